"""Connected components of a distributed edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from rastrel.llm.common import discard, shuffled, written

#: A node with more than one in so many edges is a hub; there are no more than twice so many of them.
HOT = 1000


#: Edges of which no node can have so many that it takes a task long: below, there are no hubs.
FEW = 1000
#: Edges whose nodes are too many for a broadcast, whatever their files' bytes are.
MANY = 100_000


def _star(edges: DataFrame, large: bool, most: int) -> DataFrame:
    """Large: link each greater neighbour of u to the least in its neighbourhood. Small: the same for lesser neighbours.

    The least is found by a combining aggregation and joined back: to a hub's edges by one broadcast of the hubs, wherever
    they are, and to the others' by a shuffle, so no task gets all edges of a hub. edges has no more than `most` rows, and
    is read from a table.
    """
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count(F.lit(1)).alias("n"))
    if most > MANY:
        least = shuffled(least)
    if most > FEW:
        hub = F.col("n") * HOT > most
        told = both.join(F.broadcast(least.where(hub).select("u", F.col("m").alias("h"))), "u", "left")
        rest = told.where("h is null").select("u", "v").join(least.where(~hub).select("u", "m"), "u")
        linked = told.where("h is not null").select("u", "v", F.col("h").alias("m")).union(rest.select("u", "v", "m"))
    else:
        linked = both.join(least.select("u", "m"), "u")
    linked = linked.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")) if large else (
        linked.select(F.col("v").alias("u"), F.col("m").alias("v")).union(linked.select("u", F.col("m").alias("v")))
    )
    return linked.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _put(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The edges, written, and a fingerprint of their set that is observed while they are: equal before and after a round
    only when the round changed nothing."""
    mixed, seen = F.xxhash64("u", "v"), Observation()
    made = written(edges.observe(seen, F.count(F.lit(1)).alias("n"), F.bit_xor(mixed).alias("x"), F.sum(mixed.cast("decimal(38,0)")).alias("s")), "links")
    return made, tuple(seen.get[c] for c in "nxs")


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) of each node of the edges (a, b), component being the least node that it reaches.

    Nodes are longs; null ends, loops, and repeated or turned edges change nothing. Each half of a round is
    written to the shared folder, so a lost executor costs at most that.
    """
    now, state = _put(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    for _ in range(max_rounds):
        most = state[0]
        if not most:
            break
        half = written(_star(now, True, most), "links")
        last, before = now, state
        now, state = _put(_star(half, False, most))
        discard(last)
        discard(half)
        if state == before:
            break
    else:
        raise RuntimeError(f"components have not settled in {max_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        now.select(F.col("v").alias("node"), F.col("v").alias("component"))
    ).distinct()
