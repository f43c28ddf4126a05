"""Placement of rows on shards by a permutation-filled lookup table.

Each shard has its own order of preference over the slots of a table of prime size, a walk by two hashes of its name;
the shards take turns claiming the next free slot of their order. A row goes to the shard of the slot its key hashes
to. The table has a fixed size, so it is broadcast, and a shard that leaves moves little beyond its own slots.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHARDS = 64
#: A prime, over a hundred slots a shard: shares differ by less than one in a hundred.
SLOTS = 16381
_HEX = 15


def shard_names(shards: int = SHARDS) -> list[str]:
    return [f"shard-{i:05d}" for i in range(shards)]


def _hash(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:_HEX], 16)


def lookup_table(names: list[str], slots: int = SLOTS) -> list[int]:
    """The shard (by its place in names) of each slot. slots is a prime, and no smaller than the number of shards."""
    if not names or slots < len(names) or any(slots % k == 0 for k in range(2, int(slots**0.5) + 1)):
        raise ValueError("a prime number of slots, one for each shard at least")
    walks = [(_hash(f"offset:{n}") % slots, _hash(f"skip:{n}") % (slots - 1) + 1) for n in names]
    table, taken, steps = [-1] * slots, 0, [0] * len(names)
    while True:
        for i, (offset, skip) in enumerate(walks):
            while table[slot := (offset + steps[i] * skip) % slots] >= 0:
                steps[i] += 1
            table[slot] = i
            steps[i] += 1
            taken += 1
            if taken == slots:
                return table


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """The slot of a key; a null key is an empty one."""
    digest = F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, _HEX)
    return F.conv(digest, 16, 10).cast("long") % slots


def placed(docs: DataFrame, key: str = "doc_id", names: list[str] | None = None, slots: int = SLOTS) -> DataFrame:
    """docs with `slot` and `shard` by the hash of the key, without a shuffle. The broadcast has `slots` rows, always.

    Columns of docs that have these names are replaced, unless one of them is the key. A null key is an empty one;
    repeated rows stay; an empty table gives no rows.
    """
    names = names or shard_names()
    if key in ("slot", "shard"):
        raise ValueError(f"the key must not be called {key}")
    spark: SparkSession = docs.sparkSession
    table = spark.createDataFrame(list(enumerate(lookup_table(names, slots))), "__slot long, shard int")
    at = docs.drop("shard", "__slot").withColumn("slot", slot_of(F.col(key), slots))
    return at.join(F.broadcast(table), F.col("slot") == F.col("__slot")).drop("__slot")


def write_shards(docs: DataFrame, path: str, key: str = "doc_id", names: list[str] | None = None, salts: int = 1) -> None:
    """Writes docs under path by shard; salts splits each shard over so many tasks."""
    salt = F.pmod(F.xxhash64(key, F.lit(1)), F.lit(salts))
    placed(docs, key, names).repartition("shard", salt).write.partitionBy("shard").parquet(path)
