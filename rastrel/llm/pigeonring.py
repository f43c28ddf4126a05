"""Fingerprints within three bits of each other, by pigeonring filtering: exact, and joined by equal keys.

A 64-bit fingerprint is a ring of four 16-bit segments. If two fingerprints differ in at most three bits, some start
on the ring has a chain of segments whose cumulative differences stay within the proportional budgets 0.75, 1.5, 2.25
and 3, that is 0, 1, 2 and 3 bits. The join key covers the first two links of the chain (an equal segment, then one
with at most one bit of difference, enumerated on one side); the third link and the whole are conditions of the join.
Beyond 2^32 fingerprints the key also takes bits of the third segment, in which the budget of two bits is enumerated in
the same way, so a probe meets about one fingerprint by chance, however many there are; all links are found at any size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rastrel.llm.common import shuffled

MAX_BITS = 3
SEGMENTS = 4
SEGMENT_BITS = 16


def _segment(c: Column, k: int) -> Column:
    return F.shiftrightunsigned(c, SEGMENT_BITS * (k % SEGMENTS)).bitwiseAND((1 << SEGMENT_BITS) - 1)


def _turned(c: Column, start: int) -> Column:
    """The ring from `start`: that segment lowest."""
    at = SEGMENT_BITS * start
    return c if not at else F.shiftrightunsigned(c, at).bitwiseOR(F.shiftleft(c, 64 - at))


def further_bits(fingerprints: int) -> int:
    """Bits of the third segment in the key, by the number of different fingerprints."""
    return min(SEGMENT_BITS, max(0, fingerprints.bit_length() - 2 * SEGMENT_BITS))


def _flips(further: int) -> list[int]:
    """What a key may differ in: at most one bit of the second segment, two of that and of `further` bits of the third."""
    second = [1 << SEGMENT_BITS + bit for bit in range(SEGMENT_BITS)]
    third = [1 << 2 * SEGMENT_BITS + bit for bit in range(further)]
    return [0, *second, *third, *(x | y for x in second for y in third), *(x | y for k, x in enumerate(third) for y in third[:k])]


def hamming_links(fingerprints: DataFrame, further: int = 0, node: str = "fp", part: str | None = None) -> DataFrame:
    """Pairs (a, b), a < b, of the rows `node` whose fingerprints `fp` differ in no more than 3 bits; all of them, whatever
    `further` is: it makes the key longer, for more probes. Without a node, rows are distinct fingerprints. Rows of one
    `part`, where that is given, are no pair, so a group that is one part already makes none."""
    starts = F.explode(F.array(*(F.struct(F.lit(k).alias("start"), _turned(F.col("fp"), k).alias("ring")) for k in range(SEGMENTS))))
    own = [F.col(node).alias("node"), *([F.col(part).alias("part")] if part else [])]
    rings = fingerprints.select(*own, starts.alias("s")).select("node", *(["part"] if part else []), "s.start", "s.ring")
    low = (1 << 2 * SEGMENT_BITS + further) - 1
    key = F.col("ring").bitwiseAND(low)
    index = rings.withColumn("key", key).alias("x")
    probes = rings.withColumn("key", F.explode(F.array(*(key.bitwiseXOR(F.lit(x)) for x in _flips(further))))).alias("y")
    differ = F.col("x.ring").bitwiseXOR(F.col("y.ring"))
    within = (F.col("x.node") < F.col("y.node")) & (F.bit_count(differ.bitwiseAND((1 << 3 * SEGMENT_BITS) - 1)) <= 2) & (F.bit_count(differ) <= MAX_BITS)
    if part:
        within = within & (F.col("x.part") != F.col("y.part"))
    joined = index.join(shuffled(probes), (F.col("x.start") == F.col("y.start")) & (F.col("x.key") == F.col("y.key")) & within)
    return joined.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()
