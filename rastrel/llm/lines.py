"""Repeated lines, found by two Bloom filters.

A first pass notes each line's key in a filter of what was seen once, and in a second one if all its slots were taken
before. Tasks' filters are merged slice by slice: a slot is in the second filter if any task has it there or two have it
in the first. That holds every key of two documents and few others. Only keys in it are shuffled, as 128-bit digests with
the ids of their documents, for the exact count and the choice of the first document; and only documents with such keys
meet what they lose. The filters have a fixed size: a corpus too large for them makes more suspects, and no other result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rastrel.llm.common import named, spread_join, tidy, written

#: Code points of a key at least.
LEAST = 10
#: Slots of a filter, two of which a key takes. 32 MB: about 100 million different keys before most become suspects.
SLOTS = 1 << 28
#: A key with more than one in so many suspects is hot; there are no more than so many of them.
HOT = 1000
#: Bytes of a filter that are merged together.
SLICE = 1 << 16
#: White space that is stripped at both ends of a line.
BLANK = b" \t\n\x0b\x0c\r"


def keys_of(text: bytes | None, least: int = LEAST) -> tuple[list[bytes], list[bytes | None]]:
    """The lines of a UTF-8 text, and each one's key, or None where that has fewer than `least` code points."""
    lines = (text or b"").split(b"\n")
    keys = [line.strip(BLANK).lower() for line in lines]  # bytes: A-Z only
    enough = [len(k) >= 4 * least or (len(k) >= least and len(k.decode("utf-8", "replace")) >= least) for k in keys]
    return lines, [k if e else None for k, e in zip(keys, enough)]


def _digests(keys: list[list[bytes]]) -> np.ndarray:
    """128-bit digests of all keys as rows of two longs."""
    import xxhash

    return np.frombuffer(b"".join(xxhash.xxh3_128_digest(k) for own in keys for k in own), ">i8").astype(np.int64).reshape(-1, 2)


def _own(texts: pa.Array, least: int) -> list[list[bytes]]:
    """The different keys of each text."""
    return [list({k for k in keys_of(t.as_py(), least)[1] if k is not None}) for t in texts]


def _take(filter_: np.ndarray, slots: np.ndarray) -> None:
    for bit in range(8):
        filter_[slots[slots & 7 == bit] >> 3] |= 1 << bit


def _all_in(filter_: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """Whether all slots of a row are taken."""
    return ((filter_[slots >> 3] >> (slots & 7).astype(np.uint8)) & 1).all(axis=1)


_SLICED = "slice int, places binary, once binary, twice binary"


def _sparse(once: np.ndarray, twice: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The slices of two filters that are not empty: the places of bytes that are set, and those bytes."""
    width = min(SLICE, once.size)
    for k in np.flatnonzero(once.reshape(-1, width).view(np.uint64).any(axis=1)):
        part = slice(k * width, (k + 1) * width)
        at = np.flatnonzero(once[part])
        row = [int(k)], [at.astype(np.uint16).tobytes()], [once[part][at].tobytes()], [twice[part][at].tobytes()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, (pa.int32(), *[pa.binary()] * 3))], [c.split()[0] for c in _SLICED.split(", ")])


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One pair of slices for each run of rows of one slice; of it, what the second filter has."""
    at, once, twice = None, np.zeros(SLICE, np.uint8), np.zeros(SLICE, np.uint8)

    def told() -> Iterator[pa.RecordBatch]:
        if at is not None and (places := np.flatnonzero(twice)).size:
            row = [at], [places.astype(np.uint16).tobytes()], [twice[places].tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, (pa.int32(), pa.binary(), pa.binary()))], ["slice", "places", "twice"])

    for batch in batches:
        for k, places, ones, twos in zip(*(c.to_pylist() for c in batch.columns)):
            if k != at:
                yield from told()
                at, once[:], twice[:] = k, 0, 0
            p, a, b = np.frombuffer(places, np.uint16), np.frombuffer(ones, np.uint8), np.frombuffer(twos, np.uint8)
            twice[p] |= b | (once[p] & a)
            once[p] |= a
    yield from told()


def _suspected(texts: DataFrame, least: int, slots: int) -> list[tuple[int, bytes, bytes]]:
    """The second filter of a column of texts, by slices; as large as the filter at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros(slots // 8, np.uint8), np.zeros(slots // 8, np.uint8)
        for batch in batches:
            found, n = np.unique(_digests(_own(batch.column(0).cast(pa.binary()), least)), axis=0, return_counts=True)
            own = found & (slots - 1)
            _take(twice, own[(n > 1) | _all_in(once, own)].ravel())
            _take(once, own.ravel())
        yield from _sparse(once, twice)

    made = texts.mapInArrow(tidy(run), _SLICED).repartition(F.col("slice")).sortWithinPartitions("slice")
    return [tuple(r) for r in made.mapInArrow(_merged, "slice int, places binary, twice binary").collect()]


def _filter(parts: list[tuple[int, bytes, bytes]], slots: int) -> np.ndarray:
    out = np.zeros(slots // 8, np.uint8)
    for k, places, values in parts:
        out[k * SLICE + np.frombuffer(places, np.uint16).astype(np.int64)] = np.frombuffer(values, np.uint8)
    return out


def without_repeats(docs: DataFrame, order: str = "doc_id", text: str = "text", least: int = LEAST, slots: int = SLOTS) -> DataFrame:
    """The columns of docs as a struct `doc`; kept: the text without its repeated lines; n_lines, n_dropped.

    Lines end at \\n. A key is a line without white space at its ends, A-Z in lower case. Keys of `least` code points or
    more that two documents hold lose their lines in all but the first by `order`, which keeps all of them. Rows of one
    `order` (any type that has one) are one document; a row without one is a document with those of equal text, after
    all others. A null text is an empty line. An empty table gives none; other columns may have any name and type.
    """
    rows = docs.select(F.struct(*map(named, docs.columns)).alias("doc"), named(order).alias("id"), F.coalesce(named(text).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("own", F.xxhash64("text"))
    parts = rows.sparkSession.sparkContext.broadcast(_suspected(rows.select("text"), least, slots))

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        taken = _filter(parts.value, slots)
        for batch in batches:
            own = _own(batch.column(batch.num_columns - 1).cast(pa.binary()), least)
            found = _digests(own)
            fits = _all_in(taken, found & (slots - 1))
            ends = np.concatenate(([0], np.cumsum(fits)))[np.concatenate(([0], np.cumsum([len(o) for o in own], dtype=np.int64)))].astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.ascontiguousarray(found[fits, k]))) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *lists], [*batch.schema.names[:-1], "a", "b"])

    def held(*keep: str) -> DataFrame:
        kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in keep)
        return rows.select(*keep, "text").mapInArrow(tidy(suspects), f"{kinds}, a array<long>, b array<long>").where(F.size("a") > 0)

    each = held("id", "own").select("id", "own", F.explode(F.arrays_zip("a", "b")).alias("k")).select("id", "own", "k.a", "k.b")
    each = written(each, "suspect-lines")
    alone = F.when(F.col("id").isNull(), F.col("own"))
    by_key = each.groupBy("a", "b").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.min(alone).alias("first"), F.max(alone).alias("last"), F.count(F.lit(1)).alias("n"))
    repeated = by_key.where((F.col("low") != F.col("high")) | (F.col("first") != F.col("last")) | (F.col("low").isNotNull() & F.col("first").isNotNull()))
    is_first = F.when(F.col("low").isNull(), F.col("own") == F.col("first")).otherwise(F.col("id").eqNullSafe(F.col("low")))
    often = repeated.where(F.col("n") * HOT > each.count())
    lost = spread_join(each, repeated.select("a", "b", "low", "first"), ["a", "b"], often).where(~is_first)
    lists = lost.groupBy("id", "own").agg(F.collect_set(F.struct("a", "b")).alias("lost"))  # of one text: as many as it has lines
    lists = lists.select(F.col("id").alias("of"), F.col("own").alias("with"), F.col("lost.a").alias("a"), F.col("lost.b").alias("b"))

    def flagged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        taken = _filter(parts.value, slots)
        for batch in batches:
            found = [keys_of(t.as_py(), least) for t in batch.column(batch.num_columns - 1).cast(pa.binary())]
            own = [[k for k in keys if k is not None] for _, keys in found]
            fits = np.concatenate((_all_in(taken, _digests(own) & (slots - 1)), [False]))
            starts = np.concatenate(([0], np.cumsum([len(o) for o in own], dtype=np.int64)))
            total = np.concatenate(([0], np.cumsum(fits)))
            made = [pa.array([len(lines) for lines, _ in found], pa.int64()), pa.array(total[starts[1:]] > total[starts[:-1]])]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], [*batch.schema.names, "n_lines", "suspect"])

    def dropped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, gone = [], []
            for t, a, b in zip(batch.column("text").cast(pa.binary()), batch.column("a").to_pylist(), batch.column("b").to_pylist()):
                lost = set(zip(a or (), b or ()))
                lines, keys = keys_of(t.as_py(), least)
                if lost:
                    digests = iter(map(tuple, _digests([[k for k in keys if k is not None]]).tolist()))
                    lines = [line for line, k in zip(lines, keys) if k is None or next(digests) not in lost]
                kept.append(b"\n".join(lines))
                gone.append(len(keys) - len(lines))
            made = [pa.array(kept, pa.binary()), pa.array(gone, pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("n_lines"), *made], ["doc", "n_lines", "kept", "n_dropped"])

    schema = rows.select("doc", "id", "own", "text").schema.add("n_lines", "long").add("suspect", "boolean")
    told = rows.select("doc", "id", "own", "text").mapInArrow(tidy(flagged), schema)
    clean = told.where("not suspect").select("doc", F.col("text").alias("kept"), "n_lines", F.lit(0).cast("long").alias("n_dropped"))
    met = told.where("suspect").join(lists, F.col("id").eqNullSafe(F.col("of")) & (F.col("own") == F.col("with")), "left")
    out = rows.select("doc").schema.add("n_lines", "long").add("kept", "binary").add("n_dropped", "long")
    cut = met.select("doc", "text", "n_lines", "a", "b").mapInArrow(tidy(dropped), out)
    return clean.unionByName(cut.withColumn("kept", F.col("kept").cast("string")))


def told(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines (before dropping), n_dropped, and the SHA-256 of the text that is kept."""
    found = without_repeats(docs.select("doc_id", "text"))
    return found.select("doc.doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
