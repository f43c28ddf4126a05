"""Re-Pair grammar compression of token ids: frequent pairs become nonterminals, shard by shard.

A shard holds whole documents in order. Its bytes: the header (see HEADER), then arrays in little-endian order:
doc_id long and a null flag for each document; tokens and codes of each document, unsigned 32-bit; for each rule its
two symbols and its expansion length, unsigned 32-bit; the codes, unsigned of `width` bytes; then the CRC-32 of all
before it. Symbol base + j stands for rule j, whose symbols are ids or earlier rules. Pairs never span two documents,
so a document is read from its codes alone.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rastrel.llm.common import written
from rastrel.llm.tokens import encoder

MAGIC = b"RPG1"
HEADER = struct.Struct("<4sIQQIIB")  # magic, documents, tokens, codes, rules, base, width
#: Tokens of a shard at most, but for a longer document, which is a shard of its own.
SHARD_TOKENS = 1 << 20
#: A pair is replaced if it occurs so often at least: a rule costs 12 bytes.
LEAST = 8
#: Of the table that a round's pairs are looked up in.
SLOTS = 1 << 16


def _slot(pairs: np.ndarray) -> np.ndarray:
    if pairs.dtype == np.uint32:
        return (pairs * np.uint32(0x9E3779B1) >> np.uint32(16)).astype(np.intp)
    return (pairs * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(48)).astype(np.intp)


def _compress(ids: np.ndarray, ends: np.ndarray, base: int, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, document end of each code, rules) of ids; ends marks the last id of each document.

    Rounds go on until no pair is found `least` times. A pair that a round replaces is gone, so the next one counts
    those with a symbol of that round and those that were frequent but had to wait. Symbols have 16 bits, and a pair 32,
    until those run out.
    """
    half, kind = (16, np.uint32) if base < (1 << 16) - 1 else (32, np.uint64)
    none = kind((1 << 2 * half) - 1)
    codes, rules, room = ids.astype(kind), [], (1 << half) - 1 - base
    newest, waiting = 0, np.empty(0, kind)  # the least symbol of the round before, and the pairs that wait

    def wide(pairs: np.ndarray) -> np.ndarray:
        return pairs.astype(np.uint64) >> np.uint64(16) << np.uint64(32) | pairs.astype(np.uint64) & np.uint64(0xFFFF)

    while codes.size > 1:
        if not room and half == 16:
            half, kind = 32, np.uint64
            none, room = kind((1 << 64) - 1), (1 << 32) - (1 << 16)
            codes, rules, waiting = codes.astype(kind), [wide(r) for r in rules], wide(waiting)
        pairs = (codes[:-1] << kind(half)) | codes[1:]
        if not newest:
            places = np.flatnonzero(~ends[:-1])
        else:
            fresh = codes >= kind(newest)
            open_ = fresh[:-1] | fresh[1:]
            if waiting.size:
                held = np.zeros(SLOTS, bool)
                held[_slot(waiting)] = True
                open_ |= held[_slot(pairs)]
            places = np.flatnonzero(open_ & ~ends[:-1])
        pairs = pairs[places]  # of each pair in it, all places
        kinds, counts = np.unique(pairs, return_counts=True)
        good = (counts >= least) & (kinds != none)
        kinds, counts = kinds[good], counts[good]
        if not kinds.size:
            break
        order = np.argsort(-counts, kind="stable")
        take = min(room, SLOTS // 12)
        best = kinds[order[:take]]
        slot = _slot(best)
        _, first = np.unique(slot, return_index=True)  # of pairs that share a slot, the most frequent; the others wait
        table = np.full(SLOTS, none)
        table[slot[first]] = best[first]
        waiting = np.concatenate([np.delete(best, first), kinds[order[take:]]])
        at = _slot(pairs)
        hit = (table[at] == pairs) & (pairs != none)
        where, at = places[hit], at[hit]
        # of overlapping places in a run, the first, third and so on
        starts = np.r_[True, np.diff(where) > 1]
        run_start = np.maximum.accumulate(np.where(starts, np.arange(where.size), 0))
        chosen = (np.arange(where.size) - run_start) % 2 == 0
        where, at = where[chosen], at[chosen]
        used = np.zeros(SLOTS, bool)
        used[at] = True
        newest = base + sum(map(len, rules))
        number = (np.cumsum(used) - 1 + newest).astype(kind)
        rules.append(table[used])
        room -= rules[-1].size
        codes[where] = number[at]
        ends[where] = ends[where + 1]
        keep = np.ones(codes.size, bool)
        keep[where + 1] = False
        codes, ends = codes[keep], ends[keep]
    found = np.concatenate(rules) if rules else np.empty(0, kind)
    return codes, ends, np.stack([found >> kind(half), found & kind((1 << half) - 1)], axis=1).astype(np.int64)


def _levels(rules: np.ndarray, base: int) -> list[np.ndarray]:
    """The rules by how deep they go: those of ids first, then those of ids and rules before."""
    inside = np.where(rules >= base, rules - base, len(rules))
    level = np.zeros(len(rules) + 1, np.int64)
    level[-1] = -1
    while True:
        new = level[inside].max(axis=1, initial=-1) + 1
        if (new == level[:-1]).all():
            break
        level[:-1] = new
    order = np.argsort(level[:-1], kind="stable")
    return np.split(order, np.flatnonzero(np.diff(level[:-1][order])) + 1) if len(rules) else []


def expansion_lengths(rules: np.ndarray, base: int) -> np.ndarray:
    """Ids that each rule stands for."""
    size = np.ones(base + len(rules), np.int64)
    for level in _levels(rules, base):
        size[base + level] = size[rules[level]].sum(axis=1)
    return size[base:]


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of ranges laid end to end."""
    kind = np.int32 if int(sizes.sum(dtype=np.int64)) < 1 << 31 else np.int64
    ends = np.cumsum(sizes, dtype=kind)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if ends.size else 0, dtype=kind)


def expand(codes: np.ndarray, rules: np.ndarray, base: int) -> np.ndarray:
    """The ids of codes: each takes its own from a table of all symbols' ids, laid end to end, level by level."""
    size = np.ones(base + len(rules), np.int32)
    size[base:] = expansion_lengths(rules, base)
    start = np.cumsum(size, dtype=np.int32) - size
    table = np.arange(int(size.sum()), dtype=np.uint32)  # an id stands for itself
    for level in _levels(rules, base):
        both = rules[level].ravel()
        table[_ranges(start[base + level], size[base + level])] = table[_ranges(start[both], size[both])]
    return table[_ranges(start[codes], size[codes])]


def write_shard(doc_ids: list[int | None], ids: list[bytes], base: int) -> bytes:
    """A shard of documents, each given by its ids as little-endian unsigned 32-bit integers, one at least."""
    tokens = np.array([len(x) // 4 for x in ids], np.int64)
    flat = np.frombuffer(b"".join(ids), "<u4")
    base = max(base, int(flat.max()) + 1 if flat.size else 0)
    ends = np.zeros(flat.size, bool)
    ends[np.cumsum(tokens) - 1] = True
    codes, ends, rules = _compress(flat, ends, base)
    width = 2 if base + len(rules) <= 1 << 16 else 4
    body = b"".join([
        HEADER.pack(MAGIC, len(ids), int(tokens.sum()), codes.size, len(rules), base, width),
        np.array([d or 0 for d in doc_ids], "<i8").tobytes(), np.array([d is None for d in doc_ids], "u1").tobytes(),
        tokens.astype("<u4").tobytes(), np.diff(np.flatnonzero(ends) + 1, prepend=0).astype("<u4").tobytes(),
        rules.astype("<u4").tobytes(), expansion_lengths(rules, base).astype("<u4").tobytes(), codes.astype(f"<u{width}").tobytes(),
    ])
    return body + struct.pack("<I", zlib.crc32(body))


class Shard(NamedTuple):
    doc_ids: list[int | None]
    tokens: np.ndarray
    code_ends: np.ndarray
    rules: np.ndarray
    lengths: np.ndarray
    codes: np.ndarray
    base: int

    def document(self, i: int) -> np.ndarray:
        """The ids of document i, from its own codes and the rules that they use."""
        return self.tokens_at(i, 0, int(self.tokens[i]))

    def tokens_at(self, i: int, start: int, n: int) -> np.ndarray:
        """n ids of document i from `start` on (fewer at its end). The stored lengths say which codes hold them, so that
        only those are read, and only those rules followed whose ids are asked for."""
        codes = self.codes[self.code_ends[i - 1] if i else 0 : self.code_ends[i]].astype(np.int64)
        size = np.ones(codes.size, np.int64)
        size[codes >= self.base] = self.lengths[codes[codes >= self.base] - self.base]
        ends = np.cumsum(size)
        first, last = np.searchsorted(ends, [start, start + n - 1], side="right")
        left = codes[first : last + 1][::-1].tolist()
        skip, out = start - int(ends[first - 1] if first else 0), []
        while left and len(out) < n:
            code = left.pop()
            length = int(self.lengths[code - self.base]) if code >= self.base else 1
            if skip >= length:
                skip -= length
            elif code < self.base:
                out.append(code)
            else:
                left += self.rules[code - self.base][::-1].tolist()
        return np.array(out, np.uint32)

    def every(self) -> np.ndarray:
        return expand(self.codes, self.rules, self.base)


def read_shard(data: bytes) -> Shard:
    """The parts of a shard; a damaged one raises ValueError."""
    if data[:4] != MAGIC or zlib.crc32(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
        raise ValueError("not a whole shard")
    _, docs, _, codes, rules, base, width = HEADER.unpack_from(data)
    at = HEADER.size

    def take(n: int, kind: str) -> np.ndarray:
        nonlocal at
        found = np.frombuffer(data, kind, n, at)
        at += found.nbytes
        return found

    ids, none = take(docs, "<i8"), take(docs, "u1")
    tokens, parts = take(docs, "<u4").astype(np.int64), take(docs, "<u4").astype(np.int64)
    table, lengths = take(2 * rules, "<u4").astype(np.int64).reshape(-1, 2), take(rules, "<u4")
    named = [None if n else d for d, n in zip(ids.tolist(), none.tolist())]
    return Shard(named, tokens, np.cumsum(parts), table, lengths, take(codes, f"<u{width}"), base)


def shards(docs: DataFrame, tokenizer: str, end_id: int = 0, blanks: bool = True, base: int = 50257, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """(part, block, documents, tokens, payload) of shards in ascending doc_id order, by range partitions of doc_id.

    Documents of one doc_id follow the hash of their texts, by which they are split over tasks too; null doc_ids come
    first. A null or empty text has the end id only. An empty table gives no shards.
    """
    end = end_id.to_bytes(4, "little")
    schema = pa.schema([("part", pa.int64()), ("block", pa.int64()), ("documents", pa.int64()), ("tokens", pa.int64()), ("payload", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, blanks)
        part = TaskContext.get().partitionId()
        held_docs: list[int | None] = []
        held: list[bytes] = []
        size = block = 0

        def shard() -> pa.RecordBatch:
            row = [part, block, len(held), sum(map(len, held)) // 4, write_shard(held_docs, held, base)]
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, schema)], schema=schema)

        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), encode.encode_many(batch.column(1).to_pylist())):
                ids += end
                if held and size + len(ids) > 4 * shard_tokens:
                    yield shard()
                    held_docs, held, size, block = [], [], 0, block + 1
                held_docs.append(doc_id)
                held.append(ids)
                size += len(ids)
        if held:
            yield shard()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("hash"), F.monotonically_increasing_id().alias("at"))
    order = ("doc_id", "hash", "at")  # equal rows go by where they stood
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return ordered.select("doc_id", "text").mapInArrow(run, "part long, block long, documents long, tokens long, payload binary")


def read_documents(table: DataFrame) -> DataFrame:
    """(part, block, place, doc_id, n_tokens, ids_crc32) of each document, decoded from the shards' payloads."""
    names = ["part", "block", "place", "doc_id", "before", "n_tokens", "ids_crc32"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, block, payload in zip(*(batch.column(i) for i in range(3))):
                shard = read_shard(payload.as_py())
                data = memoryview(shard.every().astype("<u4", copy=False)).cast("B")
                stops = np.cumsum(shard.tokens)
                starts = stops - shard.tokens
                n = len(shard.doc_ids)
                crcs = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(starts.tolist(), stops.tolist())]
                columns = [[part.as_py()] * n, [block.as_py()] * n, range(n), shard.doc_ids, starts, shard.tokens, crcs]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

    return table.select("part", "block", "payload").mapInArrow(run, ", ".join(f"{n} long" for n in names))


def store_and_read(docs: DataFrame, tokenizer: str, end_id: int = 0) -> DataFrame:
    """Writes docs as shards to the shared folder and reads them back: doc_id, start, n_tokens, ids_crc32 and the place.

    start counts the ids of all documents before it, over all shards: sums by range partition (one row each), and
    within a partition by shard.
    """
    stored = written(shards(docs, tokenizer, end_id), "token-shards")
    parts = stored.groupBy("part").agg(F.sum("tokens").alias("all"))
    by_part = parts.select("part", (F.sum("all").over(Window.orderBy("part")) - F.col("all")).alias("part_start"))
    inside = F.sum("tokens").over(Window.partitionBy("part").orderBy("block")) - F.col("tokens")
    at = stored.select("part", "block", inside.alias("block_start")).join(by_part, "part")
    return read_documents(stored).join(at, ["part", "block"]).select(
        "doc_id", (F.col("part_start") + F.col("block_start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32", "part", "block", "place"
    )
