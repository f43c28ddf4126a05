"""Harmonic packing of tokenized documents into sequences, worker by worker.

A piece of length n is of class k = capacity // n: between capacity / (k + 1) and capacity / k. A bin of class k
takes k pieces of that class, whatever came between. Documents may be cut, so a rest that would leave more than
`slack` tokens in its class's bins is cut at the top of the next class; pieces that stay in unfilled bins at the end
of a worker's input are laid end to end and cut at the capacity, and what is then left at powers of two.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rastrel.llm.common import tidy
from rastrel.llm.tokens import encoder

CAPACITY = 2048
WIDTH = 4
#: Room for a worker's sequence numbers; the worker's own number stands above it.
SEQUENCE_BITS = 40
#: Pieces of text whose ids a worker remembers; other operators of a pipeline share its memory.
PIECES_KEPT = 600_000


class Piece(NamedTuple):
    doc_id: int | None
    start: int
    ids: bytes
    doc_tokens: int


def cuts(n: int, capacity: int = CAPACITY, slack: int | None = None) -> list[int]:
    """Lengths of the pieces of a document of n tokens, in order."""
    slack = capacity // 64 if slack is None else slack
    lengths = [capacity] * (n // capacity)
    rest = n % capacity
    while rest:
        k = capacity // rest
        take = rest if k * rest >= capacity - slack else capacity // (k + 1)
        lengths.append(take)
        rest -= take
    return lengths


def _powers(n: int) -> list[int]:
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


def harmonic_bins(documents: Iterator[tuple[int | None, bytes]], capacity: int = CAPACITY, slack: int | None = None) -> Iterator[tuple[int, list[Piece]]]:
    """(class, pieces) of each sequence for documents given as (doc_id, ids); class 0 holds what filled no class's bin.

    Each id goes to one sequence. Memory is bounded by one unfilled bin for each class, whatever the input.
    """
    bins: dict[int, list[Piece]] = {}
    for doc_id, ids in documents:
        n, start = len(ids) // WIDTH, 0
        for length in cuts(n, capacity, slack):
            piece = Piece(doc_id, start, ids[start * WIDTH : (start + length) * WIDTH], n)
            start += length
            k = capacity // length
            held = bins.setdefault(k, [])
            held.append(piece)
            if len(held) == k:
                yield k, bins.pop(k)
    rests = [p for k in sorted(bins) for p in bins[k]]
    total = sum(len(p.ids) for p in rests) // WIDTH
    sizes = [capacity] * (total // capacity) + _powers(total % capacity)
    sequence, room = [], sizes.pop(0) if sizes else 0
    for piece in rests:
        while piece.ids:
            part = piece._replace(ids=piece.ids[: room * WIDTH])
            sequence.append(part)
            taken = len(part.ids) // WIDTH
            piece = piece._replace(start=piece.start + taken, ids=piece.ids[taken * WIDTH :])
            room -= taken
            if not room:
                yield 0, sequence
                sequence, room = [], sizes.pop(0) if sizes else 0


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, class long"


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = CAPACITY, slack: int | None = None, blanks: bool = False, with_ids: bool = False, kept: int = PIECES_KEPT) -> DataFrame:
    """One row for each piece of each document (columns doc_id and text; others are ignored), without a shuffle.

    A null or empty text has the end id only. Repeated rows are packed as often as they stand; a null doc_id stays
    null. An empty table gives no pieces. Sequence numbers are unique, not gapless. with_ids adds the ids themselves.
    kept: pieces whose ids a worker remembers at most, which costs memory and saves time.
    """
    names = [c.split()[0] for c in SCHEMA.split(", ")] + ["ids"] * with_ids
    end = end_id.to_bytes(WIDTH, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        encode = encoder(tokenizer, blanks, kept)
        base = TaskContext.get().partitionId() << SEQUENCE_BITS
        types = pa.schema([(n, pa.list_(pa.int64()) if n == "ids" else pa.int64()) for n in names])

        def documents() -> Iterator[tuple[int | None, bytes]]:
            for batch in batches:
                for doc_id, ids in zip(batch.column(0).to_pylist(), encode.encode_many(batch.column(1).to_pylist())):
                    yield doc_id, ids + end

        rows: list[tuple] = []
        for number, (k, pieces) in enumerate(harmonic_bins(documents(), capacity, slack)):
            offset = 0
            for p in pieces:
                length = len(p.ids) // WIDTH
                row = (p.doc_id, p.start, length, zlib.crc32(p.ids), p.doc_tokens, base + number, offset, k)
                rows.append((*row, np.frombuffer(p.ids, "<u4").astype(np.int64)) if with_ids else row)
                offset += length
            if len(rows) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), types)], schema=types)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), types)], schema=types)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(tidy(run), SCHEMA + ", ids array<long>" * with_ids)
