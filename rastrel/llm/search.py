"""Ranked lexical search of a set of items over all documents, by a join whose thresholds are seeded from the terms.

One pass tells each document's length and the terms of items in it; document frequencies and totals follow from that.
For each term the greatest and the kth greatest impact are stored. The kth impact of any of its terms bounds an item's
kth score from below: k documents reach it by that term alone. An item's terms are taken by falling greatest impact; those
at the end whose greatest impacts together stay under the bound cannot bring a document there, so candidates come from the
terms before (the join of items and postings on term, by blocks of documents). A candidate whose score by those, with the
bound of the rest, stays under the threshold is dropped; the others are scored exactly. A task raises its threshold by what
it has found, and tells k documents an item at most.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rastrel.llm.common import tidy, written

BEST = 50
#: Items that are searched together: one pass over the documents each. Their terms are in every task.
TOGETHER = 20_000
#: Documents whose postings are joined with the items' terms at once.
BLOCK = 8192
#: Groups in which tasks' best impacts are merged before they are merged by term.
_SALTS = 256

#: What a byte of UTF-8 counts for in a term: A-Z as a-z, other letters of ASCII, digits and all beyond as they are, and the rest parts terms.
_PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def terms_of(text: bytes | None) -> list[bytes]:
    """The terms of a UTF-8 text in their order."""
    return (text or b"").translate(_PLAIN).split()


def weight(df: int, documents: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def damping(n: np.ndarray, documents: int, length: int) -> np.ndarray:
    """m of documents of n terms."""
    return 50 + (50 * n * documents) // length


def share(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What a term's weight is multiplied by."""
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


def _postings(docs: DataFrame, id_: str, text: str, number: dict[bytes, int]) -> DataFrame:
    """doc, n (terms with repeats), terms and tfs (of those that have a number) of each row that has a term."""
    numbers = docs.sparkSession.sparkContext.broadcast(number)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = numbers.value
        for batch in batches:
            lengths, ends, terms, tfs = [], [0], [], []
            for t in batch.column(1).cast(pa.binary()):
                own = terms_of(t.as_py())
                lengths.append(len(own))
                found = [(known[w], tf) for w, tf in Counter(own).items() if w in known]
                terms.extend(k for k, _ in found)
                tfs.extend(tf for _, tf in found)
                ends.append(len(terms))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(c, pa.int32())) for c in (terms, tfs)]
            made = pa.RecordBatch.from_arrays([batch.column(0), pa.array(lengths, pa.int64()), *lists], ["doc", "n", "terms", "tfs"])
            yield made.filter(pa.array(np.array(lengths, np.int64) > 0))

    kind = docs.schema[id_].dataType.simpleString()
    rows = docs.select(F.col(id_).alias("doc"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(tidy(run), f"doc {kind}, n long, terms array<int>, tfs array<int>")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """doc and n of up to BLOCK rows; and of their postings the row, the term and tf."""
    for whole in batches:
        for at in range(0, whole.num_rows, BLOCK):
            batch = whole.slice(at, BLOCK)
            lists = batch.column(2)
            row = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            yield batch.column(0), batch.column(1).to_numpy(), row, lists.flatten().to_numpy(), batch.column(3).flatten().to_numpy().astype(np.int64)


def _best_shares(postings: DataFrame, documents: int, length: int, vocabulary: int, best: int) -> dict[int, list[int]]:
    """The `best` greatest shares of each term, falling."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = (np.empty(0, np.int64), np.empty(0, np.int64))
        for _, n, row, term, tf in _blocks(batches):
            value = share(tf, damping(n, documents, length)[row])
            term, value = np.concatenate((held[0], term)), np.concatenate((held[1], value))
            order = np.lexsort((-value, term))
            term, value = term[order], value[order]
            starts = np.flatnonzero(np.r_[True, term[1:] != term[:-1]]) if term.size else np.empty(0, np.int64)
            place = np.arange(term.size) - np.repeat(starts, np.diff(np.r_[starts, term.size]))
            held = term[place < best], value[place < best]
        kinds, starts = np.unique(held[0], return_index=True)
        lists = pa.ListArray.from_arrays(pa.array(np.r_[starts, held[0].size].astype(np.int32)), pa.array(held[1]))
        yield pa.RecordBatch.from_arrays([pa.array(kinds.astype(np.int32)), lists], ["term", "shares"])

    def merged(rows: DataFrame, *by: str) -> DataFrame:
        return rows.groupBy(*by).agg(F.slice(F.sort_array(F.flatten(F.collect_list("shares")), asc=False), 1, best).alias("shares"))

    each = postings.mapInArrow(tidy(run), "term int, shares array<long>").withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(_SALTS)))
    return {r["term"]: r["shares"] for r in merged(merged(each, "term", "salt"), "term").collect()}  # of the items' terms


def _plan(items: list[tuple[int, list[int]]], weights: dict[int, int], shares: dict[int, list[int]], best: int) -> list[tuple]:
    """Of each item: its number, terms by falling greatest impact, their weights, how many make candidates, the bound of
    the rest, and the threshold."""
    out = []
    for number, terms in items:
        own = sorted((t for t in terms if weights.get(t, 0) > 0), key=lambda t: (-weights[t] * shares[t][0], t))
        least = max([1, *(weights[t] * shares[t][best - 1] for t in own if len(shares[t]) >= best)])
        rest, cut = 0, len(own)
        while cut and rest + weights[own[cut - 1]] * shares[own[cut - 1]][0] < least:
            cut -= 1
            rest += weights[own[cut]] * shares[own[cut]][0]
        out.append((number, np.array(own, np.int64), np.array([weights[t] for t in own], np.int64), cut, rest, least))
    return out


def _found(postings: DataFrame, plan: list[tuple], documents: int, length: int, vocabulary: int, best: int) -> DataFrame:
    """(item, doc, score) of all documents that may be among an item's best, k an item and task at most."""
    told = postings.sparkSession.sparkContext.broadcast(plan)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, pa.Array]] = {}
        kind = None
        for doc, n, row, term, tf in _blocks(batches):
            kind = doc.type
            value = share(tf, damping(n, documents, length)[row])
            order = np.argsort(term, kind="stable")
            row, value = row[order], value[order]  # rows rise within a term
            ends = np.searchsorted(term[order], np.arange(vocabulary + 1))
            for number, terms, weights, cut, rest, least in told.value:
                if number in held and len(held[number][0]) == best:
                    least = max(least, int(held[number][0][-1]))
                score = np.zeros(len(doc), np.int64)
                for t, w in zip(terms[:cut].tolist(), weights[:cut].tolist()):
                    a, b = ends[t], ends[t + 1]
                    score[row[a:b]] += w * value[a:b]
                at = np.flatnonzero((score > 0) & (score + rest >= least))
                if not at.size:
                    continue
                exact = score[at]
                for t, w in zip(terms[cut:].tolist(), weights[cut:].tolist()):
                    a, b = ends[t], ends[t + 1]
                    if a < b:
                        place = np.minimum(np.searchsorted(row[a:b], at), b - a - 1)
                        exact += np.where(row[a:b][place] == at, w * value[a:b][place], 0)
                at, exact = at[exact >= least], exact[exact >= least]
                ids = doc.take(pa.array(at))
                if number in held:
                    exact, ids = np.concatenate((held[number][0], exact)), pa.concat_arrays([held[number][1], ids])
                if exact.size > best:  # equal scores by rising id, null last
                    falling = pa.table({"s": exact, "d": ids}).sort_by([("s", "descending"), ("d", "ascending")]).slice(0, best).combine_chunks()
                    held[number] = falling["s"].to_numpy(), pa.concat_arrays(falling["d"].chunks)
                else:
                    order = np.argsort(-exact, kind="stable")
                    held[number] = exact[order], ids.take(pa.array(order))
        for number, (scores, ids) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([number] * len(ids), pa.int64()), ids.cast(kind), pa.array(scores)], ["item", "doc", "score"])

    return postings.mapInArrow(tidy(run), f"item long, doc {postings.schema['doc'].dataType.simpleString()}, score long")


def _blocks_of(items: DataFrame, item: str, text: str) -> Iterator[tuple[DataFrame, list[tuple[int, list[bytes]]]]]:
    """Numbered items (__item, item), a block at a time, with each one's terms."""
    named = items.select(F.col(item).alias("item_id"), F.col(text).cast("string").alias("text")).where("text is not null")
    rows = written(named.withColumn("__item", F.monotonically_increasing_id()), "items")
    blocks = max(1, -(-rows.count() // TOGETHER))
    for k in range(blocks):
        own = rows if blocks == 1 else rows.where(F.pmod(F.xxhash64("__item"), F.lit(blocks)) == k)
        yield own, [(r["__item"], sorted(set(terms_of(r["text"].encode())))) for r in own.select("__item", "text").toLocalIterator()]


def ranked(docs: DataFrame, items: DataFrame, best: int = BEST, id_: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """item_id, rank, doc_id and score of each item's `best` documents with a score above 0; equal scores by rising id.

    Each row of docs is a document, each row of items an item, repeated ids and rows included; null ids come last among
    equal scores. Texts that are null or have no term are no documents and rank nothing. Items are searched in blocks of
    TOGETHER, each against all documents. Empty tables give no rows; other columns are not looked at.
    """
    out = None
    for rows, own in _blocks_of(items, item, item_text):
        number = {t: k for k, t in enumerate(sorted({t for _, terms in own for t in terms}))}
        postings = written(_postings(docs, id_, text, number), "postings")
        total = postings.agg(F.count(F.lit(1)).alias("n"), F.sum("n").alias("length")).first()
        df = {r["term"]: r["df"] for r in postings.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).collect()}
        weights = {t: weight(n, total["n"]) for t, n in df.items()}
        shares = _best_shares(postings, total["n"], total["length"], len(number), best) if df else {}
        plan = _plan([(k, [number[t] for t in terms]) for k, terms in own], weights, shares, best)
        made = _found(postings, [p for p in plan if p[1].size], total["n"] or 0, total["length"] or 1, len(number), best)
        place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc").asc_nulls_last()))
        top = written(made.withColumn("rank", place).where(F.col("rank") <= best), "ranked")
        told = top.join(rows.select(F.col("__item").alias("item"), "item_id"), "item").select("item_id", "rank", F.col("doc").alias("doc_id"), "score")
        out = told if out is None else out.unionByName(told)
    return out
