"""Language identification by rank-order profiles of character n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from rastrel.llm.common import named, tidy, unused


#: N-grams of a profile, of a language and of a document alike; also the distance of one that a profile lacks.
PROFILE = 300
LONGEST = 3
#: Documents that a language is learned from, on average at most: a bounded sample, chosen by a hash of doc_id and text.
SAMPLE = 3000
#: A text is rejected that scores less than so much of what all but one in a hundred of its language's sample reach.
FLOOR = 0.7
UNDETERMINED = "und"
_EDGE = 0x5F  # an underscore stands for each run of what is no letter
_BLOCK = 1 << 20
_LETTERS: np.ndarray | None = None


def _letters() -> np.ndarray:
    global _LETTERS
    if _LETTERS is None:
        _LETTERS = np.array([chr(i).isalpha() for i in range(0x110000)])
    return _LETTERS


def ngrams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(n-grams, counts) of one to three letters or word edges; an n-gram is its code points in 21 bits each.

    Whole texts are counted, long ones in blocks. No letter: none.
    """
    kinds, counts, tail = [], [], np.array([_EDGE], np.uint64)
    text = (text or "").lower()
    for at in range(0, len(text), _BLOCK):
        points = np.frombuffer(text[at : at + _BLOCK].encode("utf-32-le", "surrogatepass"), "<u4")
        points = np.where(_letters()[points], points, _EDGE).astype(np.uint64)
        if at + _BLOCK >= len(text):
            points = np.append(points, np.uint64(_EDGE))
        held = np.concatenate([tail, points])
        keep = np.ones(held.size, bool)
        keep[1:] = (held[1:] != _EDGE) | (held[:-1] != _EDGE)
        line = held[keep]
        old = int(keep[: tail.size].sum())  # those before count only with what follows them
        grams = [line[old:][line[old:] != _EDGE]]
        if line.size > 1:
            pair = line[:-1] << np.uint64(21) | line[1:]
            grams.append(pair[max(0, old - 1) :])
        if line.size > 2:
            triple = line[:-2] << np.uint64(42) | pair[1:]
            grams.append(triple[max(0, old - 2) :][line[1:-1][max(0, old - 2) :] != _EDGE])
        tail = line[-2:]
        found, n = np.unique(np.concatenate(grams), return_counts=True)
        kinds.append(found)
        counts.append(n)
    if len(kinds) < 2:
        return (kinds[0], counts[0]) if kinds else (np.empty(0, np.uint64), np.empty(0, np.int64))
    found, where = np.unique(np.concatenate(kinds), return_inverse=True)
    return found, np.bincount(where, np.concatenate(counts)).astype(np.int64)


def ranked(kinds: np.ndarray, counts: np.ndarray, size: int = PROFILE) -> np.ndarray:
    """The most frequent n-grams, first to last; of equal counts the smaller one first."""
    return kinds[np.argsort(-counts, kind="stable")[:size]]


class Profiles:
    """Languages' ranked n-grams, ready for distances."""

    def __init__(self, ranks: dict[str, list[int]], size: int = PROFILE):
        self.size = size
        self.languages = sorted(ranks)
        self.grams = np.unique(np.array([g for r in ranks.values() for g in r], np.uint64))
        self.ranks = np.full((self.grams.size + 1, len(self.languages)), -1, np.int64)
        for k, name in enumerate(self.languages):
            self.ranks[np.searchsorted(self.grams, np.array(ranks[name], np.uint64)), k] = np.arange(len(ranks[name]))

    def judge(self, text: str | None) -> tuple[str, float]:
        """The language of least out-of-place distance (the first by name of equals), and 1 less its share of the greatest."""
        own = ranked(*ngrams(text), self.size)
        if not own.size or not self.languages or not self.grams.size:
            return UNDETERMINED, 0.0
        at = np.minimum(np.searchsorted(self.grams, own), self.grams.size - 1)
        ranks = self.ranks[np.where(self.grams[at] == own, at, self.grams.size)]
        apart = np.where(ranks < 0, self.size, np.minimum(np.abs(ranks - np.arange(own.size)[:, None]), self.size)).sum(axis=0)
        best = int(apart.argmin())
        return self.languages[best], float(1 - apart[best] / (self.size * own.size))


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a row is kept from learning: crc32 of doc_id as text leaves 1 by 3. A null doc_id is not."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _sample(docs: DataFrame, sample: int) -> DataFrame | None:
    """lang and text of the rows to learn from: not held out, with both; equal rows once. None if there are none."""
    usable = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    sizes = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a language, as in the model
    if not sizes:
        return None
    share = F.create_map(*(F.lit(x) for lang, n in sorted(sizes.items()) for x in (lang, min(1.0, sample / n))))
    chosen = usable.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) < F.try_element_at(share, "lang") * (1 << 20))
    return chosen.distinct().select("lang", "text")


def floors(docs: DataFrame, profiles: Profiles, sample: int = SAMPLE) -> dict[str, float]:
    """The least score at which a text is taken to be in a language, by language, from the scores of the sample."""
    chosen = _sample(docs, sample)
    if chosen is None:
        return {}
    low = identify(chosen, profiles, []).groupBy("lang_pred").agg(F.percentile_approx("score", 0.01, F.lit(10_000)).alias("low"))
    return {r["lang_pred"]: FLOOR * r["low"] for r in low.collect()}


def learn(docs: DataFrame, sample: int = SAMPLE, size: int = PROFILE) -> Profiles:
    """Profiles of the languages in `lang`, from rows that are not held out and have both lang and text."""
    chosen = _sample(docs, sample)
    if chosen is None:
        return Profiles({})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}

        def told() -> Iterator[pa.RecordBatch]:
            for lang, found in held.items():
                kinds, where = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
                n = np.bincount(where, np.concatenate([c for _, c in found])).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * kinds.size, pa.string()), pa.array(kinds.astype(np.int64)), pa.array(n)], ["lang", "gram", "n"])
            held.clear()

        waiting = 0
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held.setdefault(lang, []).append(found := ngrams(text))
                waiting += found[0].size
                if waiting > 2_000_000:
                    yield from told()
                    waiting = 0
        yield from told()

    totals = chosen.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    best = totals.withColumn("rank", place).where(F.col("rank") <= size).collect()  # `size` rows for each language
    ranks: dict[str, list[tuple[int, int]]] = {}
    for r in best:
        ranks.setdefault(r["lang"], []).append((r["rank"], r["gram"]))
    return Profiles({lang: [g for _, g in sorted(found)] for lang, found in ranks.items()}, size)


def identify(docs: DataFrame, profiles: Profiles, keep: list[str], text: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The columns `keep`, then the language and the score of each row by these names; `und` and 0 for a text that is
    null or has no letter, and for all texts if no language was learned. Only the text is looked at."""
    sent = keep if text in keep else [*keep, text]
    schema = docs.select(*map(named, keep)).schema.add(names[0], "string").add(names[1], "double")
    at = sent.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            judged = [profiles.judge(t.as_py()) for t in batch.column(at)]
            made = [pa.array([x[0] for x in judged], pa.string()), pa.array([x[1] for x in judged], pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *made], [f"_{k}" for k in range(len(schema))])

    plain = docs.select(*(named(c).alias(f"_{k}") for k, c in enumerate(sent)))  # Arrow functions take no dots in names
    return plain.mapInArrow(tidy(run), StructType([StructField(f"_{k}", f.dataType) for k, f in enumerate(schema)])).toDF(*schema.names)


def predict(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of each row, by profiles learned from the rows that are not held out."""
    return identify(docs, learn(docs), ["doc_id"]).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def accepted(docs: DataFrame) -> DataFrame:
    """The rows whose text has a language: not undetermined, and with a score that is not under that language's floor.

    Columns of any names stay as they are; null texts and texts without letters go. An empty table gives an empty one.
    """
    profiles = learn(docs)
    lang, score = unused(docs, "__lang"), unused(docs, "__score")
    judged = identify(docs, profiles, docs.columns, names=(lang, score))
    least = sorted(floors(docs, profiles).items())
    enough = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in least for x in pair)), F.col(lang)), F.lit(0.0)) if least else F.lit(0.0)
    return judged.where((F.col(lang) != UNDETERMINED) & (F.col(score) > 0) & (F.col(score) >= enough)).select(*map(named, docs.columns))
