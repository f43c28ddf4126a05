"""Benchmark decontamination by template canonicalisation.

Numbers, names and units become typed placeholders, so a question keeps its template when its parameters change.
Windows of five template words are hash-joined between documents and benchmark items. Windows that continue each
other make a run, within which the slots must agree: each value of the item has one value in the document. Windows
whose values are the item's own count by themselves too, whether or not the slots of their run agree. A window of
nothing but slots says little: it is known by its values.

A capitalised word inside a sentence is a name; at the start of one it is a name unless the benchmark has the word in
lower case somewhere.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rastrel.llm.common import named, shuffled, tidy, written

WORDS = 5
#: Share of an item's windows that a document has, or words in a row; either is contamination.
COVERAGE, RUN_WORDS = 0.8, 13
#: Literal words of an item of fewer than five words at least; one with less ("42") is not looked for.
LITERALS = 3
#: Slots of the filter that documents are held against before the join; bounded, whatever the benchmark's size.
FILTER_BITS = 22
#: Windows of a benchmark that are too many for a broadcast, whatever their file's bytes are.
MANY = 50_000
_SEED = 7
#: Words kept at most; about 150 bytes each.
_KEPT = 1_500_000
_BLOCK = 1 << 21

# Units in lower case. Those that are also common words are left out.
UNITS = frozenset(
    "mm cm km kg mg ml kw kwh mph kmh hz khz mhz ghz kb mb gb tb pt lb lbs oz ft yd sq meter meters metre metres kilometer "
    "kilometers kilometre kilometres centimeter centimeters millimeter millimeters inch inches foot feet yard yards mile miles "
    "gram grams kilogram kilograms pound pounds ounce ounces ton tons tonne tonnes liter liters litre litres gallon gallons "
    "second seconds minute minutes hour hours day days week weeks month months year years dollar dollars euro euros cent cents "
    "percent degree degrees celsius fahrenheit".split()
)
_NUMBER = re.compile(r"[+-]?[$€£]?\d[\d.,:/]*(?:%|st|nd|rd|th)?")
_TRIM = re.compile(r"^[^\w$€£+-]+|[^\w%]+$")
LITERAL, NUMBER, UNIT, NAME = range(4)
#: How the value of a number begins.
_FIGURE = r"^[+-]?[$€£]?\p{Nd}"


def _code(word: str) -> int:
    return xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"), _SEED) | 1


_TYPED = {NUMBER: _code("<number>"), UNIT: _code("<unit>"), NAME: _code("<name>")}


class Template:
    """Template codes of words, remembered by word in a bounded table.

    common: by the first bits of their codes, the words that are no names at the start of a sentence; without it none is.
    """

    #: Of a word at the start of a sentence and inside one: its code and type; whether it ends a sentence; its own code.
    KIND = np.dtype([("start", np.uint64), ("start_kind", np.int8), ("inside", np.uint64), ("kind", np.int8), ("ends", bool), ("own", np.uint64)])

    def __init__(self, common: np.ndarray | None = None) -> None:
        self.common = common
        self.kept: dict[str, int] = {}
        self.table = np.empty(1 << 16, self.KIND)

    def _numbers(self, words: list[str]) -> np.ndarray:
        """The places of different words in the table; new ones are added."""
        if len(self.kept) > _KEPT:
            self.kept.clear()
        new = [w for w in words if w not in self.kept]
        at, end = len(self.kept), len(self.kept) + len(new)
        if end > len(self.table):
            self.table = np.concatenate([self.table[:at], np.empty(2 * end - at, self.KIND)])
        if new:
            self.table[at:end] = np.array([self._word(w) for w in new], self.KIND)
            self.kept.update(zip(new, range(at, end)))
        return np.fromiter(map(self.kept.__getitem__, words), np.int64, len(words))

    def _word(self, word: str) -> tuple[int, int, int, int, bool, int]:
        """(code, type) at the start of a sentence, (code, type) inside one, whether the word ends a sentence, and its own code.

        A word without letters or digits has code 0 and is passed over. Words stand between white space.
        """
        bare = word.strip(".,;:!?\"'()[]")
        if bare.isalpha():  # most words
            ends = not word[-1].isalpha() and word.rstrip("\"')]")[-1:] in (".", "!", "?", ":")
        else:
            bare = _TRIM.sub("", word)
            ends = word.rstrip("\"')]»”’")[-1:] in (".", "!", "?", ":")
            if not any(c.isalnum() for c in bare):
                return 0, LITERAL, 0, LITERAL, ends, 0
        low = bare.lower()
        code = _code(low)
        kind = UNIT if low in UNITS else LITERAL if bare.isalpha() or not _NUMBER.fullmatch(bare) else NUMBER
        if kind:
            return _TYPED[kind], kind, _TYPED[kind], kind, ends, code
        if not bare[0].isupper() or bare.isupper():
            return code, LITERAL, code, LITERAL, ends, code
        if self.common is None or self.common[code >> 64 - FILTER_BITS]:
            return code, LITERAL, _TYPED[NAME], NAME, ends, code
        return _TYPED[NAME], NAME, _TYPED[NAME], NAME, ends, code

    def many(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, list[str], np.ndarray, np.ndarray]]:
        """(codes, types, dictionary, words, own codes) of each text, the words by number in the dictionary. Arrow splits
        the texts and numbers their words, so that each different one is looked at once."""
        cut = pc.utf8_split_whitespace(pa.array([t or "" for t in texts], pa.string()))
        coded = cut.flatten().dictionary_encode()
        at, edges, words = coded.indices.to_numpy(), cut.offsets.to_numpy(), coded.dictionary.to_pylist()
        numbers = self._numbers(words)  # may make the table anew
        table = self.table[numbers]
        start, start_kind, inside, kind, ends, codes = (np.ascontiguousarray(table[c]) for c in self.KIND.names)
        for a, b in zip(edges.tolist(), edges[1:].tolist()):
            own = at[a:b]
            own = own[inside[own] != 0]
            first = np.empty(own.size, bool)
            first[:1], first[1:] = True, ends[own[:-1]]
            yield np.where(first, start[own], inside[own]), np.where(first, start_kind[own], kind[own]), words, own, codes[own]

    def blocks(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, list[str], np.ndarray, np.ndarray]]:
        """many() over texts that together are about a block long, in turn."""
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and size < _BLOCK:
                size += len(texts[end] or "")
                end += 1
            yield from self.many(texts[at:end])
            at = end

    def words(self, text: str | None) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """(codes, types, words) of a text, in order."""
        codes, kinds, words, own, _ = next(self.many([text]))
        return codes, kinds, [words[k] for k in own.tolist()]


def windows(codes: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of each window of `size` codes."""
    n = codes.size - size + 1
    if n < 1:
        return np.empty(0, np.uint64)
    out = np.full(n, size, np.uint64)
    for k in range(size):
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + codes[k : k + n]
    return out ^ (out >> np.uint64(32))


_SCHEMA = "row long, key long, place int, hash long, slots array<string>, length int, size int"


def _found(found: tuple, sizes: list[int], whole: bool, slots: np.ndarray | None) -> Iterator[tuple[int, int, list[str], int, int]]:
    """(place, hash, slot values, words of the text, window size) of windows; of those that may be in the benchmark."""
    codes, kinds, words, own, values = found
    if whole and codes.size < WORDS and (kinds == LITERAL).sum() < LITERALS:
        return
    for size in [min(WORDS, codes.size)] if whole else sizes:
        hashes = windows(codes, size) if size else np.empty(0, np.uint64)
        literals = np.concatenate([[0], np.cumsum(kinds == LITERAL)])
        bare = literals[size:] == literals[:-size] if hashes.size else np.empty(0, bool)
        if bare.any():
            hashes = np.where(bare, windows(values, size), hashes)
        at = np.arange(hashes.size) if slots is None else np.flatnonzero(slots[(hashes >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
        for i, h in zip(at.tolist(), hashes[at].astype(np.int64).tolist()):
            texts = [_TRIM.sub("", words[own[i + k]]).lower() if kinds[i + k] else "" for k in range(size)]
            yield i, h, texts, codes.size, size


def common_words(texts: DataFrame, text: str = "text") -> np.ndarray:
    """The words that texts have in lower case, by the first FILTER_BITS bits of their codes: a table of fixed size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0).to_pylist():
                words = {bare for w in (content or "").split() if (bare := _TRIM.sub("", w)) and bare[0].islower()}
                yield pa.RecordBatch.from_arrays([pa.array([_code(w.lower()) >> 64 - FILTER_BITS for w in words], pa.int32())], ["slot"])

    seen = np.zeros(1 << FILTER_BITS, bool)
    rows = texts.select(F.col(text).cast("string").alias("text")).mapInArrow(run, "slot int").distinct()
    seen[[r[0] for r in rows.toLocalIterator()]] = True  # as many as the table has slots at most
    return seen


def template_windows(rows: DataFrame, key: str, sizes: list[int], whole: bool = False, slots: np.ndarray | None = None, text: str = "text", common: np.ndarray | None = None) -> DataFrame:
    """Windows of each row's template: (row, key, place, hash, slots, length, size); whole: of a short text, all of it.

    row tells rows of one key apart.
    """
    names = [c.split()[0] for c in _SCHEMA.split(", ")]
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.string()), pa.int32(), pa.int32()]
    packed = [None if x is None else np.packbits(x).tobytes() for x in (slots, common)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, lower = (None if x is None else np.unpackbits(np.frombuffer(x, np.uint8)).astype(bool) for x in packed)
        template, rows, number = Template(lower), [], TaskContext.get().partitionId() << 40
        for batch in batches:
            for k, found in zip(batch.column(0).to_pylist(), template.blocks(batch.column(1).to_pylist())):
                number += 1
                for row in _found(found, sizes, whole, held):
                    rows.append((number, k, *row))
                    if len(rows) == 20_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
                        rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    return rows.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(tidy(run), _SCHEMA)


def contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, run_words: int = RUN_WORDS) -> DataFrame:
    """(doc_id, item_id, coverage, matched, windows, run_words, slots_agree) of each contaminated document and item.

    A document has an item if it has `coverage` of the item's windows, either in runs whose slots agree or with the
    item's own values, or `run_words` words in a row in a run whose slots agree (an item of fewer than five words: all of
    it in a row, if LITERALS of them are no slots). slots_agree: false if in some run one name or unit of the item stood for two in the document. Null or empty texts match nothing, null ids are passed over,
    rows of one doc_id are judged apart and the best is told. Items of one text are all named. Empty tables give no rows.
    """
    # the windows of the benchmark serve both the filter and the join
    asked = benchmark.where("item_id is not null").select("item_id", "text")
    common = common_words(asked)
    items = written(template_windows(asked.distinct(), "item_id", [], whole=True, common=common), "benchmark-windows")
    counts = dict(items.groupBy("size").count().collect())  # five at most
    sizes = list(counts)
    slot = F.shiftrightunsigned("hash", 64 - FILTER_BITS).cast("int").alias("slot")
    filled = np.zeros(1 << FILTER_BITS, bool)
    filled[[r[0] for r in items.select(slot).distinct().toLocalIterator()]] = True  # as many as the filter has slots at most
    there = template_windows(docs.where("doc_id is not null"), "doc_id", sizes, slots=filled, common=common)
    item = items.select("hash", F.col("row").alias("item_row"), F.col("key").alias("item_id"), F.col("place").alias("item_place"), F.col("slots").alias("item_slots"), (F.col("length") - F.col("size") + 1).alias("windows"), F.col("size").alias("item_size"))
    if sum(counts.values()) > MANY:
        item = shuffled(item)
    pairs = there.join(item, "hash").where("size = item_size").select(
        "row", F.col("key").alias("doc_id"), "item_row", "item_id", "place", "item_place", (F.col("place") - F.col("item_place")).alias("shift"), "windows", "size", "slots", "item_slots"
    )
    line = Window.partitionBy("row", "item_row", "shift").orderBy("place")
    fresh = F.coalesce(F.col("place") - F.lag("place").over(line) > 1, F.lit(True)).cast("int")
    runs = pairs.withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(line))
    slots = F.filter(F.arrays_zip(F.col("item_slots").alias("i"), F.col("slots").alias("d")), lambda x: (x["i"] != "") & (x["d"] != "") & ~x["i"].rlike(_FIGURE))
    per_run = runs.groupBy("row", "doc_id", "item_row", "item_id", "shift", "run", "windows", "size").agg(
        F.count(F.lit(1)).alias("n"), F.collect_set("item_place").alias("places"),
        F.collect_set(F.when(F.col("slots") == F.col("item_slots"), F.col("item_place"))).alias("same"), F.array_distinct(F.flatten(F.collect_set(slots))).alias("pairs")
    )  # a run is no longer than its item
    agree = F.size("pairs") == F.size(F.array_distinct(F.transform("pairs", lambda x: x["i"])))
    judged = per_run.withColumn("agree", agree)
    good, same = (F.size(F.array_distinct(F.flatten(F.collect_set(c)))) for c in (F.when(F.col("agree"), F.col("places")), F.col("same")))
    by_item = judged.groupBy("row", "doc_id", "item_row", "item_id").agg(
        F.greatest(good, same).cast("long").alias("matched"), F.max("windows").cast("long").alias("windows"),
        F.coalesce(F.max(F.when(F.col("agree"), F.col("n") + F.col("size") - 1)), F.lit(0)).cast("long").alias("run_words"), F.min("agree").alias("slots_agree"),
    )
    share = by_item.withColumn("coverage", F.col("matched") / F.col("windows"))
    found = share.where((F.col("coverage") >= coverage) | (F.col("run_words") >= run_words))
    told = ("coverage", "matched", "windows", "run_words", "slots_agree")
    return found.groupBy("doc_id", "item_id").agg(F.max(F.struct(*told)).alias("best")).select("doc_id", "item_id", *(f"best.{c}" for c in told))


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs whose text has no benchmark item. A row is judged by its text alone, so rows of one doc_id, or of
    none, stay or go by themselves, and ids may have any type; so may other columns, of any name. Null texts stay."""
    of = F.xxhash64(F.col("text").cast("string"))
    leaks = contaminated(docs.select(of.alias("doc_id"), "text"), benchmark).select(F.col("doc_id").alias("of")).distinct()
    leaks = written(leaks, "leaks")  # few as a rule: Spark sees their size before it deals out any text
    rows = docs.select(F.struct(*map(named, docs.columns)).alias("doc"), of.alias("of"))
    return rows.join(leaks, "of", "left_anti").select("doc.*")
