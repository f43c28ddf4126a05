"""URL filters: ordered rules first, then naive Bayes over words segmented from hosts and paths.

Words' frequencies are counted over the visible text of all pages, and joined with the runs of letters in which the
words stand, so that each run has exact counts whatever the vocabulary's size. A Viterbi search splits each run of letters of a
host or path into the likeliest words; multinomial naive Bayes over these words (hashed to a fixed number of features)
judges the URLs that no rule decides. It is trained on all URLs: those with a seed word are to block, the others are
not, and those that only a rule blocks are left out, as rules block places and not words. For the same reason it passes
over the words that the rules look at.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from rastrel.llm.common import discard, spread_join, written

# Fixed values: (host, path, verdict) of the rules.
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
# Words that mark a URL as one to block when the classifier is trained.
SEEDS = frozenset("adult bet bets betting casino cheap dating jackpot loan loans pill pills poker porn replica sex slots spam viagra warez xxx".split())
#: Letters of the words that are looked up by all substrings of a run; longer words are found by so many first letters.
SHORT = 24
FEATURES = 1 << 16
SMOOTHING = 0.1
#: What a seed counts at least among the words, so that names run together are split at seeds.
SEED_COUNT = 20
_RUN = re.compile(r"[^\W\d_]+|\d+")
#: A word or run with more than one in so many rows is hot; there are no more than so many of them.
HOT = 1000


def parts(url: Column) -> tuple[Column, Column]:
    """(host, path): what follows the first :// up to a slash, question mark, hash or the end, in lower case (A-Z only);
    then up to a question mark, hash or the end. A null url, or one without ://, has two empty ones."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + F.lit(3), F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + F.lit(1), F.length(rest)), r"^[^?#]*", 0)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.coalesce(F.translate(host, upper, upper.lower()), F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits: its host or a subdomain of it, and a path that starts with its path."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


def word_counts(pages: DataFrame, html: str = "html") -> DataFrame:
    """(word, n) of every word in the visible text of all pages."""
    visible = F.regexp_replace(F.col(html), r"(?is)<(script|style)\b.*?</\1>|<[^>]*>", " ")
    words = pages.select(F.explode(F.split(F.lower(visible), r"[^\p{L}]+")).alias("word"))
    return words.where("word <> ''").groupBy("word").agg(F.count(F.lit(1)).alias("n"))


class Segmenter:
    """Viterbi over unigrams; an unknown word is the less likely the longer it is."""

    def __init__(self, counts: dict[str, int], total: int | None = None):
        """counts: of the words that runs may hold; total: of all words, where those are more."""
        total = (sum(counts.values()) if total is None else total) + 1
        self.cost = {w: math.log(total / n) for w, n in counts.items()}
        self.unknown = math.log(10 * total)
        self.sizes = sorted({len(w) for w in counts})

    def split(self, run: str) -> tuple[str, ...]:
        """The words of a run of letters; of equal costs the one with the longer last word. An unknown word costs what
        its length does, so the best place for one to start is kept from letter to letter."""
        best: list[tuple[float, int]] = [(0.0, 0)]
        base, at = 0.0, 0  # of the start that is best for an unknown word: its cost less that of the letters before it
        for end in range(1, len(run) + 1):
            options = [(base + 2.3 * end + self.unknown, at)]
            for size in self.sizes:
                if size > end:
                    break
                cost = self.cost.get(run[end - size : end])
                if cost is not None:
                    options.append((best[end - size][0] + cost, end - size))
            best.append(min(options))
            if best[end][0] - 2.3 * end < base:
                base, at = best[end][0] - 2.3 * end, end
        words, end = [], len(run)
        while end:
            words.append(run[best[end][1] : end])
            end = best[end][1]
        return tuple(reversed(words))


def _splits(runs: DataFrame, counts: DataFrame) -> DataFrame:
    """(run, words) of each different run: split by the exact counts of all words that stand in it.

    A run meets the words of up to SHORT letters by its substrings, and longer ones by each stretch of SHORT + 1 letters.
    """
    total = counts.agg(F.sum("n")).first()[0] or 0
    letters = F.length("run")
    of_size = lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(SHORT), letters - i + 1)), lambda n: F.substring("run", i, n))
    short = runs.select("run", F.explode(F.sequence(F.lit(1), letters)).alias("at")).select("run", F.explode(of_size(F.col("at"))).alias("word"))
    often = short.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    sums = often.agg(F.sum("n")).first()[0] or 0
    few = counts.where(F.length("word") <= SHORT)
    found = spread_join(short, few, "word", often.where(F.col("n") * HOT > sums)).select("run", "word", "n")
    start = F.explode(F.sequence(F.lit(1), letters - SHORT)).alias("at")
    stretches = runs.where(letters > SHORT).select("run", start).select("run", "at", F.substring("run", F.col("at"), F.lit(SHORT + 1)).alias("head"))
    long = counts.where(F.length("word") > SHORT).select("word", "n", F.substring("word", 1, SHORT + 1).alias("head"))
    held = stretches.join(long, "head").where(F.substring("run", F.col("at"), F.length("word")) == F.col("word")).select("run", "word", "n").distinct()
    own = found.union(held).groupBy("run").agg(F.collect_set(F.struct("word", "n")).alias("own"))
    every = runs.select("run").join(own, "run", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(0).to_pylist()
            words = []
            for name, own in zip(names, batch.column(1).to_pylist()):
                counts = {x["word"]: x["n"] for x in own or ()}
                counts |= {w: max(SEED_COUNT, counts.get(w, 0)) for w in SEEDS if w in name}
                words.append(Segmenter(counts, total).split(name))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.list_(pa.string()))], ["run", "words"])

    return every.mapInArrow(run, "run string, words array<string>")


_SIDED_TYPE = ArrayType(StructType().add("side", "string").add("run", "string"))


def with_tokens(ruled: DataFrame, pages: DataFrame, passed_over: frozenset[str] = frozenset()) -> DataFrame:
    """ruled (with host and path) and `tokens`: h:word for the host, p:word for the path, but for words passed over;
    digits are one token for each length. Words are those of the splits of all runs of letters."""
    schema = ruled.schema
    names = [f.name for f in schema]
    schema = StructType(schema.fields[:]).add("__row", "long").add("__runs", _SIDED_TYPE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        host, path = names.index("host"), names.index("path")
        kind = pa.list_(pa.struct([("side", pa.string()), ("run", pa.string())]))
        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            found = [
                [{"side": side, "run": r} for side, text in (("h", h), ("p", p.lower())) for r in _RUN.findall(text)]
                for h, p in zip(batch.column(host).to_pylist(), batch.column(path).to_pylist())
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(range(number, number + len(found)), pa.int64()), pa.array(found, kind)], schema.names)
            number += len(found)

    parted = written(ruled.mapInArrow(run, schema), "url-runs")
    each = parted.select("__row", F.posexplode("__runs").alias("at", "s")).select("__row", "at", "s.side", "s.run")
    is_word = ~F.col("run").rlike(r"^\d")
    runs = written(each.where(is_word).groupBy("run").agg(F.count(F.lit(1)).alias("n")), "runs")
    counts = written(word_counts(pages), "unigrams")
    splits = written(_splits(runs, counts), "splits")
    discard(counts)
    all_runs = runs.agg(F.sum("n")).first()[0] or 0
    words = spread_join(each.where(is_word), splits, "run", runs.where(F.col("n") * HOT > all_runs)).select("__row", "at", "side", "words")
    digits = each.where(~is_word).select("__row", "at", "side", F.array(F.concat(F.lit("<"), F.length("run").cast("string"), F.lit(" digits>"))).alias("words"))
    passed = F.array(*map(F.lit, sorted(passed_over))).cast("array<string>")
    kept = words.union(digits).select("__row", "at", F.transform(F.filter("words", lambda w: ~F.array_contains(passed, w)), lambda w: F.concat("side", F.lit(":"), w)).alias("tokens"))
    by_row = kept.groupBy("__row").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "tokens"))), lambda x: x["tokens"])).alias("tokens"))
    told = parted.drop("__runs").join(by_row, "__row", "left")
    return told.select(*names, F.coalesce("tokens", F.array().cast("array<string>")).alias("tokens"))


def feature(token: str) -> int:
    return zlib.crc32(token.encode("utf-8", "surrogatepass")) % FEATURES


class Bayes:
    """Multinomial naive Bayes for block against allow, smoothed by a tenth for each feature seen."""

    def __init__(self, counts: np.ndarray, rows: np.ndarray):
        """counts: tokens by class (allow, block) and feature; rows: URLs by class."""
        self.trained = bool((rows > 0).all())
        mass = SMOOTHING * max(1, int((counts.sum(axis=0) > 0).sum()))
        allow, block = (np.log((n + SMOOTHING) / (n.sum() + mass)) for n in counts)
        self.weights = np.where(counts.sum(axis=0) > 0, block - allow, 0.0)  # a word never seen says nothing
        self.prior = math.log((rows[1] + 1) / (rows[0] + 1))

    def score(self, tokens: list[str]) -> float:
        """Log odds of block; without tokens or without both classes in training, minus infinity: allow."""
        if not tokens or not self.trained:
            return -math.inf
        return self.prior + float(self.weights[[feature(t) for t in tokens]].sum())


def train(urls: DataFrame) -> Bayes:
    """From all rows of tokens and the rules' verdict (or null): a seed word among the tokens means block."""
    seeds = F.array(*(F.lit(f"{side}:{w}") for side in "hp" for w in sorted(SEEDS)))
    block = F.arrays_overlap("tokens", seeds)
    used = urls.select("tokens", block.cast("int").alias("kind"), "verdict").where((F.size("tokens") > 0) & (block | ~F.col("verdict").eqNullSafe(F.lit("block"))))
    features = used.select("kind", F.explode("tokens").alias("t")).select("kind", (F.crc32(F.col("t").cast("binary")) % FEATURES).cast("int").alias("feature"))
    sums = features.groupBy("kind", "feature").agg(F.count(F.lit(1)).alias("n"))
    counts, rows = np.zeros((2, FEATURES), np.int64), np.zeros(2, np.int64)
    for r in sums.collect():  # two rows for each feature at most
        counts[r["kind"], r["feature"]] = r["n"]
    for r in used.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).collect():
        rows[r["kind"]] = r["n"]
    return Bayes(counts, rows)


def judged(pages: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, words and score of each page; the rule's verdict, else that of naive Bayes.

    score is the log odds of block, null where a rule decides or there is nothing to score. A URL without a host is
    allowed unless its path is blocked by its words. Null ids and repeated rows stay; an empty table gives no rows.
    """
    host, path = parts(F.col("url").cast("string"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    ruling = frozenset(w for h, p, _ in rules for w in _RUN.findall(h + p))
    told = written(with_tokens(rows.withColumns({"rule": rule, "verdict": verdict}), pages, ruling), "url-tokens")
    model = train(told)
    names = ["page_id", "host", "path", "rule", "verdict"]
    schema = StructType([told.schema[n] for n in names]).add("words", "string").add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            verdicts, words, scores = [], [], []
            for verdict, tokens in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist()):
                score = model.score(tokens)
                verdicts.append(verdict or ("block" if score > 0 else "allow"))
                words.append(" ".join(tokens))
                scores.append(None if verdict or math.isinf(score) else score)
            made = [pa.array(verdicts, pa.string()), pa.array(words, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], *made], schema.names)

    return told.select(*names, "tokens").mapInArrow(run, schema)
