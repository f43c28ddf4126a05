"""Line dedup, ranked search and whitening against plain versions."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest

from rastrel.llm import lines, queries, search, whitening
from rastrel.llm.common import table
from tests.conftest import DATA
from tests.llm import cases

BLANK = " \t\n\x0b\x0c\r"


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def plain_lines(rows):
    """(id, n_lines, kept lines) of (id, text) rows, by the rule."""
    holders = defaultdict(set)
    who = [(d is None, d, None if d is not None else t or "") for d, t in rows]
    for w, (_, t) in zip(who, rows):
        for line in (t or "").split("\n"):
            holders[lower(line.strip(BLANK))].add(w)
    first = {k: min(h, key=lambda w: (w[0], w[1] or 0)) for k, h in holders.items() if len(k) >= 10 and len(h) > 1}
    out = []
    for w, (d, t) in zip(who, rows):
        own = (t or "").split("\n")
        kept = [x for x in own if first.get(lower(x.strip(BLANK)), w) == w]
        out.append((d, len(own), kept))
    return out


def test_lines_by_the_rule(spark):
    rng = random.Random(4)
    pool = [f"  Shared LINE number {k} \r" for k in range(30)] + ["short", "", "é" * 9, "É" * 10, "éÉ" * 6, "x" * 10, "0123456789", "\tX" + "x" * 9, "a license line  ", "A LICENSE line  "]
    rows = [(rng.randrange(60), "\n".join(rng.choice(pool) if rng.random() < 0.7 else f"own line {rng.random()}" for _ in range(rng.randrange(0, 12)))) for _ in range(120)]
    rows += [(500, None), (501, ""), (502, "\n\n"), (503, "Shared LINE number 3"), (-7, "shared line number 3\nshared line number 3"), (504, "once again here\nonce again here")]
    docs = cases.documents(spark, rows).selectExpr("doc_id", "text", "1 AS id", "map('a', 1) AS a", "text AS `x.y`").repartition(7)
    got = lines.without_repeats(docs).select("doc.doc_id", "n_lines", "kept", "n_dropped", "doc.`x.y`").collect()
    want = Counter((d, n, "\n".join(kept), n - len(kept)) for d, n, kept in plain_lines(rows))
    assert Counter(tuple(r)[:4] for r in got) == want
    small = lines.without_repeats(docs, slots=1 << 10)  # a full filter: all are suspects, with the same result
    assert Counter(map(tuple, small.select("doc.doc_id", "n_lines", "kept", "n_dropped").collect())) == want


def test_lines_without_ids(spark):
    rows = [(None, "a line of null\nmine alone here"), (None, "a line of null"), (None, "a line of null"), (3, "a line of three"), (None, "a line of three")]
    got = lines.without_repeats(cases.documents(spark, rows)).select("doc.doc_id", "kept", "n_dropped").collect()
    assert sum(r["n_dropped"] for r in got if r["doc_id"] == 3) == 0
    kept = [r["kept"] for r in got if r["doc_id"] is None]
    assert "" in kept  # what document 3 has
    holders = [k for k in kept if "a line of null" in k]
    assert holders in (["a line of null\nmine alone here"], ["a line of null"] * 2)  # rows of one text are one document
    named = cases.documents(spark, [(1, "some line of text"), (2, "some line of text")]).selectExpr("concat('k', doc_id) AS doc_id", "text")
    assert sorted(map(tuple, lines.without_repeats(named).select("doc.doc_id", "n_dropped").collect())) == [("k1", 0), ("k2", 1)]


def test_lines_of_odd_and_no_documents(spark):
    odd = lines.told(cases.odd(spark))
    rows = [tuple(r) for r in cases.odd(spark).select("doc_id", "text").collect()]
    want = Counter((d, n, n - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()) for d, n, kept in plain_lines(rows))
    assert Counter(map(tuple, odd.collect())) == want
    empty = lines.told(cases.empty(spark))
    assert empty.columns == odd.columns and empty.count() == 0


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_search(docs, items, best=50):
    own = [(d, Counter(TERM.findall(lower(t or "")))) for d, t in docs]
    own = [(d, c) for d, c in own if c]
    total, length = len(own), sum(sum(c.values()) for _, c in own)
    df = Counter(t for _, c in own for t in c)
    out = []
    for item, text in items:
        terms = set(TERM.findall(lower(text or "")))
        scores = []
        for d, c in own:
            m = 50 + (50 * sum(c.values()) * total) // length
            s = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in terms if t in c)
            if s > 0:
                scores.append((-s, d is None, d if d is not None else 0, d))
        out += [(item, k + 1, d, -s) for k, (s, _, _, d) in enumerate(sorted(scores, key=lambda x: x[:3])[:best])]
    return Counter(out)


@pytest.mark.parametrize("best", [1, 5, 50])
def test_search_by_the_rule(spark, monkeypatch, best):
    rng = random.Random(best)
    words = [f"w{k}" for k in range(80)] + ["Été", "ÉTÉ", "été", "日本", "A1", "a1", "_x"]
    text = lambda n: rng.choice([" ", "-", "\n", " "]).join(rng.choices(words, [1 / (k + 1) for k in range(len(words))], k=n))
    docs = [(rng.randrange(300), text(rng.choice([1, 3, 10, 60]))) for _ in range(400)] + [(None, "w3 w4"), (None, "w3 w4"), (900, None), (901, " .,! "), (902, "w1 " * 5000)]
    items = [(k, text(8)) for k in range(25)] + [(3, "w1 w2"), (None, "w5"), (50, None), (51, ""), (52, "nowhere"), (53, "w1 W1 w1")]
    monkeypatch.setattr(search, "BLOCK", 32)
    made = search.ranked(cases.documents(spark, docs).repartition(5), spark.createDataFrame(items, "item_id long, text string"), best)
    assert Counter(map(tuple, made.select("item_id", "rank", "doc_id", "score").collect())) == plain_search(docs, items, best)
    if best == 5:
        monkeypatch.setattr(search, "TOGETHER", 7)  # several blocks of items
        again = search.ranked(cases.documents(spark, docs), spark.createDataFrame(items, "item_id long, text string"), best)
        assert Counter(map(tuple, again.collect())) == plain_search(docs, items, best)


def test_search_of_odd_and_no_documents(spark):
    items = spark.createDataFrame([(1, "word3 über a"), (2, "no id")], "item_id long, text string")
    rows = [tuple(r) for r in cases.odd(spark).select("doc_id", "text").collect()]
    got = search.ranked(cases.odd(spark).selectExpr("*", "1 AS term", "2 AS n"), items.selectExpr("*", "3 AS item"))
    assert Counter(map(tuple, got.collect())) == plain_search(rows, [(1, "word3 über a"), (2, "no id")])
    assert search.ranked(cases.empty(spark), items).count() == 0
    assert search.ranked(cases.odd(spark), items.limit(0)).count() == 0


def exact_covariance(x):
    n, d = len(x), len(x[0])
    sums = [sum(r[i] for r in x) for i in range(d)]
    return sums, [[Fraction(sum(r[i] * r[j] for r in x), n) - Fraction(sums[i] * sums[j], n * n) for j in range(d)] for i in range(d)]


def test_error_free_arithmetic():
    rng = np.random.default_rng(1)
    a, b = (rng.standard_normal(200) * 10.0 ** rng.integers(-8, 8, 200) for _ in range(2))
    for made, op in ((whitening.two_sum(a, b), lambda x, y: x + y), (whitening.two_product(a, b), lambda x, y: x * y)):
        assert all(Fraction(h) + Fraction(r) == op(Fraction(x), Fraction(y)) for h, r, x, y in zip(*made, a, b))
    high, low = whitening._summed((a, np.zeros(200)))
    exact = sum(map(Fraction, a))
    assert abs(Fraction(float(high)) + Fraction(float(low)) - exact) <= Fraction(1, 10**28) * sum(abs(Fraction(v)) for v in a)


def test_whitening_of_embeddings(spark):
    df = table(spark, DATA, "embeddings")
    got = queries.QUERIES["op13_compensated_whitening"](spark, DATA).collect()
    rows = [(r["vec_id"], [math.floor(1024 * v) + 100_000 for v in r["embedding"]]) for r in df.collect()]
    sums, exact = exact_covariance([x for _, x in rows])
    n = len(rows)
    matrix = np.array([[float(v) for v in row] for row in exact])
    made = whitening._covariance(df.selectExpr("cast(embedding as array<double>)").repartition(5), whitening.fit(df))
    assert np.array_equal(made, matrix)  # equal to the last bit
    values = np.linalg.eigvalsh(matrix)[::-1]
    assert len(got) == 8 * n and {r["n"] for r in got} == {n}
    by_id = defaultdict(dict)
    for r in got:
        by_id[r["vec_id"]][r["component"]] = r
    for vec_id, x in rows:
        assert by_id[vec_id][1]["deviation"] == sum((n * v - s) ** 2 for v, s in zip(x, sums))
    white = np.array([[by_id[i][c]["whitened"] for c in range(1, 9)] for i, _ in rows])
    assert np.abs(white.T @ white / n - np.eye(8)).max() < 1e-9 and np.abs(white.mean(axis=0)).max() < 1e-9
    centred = np.array([[float(v - Fraction(s, n)) for v, s in zip(x, sums)] for _, x in rows])
    directions = centred.T @ white / n / np.sqrt(values[:8])  # unit eigenvectors, if the projections are right
    assert np.abs(matrix @ directions - directions * values[:8]).max() < 1e-7 * values[0]
    assert np.abs((directions**2).sum(axis=0) - 1).max() < 1e-9
    for c in range(1, 9):
        assert by_id[rows[0][0]][c]["explained"] == pytest.approx(values[c - 1] / np.trace(matrix), rel=1e-9)
    assert got[0]["identity_error"] == pytest.approx(np.abs(white.T @ white / n - np.eye(8)).max(), abs=1e-9) and len({r["identity_error"] for r in got}) == 1


def test_whitening_of_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0, 0.5]), (2, [2.0, 1.0, 0.5]), (2, [2.0, 1.0, 0.5]), (None, [0.0, 4.0, 0.5]), (5, None), (6, [1.0, None, 2.0]), (7, [nan, 1.0, 1.0]), (8, [1.0, inf, 1.0]), (9, [1.0]), (10, []), (11, [1e300, 1.0, 1.0])]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, vector string, n int")
    got = whitening.transformed(df).collect()
    assert Counter(r["vec_id"] for r in got) == Counter({1: 3, 2: 6, None: 3})
    assert {r["n"] for r in got} == {4}
    x = [[math.floor(1024 * v) + 100_000 for v in e] for _, e in rows[:4]]
    sums, _ = exact_covariance(x)
    assert {(r["vec_id"], r["deviation"]) for r in got} == {(i, sum((4 * v - s) ** 2 for v, s in zip(row, sums))) for (i, _), row in zip(rows, x)}
    assert {r["component"]: r["whitened"] is None for r in got} == {1: False, 2: False, 3: True}  # the third dimension never changes
    assert got[0]["identity_error"] < 1e-9
    assert {r["whitened"] for r in whitening.transformed(df.where("vec_id = 1")).collect()} == {None}
    assert whitening.transformed(df.where("vec_id = 5")).count() == 0 and whitening.transformed(df.limit(0)).columns == whitening.transformed(df).columns
