import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from rastrel.llm import components, fingerprints, nearcopies, pigeonring, simhash
from tests.conftest import DATA
from tests.llm.cases import documents, empty, odd


def slow_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in re.split("[\x20\x09-\x0d]+", low) if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def slow_components(prints):
    """Least position reachable by links of at most three bits, by all pairs."""
    return slow_groups(prints, lambda a, b: (a ^ b).bit_count() <= 3)


def slow_shingles(text, size=5):
    words = [w for w in re.split("[\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) if w]
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def slow_near_copies(texts):
    """Least position reachable by links of texts whose five-word shingles have a Jaccard similarity of 0.8 or more, by
    all pairs. Texts without words are copies of each other."""
    def near(a, b):
        return not a and not b or 5 * len(a & b) >= 4 * len(a | b) > 0

    return slow_groups([slow_shingles(t) for t in texts], near)


def slow_groups(prints, near):
    label = list(range(len(prints)))

    def root(i):
        while label[i] != i:
            label[i] = label[label[i]]
            i = label[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if near(prints[i], prints[j]):
                a, b = sorted((root(i), root(j)))
                label[b] = a
    return [root(i) for i in range(len(prints))]


def check(df):
    rows = df.select("doc_id", "text").collect()
    prints = [slow_fingerprint(r["text"]) for r in rows]
    roots = slow_components(prints)
    least = {}
    for r, c in zip(rows, roots):
        if r["doc_id"] is not None:
            least[c] = min(least.get(c, r["doc_id"]), r["doc_id"])
    want = [(r["doc_id"], p, least.get(c)) for r, p, c in zip(rows, prints, roots)]
    got = [(r["doc_id"], r["fp"] % 2**64, r["component_id"]) for r in simhash.simhash_components(df.select("doc_id", "text"), ["doc_id"]).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_whole_table(spark):
    check(spark.read.parquet(f"{DATA}/documents.parquet"))


def test_odd_rows(spark):
    check(odd(spark))
    assert simhash.simhash_components(empty(spark), ["doc_id"]).count() == 0


def test_links_are_all_pairs(spark):
    rng = np.random.default_rng(4)
    seeds = rng.integers(0, 2**63, 40)
    found = set(seeds.tolist())
    for s in seeds.tolist():
        for _ in range(30):
            x = s
            for b in rng.choice(64, rng.integers(1, 6), replace=False):
                x ^= 1 << int(b)
            found.add(x - 2**64 if x >= 2**63 else x)
    values = [x if x < 2**63 else x - 2**64 for x in found]
    df = spark.createDataFrame([(v,) for v in values], "fp long")
    got = {(r["a"], r["b"]) for r in simhash.hamming_links(df).collect()}
    mask = 2**64 - 1
    want = {(a, b) for a in values for b in values if a < b and ((a ^ b) & mask).bit_count() <= 3}
    assert got == want


def test_long_chain_of_links(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 2000), (2000, 1000), (7, 7), (None, 3)]
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(301)}, 1000: 1000, 2000: 1000}


def test_hub(spark):
    edges = [(0, i) for i in range(1, 3000)]
    got = components.connected_components(spark.createDataFrame(edges, "a long, b long"))
    assert got.where("component <> 0").count() == 0 and got.count() == 3000


def edited(text, changes, rng):
    words = text.split()
    for at in rng.sample(range(len(words)), changes):
        words[at] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


def check_kept(df, rows):
    """What deduplicated() leaves of rows (doc_id, text): of each group, the least doc_id, null ones last."""
    roots = slow_near_copies([t for _, t in rows])
    groups = {}
    for k, root in enumerate(roots):
        groups.setdefault(root, []).append(rows[k])
    kept = [(r["doc_id"], r["text"]) for r in simhash.deduplicated(df).collect()]
    assert len(kept) == len(groups)
    for group in groups.values():
        own = [r for r in kept if r in group]
        ids = [i for i, _ in group if i is not None]
        assert len(own) == 1 and own[0][0] == min(ids, default=None)


def test_one_document_of_each_group_stays(spark):
    text = " ".join(f"w{random.Random(1).random()}{i}" for i in range(300))
    near = text.replace("w", "w", 1) + " end"
    rows = [(5, text), (3, text), (3, text), (9, near), (8, "something else entirely here"), (None, "no id but words here"), (4, None), (6, ""), (7, " \n")]
    rows += [(20, "one and the same id"), (20, "with two texts that differ"), (None, "another text without an id"), (None, "no id but words here"), (21, "A b C"), (22, "a B c")]
    check_kept(documents(spark, rows), rows)
    got = simhash.deduplicated(odd(spark))
    assert got.columns == odd(spark).columns and sorted([r["doc_id"] for r in got.collect()], key=str) == sorted([1, 3, 8, 9, 10, None], key=str)
    assert simhash.deduplicated(empty(spark)).count() == 0


def test_near_copies_of_every_degree(spark):
    """Copies at a similarity well over 0.8 are all found, by a chain too; those below stay apart."""
    rng, rows = random.Random(7), []
    for g in range(25):
        text = " ".join(f"g{g}w{rng.randrange(400)}" for _ in range(240))
        rows += [(100 * g + k, edited(text, k % 3, rng)) for k in range(12)]
        rows += [(100 * g + 50, edited(text, 40, rng)), (100 * g + 60, " ".join(text.split()[:150]))]
        step = text
        for k in range(6):  # each near the one before, and the last far from the first
            step = edited(step, 2, rng)
            rows.append((100 * g + 70 + k, step))
    check_kept(documents(spark, rows), rows)


def test_recall_at_the_least_similarity(spark):
    """Of pairs at 0.8 to 0.85, the hardest, nine in ten at least; those at 0.7 to 0.8 never."""
    rng, rows, hard, apart = random.Random(3), [], 0, 0
    for g in range(400):
        text = " ".join(f"p{g}q{rng.randrange(500)}" for _ in range(200))
        other = edited(text, rng.choice((3, 4, 5)), rng)
        a, b = slow_shingles(text), slow_shingles(other)
        share = len(a & b) / len(a | b)
        if 0.7 <= share < 0.85:
            rows += [(2 * g, text), (2 * g + 1, other)]
            hard += share >= 0.8
            apart += share < 0.8
    assert hard > 50 and apart > 50
    left = simhash.deduplicated(documents(spark, rows)).count()
    assert 2 * apart + hard <= left <= 2 * apart + hard + 0.1 * hard


def test_bands_hold_pairs_by_their_similarity_alone():
    """Of random sets at 0.8 to 0.85 nine in ten share a band, whatever their size and however many sets there are; of
    those at 0.3 hardly any do."""
    rng = np.random.default_rng(5)
    found = {0.8: [], 0.3: []}
    for _ in range(600):
        for share, hits in found.items():
            size = int(rng.integers(20, 900))
            both = round(share * size)
            own = rng.integers(0, 2**63, 2 * size - both, dtype=np.uint64)  # the union: `both` in common
            a, b = own[:size], np.concatenate((own[:both], own[size:]))
            while share == 0.8 and both / (2 * size - both) < 0.8:  # to a Jaccard similarity of 0.8
                both += 1
                own = own[: 2 * size - both]
                a, b = own[:size], np.concatenate((own[:both], own[size:]))
            hits.append(np.isin(nearcopies.bands(a), nearcopies.bands(b)).any())
    assert np.mean(found[0.8]) >= 0.95 and np.mean(found[0.3]) <= 0.01


def test_columns_of_any_kind(spark):
    rows = documents(spark, [(1, "some words of a text"), (2, "some words of a text"), (2, None), (None, "")])
    odd_ = rows.selectExpr("concat('id', doc_id) AS doc_id", "text", "map('k', doc_id) AS kinds", "1 AS `a.b`", "2 AS doc", "3 AS row", "4 AS node", "5 AS mine")
    got = simhash.deduplicated(odd_)
    assert got.columns == odd_.columns and sorted((r["doc_id"], r["kinds"], r["a.b"]) for r in got.collect()) == [("id1", {"k": 1}, 1), ("id2", {"k": 2}, 1)]


def test_very_long_text_and_its_copy(spark):
    rng = random.Random(2)
    long = " ".join(f"word{rng.randrange(5000)}" for _ in range(150_000))
    check_kept(documents(spark, rows := [(1, long), (2, edited(long, 500, rng)), (3, long[: len(long) // 2])]), rows)


def test_large_group_of_near_copies(spark):
    rng = random.Random(9)
    text = " ".join(f"w{rng.randrange(400)}" for _ in range(120))
    rows = [(k, edited(text, 1, rng) if k % 2 else f"{text} {k}") for k in range(3000)] + [(5000 + k, f"other text number {k} of {k * 7} words") for k in range(50)]
    kept = sorted(r["doc_id"] for r in simhash.deduplicated(documents(spark, rows)).collect())
    assert kept == [0, *range(5000, 5050)]


def test_blocks_of_bits(monkeypatch):
    text = " ".join(str(i) for i in range(500)).encode()
    whole = fingerprints.fingerprint(text)
    wide = fingerprints.wide_fingerprint(fingerprints.shingle_set(text, 5))
    monkeypatch.setattr(fingerprints, "BIT_BLOCK", 7)
    assert fingerprints.fingerprint(text) == whole == slow_fingerprint(text.decode())
    assert fingerprints.wide_fingerprint(fingerprints.shingle_set(text, 5)) == wide and len(wide) == 64


def test_longer_keys_lose_no_link(spark):
    rng = random.Random(12)
    prints = {rng.getrandbits(64) for _ in range(60)}
    for x in list(prints):
        for bits in (1, 2, 3, 3, 3, 4):
            prints.add(x ^ sum(1 << b for b in rng.sample(range(64), bits)))
    signed = [simhash._signed(x) for x in prints]
    want = {(min(a, b), max(a, b)) for i, a in enumerate(signed) for b in signed[:i] if (a % 2**64 ^ b % 2**64).bit_count() <= 3}
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    for further in (0, 1, 5, 16):
        assert {(r["a"], r["b"]) for r in simhash.hamming_links(df, further).collect()} == want and want
    assert [simhash.further_bits(n) for n in (0, 10**6, 2**32 - 1, 2**32, 2**40, 2**60)] == [0, 0, 0, 1, 9, 16]
    assert len(simhash._flips(16)) == 1 + 16 + 16 + 256 + 120


def test_hubs_among_many_nodes(spark):
    """A hub with a third of all edges, hubs of middle size, and many small components."""
    edges = [(1, k) for k in range(10, 2000)] + [(5, k) for k in range(3000, 3400)] + [(k, k + 1) for k in range(10_000, 17_000, 3)] + [(1999, 3000), (9, 9), (None, 4)]
    random.Random(5).shuffle(edges)
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {n: 1 for n in (1, 5, *range(10, 2000), *range(3000, 3400))} | {n: k for k in range(10_000, 17_000, 3) for n in (k, k + 1)}
    assert got == want


def test_components_ask_little_of_the_driver(spark):
    """One broadcast for each half of a round, and no job of its own for its state: 72 jobs with three and with such."""
    tracker, edges = spark.sparkContext.statusTracker(), [(0, k) for k in range(1, 3000)] + [(k, k + 1) for k in range(5000, 5008)]
    spark.sparkContext.setJobGroup("components", "components")
    try:
        got = components.connected_components(spark.createDataFrame(edges, "a long, b long"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(tracker.getJobIdsForGroup("components")) <= 65
    assert got.where("component not in (0, 5000)").count() == 0 and got.count() == 3009


def test_simhash_links_pairs_that_bands_miss(spark):
    """Pairs at 0.8 that share no band, but whose fingerprints differ in two bits."""
    rows = []
    for seed in (5059, 7534):
        rng = random.Random(seed)
        words = [f"w{rng.randrange(10**6)}" for _ in range(14)]
        texts = [" ".join(words[:13]), " ".join(words[:12] + words[13:])]
        a, b = (fingerprints.shingle_set(t.encode(), 5) for t in texts)
        assert not np.isin(nearcopies.bands(a), nearcopies.bands(b)).any()
        rows += [(seed + k, t) for k, t in enumerate(texts)]
    check_kept(documents(spark, rows), rows)


def test_odd_sketches_bound_what_two_sets_have_apart():
    rng = np.random.default_rng(8)
    for both, own in ((20, 0), (300, 2), (300, 60), (5000, 90), (1000, 3000)):
        sets = rng.integers(0, 2**63, both + 2 * own, dtype=np.uint64)
        x, y = nearcopies.odd_sketch(sets[: both + own]), nearcopies.odd_sketch(np.concatenate((sets[:both], sets[both + own :])))
        bits = int(np.bitwise_count((x ^ y).view(np.uint64)).sum())
        assert bits <= 2 * own and (own > 100 or bits >= 1.5 * own)


def test_family_that_is_alike_makes_few_rows(spark, monkeypatch):
    """Of texts that share bands but stay under 0.8, what sketches leave grows no faster than the family."""
    across, found = nearcopies._across, []

    def counted(*given):
        found.append((out := across(*given)).count())
        return out

    monkeypatch.setattr(nearcopies, "_across", counted)
    rng = random.Random(4)
    text = " ".join(f"w{rng.randrange(10**6)}" for _ in range(120))
    rows = [(k, edited(text, 8, rng)) for k in range(300)]
    assert simhash.deduplicated(documents(spark, rows)).count() > 250 and found[0] <= 30


def broadcasts(df):
    return df._jdf.queryExecution().executedPlan().toString().count("BroadcastExchange")


def test_probes_never_go_through_the_driver(spark, tmp_path):
    """A table of fingerprints is small, but 68 probes come of each: Spark sizes them by the table's file."""
    spark.range(2000).select(F.xxhash64("id").alias("fp")).write.parquet(str(tmp_path / "prints"))
    prints = spark.read.parquet(str(tmp_path / "prints"))
    links = pigeonring.hamming_links(prints)
    assert int(spark.conf.get("spark.sql.autoBroadcastJoinThreshold").rstrip("b")) >= 1 << 20  # Spark's own, which op4 and pipeline are run with
    assert not broadcasts(links)
    links.collect()
    assert not broadcasts(links)  # nor when sizes are known


def test_many_links_go_by_shuffle(spark, monkeypatch):
    """Of components' joins, only that with the hubs is a broadcast once edges are many."""
    edges = spark.range(3000).select(F.col("id").alias("v"), (F.col("id") + 3000).alias("u"))
    edges = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    assert broadcasts(components._star(edges, True, 3000)) == 3  # hubs, told twice until the plan runs, and the others' least
    monkeypatch.setattr(components, "MANY", 2000)
    assert broadcasts(components._star(edges, True, 3000)) == 2


def test_near_copies_never_go_through_the_driver(spark, monkeypatch):
    """Bands and sets of shingles are arrays, which Spark takes for one value each."""
    seen, plain = {}, nearcopies.written

    def told(df, name, keep=False):
        seen[name] = seen.get(name, 0) + broadcasts(df)
        return plain(df, name, keep)

    monkeypatch.setattr(nearcopies, "written", told)
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    assert nearcopies.deduplicated(docs).count()
    assert {"active", "shingles", "near-pairs", "parts", "prints", "close", "mixed-bands"} <= set(seen)
    assert not any(seen.values()), seen
