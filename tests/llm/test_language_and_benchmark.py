import random
import re
import zlib
from collections import Counter

from rastrel.llm import decontaminate, langid
from tests.conftest import DATA
from tests.llm.cases import documents, empty, odd


def slow_ngrams(text):
    words = "".join(c if c.isalpha() else "_" for c in (text or "").lower())
    line = re.sub("_+", "_", f"_{words}_")
    if line == "_":
        return Counter()
    found = Counter()
    for n in (1, 2, 3):
        for i in range(len(line) - n + 1):
            gram = line[i : i + n]
            if gram != "_" and not (n == 3 and gram[1] == "_"):
                found[gram] += 1
    return found


def as_text(code):
    return "".join(chr(code >> s & 0x1FFFFF) for s in (42, 21, 0) if code >> s & 0x1FFFFF)


def test_ngrams(monkeypatch):
    texts = ["", None, "a", "Hello, wörld! it's", "12 34", "a b c", "日本語 テキスト", "x" * 50 + " y" * 30, "--a--b--", "ab  cd"]
    for block in (1 << 20, 1, 2, 3, 7):
        monkeypatch.setattr(langid, "_BLOCK", block)
        for t in texts:
            kinds, counts = langid.ngrams(t)
            assert {as_text(k): n for k, n in zip(kinds.tolist(), counts.tolist())} == slow_ngrams(t), (block, t)


def test_held_out_accuracy_and_flags(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r["doc_id"]: r for r in langid.predict(docs).collect()}
    truth = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    assert set(got) == set(truth)
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r["score"] <= 1 for i, r in got.items())
    out = [r["lang_pred"] == truth[i] for i, r in got.items() if r["held_out"]]
    assert sum(out) / len(out) > 0.98


def test_distances_by_hand(spark):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("the cat and the hat", "en"), ("der hund und die katze", "de")] * 6)]
    profiles = langid.learn(documents(spark, rows))
    learned = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 != 1]
    ranks = {}
    for lang in ("de", "en"):
        total = Counter()
        for _, t, own in learned:
            if own == lang:
                total.update(slow_ngrams(t))
        ranks[lang] = [g for g, _ in sorted(total.items(), key=lambda x: (-x[1], [0] * (3 - len(x[0])) + [ord(c) for c in x[0]]))][:300]
    text = "the dog and the house"
    own = [g for g, _ in sorted(slow_ngrams(text).items(), key=lambda x: (-x[1], [0] * (3 - len(x[0])) + [ord(c) for c in x[0]]))][:300]
    apart = {lang: sum(abs(r.index(g) - i) if g in r else 300 for i, g in enumerate(own)) for lang, r in ranks.items()}
    best = min(apart, key=apart.get)
    name, score = profiles.judge(text)
    assert name == best and abs(score - (1 - apart[best] / (300 * len(own)))) < 1e-12


def test_odd_rows(spark):
    got = langid.predict(odd(spark)).collect()
    assert len(got) == odd(spark).count() and all(r["lang_pred"] == "und" and r["score"] == 0 for r in got)
    assert langid.predict(empty(spark)).count() == 0
    mixed = odd(spark).select("doc_id", "text", "lang", "source", "n_chars").union(documents(spark, [(20 + i, "plain english words are here", "en") for i in range(6)]))
    by_id = {r["doc_id"]: r["lang_pred"] for r in langid.predict(mixed).collect()}
    assert by_id[1] == by_id[2] == by_id[7] == "und" and by_id[20] == "en"
    kept = langid.accepted(mixed)
    assert kept.columns == mixed.columns and {r["doc_id"] for r in kept.collect()} >= {20, 21, 22, 23, 24, 25}


def test_noise_and_unlearned_languages_are_rejected(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    noise = ["xkcd qwrtp zzzz vbnm jkl wqp mnbv tyq hjkl zxcv bnmq wrtp", "Кошка сидит на столе и смотрит в окно", "猫はテーブルの上に座っています", "k9 x7 qz vv jj ww xx kkq zpt rrw"]
    extra = documents(spark, [(100_000 + i, t) for i, t in enumerate(noise)] + [(200_000, "This is a short English sentence about the weather.")])
    both = docs.select(*extra.columns).union(extra).selectExpr("*", "1 AS score", "2 AS lang_pred", "3 AS __text", "4 AS __lang", "5 AS `a.b`", "map('k', 1) AS kinds")
    kept = langid.accepted(both)
    assert kept.columns == both.columns
    ids = {r["doc_id"] for r in kept.collect()}
    assert ids >= {r["doc_id"] for r in docs.collect()} | {200_000} and not ids & {100_000 + i for i in range(len(noise))}


def test_repeated_rows_without_id_do_not_outgrow_the_sample(spark):
    rows = [(None, "the same english words", "en")] * 500 + [(i, f"words number {i} of the english language", "en") for i in range(50)]
    chosen = langid._sample(documents(spark, rows), 30)
    assert chosen.count() < 60


def slow_windows(text, size):
    template = decontaminate.Template()
    codes, _, _ = template.words(text)
    return [tuple(codes[i : i + size].tolist()) for i in range(len(codes) - size + 1)]


def test_leaks_against_windows_in_sets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    bench = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    items = {}
    for r in bench.collect():
        items[r["item_id"]] = slow_windows(r["text"], 5)
    want = set()
    for r in docs.select("doc_id", "text").collect():
        own = set(slow_windows(r["text"] or "", 5))
        want |= {(r["doc_id"], i) for i, w in items.items() if sum(x in own for x in w) >= 0.8 * len(w)}
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, bench).collect()}
    assert want and got == want


def test_reparameterised_questions_and_slots(spark):
    item = "A train leaves Boston at 40 km per hour and another train leaves Denver at 60 km per hour toward Boston"
    bench = spark.createDataFrame([(1, item), (2, "four short words here"), (None, item), (3, None), (4, "")], "item_id long, text string")
    rows = [
        (1, "Intro text. " + item.replace("Boston", "Paris").replace("40", "55") + " and more."),
        (2, item.replace("Boston", "Paris", 1).replace("40", "55")),  # one name of the item stands for two
        (3, "So, four short words here again"),
        (4, "A train leaves the station and nothing else of it is the same as in the other text"),
        (5, None), (6, ""), (None, item), (1, "Intro text. " + item), (13, item), (13, "nothing of the item stands in this row at all"), (None, "nor in this one"),
    ]
    got = {(r["doc_id"], r["item_id"]): r["slots_agree"] for r in decontaminate.contaminated(documents(spark, rows), bench).collect()}
    assert got == {(1, 1): True, (3, 2): True, (13, 1): True}
    left = decontaminate.decontaminated(documents(spark, rows), bench)  # by row: a leak without an id goes, a clean row beside one stays
    assert sorted([r["doc_id"] for r in left.collect()], key=str) == sorted([2, 4, 5, 6, 13, None], key=str)
    named = documents(spark, rows).selectExpr("concat('id', doc_id) AS doc_id", "text", "1 AS of", "2 AS `a.b`", "map('k', doc_id) AS doc")
    left = decontaminate.decontaminated(named, bench)
    assert left.columns == named.columns and left.count() == 6 and {r["a.b"] for r in left.collect()} == {2}
    assert decontaminate.contaminated(empty(spark), bench).count() == 0
    assert decontaminate.contaminated(odd(spark), bench.where("false")).count() == 0
    assert decontaminate.contaminated(odd(spark), bench).count() == 0


def test_one_changed_value_does_not_hide_a_copy(spark):
    words = [f"word{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(60)]
    for at in (10, 30, 50):
        words[at] = "Mary"
    item = " ".join(words)
    other = [w if w == "Mary" else f"{w}x" for w in words]
    rows = [(1, item.replace("Mary", "Maria", 1)), (2, item), (3, " ".join(other)), (4, " ".join(words[:9] + other[9:25] + words[25:]).replace("Mary", "Maria", 1))]
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = {r["doc_id"]: r for r in decontaminate.contaminated(documents(spark, rows), bench).collect()}
    assert set(got) == {1, 2, 4}
    assert (got[1]["matched"], got[1]["windows"], got[1]["slots_agree"]) == (51, 56, False)
    assert (got[2]["matched"], got[2]["run_words"], got[2]["slots_agree"]) == (56, 60, True)


NAMES = "Natalia Weng Betty Julie James Mark Albert Ken Alexis Tina Randy Jasper Joy Bella Carlos Dana Ethan Fiona Grace Hugo".split()
STORIES = [
    "{A} sold {n} clips to friends in April. {A} then gave {m} of them to {B} and kept the rest. How many clips did {A} keep?",
    "{A} is {n} years old and {B} is {m} years older than that. Together with {A} they pay {k} dollars for the ride home.",
    "{A} runs {n} km every day while {B} walks {m} km in the park. {B} stops after {k} days. {A} never stops at all.",
    "At the market {A} buys {n} kg of apples for {k} dollars. {B} buys {m} kg of pears there. Who pays more per kg and why?",
]


def test_names_at_sentence_starts_and_recall(spark):
    """Of items told again with other names and numbers, nine in ten are found; told with other words, none."""
    rng, items, rows = random.Random(6), [], []
    for i in range(60):
        story = STORIES[i % 4]
        names, numbers = rng.sample(NAMES, 4), rng.sample(range(2, 500), 6)
        items.append((i, f"Item {chr(97 + i % 26)}{chr(97 + i // 26)} reads: " + story.format(A=names[0], B=names[1], n=numbers[0], m=numbers[1], k=numbers[2])))
        rows.append((i, "Some words before it. " + items[-1][1].replace(names[0], names[2]).replace(names[1], names[3]).replace(str(numbers[0]), str(numbers[3])).replace(str(numbers[1]), str(numbers[4])).replace(str(numbers[2]), str(numbers[5]))))
        rows.append((1000 + i, f"{names[0]} went out at {numbers[0]} and saw {names[1]} there. {names[1]} had {numbers[1]} things to tell. All of them were new to everybody."))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(documents(spark, rows), bench).collect()}
    assert sum((i, i) in got for i in range(60)) >= 54 and not [d for d, _ in got if d >= 1000]


TWICE = [
    "{A} had {n} boxes and gave some to {B}. {B} had {n} boxes too before that. How many boxes do they have together now?",
    "The first shelf holds {n} jars and the second holds {n} jars. {A} takes {m} jars from each of them and leaves the others.",
    "{A} drives {n} km in {m} hours. {B} drives {n} km in {n} minutes less than that. Who of them is the faster driver?",
]


def test_equal_values_may_become_different_ones(spark):
    """Of items in which a number stands twice, told again with a new number in each place, nine in ten are found."""
    rng, items, rows = random.Random(8), [], []
    for i in range(60):
        story, names, numbers = TWICE[i % 3], rng.sample(NAMES, 4), rng.sample(range(2, 500), 7)
        items.append((i, f"Item {chr(97 + i % 26)}{chr(97 + i // 26)} reads: " + story.format(A=names[0], B=names[1], n=numbers[0], m=numbers[1])))
        again = story
        for value in numbers[2:]:
            again = again.replace("{n}", str(value), 1)
        rows.append((i, f"Item {chr(97 + i % 26)}{chr(97 + i // 26)} reads: " + again.format(A=names[2], B=names[3], m=numbers[1])))
    rows.append((900, items[0][1].replace("boxes and gave", "crates and sold").replace("boxes too before", "pears two after").replace("boxes do they have together now", "words are here")))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(documents(spark, rows), bench).collect()}
    assert sum((i, i) in got for i in range(60)) >= 54 and not [d for d, _ in got if d >= 900]


def test_figures_alone_are_no_template(spark):
    table = " ".join(str(k) for k in range(100, 130))
    bench = spark.createDataFrame([(1, "42"), (2, "7 8 9 10 11 12"), (3, "7 km"), (4, "a 7"), (5, table)], "item_id long, text string")
    rows = [(1, f"The answer is 42 and {table}"), (2, "rows 1 2 3 4 5 6 7 8 9 20 21 22 in a table"), (3, "then 7 8 9 10 11 12 follow"), (4, "a 7 km walk")]
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(documents(spark, rows), bench).collect()}
    assert got == {(1, 5), (3, 2)}
    left = decontaminate.decontaminated(documents(spark, rows).selectExpr("*", "1 AS item_id", "2 AS hash"), bench)
    assert sorted(r["doc_id"] for r in left.collect()) == [2, 4] and "item_id" in left.columns


def test_very_long_text(spark):
    item = "the quick grey heron waits beside the still green water until evening comes again"
    long = " ".join(f"word{k} and some {k} more" for k in range(60_000))
    rows = [(1, f"{long} {item} {long}"), (2, long)]
    bench = spark.createDataFrame([(9, item)], "item_id long, text string")
    assert [(r["doc_id"], r["item_id"], r["coverage"]) for r in decontaminate.contaminated(documents(spark, rows), bench).collect()] == [(1, 9, 1.0)]
