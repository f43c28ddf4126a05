import corpus_pipeline
from rastrel.llm import langid
from rastrel.llm.common import table, written
from tests.conftest import DATA
from tests.llm.cases import documents, empty
from tests.llm.test_language_and_benchmark import slow_windows
from tests.llm.test_secrets import base
from tests.llm.test_simhash import slow_near_copies
from tests.llm.test_tokens_and_packing import check_pieces

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def redacted(text):
    out, at = "", 0
    for start, _, end in base(text):
        if start >= at:
            out += text[at:start] + "[SECRET]"
        at = max(at, end)
    return out + text[at:]


def test_stages_against_brute_force(spark):
    docs = table(spark, DATA, "documents")
    rows = {r["doc_id"]: r for r in docs.collect()}
    stages = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "simhash_near_dedup", "benchmark_decontamination", "secret_scan", "harmonic_packing"]

    def step(name, df):
        out = written(stages[name](spark, df, DATA), f"test-{name}")
        return out, {r["doc_id"]: r for r in out.collect()}

    judge = langid.learn(docs).judge
    one, got = step("language_id", docs)
    assert one.columns == COLUMNS and set(got) == {i for i, r in rows.items() if judge(r["text"])[0] != "und" and judge(r["text"])[1] > 0}

    two, next_ = step("simhash_near_dedup", one)
    ids = sorted(got)
    roots = slow_near_copies([got[i]["text"] for i in ids])
    assert two.columns == COLUMNS and set(next_) == {ids[r] for r in roots} and len(next_) < len(got)

    three, clean = step("benchmark_decontamination", two)
    items = [slow_windows(r["text"], 5) for r in table(spark, DATA, "benchmark").collect()]
    leaks = {i for i, r in next_.items() if any(sum(x in own for x in w) >= 0.8 * len(w) for own in [set(slow_windows(r["text"], 5))] for w in items)}
    assert three.columns == COLUMNS and leaks and set(clean) == set(next_) - leaks

    four, hidden = step("secret_scan", three)
    assert four.columns == COLUMNS
    assert {i: (r["text"], r["n_chars"]) for i, r in hidden.items()} == {i: (t := redacted(r["text"]), len(t) if t != r["text"] else r["n_chars"]) for i, r in clean.items()}

    pieces = corpus_pipeline.run(spark, DATA).collect()
    check_pieces(pieces, [(i, r["text"]) for i, r in hidden.items()])


def test_odd_rows_go_through(spark, tmp_path):
    plain = "these are plain english words that anyone can read without trouble"
    rows = [(i, f"{plain} {i} {'more words of its own ' * (i % 3)}", "en", "s", 60) for i in range(12)] + [(None, plain, None, None, None), (20, None), (21, ""), (22, " 12 ")]
    documents(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "nothing of this is there at all in them")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.count() > 0 and got.where("doc_id in (20, 21, 22)").count() == 0
    for name in ("documents", "benchmark"):
        (empty(spark) if name == "documents" else spark.createDataFrame([], "item_id long, text string")).write.parquet(str(tmp_path / "none" / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
