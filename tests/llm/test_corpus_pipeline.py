"""The corpus pipeline: each stage on its own input, and the whole."""

import re

import pytest

import corpus_pipeline
from riskspark.llm.langid import identify
from tests_llm_helpers import brute_components, brute_decontaminated, brute_fingerprint

SF = "/root/testdata/sf0.01"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """Input and output rows of each stage, written and read again."""
    top = tmp_path_factory.mktemp("pipeline")
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"{top}/{name}")
        result = spark.read.parquet(f"{top}/{name}")
        out[name] = (docs.collect(), result.collect(), result.columns)
        docs = result
    return out


def test_order_and_columns(steps):
    assert list(steps) == ["language_id", "line_dedup", "simhash_near_dedup", "benchmark_decontamination", "mixing"]
    assert all(sorted(c) == sorted(COLUMNS) for name, (_, _, c) in steps.items() if name != "mixing")


def test_language_id_keeps_texts_with_a_language(steps):
    before, after, _ = steps["language_id"]
    assert {r["doc_id"] for r in before if any(c.isalpha() for c in r["text"] or "")} == {r["doc_id"] for r in after}


def test_unclear_texts_go(spark, documents):
    """What the decoding flags goes (too little to tell two languages apart, or none that was learned);
    every clean text stays."""
    docs = [(r["doc_id"], r["text"], r["lang"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    odd = [(10**9, "a b c", None), (10**9 + 1, "hän on talossa ja me menemme kotiin koska ilta on jo pitkällä " * 4, None),
           (10**9 + 2, "123 456", None), (10**9 + 3, "the dog and the cat are in the house", None)]
    everything = documents(docs + odd)
    kept = {r["doc_id"] for r in corpus_pipeline.language_id(spark, everything, SF).collect()}
    assert {r[0] for r in docs if any(c.isalpha() for c in r[1] or "")} <= kept
    assert kept & {r[0] for r in odd} == {10**9 + 3}
    found = {r["doc_id"]: r for r in identify(everything).collect()}
    assert found[10**9].ambiguous and found[10**9 + 1].far
    assert kept == {i for i, r in found.items() if r.lang_pred != "und" and not r.ambiguous and not r.far}


def test_line_dedup_cuts_and_counts(steps):
    before, after, _ = steps["line_dedup"]
    was = {r["doc_id"]: r["text"] for r in before}
    assert all(r["n_chars"] == len(r["text"]) <= len(was[r["doc_id"]]) for r in after)
    first = {}
    for r in sorted(before, key=lambda r: r["doc_id"]):
        first.setdefault(r["text"], r["doc_id"])
    kept = {r["doc_id"] for r in after}
    assert all(i in kept for t, i in first.items() if not any(x in was[j] for x in t.split("\n") if len(x) > 20
                                                             for j in was if j < i))


def test_one_document_of_each_group_stays(steps):
    before, after, _ = steps["simhash_near_dedup"]
    prints = {r["doc_id"]: brute_fingerprint(r["text"]) for r in before}
    assert {r["doc_id"] for r in after} == set(brute_components(prints).values())


def test_contaminated_documents_go(spark, steps):
    before, after, _ = steps["benchmark_decontamination"]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    hit = brute_decontaminated([(r["doc_id"], r["text"]) for r in before], items)
    assert hit and {r["doc_id"] for r in after} == {r["doc_id"] for r in before} - hit


def test_clean_rows_of_a_contaminated_id_stay(spark, documents):
    leak = next(r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() if r["text"])
    rows = [(None, leak), (None, "a clean text"), (None, None), (5, "clean too"), (5, f"so {leak}"), (6, "other")]
    kept = corpus_pipeline.benchmark_decontamination(spark, documents(rows), SF).collect()
    assert sorted(str((r["doc_id"], r["text"])) for r in kept) == sorted(str(rows[k]) for k in (1, 2, 3, 5))


def test_mixture_meets_its_targets(steps):
    before, after, _ = steps["mixing"]
    by_source = {}
    for r in after:
        by_source.setdefault(r["source"], []).append(r)
    assert {r["source"] for r in before} == set(by_source)
    for rows in by_source.values():
        assert sum(r["taken"] for r in rows) == int(rows[0]["target"])
    texts = {r["doc_id"]: r["text"] for r in before}
    for r in after:
        words = WORDS.findall(texts[r["doc_id"]])
        assert r["size"] == len(words) and len(WORDS.findall(r["text"])) == r["taken"]
        assert WORDS.findall(r["text"]) == (words * 4)[:r["taken"]]


def test_mixture_of_rows_without_ids(spark, documents):
    rows = [(None, "a b c", "en", "s"), (None, "d e", "en", "s"), (4, "f g h i", "en", "s"), (4, "j", "en", "s"),
            (4, "j", "en", "s"), (5, None, "en", "s"), (6, "k l", "en", None)]
    got = corpus_pipeline.mixing(spark, documents(rows), SF).collect()
    # two sources of weights 1 and 2; the one of two words stops at three times that
    assert sum(len(r["text"].split()) for r in got) == sum(r["taken"] for r in got)
    by_source = {s: sorted((str(r["doc_id"]), r["text"]) for r in got if r["source"] == s) for s in ("s", None)}
    assert by_source[None] == [("6", "k l\nk l\nk l")]
    assert {i for i, _ in by_source["s"]} <= {"None", "4"} and sum(
        r["taken"] for r in got if r["source"] == "s") == int(next(r["target"] for r in got if r["source"] == "s"))


def test_odd_rows(spark, documents, odd_rows, clashing):
    for docs in (documents(odd_rows), clashing, documents([])):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            if name != "mixing":
                assert out.columns == docs.columns
            rows = out.collect()
            assert len(rows) <= len(odd_rows)
            if docs.isEmpty():
                assert not rows
    kept = [r["doc_id"] for r in corpus_pipeline.simhash_near_dedup(spark, documents(odd_rows), SF).collect()]
    assert kept.count(6) == 1 and kept.count(None) == 2 and 1 in kept and 2 not in kept
    kept = [r["doc_id"] for r in corpus_pipeline.language_id(spark, documents(odd_rows), SF).collect()]
    assert not {1, 2, 3, 9} & set(kept) and kept.count(6) == 2 and 8 in kept


def test_run(spark):
    from riskspark.llm.queries import QUERIES
    import __spark_entry__
    assert __spark_entry__.queries()["pipeline"] is corpus_pipeline.run
    assert {f"op{n}" for n in range(1, 14)} == {q.split("_")[0] for q in QUERIES}
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 0
