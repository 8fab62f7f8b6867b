"""Regressions found by review: rounding, ids of any type, wide tables, stores, sections."""

import random
import uuid

import pytest
from pyspark.sql import functions as F

from riskspark.config import DEFAULT_CONFIG
from riskspark.functions.columns import py_fixed, py_round


def test_rounding_is_pythons(spark):
    rng = random.Random(1)
    values = [(80 - t) / 80 for t in range(81)] + [k / 2000 for k in range(2001)] + [.6375, .38375, 0.0, 1.0]
    values += [round(rng.random(), 4) for _ in range(3000)] + [rng.random() for _ in range(3000)] + [-0.0005, -0.0015]
    rows = spark.createDataFrame([(v,) for v in values] + [(None,)], "x double").select(
        "x", py_round(F.col("x"), 3).alias("three"), py_round(F.col("x"), 6).alias("six"),
        py_fixed(F.col("x"), 4).alias("text")).collect()
    for r in rows:
        if r["x"] is None:
            assert r["three"] is None
            continue
        assert r["three"] == round(r["x"], 3) and r["six"] == round(r["x"], 6)
        assert r["x"] < 0 or r["text"] == f"{r['x']:.4f}"


@pytest.mark.parametrize("ids, kind", [([-5, 3, 8, -9, 4], "long"), (["b", "a", "z", "y", "c"], "string")])
def test_components_of_any_ids(spark, ids, kind):
    from riskspark.operators.network import connected_components
    a, b, c, d, alone = ids
    edges = spark.createDataFrame([(a, "p"), (b, "p"), (b, "q"), (c, "q"), (d, "r"), (alone, "s")],
                                  f"entity {kind}, attribute string")
    got = {r["entity"]: r["component"] for r in connected_components(edges).collect()}
    assert got == {a: min(a, b, c), b: min(a, b, c), c: min(a, b, c), d: d, alone: alone}


def test_components_raise_if_rounds_run_out(spark):
    from riskspark.operators.network import connected_components
    chain = [(k, f"l{k}") for k in range(40)] + [(k + 1, f"l{k}") for k in range(40)]
    with pytest.raises(RuntimeError):
        connected_components(spark.createDataFrame(chain, "entity long, attribute string"), max_rounds=1)


def test_case_ids_without_a_key(spark):
    from riskspark.plans.analyze import case_id, row_content
    rows = spark.createDataFrame([(7, 1.0), (123456, 1.0), (None, 1.0), (None, 2.0), (None, 2.0)], "k long, x double")
    got = [r["c"] for r in rows.select(case_id(F.col("k"), row_content(rows)).alias("c")).collect()]
    assert got[:2] == ["BOI-00007", "BOI-123456"] and all(c.startswith("ACC-") and len(c) == 12 for c in got[2:])
    assert got[2] != got[3] == got[4]


def test_sections_of_texts_with_one_key_do_not_mix(spark):
    from riskspark.operators.casetext import report_sections
    texts = [("k", "intro\n1. EXECUTIVE SUMMARY\nA1\nA2\n**2. RISK ASSESSMENT**\n\n x \n"),
             ("k", "# EXECUTIVE SUMMARY\nB1"), ("n", "no header"), ("z", None), ("e", "")]
    got = sorted((r["k"], r["block"], r["header"], r["body"]) for r in report_sections(
        spark.createDataFrame(texts, "k string, t string"), "k", "t").collect() if r["body"] is not None)
    assert got == [("e", 1, "REPORT", ""), ("k", 1, "EXECUTIVE SUMMARY", "A1\nA2"), ("k", 1, "EXECUTIVE SUMMARY", "B1"),
                   ("k", 2, "RISK ASSESSMENT", "x"), ("n", 1, "REPORT", "no header")]


def wide(spark, n_columns, n_rows=60):
    """A table of many columns: constant, all-NULL, mostly NULL, text numbers."""
    columns = []
    for k in range(n_columns):
        c = F.lit(None).cast("string") if k % 50 == 7 else F.when(
            F.col("id") % (k % 9 + 2) != 0, ((F.col("id") * (k + 3)) % (k % 40 + 2)).cast("string"))
        columns.append(c.alias(f"F{k + 10000}"))
    return spark.range(n_rows).select(F.col("id").cast("string").alias("account_id"),
                                      (F.col("id") % 10 == 0).cast("int").cast("string").alias("F3924"), *columns)


def test_wide_tables(spark):
    """Cleaning, statistics, medians, MI and a top-200 selection on 1,000 columns."""
    from riskspark.operators.clean import Cleaner
    from riskspark.operators.profile import dataset_stats, exact_medians, feature_types, value_counts
    from riskspark.operators.selection import FeatureSelector
    raw = wide(spark, 1000).checkpoint()
    model = Cleaner().fit(raw)
    assert len(model.dropped_null_columns) == 20 and len(model.features) == 980
    clean = model.transform(raw).checkpoint()
    stats = dataset_stats(spark, clean, model.output_features, 20).first()
    assert stats["rows"] == 60 and stats["features"] == len(model.output_features)
    assert 0 < stats["sparsity_pct"] < 100 and stats["sum_digest"]
    types = {r["feature"]: r["n_distinct"] for r in feature_types(clean, model.output_features).collect()}
    assert len(types) == len(model.output_features)
    counts = value_counts(clean, model.output_features).checkpoint()
    medians = {r["feature"]: r["median"] for r in exact_medians(counts).collect()}
    probe = model.features[3]
    values = sorted(r[0] for r in clean.select(probe).collect() if r[0] is not None)
    n = len(values)
    assert medians[probe] == (values[(n - 1) // 2] + values[n // 2]) / 2 and types[probe] == len(set(values))
    selected = FeatureSelector(top_k=200).fit(clean, model.output_features)
    assert len(selected.selected) == 200


def test_medians_and_cutoffs_over_many_buckets(spark, monkeypatch):
    """The same results when values are cut into many buckets."""
    from riskspark.operators import cumulative
    from riskspark.operators.profile import exact_medians, value_counts
    from riskspark.operators.sampling import _cutoffs, stratified_split
    rng = random.Random(4)
    rows = [(k, rng.choice([None, rng.gauss(0, 1), float(k % 7)]), int(k % 9 == 0)) for k in range(900)]
    df = spark.createDataFrame(rows, "account_id long, v double, y int")
    one = exact_medians(value_counts(df, ["v"])).first()["median"]
    monkeypatch.setattr(cumulative, "ROWS_PER_BUCKET", 10)
    monkeypatch.setattr(cumulative.buckets_for, "__defaults__", (10,))
    assert exact_medians(value_counts(df, ["v"])).first()["median"] == one
    whole = {r["account_id"] for r in stratified_split(df).where("is_test").collect()}
    assert len(whole) == 180
    monkeypatch.setattr(_cutoffs, "__defaults__", (10,))
    assert {r["account_id"] for r in stratified_split(df).where("is_test").collect()} == whole


def test_cleaner_learns_from_training_rows_only(spark):
    """A column that has values in held-out rows only is dropped."""
    from riskspark.operators.clean import Cleaner
    from riskspark.operators.sampling import stratified_split
    rows = spark.range(200).select(F.col("id").cast("string").alias("account_id"),
                                   (F.col("id") % 5 == 0).cast("int").alias("F3924"), F.lit(1.0).alias("F1"))
    split = stratified_split(rows, "F3924", "account_id", 0.2, DEFAULT_CONFIG.seed)
    raw = split.withColumn("F2", F.when(F.col("is_test"), 1.0)).drop("is_test")
    assert Cleaner().fit(raw).dropped_null_columns == []
    assert Cleaner().fit_on_training_rows(raw).dropped_null_columns == ["F2"]


CASE = "case_id string, account_id long, risk_score double, severity string, typology string, " \
       "confidence double, is_demo boolean, report string"


def test_newer_stream_update_wins_and_replays_are_skipped(spark):
    from riskspark.operators.cases import CaseStore, upsert
    from riskspark.session import shared_dir
    from riskspark.streaming.scoring import persist_cases, read_account_stream
    base = shared_dir(spark, f"store-{uuid.uuid4().hex}")
    store = CaseStore(spark, f"{base}/store")
    store.save(spark.createDataFrame([("C1", 1, 10.0, "LOW", None, 0.0, False, "old")], CASE))
    update = spark.createDataFrame([("C1", 1, 95.0, "CRITICAL", None, 0.0, False, "new")], CASE)
    update.write.json(f"{base}/in")
    persist_cases(read_account_stream(spark, f"{base}/in", update.schema), store, f"{base}/ckpt").awaitTermination()
    assert store.read().first()["risk_score"] == 95.0
    # a batch run after it wins again; the stream's batch, replayed by a new store object, is skipped
    store.save(spark.createDataFrame([("C1", 1, 50.0, "MEDIUM", None, 0.0, False, "later")], CASE))
    again = CaseStore(spark, f"{base}/store")
    batch = [b for _, b in again._published() if b]
    assert len(batch) == 1 and batch[0].endswith("-0")
    again.save(update, batch[0])
    assert again.read().first()["report"] == "later" and len(again._published()) == 3
    # rows of one version: the choice depends on their values only
    two = spark.createDataFrame([("C2", 2, 1.0, "LOW", None, 0.0, False, "a"), ("C2", 2, 2.0, "LOW", None, 0.0, False, "b")],
                                CASE).withColumn("version", F.lit(1).cast("long"))
    assert upsert(two, two.limit(0)).first()["report"] == upsert(two.orderBy("report").repartition(3), two.limit(0)).first()["report"]


def test_neighbours_of_a_point_repeated_ten_million_times(spark):
    from riskspark.operators.knn import exact_knn
    points = spark.createDataFrame([(k, [float(k), 0.0], 10_000_000 if k == 3 else 1) for k in range(40)],
                                   "pid long, vec array<double>, mult long")
    got = {r["pid"]: [x["dist"] for x in r["neighbours"]] for r in exact_knn(points, 3, 2, leaf_size=8).collect()}
    assert got[3] == [0.0, 0.0, 0.0] and got[4] == [1.0, 1.0, 1.0] and got[0] == [1.0, 2.0, 3.0]


def test_scored_rows_keep_null_and_repeated_keys(spark):
    from riskspark.plans.learn import GBTParams, TrainedModel, fit_gbt
    from riskspark.operators.selection import FeatureModel
    rows = [(k if k % 4 else None, float(k % 5), k % 2) for k in range(40)] + [(1, 1.0, 1)] * 2
    df = spark.createDataFrame(rows, "account_id long, a double, y int")
    model = TrainedModel("B", False, FeatureModel(["a"], {"a": 0.0}),
                         fit_gbt(df.select("a", "y"), ["a"], "y", GBTParams(max_iter=2), 1.0))
    scored = model.score(df)
    assert scored.count() == df.count() and scored.columns == ["account_id", "a", "y", "p"]


def test_selection_tiers(spark):
    from dataclasses import replace

    from riskspark.operators.selection import select_features
    cfg = replace(DEFAULT_CONFIG, hints=("H2", "absent", "H1"))
    features = ["x1", "H1", "F3912", "H2", "x2", "H1_missing", "x3_missing"]
    mi = spark.createDataFrame([("x1", .1), ("x2", .3), ("H1", .9), ("x3_missing", .3)], "feature string, mi double")
    names = lambda **kw: [r["feature"] for r in select_features(
        spark, mi, features, cfg, **kw).orderBy("rank").collect()]
    assert names(top_k=6) == ["H2", "H1", "H1_missing", "F3912", "x2", "x3_missing"]
    assert names(top_k=1) == ["H2", "H1", "H1_missing", "F3912"]
    assert names(top_k=4, include_leakage=False) == ["H2", "H1", "H1_missing", "x2"]
