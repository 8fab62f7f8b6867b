"""End to end on sf0.001: pipeline (X6), model persistence (A7), versioned case store."""

import uuid

import pytest
from pyspark.sql import functions as F

from riskspark.operators.cases import CaseStore
from riskspark.plans.learn import GBTParams, TrainedModel
from riskspark.plans.pipeline import run_pipeline
from riskspark.session import shared_dir
from riskspark.sources.fixtures import accounts

SF001 = "/root/testdata/sf0.001"


def test_pipeline_store_and_model_roundtrip(spark):
    acc = accounts(spark, SF001)
    raw = acc.select(*[F.col(c).cast("string").alias(c) for c in acc.columns])  # as a CSV read gives it
    store = CaseStore(spark, shared_dir(spark, f"cases-{uuid.uuid4().hex}"))
    assert store.read().count() == 0                      # absent store reads as empty
    out = run_pipeline(spark, raw, params=GBTParams(max_iter=3), store=store)
    summary = out["summary"].first()
    assert summary["rows"] == 150 and summary["mules"] == 7
    cases = out["cases"].collect()
    assert len(cases) <= 25 and all(c["risk_score"] >= 60 for c in cases)
    assert all(c["report"].startswith("1. EXECUTIVE SUMMARY") for c in cases)
    assert {r["model"] for r in out["metrics"].collect()} == {"A", "B"}
    assert store.read().count() == len(cases)
    removed = store.clear_uploaded()                       # none of them is a demo case
    assert removed == len(cases) and store.read().count() == 0

    b = out["models"]["B"]
    path = shared_dir(spark, f"model-{uuid.uuid4().hex}")
    b.save(path, spark)
    again = TrainedModel.load(path, spark)
    p1 = {r["account_id"]: r["p"] for r in b.predict(out["clean"]).collect()}
    p2 = {r["account_id"]: r["p"] for r in again.predict(out["clean"]).collect()}
    assert p1 == p2 and again.threshold == b.threshold

    # the loaded bundle scores raw accounts as the batch did: as JSON, as a stream, and in a new run from CSV
    from riskspark.plans.learn import choose_model, load_models
    from riskspark.plans.pipeline import parse_feature_json
    from riskspark.streaming.scoring import read_account_stream, write_scores
    assert again.cleaner == b.cleaner
    lines = raw.select(F.to_json(F.struct(*raw.columns)).alias("value"))
    p3 = {r["account_id"]: r["p"] for r in again.score_raw(parse_feature_json(lines, raw.schema)).collect()}
    assert p3 == p1
    base = shared_dir(spark, f"pipe-{uuid.uuid4().hex}")
    raw.repartition(2).write.json(f"{base}/in")
    stream = again.score_raw(read_account_stream(spark, f"{base}/in", raw.schema)).select("account_id", "p")
    write_scores(stream, f"{base}/out", f"{base}/ckpt").awaitTermination()
    assert {r["account_id"]: r["p"] for r in spark.read.parquet(f"{base}/out").collect()} == p1
    b.save(f"{base}/models/B", spark)
    models = load_models(f"{base}/models", spark)
    assert set(models) == {"B"} and choose_model(models).threshold == b.threshold
    with pytest.raises(KeyError):
        choose_model(models, "A")
    raw.write.option("header", True).csv(f"{base}/csv")
    rerun = run_pipeline(spark, f"{base}/csv", models={"A": models["B"], "B": models["B"]})
    assert rerun["summary"].first()["rows"] == 150 and rerun["summary"].first()["sum_digest"]
    assert {r["model"] for r in rerun["metrics"].collect()} == {"A", "B"}
    assert [r["case_id"] for r in rerun["cases"].orderBy("case_id").collect()] == sorted(c["case_id"] for c in cases)


def test_tables_roundtrip_and_missing(spark):
    from riskspark.sources.tables import export_per_case, load_table, save_table
    base = shared_dir(spark, f"tables-{uuid.uuid4().hex}")
    schema = "model string, pr_auc double"
    assert load_table(spark, f"{base}/absent", schema).count() == 0
    df = spark.createDataFrame([("A", 0.9), ("B", 0.8)], schema)
    save_table(df, f"{base}/metrics")
    assert sorted(r["model"] for r in load_table(spark, f"{base}/metrics", schema).collect()) == ["A", "B"]
    cases = spark.createDataFrame([("C1", 1.0), ("C2", 2.0)], "case_id string, risk_score double")
    export_per_case(cases, f"{base}/cases")
    assert spark.read.json(f"{base}/cases").count() == 2
