"""What training needs no Spark job for (time of a training run on small tables is mostly jobs)."""

import uuid
from dataclasses import replace

from pyspark.sql import functions as F

from riskspark.config import DEFAULT_CONFIG
from riskspark.operators.clean import Cleaner, CleaningModel
from riskspark.operators.sampling import apply_folds, fold_cuts, stratified_folds, stratified_split
from riskspark.operators.selection import information_table, select_features


def jobs(spark, work) -> int:
    group = uuid.uuid4().hex
    spark.sparkContext.setJobGroup(group, group)
    try:
        work()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def raw_accounts(spark, n=400):
    # text as a CSV read gives it, with a repeated and a missing key
    key = F.when(F.col("id") == 7, F.lit(None)).when(F.col("id") % 50 == 9, F.lit(9)).otherwise(F.col("id"))
    return spark.range(n).select(key.cast("string").alias("account_id"), (F.col("id") % 13).cast("string").alias("F1"),
                                 F.when(F.col("id") % 7 == 0, "1").when(F.col("id") % 11 == 0, "x").otherwise("0")
                                 .alias("F3924"))


def test_cleaner_replays_its_split_without_jobs(spark, tmp_path):
    raw = raw_accounts(spark)
    model = Cleaner().fit_on_training_rows(raw)
    clean = model.transform(raw)
    found = []
    assert jobs(spark, lambda: found.append(model.split(clean))) == 0
    want = stratified_split(clean, "y", "account_id", 0.2, DEFAULT_CONFIG.seed)
    assert found[0].columns == want.columns
    assert sorted(map(str, found[0].collect())) == sorted(map(str, want.collect()))
    model.save(str(tmp_path / "cleaner"), spark)
    assert CleaningModel.load(str(tmp_path / "cleaner"), spark) == model
    assert replace(model, held_out=[]).split(clean) is None


def test_split_and_folds_of_small_tables_take_few_jobs(spark):
    df = spark.range(900).select(F.col("id").alias("account_id"), (F.col("id") % 9 == 0).cast("int").alias("y"))
    # class counts and one ranking of the rows
    assert jobs(spark, lambda: stratified_split(df)) <= 6
    assert jobs(spark, lambda: stratified_folds(df)) <= 6
    cuts = fold_cuts(df)
    assert sorted(apply_folds(df, cuts).collect()) == sorted(stratified_folds(df).collect())
    sizes = {(r["y"], r["fold"]): r["count"] for r in apply_folds(df, cuts).groupBy("y", "fold").count().collect()}
    assert sizes == {**{(1, k): 20 for k in range(5)}, **{(0, k): 160 for k in range(5)}}


def test_selection_tables_are_no_rdds(spark):
    mi = information_table(spark, {"F1": 0.2, "F2": None, "F3": 0.1})
    plan = select_features(spark, mi, ["F1", "F2", "F3"], top_k=2)._jdf.queryExecution().optimizedPlan().toString()
    assert "LogicalRDD" not in plan
    assert information_table(spark, {}).collect() == []
