"""Split/fold exactness, cleaning estimator semantics."""

from pyspark.sql import functions as F

from riskspark.operators.clean import Cleaner, normalize_null_tokens
from riskspark.operators.sampling import stratified_folds, stratified_split, holdout_allocation


def test_allocation_matches_reference_counts():
    # 9,082 rows, 81 positives -> 1,817 test rows: 16 positives, 1,801 negatives
    assert holdout_allocation({1: 81, 0: 9001}, 0.2) == {1: 16, 0: 1801}


def test_split_and_folds_exact(spark):
    df = spark.range(1000).select(F.col("id").alias("account_id"),
                                  F.when(F.col("id") % 9 == 0, 1).otherwise(0).alias("y"))
    s = stratified_split(df, "y", "account_id", 0.2, 42)
    got = {r["y"]: r["n"] for r in s.where("is_test").groupBy("y").agg(F.count("*").alias("n")).collect()}
    assert got == holdout_allocation({1: 112, 0: 888}, 0.2)
    f = stratified_folds(df, 5, "y", "account_id", 43)
    sizes = {(r["y"], r["fold"]): r["n"] for r in f.groupBy("y", "fold").agg(F.count("*").alias("n")).collect()}
    for cls in (0, 1):
        fold_sizes = [sizes[(cls, k)] for k in range(5)]
        assert max(fold_sizes) - min(fold_sizes) <= 1
    assert sum(sizes.values()) == 1000
    # same result on another partitioning
    s16 = stratified_split(df.repartition(16), "y", "account_id", 0.2, 42)
    assert sorted(r[0] for r in s.where("is_test").select("account_id").collect()) == \
        sorted(r[0] for r in s16.where("is_test").select("account_id").collect())


def test_cleaner_learns_on_train_and_replays(spark):
    raw = spark.createDataFrame(
        [("0", "1", " 1.5", "L7D", "Student ", "NA", "x"), ("1", "0", "nan", "L14D", "retired", "", "y"),
         ("2", "bad", "1d", "zzz", "others", "None", "z"), ("3", "1", "2", " L31D", "SALARIED", "n/a", "w")],
        "`Unnamed: 0` string, F3924 string, F1 string, F3889 string, F3891 string, F2 string, F3 string")
    raw = normalize_null_tokens(raw)
    m = Cleaner().fit(raw)
    assert set(m.dropped_null_columns) == {"F2", "F3"}  # F3 is text: all NULL after coercion
    assert m.missing_columns == ["F1", "F3889"]
    out = m.transform(raw).orderBy("F3891").collect()
    assert [r["y"] for r in m.transform(raw).collect()] == [1, 0, 0, 1]
    vals = {r["F3891"]: (r["F1"], r["F3889"], r["F1_missing"]) for r in out}
    assert vals[2.0] == (1.5, 0.0, 0)       # student, ' 1.5', L7D
    assert vals[5.0] == (None, 1.0, 1)      # retired, 'nan' -> NULL
    assert vals[6.0] == (None, None, 1)     # '1d' rejected, unknown standing
    assert vals[1.0] == (2.0, 2.0, 0)       # upper-case occupation lower-cased; standing stripped
    # replay on a frame lacking a learned column: it appears as NULL
    again = m.transform(raw.drop("F1"))
    assert "F1" in again.columns and again.where(F.col("F1").isNotNull()).count() == 0


def test_csv_source_with_index_and_null_tokens(spark):
    import uuid
    from riskspark.operators.clean import read_accounts_csv
    from riskspark.session import shared_dir
    path = shared_dir(spark, f"csv-{uuid.uuid4().hex}")
    lines = [",F3924,F115,F3889,F3891,F2", "0,1,0.5,L7D, Student,NA", "1,0,#N/A,G365D,retired,",
             "2,x,1e-1,L90D,others,null"]
    spark.createDataFrame([(l,) for l in lines], "v string").coalesce(1).write.text(path)
    raw = read_accounts_csv(spark, path)
    assert raw.columns[0] == "_c0"                       # blank header of the saved index
    m = Cleaner().fit(raw)
    assert "_c0" not in m.features and m.dropped_null_columns == ["F2"]
    rows = sorted(m.transform(raw).collect(), key=lambda r: r["F3889"])  # L7D=0, L90D=3, G365D=6
    assert [r["y"] for r in rows] == [1, 0, 0]          # 'x' -> 0
    assert [r["F115"] for r in rows] == [0.5, 0.1, None]  # '1e-1' parsed, '#N/A' is NULL


def test_hash_sample_and_class_weight(spark):
    from riskspark.config import RiskConfig
    from riskspark.operators.sampling import hash_sample
    from riskspark.plans.learn import class_weight
    df = spark.range(1000).select(F.col("id").alias("account_id"),
                                  F.when(F.col("id") % 10 == 0, 1).otherwise(0).alias("y"))
    a = sorted(r[0] for r in hash_sample(df, 400).select("account_id").collect())
    b = sorted(r[0] for r in hash_sample(df.repartition(13), 400).select("account_id").collect())
    assert len(a) == 400 and a == b
    assert hash_sample(df.limit(50), 400).count() == 50          # fewer rows than n: all of them
    assert class_weight(df, "y", RiskConfig()) == 900 / 100       # measured legit / mule ratio
    assert class_weight(df, "y", RiskConfig(pos_weight=112)) == 112.0


def test_cleaning_model_roundtrip(spark):
    import uuid
    from riskspark.operators.clean import CleaningModel
    from riskspark.session import shared_dir
    raw = spark.createDataFrame([("1", "0.5", "L7D", None), ("0", None, "L14D", None)],
                                "F3924 string, F1 string, F3889 string, F2 string")
    m = Cleaner().fit(raw)
    path = shared_dir(spark, f"clean-{uuid.uuid4().hex}")
    m.save(path, spark)
    again = CleaningModel.load(path, spark)
    assert again == m
    assert again.transform(raw).collect() == m.transform(raw).collect()
