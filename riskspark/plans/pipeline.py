"""Batch pipeline (X4, X6, G17) and table fingerprint (A4), single-row input (A5).

``analyze`` is the full per-account chain (probability -> score, severity,
indicators, typology -> attributions -> report) as one DataFrame transform:
the same code for one row, a batch or a stream micro-batch.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskspark.config import DEFAULT_CONFIG, TOP_CASES, RiskConfig
from riskspark.operators.casetext import fallback_report
from riskspark.operators.fingerprint import dataset_fingerprint
from riskspark.plans.analyze import account_profile, assess, case_id, registry_flag, row_content, top_cases


def parse_feature_json(lines: DataFrame, schema: T.StructType, col: str = "value") -> DataFrame:
    """A5: JSON feature dicts (one per line) -> typed rows with the fitted schema; absent keys -> NULL."""
    return lines.select(F.from_json(F.col(col), schema).alias("_r")).select("_r.*")


def flat_analysis(assessed: DataFrame, cfg: RiskConfig = DEFAULT_CONFIG, model_used: str = "B") -> DataFrame:
    """Flat columns used by the text operators (case id, profile fields, flag)."""
    return assessed.select(
        "*", case_id(F.col(cfg.key), row_content(assessed)).alias("case_id"), registry_flag(cfg).alias("f3912_flag"),
        F.col(f"x_{cfg.age_col}").alias("age"), F.col(f"x_{cfg.tenure_col}").alias("tenure"),
        F.lit(model_used).alias("model_used"),
        account_profile(cfg).alias("account_profile"))


def analyze(df: DataFrame, prob_col: str, threshold: float, cfg: RiskConfig = DEFAULT_CONFIG,
            shap: DataFrame | None = None, model_used: str = "B") -> DataFrame:
    """Analysis rows with the deterministic report; ``shap`` is an optional
    ``(key, shap_values)`` table (from ``explain.shap_struct_array``)."""
    a = flat_analysis(assess(df, prob_col, threshold, cfg), cfg, model_used)
    if shap is not None:
        a = a.join(shap, cfg.key, "left")
    else:
        a = a.withColumn("shap_values", F.lit(None).cast(
            "array<struct<feature:string,raw_feature:string,shap_value:double,"
            "direction:string,feature_value:double>>"))
    return a.select("*", fallback_report(a).alias("report"), F.lit("fallback").alias("report_source"))


def run_pipeline(spark: SparkSession, raw: DataFrame | str, cfg: RiskConfig = DEFAULT_CONFIG,
                 models: dict | None = None, params=None, top_n: int = TOP_CASES,
                 store=None) -> dict:
    """Clean -> train (or reuse) -> score all -> metrics if labelled -> top cases.

    ``raw`` is a table or the path of a CSV file (A6). Models that carry a cleaner
    bring it along; otherwise one is fitted on the training rows. Returns the frames
    of each stage plus a one-row run summary (G17).
    """
    from riskspark.operators.clean import Cleaner, drop_index_column, read_accounts_csv
    from riskspark.operators.explain import explain_rows, shap_struct_array, top_attributions
    from riskspark.operators.metrics import model_metrics
    from riskspark.operators.sampling import stratified_split
    from riskspark.plans.learn import train_models

    from riskspark.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(spark)
    t0 = time.time()
    if isinstance(raw, str):
        raw = drop_index_column(read_accounts_csv(spark, raw), cfg)
    given = models["B"].cleaner if models else None
    cleaner = given or Cleaner(cfg).fit_on_training_rows(raw)
    clean = cleaner.transform(raw, cfg).checkpoint()  # written once to the shared folder
    labelled = "y" in clean.columns
    split = None
    if models is None:
        models = train_models(clean, cleaner.output_features, cfg, params,
                              split=cleaner.split(clean, cfg) if labelled else None)
        split = models["split"]
        models["A"].cleaner = models["B"].cleaner = cleaner
    b = models["B"]
    scored = b.score(clean).checkpoint()  # the cleaned columns and p, one projection
    joined = scored
    assessed = assess(joined, "p", b.threshold, cfg)
    top = top_cases(assessed, cfg.key, top_n)
    prepared_top = b.features.transform(top.select(cfg.key, *[c for c in clean.columns if c != cfg.key]),
                                        keep=(cfg.key,))
    shap = shap_struct_array(top_attributions(explain_rows(prepared_top, b.model, b.features.selected, cfg.key),
                                              10, cfg.key), cfg.key)
    # re-analyse the top rows from their input columns (features + p), now with attributions
    cases = analyze(top.select(*joined.columns), "p", b.threshold, cfg, shap)
    metrics = None
    if labelled:
        # models from elsewhere are measured on this table's own held-out rows
        split = stratified_split(clean, "y", cfg.key, 0.2, cfg.seed) if split is None else split
        test = split.where(F.col("is_test"))
        parts = [models[m].predict(test, cfg.key).select(F.lit(m).alias("model"), cfg.key, "y", "p")
                 for m in ("A", "B")]
        thr = spark.createDataFrame([(m, float(models[m].threshold)) for m in ("A", "B")],
                                    "model string, threshold double")
        metrics = model_metrics(parts[0].unionByName(parts[1]), thr, key=cfg.key)
    flagged_n = assessed.where(F.col("risk_score") >= cfg.flag_threshold).count()
    digest = dataset_fingerprint(raw).first()
    summary = spark.createDataFrame(
        [(clean.count(), len(b.features.selected), flagged_n,
          int(clean.agg(F.coalesce(F.sum("y"), F.lit(0))).first()[0]) if labelled else 0,
          float(b.threshold), digest["xor_digest"], digest["sum_digest"], round(time.time() - t0, 2))],
        "rows long, features_selected int, flagged long, mules long, threshold double, "
        "xor_digest long, sum_digest string, seconds double")
    if store is not None:
        store.clear_uploaded()  # a run replaces the uploaded cases of the run before
        store.save(cases.select("case_id", F.col(cfg.key).cast("long").alias("account_id"), "risk_score",
                                "severity", "typology", "confidence", F.lit(False).alias("is_demo"),
                                "report"))
    return {"clean": clean, "scored": scored, "assessed": assessed, "cases": cases,
            "metrics": metrics, "summary": summary, "models": models}
