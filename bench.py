"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query is executed in full with the ``noop`` sink (no collect to the
driver). Fixtures shared by several queries (the account table built from
orders x lineitem, the cleaned table) are built once and timed separately,
as a production run would persist its cleaned input.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "top_flagged_cases", "risk_assessment", "typology_assignment", "indicator_records",
    "dataset_summary", "hint_profile", "column_medians", "feature_type_breakdown",
    "pr_curve", "model_metrics", "tuned_threshold",
    "stratified_split_counts", "mutual_information", "feature_selection_model_b", "imputed_features",
    "case_reports", "report_sections", "case_store_upsert", "dashboard_kpis",
    "risk_propagation", "risk_components", "campaign_summary",
    "single_account_json", "stream_scoring", "smote_class_counts", "csv_accounts", "top_attributions",
]


def training(spark, sf_dir: str, timings: dict[str, float]) -> None:
    """Both models with default parameters (twelve fits of 300 trees, five folds each) and the attribution
    of all held-out accounts."""
    from pyspark.sql import functions as F

    from riskspark.operators.explain import explain_rows
    from riskspark.plans.learn import train_models
    from riskspark.plans.queries import cleaning

    model, clean = cleaning(spark, sf_dir)
    t = time.time()
    models = train_models(clean, model.output_features)
    timings["training_both_models"] = round(time.time() - t, 3)
    t = time.time()
    b = models["B"]
    held_out = b.features.transform(models["split"].where(F.col("is_test")), keep=("account_id",))
    explain_rows(held_out, b.model, b.features.selected).write.format("noop").mode("overwrite").save()
    timings["attribution_held_out"] = round(time.time() - t, 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]
    from riskspark.plans.queries import REGISTRY, accounts_p, cleaning, scored_p
    from riskspark.session import local_session

    spark = local_session(cpus, shuffle_partitions=int(cpus) * 2, app_name="riskspark-bench")
    timings: dict[str, float] = {}

    t0 = time.time()
    n_accounts = accounts_p(spark, sf_dir).count()
    scored_p(spark, sf_dir).count()
    cleaning(spark, sf_dir)[1].count()
    timings["fixture_build"] = round(time.time() - t0, 3)

    for name in only or HEADLINE:
        t = time.time()
        REGISTRY[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.time() - t, 3)
    if not only:
        training(spark, sf_dir, timings)

    total = round(sum(timings.values()), 3)
    score_s = timings.get("risk_assessment")
    out = {
        "metric": "total_sec",
        "value": total,
        "unit": "sec",
        "queries": timings,
        "sf": os.path.basename(sf_dir).replace("sf", ""),
        "accounts": n_accounts,
        "scoring_rows_per_sec": round(n_accounts / score_s, 1) if score_s else None,
        "cpus": cpus,
    }
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
