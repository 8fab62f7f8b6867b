"""Validation metrics over any ``(group, key, y, p)`` table.

Scores are first aggregated to distinct values per group (a hot score is one
row), then cumulative true/false-positive counts come from the bucketed
``running_sums`` — no single-partition window. AP, ROC-AUC and KS are then
plain aggregates over that curve table:

* AP  = sum over distinct scores (descending) of (R_n - R_{n-1}) P_n — the
  step-wise definition, not Spark's trapezoidal ``areaUnderPR``;
* AUC = trapezoid over (FPR, TPR) = tie-averaged rank statistic;
* KS  = max(TPR - FPR), starting from the (0, 0) point.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskspark.config import PRECISION_AT_K
from riskspark.functions.columns import safe_div
from riskspark.operators.cumulative import running_sums


def curve(df: DataFrame, y: str = "y", p: str = "p", group: list[str] | None = None,
          n_buckets: int = 256) -> DataFrame:
    """M4: per group and distinct score (descending): pos, neg, cum tp/fp, totals."""
    g = list(group or [])
    counts = df.groupBy(*g, F.col(p).alias("score")).agg(
        F.count_if(F.col(y) == 1).alias("pos"), F.count_if(F.col(y) != 1).alias("neg"))
    cum = running_sums(counts, g, "score", ["pos", "neg"], descending=True, n_buckets=n_buckets)
    return cum.select(*g, "score", "pos", "neg",
                      F.col("cum_pos").alias("tp"), F.col("cum_neg").alias("fp"),
                      F.col("tot_pos").alias("n_pos"), F.col("tot_neg").alias("n_neg"))


def _curve_terms(c: DataFrame) -> DataFrame:
    tp, fp, P, N = (F.col(x).cast("double") for x in ("tp", "fp", "n_pos", "n_neg"))
    precision = safe_div(tp, tp + fp)
    recall = F.try_divide(tp, P)
    tpr_prev = F.try_divide(tp - F.col("pos"), P)
    return c.select(
        "*",
        precision.alias("precision"), recall.alias("recall"),
        (F.try_divide(F.col("pos").cast("double"), P) * precision).alias("ap_term"),
        (F.try_divide(F.col("neg").cast("double"), N) * (tpr_prev + recall) / F.lit(2.0)).alias("auc_term"),
        (recall - F.try_divide(fp, N)).alias("ks_term"),
        safe_div(F.lit(2.0) * precision * recall, precision + recall).alias("f1"),
    )


def ranking_metrics(df: DataFrame, y: str = "y", p: str = "p", group: list[str] | None = None,
                    n_buckets: int = 256) -> DataFrame:
    """M1-M3: ``pr_auc``, ``roc_auc``, ``ks_statistic`` per group (unrounded)."""
    g = list(group or [])
    t = _curve_terms(curve(df, y, p, g, n_buckets))
    return t.groupBy(*g).agg(
        F.sum("ap_term").alias("pr_auc"),
        F.sum("auc_term").alias("roc_auc"),
        F.greatest(F.lit(0.0), F.max("ks_term")).alias("ks_statistic"))


def tune_threshold(df: DataFrame, y: str = "y", p: str = "p", group: list[str] | None = None,
                   n_buckets: int = 256) -> DataFrame:
    """The score maximising F1 on the PR curve, lowest such score on ties."""
    g = list(group or [])
    t = _curve_terms(curve(df, y, p, g, n_buckets))
    if not g:  # one group: the best F1 is a single number, used as a literal (no constant-key join)
        best_f1 = t.agg(F.max("f1")).first()[0]
        return t.where(F.col("f1") == F.lit(best_f1)).agg(
            F.min("score").alias("threshold"), F.first("f1").alias("best_f1"))
    best = t.groupBy(*g).agg(F.max("f1").alias("best_f1"))
    # one row per group: a small broadcast side by construction
    picked = t.join(F.broadcast(best), g, "inner")
    return picked.where(F.col("f1") == F.col("best_f1")).groupBy(*g).agg(
        F.min("score").alias("threshold"), F.first("best_f1").alias("best_f1"))


def confusion(df: DataFrame, thr: Column, y: str = "y", p: str = "p",
              group: list[str] | None = None) -> DataFrame:
    """M5-M8: confusion counts, precision/recall/F1 (0 on zero division), FPR, accuracy."""
    g = list(group or [])
    pred = F.col(p) >= thr
    pos = F.col(y) == 1
    cm = df.groupBy(*g).agg(
        F.count_if(pred & pos).alias("tp"), F.count_if(pred & ~pos).alias("fp"),
        F.count_if(~pred & ~pos).alias("tn"), F.count_if(~pred & pos).alias("fn"))
    tp, fp, tn, fn = (F.col(x).cast("double") for x in ("tp", "fp", "tn", "fn"))
    prec = safe_div(tp, tp + fp)
    rec = safe_div(tp, tp + fn)
    return cm.select(
        "*", prec.alias("precision"), rec.alias("recall"),
        safe_div(F.lit(2.0) * prec * rec, prec + rec).alias("f1"),
        safe_div(fp, fp + tn).alias("false_positive_rate"),
        safe_div(tp + tn, tp + tn + fp + fn).alias("accuracy"))


def precision_at_k(df: DataFrame, k: int, y: str = "y", p: str = "p", key: str = "account_id") -> DataFrame:
    """K7: hits among the k highest scores (ties by key); k = min(k, n); 0 when k = 0.

    ``orderBy().limit(k)`` plans TakeOrderedAndProject: each partition keeps
    its own top k and only those are merged, so no group is gathered.
    """
    top = df.orderBy(F.col(p).desc(), F.col(key).asc()).limit(k)
    return top.agg(F.count(F.lit(1)).alias("k"),
                   F.coalesce(F.sum(F.col(y)), F.lit(0)).cast("long").alias("hits")) \
        .select(F.col("k").cast("int").alias("k"), "hits",
                safe_div(F.col("hits").cast("double"), F.col("k")).alias("precision"))


def model_metrics(df: DataFrame, thresholds: DataFrame, y: str = "y", p: str = "p",
                  key: str = "account_id", model: str = "model",
                  ks=PRECISION_AT_K, n_buckets: int = 256) -> DataFrame:
    """One row per model: ranking metrics, confusion at its threshold, P@K.

    ``thresholds`` is ``(model, threshold)``: one row per model (broadcast).
    """
    with_thr = df.join(F.broadcast(thresholds), model, "inner")
    rank = ranking_metrics(df, y, p, [model], n_buckets)
    cm = confusion(with_thr, F.col("threshold"), y, p, [model])
    out = thresholds.join(rank, model, "left").join(cm, model, "left")
    models = [r[0] for r in thresholds.select(model).collect()]  # config-sized list
    for k in ks:
        parts = [precision_at_k(df.where(F.col(model) == m), k, y, p, key)
                 .select(F.lit(m).alias(model), F.col("precision").alias(f"precision_at_{k}"),
                         F.col("hits").alias(f"hits_at_{k}"), F.col("k").alias(f"k_at_{k}"))
                 for m in models]
        pk = parts[0]
        for part in parts[1:]:
            pk = pk.unionByName(part)
        out = out.join(pk, model, "left")
    return out
