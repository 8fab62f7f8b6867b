"""Dataset profiling (G1-G13, K8, D14) over wide or long account tables.

Wide tables are profiled with single-pass aggregates (one row of counts),
unpivoted into ``(feature, ...)`` rows; per-feature distributions use the long
form ``(key, y, feature, value)`` with partial aggregation before any shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskspark.config import DEFAULT_CONFIG, RiskConfig
from riskspark.functions.columns import map_lookup
from riskspark.operators.cumulative import running_sums


def to_long(df: DataFrame, features: list[str], id_cols: list[str]) -> DataFrame:
    """Wide -> long ``(*id_cols, feature, value)`` with one Generate (no union of selects).

    The generated rows carry a position; its name comes from one literal array, so
    the expression stays small at thousands of columns.
    """
    values = F.array(*[F.col(f"`{f}`").cast(T.DoubleType()) for f in features]) if features \
        else F.array().cast("array<double>")
    names = F.array(*map(F.lit, features)) if features else F.array().cast("array<string>")
    return df.select(*id_cols, F.posexplode(values).alias("_pos", "value")).select(
        *id_cols, F.get(names, F.col("_pos")).alias("feature"), "value")


def value_counts(df: DataFrame, features: list[str], y: str = "y") -> DataFrame:
    """``(feature, value, pos, neg)``: how often each value (NULL too) occurs with either label.

    The one pass over the data behind medians, KS, MI and leakage; counts are
    combined in the map tasks, so a value of a third of all rows is one row per task.
    """
    return to_long(df, features, [y]).groupBy("feature", "value").agg(
        F.count_if(F.col(y) == 1).alias("pos"), F.count_if(~F.col(y).eqNullSafe(1)).alias("neg"))


def non_null_counts(df: DataFrame, features: list[str], chunk: int = 200) -> DataFrame:
    """``(feature, n_rows, n_non_null)``: aggregates of ``chunk`` columns each, so that
    plans stay small on tables of thousands of columns."""
    parts = []
    for lo in range(0, max(len(features), 1), chunk):
        part = features[lo:lo + chunk]
        wide = df.agg(F.count(F.lit(1)).alias("n_rows"),
                      *[F.count(F.col(f"`{c}`")).alias(f"_{i}") for i, c in enumerate(part)])
        names = F.array(*map(F.lit, part)) if part else F.array().cast("array<string>")
        counts = F.array(*[F.col(f"_{i}") for i in range(len(part))]) if part else F.array().cast("array<bigint>")
        parts.append(wide.select("n_rows", F.posexplode(counts).alias("_pos", "n_non_null"))
                     .select(F.get(names, F.col("_pos")).alias("feature"), "n_rows", "n_non_null"))
    return reduce(DataFrame.unionByName, parts)


def null_fractions(df: DataFrame, features: list[str]) -> DataFrame:
    """``(feature, n_rows, n_non_null, null_fraction)``."""
    return non_null_counts(df, features).select(
        "feature", "n_rows", F.col("n_non_null").cast(T.LongType()).alias("n_non_null"),
        (F.lit(1.0) - F.col("n_non_null") / F.col("n_rows")).alias("null_fraction"))


def distinct_counts(df: DataFrame, features: list[str]) -> DataFrame:
    """``(feature, n_distinct)``, exact: distinct values are combined in the map tasks first."""
    counted = (to_long(df, features, []).where(F.col("value").isNotNull()).distinct()
               .groupBy("feature").agg(F.count(F.lit(1)).alias("n_distinct")))
    names = df.sparkSession.createDataFrame([(f,) for f in features], "feature string")
    return names.join(counted, "feature", "left").select(
        "feature", F.coalesce("n_distinct", F.lit(0)).cast("long").alias("n_distinct"))


def feature_types(df: DataFrame, features: list[str], cfg: RiskConfig = DEFAULT_CONFIG) -> DataFrame:
    """``(feature, n_distinct, feature_type)``; configured categoricals first."""
    t = (F.when(F.col("feature").isin(*cfg.categorical), F.lit("categorical"))
         .when(F.col("n_distinct") <= 2, F.lit("binary"))
         .when(F.col("n_distinct") <= 10, F.lit("low_cardinality"))
         .otherwise(F.lit("continuous")))
    return distinct_counts(df, features).select("feature", "n_distinct", t.alias("feature_type"))


def type_breakdown(types: DataFrame) -> DataFrame:
    """G6 + G16: counts of each type and their share of all features (0-safe)."""
    counts = types.groupBy("feature_type").agg(F.count(F.lit(1)).alias("n_features"))
    total = F.sum("n_features").over(Window.partitionBy())  # at most 4 rows
    return counts.select("feature_type", "n_features",
                         F.coalesce(F.try_divide(F.col("n_features") * F.lit(100.0), total),
                                    F.lit(0.0)).alias("share_pct"))


def class_means(counts: DataFrame) -> DataFrame:
    """Per feature mean among mules and legit accounts (NULLs skipped), from ``value_counts``."""
    v = F.col("value")
    some = counts.where(v.isNotNull())
    return some.groupBy("feature").agg(
        F.try_divide(F.sum(v * F.col("pos")), F.sum("pos")).alias("mule_mean"),
        F.try_divide(F.sum(v * F.col("neg")), F.sum("neg")).alias("legit_mean"),
        F.sum("pos").alias("n_mule"), F.sum("neg").alias("n_legit"))


def means_by_class(df: DataFrame, features: list[str], y: str = "y") -> DataFrame:
    """G7 from the wide table: one aggregate of a few columns (the hints), no long form."""
    positive = F.col(y).eqNullSafe(1)

    def of(f, label):
        return F.when(label, F.col(f"`{f}`").cast("double"))
    row = df.agg(*[agg.alias(f"{name}{k}") for k, f in enumerate(features) for name, agg in (
        ("m", F.avg(of(f, positive))), ("l", F.avg(of(f, ~positive))),
        ("p", F.count(of(f, positive))), ("n", F.count(of(f, ~positive))))])
    stats = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"m{k}").alias("mule_mean"), F.col(f"l{k}").alias("legit_mean"),
                               F.col(f"p{k}").alias("n_mule"), F.col(f"n{k}").alias("n_legit")) for k, f in enumerate(features)])
    return row.select(F.inline(stats))


def ks_statistic(counts: DataFrame) -> DataFrame:
    """Two-sample KS per feature = max |ECDF_mule - ECDF_legit|, from ``value_counts``.

    A value is one row, so ties are exact; the running counts come from the
    bucketed ``running_sums`` (no single-partition window). NULL when either class
    has fewer than two values.
    """
    cum = running_sums(counts.where(F.col("value").isNotNull()), ["feature"], "value", ["pos", "neg"])
    diff = F.abs(F.try_divide(F.col("cum_pos"), F.col("tot_pos"))
                 - F.try_divide(F.col("cum_neg"), F.col("tot_neg")))
    return cum.groupBy("feature").agg(
        F.max(diff).alias("ks"), F.first("tot_pos").alias("n_pos"), F.first("tot_neg").alias("n_neg")) \
        .select("feature", F.when((F.col("n_pos") > 1) & (F.col("n_neg") > 1), F.col("ks")).alias("ks_stat"))


def discriminative_power(ks: Column) -> Column:
    """High / Medium / Low by KS, em dash without a KS."""
    return (F.when(ks.isNull(), F.lit("—")).when(ks >= 0.5, F.lit("High"))
            .when(ks >= 0.25, F.lit("Medium")).otherwise(F.lit("Low")))


def hint_table(spark: SparkSession, df: DataFrame, y: str = "y",
               cfg: RiskConfig = DEFAULT_CONFIG) -> DataFrame:
    """G10 + B12: one row per hint feature in config order; absent features give NULL stats."""
    present = [f for f in cfg.hints if f in df.columns]
    hints = spark.createDataFrame([(i, f) for i, f in enumerate(cfg.hints)], "hint_rank int, feature string")
    meaning = F.coalesce(map_lookup(cfg.hint_meanings, F.col("feature")),
                         F.concat(F.lit("Feature "), F.col("feature")))
    if present and y in df.columns:
        from riskspark.operators.refine import ks_statistics
        ks = spark.createDataFrame(list(ks_statistics(df, present, y).items()), "feature string, ks_stat double")
        stats = means_by_class(df, present, y).join(F.broadcast(ks), "feature", "left")  # a row per hint
    else:
        stats = spark.createDataFrame([], "feature string, mule_mean double, legit_mean double, "
                                          "n_mule long, n_legit long, ks_stat double")
    # hints is a config list (18 rows): broadcast size is fixed
    return F.broadcast(hints).join(stats, "feature", "left").select(
        "hint_rank", "feature", meaning.alias("decoded_meaning"),
        F.when(F.col("n_mule") > 0, F.col("mule_mean")).alias("mule_mean"),
        F.when(F.col("n_legit") > 0, F.col("legit_mean")).alias("legit_mean"),
        "ks_stat", discriminative_power(F.col("ks_stat")).alias("discriminative_power"))


def class_rate_by(df: DataFrame, col: str, y: str = "y") -> DataFrame:
    """Observed positive rate and count per category (the priors table)."""
    return df.groupBy(col).agg(F.avg(F.col(y).cast("double")).alias("positive_rate"),
                               F.count(F.lit(1)).alias("n_accounts"))


def dataset_stats(spark: SparkSession, df: DataFrame, features: list[str], n_dropped: int,
                  y: str = "y") -> DataFrame:
    """One summary row (rows, features, classes, ratio, sparsity,
    dropped columns) with the table's fingerprint (A4).

    Sparsity is the mean NULL share over the columns' non-NULL counts, which are
    taken in chunks of columns.
    """
    from riskspark.operators.fingerprint import dataset_fingerprint
    has_y = y in df.columns
    classes = df.agg(
        F.count(F.lit(1)).alias("rows"),
        (F.coalesce(F.sum(F.col(y)), F.lit(0)) if has_y else F.lit(0)).cast(T.LongType()).alias("mule_count"),
        (F.count_if(F.col(y) == 0) if has_y else F.lit(0)).cast(T.LongType()).alias("legit_count"))
    sparsity = null_fractions(df, features).agg(
        (F.coalesce(F.avg("null_fraction"), F.lit(0.0)) * F.lit(100.0)).alias("sparsity_pct"))
    digest = dataset_fingerprint(df).select("xor_digest", "sum_digest")
    one, two, three = (part.first().asDict() for part in (classes, sparsity, digest))  # one row each
    row = spark.createDataFrame([{**one, **two, **three}], "rows long, mule_count long, legit_count long, "
                                "sparsity_pct double, xor_digest long, sum_digest string")
    ratio = F.try_divide(F.col("legit_count").cast("double"), F.col("mule_count"))
    return row.select(
        "rows", F.lit(len(features)).alias("features"), F.lit(n_dropped).alias("fully_null_columns"),
        "mule_count", "legit_count",
        F.when(F.col("mule_count") > 0, F.concat(F.bround(ratio, 0).cast(T.LongType()).cast("string"),
                                                 F.lit(":1"))).otherwise(F.lit("n/a")).alias("imbalance_ratio"),
        "sparsity_pct", "xor_digest", "sum_digest")


def exact_medians(counts: DataFrame) -> DataFrame:
    """Exact median per feature (mean of the two middle values), NULLs skipped, from ``value_counts``.

    Distributed selection: distinct values are ranked by bucketed running counts,
    and the rows holding the middle ranks are kept; no group is ever materialised
    in one task. All-NULL features give 0.0.
    """
    some = counts.where(F.col("value").isNotNull()).select(
        "feature", "value", (F.col("pos") + F.col("neg")).alias("cnt"))
    cum = running_sums(some, ["feature"], "value", ["cnt"])
    n = F.col("tot_cnt")
    lo_rank = F.floor((n - 1) / 2) + 1
    hi_rank = F.floor(n / 2) + 1
    first = F.col("cum_cnt") - F.col("cnt")
    picked = cum.groupBy("feature").agg(
        F.max(F.when((first < lo_rank) & (lo_rank <= F.col("cum_cnt")), F.col("value"))).alias("lo"),
        F.max(F.when((first < hi_rank) & (hi_rank <= F.col("cum_cnt")), F.col("value"))).alias("hi"))
    feats = counts.select("feature").distinct()
    return feats.join(picked, "feature", "left").select(
        "feature", F.coalesce((F.col("lo") + F.col("hi")) / F.lit(2.0), F.lit(0.0)).alias("median"))


def rank_hints_by_ks(hints: DataFrame) -> DataFrame:
    """K8: hint rows by KS statistic, strongest first (NULL KS last, then config order)."""
    return hints.orderBy(F.col("ks_stat").desc_nulls_last(), F.col("hint_rank"))


def leakage_report(counts: DataFrame, mi: DataFrame | None = None) -> DataFrame:
    """How well "value >= 1" alone flags the positives, per feature (precision,
    recall, flagged count), with the feature's MI when given; from ``value_counts``. A
    column with near-perfect precision is a leakage suspect (the registry flag)."""
    flag = F.col("value") >= 1
    n = F.col("pos") + F.col("neg")
    rep = counts.groupBy("feature").agg(
        F.coalesce(F.sum(F.when(flag, n)), F.lit(0)).alias("n_flagged"),
        F.coalesce(F.sum(F.when(flag, F.col("pos"))), F.lit(0)).alias("tp"),
        F.sum("pos").alias("n_pos"))
    return _flag_shares(rep, mi)


def _flag_shares(rep: DataFrame, mi: DataFrame | None) -> DataFrame:
    rep = rep.select("feature", "n_flagged",
                     F.try_divide(F.col("tp").cast("double"), F.col("n_flagged")).alias("flag_precision"),
                     F.try_divide(F.col("tp").cast("double"), F.col("n_pos")).alias("flag_recall"))
    return rep.join(mi, "feature", "left") if mi is not None else rep


def wide_leakage_report(df: DataFrame, features: list[str], y: str = "y", mi: DataFrame | None = None) -> DataFrame:
    """D14 from the wide table: the columns' flag counts in one pass, without a row per value."""
    from riskspark.operators.refine import flag_counts
    n_pos = df.where(F.col(y) == 1).count()
    rows = [(f, p + n, p, n_pos) for f, (p, n) in flag_counts(df, features, y).items()]
    return _flag_shares(df.sparkSession.createDataFrame(rows, "feature string, n_flagged long, tp long, n_pos long"), mi)
