"""Feature selection.

``FeatureSelector.fit`` works on training rows only: exact medians, plug-in
mutual information on median-filled values, then the top-k list with forced
domain hints. The fitted ``FeatureModel`` reindexes any table to exactly the
selected columns (absent -> NULL) and fills NULLs with the *training* medians.
"""

from __future__ import annotations

import json
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, field

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskspark.config import DEFAULT_CONFIG, RiskConfig
from riskspark.functions.columns import num
from riskspark.operators.clean import MISSING_SUFFIX
from riskspark.operators.cumulative import running_sums
from riskspark.operators import refine
from riskspark.session import ensure_checkpoint_dir, small_table


def impute_long(long: DataFrame, medians: DataFrame) -> DataFrame:
    """Long form with NULL values replaced by the feature's median (one row per feature: broadcast)."""
    return long.join(F.broadcast(medians), "feature", "left").select(
        *[c for c in long.columns if c != "value"],
        F.coalesce(F.col("value"), F.col("median"), F.lit(0.0)).alias("value"))


def mutual_information(counts: DataFrame, n_bins: int = 20, discrete_max: int = 10) -> DataFrame:
    """Plug-in MI (nats) of each feature with the label, from imputed value counts
    (``profile.value_counts`` with NULLs replaced: ``feature, value, pos, neg``).

    Features with at most ``discrete_max`` distinct values use each value as a
    bin; others use ``n_bins`` equal-frequency bins over exact ranks, where a
    value's bin is ``floor(rows_below * n_bins / n)`` so ties share a bin.
    The ranking, not the estimator, is the contract with the reference.
    """
    counts = counts.groupBy("feature", "value").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    counts = counts.select("*", (F.col("pos") + F.col("neg")).alias("cnt"))
    cum = running_sums(counts, ["feature"], "value", ["cnt"])
    nd = cum.groupBy("feature").agg(F.count(F.lit(1)).alias("n_distinct"))
    # one row per feature: broadcast
    binned = cum.join(F.broadcast(nd), "feature").select(
        "feature", "pos", "neg",
        F.when(F.col("n_distinct") <= discrete_max, F.col("value"))
        .otherwise(F.floor((F.col("cum_cnt") - F.col("cnt")) * n_bins / F.col("tot_cnt"))
                   .cast(T.DoubleType())).alias("bin"))
    bins = binned.groupBy("feature", "bin").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    tot = Window.partitionBy("feature")  # bins per feature: at most n_bins or discrete_max rows
    b = bins.select("feature", "pos", "neg",
                    F.sum("pos").over(tot).alias("P"), F.sum("neg").over(tot).alias("Q"))
    n = F.col("P") + F.col("Q")
    nb = F.col("pos") + F.col("neg")

    def term(cell, cls_total):
        cell_d = cell.cast("double")
        return F.when(cell > 0, cell_d / n * F.log(cell_d * n / (nb * cls_total)))\
            .otherwise(F.lit(0.0))
    return b.groupBy("feature").agg(
        F.sum(term(F.col("pos"), F.col("P")) + term(F.col("neg"), F.col("Q"))).alias("mi"))


def information_table(spark: SparkSession, scores: dict[str, float]) -> DataFrame:
    """``(feature, mi)`` of ``refine.label_information``'s result."""
    return small_table(spark, list(scores.items()), "feature string, mi double")


def select_features(spark: SparkSession, mi: DataFrame, features: list[str],
                    cfg: RiskConfig = DEFAULT_CONFIG, include_leakage: bool = True,
                    top_k: int | None = None) -> DataFrame:
    """K3: ``(feature, rank, mi, forced)`` of the selected columns.

    The column table (one row per column) is joined with the hint table, once by
    the column itself and once by the column a ``_missing`` flag belongs to. That
    gives each column a tier: hint, flag of a hint, leak column (if allowed), other.
    Tiers come in this order, hints as configured, others by MI (ties by place);
    the first ``top_k`` ranks and every forced column are kept.
    """
    k = cfg.top_k if top_k is None else top_k
    columns = small_table(spark, list(enumerate(features)), "place int, feature string")
    hints = small_table(spark, list(enumerate(cfg.hints)), "hint_place int, hint string")
    flags = hints.select(F.concat("hint", F.lit(MISSING_SUFFIX)).alias("flag"))
    leak = F.lit(include_leakage) & (F.col("feature") == cfg.leakage)
    tiered = (columns.join(hints, F.col("feature") == F.col("hint"), "left")
              .join(flags, F.col("feature") == F.col("flag"), "left")
              .withColumn("tier", F.when(F.col("hint").isNotNull(), 0).when(F.col("flag").isNotNull(), 1)
                          .when(leak, 2)).join(mi, "feature", "left"))
    forced = F.col("tier").isNotNull()
    order = Window.orderBy(F.col("tier").asc_nulls_last(), F.col("hint_place").asc_nulls_last(),
                           F.when(~forced, F.col("mi")).desc_nulls_last(), F.col("place"))  # one row per column
    return (tiered.withColumn("rank", F.row_number().over(order)).where(forced | (F.col("rank") <= k))
            .select("feature", "rank", "mi", forced.alias("forced")))


@dataclass
class FeatureModel:
    """Fitted selection: ordered features, training medians, MI scores."""

    selected: list[str]
    medians: dict
    mi_scores: dict = field(default_factory=dict)
    leakage_present: bool = False
    include_leakage: bool = True

    def transform(self, df: DataFrame, keep: tuple = ()) -> DataFrame:
        """Exact selected columns (absent -> NULL) filled with training medians."""
        cols = [F.col(c) for c in keep if c in df.columns]
        for f in self.selected:
            v = num(F.col(f"`{f}`"), df.schema[f].dataType) if f in df.columns \
                else F.lit(None).cast(T.DoubleType())
            cols.append(F.coalesce(v, F.lit(float(self.medians.get(f, 0.0)))).alias(f))
        return df.select(*cols)

    def top_mi(self, n: int = 20) -> list:
        """K4: the n best MI scores."""
        return sorted(self.mi_scores.items(), key=lambda kv: (-kv[1], kv[0]))[:n]

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def from_json(s: str) -> FeatureModel:
        return FeatureModel(**json.loads(s))


class FeatureSelector:
    """Estimator over a cleaned training table with label column ``y``."""

    def __init__(self, cfg: RiskConfig = DEFAULT_CONFIG, include_leakage: bool = True,
                 top_k: int | None = None):
        self.cfg, self.include_leakage, self.top_k = cfg, include_leakage, top_k

    def fit(self, df: DataFrame, features: list[str], y: str = "y") -> FeatureModel:
        return fit_selectors([self], df, features, y)[0]


def fit_selectors(selectors: list[FeatureSelector], df: DataFrame, features: list[str],
                  y: str = "y") -> list[FeatureModel]:
    """Fit several selectors on the same training rows: medians and MI of a column don't depend on the others,
    so they are computed once."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    allowed = [[f for f in features if s.include_leakage or f != s.cfg.leakage] for s in selectors]  # B8
    every = [f for f in features if any(f in a for a in allowed)]
    # one number per column comes back to the driver
    medians = refine.medians(df, every, y)
    mi_scores = refine.label_information(df, every, medians, y)
    mi = information_table(spark, mi_scores)

    def model(s: FeatureSelector, feats: list[str]) -> FeatureModel:
        sel = select_features(spark, mi.where(F.col("feature").isin(feats)), feats, s.cfg, s.include_leakage, s.top_k)
        chosen = [r["feature"] for r in sel.orderBy("rank").collect()]
        return FeatureModel(chosen, {f: medians.get(f, 0.0) for f in chosen},
                            {f: v for f, v in mi_scores.items() if f in feats},
                            s.cfg.leakage in features, s.include_leakage)
    with ThreadPoolExecutor(2) as pool:
        return list(pool.map(inheritable_thread_target(spark)(model), selectors, allowed))
