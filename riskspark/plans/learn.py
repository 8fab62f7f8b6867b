"""Model training and scoring.

``train_many`` is the reference recipe re-expressed on DataFrames: hash-based
stratified hold-out, feature selection fitted on training rows only, k-fold
out-of-fold predictions with SMOTE applied strictly inside each fold's training
part, F1-tuned threshold, and a fit on the whole (oversampled) training split.
The fits of all folds and models are one joint run of ``operators.boosting``: a
training row is prepared, stored and read once for all the fits that use it.
Intermediate frames are checkpointed to the shared folder, which keeps plans
short and survives lost executors.
"""

from __future__ import annotations

import json
import math
import time
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskspark.config import DEFAULT_CONFIG, RiskConfig
from riskspark.operators.boosting import BoostedTrees, BoostParams, Fit, boost, sigmoid
from riskspark.operators.clean import CleaningModel
from riskspark.operators.cumulative import ROWS_PER_BUCKET
from riskspark.operators.metrics import ranking_metrics, tune_threshold
from riskspark.operators.sampling import apply_folds, fold_cuts, stratified_split
from riskspark.operators.selection import FeatureModel, FeatureSelector, fit_selectors

DEFAULT_TREES = 300
#: Synthetic rows of a partition, where a draw makes more.
DRAW_ROWS = 100_000


@dataclass
class GBTParams:
    """The reference booster settings."""

    max_iter: int = DEFAULT_TREES
    max_depth: int = 4
    step_size: float = 0.05
    subsampling_rate: float = 0.8
    feature_subset: str = "0.8"
    min_instances_per_node: int = 1
    max_bins: int = 256
    seed: int = 42
    l2: float = 1.0

    def booster(self) -> BoostParams:
        return BoostParams(self.max_iter, self.max_depth, self.step_size, self.subsampling_rate,
                           float(self.feature_subset), float(self.min_instances_per_node), self.l2, self.max_bins,
                           self.seed)


def class_weight(df: DataFrame, y: str, cfg: RiskConfig) -> float:
    """Configured positive weight, else the measured legit/mule ratio."""
    if cfg.pos_weight is not None:
        return float(cfg.pos_weight)
    r = df.agg(F.count_if(F.col(y) == 0).alias("neg"), F.count_if(F.col(y) == 1).alias("pos")).first()
    return float(r["neg"]) / r["pos"] if r["pos"] else 1.0


def with_weight(df: DataFrame, y: str, w: float) -> DataFrame:
    return df.select("*", F.when(F.col(y) == 1, F.lit(w)).otherwise(F.lit(1.0)).alias("_w"))


def fit_gbt(df: DataFrame, features: list[str], y: str, params: GBTParams, weight: float) -> BoostedTrees:
    """One weighted fit on an already-imputed feature table."""
    rows = df.select(*[F.col(f"`{f}`").cast("double").alias(f) for f in features], F.col(y).cast("int").alias("y"),
                     F.lit(1).cast("long").alias("fits"), F.xxhash64(*[f"`{f}`" for f in features], y).alias("hash"))
    return boost(rows, features, [Fit(list(range(len(features))), weight)], params.booster())[0]


def predict_proba(model: BoostedTrees, df: DataFrame, out: str = "p") -> DataFrame:
    """Positive-class probability as a plain double column."""
    return df.select("*", model.probability(*[F.col(f"`{f}`").cast("double") for f in model.features]).alias(out))


def fold_probability(models: list[BoostedTrees], fold: F.Column) -> F.Column:
    """Positive-class probability by the model of the row's fold; the models share their features."""
    @F.pandas_udf("double")
    def score(folds: pd.Series, *values: pd.Series) -> pd.Series:
        x, of = np.column_stack([v.to_numpy(float) for v in values]), folds.to_numpy()
        margin = np.zeros(len(x))
        for k, model in enumerate(models):
            mine = np.flatnonzero(of == k)
            margin[mine] = model.margin(x[mine])
        return pd.Series(sigmoid(margin))
    return score(fold, *[F.col(f"`{f}`").cast("double") for f in models[0].features])


@dataclass
class TrainedModel:
    """D10 result: fitted cleaning + selection + booster + tuned threshold + summary.

    The whole bundle is saved and loaded together, so raw data of a batch, a single
    account or a stream is cleaned and scored by what the training rows taught.
    """

    name: str
    include_leakage: bool
    features: FeatureModel
    model: BoostedTrees
    threshold: float = 0.5
    cv_pr_auc: float = 0.0
    train_time_s: float = 0.0
    n_train: int = 0
    meta: dict = field(default_factory=dict)
    cleaner: CleaningModel | None = None

    def score_raw(self, raw: DataFrame, out: str = "p") -> DataFrame:
        """Clean raw accounts with the fitted cleaner and score them; row by row, so also on a stream."""
        if self.cleaner is None:
            raise ValueError(f"model {self.name} was trained on cleaned data and has no cleaner")
        return self.score(self.cleaner.transform(raw), out)

    def predict(self, df: DataFrame, key: str = "account_id", keep: tuple = ("y",)) -> DataFrame:
        """The same transform for one row or a whole table."""
        prepared = self.features.transform(df, keep=(key, *keep))
        return predict_proba(self.model, prepared)

    def score(self, df: DataFrame, out: str = "p") -> DataFrame:
        """``df`` with the model's probability; its own columns stay as they are (no join)."""
        own = [F.col(f"`{c}`").alias(f"_in_{c}") for c in df.columns]
        kept = df.select("*", *own)
        prepared = self.features.transform(kept, keep=tuple(f"_in_{c}" for c in df.columns))
        scored = predict_proba(self.model, prepared, out)
        return scored.select(*[F.col(f"`_in_{c}`").alias(c) for c in df.columns], out)

    def save(self, path: str, spark: SparkSession) -> None:
        """One JSON row for the trees, one for the rest."""
        spark.createDataFrame([(self.model.to_json(),)], "model string").coalesce(1) \
            .write.mode("overwrite").text(f"{path}/model")
        meta = {"name": self.name, "include_leakage": self.include_leakage,
                "features": self.features.to_json(), "threshold": self.threshold,
                "cv_pr_auc": self.cv_pr_auc, "train_time_s": self.train_time_s,
                "n_train": self.n_train, "meta": self.meta,
                "cleaner": asdict(self.cleaner) if self.cleaner else None}
        spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1) \
            .write.mode("overwrite").text(f"{path}/meta")

    @staticmethod
    def load(path: str, spark: SparkSession) -> TrainedModel:
        meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
        return TrainedModel(meta["name"], meta["include_leakage"],
                            FeatureModel.from_json(meta["features"]),
                            BoostedTrees.from_json(spark.read.text(f"{path}/model").first()[0]), meta["threshold"],
                            meta["cv_pr_auc"], meta["train_time_s"], meta["n_train"], meta["meta"],
                            CleaningModel(**meta["cleaner"]) if meta.get("cleaner") else None)


def load_models(path: str, spark: SparkSession) -> dict:
    """The models saved under ``path/A`` and ``path/B``, those that are there."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    found = {}
    for name in ("A", "B"):
        where = jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/{name}/meta/_SUCCESS")
        if where.getFileSystem(conf).exists(where):
            found[name] = TrainedModel.load(f"{path.rstrip('/')}/{name}", spark)
    return found


def choose_model(models: dict, name: str = "B") -> TrainedModel:
    """Model A or B; an error names the model that isn't loaded."""
    if not isinstance(models.get(name), TrainedModel):
        raise KeyError(f"model {name} is not loaded")
    return models[name]


def train_many(df: DataFrame, features: list[str], models: dict[str, bool], cfg: RiskConfig = DEFAULT_CONFIG,
               params: GBTParams | None = None, n_folds: int = 5, use_smote: bool = True, y: str = "y",
               top_k: int | None = None, split: DataFrame | None = None) -> tuple[dict, DataFrame]:
    """The trained bundles by name (``models``: name to whether the leak column is allowed) and the split
    frame (``is_test`` column). Each model has a fit per fold, on all other folds' rows, and one on all rows."""
    from riskspark.operators.smote import Draw, smote_draws
    from riskspark.session import ensure_checkpoint_dir

    params = params or GBTParams()
    spark, key, t0 = df.sparkSession, cfg.key, time.time()
    ensure_checkpoint_dir(spark)
    marks: dict = {}

    def mark(label):
        marks[label] = round(time.time() - t0, 2)

    if split is None:
        split = stratified_split(df, y, key, 0.2, cfg.seed).checkpoint()
    train = split.where(~F.col("is_test"))
    mark("split")
    # folds and class weight need keys and labels only: found while the selectors are fitted
    apart = inheritable_thread_target(spark)
    with ThreadPoolExecutor(2) as pool:
        borders = pool.submit(apart(lambda: fold_cuts(train, n_folds, y, key, cfg.seed + 1)))
        rows_of = pool.submit(apart(lambda: (class_weight(train, y, cfg), train.count())))
        chosen = fit_selectors([FeatureSelector(cfg, leak, top_k) for leak in models.values()], train, features, y)
        (weight, n_train), borders = rows_of.result(), borders.result()
    mark("selection")
    # a column's median is the same in all models, so one prepared table serves them all
    union = list(dict.fromkeys(f for fm in chosen for f in fm.selected))
    medians = {f: m for fm in chosen for f, m in fm.medians.items()}
    prepared = apply_folds(FeatureModel(union, medians).transform(train, keep=(key, y)), borders, n_folds, y, key,
                           cfg.seed + 1).checkpoint()
    mark("folds")

    # fit number: model * (folds + 1) + the fold it leaves out (or ``n_folds``: none)
    numbers = [(m, fold) for m in range(len(chosen)) for fold in [*range(n_folds), n_folds]]
    masks = [sum(1 << k for k, (_, fold) in enumerate(numbers) if fold != own) for own in range(n_folds)]
    label = F.col(y).cast("int").alias("y")
    real = prepared.select(*union, label, F.element_at(F.array(*[F.lit(m).cast("long") for m in masks]),
                                                      F.col("fold") + 1).alias("fits"),
                           F.xxhash64(F.col(key).cast("string"), F.lit(params.seed)).alias("hash"))

    def synthetic() -> DataFrame | None:
        draws = [Draw(F.col("fold") != fold, chosen[m].selected,
                      cfg.seed if fold == n_folds else cfg.seed + 10 + fold) for m, fold in numbers]
        made = smote_draws(prepared, draws, y, key)
        if made is None:
            return None

        def by_model(column) -> F.Column:
            own = [F.when(F.col("draw").between(m * (n_folds + 1), m * (n_folds + 1) + n_folds), column(fm.selected))
                   for m, fm in enumerate(chosen)]
            return F.coalesce(*own)
        columns = [by_model(lambda sel, f=f: F.col("svec")[sel.index(f)] if f in sel
                            else F.lit(None).cast("double")).alias(f) for f in union]
        hashed = by_model(lambda sel: F.xxhash64(*[F.col("svec")[i] for i in range(len(sel))], "draw"))
        made = made.select(*columns, F.lit(1).cast("int").alias("y"),
                           F.element_at(F.array(*[F.lit(1 << k).cast("long") for k in range(len(numbers))]),
                                        F.col("draw") + 1).alias("fits"), hashed.alias("hash"), "draw")
        # a draw makes fewer rows than it has, so partitions of a draw hold about ``DRAW_ROWS`` at most
        share = max(1, math.ceil(n_train / DRAW_ROWS))
        place = F.col("draw") * share + F.pmod(F.col("hash"), F.lit(share)).cast("int")
        return made.repartitionById(share * len(numbers), place).drop("draw").checkpoint()

    rows, made = real, synthetic() if use_smote else None
    if made is not None:
        rows = rows.unionByName(made)
    mark("smote")
    fits = [Fit([union.index(f) for f in chosen[m].selected], weight) for m, _ in numbers]
    grown = boost(rows, union, fits, params.booster())
    mark("boosting")

    # out of fold: each row by the fits that left its fold out, all models in one pass
    held = [fold_probability([grown[numbers.index((m, fold))] for fold in range(n_folds)], F.col("fold"))
            for m in range(len(chosen))]
    oof = prepared.select(F.col(y), F.array(*held).alias("_p")).select(
        y, F.posexplode("_p").alias("model", "p")).checkpoint()
    n_buckets = math.ceil(n_train / ROWS_PER_BUCKET) or 1
    with ThreadPoolExecutor(2) as pool:
        best, ranked = pool.map(inheritable_thread_target(spark)(
            lambda metric: {r["model"]: r for r in metric(oof, y, "p", ["model"], n_buckets).collect()}),
            (tune_threshold, ranking_metrics))  # a row per model
    scores = []
    for m in range(len(chosen)):
        found = m in best and best[m]["threshold"] is not None
        pr_auc = ranked[m]["pr_auc"] if m in ranked else None
        scores.append((float(pr_auc or 0.0), float(best[m]["threshold"]) if found else 0.5))
    mark("oof_metrics")

    out = {}
    for m, ((name, leak), fm, (pr_auc, threshold)) in enumerate(zip(models.items(), chosen, scores)):
        out[name] = TrainedModel(name, leak, fm, grown[numbers.index((m, n_folds))], threshold, pr_auc,
                                 round(time.time() - t0, 2), n_train,
                                 {"pos_weight": weight, "n_features": len(fm.selected), "trees": params.max_iter,
                                  "phase_seconds": marks})
    return out, split


def train_one(df: DataFrame, features: list[str], include_leakage: bool, name: str, cfg: RiskConfig = DEFAULT_CONFIG,
              params: GBTParams | None = None, **kw) -> tuple[TrainedModel, DataFrame]:
    """One trained bundle and the split frame."""
    out, split = train_many(df, features, {name: include_leakage}, cfg, params, **kw)
    return out[name], split


def train_models(df: DataFrame, features: list[str], cfg: RiskConfig = DEFAULT_CONFIG,
                 params: GBTParams | None = None, **kw) -> dict:
    """Model A (leak column allowed) and model B (leak column excluded)."""
    if "y" not in df.columns:
        raise ValueError("training needs a label column 'y'")
    out, split = train_many(df, features, {"A": True, "B": False}, cfg, params, **kw)
    return {**out, "split": split}


def training_summary(spark: SparkSession, models: dict) -> DataFrame:
    """D11 summary: one row per model."""
    rows = [(k, m.include_leakage, m.cv_pr_auc, m.threshold, len(m.features.selected),
             m.n_train, m.train_time_s) for k, m in models.items() if isinstance(m, TrainedModel)]
    return spark.createDataFrame(rows, "model string, includes_leakage boolean, cv_pr_auc double, "
                                       "threshold double, n_features int, n_train long, train_time_s double")
