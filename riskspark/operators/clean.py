"""Loading and cleaning an account table.

``Cleaner.fit`` learns, on training rows only, which columns are all-NULL and
which get a ``_missing`` twin; ``CleaningModel.transform`` replays exactly that
schema on any later data (batch, one row or a stream), so train and serve
cannot drift. Fitting counts columns in chunks; transforming is a single
``select`` (never a ``withColumn`` loop).
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskspark.config import DEFAULT_CONFIG, OCCUPATION_ORDER, STANDING_ORDER, RiskConfig
from riskspark.functions.columns import map_lookup, null_token, num, strip_ws
from riskspark.operators.profile import non_null_counts

MISSING_SUFFIX = "_missing"


def read_accounts_csv(spark: SparkSession, path: str) -> DataFrame:
    """A1: CSV with a header, every column read as text (no inference pass), NULL tokens normalised."""
    df = spark.read.option("header", True).option("mode", "PERMISSIVE").csv(path)
    return normalize_null_tokens(df)


def normalize_null_tokens(df: DataFrame) -> DataFrame:
    """pandas' default NA tokens -> NULL on every text column."""
    cols = [null_token(F.col(f"`{c}`")).alias(c) if isinstance(t, T.StringType) else F.col(f"`{c}`")
            for c, t in zip(df.columns, [f.dataType for f in df.schema.fields])]
    return df.select(*cols)


def drop_index_column(df: DataFrame, cfg: RiskConfig = DEFAULT_CONFIG) -> DataFrame:
    """A2: drop the saved index column (``Unnamed: 0``, a first ``Unnamed*`` or blank ``_c0``)."""
    if cfg.index_column in df.columns:
        return df.drop(cfg.index_column)
    first = df.columns[0] if df.columns else None
    if first is not None and (first.startswith("Unnamed") or first == "_c0"):
        return df.drop(first)
    return df


def target_column(c: Column) -> Column:
    """B1: numeric target, unparseable/NULL -> 0, truncated to int."""
    return F.coalesce(num(c), F.lit(0.0)).cast(T.IntegerType())


def encode_standing(c: Column) -> Column:
    """Strip, case-sensitive label -> 0..6; unknown -> NULL."""
    return map_lookup({v: float(i) for i, v in enumerate(STANDING_ORDER)}, strip_ws(c.cast("string")))


def encode_occupation(c: Column) -> Column:
    """Strip, lower, label -> 0..6; unknown -> NULL."""
    return map_lookup({v: float(i) for i, v in enumerate(OCCUPATION_ORDER)},
                      F.lower(strip_ws(c.cast("string"))))


def coerced_columns(df: DataFrame, features: list[str], cfg: RiskConfig = DEFAULT_CONFIG) -> list[Column]:
    """Encoded categoricals and numeric coercion (NaN -> NULL), as DOUBLE."""
    out = []
    for c in features:
        if c not in df.columns:
            out.append(F.lit(None).cast(T.DoubleType()).alias(c))
            continue
        ref = F.col(f"`{c}`")
        if c == cfg.standing_col and not isinstance(df.schema[c].dataType, T.NumericType):
            out.append(encode_standing(ref).alias(c))
        elif c == cfg.occupation_col and not isinstance(df.schema[c].dataType, T.NumericType):
            out.append(encode_occupation(ref).alias(c))
        else:
            out.append(num(ref, df.schema[c].dataType).alias(c))
    return out


@dataclass
class CleaningModel:
    """Fitted cleaning state: replayed identically on any data."""

    key: str | None
    target: str | None
    features: list[str]
    dropped_null_columns: list[str]
    missing_columns: list[str]
    n_rows: int = 0
    null_fractions: dict = field(default_factory=dict)
    #: ``sampling.split_cuts`` of the rows that fitting held out.
    held_out: list = field(default_factory=list)

    @property
    def output_features(self) -> list[str]:
        return self.features + [f"{c}{MISSING_SUFFIX}" for c in self.missing_columns]

    def transform(self, df: DataFrame, cfg: RiskConfig = DEFAULT_CONFIG) -> DataFrame:
        """Coerce/encode the learned features (absent -> NULL), add ``_missing`` flags, keep key and y."""
        df = drop_index_column(df, cfg)
        keep = []
        if self.key and self.key in df.columns:
            keep.append(F.col(self.key))
        if self.target and self.target in df.columns:
            keep.append(target_column(F.col(self.target)).alias("y"))
        coerced = df.select(*keep, *coerced_columns(df, self.features, cfg))
        flags = [F.col(f"`{c}`").isNull().cast(T.IntegerType()).alias(f"{c}{MISSING_SUFFIX}")
                 for c in self.missing_columns]
        return coerced.select("*", *flags)

    def split(self, clean: DataFrame, cfg: RiskConfig = DEFAULT_CONFIG) -> DataFrame | None:
        """The cleaned rows with ``is_test`` as fitting held them out (what ``stratified_split`` gives for the table
        that was fitted, without another pass); None if it held out none."""
        from riskspark.operators.sampling import apply_split
        return apply_split(clean, self.held_out, "y", self.key, cfg.seed) if self.held_out else None

    def metadata(self, spark: SparkSession) -> DataFrame:
        """One summary row of the fitted cleaning."""
        return spark.createDataFrame(
            [(self.n_rows, len(self.output_features), len(self.dropped_null_columns),
              len(self.missing_columns), self.dropped_null_columns, self.missing_columns)],
            "n_rows long, n_features int, n_dropped int, n_missing_indicators int, "
            "dropped_null_columns array<string>, missing_indicator_columns array<string>")

    def save(self, path: str, spark: SparkSession) -> None:
        spark.createDataFrame([(json.dumps(asdict(self)),)], "state string") \
            .coalesce(1).write.mode("overwrite").text(path)

    @staticmethod
    def load(path: str, spark: SparkSession) -> CleaningModel:
        return CleaningModel(**json.loads(spark.read.text(path).first()[0]))


class Cleaner:
    """B2 + B5 + B6 estimator: learn dropped columns and ``_missing`` twins on training rows."""

    def __init__(self, cfg: RiskConfig = DEFAULT_CONFIG, threshold: float | None = None, chunk: int = 200):
        self.cfg = cfg
        self.chunk = chunk
        self.threshold = cfg.missing_threshold if threshold is None else threshold

    def fit_on_training_rows(self, raw: DataFrame) -> CleaningModel:
        """Fit without the rows that ``stratified_split`` holds out (all rows if there is no target)."""
        from riskspark.operators.sampling import apply_split, split_cuts
        cfg = self.cfg
        if cfg.target not in raw.columns or cfg.key not in raw.columns:
            return self.fit(raw)
        rows = raw.withColumn("_split_y", target_column(F.col(cfg.target)))
        cuts = split_cuts(rows, "_split_y", cfg.key, 0.2, cfg.seed)
        split = apply_split(rows, cuts, "_split_y", cfg.key, cfg.seed)
        return replace(self.fit(split.where(~F.col("is_test")).drop("_split_y", "is_test")), held_out=cuts)

    def fit(self, df: DataFrame) -> CleaningModel:
        cfg = self.cfg
        df = drop_index_column(df, cfg)
        key = cfg.key if cfg.key in df.columns else None
        target = cfg.target if cfg.target in df.columns else None
        features = [c for c in df.columns if c not in (key, target, "y")]
        # chunks of columns keep the coercion expressions small on wide tables; one row per column comes back
        counts = {r["feature"]: r for lo in range(0, len(features), self.chunk)
                  for r in non_null_counts(df.select(*coerced_columns(df, features[lo:lo + self.chunk], cfg)),
                                           features[lo:lo + self.chunk], self.chunk).collect()}
        n = int(next(iter(counts.values()))["n_rows"]) if counts else df.count()
        frac = {c: (1.0 - counts[c]["n_non_null"] / n) if n else 1.0 for c in features}
        dropped = [c for c in features if frac[c] >= 1.0]
        kept = [c for c in features if c not in dropped]
        missing = [c for c in kept if frac[c] > self.threshold]
        return CleaningModel(key, target, kept, dropped, missing, n,
                             {c: frac[c] for c in features})
