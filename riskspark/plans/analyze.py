"""Account analysis (X4 rule part, F15, B15-B20, K1) as one projection chain.

``assess`` is the same transform for one account, a batch or a stream: it
uses only projections and literal lookups, so it never shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskspark.config import DEFAULT_CONFIG, FLAG_THRESHOLD, TOP_CASES, RiskConfig
from riskspark.functions.columns import py_round
from riskspark.functions.scoring import (
    indicator_array,
    recommended_action,
    score_from_proba,
    severity,
    with_indicators,
)
from riskspark.operators.rules import classification_struct, classify


def assess(df: DataFrame, prob_col: str = "p", threshold=0.5,
           cfg: RiskConfig = DEFAULT_CONFIG) -> DataFrame:
    """F15 + T1-T10: risk_score, risk_probability, severity, action, indicators, typology."""
    x = with_indicators(df, cfg)
    x = x.select("*", score_from_proba(F.col(prob_col), threshold).alias("risk_score"),
                 py_round(F.col(prob_col), 6).alias("risk_probability"))
    x = x.select("*", severity(F.col("risk_score")).alias("severity"))
    x = x.select("*", recommended_action(F.col("severity")).alias("recommended_action"))
    return classify(x, "risk_score", cfg)


def registry_flag(cfg: RiskConfig = DEFAULT_CONFIG) -> Column:
    """Leak column present and >= 1 (NULL -> false)."""
    return F.coalesce(F.col(f"x_{cfg.leakage}") >= 1, F.lit(False))


def account_profile(cfg: RiskConfig = DEFAULT_CONFIG) -> Column:
    """STRUCT<occupation, account_standing, age, account_tenure>."""
    return F.struct(
        F.col("occupation").alias("occupation"),
        F.col("standing").alias("account_standing"),
        F.col(f"x_{cfg.age_col}").alias("age"),
        F.col(f"x_{cfg.tenure_col}").alias("account_tenure"),
    )


def row_content(df: DataFrame) -> Column:
    """The whole row as JSON text, which identifies a row without a key."""
    return F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))


def case_id(key: Column, content: Column | None = None, prefix: str = "BOI-", width: int = 5) -> Column:
    """Deterministic case id from the account key (never from row position); without
    a key ``ACC-`` and a digest of the row's ``content``."""
    k = key.cast(T.StringType())
    hashed = F.upper(F.substring(F.sha2(F.coalesce(content if content is not None else F.lit(""), F.lit("")), 256), 1, 8))
    return F.when(key.isNull(), F.concat(F.lit("ACC-"), hashed)) \
        .otherwise(F.concat(F.lit(prefix), F.when(F.length(k) >= width, k)  # lpad would truncate
                            .otherwise(F.lpad(k, width, "0"))))


def analysis_records(assessed: DataFrame, cfg: RiskConfig = DEFAULT_CONFIG,
                     model_used: str = "B") -> DataFrame:
    """Nested ``AccountAnalysis`` rows (one per account) from ``assess`` output."""
    extra = []
    if "shap_values" in assessed.columns:
        extra.append(F.col("shap_values"))
    else:
        extra.append(F.lit(None).cast(
            "array<struct<feature:string,raw_feature:string,shap_value:double,"
            "direction:string,feature_value:double>>").alias("shap_values"))
    return assessed.select(
        F.col(cfg.key).alias("account_id"),
        case_id(F.col(cfg.key), row_content(assessed)).alias("case_id"),
        "risk_score", "risk_probability", "severity", "recommended_action",
        classification_struct().alias("classification"),
        indicator_array(cfg).alias("behavioural_indicators"),
        account_profile(cfg).alias("account_profile"),
        registry_flag(cfg).alias("f3912_flag"),
        F.lit(model_used).alias("model_used"),
        *extra,
    )


def flagged(df: DataFrame, threshold: float = FLAG_THRESHOLD) -> DataFrame:
    """Accounts whose (rounded) score reaches the flag threshold."""
    return df.filter(F.col("risk_score") >= F.lit(threshold))


def top_cases(df: DataFrame, key: str = "account_id", n: int = TOP_CASES,
              threshold: float = FLAG_THRESHOLD) -> DataFrame:
    """K1: the n highest flagged scores, ties by key (plans TakeOrderedAndProject)."""
    return flagged(df, threshold).orderBy(F.col("risk_score").desc(), F.col(key).asc()).limit(n)


def validate(df: DataFrame) -> DataFrame:
    """Rows of ``analysis_records`` output violating a range (score 0-100,
    probability / confidence / indicator values 0-1)."""
    bad = (~F.col("risk_score").between(0, 100)) | (~F.col("risk_probability").between(0, 1)) \
        | (~F.col("classification.confidence").between(0, 1)) \
        | F.exists("behavioural_indicators", lambda s: ~s["value"].between(0, 1))
    return df.filter(F.coalesce(bad, F.lit(True)))
