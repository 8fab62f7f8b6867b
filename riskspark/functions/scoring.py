"""Risk score, severity, category decoding and behavioural indicators.

All functions build Column expressions, so scoring one account or a billion
accounts is the same projection inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskspark.config import (
    DEFAULT_ACTION,
    DEFAULT_CONFIG,
    INDICATORS,
    OCCUPATION_DEFAULT_RATE,
    OCCUPATION_ORDER,
    OCCUPATION_RATE_SCALE,
    SEVERITY_BANDS,
    STANDING_DEFAULT_RATE,
    STANDING_ORDER,
    STANDING_RATE_SCALE,
    RiskConfig,
)
from riskspark.functions.columns import NUMERIC_PATTERN, clip01, map_lookup, num_col, py_round, strip_ws

_LO_THR = 1e-6


def score_from_proba(p: Column, thr) -> Column:
    """F1: threshold-anchored 0-100 score; ``thr`` maps to 60, 1.0 to 100; 1 dp."""
    t = thr if isinstance(thr, Column) else F.lit(float(thr))
    t = F.least(F.greatest(t, F.lit(_LO_THR)), F.lit(1 - _LO_THR))
    raw = F.when(p >= t, F.lit(60.0) + F.lit(40.0) * (p - t) / (F.lit(1.0) - t)) \
        .otherwise(F.lit(60.0) * (p / t))
    clamped = F.greatest(F.lit(0.0), F.least(F.lit(100.0), raw))
    return F.bround(clamped, 1)


def severity(score: Column) -> Column:
    """F2: half-open bands >=80, >=60, >=40, else LOW (so 79.5 is HIGH)."""
    expr = None
    for lo, name, _ in SEVERITY_BANDS[:-1]:
        expr = (F.when(score >= lo, F.lit(name)) if expr is None
                else expr.when(score >= lo, F.lit(name)))
    return expr.otherwise(F.lit(SEVERITY_BANDS[-1][1]))


def recommended_action(sev: Column) -> Column:
    """action text by severity, default the LOW action."""
    return map_lookup({name: act for _, name, act in SEVERITY_BANDS}, sev, DEFAULT_ACTION)


def _decode(raw: Column, order: tuple, case_fn) -> Column:
    s = strip_ws(raw.cast(T.StringType()))
    label = case_fn(s)
    as_label = F.when(label.isin(*order), label)
    code = F.when(s.rlike(NUMERIC_PATTERN), s.try_cast(T.DoubleType()))
    # int(float(v)) truncates toward zero; then 0 <= i < len(order)
    idx = F.when(~F.isnan(code) & (F.abs(code) < 1e9), code.cast(T.IntegerType()))
    arr = F.array(*[F.lit(x) for x in order])
    by_code = F.when((idx >= 0) & (idx < len(order)), F.element_at(arr, idx + 1))
    return F.coalesce(as_label, by_code)


def decode_standing(raw: Column) -> Column:
    """standing label from a raw label (trim, upper) or its code 0-6."""
    return _decode(raw, STANDING_ORDER, F.upper)


def decode_occupation(raw: Column) -> Column:
    """occupation label from a raw label (trim, lower) or its code 0-6."""
    return _decode(raw, OCCUPATION_ORDER, F.lower)


def _col_or_null(df: DataFrame, name: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(T.StringType())


def indicator_inputs(df: DataFrame, cfg: RiskConfig = DEFAULT_CONFIG) -> DataFrame:
    """Add the NULL-safe numeric inputs and decoded categories the indicators need.

    Columns added: ``x_<code>`` doubles and ``occupation`` / ``standing`` labels.
    """
    codes = {cfg.tenure_col, cfg.activity_col, cfg.legitimacy_col, cfg.activity_count_col,
             cfg.high_risk_col, cfg.age_col, cfg.leakage, "F1692", "F527", "F531"}
    cols = [num_col(df, c).alias(f"x_{c}") for c in sorted(codes)]
    cols.append(decode_occupation(_col_or_null(df, cfg.occupation_col)).alias("occupation"))
    cols.append(decode_standing(_col_or_null(df, cfg.standing_col)).alias("standing"))
    return df.select("*", *cols)


def indicator_values(cfg: RiskConfig = DEFAULT_CONFIG, rounded: bool = True) -> dict:
    """F6-F13 as Columns over ``indicator_inputs`` output, keyed by indicator key."""
    tenure = F.col(f"x_{cfg.tenure_col}")
    act = F.col(f"x_{cfg.activity_col}")
    legit = F.col(f"x_{cfg.legitimacy_col}")
    cnt = F.col(f"x_{cfg.activity_count_col}")
    hr = F.col(f"x_{cfg.high_risk_col}")
    occ_rate = occupation_rate(cfg)
    st_rate = standing_rate(cfg)
    raw = {
        "dormancy_signal": F.when(tenure.isNull(), F.lit(0.5))
        .otherwise(clip01((F.lit(80.0) - tenure) / F.lit(80.0))),
        "activity_flag": F.when(act.isNull(), F.lit(0.5)).otherwise(clip01(act)),
        "legitimacy_gap": F.when(legit.isNull(), F.lit(0.6))
        .when(legit == 0, F.lit(1.0)).otherwise(F.lit(0.2)),
        "missingness_pattern": F.when(cnt.isNull(), F.lit(0.85)).otherwise(F.lit(0.25)),
        "high_risk_flag": F.when(hr.isNull(), F.lit(0.4))
        .when(hr >= 1, F.lit(1.0)).otherwise(F.lit(0.1)),
        "risk_score": F.when(act.isNull(), F.lit(0.5)).otherwise(clip01(act)),
        "occupation_risk": clip01(occ_rate / F.lit(OCCUPATION_RATE_SCALE)),
        "account_standing": clip01(st_rate / F.lit(STANDING_RATE_SCALE)),
    }
    if rounded:
        raw = {k: py_round(v, 3) for k, v in raw.items()}
    return raw


def occupation_rate(cfg: RiskConfig = DEFAULT_CONFIG) -> Column:
    return map_lookup(cfg.occupation_rates, F.col("occupation"), OCCUPATION_DEFAULT_RATE)


def standing_rate(cfg: RiskConfig = DEFAULT_CONFIG) -> Column:
    return map_lookup(cfg.standing_rates, F.col("standing"), STANDING_DEFAULT_RATE)


def indicator_array(cfg: RiskConfig = DEFAULT_CONFIG) -> Column:
    """ARRAY<STRUCT<key,label,value,raw_value,source_feature,description>>.

    Expects ``ind_<key>`` columns (from ``indicator_values``) and ``indicator_inputs``.
    """
    raw_values = {
        "dormancy_signal": F.col(f"x_{cfg.tenure_col}"),
        "activity_flag": F.col(f"x_{cfg.activity_col}"),
        "legitimacy_gap": F.col(f"x_{cfg.legitimacy_col}"),
        "missingness_pattern": F.col(f"x_{cfg.activity_count_col}"),
        "high_risk_flag": F.col(f"x_{cfg.high_risk_col}"),
        "risk_score": F.col(f"x_{cfg.activity_col}"),
        "occupation_risk": F.lit(None).cast(T.DoubleType()),
        "account_standing": F.lit(None).cast(T.DoubleType()),
    }
    descriptions = {}
    for key, _label, _src, text in INDICATORS:
        if key == "occupation_risk":
            descriptions[key] = F.format_string(
                text, F.coalesce(F.col("occupation"), F.lit("unknown")), occupation_rate(cfg) * 100)
        elif key == "account_standing":
            descriptions[key] = F.format_string(
                text, F.coalesce(F.col("standing"), F.lit("unknown")), standing_rate(cfg) * 100)
        else:
            descriptions[key] = F.lit(text)
    return F.array(*[
        F.struct(
            F.lit(key).alias("key"),
            F.lit(label).alias("label"),
            F.col(f"ind_{key}").alias("value"),
            raw_values[key].alias("raw_value"),
            F.lit(src).alias("source_feature"),
            descriptions[key].alias("description"),
        )
        for key, label, src, _ in INDICATORS
    ])


def with_indicators(df: DataFrame, cfg: RiskConfig = DEFAULT_CONFIG) -> DataFrame:
    """``indicator_inputs`` + one ``ind_<key>`` column per indicator (3 dp, as Python rounds)."""
    base = indicator_inputs(df, cfg)
    vals = indicator_values(cfg)
    return base.select("*", *[v.alias(f"ind_{k}") for k, v in vals.items()])
