"""Typology rule engine (T1-T10) as column expressions — no UDF.

Rules are config rows of SQL predicates. A typology's confidence is the
matched weight over the total weight; the best typology wins with a strict
``>`` scanned in rule order, so the first rule wins ties.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskspark.config import (
    DEFAULT_CONFIG,
    FALLBACK_CONFIDENCE,
    FALLBACK_MATCH_LABEL,
    FALLBACK_TYPOLOGY,
    LEGITIMATE_DESCRIPTION,
    MIN_RISK_FOR_TYPOLOGY,
    TYPOLOGY_DESCRIPTIONS,
    RiskConfig,
)
from riskspark.functions.columns import map_lookup

_FEATURE_REF = re.compile(r"\b(F\d+)\b")


def predicate(expr_text: str) -> Column:
    """A rule predicate over ``ind_*`` and the NULL-safe ``x_F*`` inputs; NULL -> false."""
    return F.coalesce(F.expr(_FEATURE_REF.sub(r"x_\1", expr_text)), F.lit(False))


def rule_confidences(cfg: RiskConfig = DEFAULT_CONFIG) -> dict:
    """Per typology: matched weight / total weight (summed left to right)."""
    out = {}
    for typ, preds in cfg.rules:
        total = 0.0
        for _, _, w in preds:
            total += w
        matched = F.lit(0.0)
        for _, text, w in preds:
            matched = matched + F.when(predicate(text), F.lit(w)).otherwise(F.lit(0.0))
        out[typ] = matched / F.lit(total) if total else F.lit(0.0)
    return out


def _matched_labels(preds) -> Column:
    arr = F.array(*[F.when(predicate(text), F.lit(label)) for label, text, _ in preds])
    return F.filter(arr, lambda x: x.isNotNull())


def classify(df: DataFrame, score_col: str = "risk_score",
             cfg: RiskConfig = DEFAULT_CONFIG, keep_rule_scores: bool = False) -> DataFrame:
    """Add ``typology, rule_confidence, confidence, matched_indicators,
    typology_description`` (expects ``with_indicators`` columns and a score)."""
    confs = rule_confidences(cfg)
    names = [typ for typ, _ in cfg.rules]
    conf_cols = {typ: f"conf_{typ}" for typ in names}
    staged = df.select("*", *[confs[t].alias(conf_cols[t]) for t in names])
    best = F.greatest(*[F.col(conf_cols[t]) for t in names]) if len(names) > 1 \
        else F.col(conf_cols[names[0]])

    winner = None
    labels = None
    for typ, preds in cfg.rules:
        cond = F.col(conf_cols[typ]) == best
        winner = F.when(cond, F.lit(typ)) if winner is None else winner.when(cond, F.lit(typ))
        ml = _matched_labels(preds)
        labels = F.when(cond, ml) if labels is None else labels.when(cond, ml)

    score = F.col(score_col)
    low = score < F.lit(MIN_RISK_FOR_TYPOLOGY)
    nothing = best <= F.lit(0.0)
    typology = (F.when(low, F.lit(None).cast(T.StringType()))
                .when(nothing, F.lit(FALLBACK_TYPOLOGY)).otherwise(winner))
    rule_conf = (F.when(low, F.lit(0.0)).when(nothing, F.lit(FALLBACK_CONFIDENCE))
                 .otherwise(best))
    matched = (F.when(low, F.array().cast("array<string>"))
               .when(nothing, F.array(F.lit(FALLBACK_MATCH_LABEL)))
               .otherwise(labels))
    blended = F.bround(F.least(F.lit(0.99), F.lit(0.6) * F.col("rule_confidence")
                               + F.lit(0.4) * (score / F.lit(100.0))), 2)
    out = staged.select(
        "*",
        typology.alias("typology"),
        rule_conf.alias("rule_confidence"),
        matched.alias("matched_indicators"),
    )
    out = out.select(
        "*",
        F.when(low, F.lit(0.0)).otherwise(blended).alias("confidence"),
        F.when(F.col("typology").isNull(), F.lit(LEGITIMATE_DESCRIPTION))
        .otherwise(map_lookup(TYPOLOGY_DESCRIPTIONS, F.col("typology"))).alias("typology_description"),
    )
    if not keep_rule_scores:
        out = out.drop(*conf_cols.values())
    return out


def classification_struct() -> Column:
    """``MuleClassification`` as a nested struct over ``classify`` output."""
    return F.struct(
        F.col("typology"), F.col("confidence"), F.col("matched_indicators"),
        F.col("typology_description"))
