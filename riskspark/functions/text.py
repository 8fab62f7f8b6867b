"""Text helpers: labels, reasoning-tag stripping."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskspark.config import DEFAULT_CONFIG, RiskConfig
from riskspark.functions.columns import map_lookup, strip_ws


def feature_label(code: Column, cfg: RiskConfig = DEFAULT_CONFIG) -> Column:
    """Human label for a feature code, else ``Feature <code>``."""
    return F.coalesce(map_lookup(cfg.feature_names, code), F.concat(F.lit("Feature "), code))


def hint_meaning(code: Column, cfg: RiskConfig = DEFAULT_CONFIG) -> Column:
    """Decoded meaning of a hint feature, same fallback."""
    return F.coalesce(map_lookup(cfg.hint_meanings, code), F.concat(F.lit("Feature "), code))


def strip_reasoning(text: Column) -> Column:
    """drop ``<think>...</think>`` blocks (any case, across lines), then strip."""
    return strip_ws(F.regexp_replace(text, r"(?is)<think>.*?</think>", ""))
