"""Independent DuckDB SQL for every checked query (the correctness oracle).

Written directly from the operator semantics, not generated from the Spark
plans. Literals are cast to DOUBLE so DuckDB does not fall back to DECIMAL
arithmetic. Indicators and probabilities are rounded by ``printf``, which rounds
the binary value.
"""

from __future__ import annotations

from riskspark.config import (
    INDICATORS,
    OCCUPATION_MULE_RATE,
    OCCUPATION_ORDER,
    SEVERITY_BANDS,
    STANDING_MULE_RATE,
    STANDING_ORDER,
    TYPOLOGY_DESCRIPTIONS,
    TYPOLOGY_RULES,
)


def d(x) -> str:
    return f"CAST({float(x)!r} AS DOUBLE)"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


ACCOUNTS = f"""
WITH o AS (
  SELECT o_custkey,
         count(*) AS n_orders,
         count_if(o_orderpriority IN ('1-URGENT', '2-HIGH')) AS n_urgent,
         min(o_orderdate) AS first_order,
         max(o_orderdate) AS last_order,
         arg_max(o_orderstatus, o_orderkey) AS last_status,
         count_if(o_orderdate > TIMESTAMP '2000-08-01 00:00:00') AS n_recent
  FROM orders GROUP BY o_custkey),
l AS (
  SELECT o.o_custkey,
         count(*) AS n_lines,
         count(DISTINCT li.l_suppkey) AS n_supp,
         count(DISTINCT li.l_partkey) AS n_part,
         sum(li.l_extendedprice) AS ext_total,
         sum(CASE WHEN li.l_returnflag = 'R' THEN li.l_extendedprice ELSE {d(0)} END) AS ext_returned
  FROM lineitem li JOIN orders o ON li.l_orderkey = o.o_orderkey
  GROUP BY o.o_custkey),
base AS (
  SELECT c.c_custkey AS account_id,
    CAST(o.n_urgent AS DOUBLE) / o.n_orders AS F115,
    CAST(floor(date_diff('day', CAST(o.first_order AS DATE), DATE '2001-08-01') / {d(30)}) AS DOUBLE) AS F2956,
    CASE WHEN c.c_acctbal < 0 THEN {d(1)} ELSE {d(0)} END AS F670,
    CASE WHEN o.last_status IS NULL THEN CAST(NULL AS DOUBLE)
         WHEN o.last_status = 'F' THEN {d(0)} ELSE {d(1)} END AS F2082,
    CAST(nullif(o.n_recent, 0) AS DOUBLE) AS F3043,
    CASE WHEN o.last_order IS NULL THEN NULL
         WHEN date_diff('day', CAST(o.last_order AS DATE), DATE '2001-08-01') <= 7 THEN 'L7D'
         WHEN date_diff('day', CAST(o.last_order AS DATE), DATE '2001-08-01') <= 14 THEN 'L14D'
         WHEN date_diff('day', CAST(o.last_order AS DATE), DATE '2001-08-01') <= 31 THEN 'L31D'
         WHEN date_diff('day', CAST(o.last_order AS DATE), DATE '2001-08-01') <= 90 THEN 'L90D'
         WHEN date_diff('day', CAST(o.last_order AS DATE), DATE '2001-08-01') <= 180 THEN 'L180D'
         WHEN date_diff('day', CAST(o.last_order AS DATE), DATE '2001-08-01') <= 365 THEN 'L365D'
         ELSE 'G365D' END AS F3889,
    CASE c.c_mktsegment WHEN 'AUTOMOBILE' THEN ' SelfEmployed' WHEN 'BUILDING' THEN 'Salaried '
         WHEN 'FURNITURE' THEN 'student' WHEN 'HOUSEHOLD' THEN 'housewife'
         WHEN 'MACHINERY' THEN 'Agriculture' END AS F3891,
    CAST(18 + c.c_custkey % 60 AS DOUBLE) AS F3894,
    CAST(l.n_supp AS DOUBLE) / l.n_lines AS F527,
    CAST(l.n_part AS DOUBLE) / l.n_lines AS F531,
    l.ext_returned / l.ext_total AS F1692,
    c.c_acctbal, c.c_name
  FROM customer c LEFT JOIN o ON o.o_custkey = c.c_custkey LEFT JOIN l ON l.o_custkey = c.c_custkey)
SELECT account_id, F115, F2956, F670, F2082, F3043, F3889, F3891, F3894, F527, F531, F1692,
  CAST(CASE WHEN c_acctbal < 0 AND F115 >= 0.4 THEN 1 ELSE 0 END AS INTEGER) AS F3924,
  CASE WHEN c_acctbal < 0 AND F115 >= 0.4 AND account_id % 20 <> 0 THEN {d(1)} ELSE {d(0)} END AS F3912,
  CAST(NULL AS DOUBLE) AS F9001, c_name AS F9002
FROM base
"""

SCORED = f"""
SELECT *, {d(0.9)} * F3912 + {d(0.1)} * p AS p2 FROM (
  SELECT *, {d(0.35)} * coalesce(F115, {d(0.5)}) + {d(0.30)} * F670
        + {d(0.15)} * ({d(1)} - coalesce(F2082, {d(0.4)}))
        + {d(0.20)} * (CASE WHEN F2956 IS NULL THEN {d(0.5)} WHEN F2956 > 80 THEN {d(0)}
                            ELSE ({d(80)} - F2956) / {d(80)} END) AS p
  FROM ({ACCOUNTS}) acc) s
"""


def _strip(c: str) -> str:
    return f"regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"


def _in_list(values) -> str:
    return ", ".join(q(v) for v in values)


def _case_map(expr: str, mapping: dict, default) -> str:
    whens = " ".join(f"WHEN {q(k)} THEN {d(v)}" for k, v in mapping.items())
    return f"coalesce(CASE {expr} {whens} END, {d(default)})"


def _clip(x: str) -> str:
    return f"(CASE WHEN ({x}) IS NULL THEN NULL ELSE greatest({d(0)}, least({d(1)}, {x})) END)"


# Indicators and decoded categories over a relation with the feature columns.
def indicator_select(src: str) -> str:
    occ = f"lower({_strip('F3891')})"
    st = f"upper({_strip('F3889')})"
    occ_rate = _case_map("occupation", OCCUPATION_MULE_RATE, 0.009)
    st_rate = _case_map("standing", STANDING_MULE_RATE, 0.006)
    return f"""
SELECT i0.*,
  CAST(printf('%.3f', CASE WHEN F2956 IS NULL THEN {d(0.5)} ELSE {_clip(f'({d(80)} - F2956) / {d(80)}')} END) AS DOUBLE) AS ind_dormancy_signal,
  CAST(printf('%.3f', CASE WHEN F115 IS NULL THEN {d(0.5)} ELSE {_clip('F115')} END) AS DOUBLE) AS ind_activity_flag,
  CAST(printf('%.3f', CASE WHEN F2082 IS NULL THEN {d(0.6)} WHEN F2082 = 0 THEN {d(1)} ELSE {d(0.2)} END) AS DOUBLE) AS ind_legitimacy_gap,
  CAST(printf('%.3f', CASE WHEN F3043 IS NULL THEN {d(0.85)} ELSE {d(0.25)} END) AS DOUBLE) AS ind_missingness_pattern,
  CAST(printf('%.3f', CASE WHEN F670 IS NULL THEN {d(0.4)} WHEN F670 >= 1 THEN {d(1)} ELSE {d(0.1)} END) AS DOUBLE) AS ind_high_risk_flag,
  CAST(printf('%.3f', CASE WHEN F115 IS NULL THEN {d(0.5)} ELSE {_clip('F115')} END) AS DOUBLE) AS ind_risk_score,
  CAST(printf('%.3f', {_clip(f'{occ_rate} / {d(0.02)}')}) AS DOUBLE) AS ind_occupation_risk,
  CAST(printf('%.3f', {_clip(f'{st_rate} / {d(0.0126)}')}) AS DOUBLE) AS ind_account_standing,
  {occ_rate} AS occupation_rate, {st_rate} AS standing_rate
FROM (SELECT *,
        CASE WHEN {occ} IN ({_in_list(OCCUPATION_ORDER)}) THEN {occ} END AS occupation,
        CASE WHEN {st} IN ({_in_list(STANDING_ORDER)}) THEN {st} END AS standing
      FROM ({src}) s0) i0
"""


def assess_select(src: str, threshold: float) -> str:
    t = d(threshold)
    score = (f"round_even(greatest({d(0)}, least({d(100)}, CASE WHEN p >= {t} THEN {d(60)} + {d(40)} * (p - {t}) "
             f"/ ({d(1)} - {t}) ELSE {d(60)} * (p / {t}) END)), 1)")
    sev = "CASE " + " ".join(f"WHEN risk_score >= {d(lo)} THEN {q(n)}" for lo, n, _ in SEVERITY_BANDS[:-1]) \
        + f" ELSE {q(SEVERITY_BANDS[-1][1])} END"
    action = "CASE severity " + " ".join(f"WHEN {q(n)} THEN {q(a)}" for _, n, a in SEVERITY_BANDS) + " END"
    return f"""
SELECT a2.*, {action} AS recommended_action FROM (
  SELECT a1.*, {sev} AS severity FROM (
    SELECT ind.*, {score} AS risk_score, CAST(printf('%.6f', p) AS DOUBLE) AS risk_probability
    FROM ({indicator_select(src)}) ind) a1) a2
"""


def _sql_pred(text: str) -> str:
    return f"coalesce(({text}), false)"


def typology_select(src: str, threshold: float) -> str:
    conf_cols = []
    label_cols = []
    for typ, preds in TYPOLOGY_RULES:
        total = sum(w for _, _, w in preds)
        matched = " + ".join(f"CASE WHEN {_sql_pred(t)} THEN {d(w)} ELSE {d(0)} END" for _, t, w in preds)
        conf_cols.append(f"({d(0)} + {matched}) / {d(total)} AS conf_{typ}")
        labels = ", ".join(f"CASE WHEN {_sql_pred(t)} THEN {q(lbl)} END" for lbl, t, _ in preds)
        label_cols.append(f"list_filter([{labels}], lambda x: x IS NOT NULL) AS labels_{typ}")
    names = [typ for typ, _ in TYPOLOGY_RULES]
    best = "greatest(" + ", ".join(f"conf_{n}" for n in names) + ")"
    winner = "CASE " + " ".join(f"WHEN conf_{n} = best THEN {q(n)}" for n in names) + " END"
    win_labels = "CASE " + " ".join(f"WHEN conf_{n} = best THEN labels_{n}" for n in names) + " END"
    desc = "CASE typology " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in TYPOLOGY_DESCRIPTIONS.items()) + " END"
    return f"""
SELECT t3.*,
  CASE WHEN risk_score < {d(40)} THEN {d(0)}
       ELSE round_even(least({d(0.99)}, {d(0.6)} * rule_confidence + {d(0.4)} * (risk_score / {d(100)})), 2) END AS confidence,
  CASE WHEN typology IS NULL THEN {q('Profile consistent with legitimate usage — no mule typology assigned.')}
       ELSE {desc} END AS typology_description
FROM (
  SELECT t2.*,
    CASE WHEN risk_score < {d(40)} THEN NULL WHEN best <= 0 THEN 'LAYER_1_MULE' ELSE {winner} END AS typology,
    CASE WHEN risk_score < {d(40)} THEN {d(0)} WHEN best <= 0 THEN {d(0.3)} ELSE best END AS rule_confidence,
    CASE WHEN risk_score < {d(40)} THEN CAST([] AS VARCHAR[])
         WHEN best <= 0 THEN ['Elevated model risk score without a dominant typology signature']
         ELSE {win_labels} END AS matched_indicators
  FROM (
    SELECT t1.*, {best} AS best FROM (
      SELECT a.*, {", ".join(conf_cols)}, {", ".join(label_cols)}
      FROM ({assess_select(src, threshold)}) a) t1) t2) t3
"""


ANALYSIS = typology_select(SCORED, 0.45)

INDICATOR_COLS = ", ".join(f"ind_{k}" for k, *_ in INDICATORS)


def _indicator_long() -> str:
    parts = []
    raw = {"dormancy_signal": "F2956", "activity_flag": "F115", "legitimacy_gap": "F2082",
           "missingness_pattern": "F3043", "high_risk_flag": "F670", "risk_score": "F115"}
    for key, label, src, text in INDICATORS:
        if key == "occupation_risk":
            descr = (f"printf({q(text)}, coalesce(occupation, 'unknown'), occupation_rate * {d(100)})")
        elif key == "account_standing":
            descr = f"printf({q(text)}, coalesce(standing, 'unknown'), standing_rate * {d(100)})"
        else:
            descr = q(text)
        rv = raw.get(key)
        rv = rv if rv else "CAST(NULL AS DOUBLE)"
        parts.append(f"SELECT account_id, {q(key)} AS key, {q(label)} AS label, ind_{key} AS value, "
                     f"{rv} AS raw_value, {q(src)} AS source_feature, {descr} AS description FROM ind")
    return f"WITH ind AS ({indicator_select(SCORED)})\n" + "\nUNION ALL\n".join(parts)


SQL = {
    "accounts_fixture": ACCOUNTS,
    "risk_assessment": f"""
SELECT account_id, risk_score, risk_probability, severity, recommended_action, occupation, standing,
       {INDICATOR_COLS}
FROM ({assess_select(SCORED, 0.45)}) x""",
    "typology_assignment": f"""
SELECT account_id, risk_score, typology, rule_confidence, confidence,
       array_to_string(matched_indicators, '|') AS matched, typology_description
FROM ({ANALYSIS}) x""",
    "indicator_records": _indicator_long(),
    "top_flagged_cases": f"""
SELECT account_id, 'BOI-' || CASE WHEN length(CAST(account_id AS VARCHAR)) >= 5 THEN CAST(account_id AS VARCHAR)
         ELSE lpad(CAST(account_id AS VARCHAR), 5, '0') END AS case_id,
       risk_score, severity, typology, confidence
FROM ({ANALYSIS}) x WHERE risk_score >= {d(60)}
ORDER BY risk_score DESC, account_id LIMIT 25""",
    "severity_distribution": f"""
SELECT severity, count(*) AS n_accounts, min(risk_score) AS min_score, max(risk_score) AS max_score
FROM ({assess_select(SCORED, 0.45)}) x GROUP BY severity""",
}


# ---------------------------------------------------------------- cleaning / profiling
RAW_FEATURES = ["F115", "F2956", "F670", "F2082", "F3043", "F3889", "F3891", "F3894",
                "F527", "F531", "F1692", "F3912", "F9001", "F9002"]
KEPT = [f for f in RAW_FEATURES if f not in ("F9001", "F9002")]
OUT_FEATURES = KEPT + ["F3043_missing"]


def _coerced(f: str) -> str:
    if f == "F3889":
        return ("CASE " + _strip("F3889") + " "
                + " ".join(f"WHEN {q(v)} THEN {d(i)}" for i, v in enumerate(STANDING_ORDER)) + " END")
    if f == "F3891":
        return ("CASE lower(" + _strip("F3891") + ") "
                + " ".join(f"WHEN {q(v)} THEN {d(i)}" for i, v in enumerate(OCCUPATION_ORDER)) + " END")
    if f == "F9002":
        return "TRY_CAST(CASE WHEN regexp_matches(F9002, '^\\s*[+-]?(\\d+(\\.\\d*)?|\\.\\d+)([eE][+-]?\\d+)?\\s*$') THEN F9002 END AS DOUBLE)"
    return f"CAST({f} AS DOUBLE)"


COERCED = f"""
SELECT CAST(account_id AS VARCHAR) AS account_id, CAST(F3924 AS INTEGER) AS y,
       {", ".join(f"{_coerced(f)} AS {f}" for f in RAW_FEATURES)}
FROM ({ACCOUNTS}) a
"""

CLEAN = f"""
SELECT account_id, y, {", ".join(KEPT)},
       CAST(F3043 IS NULL AS INTEGER) AS F3043_missing
FROM ({COERCED}) c
"""


def _unpivot(src: str, feats, extra: str = "") -> str:
    sel = ", ".join(x for x in [extra] if x)
    pre = f"{sel}, " if sel else ""
    return "\nUNION ALL\n".join(
        f"SELECT {pre}{q(f)} AS feature, CAST({f} AS DOUBLE) AS value FROM ({src}) u" for f in feats)


def _null_rows(src: str, feats) -> str:
    return "\nUNION ALL\n".join(
        f"SELECT {q(f)} AS feature, count(*) AS n_rows, count({f}) AS n_non_null, "
        f"{d(1)} - count({f}) / count(*) AS null_fraction FROM ({src}) n" for f in feats)


_LABELS = "CASE feature " + " ".join(
    f"WHEN {q(k)} THEN {q(v)}" for k, v in __import__('riskspark.config', fromlist=['x']).FEATURE_NAMES.items()) + " END"

_HINTS = __import__('riskspark.config', fromlist=['x']).DOMAIN_HINT_FEATURES
_MEANINGS = __import__('riskspark.config', fromlist=['x']).DOMAIN_HINT_MEANINGS
_HINT_ROWS = " UNION ALL ".join(f"SELECT {i} AS hint_rank, {q(f)} AS feature, {q(_MEANINGS[f])} AS decoded_meaning"
                                for i, f in enumerate(_HINTS))
_PRESENT_HINTS = [f for f in _HINTS if f in OUT_FEATURES]

_DISTINCT = "\nUNION ALL\n".join(
    f"SELECT {q(f)} AS feature, count(DISTINCT {f}) AS n_distinct FROM ({CLEAN}) c" for f in OUT_FEATURES)
_TYPES = f"""
SELECT feature, n_distinct,
  CASE WHEN feature IN ('F3889', 'F3891') THEN 'categorical' WHEN n_distinct <= 2 THEN 'binary'
       WHEN n_distinct <= 10 THEN 'low_cardinality' ELSE 'continuous' END AS feature_type
FROM ({_DISTINCT}) dd"""

SQL.update({
    "cleaned_accounts": CLEAN,
    "null_profile": _null_rows(COERCED, RAW_FEATURES),
    "dataset_summary": f"""
WITH nf AS ({_null_rows(CLEAN, OUT_FEATURES)})
SELECT (SELECT count(*) FROM ({CLEAN}) c) AS rows, {len(OUT_FEATURES)} AS features, 2 AS fully_null_columns,
       CAST(sum(y) AS BIGINT) AS mule_count, CAST(count_if(y = 0) AS BIGINT) AS legit_count,
       CASE WHEN sum(y) > 0 THEN CAST(CAST(round_even(CAST(count_if(y = 0) AS DOUBLE) / sum(y), 0) AS BIGINT) AS VARCHAR) || ':1'
            ELSE 'n/a' END AS imbalance_ratio,
       (SELECT avg(null_fraction) * {d(100)} FROM nf) AS sparsity_pct
FROM ({CLEAN}) c""",
    "feature_type_breakdown": _TYPES,
    "feature_type_shares": f"""
SELECT feature_type, count(*) AS n_features,
       count(*) * {d(100)} / sum(count(*)) OVER () AS share_pct
FROM ({_TYPES}) t GROUP BY feature_type""",
    "hint_profile": f"""
WITH long AS ({_unpivot(CLEAN, _PRESENT_HINTS, "y")}),
means AS (SELECT feature, avg(CASE WHEN y = 1 THEN value END) AS mule_mean,
                 avg(CASE WHEN y = 0 THEN value END) AS legit_mean FROM long GROUP BY feature),
cnt AS (SELECT feature, value, count_if(y = 1) AS pos, count_if(y = 0) AS neg
        FROM long WHERE value IS NOT NULL GROUP BY feature, value),
cum AS (SELECT feature,
          sum(pos) OVER (PARTITION BY feature ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cp,
          sum(neg) OVER (PARTITION BY feature ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cn,
          sum(pos) OVER (PARTITION BY feature) AS tp, sum(neg) OVER (PARTITION BY feature) AS tn FROM cnt),
ks AS (SELECT feature, CASE WHEN max(tp) > 1 AND max(tn) > 1
                            THEN max(abs(CAST(cp AS DOUBLE) / tp - CAST(cn AS DOUBLE) / tn)) END AS ks_stat
       FROM cum GROUP BY feature)
SELECT h.hint_rank, h.feature, h.decoded_meaning, m.mule_mean, m.legit_mean, k.ks_stat,
       CASE WHEN k.ks_stat IS NULL THEN '—' WHEN k.ks_stat >= 0.5 THEN 'High'
            WHEN k.ks_stat >= 0.25 THEN 'Medium' ELSE 'Low' END AS discriminative_power
FROM ({_HINT_ROWS}) h LEFT JOIN means m ON m.feature = h.feature LEFT JOIN ks k ON k.feature = h.feature""",
    "class_rate_by_occupation": f"""
SELECT occupation, avg(CAST(F3924 AS DOUBLE)) AS positive_rate, count(*) AS n_accounts
FROM ({indicator_select(ACCOUNTS)}) x GROUP BY occupation""",
    "column_medians": f"""
WITH long AS ({_unpivot(CLEAN, KEPT)}),
r AS (SELECT feature, value, row_number() OVER (PARTITION BY feature ORDER BY value) AS rn,
             count(*) OVER (PARTITION BY feature) AS n FROM long WHERE value IS NOT NULL)
SELECT feature, (max(CASE WHEN rn = floor((n - 1) / 2) + 1 THEN value END)
               + max(CASE WHEN rn = floor(n / 2) + 1 THEN value END)) / {d(2)} AS median
FROM r GROUP BY feature""",
    "feature_labels": f"""
SELECT feature, coalesce({_LABELS}, 'Feature ' || feature) AS label, n_non_null
FROM ({_null_rows(COERCED, RAW_FEATURES)}) f""",
})


# ---------------------------------------------------------------- validation metrics
MODEL_SCORES = f"""
SELECT 'A' AS model, account_id, F3924 AS y, p2 AS p FROM ({SCORED}) s
UNION ALL
SELECT 'B' AS model, account_id, F3924 AS y, p FROM ({SCORED}) s
"""

CURVE = f"""
SELECT model, score, pos, neg,
  sum(pos) OVER (PARTITION BY model ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tp,
  sum(neg) OVER (PARTITION BY model ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS fp,
  sum(pos) OVER (PARTITION BY model) AS n_pos, sum(neg) OVER (PARTITION BY model) AS n_neg
FROM (SELECT model, p AS score, count_if(y = 1) AS pos, count_if(y <> 1) AS neg
      FROM ({MODEL_SCORES}) m GROUP BY model, p) c
"""

CURVE_TERMS = f"""
SELECT *,
  CASE WHEN n_pos > 0 THEN (CAST(pos AS DOUBLE) / n_pos) * prec END AS ap_term,
  CASE WHEN n_neg > 0 THEN (CAST(neg AS DOUBLE) / n_neg) * ((CAST(tp - pos AS DOUBLE) / n_pos) + rec) / {d(2)} END AS auc_term,
  rec - CAST(fp AS DOUBLE) / n_neg AS ks_term,
  CASE WHEN prec + rec > 0 THEN {d(2)} * prec * rec / (prec + rec) ELSE {d(0)} END AS f1
FROM (SELECT *, CASE WHEN tp + fp > 0 THEN CAST(tp AS DOUBLE) / (tp + fp) ELSE {d(0)} END AS prec,
             CAST(tp AS DOUBLE) / n_pos AS rec FROM ({CURVE}) c0) c1
"""


def _p_at_k(k: int) -> str:
    return f"""
SELECT model, CAST(count(*) AS INTEGER) AS k_at_{k}, CAST(coalesce(sum(y), 0) AS BIGINT) AS hits_at_{k},
       CASE WHEN count(*) > 0 THEN CAST(coalesce(sum(y), 0) AS DOUBLE) / count(*) ELSE {d(0)} END AS precision_at_{k}
FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY p DESC, account_id) AS rn FROM ({MODEL_SCORES}) m) r
WHERE rn <= {k} GROUP BY model"""


SQL.update({
    "pr_curve": f"SELECT model, score, pos, neg, tp, fp, n_pos, n_neg FROM ({CURVE}) c",
    "tuned_threshold": f"""
SELECT model, min(score) AS threshold, max(f1) AS best_f1
FROM (SELECT *, max(f1) OVER (PARTITION BY model) AS best FROM ({CURVE_TERMS}) t) b
WHERE f1 = best GROUP BY model""",
    "model_metrics": f"""
WITH rank AS (SELECT model, sum(ap_term) AS pr_auc, sum(auc_term) AS roc_auc,
                     greatest({d(0)}, max(ks_term)) AS ks_statistic FROM ({CURVE_TERMS}) t GROUP BY model),
cm AS (SELECT model, count_if(p >= 0.45) FILTER (WHERE y = 1) AS tp, count_if(p >= 0.45 AND y <> 1) AS fp,
              count_if(p < 0.45 AND y <> 1) AS tn, count_if(p < 0.45 AND y = 1) AS fn
       FROM ({MODEL_SCORES}) m GROUP BY model),
cm2 AS (SELECT *, CASE WHEN tp + fp > 0 THEN CAST(tp AS DOUBLE) / (tp + fp) ELSE {d(0)} END AS precision,
               CASE WHEN tp + fn > 0 THEN CAST(tp AS DOUBLE) / (tp + fn) ELSE {d(0)} END AS recall,
               CASE WHEN fp + tn > 0 THEN CAST(fp AS DOUBLE) / (fp + tn) ELSE {d(0)} END AS false_positive_rate,
               CAST(tp + tn AS DOUBLE) / (tp + tn + fp + fn) AS accuracy FROM cm)
SELECT cm2.model, {d(0.45)} AS threshold, rank.pr_auc, rank.roc_auc, rank.ks_statistic,
       cm2.tp, cm2.fp, cm2.tn, cm2.fn, precision, recall,
       CASE WHEN precision + recall > 0 THEN {d(2)} * precision * recall / (precision + recall) ELSE {d(0)} END AS f1,
       false_positive_rate, accuracy,
       precision_at_50, hits_at_50, k_at_50, precision_at_100, hits_at_100, k_at_100
FROM cm2 JOIN rank ON rank.model = cm2.model
JOIN ({_p_at_k(50)}) p50 ON p50.model = cm2.model JOIN ({_p_at_k(100)}) p100 ON p100.model = cm2.model""",
})


# ---------------------------------------------------------------- sampling / selection
_MEDIANS = f"""
SELECT feature, coalesce((max(CASE WHEN rn = floor((n - 1) / 2) + 1 THEN value END)
               + max(CASE WHEN rn = floor(n / 2) + 1 THEN value END)) / {d(2)}, {d(0)}) AS median
FROM (SELECT feature, value, row_number() OVER (PARTITION BY feature ORDER BY value) AS rn,
             count(*) OVER (PARTITION BY feature) AS n
      FROM ({_unpivot(CLEAN, OUT_FEATURES)}) l WHERE value IS NOT NULL) r GROUP BY feature"""


def _mi(feats) -> str:
    return f"""
WITH long AS ({_unpivot(CLEAN, feats, "y")}),
imp AS (SELECT l.y, l.feature, coalesce(l.value, m.median, {d(0)}) AS value
        FROM long l LEFT JOIN ({_MEDIANS}) m ON m.feature = l.feature),
cnt AS (SELECT feature, value, count_if(y = 1) AS pos, count_if(y <> 1) AS neg, count(*) AS cnt
        FROM imp GROUP BY feature, value),
cum AS (SELECT *, sum(cnt) OVER (PARTITION BY feature ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c,
               sum(cnt) OVER (PARTITION BY feature) AS tot, count(*) OVER (PARTITION BY feature) AS nd FROM cnt),
bins AS (SELECT feature, CASE WHEN nd <= 10 THEN value ELSE CAST(floor((c - cnt) * 20 / tot) AS DOUBLE) END AS bin,
                sum(pos) AS pos, sum(neg) AS neg FROM cum GROUP BY 1, 2),
b AS (SELECT *, sum(pos) OVER (PARTITION BY feature) AS P, sum(neg) OVER (PARTITION BY feature) AS Q FROM bins)
SELECT feature, sum(
  CASE WHEN pos > 0 THEN CAST(pos AS DOUBLE) / (P + Q) * ln(CAST(pos AS DOUBLE) * (P + Q) / ((pos + neg) * P)) ELSE {d(0)} END
+ CASE WHEN neg > 0 THEN CAST(neg AS DOUBLE) / (P + Q) * ln(CAST(neg AS DOUBLE) * (P + Q) / ((pos + neg) * Q)) ELSE {d(0)} END) AS mi
FROM b GROUP BY feature"""


def _selection_sql(include_leak: bool, hints=None, top_k: int = 200) -> str:
    """Hints in their order, then missing flags of hints, then the leak column; the rest by MI."""
    hints = _HINTS if hints is None else hints
    feats = [f for f in OUT_FEATURES if include_leak or f != "F3912"]
    listed = lambda names: ", ".join(f"({i}, {q(f)})" for i, f in enumerate(names))
    leak = "WHEN c.name = 'F3912' THEN 2" if include_leak else ""
    return f"""
WITH c(place, name) AS (VALUES {listed(feats)}), hint(place, name) AS (VALUES {listed(hints)}),
tiers AS (
  SELECT c.name, c.place, h.place AS hint_place,
         CASE WHEN h.name IS NOT NULL THEN 0 WHEN t.name IS NOT NULL THEN 1 {leak} END AS tier
  FROM c LEFT JOIN hint h ON h.name = c.name LEFT JOIN hint t ON c.name = t.name || '_missing')
SELECT feature, rank, mi, forced FROM (
  SELECT t.name AS feature, m.mi, t.tier IS NOT NULL AS forced,
         row_number() OVER (ORDER BY t.tier NULLS LAST, t.hint_place NULLS LAST,
                            CASE WHEN t.tier IS NULL THEN m.mi END DESC NULLS LAST, t.place) AS rank
  FROM tiers t LEFT JOIN ({_mi(feats)}) m ON m.feature = t.name) r
WHERE forced OR rank <= {top_k}"""


_ALLOC = f"""
WITH c AS (SELECT y, count(*) AS n_rows FROM (SELECT F3924 AS y FROM ({ACCOUNTS}) a) s GROUP BY y),
t AS (SELECT *, sum(n_rows) OVER () AS n, ceil({d(0.2)} * sum(n_rows) OVER ()) AS n_test_all FROM c),
r AS (SELECT *, n_test_all * n_rows / n AS raw, floor(n_test_all * n_rows / n) AS base FROM t),
k AS (SELECT *, row_number() OVER (ORDER BY raw - base DESC, n_rows DESC, y) AS ord,
             n_test_all - sum(base) OVER () AS leftover FROM r)
SELECT y, n_rows, CAST(base + CASE WHEN ord <= leftover THEN 1 ELSE 0 END AS BIGINT) AS n_test FROM k"""

_FOLDS = f"""
WITH c AS (SELECT F3924 AS y, count(*) AS n FROM ({ACCOUNTS}) a GROUP BY 1),
f AS (SELECT y, n, fold FROM c, range(0, 5) r(fold)),
b AS (SELECT y, fold, CASE WHEN fold = 0 THEN 0 ELSE round_even(fold * n / 5, 0) END AS lo,
             CASE WHEN fold = 4 THEN n ELSE round_even((fold + 1) * n / 5, 0) END AS hi FROM f)
SELECT y, CAST(fold AS INTEGER) AS fold, CAST(hi - lo AS BIGINT) AS n_rows FROM b WHERE hi > lo"""

SQL.update({
    "stratified_split_counts": _ALLOC,
    "stratified_fold_counts": _FOLDS,
    "mutual_information": _mi(OUT_FEATURES),
    "feature_selection_model_a": _selection_sql(True),
    "feature_selection_model_b": _selection_sql(False),
    "feature_selection_cut": _selection_sql(True, ("F115", "F3043"), 6),
    "top_mi_features": f"SELECT feature, mi FROM ({_mi(OUT_FEATURES)}) m ORDER BY mi DESC, feature LIMIT 5",
    "imputed_features": f"""
SELECT account_id, y, {", ".join(f"coalesce(CAST({f} AS DOUBLE), (SELECT median FROM med WHERE feature = {q(f)})) AS {f}" for f in OUT_FEATURES)}
FROM ({CLEAN}) c, (SELECT 1) one, LATERAL (SELECT 1) l2
""".replace("FROM (", "FROM (", 1),
})
SQL["imputed_features"] = f"WITH med AS ({_MEDIANS})\n" + SQL["imputed_features"].replace(", (SELECT 1) one, LATERAL (SELECT 1) l2", "")


# ---------------------------------------------------------------- learning
SQL["smote_class_counts"] = """
WITH j AS (SELECT 1 - l.quality AS y FROM documents d JOIN labels l ON l.doc_id = d.doc_id),
c AS (SELECT count_if(y = 1) AS n_pos, count_if(y <> 1) AS n_neg FROM j)
SELECT CAST(1 - quality AS INTEGER) AS y, false AS synthetic, count(*) AS n_rows
FROM documents d JOIN labels l ON l.doc_id = d.doc_id GROUP BY 1
UNION ALL
SELECT 1 AS y, true AS synthetic, n_neg - n_pos AS n_rows FROM c WHERE n_pos >= 2 AND n_neg > n_pos
"""
SQL["minority_neighbours"] = """
WITH f AS (
  SELECT d.doc_id AS id, length(text) AS a, length(text) - length(replace(text, ' ', '')) AS b,
         length(text) - length(regexp_replace(text, '[0-9]', '', 'g')) AS c,
         length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS e,
         length(text) - length(replace(text, chr(10), '')) + 1 AS g
  FROM documents d JOIN labels l ON l.doc_id = d.doc_id WHERE l.quality = 0),
p AS (SELECT min(id) AS pid, count(*) AS mult, a, b, c, e, g FROM f GROUP BY a, b, c, e, g),
pairs AS (
  SELECT x.pid, y.pid AS neighbour, CASE WHEN x.pid = y.pid THEN y.mult - 1 ELSE y.mult END AS mult,
         sqrt(CAST((x.a - y.a) * (x.a - y.a) + (x.b - y.b) * (x.b - y.b) + (x.c - y.c) * (x.c - y.c)
                   + (x.e - y.e) * (x.e - y.e) + (x.g - y.g) * (x.g - y.g) AS DOUBLE)) AS distance
  FROM p x CROSS JOIN p y),
copies AS (SELECT pid, neighbour, distance, unnest(range(least(mult, 5))) AS copy FROM pairs),
ranked AS (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY distance, neighbour, copy) - 1 AS slot FROM copies)
SELECT pid, CAST(slot AS INTEGER) AS slot, neighbour, distance FROM ranked WHERE slot < 5
"""
SQL["model_training_summary"] = f"""
WITH alloc AS ({_ALLOC})
SELECT m.model, m.includes_leakage, m.n_features, (SELECT sum(n_rows - n_test) FROM alloc) AS n_train
FROM (SELECT 'A' AS model, true AS includes_leakage, {len(OUT_FEATURES)} AS n_features
      UNION ALL SELECT 'B', false, {len(OUT_FEATURES) - 1}) m
"""


# ---------------------------------------------------------------- network
EDGES = """
SELECT DISTINCT user_id AS entity,
  json_extract_string(props, '$.k') || '|' || strftime(date_trunc('hour', ts), '%Y-%m-%d %H') || '|'
    || CAST(CAST(floor(minute(ts) / 10) AS BIGINT) AS VARCHAR) AS attribute
FROM events"""
ESCORES = f"""
SELECT user_id AS entity,
  least({d(100)}, {d(100)} * avg(CASE WHEN event_type = 'error' THEN {d(1)} ELSE {d(0)} END) * {d(2)}) AS score
FROM events GROUP BY user_id"""
PAIRS = f"SELECT DISTINCT a.entity AS a, b.entity AS b FROM ({EDGES}) a JOIN ({EDGES}) b ON a.attribute = b.attribute AND a.entity <> b.entity"
COMPONENTS = f"""
WITH RECURSIVE nodes AS (SELECT DISTINCT entity FROM ({EDGES}) e),
cc(entity, label) AS (
  SELECT entity, entity FROM nodes
  UNION
  SELECT p.b, cc.label FROM cc JOIN ({PAIRS}) p ON p.a = cc.entity)
SELECT entity, min(label) AS component FROM cc GROUP BY entity"""
CSUMMARY = f"""
WITH deg AS (SELECT entity, count(DISTINCT attribute) AS degree FROM ({EDGES}) e GROUP BY entity),
j AS (SELECT c.component, c.entity, coalesce(s.score, {d(0)}) AS score, coalesce(deg.degree, 0) AS degree
      FROM ({COMPONENTS}) c LEFT JOIN ({ESCORES}) s ON s.entity = c.entity LEFT JOIN deg ON deg.entity = c.entity)
SELECT component, count(*) AS size, avg(score) AS mean_risk, count_if(score >= {d(60)}) AS mules,
  coalesce(sum(CASE WHEN score >= {d(60)} THEN score * {d(0.18)} END), {d(0)}) AS exposure_lakh,
  arg_max(entity, (degree, -entity)) AS hub
FROM j GROUP BY component"""

SQL.update({
    "attribute_links": f"SELECT attribute, count(*) AS degree FROM ({EDGES}) e GROUP BY attribute",
    "risk_propagation": f"""
SELECT s.entity, s.score, least({d(100)}, coalesce(max(n.score), {d(0)}) * {d(0.8)}) AS propagated
FROM ({ESCORES}) s LEFT JOIN ({PAIRS}) p ON p.a = s.entity LEFT JOIN ({ESCORES}) n ON n.entity = p.b
GROUP BY s.entity, s.score""",
    "risk_components": COMPONENTS,
    "campaign_summary": CSUMMARY,
    "campaign_lookup": f"""
SELECT c.c_custkey AS entity, cc.component, coalesce(cs.mean_risk, {d(50)}) AS campaign_score,
       coalesce(cs.size, 0) AS campaign_size
FROM customer c LEFT JOIN ({COMPONENTS}) cc ON cc.entity = c.c_custkey
LEFT JOIN ({CSUMMARY}) cs ON cs.component = cc.component""",
})


# ---------------------------------------------------------------- case text / cases / stream
from riskspark.operators import casetext as _ct  # noqa: E402

_NL = "chr(10)"
CASE_ID = "'BOI-' || CASE WHEN length(CAST(account_id AS VARCHAR)) >= 5 THEN CAST(account_id AS VARCHAR) ELSE lpad(CAST(account_id AS VARCHAR), 5, '0') END"


def _unknown(c: str) -> str:
    return f"coalesce(CAST({c} AS VARCHAR), 'unknown')"


def _note(sev: str) -> str:
    from riskspark.config import REGULATORY_NOTES
    return "CASE " + sev + " " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in REGULATORY_NOTES.items()) \
        + f" ELSE {q(REGULATORY_NOTES['LOW'])} END"


REPORTS = f"""
SELECT account_id, case_id, report, 'fallback' AS report_source FROM (
SELECT account_id, {CASE_ID} AS case_id,
 '1. EXECUTIVE SUMMARY' || {_NL} ||
 'Account ' || {CASE_ID} || ' scored ' || CAST(risk_score AS VARCHAR) || '/100 (' || severity || '). ' ||
 CASE WHEN typology IS NOT NULL THEN 'It matches the ' || typology || ' mule typology and warrants action. '
      ELSE 'It does not match a mule typology and appears legitimate. ' END ||
 CASE WHEN coalesce(F3912 >= 1, false) THEN 'This account matches the fraud registry (F3912) — treat as confirmed. ' ELSE '' END ||
 {_NL} || {_NL} || '2. RISK ASSESSMENT' || {_NL} || 'Risk score ' || CAST(risk_score AS VARCHAR) ||
 '/100 places this account in the ' || severity || ' band' || {_NL} || '(model probability ' ||
 printf('%.4f', risk_probability) || ', decision threshold applied). ' || recommended_action || '.' ||
 {_NL} || {_NL} || '3. KEY FRAUD INDICATORS' || {_NL} || 'The model attributes the score primarily to:' || {_NL} ||
 '   - No SHAP attributions available.' || {_NL} || {_NL} || '4. MULE TYPOLOGY ASSESSMENT' || {_NL} ||
 CASE WHEN typology IS NOT NULL THEN 'Classified as ' || typology || ' with ' || printf('%.0f%%', confidence * 100)
        || ' confidence.' || {_NL} || typology_description || {_NL} || 'Supporting evidence:' || {_NL} ||
        CASE WHEN len(matched_indicators) > 0
             THEN array_to_string(list_transform(matched_indicators, lambda m: '   - ' || m), {_NL})
             ELSE '   - None matched.' END
      ELSE {q(_ct.NO_TYPOLOGY)} END ||
 {_NL} || {_NL} || '5. ACCOUNT PROFILE ANALYSIS' || {_NL} || 'Occupation: ' || {_unknown('occupation')} ||
 '. Account standing period: ' || {_unknown('standing')} || '.' || {_NL} || 'Account holder age: ' ||
 {_unknown('F3894')} || '. Account tenure: ' || {_unknown('F2956')} || '.' || {_NL} || {q(_ct.PROFILE_NOTE)} ||
 {_NL} || {_NL} || '6. RECOMMENDED ACTIONS' || {_NL} || recommended_action || '. ' ||
 CASE WHEN severity IN ('CRITICAL', 'HIGH') THEN {q(_ct.ESCALATE)} ELSE {q(_ct.ROUTINE)} END ||
 {_NL} || {_NL} || '7. REGULATORY NOTE' || {_NL} || {_note('severity')} AS report
FROM ({ANALYSIS}) a) r
"""


def _sections(src: str, key: str, text: str) -> str:
    hdr_clean = (f"upper(regexp_replace(regexp_replace(regexp_replace(line, '[*#]', '', 'g'), "
                 f"'^\\s*\\d+\\.\\s*', ''), '^\\s+|\\s+$', '', 'g'))")
    hdr = "CASE " + " ".join(f"WHEN starts_with(clean, {q(s)}) THEN {q(s)}" for s in REPORT_SECTIONS_) + " END"
    return f"""
WITH src AS ({src}),
lines AS (SELECT {key} AS k, unnest(string_split({text}, chr(10))) AS line,
                 generate_subscripts(string_split({text}, chr(10)), 1) AS pos FROM src),
c AS (SELECT *, {hdr_clean} AS clean FROM lines),
h AS (SELECT k, pos, line, {hdr} AS hdr FROM c),
b AS (SELECT *, sum(CASE WHEN hdr IS NOT NULL THEN 1 ELSE 0 END)
                OVER (PARTITION BY k ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS block FROM h),
blocks AS (SELECT k, CAST(block AS BIGINT) AS block, max(hdr) AS header,
                  coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE hdr IS NULL), '') AS raw
           FROM b WHERE block > 0 GROUP BY k, block)
SELECT k AS {key}, block, header, replace(regexp_replace(raw, '^\\s+|\\s+$', '', 'g'), '**', '') AS body FROM blocks
UNION ALL
SELECT {key}, CAST(1 AS BIGINT) AS block, 'REPORT' AS header,
       replace(regexp_replace({text}, '^\\s+|\\s+$', '', 'g'), '**', '') AS body
FROM src WHERE {key} NOT IN (SELECT k FROM blocks)"""


from riskspark.config import REPORT_SECTIONS as REPORT_SECTIONS_  # noqa: E402

ASSISTANT = ("SELECT CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR) AS text_id, text "
             "FROM conversations WHERE role = 'assistant'")

_V1 = f"""SELECT {CASE_ID} AS case_id, CAST(account_id AS BIGINT) AS account_id, risk_score, severity, typology,
  confidence, account_id % 10 = 0 AS is_demo, CAST(1 AS BIGINT) AS version FROM ({ANALYSIS}) a"""
_V2 = f"""SELECT case_id, account_id, risk_score / {d(2)} AS risk_score, 'LOW' AS severity, typology, confidence,
  is_demo, CAST(2 AS BIGINT) AS version FROM ({_V1}) v WHERE account_id % 7 = 0"""
_UPSERT = f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY version DESC) AS rn
                  FROM (SELECT * FROM ({_V1}) a UNION ALL SELECT * FROM ({_V2}) b) u) x WHERE rn = 1"""
_PB = {k: "|".join(v) for k, v in _ct.PLAYBOOK_ACTIONS.items()}

SQL.update({
    "case_reports": REPORTS,
    "report_sections": _sections(f"SELECT account_id, report FROM ({REPORTS}) r", "account_id", "report"),
    "conversation_sections": _sections(ASSISTANT, "text_id", "text"),
    "generated_text_gate": f"""
SELECT text_id, s AS stripped,
  CASE WHEN length(s2) > 200 AND contains(upper(s2), 'EXECUTIVE SUMMARY')
       THEN CASE WHEN contains(upper(s2), 'REGULATORY NOTE') THEN s2
                 ELSE s2 || chr(10) || chr(10) || '7. REGULATORY NOTE' || chr(10) || {_note("'HIGH'")} END
       ELSE '<fallback report>' END AS final_text,
  CASE WHEN length(s2) > 200 AND contains(upper(s2), 'EXECUTIVE SUMMARY') THEN 'ollama' ELSE 'fallback' END AS report_source
FROM (SELECT text_id, regexp_replace(regexp_replace(text, '(?is)<think>.*?</think>', '', 'g'), '^\\s+|\\s+$', '', 'g') AS s,
             regexp_replace(regexp_replace(text, '(?is)<think>.*?</think>', '', 'g'), '^\\s+|\\s+$', '', 'g') AS s2
      FROM ({ASSISTANT}) t) g""",
    "case_playbooks": f"""
SELECT account_id, severity,
  CASE severity {" ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in _PB.items())} ELSE {q("|".join(_ct.PLAYBOOK_DEFAULT_ACTIONS))} END AS actions,
  CASE severity {" ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in _ct.PLAYBOOK_NOTES.items())} ELSE {q(_ct.PLAYBOOK_DEFAULT_NOTE)} END AS note,
  CASE WHEN severity IN ('CRITICAL', 'HIGH') THEN {q("|".join(_ct.WORKFLOW_ESCALATED))} ELSE {q("|".join(_ct.WORKFLOW_ROUTINE))} END AS workflow,
  {_note('severity')} AS regulatory_note
FROM ({ANALYSIS}) a""",
    "case_store_upsert": f"SELECT case_id, account_id, risk_score, severity, is_demo, version FROM ({_UPSERT}) u",
    "case_listing": f"SELECT case_id, risk_score, severity FROM ({_UPSERT}) u ORDER BY risk_score DESC, case_id",
    "clear_uploaded_cases": f"SELECT count_if(is_demo) AS kept, count_if(NOT is_demo) AS removed FROM ({_V1}) v",
    "demo_case_seeding": f"""SELECT count(*) AS new_demo_cases FROM ({_V1}) d
WHERE is_demo AND case_id NOT IN (SELECT case_id FROM ({_V1}) e WHERE NOT is_demo)""",
    "case_lookup_priority": f"""
SELECT case_id, arg_min(risk_score, prio) AS risk_score, arg_min(source, prio) AS source FROM (
  SELECT case_id, risk_score, 'demo' AS source, 0 AS prio FROM ({_V1}) a WHERE is_demo
  UNION ALL SELECT case_id, risk_score, 'store' AS source, 1 AS prio FROM ({_V2}) b) u GROUP BY case_id""",
    "high_severity_cases": f"SELECT {CASE_ID} AS case_id, severity, risk_score FROM ({ANALYSIS}) a WHERE severity IN ('CRITICAL', 'HIGH')",
    "dashboard_kpis": f"""
SELECT count(*) AS total, count_if(severity IN ('CRITICAL', 'HIGH')) AS mules,
  CAST(CASE WHEN count(*) > 0 THEN round(avg(risk_score), 0) ELSE 0 END AS BIGINT) AS avg_risk,
  count_if(severity IN ('CRITICAL', 'HIGH')) * {d(14.4)} AS exposure_lakh,
  CAST(greatest(1, ceil(count_if(severity IN ('CRITICAL', 'HIGH')) / {d(3)})) AS BIGINT) AS active_campaigns
FROM ({ANALYSIS}) a""",
    "analytics_kpis": f"""
SELECT count(*) AS flagged, CAST(ceil(count(*) / {d(3)}) AS BIGINT) AS networks_disrupted,
  count(*) * {d(14.4)} AS fraud_prevented_lakh, CAST(ceil(count(*) / {d(5)}) AS BIGINT) AS high_risk_communities
FROM ({ANALYSIS}) a WHERE risk_score >= {d(60)}""",
})
SQL["single_account_json"] = SQL["risk_assessment"]
SQL["stream_scoring"] = SQL["risk_assessment"]


# ---------------------------------------------------------------- prompts and STR drafts
def _js(c: str) -> str:
    return f"CASE WHEN {c} = floor({c}) THEN CAST(CAST({c} AS BIGINT) AS VARCHAR) ELSE CAST({c} AS VARCHAR) END"


def _bul(indent: str, fallback: str) -> str:
    return (f"CASE WHEN len(matched_indicators) > 0 THEN array_to_string(list_transform(matched_indicators, "
            f"lambda m: '{indent}- ' || m), chr(10)) ELSE {q(fallback)} END")


SQL["case_prompts"] = f"""
SELECT account_id,
 'Produce a mule-account investigation report for the account below.' || chr(10) || chr(10) ||
 'STRUCTURED ANALYSIS' || chr(10) || 'Case ID: ' || {CASE_ID} || chr(10) ||
 'Risk score: ' || CAST(risk_score AS VARCHAR) || '/100' || chr(10) || 'Severity: ' || severity || chr(10) ||
 'Model risk probability: ' || printf('%.4f', risk_probability) || chr(10) ||
 'Fraud-registry (F3912) match: ' || CASE WHEN coalesce(F3912 >= 1, false) THEN 'YES' ELSE 'no' END ||
 chr(10) || chr(10) || 'Top SHAP fraud indicators:' || chr(10) || '  - (no SHAP attribution available)' ||
 chr(10) || chr(10) || 'Mule typology: ' || coalesce(typology, 'None (legitimate profile)') ||
 ' (confidence ' || printf('%.0f%%', confidence * 100) || ')' || chr(10) ||
 'Matched typology evidence:' || chr(10) || {_bul("  ", "  - none")} || chr(10) || chr(10) ||
 'Account profile:' || chr(10) || '  - Occupation: ' || {_unknown('occupation')} || chr(10) ||
 '  - Account standing period: ' || {_unknown('standing')} || chr(10) ||
 '  - Account holder age: ' || {_unknown('F3894')} || chr(10) ||
 '  - Account tenure: ' || {_unknown('F2956')} || chr(10) || chr(10) || {q(_ct.PROMPT_INSTRUCTIONS)} AS prompt
FROM ({ANALYSIS}) a"""

SQL["str_drafts"] = f"""
SELECT account_id,
 'SUSPICIOUS TRANSACTION REPORT (STR) — DRAFT' || chr(10) ||
 'Filed under the Prevention of Money Laundering Act, 2002 (FIU-IND)' || chr(10) || chr(10) ||
 'REPORTING ENTITY      : Bank of India' || chr(10) || 'SUBJECT ACCOUNT       : ' || {CASE_ID} || chr(10) ||
 'RISK SCORE / SEVERITY : ' || {_js('risk_score')} || '/100 (' || severity || ')' || chr(10) ||
 'MULE TYPOLOGY         : ' || coalesce(typology, 'None') || ' (' ||
   CAST(CAST(round(confidence * 100) AS BIGINT) AS VARCHAR) || '% confidence)' || chr(10) ||
 'FRAUD REGISTRY MATCH  : ' || CASE WHEN coalesce(F3912 >= 1, false) THEN 'YES (F3912 = 1)' ELSE 'No' END || chr(10) ||
 'MODEL                 : B (SHAP-attributed)' || chr(10) || chr(10) ||
 'GROUNDS FOR SUSPICION' || chr(10) || {_bul("  ", "  - Elevated model risk score")} || chr(10) || chr(10) ||
 'TOP CONTRIBUTING SIGNALS (SHAP)' || chr(10) || '' || chr(10) || chr(10) ||
 'ACCOUNT PROFILE' || chr(10) || '  Occupation       : ' || {_unknown('occupation')} || chr(10) ||
 '  Account standing : ' || {_unknown('standing')} || chr(10) ||
 '  Account age      : ' || coalesce({_js('F3894')}, 'unknown') || chr(10) || chr(10) ||
 'RECOMMENDED ACTION    : ' || CASE severity {" ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in _ct.STR_ACTIONS.items())}
   ELSE {q(_ct.STR_DEFAULT_ACTION)} END || chr(10) || chr(10) || {q(_ct.STR_FOOTER)} AS str_draft
FROM ({ANALYSIS}) a"""


def _round(prev: str) -> str:
    return f"""SELECT s.entity, greatest(s.risk, least({d(100)}, coalesce(max(n.risk), {d(0)}) * {d(0.8)})) AS risk
FROM ({prev}) s LEFT JOIN ({PAIRS}) p ON p.a = s.entity LEFT JOIN ({prev}) n ON n.entity = p.b
GROUP BY s.entity, s.risk"""


_R0 = f"SELECT entity, score AS risk FROM ({ESCORES}) e"
SQL["risk_propagation_rounds"] = f"""
SELECT e.entity, e.score, r.risk FROM ({ESCORES}) e JOIN ({_round(_round(_round(_R0)))}) r ON r.entity = e.entity"""

SQL["stream_case_persistence"] = f"SELECT case_id, account_id, risk_score, severity, is_demo FROM ({_V1}) v"

SQL["schema_violations"] = f"""
SELECT account_id, risk_score, risk_probability, confidence FROM ({ANALYSIS}) a
WHERE NOT (risk_score BETWEEN 0 AND 100 AND risk_probability BETWEEN 0 AND 1 AND confidence BETWEEN 0 AND 1
           AND least({INDICATOR_COLS}) >= 0 AND greatest({INDICATOR_COLS}) <= 1)"""

SQL["leakage_report"] = f"""
WITH long AS ({_unpivot(CLEAN, OUT_FEATURES, "y")}),
rep AS (SELECT feature, count_if(value >= 1) AS n_flagged, count_if(value >= 1 AND y = 1) AS tp,
               count_if(y = 1) AS n_pos FROM long GROUP BY feature)
SELECT r.feature, r.n_flagged,
  CASE WHEN r.n_flagged > 0 THEN CAST(r.tp AS DOUBLE) / r.n_flagged END AS flag_precision,
  CASE WHEN r.n_pos > 0 THEN CAST(r.tp AS DOUBLE) / r.n_pos END AS flag_recall, m.mi
FROM rep r LEFT JOIN ({_mi(OUT_FEATURES)}) m ON m.feature = r.feature"""


# ---------------------------------------------------------------- metadata, weights, attributions, typed links
SQL["table_fingerprint"] = """
SELECT count(*) AS n_rows, bit_xor(h) AS xor_digest, CAST(sum(CAST(h AS HUGEINT)) AS VARCHAR) AS sum_digest
FROM (SELECT CAST('0x' || substr(sha256(CAST(to_json({'c_custkey': c_custkey, 'c_name': c_name,
        'c_nationkey': c_nationkey, 'c_mktsegment': c_mktsegment}) AS VARCHAR)), 1, 15) AS BIGINT) AS h FROM customer) r"""

SQL["cleaning_metadata"] = f"""
WITH nf AS ({_null_rows(COERCED, RAW_FEATURES)}), alloc AS ({_ALLOC}),
place AS (SELECT unnest({RAW_FEATURES}) AS feature, unnest(range({len(RAW_FEATURES)})) AS place),
g AS (SELECT string_agg(nf.feature, '|' ORDER BY place) FILTER (WHERE null_fraction >= 1) AS dropped,
             string_agg(nf.feature, '|' ORDER BY place) FILTER (WHERE null_fraction > 0.05 AND null_fraction < 1) AS missing,
             count_if(null_fraction >= 1) AS nd,
             count_if(null_fraction > 0.05 AND null_fraction < 1) AS nm, count(*) AS n
      FROM nf JOIN place ON place.feature = nf.feature)
SELECT (SELECT CAST(sum(n_rows - n_test) AS BIGINT) FROM alloc) AS n_rows, CAST(n - nd + nm AS INTEGER) AS n_features,
       CAST(nd AS INTEGER) AS n_dropped, CAST(nm AS INTEGER) AS n_missing_indicators, dropped, missing FROM g"""

SQL["hints_by_ks"] = f"SELECT feature, ks_stat, discriminative_power FROM ({SQL['hint_profile']}) h"

SQL["class_weights"] = f"""
WITH a AS (SELECT account_id, F3924 AS y FROM ({ACCOUNTS}) x),
c AS (SELECT CAST(count_if(y = 0) AS DOUBLE) / count_if(y = 1) AS w FROM a)
SELECT account_id, y, CASE WHEN y = 1 THEN w ELSE {d(1)} END AS weight FROM a, c"""

SQL["case_lookup"] = f"""SELECT case_id, account_id, risk_score, severity, version FROM ({_UPSERT}) u
WHERE case_id = 'BOI-00014'"""

_ATTRIBUTIONS = f"""SELECT account_id, feature, (coalesce(value, {d(0)}) - {d(0.5)}) * {d(0.25)} AS shap_value,
  coalesce(value, {d(0)}) AS feature_value FROM ({_unpivot(CLEAN, KEPT, "account_id")}) u"""
_LABELLED = f"coalesce({_LABELS}, 'Feature ' || feature)"

SQL["top_attributions"] = f"""
SELECT account_id, rank, {_LABELLED} AS label, feature AS raw_feature, shap_value,
       CASE WHEN shap_value >= 0 THEN 'increases_risk' ELSE 'reduces_risk' END AS direction, feature_value
FROM (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY abs(shap_value) DESC, feature) AS rank
      FROM ({_ATTRIBUTIONS}) a) r WHERE rank <= 10"""

SQL["attribution_importance"] = f"""
SELECT {_LABELLED} AS label, feature AS raw_feature, mean_abs_shap,
       CASE WHEN mean_shap >= 0 THEN 'increases_risk' ELSE 'reduces_risk' END AS direction
FROM (SELECT feature, avg(abs(shap_value)) AS mean_abs_shap, avg(shap_value) AS mean_shap
      FROM ({_ATTRIBUTIONS}) a GROUP BY feature ORDER BY 2 DESC, feature LIMIT 8) g"""

SQL["risk_propagation_typed"] = f"""
WITH links AS (
  SELECT DISTINCT user_id AS entity, {d(0.8)} AS f, 'd' AS t, json_extract_string(props, '$.k') || '|'
    || strftime(date_trunc('hour', ts), '%Y-%m-%d %H') || '|' || CAST(CAST(floor(minute(ts) / 10) AS BIGINT) AS VARCHAR) AS a
  FROM events
  UNION ALL
  SELECT DISTINCT user_id, {d(0.4)}, 't', event_type || '|' || strftime(date_trunc('hour', ts), '%Y-%m-%d %H') || '|'
    || CAST(CAST(floor(minute(ts) / 10) AS BIGINT) AS VARCHAR) FROM events WHERE event_type = 'purchase'),
s AS ({ESCORES}),
nb AS (SELECT x.entity, max(s.score * x.f) AS best FROM links x JOIN links y
         ON x.t = y.t AND x.a = y.a AND x.entity <> y.entity JOIN s ON s.entity = y.entity GROUP BY x.entity)
SELECT s.entity, s.score, least({d(100)}, coalesce(nb.best, {d(0)})) AS propagated, s.score >= {d(60)} AS is_mule
FROM s LEFT JOIN nb ON nb.entity = s.entity"""

SQL["csv_accounts"] = SQL["cleaned_accounts"]
