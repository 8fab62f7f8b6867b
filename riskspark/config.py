"""Configuration: column roles, dictionaries, bands and typology rules.

Every operator reads its column names and dictionaries from a ``RiskConfig``
so the same code runs on any account table, not one hard-coded file.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# --------------------------------------------------------------------------
# FIXED VALUES. These must equal the reference application's constants for
# results to match; they are stated here as plain data in natural order.
# --------------------------------------------------------------------------

TARGET_COLUMN = "F3924"
LEAKAGE_FEATURE = "F3912"
INDEX_COLUMN = "Unnamed: 0"
TOP_K_FEATURES = 200
RANDOM_STATE = 42
MISSING_INDICATOR_THRESHOLD = 0.05  # strictly greater than
MIN_RISK_FOR_TYPOLOGY = 40.0
FLAG_THRESHOLD = 60.0
TOP_CASES = 25
PRECISION_AT_K = (50, 100)

# (lower bound inclusive, name, recommended action), highest band first.
SEVERITY_BANDS = (
    (80.0, "CRITICAL", "Immediate block recommended"),
    (60.0, "HIGH", "Step-up authentication required"),
    (40.0, "MEDIUM", "Enhanced monitoring"),
    (0.0, "LOW", "Allow, log only"),
)
DEFAULT_ACTION = "Allow, log only"

FEATURE_NAMES = {
    "F115": "Transaction Risk Score",
    "F2956": "Account Tenure",
    "F670": "High-Risk Flag",
    "F2082": "Legitimacy Indicator",
    "F3043": "Activity Count",
    "F3889": "Account Standing Period",
    "F3891": "Account Holder Occupation",
    "F3894": "Account Holder Age",
    "F3912": "Fraud Registry Flag (Leakage Warning)",
}

DOMAIN_HINT_FEATURES = (
    "F115", "F321", "F527", "F531", "F670", "F1692", "F2082", "F2122",
    "F2582", "F2678", "F2737", "F2956", "F3043", "F3836", "F3887",
    "F3889", "F3891", "F3894",
)

DOMAIN_HINT_MEANINGS = {
    "F115": "Transaction Risk Score",
    "F321": "Transfer Velocity Signal",
    "F527": "Inbound Counterparty Spread",
    "F531": "Outbound Counterparty Spread",
    "F670": "High-Risk Flag",
    "F1692": "Cash Flow Ratio",
    "F2082": "Legitimacy Indicator",
    "F2122": "Channel Usage Pattern",
    "F2582": "Balance Volatility",
    "F2678": "Geographic Risk Signal",
    "F2737": "Device / Session Anomaly",
    "F2956": "Account Tenure",
    "F3043": "Activity Count",
    "F3836": "KYC Completeness Score",
    "F3887": "Relationship Depth",
    "F3889": "Account Standing Period",
    "F3891": "Account Holder Occupation",
    "F3894": "Account Holder Age",
}

STANDING_ORDER = ("L7D", "L14D", "L31D", "L90D", "L180D", "L365D", "G365D")
OCCUPATION_ORDER = (
    "selfemployed", "salaried", "student", "agriculture",
    "housewife", "retired", "others",
)

OCCUPATION_MULE_RATE = {
    "student": 0.0194,
    "agriculture": 0.0126,
    "housewife": 0.0045,
    "selfemployed": 0.0090,
    "salaried": 0.0070,
    "retired": 0.0040,
    "others": 0.0100,
}
OCCUPATION_DEFAULT_RATE = 0.009
OCCUPATION_RATE_SCALE = 0.02

STANDING_MULE_RATE = {
    "L7D": 0.0000,
    "L14D": 0.0000,
    "L31D": 0.0030,
    "L90D": 0.0060,
    "L180D": 0.0090,
    "L365D": 0.0126,
    "G365D": 0.0080,
}
STANDING_DEFAULT_RATE = 0.006
STANDING_RATE_SCALE = 0.0126

# Behavioural indicators: key, label, source feature, description
# (two descriptions are templates filled with the decoded category and prior).
INDICATORS = (
    ("dormancy_signal", "Dormancy Signal", "F2956",
     "Low account tenure / dormancy-break signal. Mule median 41 vs legit 64."),
    ("activity_flag", "Activity Flag", "F115",
     "Elevated transactional activity. Mules score ~22% higher (0.72 vs 0.59)."),
    ("legitimacy_gap", "Legitimacy Gap", "F2082",
     "Missing legitimacy indicator. Every confirmed mule has F2082 = 0."),
    ("missingness_pattern", "Missingness Pattern", "F3043",
     "Activity-count field absent. 82.7% of mules missing it vs 64% of legit."),
    ("high_risk_flag", "High-Risk Flag", "F670",
     "F670 = 1 carries a 2.29% mule rate (2.6x the population average)."),
    ("risk_score", "Risk Score", "F115",
     "Normalised transaction risk score derived from F115."),
    ("occupation_risk", "Occupation Risk", "F3891",
     "Occupation '%s' carries a %.2f%% mule prior."),
    ("account_standing", "Account Standing", "F3889",
     "Standing '%s' carries a %.2f%% mule prior."),
)

TYPOLOGY_DESCRIPTIONS = {
    "LAYER_1_MULE":
        "Direct recipient of stolen funds — high transaction velocity on a newly "
        "opened account with rapid outbound transfers.",
    "PASS_THROUGH":
        "Funds received and almost immediately forwarded. Near-zero legitimacy "
        "footprint with a high cash-flow ratio.",
    "DORMANT_ACTIVATED":
        "A long-lapsed or very new account that has suddenly become active — a "
        "classic dormancy-break laundering pattern.",
    "SYNTHETIC_IDENTITY":
        "Likely synthetic / borrowed identity — high-risk flag set, low-income "
        "occupation profile, and a very recently opened account.",
    "NETWORK_HUB":
        "Central node in a layering network — high activity with a complex, wide "
        "counterparty spread routing funds across many accounts.",
}
LEGITIMATE_DESCRIPTION = (
    "Profile consistent with legitimate usage — no mule typology assigned."
)
FALLBACK_TYPOLOGY = "LAYER_1_MULE"
FALLBACK_CONFIDENCE = 0.3
FALLBACK_MATCH_LABEL = "Elevated model risk score without a dominant typology signature"

# Typology rules in priority order (first wins ties). Each predicate is
# (label, SQL boolean expression over indicator values ``ind_<key>`` and the
# numeric feature columns, weight). NULL predicates count as not matched.
TYPOLOGY_RULES = (
    ("LAYER_1_MULE", (
        ("High transaction velocity (F115 elevated)", "ind_activity_flag >= 0.7", 1.0),
        ("Newly opened account (low tenure F2956)", "ind_dormancy_signal >= 0.55", 1.0),
        ("High-risk flag set (F670=1)", "ind_high_risk_flag >= 0.9", 0.8),
        ("Missing legitimacy indicator (F2082=0)", "ind_legitimacy_gap >= 0.9", 0.8),
    )),
    ("PASS_THROUGH", (
        ("Near-zero legitimacy footprint (F2082=0)", "ind_legitimacy_gap >= 0.9", 1.2),
        ("High cash-flow ratio (F1692 elevated)", "F1692 >= 0.6", 1.0),
        ("Elevated activity (F115)", "ind_activity_flag >= 0.6", 0.6),
    )),
    ("DORMANT_ACTIVATED", (
        ("Very low / reactivated tenure (F2956 low)", "F2956 <= 25", 1.4),
        ("Strong dormancy-break signal", "ind_dormancy_signal >= 0.65", 1.0),
        ("Activity present after lapse (F115)", "ind_activity_flag >= 0.5", 0.7),
    )),
    ("SYNTHETIC_IDENTITY", (
        ("High-risk flag set (F670=1)", "ind_high_risk_flag >= 0.9", 1.2),
        ("Low-income occupation (student/agriculture)",
         "occupation IN ('student', 'agriculture')", 1.2),
        ("Very new account (low tenure)", "F2956 <= 35", 1.0),
        ("Fraud registry match (F3912=1)", "F3912 >= 1", 0.8),
    )),
    ("NETWORK_HUB", (
        ("High activity (F115)", "ind_activity_flag >= 0.75", 1.0),
        ("Wide inbound counterparty spread (F527)", "F527 >= 0.6", 1.0),
        ("Wide outbound counterparty spread (F531)", "F531 >= 0.6", 1.0),
    )),
)

REPORT_SECTIONS = (
    "EXECUTIVE SUMMARY",
    "RISK ASSESSMENT",
    "KEY FRAUD INDICATORS",
    "MULE TYPOLOGY ASSESSMENT",
    "ACCOUNT PROFILE ANALYSIS",
    "RECOMMENDED ACTIONS",
    "REGULATORY NOTE",
)

REGULATORY_NOTES = {
    "CRITICAL": (
        "RBI Master Direction on KYC (2016, as amended) and the RBI mule-account "
        "advisories require immediate account freeze. File a Suspicious Transaction "
        "Report (STR) with FIU-IND under the PMLA, 2002. SAR recommended: YES."
    ),
    "HIGH": (
        "Under the RBI KYC Master Direction, apply enhanced due diligence and "
        "step-up authentication. Prepare an STR draft for FIU-IND review. "
        "SAR recommended: YES (pending confirmation)."
    ),
    "MEDIUM": (
        "RBI risk-based monitoring guidelines apply. Place under enhanced "
        "transaction monitoring; no STR at this stage. SAR recommended: NO (monitor)."
    ),
    "LOW": (
        "No regulatory action indicated under current RBI guidance. Routine "
        "logging only. SAR recommended: NO."
    ),
}

# pandas' default missing-value tokens for text input.
NULL_TOKENS = (
    "", "NA", "N/A", "n/a", "NaN", "nan", "-NaN", "-nan", "NULL", "null",
    "None", "<NA>", "#N/A", "#NA", "#N/A N/A", "1.#IND", "-1.#IND",
    "1.#QNAN", "-1.#QNAN",
)

# Dashboard constants: exposure per mule in lakh, accounts per campaign / community.
EXPOSURE_PER_MULE_LAKH = 14.4
MULES_PER_CAMPAIGN = 3
MULES_PER_COMMUNITY = 5
CAMPAIGN_EXPOSURE_FACTOR = 0.18

# Risk propagation factors by link type (entity to neighbour).
PROPAGATION_FACTORS = {"transferred_to": 0.4, "shares_ip": 0.8, "shares_device": 0.8}


@dataclass(frozen=True)
class RiskConfig:
    """Column roles and dictionaries for one account table."""

    key: str = "account_id"
    target: str = TARGET_COLUMN
    leakage: str = LEAKAGE_FEATURE
    index_column: str = INDEX_COLUMN
    standing_col: str = "F3889"
    occupation_col: str = "F3891"
    tenure_col: str = "F2956"
    activity_col: str = "F115"
    legitimacy_col: str = "F2082"
    activity_count_col: str = "F3043"
    high_risk_col: str = "F670"
    age_col: str = "F3894"
    hints: tuple = DOMAIN_HINT_FEATURES
    top_k: int = TOP_K_FEATURES
    seed: int = RANDOM_STATE
    pos_weight: float | None = None  # None = measured legit/mule ratio
    missing_threshold: float = MISSING_INDICATOR_THRESHOLD
    flag_threshold: float = FLAG_THRESHOLD
    feature_names: dict = field(default_factory=lambda: dict(FEATURE_NAMES))
    hint_meanings: dict = field(default_factory=lambda: dict(DOMAIN_HINT_MEANINGS))
    occupation_rates: dict = field(default_factory=lambda: dict(OCCUPATION_MULE_RATE))
    standing_rates: dict = field(default_factory=lambda: dict(STANDING_MULE_RATE))
    rules: tuple = TYPOLOGY_RULES

    @property
    def categorical(self) -> tuple:
        return (self.standing_col, self.occupation_col)


DEFAULT_CONFIG = RiskConfig()
