"""Parameters of the scoring jobs.

The weights of the behaviour and conviction scores, the penalties, the role values, the eligibility limits and the
role aliases are this project's own choice: the material the engine was surveyed from ships none.
Every group of weights sums to one (checked by ``operators.quality.check_weights``).
"""

BEHAVIOR_WEIGHTS = {
    "purchase_size_abnormality": 0.25,
    "silence_break": 0.20,
    "purchase_velocity": 0.10,
    "purchase_acceleration": 0.10,
    "ownership_increase": 0.15,
    "role_quality": 0.10,
    "history_quality": 0.10,
}

# weight name -> score column it applies to
BEHAVIOR_COLUMNS = {
    "purchase_size_abnormality": "abnormality_score",
    "silence_break": "silence_break_score",
    "purchase_velocity": "velocity_score",
    "purchase_acceleration": "acceleration_score",
    "ownership_increase": "ownership_score",
    "role_quality": "role_score",
    "history_quality": "history_quality_score",
}

CONVICTION_WEIGHTS = {
    "behavior_change": 0.30,
    "absolute_purchase_size": 0.15,
    "ownership_increase": 0.10,
    "cluster_confirmation": 0.15,
    "role_quality": 0.10,
    "direct_ownership": 0.05,
    "company_context": 0.05,
    "data_quality": 0.10,
}

PENALTIES = {
    "sparse_history": 5.0,
    "indirect_only": 8.0,
    "missing_price": 5.0,
    "microcap_or_illiquid": 7.0,
}

ROLE_QUALITY = {
    "founder_ceo": 100.0,
    "founder": 95.0,
    "ceo": 90.0,
    "cfo": 85.0,
    "coo": 75.0,
    "president": 75.0,
    "operating_executive": 70.0,
    "director": 50.0,
    "ten_percent_owner": 35.0,
    "other_officer": 45.0,
}

# Shares of the evidence score on the discovery page.
EVIDENCE_WEIGHTS = {
    "conviction": 0.34,
    "behavior_change": 0.18,
    "cluster": 0.15,
    "abnormality": 0.12,
    "silence_break": 0.08,
    "ownership": 0.06,
    "role_quality": 0.04,
    "data_quality": 0.03,
}

# Role groups: aliases found in an officer title -> roles they stand for.
ROLE_ALIASES = {
    "founder": (["founder"], ["founder"]),
    "co_founder": (["co-founder", "cofounder", "co founder"], ["founder"]),
    "ceo": (["ceo", "chief executive officer", "chief executive"], ["ceo", "operating_executive"]),
    "interim_ceo": (["interim ceo", "interim chief executive officer"], ["ceo", "operating_executive"]),
    "president_and_ceo": (
        ["president and ceo", "president & ceo", "president and chief executive officer"],
        ["ceo", "operating_executive", "president"],
    ),
    "cfo": (["cfo", "chief financial officer"], ["cfo", "operating_executive"]),
    "interim_cfo": (["interim cfo", "interim chief financial officer"], ["cfo", "operating_executive"]),
    "coo": (["coo", "chief operating officer"], ["coo", "operating_executive"]),
    "president": (["president"], ["operating_executive", "president"]),
    "chairman": (["chairman", "chairwoman", "chair"], ["director"]),
    "executive_chairman": (["executive chairman", "executive chair"], ["director", "operating_executive"]),
    "director": (["director"], ["director"]),
    "ten_percent_owner": (["10% owner", "ten percent owner"], ["ten_percent_owner"]),
    "other_officer": (["vice president", "evp", "svp", "treasurer", "secretary"], ["other_officer"]),
}
OPERATING_ROLES = ["ceo", "cfo", "coo", "president", "operating_executive"]

ELIGIBILITY = {
    "market_cap_min": 50e6,
    "market_cap_max": 10e9,
    "price_min": 1.0,
    "dollar_volume_min": 100e3,
    "excluded_types": ["etf", "fund", "warrant", "preferred"],
}

# Windows in days and in price sessions, page limits.
CAMPAIGN_GAP_WEEKDAYS = 5
CLUSTER_DAYS = 14
VELOCITY_DAYS = (30, 90, 180)
HISTORY_DAYS = {"purchase_count_1y": 365, "purchase_count_3y": 1095, "purchase_count_5y": 1825}
FORWARD_SESSIONS = (1, 5, 21, 63, 126, 252)
PRIOR_SESSIONS = (21, 63, 126)
STORY_SESSIONS = 756
STORY_POINTS = 260
STORY_MARKERS = 250

# Transaction codes of the public ownership forms that count as known.
TRANSACTION_CODES = list("ACDFGIJKLMPSUWXZ")

# Ranking categories in the order of the discovery sections.
CATEGORIES = [
    "breaking_habits",
    "quiet_buyers",
    "wolf_packs",
    "growing_positions",
    "accelerating",
    "contrarian",
    "under_the_radar",
]

# Groups with more events than this take the chunked order-statistics job instead of in-row arrays.
ARRAY_GROUP_LIMIT = 1024
