"""Discovery rankings: seven categories scored in one pass, ranked, carded and kept as history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from stakewatch import params
from stakewatch.functions.identity import stable_id
from stakewatch.functions.numeric import clamp, fixed_text, round_to
from stakewatch.functions.roles import role_label
from stakewatch.functions.text import tokens
from stakewatch.operators.grouping import first_per_key, rank_rows, top_per_key
from stakewatch.operators.total_order import numbered


def number(name: str, default: float = 0.0) -> Column:
    return F.coalesce(F.col(name).cast("double"), F.lit(default))


def section_number(category: Column) -> Column:
    """Place of a category in the fixed order of sections, from 1; 0 when it is none of them."""
    return F.array_position(F.array(*map(F.lit, params.CATEGORIES)), category).cast("int")


def category_rules() -> dict[str, tuple[Column, Column]]:
    """Category -> (qualifies, score). The limits and shares are fixed values of the ranking definitions."""
    conviction, behavior = number("conviction_score"), number("behavior_change_score")
    first = F.coalesce("first_ever_purchase", F.lit(False))
    depth = F.when(F.col("history_depth").isin("usable", "deep"), F.lit(100.0)).otherwise(F.lit(40.0))
    own, gap = number("ownership_increase_percent"), number("days_since_previous_purchase")
    buyers = number("unique_buyers", 1.0)
    acceleration = number("acceleration_score")
    drawdown = F.abs(F.least(F.lit(0.0), number("drawdown_52w")))
    cap = number("market_cap")
    cap_score = F.when(cap <= 1e9, F.lit(100.0)).otherwise(F.greatest(F.lit(0.0), F.lit(100.0) - (cap - 1e9) / 9e7))
    direct = F.when(F.col("direct_indirect_code") == "D", F.lit(100.0)).otherwise(F.lit(30.0))
    usable = F.coalesce(F.col("history_quality"), F.lit("acceptable")) != "unusable"
    return {
        "breaking_habits": (
            first | (number("purchase_multiple") >= 2),
            number("abnormality_score") * 0.45
            + number("historical_percentile") * 0.25
            + number("robust_z_display") * 0.2 * 10
            + depth * 0.1,
        ),
        "quiet_buyers": (
            (gap >= 365) | first,
            number("silence_break_score") * 0.5 + own * 0.25 + conviction * 0.25,
        ),
        "wolf_packs": (
            buyers >= 2,
            number("cluster_score") * 0.45 + conviction * 0.3 + F.least(F.lit(100.0), buyers * 25) * 0.25,
        ),
        "growing_positions": (
            own > 0,
            F.least(F.lit(100.0), own * 2) * 0.45 + conviction * 0.35 + direct * 0.2,
        ),
        "accelerating": (
            (acceleration > 0) & (number("acceleration_sample_count") >= 2),
            acceleration * 0.6 + conviction * 0.4,
        ),
        "contrarian": (
            (drawdown >= 0.15) & (conviction >= 50) & usable,
            conviction * 0.55 + F.least(F.lit(100.0), drawdown * 200) * 0.45,
        ),
        "under_the_radar": (
            F.coalesce("discovery_eligible", F.lit(True)) & ((cap == 0) | (cap <= 1e10)),
            conviction * 0.45 + behavior * 0.4 + cap_score * 0.15,
        ),
    }


def headline(category: Column, role: Column | None = None) -> Column:
    """Headline of a ranked purchase; the texts are fixed values. ``role`` is the buyer's label where it is known already."""
    role = role_label(F.col("normalized_roles")) if role is None else role
    buyers, gap = number("buyer_count"), number("days_since_previous_purchase")
    own, multiple = number("ownership_increase_percent"), number("purchase_multiple")
    return (
        F.when(
            (category == "wolf_packs") & (buyers >= 2),
            F.concat(buyers.cast("int").cast("string"), F.lit(" insiders bought within 14 days")),
        )
        .when(
            (category == "quiet_buyers") & (gap > 0),
            F.concat(F.lit("First open-market purchase in "), fixed_text(gap / 365.25, 1), F.lit(" years")),
        )
        .when(
            (category == "growing_positions") & (own > 0),
            F.concat(role, F.lit(" increased direct holdings by "), fixed_text(own, 0), F.lit("%")),
        )
        .when(category == "accelerating", F.lit("Purchase size and frequency are accelerating"))
        .when(multiple > 0, F.concat(role, F.lit(" purchase was "), fixed_text(multiple, 1), F.lit("× larger than prior median")))
        .when(
            F.coalesce("first_ever_purchase", F.lit(False)),
            F.concat(F.lit("First recorded open-market purchase by "), F.lower(role)),
        )
        .otherwise(F.concat(F.lit("Unusual open-market purchase by "), F.lower(role)))
    )


RANKING_COLUMNS = [
    "rank",
    "ranking_category",
    "event_id",
    "ticker",
    "issuer_cik",
    "company_name",
    "market_cap",
    "sector",
    "industry",
    "buyer_count",
    "qualifying_operating_executive_count",
    "latest_transaction_date",
    "latest_filing_date",
    "purchase_value",
    "purchase_multiple",
    "ownership_increase_percent",
    "days_since_previous_purchase",
    "abnormality_score",
    "silence_break_score",
    "cluster_score",
    "behavior_change_score",
    "conviction_score",
    "score_quality",
    "discovery_eligibility",
    "headline",
    "reason_codes",
    "source_accession_numbers",
    "stable_key",
    "ranking_score",
]


def discovery_rows(signals: DataFrame, categories: list[str] | None = None) -> DataFrame:
    """Qualifying purchases with their score, one row per category they qualify for; the signals are read once."""
    rules = category_rules()
    entries = [
        F.when(rule, F.struct(F.lit(name).alias("ranking_category"), round_to(score, 6).alias("ranking_score")))
        for name, (rule, score) in rules.items()
        if categories is None or name in categories
    ]
    spread = signals.withColumn("_entry", F.explode(F.array_compact(F.array(*entries)))).select("*", "_entry.*").drop("_entry")
    spread = spread.withColumn("buyer_count", number("unique_buyers", 1.0).cast("int"))
    accession = F.coalesce("accession_number", F.lit(""))
    zero = {c: number(c) for c in (
        "market_cap", "purchase_value", "abnormality_score", "silence_break_score", "cluster_score",
        "behavior_change_score", "conviction_score",
    )}
    return spread.withColumns(
        {
            "headline": headline(F.col("ranking_category")),
            "stable_key": stable_id(F.col("ranking_category"), F.col("issuer_cik"), F.col("event_id"), accession),
            "qualifying_operating_executive_count": number("unique_operating_executives", 1.0).cast("int"),
            "latest_transaction_date": F.col("transaction_date"),
            "latest_filing_date": F.col("filing_date"),
            "score_quality": F.coalesce("history_quality", F.lit("acceptable")),
            "discovery_eligibility": F.coalesce("discovery_eligible", F.lit(True)),
            "source_accession_numbers": accession,
            **zero,
        }
    )


def rank_discoveries(signals: DataFrame, categories: list[str] | None = None, digits: tuple[str, ...] = ("stable_key",)) -> DataFrame:
    """Ranked rows of the categories: score, then conviction, ticker and key; ranks start at 1 per category. ``digits`` names the
    columns that hold digits of a hash: their bytes have the same order and half the length."""
    # Only what a ranked row shows goes through the order, not the many columns of a signal; headlines are made as rows are read.
    rows = discovery_rows(signals, categories).withColumns({"_role": role_label(F.col("normalized_roles")), **{c: F.unhex(c) for c in digits}})
    rows = rows.select(*[c for c in RANKING_COLUMNS if c not in ("rank", "headline")], "first_ever_purchase", "_role")
    scores = [F.col("ranking_score"), F.col("conviction_score")]
    ranked = rank_rows(rows, ["ranking_category"], scores, [F.col("ticker"), F.col("stable_key")])
    shown = {"headline": headline(F.col("ranking_category"), F.col("_role")), **{c: F.lower(F.hex(c)) for c in digits}}
    return ranked.withColumns(shown).select(*RANKING_COLUMNS)


def ranking_cards(ranked: DataFrame) -> DataFrame:
    """Ranked rows as cards: list texts split, empty texts missing."""
    def text(name: str) -> Column:
        return F.nullif(name, F.lit(""))

    return ranked.select(
        "rank", F.col("ranking_category").alias("category"), text("ticker").alias("ticker"), "issuer_cik", text("company_name").alias("company_name"),
        "headline", "purchase_value", "purchase_multiple", "ownership_increase_percent", "buyer_count",
        F.col("qualifying_operating_executive_count").alias("operating_executive_count"), "behavior_change_score", "conviction_score",
        "abnormality_score", "silence_break_score", "cluster_score", "market_cap", "sector", "industry",
        F.col("latest_transaction_date").alias("transaction_date"), F.col("latest_filing_date").alias("filing_date"), F.col("score_quality").alias("quality"),
        F.col("discovery_eligibility").alias("discovery_eligible"), "reason_codes", tokens(F.col("source_accession_numbers")).alias("source_accession_numbers"),
    )


def normalized_rows(ranked: DataFrame, category: str) -> DataFrame:
    """Rows of one ranking with ``rank``, ``ranking_category`` and ``category``: where a table has no ranks its rows are numbered by
    conviction (or ``score``), ticker and company number, where it names no category it gets the given one."""
    names = set(ranked.columns)
    out = ranked if "ranking_category" in names else ranked.withColumn("ranking_category", F.lit(category))
    out = out if "category" in names else out.withColumn("category", F.col("ranking_category"))
    if "rank" in names:
        return out
    score = number("conviction_score" if "conviction_score" in names else "score") if names & {"conviction_score", "score"} else F.lit(0.0)
    ties = [F.asc(c) for c in ("ticker", "issuer_cik") if c in names]
    rest = [F.asc(F.xxhash64(*[c for c in ranked.columns]))]
    return numbered(out, ["ranking_category"], [score.desc_nulls_last(), *ties, *rest])


def normalized_order(ranked: DataFrame) -> DataFrame:
    """Rows in page order: rank, then conviction, ticker and company number."""
    return ranked.orderBy(F.coalesce(F.col("rank").cast("double"), F.lit(1e9)), F.desc("conviction_score"), "ticker", "issuer_cik")


def sections(ranked: DataFrame, size: int) -> DataFrame:
    """First items of every category. Ranks are known, so this is a filter that reaches the scan."""
    return ranked.filter(F.col("rank") <= size)


def section_lists(ranked: DataFrame, size: int) -> DataFrame:
    """One row per category: its full count and its first items as a list of at most ``size``."""
    counts = ranked.groupBy("ranking_category").agg(F.count(F.lit(1)).alias("count"))
    cards = ranking_cards(sections(ranked, size))
    items = cards.groupBy(F.col("category").alias("ranking_category")).agg(F.array_sort(F.collect_list(F.struct(*[c for c in cards.columns]))).alias("items"))
    return counts.join(items, "ranking_category")


def snapshot_keys(ranked: DataFrame) -> DataFrame:
    score = F.col("ranking_score").cast("string")
    return ranked.withColumn("snapshot_key", stable_id(F.col("stable_key"), score, F.col("rank")))


def append_history(history: DataFrame, latest: DataFrame, shown: list[str] | None = None) -> DataFrame:
    """Rows of the latest ranking that the history does not hold yet, by snapshot key; each key once. Only the ``shown`` columns are
    sent with the keys, all where none are named."""
    keyed = snapshot_keys(latest)
    keyed = keyed if shown is None else keyed.select("snapshot_key", *shown)
    fresh = first_per_key(keyed, ["snapshot_key"], [F.col("ranking_category"), F.col("rank")])
    return fresh.join(history.select("snapshot_key"), "snapshot_key", "left_anti")


def first_across_sections(items: DataFrame) -> DataFrame:
    """One item per company over all sections: the earliest section, then the best rank."""
    identity = F.lower(F.concat_ws("|", *[F.nullif(c, F.lit("")) for c in ("issuer_cik", "ticker", "company_name")]))
    keyed = items.withColumn("_key", identity).filter("_key <> ''")
    return first_per_key(keyed, ["_key"], [section_number(F.col("ranking_category")), F.col("rank")]).drop("_key")


def latest_stories(signals: DataFrame, ranked: DataFrame, count: int = 6) -> DataFrame:
    """Newest purchases, one per ticker, day and person, filled up from the rankings where they are too few.

    Only the first ``count`` candidates of each source are ever compared. Both sources are cut with top-k.
    """
    beats = first_per_key(
        signals.select("ticker", "transaction_date", "insider_id", "event_id", "headline", "purchase_value", "conviction_score").filter("ticker <> ''"),
        ["ticker", "transaction_date", "insider_id"], [F.col("conviction_score"), F.col("event_id")],
    )
    newest = beats.orderBy(F.desc("transaction_date"), F.asc("conviction_score"), F.desc("event_id")).limit(count)
    first = newest.select(
        F.lit(0).alias("_source"),
        F.col("event_id").alias("id"), "ticker", F.col("transaction_date").alias("date"), F.col("purchase_value").alias("value"),
        F.row_number().over(Window.orderBy(F.desc("transaction_date"), F.asc("conviction_score"), F.desc("event_id"))).alias("_n"),
    )
    cards = first_per_key(
        ranked.select("ticker", "latest_filing_date", "headline", "ranking_category", "rank", "purchase_value", "stable_key"),
        ["ticker", "latest_filing_date", "headline"], [section_number(F.col("ranking_category")), F.col("rank")],
    )
    order = [section_number(F.col("ranking_category")), F.col("rank")]
    filled = cards.orderBy(*order).limit(count).select(
        F.lit(1).alias("_source"), F.concat_ws("-", "ticker", F.col("latest_filing_date").cast("string"), "headline").alias("id"),
        "ticker", F.col("latest_filing_date").alias("date"), F.col("purchase_value").alias("value"), F.row_number().over(Window.orderBy(*order)).alias("_n"),
    )
    return first.unionByName(filled).orderBy("_source", "_n").limit(count).select("id", "ticker", "date", "value")


def change_groups(feed: DataFrame, size: int = 5) -> DataFrame:
    """First items of each kind of change, in feed order."""
    kinds = ["new_cluster", "silence_break", "conviction_increase"]
    spread = feed.withColumn("change_type", F.explode("change_types")).filter(F.col("change_type").isin(kinds))
    order = [F.desc("filing_date"), F.desc("conviction"), F.desc("purchase_value"), F.asc("id")]
    return top_per_key(spread, ["change_type"], order, size)
