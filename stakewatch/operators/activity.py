"""Period queries over purchases and discoveries: windows, summaries, feed, sectors, calendar, merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from stakewatch.functions.dates import filing_delay, parse_date
from stakewatch.functions.narrative import feed_detail, feed_summary
from stakewatch.functions.numeric import change_percent, clamp, ratio, round_to, safe_number
from stakewatch.functions.text import display_ticker, first_text, usable_text
from stakewatch.operators.grouping import exact_median, first_per_key, last_per_key, rank_rows
from stakewatch.operators.total_order import laid_out
from stakewatch.operators.rankings import section_number

PERIOD_DAYS = {"1d": 1, "7d": 7, "30d": 30, "90d": 90}


def company_identity(cik: str = "issuer_cik", ticker: str = "ticker", name: str = "company_name") -> Column:
    parts = [usable_text(F.col(cik)), F.upper(usable_text(F.col(ticker))), F.lower(usable_text(F.col(name)))]
    return F.concat_ws("|", *[F.nullif(p, F.lit("")) for p in parts])


def buyer_identity() -> Column:
    return first_text(F.col("owner_cik"), F.lower("owner_name"))


def change_types() -> Column:
    def n(name: str) -> Column:
        return F.coalesce(F.col(name).cast("double"), F.lit(0.0))

    return F.array_compact(
        F.array(
            F.when((n("buyer_count") >= 2) | (n("cluster_score") >= 60), F.lit("new_cluster")),
            F.when((n("silence_break_score") >= 60) | (n("days_since_previous_purchase") >= 365), F.lit("silence_break")),
            F.when((n("conviction_score") >= 75) & (n("behavior_change_score") >= 60), F.lit("conviction_increase")),
            F.when(n("purchase_value") >= 500_000, F.lit("large_purchase")),
        )
    )


ACTIVITY_COLUMNS = [
    "filing_date", "transaction_date", "ticker", "issuer_cik", "company_name", "sector", "industry", "company_slug",
    "owner_cik", "owner_name", "purchase_value", "buyer_count", "conviction_score", "behavior_change_score",
    "cluster_score", "silence_break_score", "days_since_previous_purchase", "headline",
]


COMPANY_TEXTS = ["issuer_cik", "company_name", "sector", "industry"]


def resolve_company(rows: DataFrame, companies: DataFrame, keep: bool, more: tuple[str, ...] = ()) -> DataFrame:
    """Rows with their company by number, else by upper-case ticker; unmatched rows stay only with ``keep``. ``more`` names further
    columns of the companies to bring.

    The lookup is first made unique per key (last one wins), so neither join multiplies rows.
    """
    place = [F.col("slug")]
    known = companies.select(
        "issuer_cik", F.upper("ticker").alias("ticker"), "company_name", "sector", "industry", "market_cap", "slug", *more
    )
    by_cik = last_per_key(known.filter("issuer_cik <> ''"), ["issuer_cik"], place)
    by_ticker = last_per_key(known.filter("ticker <> ''"), ["ticker"], place)
    left = rows.withColumns({"_cik": usable_text(F.col("issuer_cik")), "_ticker": display_ticker(F.col("ticker"))})
    first = by_cik.select(F.col("issuer_cik").alias("_cik"), F.struct(*known.columns).alias("_by_cik"))
    second = by_ticker.select(F.col("ticker").alias("_ticker"), F.struct(*known.columns).alias("_by_ticker"))
    out = left.join(first, "_cik", "left").join(second, "_ticker", "left")
    out = out.withColumn("company", F.coalesce("_by_cik", "_by_ticker")).drop("_cik", "_ticker", "_by_cik", "_by_ticker")
    return out if keep else out.filter(F.col("company").isNotNull())


def activity_events(daily: DataFrame, discoveries: DataFrame, companies: DataFrame) -> DataFrame:
    """Daily purchases and discoveries in one form, matched to a company, one row per six-part key.

    Daily rows come first, then discoveries by category and rank; the first row of a key is kept.
    """
    both = daily.withColumns({"_source": F.lit(0), "_rank": F.lit(0)}).unionByName(
        discoveries.withColumns({"_source": F.lit(1), "_rank": F.col("rank")}), allowMissingColumns=True
    )
    # Texts of a company are read once for the company, not for each of its rows.
    read = {"_shown": display_ticker(F.upper("ticker")), **{f"_{c}": F.nullif(usable_text(F.col(c)), F.lit("")) for c in COMPANY_TEXTS}}
    matched = resolve_company(both, companies.withColumns(read), keep=False, more=tuple(read))
    company = F.col("company")

    def text(name: str, *fallbacks: Column) -> Column:
        return F.coalesce(company[f"_{name}"], F.nullif(usable_text(F.col(name)), F.lit("")), *fallbacks, F.lit(""))

    filed = F.coalesce("filing_date", "transaction_date")
    traded = F.coalesce("transaction_date", "filing_date")
    rows = matched.withColumn("_shown", company["_shown"]).filter((F.col("_shown") != "") & filed.isNotNull()).select(
        filed.alias("filing_date"),
        traded.alias("transaction_date"),
        F.col("_shown").alias("ticker"),
        text("issuer_cik").alias("issuer_cik"),
        text("company_name", F.col("_shown")).alias("company_name"),
        text("sector").alias("sector"),
        text("industry").alias("industry"),
        company["slug"].alias("company_slug"),
        usable_text(F.col("owner_cik")).alias("owner_cik"),
        usable_text(F.col("owner_name")).alias("owner_name"),
        safe_number(F.col("purchase_value")).alias("purchase_value"),
        F.greatest(F.lit(1), F.coalesce(F.col("buyer_count").cast("int"), F.lit(0))).alias("buyer_count"),
        *[safe_number(F.col(c)).alias(c) for c in (
            "conviction_score", "behavior_change_score", "cluster_score", "silence_break_score", "days_since_previous_purchase")],
        usable_text(F.col("headline")).alias("headline"),
        "_source", "_rank", section_number(F.coalesce("ranking_category", F.lit(""))).alias("_section"), "event_id",
    )
    rows = rows.withColumn("_who", F.coalesce(F.nullif("owner_cik", F.lit("")), "owner_name"))
    # Values first: rows sort by what differs most, so that few are compared beyond it.
    keys = ["purchase_value", "filing_date", "transaction_date", "issuer_cik", "ticker", "_who"]
    order = [F.col(c) for c in ("_source", "_section", "_rank", "event_id")]
    return first_per_key(rows, keys, order).select(*ACTIVITY_COLUMNS)


def in_period(items: DataFrame, period: str = "7d", anchor: Column | None = None) -> DataFrame:
    """Rows of the period ending at the anchor (else the newest filing date) and of the equally long one before,
    told apart by ``is_current``. The anchor is one scalar; both ranges are pushed to the scan as date filters."""
    days = PERIOD_DAYS[period]
    end = anchor if anchor is not None else items.agg(F.max("filing_date")).scalar()
    start = F.date_sub(end, days - 1)
    previous = F.date_sub(start, days)
    inside = items.filter((F.col("filing_date") >= previous) & (F.col("filing_date") <= end))
    return inside.withColumns({"is_current": F.col("filing_date") >= start, "period_start": start, "period_end": end})


def period_summary(items: DataFrame) -> DataFrame:
    """Six metrics of the current and the previous period."""
    typed = items.withColumn("_types", change_types())
    return typed.groupBy("is_current").agg(
        F.count(F.lit(1)).alias("purchases"),
        F.countDistinct(F.nullif(company_identity(), F.lit(""))).alias("companies"),
        F.countDistinct(F.nullif(buyer_identity(), F.lit(""))).alias("buyers"),
        F.round(F.sum("purchase_value"), 2).alias("purchase_value"),
        F.count_if(F.array_contains("_types", "new_cluster")).alias("new_clusters"),
        F.count_if(F.array_contains("_types", "silence_break")).alias("silence_breaks"),
    )


PERIOD_METRICS = ["purchases", "companies", "buyers", "purchase_value", "new_clusters", "silence_breaks"]


def period_change(summary: DataFrame) -> DataFrame:
    """Metric rows: current, previous and percent change."""
    def at(current: bool, name: str) -> Column:
        return F.coalesce(F.max(F.when(F.col("is_current") == current, F.col(name).cast("double"))), F.lit(0.0))

    wide = summary.agg(
        F.array(*[F.struct(F.lit(m).alias("metric"), at(True, m).alias("current"), at(False, m).alias("previous")) for m in PERIOD_METRICS]).alias("m")
    )
    return wide.select(F.inline("m")).withColumn("change_percent", change_percent(F.col("current"), F.col("previous")))


def activity_feed(items: DataFrame, costs: DataFrame | None = None) -> DataFrame:
    """One row per filing date and company with the union of what changed, its size, delay and text.

    ``costs`` gives ``percent_vs_cost`` by ``ticker``, how far the latest price is from what buyers paid on average; where it
    is known the text says so."""
    typed = items.filter("ticker <> ''").withColumns({"_company": company_identity(), "_types": change_types(), "_buyer": F.nullif(buyer_identity(), F.lit(""))})
    place = F.struct("transaction_date", "purchase_value", "owner_cik", "headline")
    grouped = typed.groupBy("filing_date", "_company").agg(
        F.min_by(F.struct("transaction_date", F.upper("ticker").alias("ticker"), "company_name", "company_slug", "sector"), place).alias("_first"),
        F.countDistinct("_buyer").alias("_buyers"),
        F.max("buyer_count").alias("_reported"),
        F.round(F.sum("purchase_value"), 2).alias("purchase_value"),
        F.max("conviction_score").alias("conviction"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("_types")))).alias("change_types"),
    )
    buyers = F.greatest(F.col("_buyers"), F.col("_reported").cast("bigint"), F.lit(1).cast("bigint"))
    out = grouped.select(
        F.concat_ws("|", F.col("filing_date").cast("string"), "_company").alias("id"),
        "filing_date",
        F.col("_first.transaction_date").alias("transaction_date"),
        F.col("_first.ticker").alias("ticker"),
        first_text(F.col("_first.company_name"), F.col("_first.ticker")).alias("company_name"),
        F.col("_first.company_slug").alias("company_slug"),
        first_text(F.col("_first.sector"), fallback="Unclassified").alias("sector"),
        "purchase_value",
        buyers.alias("buyer_count"),
        F.greatest("conviction", F.lit(0.0)).alias("conviction"),
        "change_types",
    )
    out = out.withColumn("percent_vs_cost", F.lit(None).cast("double")) if costs is None else out.join(costs.select("ticker", "percent_vs_cost"), "ticker", "left")
    return out.withColumns(
        {
            "filing_delay_days": filing_delay(F.col("transaction_date"), F.col("filing_date")),
            "summary": feed_summary(F.col("ticker"), F.col("buyer_count"), F.col("change_types")),
            "detail": feed_detail(F.col("buyer_count"), F.col("purchase_value"), F.col("percent_vs_cost")),
        }
    ).drop("percent_vs_cost")


def filter_feed(feed: DataFrame, sector: str = "all", change: str = "all", min_value: float = 0.0, min_buyers: int = 1) -> DataFrame:
    out = feed.filter((F.col("purchase_value") >= min_value) & (F.col("buyer_count") >= min_buyers))
    if sector != "all":
        out = out.filter(F.col("sector") == sector)
    if change != "all":
        out = out.filter(F.array_contains("change_types", change))
    return out


def feed_by_day(feed: DataFrame) -> DataFrame:
    """Feed items with their place inside their filing day, as rows (a day may hold any number of them)."""
    return rank_rows(feed, ["filing_date"], [F.col("conviction"), F.col("purchase_value")], [F.asc("id")], "place")


def sector_acceleration(items: DataFrame) -> DataFrame:
    """Current against previous purchases per sector from one pass over both periods."""
    sector = first_text(F.col("sector"), fallback="Unclassified")
    now = F.col("is_current")
    grouped = items.groupBy(sector.alias("sector")).agg(
        F.count_if(now).alias("current_purchases"),
        F.count_if(~now).alias("previous_purchases"),
        F.countDistinct(F.when(now, F.nullif(company_identity(), F.lit("")))).alias("companies"),
        F.countDistinct(F.when(now, F.nullif(buyer_identity(), F.lit("")))).alias("buyers"),
        F.round(F.coalesce(F.sum(F.when(now, F.col("purchase_value"))), F.lit(0.0)), 2).alias("purchase_value"),
    )
    current, previous = F.col("current_purchases").cast("double"), F.col("previous_purchases")
    return grouped.filter("current_purchases > 0").withColumn(
        "multiplier", F.when(previous > 0, current / F.nullif(previous, F.lit(0))).otherwise(current)
    )


# --- daily and sector figures -----------------------------------------------------------------------------------

def sector_figures(signals: DataFrame) -> DataFrame:
    """Figures per sector. The scores have four digits, so an exact median holds at most a million distinct values
    per sector, whatever the number of purchases; it is combined before the shuffle."""
    sector = first_text(F.col("sector"), fallback="Unclassified")
    return signals.groupBy(sector.alias("sector")).agg(
        F.count(F.lit(1)).alias("signal_count"),
        F.countDistinct("issuer_cik").alias("company_count"),
        F.countDistinct("insider_id").alias("buyer_count"),
        F.round(F.sum(F.coalesce("purchase_value", F.lit(0.0))), 2).alias("purchase_value"),
        F.median(F.coalesce("conviction_score", F.lit(0.0))).alias("median_conviction"),
        F.median(F.coalesce("behavior_change_score", F.lit(0.0))).alias("median_behavior_change"),
        F.count_if(F.col("cluster_score") > 0).alias("cluster_count"),
    )


def sector_activity(signals: DataFrame) -> DataFrame:
    """Sector ranking table: share of the issuers that are eligible among the signals themselves."""
    eligible = signals.agg(F.countDistinct(F.when(F.col("discovery_eligible"), F.col("issuer_cik")))).scalar()
    return sector_figures(signals).withColumn(
        "eligible_universe_share", F.col("company_count") / F.greatest(eligible, F.lit(1).cast("bigint"))
    )


def sector_payload(signals: DataFrame, companies: DataFrame) -> DataFrame:
    """Sector page: the company's sector where the signal has none, share of all eligible companies."""
    own = companies.select("issuer_cik", F.col("sector").alias("_sector"))
    joined = signals.drop("sector").join(own, "issuer_cik", "left").withColumn("sector", F.col("_sector"))
    eligible = companies.agg(F.count_if("discovery_eligible")).scalar()
    return sector_figures(joined).withColumn(
        "eligible_universe_share", round_to(F.col("company_count") / F.greatest(eligible, F.lit(1).cast("bigint")), 6)
    )


def daily_activity(events: DataFrame, signals: DataFrame) -> DataFrame:
    """Purchases per day with the scores of their signal (first one per event)."""
    scores = first_per_key(signals.select("event_id", "conviction_score"), ["event_id"], [F.col("conviction_score")])
    joined = events.select("event_id", "issuer_cik", "insider_id", "transaction_date", "purchase_value").join(scores, "event_id", "left")
    return joined.groupBy(F.col("transaction_date").alias("date")).agg(
        F.count(F.lit(1)).alias("event_count"),
        F.countDistinct("issuer_cik").alias("company_count"),
        F.countDistinct("insider_id").alias("buyer_count"),
        F.round(F.sum("purchase_value"), 2).alias("purchase_value"),
        F.median(F.coalesce("conviction_score", F.lit(0.0))).alias("median_conviction"),
        F.max("purchase_value").alias("largest_purchase"),
    )


def daily_bars(events: DataFrame, keys: list[str]) -> DataFrame:
    """Bars of a timeline per entity and day."""
    return events.groupBy(*keys, F.col("transaction_date").alias("date")).agg(
        F.round(F.sum("purchase_value"), 2).alias("value"),
        F.avg("conviction_score").alias("conviction"),
        F.countDistinct("owner_cik").alias("buyer_count"),
        F.countDistinct(F.nullif(F.array_join("normalized_roles", "|"), F.lit(""))).alias("role_count"),
        F.greatest(F.max(F.coalesce("ownership_increase_percent", F.lit(0.0))), F.lit(0.0)).alias("ownership"),
        F.count(F.lit(1)).alias("event_count"),
    )


def latest_per_key(df: DataFrame, key: str, day: str, tie: str) -> DataFrame:
    return last_per_key(df, [key], [F.col(day), F.col(tie)])


def company_stats(events: DataFrame, signals: DataFrame) -> DataFrame:
    """Totals per company; exact medians of four-digit scores as in ``sector_figures``."""
    bought = events.groupBy("issuer_cik").agg(
        F.count(F.lit(1)).alias("purchase_event_count"),
        F.countDistinct("insider_id").alias("unique_buyer_count"),
        F.round(F.sum("purchase_value"), 2).alias("total_purchase_value"),
        F.max("purchase_value").alias("largest_purchase_value"),
    )
    scored = signals.groupBy("issuer_cik").agg(
        F.median("conviction_score").alias("median_conviction"), F.max("behavior_change_score").alias("highest_behavior_change")
    )
    return bought.join(scored, "issuer_cik", "left")


def person_profile(events: DataFrame, histories: DataFrame, signals: DataFrame) -> DataFrame:
    """Totals per person. Purchase values and gaps have no bound on distinct values, so their medians are counted."""
    bought = events.groupBy("insider_id").agg(
        F.count(F.lit(1)).alias("purchase_count"),
        F.countDistinct("issuer_cik").alias("company_count"),
        F.round(F.sum("purchase_value"), 2).alias("total_purchase_value"),
        F.max("purchase_value").alias("largest_purchase_value"),
    )
    values = exact_median(events, ["insider_id"], "purchase_value", "median_purchase_value")
    gaps = histories.filter("median_prior_gap_days <> 0").select("insider_id", "median_prior_gap_days")
    gap_medians = exact_median(gaps, ["insider_id"], "median_prior_gap_days", "median_days_between_purchases")
    best = signals.groupBy("insider_id").agg(
        F.max("behavior_change_score").alias("highest_behavior_change"), F.max("conviction_score").alias("highest_conviction")
    )
    return bought.join(values, "insider_id", "left").join(gap_medians, "insider_id", "left").join(best, "insider_id", "left")


# --- merges of ranked items -------------------------------------------------------------------------------------

STRENGTH_FIELDS = ["conviction", "behavior", "cluster", "buyers", "value"]


def ladder_score(prefix: str = "") -> Column:
    c = {name: F.col(prefix + name) for name in STRENGTH_FIELDS}
    return clamp(
        c["conviction"] * 0.45
        + c["behavior"] * 0.18
        + c["cluster"] * 0.22
        + F.least(c["buyers"], F.lit(6)) * 2.5
        + F.least(F.log10(F.greatest(c["value"], F.lit(1.0))) * 1.6, F.lit(10.0))
    )


def consensus_strength(prefix: str = "") -> Column:
    c = {name: F.col(prefix + name) for name in STRENGTH_FIELDS}
    return c["conviction"] * 3 + c["buyers"] * 22 + c["cluster"] + F.log10(F.greatest(c["value"], F.lit(1.0))) * 5


def landscape_strength(prefix: str = "") -> Column:
    c = {name: F.col(prefix + name) for name in STRENGTH_FIELDS}
    return c["conviction"] * 2 + c["behavior"] + F.log10(F.greatest(c["value"], F.lit(1.0))) * 8


STRENGTHS = {"consensus": consensus_strength, "landscape": landscape_strength, "ladder": ladder_score}


def with_largest_so_far(rows: DataFrame, key: str, place: str, columns: list[str]) -> DataFrame:
    """Adds ``_so_far_`` and the name of each column: its largest value over the key's rows at earlier places."""
    rows = laid_out(rows, [key], [F.asc(place)], "merged")
    ranges = rows.groupBy(key, "_range").agg(*[F.max(c).alias(f"_in_{c}") for c in columns])
    earlier = Window.partitionBy(key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select(key, "_range", *[F.max(f"_in_{c}").over(earlier).alias(f"_before_{c}") for c in columns])
    inside = Window.partitionBy(key, "_range").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    both = rows.join(ranges, [key, "_range"]).withColumns({f"_so_far_{c}": F.greatest(F.col(f"_before_{c}"), F.max(c).over(inside)) for c in columns})
    return both.drop("_range", "_at", *[f"_before_{c}" for c in columns])


def merge_companies(items: DataFrame, strength: str) -> DataFrame:
    """One row per company from ranked items of any number: largest figures, first named sector, and the headline of the
    last item that was stronger than everything merged before it.

    The largest figures so far combine in any grouping, so items are laid out in one total order, each range of it gives its
    maxima per company, and what came before a range is known from those; only the rows of one company in one range are ever
    walked through together.
    """
    identity = [usable_text(F.col("issuer_cik")), F.upper(usable_text(F.col("ticker"))), F.lower(usable_text(F.col("company_name")))]
    plain = items.select(
        F.concat_ws("|", *[F.nullif(p, F.lit("")) for p in identity]).alias("id"),
        F.upper(usable_text(F.col("ticker"))).alias("ticker"),
        usable_text(F.col("company_name"), "Company unavailable").alias("company_name"),
        usable_text(F.col("headline"), "Executive buying deserves attention.").alias("headline"),
        usable_text(F.col("sector"), "Unclassified").alias("sector"),
        F.greatest(F.lit(0.0), safe_number(F.col("market_cap"))).alias("market_cap"),
        clamp(safe_number(F.col("conviction_score"))).alias("conviction"),
        clamp(safe_number(F.col("behavior_change_score"))).alias("behavior"),
        clamp(safe_number(F.col("cluster_score"))).alias("cluster"),
        F.greatest(F.lit(0.0), safe_number(F.col("purchase_value"))).alias("value"),
        F.greatest(F.lit(1), F.coalesce("buyer_count", F.lit(1))).alias("buyers"),
        F.greatest(F.lit(0.0), safe_number(F.col("purchase_multiple"))).alias("multiple"),
        F.struct(section_number(F.col("ranking_category")).alias("section"), F.col("rank")).alias("_place"),
    ).filter("ticker <> ''")
    score = STRENGTHS[strength]
    merged = with_largest_so_far(plain.withColumn("_own", round_to(score(), 6)), "id", "_place", [*STRENGTH_FIELDS, "_own"])
    # The ladder keeps the best score of any item; the other two score the merged figures.
    held = F.col("_so_far__own") if strength == "ladder" else round_to(score("_so_far_"), 6)
    merged = merged.withColumn("_stronger", F.coalesce(F.col("_own") > held, F.lit(True)))
    named = F.col("sector") != "Unclassified"
    return merged.groupBy("id").agg(
        F.min_by("ticker", "_place").alias("ticker"),
        F.min_by("company_name", "_place").alias("company_name"),
        F.max_by("headline", F.when(F.col("_stronger"), F.col("_place"))).alias("headline"),
        F.coalesce(F.min_by("sector", F.when(named, F.col("_place"))), F.lit("Unclassified")).alias("sector"),
        *[F.max(c).alias(c) for c in ("market_cap", "conviction", "behavior", "cluster", "value", "buyers", "multiple")],
        F.max(round_to(ladder_score(), 6)).alias("rank_score"),
    )


def consensus_totals(merged: DataFrame) -> DataFrame:
    return merged.agg(
        F.sum("buyers").alias("total_buyers"),
        F.count_if(F.col("buyers") >= 2).alias("companies_with_multiple_buyers"),
        F.count_if(F.col("buyers") >= 3).alias("companies_with_three_or_more"),
        F.round(F.sum("value"), 2).alias("total_purchased"),
    )


def merge_day(signals: DataFrame) -> DataFrame:
    """Selected-day cards: one row per day and ticker with the largest figures and the first explicit headline."""
    default = "An executive disclosed a purchase."
    headline = usable_text(F.col("headline"), default)
    place = F.struct(-F.col("conviction_score"), -F.col("purchase_value"), F.col("event_id"))
    explicit = F.when(headline != default, headline)
    return signals.groupBy(F.col("transaction_date").alias("date"), F.upper("ticker").alias("ticker")).agg(
        F.max("purchase_value").alias("purchase_value"),
        F.max("conviction_score").alias("conviction"),
        F.max("behavior_change_score").alias("behavior"),
        F.max("unique_buyers").alias("buyer_count"),
        F.coalesce(F.min_by(explicit, F.when(explicit.isNotNull(), place)), F.lit(default)).alias("headline"),
    )


def calendar_rows(days: DataFrame, signals: DataFrame) -> DataFrame:
    """Calendar: the figures of each day with that day's purchases as rows, numbered by conviction and value."""
    placed = rank_rows(
        signals.select(F.col("transaction_date").alias("date"), "event_id", "ticker", "conviction_score", F.col("purchase_value").alias("value")),
        ["date"], [F.col("conviction_score"), F.col("value")], [F.asc("event_id")], "place",
    )
    return days.join(placed, "date", "left")


def newest_of(*tables: tuple[str, DataFrame, str]) -> DataFrame:
    """Rows and newest date per table, each from one aggregate over one column."""
    out = None
    for name, df, day in tables:
        one = df.agg(F.lit(name).alias("artifact"), F.count(F.lit(1)).alias("rows"), F.max(parse_date(F.col(day))).alias("newest"))
        out = one if out is None else out.unionByName(one)
    return out


def overview(lots: DataFrame, events: DataFrame, signals: DataFrame, companies: DataFrame, exceptional: float = 85.0) -> DataFrame:
    """Counts and market pulse of the first page, one row; one aggregate for each table."""
    def of(df: DataFrame, value: Column) -> Column:
        return df.agg(value).scalar()

    return signals.agg(
        of(lots, F.count(F.lit(1))).alias("normalized_transactions"), of(lots, F.count_if("is_qualifying_purchase")).alias("qualifying_purchases"),
        of(events, F.count(F.lit(1))).alias("purchase_events"), F.count(F.lit(1)).alias("event_signals"),
        F.countDistinct("issuer_cik").alias("company_signals"),
        of(companies, F.count(F.lit(1))).alias("companies"), of(companies, F.count_if("discovery_eligible")).alias("eligible_companies"),
        F.count_if(F.col("conviction_score") >= exceptional).alias("exceptional_signals"), F.count_if(F.col("cluster_score") > 0).alias("cluster_signals"),
        F.median("behavior_change_score").alias("median_behavior_change"), F.median("conviction_score").alias("median_conviction"),
        of(events, F.round(F.sum("purchase_value"), 2)).alias("total_reported_purchase_value"), F.countDistinct("issuer_cik").alias("active_company_count"),
    )


def quality_summary_of(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Records by table and quality (lower case, ``unknown`` where there is none)."""
    out = None
    for name, (df, column) in tables.items():
        quality = F.coalesce(F.nullif(F.lower(F.trim(F.col(column))), F.lit("")), F.lit("unknown"))
        one = df.groupBy(quality.alias("quality")).agg(F.count(F.lit(1)).alias("records")).select(F.lit(name).alias("artifact"), "quality", "records")
        out = one if out is None else out.unionByName(one)
    return out


def stage_status(tables: dict[str, DataFrame]) -> DataFrame:
    """Files, bytes, rows and last writing of every stage table, from what the file system knows and, for the rows, from the
    files' footers: no column is read."""
    out = None
    for name, df in tables.items():
        by_file = df.groupBy(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_modification_time").alias("at")).agg(F.count(F.lit(1)).alias("n"))
        one = by_file.agg(
            F.lit(name).alias("artifact"), F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.max("at").alias("written_at")
        )
        out = one if out is None else out.unionByName(one)
    return out


def outstanding_warnings(checked: DataFrame) -> DataFrame:
    """Rows with a warning by table (``artifact_name``, ``warnings``); texts that say none do not count."""
    said = ~F.lower(F.trim(F.coalesce(F.col("warnings").cast("string"), F.lit("")))).isin("", "nan", "none", "[]")
    return checked.groupBy("artifact_name").agg(F.count_if(said).alias("outstanding_warnings"))
