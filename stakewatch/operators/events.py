"""Purchase events from lots, ownership change, and campaigns from events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from stakewatch import params
from stakewatch.functions.dates import weekday_gap
from stakewatch.functions.identity import stable_id
from stakewatch.functions.numeric import ratio

EVENT_KEYS = [
    "issuer_cik",
    "owner_cik",
    "insider_id",
    "ticker",
    "transaction_date",
    "security_title",
    "direct_indirect_code",
    "accession_number",
]


def ownership_columns(acquired: Column, after: Column, code: Column) -> dict[str, Column]:
    before = after - acquired
    percent = F.when(before < 0, F.lit(None)).when(
        before == 0, F.when(acquired > 0, F.lit(100.0)).otherwise(F.lit(0.0))
    ).otherwise(ratio(acquired, before) * 100)
    known = acquired.isNotNull() & after.isNotNull()
    return {
        "holdings_before": before,
        "ownership_increase_percent": percent,
        "first_reported_position": F.when(known, (before == 0) & (acquired > 0)).otherwise(F.lit(False)),
        "ambiguous_ownership": F.when(known, ~F.coalesce(code, F.lit("")).isin("D", "I")).otherwise(F.lit(True)),
    }


def purchase_events(lots: DataFrame, active_only: bool = False) -> DataFrame:
    """One row per purchase: lots of one filing, person, day, security and ownership form together."""
    bought = lots.filter("is_qualifying_purchase")
    if active_only:
        bought = bought.filter("status = 'active'")
    grouped = bought.groupBy(*EVENT_KEYS).agg(
        F.max("filing_date").alias("filing_date"),
        F.sum("shares").alias("total_shares"),
        F.round(F.sum("reported_value"), 2).alias("purchase_value"),
        F.count(F.lit(1)).cast("int").alias("lot_count"),
        F.max("shares_owned_after").alias("reported_holdings_after"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("normalized_roles")))).alias("normalized_roles"),
        F.array_sort(F.array_remove(F.collect_set("footnotes"), "")).alias("footnotes"),
        F.when(F.bool_and(F.coalesce(F.col("quality") == "high", F.lit(False))), F.lit("high"))
        .otherwise(F.lit("acceptable"))
        .alias("event_quality"),
    )
    owned = ownership_columns(F.col("total_shares"), F.col("reported_holdings_after"), F.col("direct_indirect_code"))
    return grouped.withColumns(
        {
            "event_id": stable_id(*[F.col(k) for k in EVENT_KEYS]),
            "weighted_average_price": ratio(F.col("purchase_value"), F.col("total_shares")),
            **owned,
        }
    )


WHO = ["issuer_cik", "insider_id", "ticker"]


def purchase_runs(events: DataFrame, gap_weekdays: int = params.CAMPAIGN_GAP_WEEKDAYS) -> DataFrame:
    """Run number of each purchase day of a person in an issuer; a larger weekday gap starts a new run.

    Works on one row per person and day, so a person never holds more rows than the calendar has days.
    """
    days = events.select(*WHO, "transaction_date").distinct()
    timeline = Window.partitionBy(*WHO).orderBy("transaction_date")
    gap = weekday_gap(F.lag("transaction_date").over(timeline), F.col("transaction_date"))
    return (
        days.withColumn("_break", F.coalesce(gap > gap_weekdays, F.lit(False)).cast("int"))
        .withColumn("campaign_no", F.sum("_break").over(timeline.rowsBetween(Window.unboundedPreceding, 0)))
        .drop("_break")
    )


def purchase_campaigns(events: DataFrame, gap_weekdays: int = params.CAMPAIGN_GAP_WEEKDAYS) -> DataFrame:
    """One row per run. Its id comes from its first and last purchase and its size, so no row holds a list of all ids;
    ``campaign_members`` gives the purchases of each run as rows."""
    place = F.struct("transaction_date", "event_id")
    return (
        events.join(purchase_runs(events, gap_weekdays), [*WHO, "transaction_date"])
        .groupBy(*WHO, "campaign_no")
        .agg(
            F.min("transaction_date").alias("start_date"),
            F.max("transaction_date").alias("end_date"),
            F.round(F.sum("purchase_value"), 2).alias("purchase_value"),
            F.sum("total_shares").alias("total_shares"),
            F.count(F.lit(1)).cast("int").alias("event_count"),
            F.min(place)["event_id"].alias("first_event_id"),
            F.max(place)["event_id"].alias("last_event_id"),
        )
        .withColumn("campaign_id", stable_id(F.col("first_event_id"), F.col("last_event_id"), F.col("event_count")))
    )


def campaign_members(events: DataFrame, gap_weekdays: int = params.CAMPAIGN_GAP_WEEKDAYS) -> DataFrame:
    """Purchase to campaign, one row each."""
    placed = events.join(purchase_runs(events, gap_weekdays), [*WHO, "transaction_date"])
    ids = purchase_campaigns(events, gap_weekdays).select(*WHO, "campaign_no", "campaign_id")
    return placed.join(ids, [*WHO, "campaign_no"]).select("campaign_id", "event_id", "transaction_date")
