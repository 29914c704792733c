"""Strictly causal purchase history of each person in each issuer.

Everything that adds up (counts, sums, extremes, gaps) is taken on one row per person and day, at most as many rows
as the calendar has days, and joined back to the purchases of that day. What does not add up (medians, percentiles)
comes from ``prior_statistics``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from stakewatch import params
from stakewatch.functions.numeric import ratio

PERSON = ["issuer_cik", "insider_id"]
PERSON_DAY = [*PERSON, "transaction_date"]


#: Purchases of one person and day that one task may number by itself, and the buckets of days that are counted together.
DAY_ROWS = 20_000
DAY_BUCKETS = 1 << 20


def has_large_days(events: DataFrame, limit: int = DAY_ROWS) -> bool:
    """Whether any person may have more purchases on a day than ``limit``. Days are counted by buckets of their hash, so no day is
    missed and never more than ``DAY_BUCKETS`` counts leave a task."""
    bucket = F.pmod(F.xxhash64(*PERSON_DAY), F.lit(DAY_BUCKETS)).alias("_bucket")
    return not events.groupBy(bucket).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > limit).isEmpty()


def with_positions(events: DataFrame, digits: int = 2) -> DataFrame:
    """Adds the place of a purchase among those of its own day (by event id) and the day's running figures.

    Event ids are hashes, so their first ``digits`` cut a day into 16 to the power of ``digits`` even parts that keep its
    order. Each part is numbered on its own and then moved by what the parts before it hold. With no digits a day is one part,
    and nothing has to be moved; only where ``has_large_days`` is false.
    """
    part = F.substring("event_id", 1, digits)
    keyed = events.withColumn("_part", part)
    inside = Window.partitionBy(*PERSON_DAY, "_part").orderBy("event_id")
    if digits == 0:
        # Rows without a key meet no part either.
        keyed = events.dropna(subset=[*PERSON_DAY, "event_id"])
        inside = Window.partitionBy(*PERSON_DAY).orderBy("event_id")
    so_far = inside.rowsBetween(Window.unboundedPreceding, 0)
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    value = F.coalesce("purchase_value", F.lit(0.0))
    positive = F.when(value > 0, value)
    log_value = F.log1p(value)
    placed = keyed.withColumn("_day_place", F.row_number().over(inside) - 1).withColumns(
        {
            "_day_value": F.sum(value).over(so_far),
            "_day_logs": F.sum(log_value).over(so_far),
            "_day_placed_logs": F.sum(F.col("_day_place") * log_value).over(so_far),
            "_day_positive": F.coalesce(F.count_if(value > 0).over(before), F.lit(0)),
            "_day_largest": F.max(positive).over(before),
        }
    )
    if digits == 0:
        return placed
    parts = keyed.groupBy(*PERSON_DAY, "_part").agg(
        F.count(F.lit(1)).alias("n"), F.sum(value).alias("v"), F.sum(log_value).alias("l"), F.count_if(value > 0).alias("c"), F.max(positive).alias("m")
    )
    earlier = Window.partitionBy(*PERSON_DAY).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    moves = parts.select(
        *PERSON_DAY, "_part",
        *[F.coalesce(F.sum(x).over(earlier), F.lit(0)).alias(f"_before_{x}") for x in ("n", "v", "l", "c")],
        F.max("m").over(earlier).alias("_before_m"),
    )
    # Sum of place times log up to a purchase: what its own part gives, moved by the places before the part; what the
    # parts before give is the same sum at their ends.
    moved = placed.join(moves, [*PERSON_DAY, "_part"])
    own_part = F.col("_day_placed_logs") + F.col("_before_n") * F.col("_day_logs")
    ends = placed.groupBy(*PERSON_DAY, "_part").agg(F.max(F.struct("_day_place", "_day_logs", "_day_placed_logs")).alias("e"))
    ends = ends.join(moves.select(*PERSON_DAY, "_part", "_before_n"), [*PERSON_DAY, "_part"]).select(
        *PERSON_DAY, "_part", (F.col("e._day_placed_logs") + F.col("_before_n") * F.col("e._day_logs")).alias("_part_sum")
    )
    ends = ends.select(*PERSON_DAY, "_part", F.coalesce(F.sum("_part_sum").over(earlier), F.lit(0.0)).alias("_before_p"))
    return (
        moved.join(ends, [*PERSON_DAY, "_part"])
        .withColumns(
            {
                "_day_placed_logs": own_part + F.col("_before_p"),
                "_day_place": (F.col("_day_place") + F.col("_before_n")).cast("int"),
                "_day_value": F.col("_day_value") + F.col("_before_v"),
                "_day_logs": F.col("_day_logs") + F.col("_before_l"),
                "_day_positive": F.col("_day_positive") + F.col("_before_c"),
                "_day_largest": F.greatest("_day_largest", "_before_m"),
            }
        )
        .drop("_part", "_before_n", "_before_v", "_before_l", "_before_c", "_before_m", "_before_p")
    )


def daily_history(placed: DataFrame) -> DataFrame:
    """One row per person and day with everything known before that day.

    A day with n purchases stands for its distance to the day before and n - 1 gaps of zero. The zeros come as a
    second entry of the day with a weight, so exact gap medians need no list of purchases and no second pass.
    """
    days = placed.groupBy(*PERSON_DAY).agg(
        F.count(F.lit(1)).alias("_n"),
        F.count("purchase_value").alias("_known"),
        F.count_if(F.coalesce("purchase_value", F.lit(0.0)) > 0).alias("_positive"),
        F.sum("purchase_value").alias("_value"),
        F.max("purchase_value").alias("_largest"),
        F.max("_day_logs").alias("_logs"),
        F.sum(F.col("_day_place") * F.log1p(F.coalesce("purchase_value", F.lit(0.0)))).alias("_placed_logs"),
    )
    measures = [c for c in days.columns if c not in PERSON_DAY]
    in_order = Window.partitionBy(*PERSON).orderBy("transaction_date")
    whole = in_order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    previous = F.lag("transaction_date").over(in_order)
    days = days.withColumns(
        {
            "previous_purchase_date": previous,
            "days_since_previous_purchase": F.datediff("transaction_date", previous),
            "_first_gap": F.when(F.first("_n").over(whole) > 1, F.lit(0)).otherwise(
                F.datediff(F.nth_value("transaction_date", 2).over(whole), F.first("transaction_date").over(whole))
            ),
        }
    )
    one, zeros = F.lit(1).cast("bigint"), F.col("_n") - 1
    entries = F.array_compact(
        F.array(
            F.struct(F.lit(True).alias("day_itself"), F.col("days_since_previous_purchase").alias("gap"), one.alias("times")),
            F.when(zeros > 0, F.struct(F.lit(False).alias("day_itself"), F.lit(0).alias("gap"), zeros.alias("times"))),
        )
    )
    spread = days.withColumn("_entry", F.explode(entries)).withColumns(
        {
            "_day": F.unix_date("transaction_date"),
            "_gap": F.col("_entry.gap"),
            "_times": F.col("_entry.times"),
            **{c: F.when(F.col("_entry.day_itself"), F.col(c)) for c in measures},
        }
    )
    line = Window.partitionBy(*PERSON).orderBy("_day")
    before = line.rangeBetween(Window.unboundedPreceding, -1)

    def trailing(days_back: int) -> object:
        return line.rangeBetween(-days_back, -1)

    def total(col: str | Column, over: object) -> Column:
        return F.coalesce(F.sum(col).over(over), F.lit(0))

    out = spread.withColumns(
        {
            "prior_purchase_count": total("_n", before),
            **{name: total("_n", trailing(n)) for name, n in params.HISTORY_DAYS.items()},
            "cumulative_prior_purchase_value": F.coalesce(F.sum("_value").over(before), F.lit(0.0)),
            "prior_mean_purchase_value": ratio(F.sum("_value").over(before), F.sum("_known").over(before)),
            "largest_prior_purchase_value": F.max("_largest").over(before),
            "first_prior_purchase_date": F.min("transaction_date").over(before),
            "median_prior_gap_days": F.percentile("_gap", 0.5, F.col("_times")).over(before),
            "longest_prior_gap_days": F.max("_gap").over(before).cast("double"),
            "group_size": F.sum("_n").over(Window.partitionBy(*PERSON)),
            "_logs_before": total("_logs", before),
            "_positive_before": total("_positive", before),
            **{f"_value_{n}d": total("_value", trailing(n)) for n in params.VELOCITY_DAYS},
            **{f"_count_{n}d": total("_n", trailing(n)) for n in params.VELOCITY_DAYS},
            "_full_90d": F.round(total("_value", line.rangeBetween(-90, 0)), 2),
        }
    )
    weighted = F.col("prior_purchase_count") * F.col("_logs") + F.col("_placed_logs")
    out = out.withColumn("_placed_logs_before", F.coalesce(F.sum(weighted).over(before), F.lit(0.0)))
    return out.filter("_entry.day_itself").drop(*measures, "_entry", "_gap", "_times", "_day")


def sorted_median(values: Column) -> Column:
    """Median of a sorted array; null when it is empty."""
    n = F.size(values)
    low = F.try_element_at(values, F.floor((n + 1) / 2.0).cast("int"))
    high = F.try_element_at(values, (F.floor(n / 2.0) + 1).cast("int"))
    return F.when(n > 0, (low + high) / 2)


def history_depth(count: Column) -> Column:
    return (
        F.when(count == 0, F.lit("no_history"))
        .when(count <= 2, F.lit("sparse"))
        .when(count <= 7, F.lit("usable"))
        .otherwise(F.lit("deep"))
    )


def history_quality(count: Column) -> Column:
    return F.when(count == 0, F.lit("limited")).when(count <= 2, F.lit("acceptable")).otherwise(F.lit("high"))


def with_daily_history(events: DataFrame, digits: int = 2) -> DataFrame:
    """Purchases with their day's causal columns and their position among the person's purchases."""
    placed = with_positions(events, digits)
    daily = daily_history(placed)
    joined = placed.join(daily, PERSON_DAY)
    count = F.col("prior_purchase_count")
    sequence = (count + F.col("_day_place")).cast("bigint")
    value = F.coalesce("purchase_value", F.lit(0.0))
    return joined.withColumns(
        {
            "sequence": sequence,
            "history_depth": history_depth(count),
            "history_quality": history_quality(count),
            "quality_flags": F.when(count == 0, F.lit("no_prior_history"))
            .when(count <= 2, F.lit("sparse_prior_history"))
            .otherwise(F.lit("")),
            **{f"purchase_value_{n}d": F.round(F.col(f"_value_{n}d") + F.col("_day_value"), 2) for n in params.VELOCITY_DAYS},
            **{f"purchase_count_{n}d": F.col(f"_count_{n}d") + F.col("_day_place") + 1 for n in params.VELOCITY_DAYS},
            # earlier positive purchases, and the largest of them
            "_priors": (F.col("_positive_before") + F.col("_day_positive")).cast("bigint"),
            "_largest": F.greatest(F.when(F.col("largest_prior_purchase_value") > 0, F.col("largest_prior_purchase_value")), F.col("_day_largest")),
            "_sum_logs": F.col("_logs_before") + F.col("_day_logs"),
            # sum of position * log value up to this purchase
            "_sum_placed_logs": F.col("_placed_logs_before") + count * F.col("_day_logs") + F.col("_day_placed_logs"),
            "_last_gap": F.when(F.col("_day_place") > 0, F.lit(0)).otherwise(F.col("days_since_previous_purchase")),
            # what the 90 days up to this day held before this purchase
            "_same_day_90d": F.round(F.col("_value_90d") + F.col("_day_value") - value, 2),
        }
    ).drop(
        "_logs_before",
        "_positive_before",
        "_day_positive",
        "_day_largest",
        "_placed_logs_before",
        "_day_logs",
        "_day_placed_logs",
        "_day_value",
        *[f"_value_{n}d" for n in params.VELOCITY_DAYS],
        *[f"_count_{n}d" for n in params.VELOCITY_DAYS],
    )
