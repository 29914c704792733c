"""As-of joins between days and price sessions.

Both sides are first reduced to one row per ticker and day, so a ticker never holds more rows than the calendar has
days, whatever the number of purchases; the purchases then join on (ticker, day) by equality.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def match_sessions(days: DataFrame, sessions: DataFrame, day: str = "day") -> DataFrame:
    """For each (ticker, day): the first session on or after it and the last one on or before it.

    ``days`` has ticker and ``day``; ``sessions`` has ticker, date and any further columns. Result columns
    ``next_session`` and ``previous_session`` are structs of the session columns.
    """
    columns = [c for c in sessions.columns if c != "ticker"]
    asked = days.select("ticker", F.col(day).alias("_day")).distinct()
    empty = sessions.select(F.struct(*columns).alias("s")).schema["s"].dataType
    both = asked.select("ticker", "_day", F.lit(1).alias("_asked"), F.lit(None).cast(empty).alias("_session")).unionByName(
        sessions.select("ticker", F.col("date").alias("_day"), F.lit(0).alias("_asked"), F.struct(*columns).alias("_session"))
    )
    # Both directions run over a frame that only grows, which Spark evaluates in one pass.
    up = Window.partitionBy("ticker").orderBy(F.asc("_day"), F.asc("_asked"))
    down = Window.partitionBy("ticker").orderBy(F.desc("_day"), F.asc("_asked"))
    grown = (Window.unboundedPreceding, Window.currentRow)
    return (
        both.withColumn("next_session", F.last("_session", ignorenulls=True).over(down.rowsBetween(*grown)))
        .withColumn("previous_session", F.last("_session", ignorenulls=True).over(up.rowsBetween(*grown)))
        .filter("_asked = 1")
        .select("ticker", F.col("_day").alias(day), "next_session", "previous_session")
    )


def nearest_session(matched: DataFrame, day: str = "day") -> DataFrame:
    """Adds the session nearest in absolute distance; the earlier one when both are equally far."""
    back = F.datediff(F.col(day), F.col("previous_session.date"))
    ahead = F.datediff(F.col("next_session.date"), F.col(day))
    nearer = F.when(back <= ahead, F.col("previous_session")).otherwise(F.col("next_session"))
    return matched.withColumn("nearest_session", F.coalesce(nearer, F.col("previous_session"), F.col("next_session")))
