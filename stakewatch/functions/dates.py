"""Dates: tolerant parsing, weekday distance, day numbers, filing delay."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def parse_date(col: Column) -> Column:
    """Compact, ISO and timestamp texts to a date in UTC; anything else is null."""
    raw = F.trim(col.cast("string"))
    compact = F.when(raw.rlike(r"^\d{8}$"), F.try_to_date(raw, "yyyyMMdd"))
    plain = F.when(raw.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(raw, "yyyy-MM-dd"))
    stamped = F.when(raw.rlike(r"^\d{4}-\d{2}-\d{2}[T ]"), raw.try_cast("timestamp").cast("date"))
    return F.coalesce(compact, plain, stamped)


def day_number(col: Column) -> Column:
    """Days since the epoch, for range frames counted in days."""
    return F.unix_date(col)


def weekdays_before(day: Column) -> Column:
    """Number of Mondays to Fridays before a day number (from a fixed Monday on)."""
    shifted = day + 3
    return 5 * F.floor(shifted / 7.0) + F.least(F.pmod(shifted, F.lit(7)), F.lit(5))


def weekday_gap(earlier: Column, later: Column) -> Column:
    """Weekdays from one date to another, both ends counted, minus one. No calendar is built."""
    return (weekdays_before(F.unix_date(later) + 1) - weekdays_before(F.unix_date(earlier)) - 1).cast("int")


def filing_delay(transaction: Column, filing: Column) -> Column:
    return F.greatest(F.lit(0), F.datediff(filing, transaction))
