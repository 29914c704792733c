"""Numbers: tolerant casts, clipping, scales, rounding and compact text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def safe_number(col: Column, default: float | None = 0.0) -> Column:
    """Text or number to a finite double; anything else gives the default."""
    value = col.try_cast("double")
    finite = F.when(F.isnan(value) | (F.abs(value) == float("inf")), F.lit(None)).otherwise(value)
    return finite if default is None else F.coalesce(finite, F.lit(default))


def clamp(col: Column, low: float = 0.0, high: float = 100.0) -> Column:
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), col))


def ratio(top: Column, bottom: Column) -> Column:
    """Quotient that is null, not an error, when the divisor is zero or missing."""
    return top / F.when(bottom != 0, bottom)


def round_to(col: Column, digits: int) -> Column:
    """Half-up rounding by plain double arithmetic, so that any engine gives the same bits."""
    factor = float(10**digits)
    return F.floor(col * factor + 0.5) / factor


def scale_linear(col: Column, low: Column, high: Column, out_low: float, out_high: float) -> Column:
    share = clamp(ratio(col - low, high - low), 0.0, 1.0)
    return (
        F.when(col.isNull(), F.lit(out_low))
        .when(low == high, F.lit((out_low + out_high) / 2))
        .otherwise(F.lit(out_low) + share * (out_high - out_low))
    )


def scale_log(col: Column, low: Column, high: Column, out_low: float, out_high: float) -> Column:
    floor_low = F.greatest(low, F.lit(1.0))
    floor_high = F.greatest(high, floor_low + 1.0)
    return scale_linear(
        F.log10(F.greatest(col, F.lit(1.0))), F.log10(floor_low), F.log10(floor_high), out_low, out_high
    )


def fixed_text(col: Column, digits: int) -> Column:
    """Decimal text with a fixed number of digits, ties upward, no locale."""
    factor = 10**digits
    units = F.floor(F.abs(col) * float(factor) + 0.5)
    whole = F.floor(units / float(factor)).cast("string")
    sign = F.when((col < 0) & (units > 0), F.lit("-")).otherwise(F.lit(""))
    if digits == 0:
        return F.concat(sign, units.cast("string"))
    return F.concat(sign, whole, F.lit("."), F.lpad((units % factor).cast("string"), digits, "0"))


def trimmed_text(col: Column, digits: int) -> Column:
    """Like ``fixed_text`` without a trailing ``.0``."""
    return F.regexp_replace(fixed_text(col, digits), r"\.0$", "")


def feed_currency(col: Column) -> Column:
    """Dollar text of the activity feed: one decimal, K/M/B."""
    size = F.abs(col)
    sign = F.when(col < 0, F.lit("-")).otherwise(F.lit(""))
    return (
        F.when(size >= 1e9, F.concat(sign, F.lit("$"), trimmed_text(size / 1e9, 1), F.lit("B")))
        .when(size >= 1e6, F.concat(sign, F.lit("$"), trimmed_text(size / 1e6, 1), F.lit("M")))
        .when(size >= 1e3, F.concat(sign, F.lit("$"), trimmed_text(size / 1e3, 1), F.lit("K")))
        .otherwise(F.concat(sign, F.lit("$"), fixed_text(size, 0)))
    )


def grouped_integer(col: Column) -> Column:
    return F.format_number(col.cast("bigint"), 0)


def compact_text(col: Column) -> Column:
    """Short number: one decimal below ten units of K/M/B/T, none above."""
    size = F.abs(col)
    out = F.when(col == F.floor(col), grouped_integer(col)).otherwise(trimmed_text(col, 1))
    for threshold, suffix in ((1e3, "K"), (1e6, "M"), (1e9, "B"), (1e12, "T")):
        scaled = col / threshold
        text = F.when(F.abs(scaled) < 10, trimmed_text(scaled, 1)).otherwise(fixed_text(scaled, 0))
        out = F.when(size >= threshold, F.concat(text, F.lit(suffix))).otherwise(out)
    return out


def currency_text(col: Column) -> Column:
    sign = F.when(col < 0, F.lit("-")).otherwise(F.lit(""))
    return F.coalesce(F.concat(sign, F.lit("$"), compact_text(F.abs(col))), F.lit("Not available"))


def number_text(col: Column) -> Column:
    return F.coalesce(compact_text(col), F.lit("0"))


def percent_text(col: Column) -> Column:
    return F.coalesce(F.concat(trimmed_text(col, 1), F.lit("%")), F.lit("Not available"))


def score_text(col: Column) -> Column:
    return F.coalesce(fixed_text(col, 0), F.lit("—"))


def multiple_text(col: Column) -> Column:
    shown = F.when(col >= 10, trimmed_text(col, 1)).otherwise(trimmed_text(col, 2))
    return F.when(col > 0, F.concat(shown, F.lit("×"))).otherwise(F.lit("First recorded purchase"))


def change_percent(current: Column, previous: Column) -> Column:
    """Percent change; from a zero base it is 0 when nothing changed, else null."""
    return F.when(previous == 0, F.when(current == 0, F.lit(0.0))).otherwise((current - previous) / previous * 100)
