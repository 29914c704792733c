"""Sentences about purchases.

The sentences and the limits that choose between them are fixed values of the page texts.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from stakewatch.functions.numeric import currency_text, feed_currency, fixed_text, multiple_text, percent_text, score_text
from stakewatch.functions.text import usable_text


def feed_summary(ticker: Column, buyers: Column, types: Column) -> Column:
    return (
        F.when(
            F.array_contains(types, "new_cluster") & (buyers >= 2),
            F.concat(buyers.cast("string"), F.lit(" executives are now buying "), ticker, F.lit(".")),
        )
        .when(F.array_contains(types, "silence_break"), F.concat(F.lit("An executive returned to buy "), ticker, F.lit(" after a long absence.")))
        .when(F.array_contains(types, "conviction_increase"), F.concat(F.lit("The evidence around "), ticker, F.lit(" strengthened materially.")))
        .when(F.array_contains(types, "large_purchase"), F.concat(ticker, F.lit(" disclosed a large open-market purchase.")))
        .otherwise(F.concat(ticker, F.lit(" reported qualifying insider buying.")))
    )


def feed_detail(buyers: Column, value: Column, percent_vs_cost: Column) -> Column:
    committed = F.concat(
        buyers.cast("string"), F.when(buyers == 1, " buyer").otherwise(" buyers"), F.lit(" committed "), feed_currency(value), F.lit(".")
    )
    context = F.concat(
        F.lit("The latest price is "), fixed_text(F.abs(percent_vs_cost), 1), F.lit("% "),
        F.when(percent_vs_cost >= 0, "above").otherwise("below"), F.lit(" their average reported cost."),
    )
    return F.concat_ws(" ", committed, context)


def company_headline(headline: Column, buyers: Column, multiple: Column, company: Column) -> Column:
    return F.coalesce(
        F.nullif(usable_text(headline), F.lit("")),
        F.when(buyers > 1, F.concat(fixed_text(buyers, 0), F.lit(" executives bought shares in the same company."))),
        F.when(multiple > 1, F.concat(F.lit("An executive made a purchase "), multiple_text(multiple), F.lit(" larger than usual."))),
        F.concat(F.lit("Executives at "), F.nullif(company, F.lit("")), F.lit(" committed personal capital.")),
        F.lit("Executives committed personal capital."),
    )


def why_it_matters(conviction: Column, buyers: Column, ownership: Column, value: Column) -> Column:
    return (
        F.when(buyers >= 3, F.concat(fixed_text(buyers, 0), F.lit(" independent buyers reached the same decision, which makes the activity harder to dismiss as an isolated trade.")))
        .when(ownership >= 20, F.concat(F.lit("The purchase materially increased the insider’s ownership by "), percent_text(ownership), F.lit(", creating a meaningfully larger personal exposure.")))
        .when(value >= 1_000_000, F.concat(F.lit("The reported purchase exceeded "), currency_text(value), F.lit(", making it a substantial personal commitment rather than a token transaction.")))
        .when(conviction >= 80, F.lit("The evidence remains strong after accounting for history, ownership, role relevance, confirmation, and data quality."))
        .otherwise(F.lit("The purchase becomes more meaningful when viewed against the executive’s prior behavior and current ownership."))
    )


def why_it_is_unusual(prior_count: Column, days: Column, multiple: Column, behavior: Column) -> Column:
    return (
        F.when(prior_count == 0, F.lit("This is the first recorded qualifying open-market purchase in the available history."))
        .when(days >= 365 * 3, F.concat(F.lit("The executive returned after roughly "), fixed_text(days / 365.0, 1), F.lit(" years without a comparable purchase.")))
        .when(multiple >= 3, F.concat(F.lit("The purchase was "), multiple_text(multiple), F.lit(" the executive’s prior median purchase size.")))
        .when(behavior >= 75, F.concat(F.lit("The executive’s current behavior differs sharply from their own historical pattern, with a behavior-change score of "), score_text(behavior), F.lit(".")))
        .otherwise(F.lit("The timing, size, or ownership impact differs from the executive’s established pattern."))
    )


def evidence_lines(value: Column, multiple: Column, ownership: Column, buyers: Column, conviction: Column) -> Column:
    """Up to four short facts, zero or missing ones left out."""
    lines = F.array_compact(
        F.array(
            F.when(value != 0, F.concat(currency_text(value), F.lit(" reported purchase"))),
            F.when(multiple != 0, F.concat(multiple_text(multiple), F.lit(" prior median"))),
            F.when(ownership != 0, F.concat(percent_text(ownership), F.lit(" ownership increase"))),
            F.when(buyers != 0, F.concat(fixed_text(buyers, 0), F.lit(" independent buyer"), F.when(buyers == 1, "").otherwise("s"))),
            F.when(conviction != 0, F.concat(F.lit("Evidence strength "), score_text(conviction))),
        )
    )
    return F.slice(lines, 1, 4)
