"""Price sessions: cleaning, rolling context, splits, and the context of a purchase."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from stakewatch import params
from stakewatch.functions.numeric import ratio, round_to
from stakewatch.operators.asof import match_sessions
from stakewatch.operators.grouping import last_per_key

PRICE_COLUMNS = ["open", "high", "low", "close", "adj_close", "volume", "dividends", "stock_splits"]


def with_trailing_highest(rows: DataFrame, column: str, frames: dict[str, int]) -> DataFrame:
    """Adds the highest value of the last n sessions for each name and n of ``frames``.

    Sessions (numbered from 1 by ``_n`` in each ticker) are cut into blocks of n; a frame is the end of one block and the
    beginning of the next, so it is the larger of two running maxima, and no frame is walked through row by row."""
    # Blocks follow each other as their sessions do, so the last two windows find the rows in one order.
    line = Window.partitionBy("ticker").orderBy("_block", "_n")
    for name, n in frames.items():
        inside = Window.partitionBy("ticker", "_block")
        rows = rows.withColumn("_block", F.floor((F.col("_n") - 1) / float(n)))
        rows = rows.withColumn("_from", F.max(column).over(inside.orderBy(F.desc("_n")).rowsBetween(Window.unboundedPreceding, 0)))
        rows = rows.withColumn("_upto", F.max(column).over(inside.orderBy("_n").rowsBetween(Window.unboundedPreceding, 0)))
        rows = rows.withColumn(name, F.greatest("_upto", F.lag("_from", n - 1).over(line))).drop("_block", "_upto", "_from")
    return rows


def with_trailing_moments(rows: DataFrame, frames: dict[str, tuple[str, int]]) -> DataFrame:
    """Adds for each name and (column, n) of ``frames`` a struct of the count, mean and sum of squares about the mean (``n``,
    ``mean``, ``m2``) of the column's known values in the last n sessions.

    Blocks and frames are as in ``with_trailing_highest``. Squares at both ends of a frame are running sums about the mean of
    their own block, so that large values with small steps keep their digits, and are merged as two samples are. No
    frame is walked through row by row."""
    # The centre and the first ends are taken in one order of the rows, the other ends and the step back in another.
    line = Window.partitionBy("ticker").orderBy("_block", "_n")
    for name, (column, n) in frames.items():
        inside = Window.partitionBy("ticker", "_block")
        whole = inside.orderBy(F.desc("_n")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        rows = rows.withColumn("_block", F.floor((F.col("_n") - 1) / float(n))).withColumn("_centre", F.avg(column).over(whole))
        away = F.col(column) - F.col("_centre")
        for end, order in (("_from", F.col("_n").desc()), ("_upto", F.col("_n").asc())):
            so_far = inside.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
            rows = rows.withColumn(end, F.struct(F.count(column).over(so_far).alias("n"), F.sum(column).over(so_far).alias("t"), F.sum(away).over(so_far).alias("s"), F.sum(away * away).over(so_far).alias("q"), F.col("_centre").alias("c")))
        # The frame of a block's last session is the block itself.
        ended = F.col("_n") % n == 0
        rows = rows.withColumn("_from", F.when(~ended, F.lag("_from", n - 1).over(line)))
        rows = rows.withColumn(name, merged_moments(F.col("_from"), F.col("_upto"))).drop("_block", "_centre", "_upto", "_from")
    return rows


def merged_moments(left: Column, right: Column) -> Column:
    """Moments of two samples together, each given as count, sum ``t``, and sum ``s`` and sum of squares ``q`` about its ``c``."""

    def moments(part: Column) -> tuple[Column, Column, Column]:
        n = F.coalesce(part["n"], F.lit(0))
        shift = F.when(n > 0, part["s"] / n)
        return n, F.coalesce(part["c"] + shift, F.lit(0.0)), F.coalesce(part["q"] - part["s"] * shift, F.lit(0.0))

    (n1, mean1, m1), (n2, mean2, m2) = moments(left), moments(right)
    n = n1 + n2
    share = F.when(n > 0, n2 / n)
    apart = F.when((n1 > 0) & (n2 > 0), mean2 - mean1).otherwise(F.lit(0.0))
    mean = (F.coalesce(left["t"], F.lit(0.0)) + F.coalesce(right["t"], F.lit(0.0))) / F.nullif(n, F.lit(0))
    squares = F.greatest(m1 + m2 + apart * apart * n1 * share, F.lit(0.0))
    return F.struct(n.alias("n"), mean.alias("mean"), F.when(n > 0, squares).alias("m2"))


def session_context(prices: DataFrame) -> DataFrame:
    """Rolling columns of each session, computed once per (ticker, date) and shared by all purchases.

    A ticker has one row per session, so a window never holds more rows than the calendar has days.
    """
    line = Window.partitionBy("ticker").orderBy("date")
    back = Window.partitionBy("ticker").orderBy(F.desc("date"))
    position = F.row_number().over(line)
    daily_return = ratio(F.col("close"), F.lag("close").over(line)) - 1
    base = prices.withColumns(
        {"_n": position, "_return": daily_return, "_dollars": F.col("close") * F.col("volume")}
    )
    base = with_trailing_highest(base, "high", {"_high_52w": 252, "_high_3y": 756})
    base = with_trailing_moments(base, {"_close_200": ("close", 200), "_return_63": ("_return", 63), "_dollars_63": ("_dollars", 63)})
    later_splits = F.collect_list(F.when(F.col("stock_splits") > 0, F.col("stock_splits").cast("double"))).over(
        back.rowsBetween(Window.unboundedPreceding, -1)
    )
    columns = {
        "prior_session_close": F.lag("close").over(line),
        **{f"return_prior_{n}d": ratio(F.col("close"), F.lag("close", n).over(line)) - 1 for n in params.PRIOR_SESSIONS},
        "drawdown_52w": ratio(F.col("close"), F.col("_high_52w")) - 1,
        "drawdown_3y": ratio(F.col("close"), F.col("_high_3y")) - 1,
        "distance_200d_ma": F.when(F.col("_n") >= 200, ratio(F.col("close"), F.col("_close_200.mean")) - 1),
        "realized_volatility_63d": F.when(F.col("_return_63.n") >= 63, F.sqrt(F.col("_return_63.m2") / 62) * F.lit(252.0 ** 0.5)),
        "average_dollar_volume_63d": F.col("_dollars_63.mean"),
        "split_factor_after": F.aggregate(later_splits, F.lit(1.0), lambda total, split: total * split),
        **{
            f"evaluation_forward_return_{n}d": ratio(F.lead("close", n).over(line), F.col("close")) - 1
            for n in params.FORWARD_SESSIONS
        },
    }
    return base.withColumns(columns).drop("_n", "_return", "_dollars", "_high_52w", "_high_3y", "_close_200", "_return_63", "_dollars_63")


CONTEXT_COLUMNS = [
    "prior_session_close",
    *[f"return_prior_{n}d" for n in params.PRIOR_SESSIONS],
    "drawdown_52w",
    "drawdown_3y",
    "distance_200d_ma",
    "realized_volatility_63d",
    "average_dollar_volume_63d",
    *[f"evaluation_forward_return_{n}d" for n in params.FORWARD_SESSIONS],
]


def later_split_factor(days: DataFrame, prices: DataFrame) -> DataFrame:
    """Product of the positive splits after each asked (ticker, day), the day itself not counted."""
    splits = prices.filter("stock_splits > 0").select(
        "ticker", F.col("date").alias("day"), F.col("stock_splits").cast("double").alias("_split")
    )
    both = days.select("ticker", "day").distinct().withColumn("_split", F.lit(None).cast("double")).unionByName(splits)
    later = Window.partitionBy("ticker").orderBy(F.desc(F.unix_date("day"))).rangeBetween(Window.unboundedPreceding, -1)
    factor = F.aggregate(F.collect_list("_split").over(later), F.lit(1.0), lambda total, split: total * split)
    return both.withColumn("split_factor_after_event", factor).filter("_split is null").drop("_split")


def with_asked_for(prices: DataFrame, days: DataFrame) -> DataFrame:
    """Marks in ``_asked_for`` the sessions that are the first on or after any of the days: those that the number of days so far rises at."""
    both = prices.withColumn("_asks", F.lit(0)).unionByName(days.select("ticker", F.col("day").alias("date"), F.lit(1).alias("_asks")), allowMissingColumns=True)
    so_far = F.sum("_asks").over(Window.partitionBy("ticker").orderBy("date", F.desc("_asks")).rowsBetween(Window.unboundedPreceding, 0))
    sessions = both.withColumn("_so_far", so_far).filter("_asks = 0")
    before = F.lag("_so_far", 1, 0).over(Window.partitionBy("ticker").orderBy("date"))
    return sessions.withColumn("_asked_for", F.col("_so_far") > before).drop("_asks", "_so_far")


def add_price_context(events: DataFrame, prices: DataFrame) -> DataFrame:
    """Purchases with the session on or after their date and its rolling context; missing prices are flagged."""
    days = events.select("ticker", F.col("transaction_date").alias("day")).distinct()
    # The context is made from all sessions, but only those that a purchase asks for are sent on with it.
    sessions = session_context(with_asked_for(prices, days)).filter("_asked_for").select("ticker", "date", "close", *CONTEXT_COLUMNS)
    matched = match_sessions(days, sessions).drop("previous_session")
    factors = later_split_factor(days, prices)
    per_day = (
        matched.join(factors, ["ticker", "day"])
        .filter("next_session is not null")
        .select(
            "ticker",
            F.col("day").alias("transaction_date"),
            F.lit(True).alias("price_available"),
            F.col("next_session.date").alias("price_context_date"),
            F.col("next_session.close").alias("transaction_date_close"),
            *[F.col(f"next_session.{c}").alias(c) for c in CONTEXT_COLUMNS],
            "split_factor_after_event",
        )
    )
    out = events.join(per_day, ["ticker", "transaction_date"], "left")
    return out.withColumns(
        {
            "price_available": F.coalesce("price_available", F.lit(False)),
            "split_adjusted_shares": F.col("total_shares") * F.col("split_factor_after_event"),
            "split_adjusted_price": ratio(F.col("weighted_average_price"), F.col("split_factor_after_event")),
        }
    )


def usable_sessions(prices: DataFrame, keep: int = params.STORY_SESSIONS) -> DataFrame:
    """Clean sessions for the price story: one row per date (last load wins), positive story close, newest ``keep``."""
    typed = prices.withColumns({c: F.col(c).try_cast("double") for c in PRICE_COLUMNS if c in prices.columns})
    order = [F.col(c) for c in ("load_no",) if c in prices.columns] or [F.struct(*[c for c in PRICE_COLUMNS if c in prices.columns])]
    unique = last_per_key(typed.filter("date is not null"), ["ticker", "date"], order)
    story = F.when(F.col("adj_close") > 0, F.col("adj_close")).otherwise(F.col("close"))
    newest = Window.partitionBy("ticker").orderBy(F.desc("date"))
    return (
        unique.withColumn("story_close", story)
        .filter("story_close > 0")
        .withColumn("_age", F.row_number().over(newest))
        .filter(F.col("_age") <= keep)
        .drop("_age")
    )


def company_context(companies: DataFrame, prices: DataFrame, rules: dict = params.ELIGIBILITY) -> DataFrame:
    """Companies with their latest price, dollar volume of 63 sessions, eligibility and its reasons."""
    newest = Window.partitionBy("ticker").orderBy(F.desc("date"))
    recent = prices.withColumn("_age", F.row_number().over(newest)).filter("_age <= 63")
    facts = recent.groupBy("ticker").agg(
        F.max_by("close", "date").alias("latest_price"),
        F.avg(F.col("close") * F.col("volume")).alias("average_dollar_volume_63d"),
    )
    return with_eligibility(companies.join(facts, "ticker", "left"), rules)


def with_eligibility(df: DataFrame, rules: dict = params.ELIGIBILITY) -> DataFrame:
    cap, price, volume = F.col("market_cap"), F.col("latest_price"), F.col("average_dollar_volume_63d")
    kind = F.lower(F.coalesce("quote_type", F.lit("")))
    excluded = kind.rlike("|".join(rules["excluded_types"]))
    reasons = F.array_compact(
        F.array(
            F.when(cap.isNull(), F.lit("missing_market_cap"))
            .when(cap < rules["market_cap_min"], F.lit("market_cap_below_minimum"))
            .when(cap > rules["market_cap_max"], F.lit("market_cap_above_maximum")),
            F.when(price.isNull(), F.lit("missing_price")).when(price < rules["price_min"], F.lit("price_below_minimum")),
            F.when(volume.isNull() | (volume < rules["dollar_volume_min"]), F.lit("insufficient_liquidity")),
            F.when(excluded, F.lit("excluded_security_type")),
        )
    )
    return df.withColumn("eligibility_reasons", reasons).withColumn("discovery_eligible", F.size("eligibility_reasons") == 0)


def trend_label(price: Column, mean_200: Column, return_63: Column) -> Column:
    return (
        F.when(mean_200.isNull() | return_63.isNull(), F.lit("insufficient_history"))
        .when((price >= mean_200) & (return_63 >= 0.05), F.lit("advancing"))
        .when((price >= mean_200) & (return_63 > -0.05), F.lit("holding_above_trend"))
        .when((price < mean_200) & (return_63 >= 0), F.lit("recovering"))
        .when(return_63 <= -0.15, F.lit("falling"))
        .otherwise(F.lit("below_trend"))
    )


def story_context(sessions: DataFrame) -> DataFrame:
    """One row per ticker: last price, highs, trend, volatility and its place among earlier values."""
    line = Window.partitionBy("ticker").orderBy("date")
    whole = Window.partitionBy("ticker")
    step = sessions.withColumns(
        {
            "_n": F.row_number().over(line),
            "_rows": F.count(F.lit(1)).over(whole),
            "_return": ratio(F.col("story_close"), F.lag("story_close").over(line)) - 1,
        }
    )
    last63 = line.rowsBetween(-62, 0)
    step = step.withColumn(
        "_vol",
        F.when(F.count("_return").over(last63) >= 40, F.stddev_samp("_return").over(last63) * F.lit(252.0**0.5)),
    )
    step = step.withColumn("_last_vol", F.max(F.when(F.col("_n") == F.col("_rows"), F.col("_vol"))).over(whole))
    age = F.col("_rows") - F.col("_n")
    close = F.col("story_close")
    facts = step.groupBy("ticker").agg(
        F.max("date").alias("price_date"),
        F.count(F.lit(1)).alias("price_rows"),
        F.max_by("story_close", "date").alias("current_price"),
        F.max(F.when(age < 252, close)).alias("high_52w"),
        F.max(close).alias("high_3y"),
        F.avg(F.when(age < 200, close)).alias("mean_200"),
        F.max(F.when(age == 63, close)).alias("close_63_ago"),
        F.max("_last_vol").alias("volatility"),
        F.avg(F.when(F.col("_vol").isNotNull(), (F.round("_vol", 12) <= F.round("_last_vol", 12)).cast("double"))).alias("_share"),
    )
    price = F.col("current_price")
    mean_200 = F.when(F.col("price_rows") >= 40, F.col("mean_200"))
    return_63 = ratio(price, F.col("close_63_ago")) - 1
    return facts.select(
        "ticker",
        "price_date",
        "price_rows",
        "current_price",
        ((ratio(price, F.col("high_52w")) - 1) * 100).alias("drawdown_from_52_week_high"),
        ((ratio(price, F.col("high_3y")) - 1) * 100).alias("drawdown_from_3_year_high"),
        ((ratio(price, mean_200) - 1) * 100).alias("distance_from_200_day_average"),
        (return_63 * 100).alias("return_63_sessions"),
        (F.col("volatility") * 100).alias("realized_volatility_63d"),
        F.when(F.col("volatility").isNotNull(), F.col("_share") * 100).alias("volatility_percentile"),
        trend_label(price, mean_200, return_63).alias("trend"),
    )


def downsample(sessions: DataFrame, event_days: DataFrame, points: int = params.STORY_POINTS) -> DataFrame:
    """Every n-th session, the last one, and the sessions at or next to a purchase, in at most about ``points`` steps."""
    line = Window.partitionBy("ticker").orderBy("date")
    numbered = sessions.withColumn("_n", F.row_number().over(line) - 1).withColumn(
        "_rows", F.count(F.lit(1)).over(Window.partitionBy("ticker"))
    )
    step = F.greatest(F.lit(1), F.ceil(F.col("_rows") / float(points)))
    regular = (F.col("_n") % step == 0) | (F.col("_n") == F.col("_rows") - 1)
    matched = match_sessions(event_days.select("ticker", "day"), sessions.select("ticker", "date"))
    exact = F.col("next_session.date") == F.col("day")
    wanted = F.when(exact, F.array("next_session.date")).otherwise(
        F.array_compact(F.array("previous_session.date", "next_session.date"))
    )
    near = matched.select("ticker", F.explode(wanted).alias("date")).distinct().withColumn("_near", F.lit(True))
    return (
        numbered.join(near, ["ticker", "date"], "left")
        .filter((F.col("_rows") <= points) | regular | F.coalesce("_near", F.lit(False)))
        .drop("_n", "_rows", "_near")
    )
