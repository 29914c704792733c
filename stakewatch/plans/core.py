"""Queries on lots, purchase events, histories, signals and rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from stakewatch import params
from stakewatch.functions.dates import weekday_gap
from stakewatch.functions.numeric import round_to
from stakewatch.functions.text import joined
from stakewatch.operators import events as event_ops
from stakewatch.operators import prices as price_ops
from stakewatch.operators import rankings as ranking_ops
from stakewatch.operators import signals as signal_ops
from stakewatch.operators.asof import match_sessions, nearest_session
from stakewatch.plans import tables
from stakewatch.plans.oracle import RULES, headline_sql, r, role_label_sql
from stakewatch.plans.registry import query
from stakewatch.functions.roles import role_label


def rounded(df: DataFrame, digits: int = 6, *names: str) -> DataFrame:
    return df.withColumns({n: round_to(F.col(n), digits) for n in names})


def rs(*names: str, digits: int = 6) -> str:
    return ", ".join(f"{r(n, digits)} AS {n}" for n in names)


# --- lots and events -------------------------------------------------------------------------------------------

@query(
    "p3_qualifying_purchases",
    "SELECT accession_number, line_no, part_no, issuer_cik, insider_id, shares, price_per_share FROM lots WHERE is_qualifying_purchase",
    ("lots",),
)
def p3(spark, sf_dir):
    return tables.lots(spark, sf_dir).filter("is_qualifying_purchase").select(
        "accession_number", "line_no", "part_no", "issuer_cik", "insider_id", "shares", "price_per_share"
    )


@query(
    "p4_p5_open_market_and_row_quality",
    """SELECT issuer_cik, is_non_derivative AND transaction_code='P' AS is_open_market_purchase, quality, count(*) AS lots
    FROM lots GROUP BY 1,2,3""",
    ("lots",),
)
def p4(spark, sf_dir):
    open_market = F.col("is_non_derivative") & (F.col("transaction_code") == "P")
    return (
        tables.lots(spark, sf_dir)
        .groupBy("issuer_cik", open_market.alias("is_open_market_purchase"), "quality")
        .agg(F.count(F.lit(1)).alias("lots"))
    )


@query(
    "p6_symbol_filter",
    "SELECT issuer_cik, insider_id, transaction_date, shares FROM lots WHERE upper(ticker)=upper('s17')",
    ("lots",),
)
def p6(spark, sf_dir):
    return tables.lots(spark, sf_dir).filter(F.upper("ticker") == "S17").select(
        "issuer_cik", "insider_id", "transaction_date", "shares"
    )


EVENT_COLUMNS = [
    "event_id", "issuer_cik", "insider_id", "ticker", "transaction_date", "filing_date", "security_title",
    "direct_indirect_code", "accession_number", "total_shares", "purchase_value", "lot_count",
    "reported_holdings_after", "event_quality",
]


@query(
    "a1_purchase_events",
    f"SELECT {', '.join(EVENT_COLUMNS)}, array_to_string(normalized_roles,'|') AS normalized_roles FROM pe",
    ("pe",),
)
def a1(spark, sf_dir):
    # From the lots themselves, so this query shows the whole grouping plan.
    return event_ops.purchase_events(tables.lots(spark, sf_dir)).select(
        *EVENT_COLUMNS, joined(F.col("normalized_roles")).alias("normalized_roles")
    )


@query(
    "s12_ownership_change",
    f"SELECT event_id, holdings_before, {rs('ownership_increase_percent')}, first_reported_position, ambiguous_ownership FROM pe",
    ("pe",),
)
def s12(spark, sf_dir):
    df = tables.events(spark, sf_dir).select(
        "event_id", "holdings_before", "ownership_increase_percent", "first_reported_position", "ambiguous_ownership"
    )
    return rounded(df, 6, "ownership_increase_percent")


_WEEKDAYS = "(SELECT count(*) FROM generate_series(0, CAST({b}-{a} AS BIGINT)) g(i) WHERE isodow({a}+CAST(i AS INTEGER))<6)-1"
_RUN = """
runs AS (SELECT *, sum(brk) OVER (PARTITION BY issuer_cik,insider_id,ticker ORDER BY transaction_date,event_id
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM (
 SELECT *, CASE WHEN prev IS NOT NULL AND len(list_filter(generate_series(CAST(0 AS BIGINT), CAST(transaction_date-prev AS BIGINT)), lambda i: isodow(prev+CAST(i AS INTEGER))<6))-1>5 THEN 1 ELSE 0 END AS brk
 FROM (SELECT *, lag(transaction_date) OVER (PARTITION BY issuer_cik,insider_id,ticker ORDER BY transaction_date,event_id) AS prev FROM pe)))"""


@query(
    "a2_purchase_campaigns",
    f"""SELECT issuer_cik,insider_id,ticker,min(transaction_date) AS start_date,max(transaction_date) AS end_date,
     round(sum(purchase_value),2) AS purchase_value, sum(total_shares) AS total_shares, count(*) AS event_count,
     arg_min(event_id,(transaction_date,event_id)) AS first_event_id, arg_max(event_id,(transaction_date,event_id)) AS last_event_id
    FROM (WITH {_RUN} SELECT * FROM runs) GROUP BY issuer_cik,insider_id,ticker,run""",
    ("pe",),
)
def a2(spark, sf_dir):
    return event_ops.purchase_campaigns(tables.events(spark, sf_dir)).select(
        "issuer_cik", "insider_id", "ticker", "start_date", "end_date", "purchase_value", "total_shares",
        F.col("event_count").cast("bigint").alias("event_count"), "first_event_id", "last_event_id",
    )


@query(
    "a2_campaign_members",
    f"""SELECT first_value(event_id) OVER w || '>' || event_id AS member, transaction_date, count(*) OVER w2 AS run_size
    FROM (WITH {_RUN} SELECT * FROM runs)
    WINDOW w AS (PARTITION BY issuer_cik,insider_id,ticker,run ORDER BY transaction_date,event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING),
     w2 AS (PARTITION BY issuer_cik,insider_id,ticker,run)""",
    ("pe",),
)
def a2_members(spark, sf_dir):
    events = tables.events(spark, sf_dir)
    campaigns = event_ops.purchase_campaigns(events).select(
        "campaign_id", "first_event_id", F.col("event_count").cast("bigint").alias("run_size")
    )
    return event_ops.campaign_members(events).join(campaigns, "campaign_id").select(
        F.concat_ws(">", "first_event_id", "event_id").alias("member"), "transaction_date", "run_size"
    )


@query(
    "s14_weekday_gap",
    """SELECT accession_number, line_no, part_no, transaction_date, filing_date,
     CAST(len(list_filter(generate_series(CAST(0 AS BIGINT), CAST(filing_date-transaction_date AS BIGINT)), lambda i: isodow(transaction_date+CAST(i AS INTEGER))<6))-1 AS INTEGER) AS weekday_gap
    FROM lots""",
    ("lots",),
)
def s14(spark, sf_dir):
    return tables.lots(spark, sf_dir).select(
        "accession_number", "line_no", "part_no", "transaction_date", "filing_date",
        weekday_gap(F.col("transaction_date"), F.col("filing_date")).alias("weekday_gap"),
    )


# --- prices -----------------------------------------------------------------------------------------------------

@query(
    "j4_forward_asof_session",
    f"""SELECT event_id, price_available, price_context_date, {rs('transaction_date_close')} FROM priced""",
    ("priced",),
)
def j4(spark, sf_dir):
    events, sessions = tables.events(spark, sf_dir), tables.prices(spark, sf_dir).select("ticker", "date", "close")
    days = events.select("ticker", F.col("transaction_date").alias("day"))
    found = match_sessions(days, sessions).select(
        "ticker", F.col("day").alias("transaction_date"),
        F.col("next_session.date").alias("price_context_date"), F.col("next_session.close").alias("transaction_date_close"),
    )
    out = events.join(found, ["ticker", "transaction_date"], "left")
    return rounded(out.select(
        "event_id", F.col("price_context_date").isNotNull().alias("price_available"), "price_context_date", "transaction_date_close"
    ), 6, "transaction_date_close")


@query(
    "j5_asof_with_end_clamp",
    """SELECT event_id, coalesce(n.date, l.last_date) AS price_date FROM pe e
    ASOF LEFT JOIN (SELECT ticker, date FROM prices) n ON e.ticker=n.ticker AND e.transaction_date<=n.date
    LEFT JOIN (SELECT ticker, max(date) AS last_date FROM prices GROUP BY 1) l ON l.ticker=e.ticker""",
    ("pe", "prices"),
)
def j5(spark, sf_dir):
    events = tables.events(spark, sf_dir)
    days = events.select("ticker", F.col("transaction_date").alias("day"))
    found = match_sessions(days, tables.prices(spark, sf_dir).select("ticker", "date"))
    clamped = found.select(
        "ticker", F.col("day").alias("transaction_date"),
        F.coalesce("next_session.date", "previous_session.date").alias("price_date"),
    )
    return events.join(clamped, ["ticker", "transaction_date"], "left").select("event_id", "price_date")


@query(
    "j6_nearest_session",
    """SELECT event_id, CASE WHEN b.date IS NULL THEN f.date WHEN f.date IS NULL THEN b.date
      WHEN e.transaction_date-b.date<=f.date-e.transaction_date THEN b.date ELSE f.date END AS nearest_date
    FROM pe e ASOF LEFT JOIN (SELECT ticker, date FROM prices) f ON e.ticker=f.ticker AND e.transaction_date<=f.date
    ASOF LEFT JOIN (SELECT ticker, date FROM prices) b ON e.ticker=b.ticker AND e.transaction_date>=b.date""",
    ("pe", "prices"),
)
def j6(spark, sf_dir):
    events = tables.events(spark, sf_dir)
    days = events.select("ticker", F.col("transaction_date").alias("day"))
    found = nearest_session(match_sessions(days, tables.prices(spark, sf_dir).select("ticker", "date")))
    near = found.select("ticker", F.col("day").alias("transaction_date"), F.col("nearest_session.date").alias("nearest_date"))
    return events.join(near, ["ticker", "transaction_date"], "left").select("event_id", "nearest_date")


_W11 = ["prior_session_close", "return_prior_21d", "return_prior_63d", "return_prior_126d",
        *[f"evaluation_forward_return_{n}d" for n in params.FORWARD_SESSIONS]]


@query("w11_session_returns", f"SELECT ticker, date, {rs(*_W11)} FROM sessions", ("sessions",))
def w11(spark, sf_dir):
    return rounded(price_ops.session_context(tables.prices(spark, sf_dir)).select("ticker", "date", *_W11), 6, *_W11)


_W12 = ["drawdown_52w", "drawdown_3y", "distance_200d_ma", "realized_volatility_63d"]


@query(
    "w12_drawdown_mean_volatility",
    f"SELECT ticker, date, {rs(*_W12)}, {r('average_dollar_volume_63d', 2)} AS average_dollar_volume_63d FROM sessions",
    ("sessions",),
)
def w12(spark, sf_dir):
    df = price_ops.session_context(tables.prices(spark, sf_dir)).select("ticker", "date", *_W12, "average_dollar_volume_63d")
    return rounded(rounded(df, 6, *_W12), 2, "average_dollar_volume_63d")


@query("w13_split_factor", "SELECT ticker, date, split_factor_after FROM sessions", ("sessions",))
def w13(spark, sf_dir):
    return price_ops.session_context(tables.prices(spark, sf_dir)).select("ticker", "date", "split_factor_after")


_PX = ["drawdown_52w", "return_prior_21d", "realized_volatility_63d", "evaluation_forward_return_21d"]


@query(
    "j4_purchase_price_context",
    f"""SELECT event_id, price_available, price_context_date, {rs(*_PX)}, split_factor_after_event,
     {r('total_shares*split_factor_after_event')} AS split_adjusted_shares, {r('weighted_average_price/split_factor_after_event')} AS split_adjusted_price
    FROM priced""",
    ("priced",),
)
def price_context(spark, sf_dir):
    df = price_ops.add_price_context(tables.events(spark, sf_dir), tables.prices(spark, sf_dir)).select(
        "event_id", "price_available", "price_context_date", *_PX, "split_factor_after_event",
        "split_adjusted_shares", "split_adjusted_price",
    )
    return rounded(df, 6, *_PX, "split_adjusted_shares", "split_adjusted_price")


# --- history ----------------------------------------------------------------------------------------------------

@query(
    "w1_causal_history",
    f"""SELECT event_id, prior_purchase_count, {r('cumulative_prior_purchase_value', 2)} AS cumulative_prior_purchase_value,
     floor(prior_mean_purchase_value*1e4+0.500001e0)/1e4 AS prior_mean_purchase_value, largest_prior_purchase_value,
     {r('prior_median_purchase_value', 4)} AS prior_median_purchase_value,
     {rs('prior_median_ownership_increase_percent')}, first_prior_purchase_date, previous_purchase_date FROM hist""",
    ("hist",),
)
def w1(spark, sf_dir):
    df = tables.build_histories(spark, sf_dir).select(
        "event_id", "prior_purchase_count", "cumulative_prior_purchase_value", "prior_mean_purchase_value",
        "largest_prior_purchase_value", "prior_median_purchase_value", "prior_median_ownership_increase_percent",
        "first_prior_purchase_date", "previous_purchase_date",
    )
    df = rounded(df, 2, "cumulative_prior_purchase_value")
    # Means of cent amounts often end in exactly half a unit; the small extra keeps those up in both engines.
    mean = F.floor(F.col("prior_mean_purchase_value") * 1e4 + 0.500001) / 1e4
    df = rounded(df.withColumn("prior_mean_purchase_value", mean), 4, "prior_median_purchase_value")
    return rounded(df, 6, "prior_median_ownership_increase_percent")


@query(
    "w2_trailing_counts",
    "SELECT event_id, purchase_count_1y, purchase_count_3y, purchase_count_5y FROM hist",
    ("hist",),
)
def w2(spark, sf_dir):
    return tables.daily_histories(tables.events(spark, sf_dir)).select("event_id", *params.HISTORY_DAYS)


@query("w3_days_since_previous", "SELECT event_id, days_since_previous_purchase FROM hist", ("hist",))
def w3(spark, sf_dir):
    return tables.daily_histories(tables.events(spark, sf_dir)).select("event_id", "days_since_previous_purchase")


@query("w4_prior_gaps", "SELECT event_id, median_prior_gap_days, longest_prior_gap_days FROM hist", ("hist",))
def w4(spark, sf_dir):
    return tables.daily_histories(tables.events(spark, sf_dir)).select("event_id", "median_prior_gap_days", "longest_prior_gap_days")


@query("w5_prior_value_percentile", f"SELECT event_id, {rs('prior_purchase_value_percentile')} FROM hist", ("hist",))
def w5(spark, sf_dir):
    df = tables.histories(spark, sf_dir).select("event_id", "prior_purchase_value_percentile")
    return rounded(df, 6, "prior_purchase_value_percentile")


@query(
    "w6_history_depth",
    """SELECT event_id, history_depth, history_quality, CASE WHEN prior_purchase_count=0 THEN 'no_prior_history'
     WHEN prior_purchase_count<=2 THEN 'sparse_prior_history' ELSE '' END AS quality_flags FROM hist""",
    ("hist",),
)
def w6(spark, sf_dir):
    return tables.daily_histories(tables.events(spark, sf_dir)).select("event_id", "history_depth", "history_quality", "quality_flags")


@query("a26_history_depth_distribution", "SELECT history_depth, count(*) AS purchases FROM hist GROUP BY 1", ("hist",))
def a26(spark, sf_dir):
    return tables.histories(spark, sf_dir).groupBy("history_depth").agg(F.count(F.lit(1)).alias("purchases"))


# --- signals ----------------------------------------------------------------------------------------------------

_W7 = ["purchase_multiple", "largest_prior_multiple", "historical_percentile", "robust_z", "robust_z_display", "abnormality_score"]


@query(
    "w7_abnormality",
    f"SELECT event_id, {rs(*_W7)}, abnormality_quality, first_ever_purchase FROM sig",
    ("sig",),
)
def w7(spark, sf_dir):
    df = tables.histories(spark, sf_dir).withColumns(signal_ops.abnormality_columns())
    return rounded(df.select("event_id", *_W7, "abnormality_quality", "first_ever_purchase"), 6, *_W7)


@query(
    "w8_velocity",
    f"""SELECT event_id, {", ".join(f"purchase_value_{n}d, purchase_count_{n}d" for n in params.VELOCITY_DAYS)},
     {rs('velocity_multiple', 'velocity_score')}, CASE WHEN sequence>=3 THEN 'high' ELSE 'limited' END AS velocity_quality FROM sig""",
    ("sig",),
)
def w8(spark, sf_dir):
    df = tables.histories(spark, sf_dir).withColumns(signal_ops.velocity_columns())
    named = [f"purchase_{k}_{n}d" for n in params.VELOCITY_DAYS for k in ("value", "count")]
    return rounded(df.select("event_id", *named, "velocity_multiple", "velocity_score", "velocity_quality"), 6, "velocity_multiple", "velocity_score")


_W9 = ["unique_buyers", "unique_operating_executives", "ceo_present", "cfo_present", "founder_present"]


@query(
    "w9_buyer_clusters",
    f"""SELECT issuer_cik, transaction_date, {", ".join(_W9)}, unique_buyers>1 AND unique_operating_executives=0 AS director_only_cluster,
     cluster_purchase_value, least(100e0, 25e0*unique_buyers+15e0*CAST(ceo_present AS INTEGER)+15e0*CAST(cfo_present AS INTEGER)+15e0*CAST(founder_present AS INTEGER)) AS cluster_score
    FROM clusters""",
    ("clusters",),
)
def w9(spark, sf_dir):
    return signal_ops.buyer_clusters(tables.events(spark, sf_dir)).select(
        "issuer_cik", "transaction_date", *_W9, "director_only_cluster", "cluster_purchase_value", "cluster_score"
    )


@query(
    "j12_interval_members",
    """SELECT d.issuer_cik, d.transaction_date, count(*) AS purchases, round(sum(e.purchase_value),2) AS value, max(e.purchase_value) AS largest
    FROM (SELECT DISTINCT issuer_cik, transaction_date FROM pe) d JOIN pe e ON e.issuer_cik=d.issuer_cik
     AND e.transaction_date BETWEEN d.transaction_date-14 AND d.transaction_date GROUP BY 1,2""",
    ("pe",),
)
def j12(spark, sf_dir):
    from pyspark.sql import Window

    days = tables.events(spark, sf_dir).groupBy("issuer_cik", "transaction_date").agg(
        F.count(F.lit(1)).alias("n"), F.sum("purchase_value").alias("v"), F.max("purchase_value").alias("m")
    )
    frame = Window.partitionBy("issuer_cik").orderBy(F.unix_date("transaction_date")).rangeBetween(-params.CLUSTER_DAYS, 0)
    return days.select(
        "issuer_cik", "transaction_date", F.sum("n").over(frame).alias("purchases"),
        F.round(F.sum("v").over(frame), 2).alias("value"), F.max("m").over(frame).alias("largest"),
    )


@query(
    "w10_acceleration",
    f"SELECT event_id, {rs('value_acceleration', 'frequency_acceleration', 'acceleration_score')}, acceleration_sample_count FROM sig",
    ("sig",),
)
def w10(spark, sf_dir):
    names = ["value_acceleration", "frequency_acceleration", "acceleration_score"]
    df = tables.histories(spark, sf_dir).withColumns(signal_ops.acceleration_columns())
    return rounded(df.select("event_id", *names, "acceleration_sample_count"), 6, *names)


@query("s13_silence_break", f"SELECT event_id, {rs('gap_multiple', 'silence_break_score')} FROM sig", ("sig",))
def s13(spark, sf_dir):
    df = tables.signals(spark, sf_dir).select("event_id", "gap_multiple", "silence_break_score")
    return rounded(df, 6, "gap_multiple", "silence_break_score")


@query(
    "s15_drawdown_label",
    """SELECT event_id, CASE WHEN drawdown_52w IS NULL THEN 'unknown' WHEN drawdown_52w>-0.1e0 THEN 'near_highs'
     WHEN drawdown_52w>-0.25e0 THEN 'moderate_pullback' WHEN drawdown_52w<=-0.5e0 AND coalesce(return_prior_21d,0)>0 THEN 'early_recovery'
     WHEN drawdown_52w<=-0.5e0 THEN 'post_capitulation' ELSE 'deep_drawdown' END AS drawdown_label FROM priced""",
    ("priced",),
)
def s15(spark, sf_dir):
    return tables.priced_events(spark, sf_dir).select(
        "event_id", signal_ops.drawdown_label(F.col("drawdown_52w"), F.col("return_prior_21d")).alias("drawdown_label")
    )


@query("s16_role_score", "SELECT event_id, role_score FROM scored_parts", ("scored_parts",))
def s16(spark, sf_dir):
    from stakewatch.functions.roles import role_score

    return tables.events(spark, sf_dir).select("event_id", role_score(F.col("normalized_roles")).alias("role_score"))


_PARTS = list(params.BEHAVIOR_COLUMNS.values())


@query(
    "s17_behavior_score",
    f"""SELECT event_id, behavior_change_score, {rs(*_PARTS)},
     array_to_string(list_filter([{", ".join(f"CASE WHEN {c} IS NULL THEN '{c}' END" for c in _PARTS)}], lambda x: x IS NOT NULL),'|') AS behavior_missing FROM sig""",
    ("sig",),
)
def s17(spark, sf_dir):
    df = tables.signals(spark, sf_dir)
    parts = {c: round_to(F.col("behavior_components")[c], 6) for c in _PARTS}
    return df.withColumns(parts).select(
        "event_id", "behavior_change_score", *_PARTS, joined(F.col("behavior_missing")).alias("behavior_missing")
    )


@query(
    "s18_conviction_score",
    "SELECT event_id, conviction_score, conviction_grade, reason_codes FROM sig",
    ("sig",),
)
def s18(spark, sf_dir):
    return tables.signals(spark, sf_dir).select(
        "event_id", "conviction_score", "conviction_grade", joined(F.col("reason_codes")).alias("reason_codes")
    )


@query(
    "s18_conviction_parts",
    f"""SELECT event_id, {r("least(100e0,log10(greatest(purchase_value,1e0))/7*100)")} AS size_part, coalesce({r('ownership_score')},0e0) AS ownership_part,
     cluster_score AS cluster_part, CASE WHEN direct_indirect_code='I' THEN 8e0 ELSE 0e0 END AS indirect_penalty FROM sig""",
    ("sig",),
)
def s18_parts(spark, sf_dir):
    parts, off = F.col("conviction_components"), F.col("conviction_penalties")
    return tables.signals(spark, sf_dir).select(
        "event_id",
        round_to(parts["absolute_purchase_size"], 6).alias("size_part"),
        round_to(parts["ownership_increase"], 6).alias("ownership_part"),
        parts["cluster_confirmation"].alias("cluster_part"),
        F.coalesce(F.try_element_at(off, F.lit("indirect_only")), F.lit(0.0)).alias("indirect_penalty"),
    )


@query(
    "a17_best_purchase_per_issuer",
    "SELECT issuer_cik, arg_max(event_id,(conviction_score,event_id)) AS event_id, max(conviction_score) AS conviction_score FROM sig GROUP BY 1",
    ("sig",),
)
def a17(spark, sf_dir):
    return signal_ops.best_per_issuer(tables.signals(spark, sf_dir).select("issuer_cik", "event_id", "conviction_score"))


@query(
    "p7_discovery_eligibility",
    f"""SELECT issuer_cik, discovery_eligible, array_to_string(eligibility_reasons,'|') AS eligibility_reasons, {r('latest_price')} AS latest_price,
     {r('average_dollar_volume_63d', 2)} AS average_dollar_volume_63d FROM context""",
    ("context",),
)
def p7(spark, sf_dir):
    df = price_ops.company_context(tables.companies(spark, sf_dir), tables.prices(spark, sf_dir)).select(
        "issuer_cik", "discovery_eligible", joined(F.col("eligibility_reasons")).alias("eligibility_reasons"),
        "latest_price", "average_dollar_volume_63d",
    )
    return rounded(rounded(df, 6, "latest_price"), 2, "average_dollar_volume_63d")


# --- rankings ---------------------------------------------------------------------------------------------------

_RANK = [
    "rank", "ticker", "issuer_cik", "company_name", "market_cap", "sector", "buyer_count", "latest_transaction_date", "latest_filing_date",
    "purchase_value", "conviction_score", "score_quality", "headline", "source_accession_numbers", "stable_key", "ranking_score",
]


def _one_category(number: int, name: str) -> None:
    rule, score = RULES[name]

    def run(spark, sf_dir):
        # Straight from the signals: qualify, score and rank in one job.
        return ranking_ops.rank_discoveries(tables.signals(spark, sf_dir), [name]).select(*_RANK)

    query(f"r{number}_{name}", f"SELECT {', '.join(_RANK)} FROM ranked WHERE ranking_category='{name}'", ("ranked",))(run)


for _i, _name in enumerate(params.CATEGORIES, start=1):
    _one_category(_i, _name)


@query(
    "r8_latest_rankings",
    "SELECT ranking_category, rank, event_id, stable_key, ranking_score FROM ranked",
    ("ranked",),
)
def r8(spark, sf_dir):
    return ranking_ops.rank_discoveries(tables.signals(spark, sf_dir)).select(
        "ranking_category", "rank", "event_id", "stable_key", "ranking_score"
    )


@query(
    "r10_headline_and_role",
    f"SELECT event_id, ranking_category, headline, {role_label_sql('normalized_roles')} AS role_label FROM ranked",
    ("ranked",),
)
def r10(spark, sf_dir):
    rows = ranking_ops.discovery_rows(tables.signals(spark, sf_dir))
    return rows.select("event_id", "ranking_category", "headline", role_label(F.col("normalized_roles")).alias("role_label"))
