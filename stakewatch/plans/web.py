"""Queries behind the pages: sectors, days, periods, evidence, stories, dossiers, charts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from stakewatch import params
from stakewatch.functions import narrative
from stakewatch.functions.dates import parse_date
from stakewatch.functions.numeric import round_to
from stakewatch.functions.text import joined, slug, tolerant_boolean
from stakewatch.operators import activity, dossiers, evidence, rankings, stories, visuals
from stakewatch.operators import prices as price_ops
from stakewatch.operators.events import purchase_campaigns
from stakewatch.operators.grouping import exact_median, first_per_key, last_per_key, rank_rows, top_per_key
from stakewatch.operators.signals import best_per_issuer
from stakewatch.plans import tables
from stakewatch.plans.core import _RUN, rounded, rs
from stakewatch.plans.normal import pick, pick_sql
from stakewatch.plans.oracle import add_view, clip, compact, feed_money, fixed, money, r, sid, trimmed
from stakewatch.plans.registry import query


def company_index(spark, sf_dir) -> DataFrame:
    return tables.company_context(spark, sf_dir).withColumn("slug", slug(F.col("ticker")))


def people(spark, sf_dir) -> DataFrame:
    return tables.insiders(spark, sf_dir).withColumn("raw_officer_title", F.lit("Officer"))


def with_strangers(companies: DataFrame) -> DataFrame:
    """The companies, and as many more that nothing else knows."""
    return companies.unionByName(companies.withColumn("issuer_cik", F.concat(F.lit("X"), "issuer_cik")))


def sections(spark, sf_dir) -> DataFrame:
    """Discovery sections: the first hundred of each category."""
    return rankings.sections(tables.ranked(spark, sf_dir), 100)


_SECTION = "CASE ranking_category " + " ".join(f"WHEN '{c}' THEN {i}" for i, c in enumerate(params.CATEGORIES, 1)) + " ELSE 0 END"
add_view("section_items", f"SELECT *, {_SECTION} AS section_no FROM ranked WHERE rank<=100")
add_view("ranked_items", f"SELECT *, {_SECTION} AS section_no FROM ranked")

# --- sectors, days, totals --------------------------------------------------------------------------------------

_SECTOR_FIGURES = """sector, count(*) AS signal_count, count(DISTINCT issuer_cik) AS company_count, count(DISTINCT insider_id) AS buyer_count,
 round(sum(purchase_value),2) AS purchase_value, median(conviction_score) AS median_conviction, median(behavior_change_score) AS median_behavior_change,
 sum(CASE WHEN cluster_score>0 THEN 1 ELSE 0 END)::BIGINT AS cluster_count"""


@query(
    "a6_sector_activity",
    f"""SELECT {_SECTOR_FIGURES}, {r("count(DISTINCT issuer_cik)*1e0/greatest(1,(SELECT count(DISTINCT issuer_cik) FROM sig WHERE discovery_eligible))")} AS eligible_universe_share FROM sig GROUP BY sector""",
    ("sig",),
)
def a6(spark, sf_dir):
    return rounded(activity.sector_activity(tables.signals(spark, sf_dir)), 6, "eligible_universe_share")


@query(
    "a7_sector_payload",
    f"""SELECT {_SECTOR_FIGURES}, {r("count(DISTINCT issuer_cik)*1e0/greatest(1,(SELECT count(*) FROM context WHERE discovery_eligible))")} AS eligible_universe_share
    FROM (SELECT s.* EXCLUDE (sector), c.sector FROM sig s LEFT JOIN context c USING (issuer_cik)) GROUP BY sector""",
    ("sig", "context"),
)
def a7(spark, sf_dir):
    return activity.sector_payload(tables.signals(spark, sf_dir), tables.company_context(spark, sf_dir))


@query(
    "j8_signal_sectors",
    "SELECT s.event_id, c.sector FROM sig s LEFT JOIN context c USING (issuer_cik)",
    ("sig", "context"),
)
def j8(spark, sf_dir):
    companies = tables.company_context(spark, sf_dir).select("issuer_cik", "sector")
    return tables.signals(spark, sf_dir).select("event_id", "issuer_cik").join(companies, "issuer_cik", "left").select("event_id", "sector")


@query(
    "a8_daily_activity",
    """SELECT transaction_date AS date, count(*) AS event_count, count(DISTINCT issuer_cik) AS company_count, count(DISTINCT insider_id) AS buyer_count,
     round(sum(purchase_value),2) AS purchase_value, median(conviction_score) AS median_conviction, max(purchase_value) AS largest_purchase FROM sig GROUP BY 1""",
    ("sig",),
)
def a8(spark, sf_dir):
    return activity.daily_activity(tables.events(spark, sf_dir), tables.signals(spark, sf_dir))


@query(
    "j7_event_scores",
    "SELECT event_id, conviction_score, behavior_change_score, cluster_score FROM sig",
    ("sig",),
)
def j7(spark, sf_dir):
    signals = tables.signals(spark, sf_dir)
    twice = signals.unionByName(signals.withColumn("conviction_score", F.col("conviction_score") - 1))
    return stories.with_signal_scores(tables.events(spark, sf_dir), twice).select(
        "event_id", "conviction_score", "behavior_change_score", "cluster_score"
    )


@query(
    "a9_overview_counts",
    f"""SELECT (SELECT count(*) FROM lots) AS normalized_transactions, (SELECT count(*) FROM lots WHERE is_qualifying_purchase) AS qualifying_purchases,
     count(*) AS event_signals, count(DISTINCT issuer_cik) AS active_companies, sum(CASE WHEN conviction_score>=85 THEN 1 ELSE 0 END)::BIGINT AS exceptional_signals,
     sum(CASE WHEN cluster_score>0 THEN 1 ELSE 0 END)::BIGINT AS cluster_signals, median(conviction_score) AS median_conviction, median(behavior_change_score) AS median_behavior_change,
     round(sum(purchase_value),2) AS total_reported_purchase_value, (SELECT count(*) FROM context) AS companies, (SELECT count(*) FROM context WHERE discovery_eligible) AS eligible_companies FROM sig""",
    ("sig", "lots", "context"),
)
def a9(spark, sf_dir):
    lots, context = tables.lots(spark, sf_dir), tables.company_context(spark, sf_dir)
    return tables.signals(spark, sf_dir).agg(
        lots.agg(F.count(F.lit(1))).scalar().alias("normalized_transactions"),
        lots.agg(F.count_if("is_qualifying_purchase")).scalar().alias("qualifying_purchases"),
        F.count(F.lit(1)).alias("event_signals"), F.countDistinct("issuer_cik").alias("active_companies"),
        F.count_if(F.col("conviction_score") >= 85).alias("exceptional_signals"), F.count_if(F.col("cluster_score") > 0).alias("cluster_signals"),
        F.median("conviction_score").alias("median_conviction"), F.median("behavior_change_score").alias("median_behavior_change"),
        F.round(F.sum("purchase_value"), 2).alias("total_reported_purchase_value"),
        context.agg(F.count(F.lit(1))).scalar().alias("companies"), context.agg(F.count_if("discovery_eligible")).scalar().alias("eligible_companies"),
    )


@query(
    "a9_overview",
    f"""SELECT (SELECT count(*) FROM lots) AS normalized_transactions, (SELECT count(*) FROM lots WHERE is_qualifying_purchase) AS qualifying_purchases, (SELECT count(*) FROM pe) AS purchase_events,
     count(*) AS event_signals, count(DISTINCT issuer_cik) AS company_signals, (SELECT count(*) FROM context) AS companies, (SELECT count(*) FROM context WHERE discovery_eligible) AS eligible_companies,
     sum(CASE WHEN conviction_score>=85 THEN 1 ELSE 0 END)::BIGINT AS exceptional_signals, sum(CASE WHEN cluster_score>0 THEN 1 ELSE 0 END)::BIGINT AS cluster_signals,
     median(behavior_change_score) AS median_behavior_change, median(conviction_score) AS median_conviction, (SELECT round(sum(purchase_value),2) FROM pe) AS total_reported_purchase_value, count(DISTINCT issuer_cik) AS active_company_count FROM sig""",
    ("sig", "lots", "pe", "context"),
)
def a9_overview(spark, sf_dir):
    return activity.overview(tables.lots(spark, sf_dir), tables.events(spark, sf_dir), tables.signals(spark, sf_dir), tables.company_context(spark, sf_dir))


@query(
    "a9_featured_discoveries",
    "SELECT rank, nullif(ticker,'') AS ticker, headline, conviction_score, purchase_value FROM ranked WHERE ranking_category='under_the_radar' AND rank<=12",
    ("ranked",),
)
def a9_featured(spark, sf_dir):
    """Cards of the first page: the first twelve of one category."""
    mine = rankings.sections(tables.ranked(spark, sf_dir).filter("ranking_category = 'under_the_radar'"), 12)
    return rankings.ranking_cards(mine).select("rank", "ticker", "headline", "conviction_score", "purchase_value")


@query(
    "a9_quality_summary",
    """SELECT 'transactions' AS artifact, quality, count(*) AS records FROM lots GROUP BY 2 UNION ALL SELECT 'purchase_events', event_quality, count(*) FROM pe GROUP BY 2
     UNION ALL SELECT 'event_signals', history_quality, count(*) FROM sig GROUP BY 2 UNION ALL SELECT 'companies', 'unknown', count(*) FROM context""",
    ("lots", "pe", "sig", "context"),
)
def a9_quality(spark, sf_dir):
    return activity.quality_summary_of({
        "transactions": (tables.lots(spark, sf_dir).withColumn("quality", F.upper("quality")), "quality"), "purchase_events": (tables.events(spark, sf_dir), "event_quality"),
        "event_signals": (tables.signals(spark, sf_dir), "history_quality"), "companies": (tables.company_context(spark, sf_dir).withColumn("quality", F.lit(" ")), "quality"),
    })


@query(
    "a10_quality_counts",
    "SELECT quality, count(*) AS records FROM (SELECT quality FROM lots UNION ALL SELECT event_quality FROM pe UNION ALL SELECT history_quality FROM hist) GROUP BY 1",
    ("lots", "pe", "hist"),
)
def a10(spark, sf_dir):
    parts = [
        tables.lots(spark, sf_dir).select(F.upper("quality").alias("quality")),
        tables.events(spark, sf_dir).select(F.col("event_quality").alias("quality")),
        tables.histories(spark, sf_dir).select(F.col("history_quality").alias("quality")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy(F.lower("quality").alias("quality")).agg(F.count(F.lit(1)).alias("records"))


@query(
    "a11_company_stats",
    """SELECT issuer_cik, count(*) AS purchase_event_count, count(DISTINCT insider_id) AS unique_buyer_count, round(sum(purchase_value),2) AS total_purchase_value,
     max(purchase_value) AS largest_purchase_value, median(conviction_score) AS median_conviction, max(behavior_change_score) AS highest_behavior_change FROM sig GROUP BY 1""",
    ("sig",),
)
def a11(spark, sf_dir):
    return activity.company_stats(tables.events(spark, sf_dir), tables.signals(spark, sf_dir))


@query(
    "a12_person_profile",
    f"""SELECT insider_id, count(*) AS purchase_count, count(DISTINCT issuer_cik) AS company_count, round(sum(purchase_value),2) AS total_purchase_value, {r('median(purchase_value)', 4)} AS median_purchase_value,
     max(purchase_value) AS largest_purchase_value, median(nullif(median_prior_gap_days,0)) AS median_days_between_purchases, max(behavior_change_score) AS highest_behavior_change,
     max(conviction_score) AS highest_conviction FROM sig GROUP BY 1""",
    ("sig",),
)
def a12(spark, sf_dir):
    signals = tables.signals(spark, sf_dir)
    return rounded(activity.person_profile(tables.events(spark, sf_dir), signals, signals), 4, "median_purchase_value")


@query(
    "a13_average_purchase_price",
    f"SELECT ticker, {r('sum(weighted_average_price*total_shares)/sum(total_shares)', 4)} AS average_reported_purchase_price FROM pe GROUP BY 1",
    ("pe",),
)
def a13(spark, sf_dir):
    return rounded(stories.average_cost(tables.events(spark, sf_dir), ["ticker"]), 4, "average_reported_purchase_price")


@query(
    "a13_price_fallbacks",
    f"""SELECT k AS kind, {r('sum(p*w)/sum(w)', 4)} AS average_reported_purchase_price FROM (SELECT hash_no%4 AS k,
      CASE hash_no%4 WHEN 0 THEN price_per_share WHEN 1 THEN price_per_share WHEN 2 THEN reported_value/shares END AS p,
      CASE hash_no%4 WHEN 1 THEN reported_value/price_per_share ELSE shares END AS w FROM (SELECT *, part_no AS hash_no FROM lots)) WHERE p>0 AND w>0 GROUP BY 1""",
    ("lots",),
)
def a13_fallbacks(spark, sf_dir):
    kind = F.col("part_no") % 4
    lots = tables.lots(spark, sf_dir).select(
        kind.alias("kind"),
        F.when(kind == 0, F.col("price_per_share").cast("string")).when(kind == 1, "none").otherwise("-1").alias("weighted_average_price"),
        F.when(kind == 1, F.col("price_per_share")).alias("price_per_share"),
        F.when(kind != 1, F.col("shares")).alias("shares"),
        F.when(kind != 3, F.col("reported_value")).alias("purchase_value"),
    )
    return rounded(stories.average_cost(lots, ["kind"]), 4, "average_reported_purchase_price")


@query(
    "a16_latest_per_issuer",
    "SELECT issuer_cik, arg_max(event_id,(transaction_date,event_id)) AS event_id, max(transaction_date) AS transaction_date FROM sig GROUP BY 1",
    ("sig",),
)
def a16(spark, sf_dir):
    return activity.latest_per_key(tables.signals(spark, sf_dir).select("issuer_cik", "event_id", "transaction_date"), "issuer_cik", "transaction_date", "event_id")


@query(
    "j9_companies_with_latest_signal",
    """SELECT c.issuer_cik, c.company_name, l.event_id, l.conviction_score FROM (SELECT issuer_cik, company_name FROM companies UNION ALL SELECT 'X'||issuer_cik, company_name FROM companies) c LEFT JOIN (SELECT issuer_cik, arg_max(event_id,(transaction_date,event_id)) AS event_id,
     arg_max(conviction_score,(transaction_date,event_id)) AS conviction_score FROM sig GROUP BY 1) l USING (issuer_cik)""",
    ("sig", "companies"),
)
def j9(spark, sf_dir):
    signals = tables.signals(spark, sf_dir).select("issuer_cik", "event_id", "transaction_date", "conviction_score")
    latest = activity.latest_per_key(signals, "issuer_cik", "transaction_date", "event_id").drop("transaction_date")
    return with_strangers(tables.companies(spark, sf_dir)).select("issuer_cik", "company_name").join(latest, "issuer_cik", "left")


# --- periods ----------------------------------------------------------------------------------------------------

def _daily_source(spark, sf_dir) -> DataFrame:
    """Daily rows, some without company number so that the ticker must match, and more rows of companies that are not known."""
    number = F.col("issuer_cik").cast("bigint")
    daily = tables.signals(spark, sf_dir).select(
        "event_id", "filing_date", "transaction_date", "ticker", F.when(number % 7 == 0, "").otherwise(F.col("issuer_cik")).alias("issuer_cik"),
        "company_name", "sector", "industry", "owner_cik", F.concat(F.lit("Buyer "), "owner_cik").alias("owner_name"), "purchase_value",
        F.col("unique_buyers").alias("buyer_count"), "conviction_score", "behavior_change_score", "cluster_score", "silence_break_score",
        "days_since_previous_purchase", F.lit("").alias("headline"), F.lit("").alias("ranking_category"), number.alias("_number"),
    )
    strangers = daily.filter("_number % 10 = 9").withColumns({"event_id": F.concat("event_id", F.lit("-x")), "ticker": F.lit("NOSUCH"), "issuer_cik": F.lit("9999999999")})
    return daily.unionByName(strangers).drop("_number")


def _sources(spark, sf_dir):
    """Daily rows, discoveries and companies."""
    found = tables.ranked(spark, sf_dir).select(
        "event_id", F.col("latest_filing_date").alias("filing_date"), F.col("latest_transaction_date").alias("transaction_date"), "ticker", "issuer_cik",
        "company_name", "sector", "industry", F.lit("").alias("owner_cik"), F.lit("").alias("owner_name"), "purchase_value", "buyer_count", "conviction_score",
        "behavior_change_score", "cluster_score", "silence_break_score", "days_since_previous_purchase", "headline", "ranking_category", "rank",
    )
    return _daily_source(spark, sf_dir), found, company_index(spark, sf_dir)


def items(spark, sf_dir) -> DataFrame:
    return tables.stage(spark, sf_dir, "activity_items", lambda s, d: activity.activity_events(*_sources(s, d)))


add_view(
    "all_items",
    """SELECT event_id, filing_date, transaction_date, ticker, CASE WHEN CAST(issuer_cik AS BIGINT)%7=0 THEN '' ELSE issuer_cik END AS raw_cik, issuer_cik, company_name, sector, industry,
      owner_cik, 'Buyer '||owner_cik AS owner_name, purchase_value, unique_buyers AS buyer_count, conviction_score, behavior_change_score, cluster_score, silence_break_score,
      coalesce(days_since_previous_purchase,0)*1e0 AS days_since_previous_purchase, '' AS headline, 0 AS source, 0 AS section_no, 0 AS rank, true AS known FROM sig
     UNION ALL SELECT event_id||'-x', filing_date, transaction_date, 'NOSUCH', '9999999999', '9999999999', company_name, sector, industry, owner_cik, 'Buyer '||owner_cik, purchase_value, unique_buyers, conviction_score, behavior_change_score,
      cluster_score, silence_break_score, coalesce(days_since_previous_purchase,0)*1e0, '', 0, 0, 0, false FROM sig WHERE CAST(issuer_cik AS BIGINT)%10=9
     UNION ALL SELECT event_id, latest_filing_date, latest_transaction_date, ticker, issuer_cik, issuer_cik, company_name, sector, industry, '', '', purchase_value, buyer_count, conviction_score,
      behavior_change_score, cluster_score, silence_break_score, coalesce(days_since_previous_purchase,0)*1e0, headline, 1, section_no, rank, true FROM ranked_items""",
)
add_view(
    "items",
    """SELECT filing_date, transaction_date, ticker, issuer_cik, company_name, sector, industry, lower(ticker) AS company_slug, owner_cik, owner_name, purchase_value, greatest(1,buyer_count) AS buyer_count,
     conviction_score, behavior_change_score, cluster_score, silence_break_score, days_since_previous_purchase, headline FROM (
      SELECT *, row_number() OVER (PARTITION BY filing_date,transaction_date,issuer_cik,ticker,CASE WHEN owner_cik<>'' THEN owner_cik ELSE owner_name END,purchase_value
        ORDER BY source,section_no,rank,event_id) AS rn FROM all_items WHERE known) WHERE rn=1""",
)


@query("u4_activity_events", "SELECT * FROM items", ("items",))
def u4(spark, sf_dir):
    return activity.activity_events(*_sources(spark, sf_dir))


@query(
    "j10_company_fallback_drop",
    "SELECT event_id, CASE WHEN raw_cik='' THEN 'ticker' ELSE 'cik' END AS way, issuer_cik AS company_cik FROM all_items WHERE source=0 AND known",
    ("all_items",),
)
def j10(spark, sf_dir):
    daily, index = _daily_source(spark, sf_dir), company_index(spark, sf_dir)
    return activity.resolve_company(daily, index, keep=False).select(
        "event_id", F.when(F.col("issuer_cik") == "", "ticker").otherwise("cik").alias("way"), F.col("company.issuer_cik").alias("company_cik")
    )


@query(
    "j10_company_fallback_keep",
    "SELECT event_id, CASE WHEN known THEN issuer_cik END AS company_cik FROM all_items WHERE source=0",
    ("all_items",),
)
def j10_keep(spark, sf_dir):
    daily, index = _daily_source(spark, sf_dir), company_index(spark, sf_dir)
    return activity.resolve_company(daily, index, keep=True).select("event_id", F.col("company.issuer_cik").alias("company_cik"))


@query(
    "j11_companies_with_discoveries",
    """SELECT issuer_cik FROM companies c WHERE EXISTS (SELECT 1 FROM ranked_items s WHERE (CAST(s.issuer_cik AS BIGINT)%3=0 AND s.issuer_cik=c.issuer_cik)
     OR (CAST(s.issuer_cik AS BIGINT)%3=1 AND s.ticker=c.ticker) OR (CAST(s.issuer_cik AS BIGINT)%3=2 AND lower(s.company_name)=lower(c.company_name)))""",
    ("ranked_items", "companies"),
)
def j11(spark, sf_dir):
    return companies_with_discoveries(tables.companies(spark, sf_dir), _thirds(tables.ranked(spark, sf_dir))).select("issuer_cik")


def _thirds(found: DataFrame) -> DataFrame:
    """Discoveries that each name their company in one way only: number, ticker or name."""
    kind = F.col("issuer_cik").cast("bigint") % 3
    return found.select(
        F.when(kind == 0, F.col("issuer_cik")).otherwise("").alias("issuer_cik"), F.when(kind == 1, F.col("ticker")).otherwise("nan").alias("ticker"),
        F.when(kind == 2, F.upper("company_name")).alias("company_name"),
    )


def companies_with_discoveries(companies: DataFrame, found: DataFrame) -> DataFrame:
    """Companies named by a discovery through any of three keys: keys as rows, then a semi join."""
    from stakewatch.functions.text import usable_text

    def keys() -> list:
        named = [("cik", "issuer_cik"), ("ticker", "ticker"), ("name", "company_name")]
        texts = [F.lower(usable_text(F.col(column))) for _, column in named]
        return F.array_compact(F.array(*[F.when(t != "", F.concat(F.lit(f"{kind}:"), t)) for (kind, _), t in zip(named, texts)]))

    wanted = found.select(F.explode(keys()).alias("_key")).distinct()
    keyed = companies.withColumn("_key", F.explode(keys()))
    return keyed.join(wanted, "_key", "left_semi").drop("_key").distinct()


_TYPES = """list_filter([CASE WHEN buyer_count>=2 OR cluster_score>=60 THEN 'new_cluster' END, CASE WHEN silence_break_score>=60 OR days_since_previous_purchase>=365 THEN 'silence_break' END,
 CASE WHEN conviction_score>=75 AND behavior_change_score>=60 THEN 'conviction_increase' END, CASE WHEN purchase_value>=500000 THEN 'large_purchase' END], lambda x: x IS NOT NULL)"""
_IDENT = "concat_ws('|', issuer_cik, upper(ticker), lower(company_name))"
_BUYER = "nullif(CASE WHEN owner_cik<>'' THEN owner_cik ELSE lower(owner_name) END,'')"


@query("s19_change_types", f"SELECT ticker, filing_date, owner_cik, purchase_value, headline, array_to_string({_TYPES},'|') AS change_types FROM items", ("items",))
def s19(spark, sf_dir):
    return items(spark, sf_dir).select("ticker", "filing_date", "owner_cik", "purchase_value", "headline", joined(activity.change_types()).alias("change_types"))


def _period_sql(days: int) -> str:
    return f"""(SELECT i.*, filing_date>top.e-{days - 1} -1 AS is_current, top.e-{days - 1} AS period_start, top.e AS period_end FROM items i, (SELECT max(filing_date) AS e FROM items) top
     WHERE filing_date<=top.e AND filing_date>=top.e-{2 * days - 1})"""


@query(
    "w19_period_windows",
    f"SELECT ticker, filing_date, owner_cik, purchase_value, headline, is_current, period_start, period_end FROM {_period_sql(30)}",
    ("items",),
)
def w19(spark, sf_dir):
    return activity.in_period(items(spark, sf_dir), "30d").select(
        "ticker", "filing_date", "owner_cik", "purchase_value", "headline", "is_current", "period_start", "period_end"
    )


_SUMMARY = f"""SELECT is_current, count(*) AS purchases, count(DISTINCT {_IDENT}) AS companies, count(DISTINCT {_BUYER}) AS buyers, round(sum(purchase_value),2) AS purchase_value,
 sum(CASE WHEN list_contains({_TYPES},'new_cluster') THEN 1 ELSE 0 END)::BIGINT AS new_clusters, sum(CASE WHEN list_contains({_TYPES},'silence_break') THEN 1 ELSE 0 END)::BIGINT AS silence_breaks
 FROM {_period_sql(90)} GROUP BY 1"""


@query("a18_period_summary", _SUMMARY, ("items",))
def a18(spark, sf_dir):
    return activity.period_summary(activity.in_period(items(spark, sf_dir), "90d"))


@query(
    "w21_period_change",
    f"""SELECT metric, current, previous, {r('CASE WHEN previous=0 THEN CASE WHEN current=0 THEN 0e0 END ELSE (current-previous)/previous*100 END')} AS change_percent FROM (
     SELECT metric, coalesce(max(CASE WHEN is_current THEN v END),0e0) AS current, coalesce(max(CASE WHEN NOT is_current THEN v END),0e0) AS previous FROM (
      SELECT is_current, unnest(['purchases','companies','buyers','purchase_value','new_clusters','silence_breaks']) AS metric,
       unnest([purchases*1e0,companies*1e0,buyers*1e0,purchase_value,new_clusters*1e0,silence_breaks*1e0]) AS v FROM ({_SUMMARY})) GROUP BY 1)""",
    ("items",),
)
def w21(spark, sf_dir):
    return rounded(activity.period_change(activity.period_summary(activity.in_period(items(spark, sf_dir), "90d"))), 6, "change_percent")


_FEED_TEXT = f"""CASE WHEN list_contains(change_types,'new_cluster') AND buyer_count>=2 THEN CAST(buyer_count AS VARCHAR)||' executives are now buying '||ticker||'.'
 WHEN list_contains(change_types,'silence_break') THEN 'An executive returned to buy '||ticker||' after a long absence.'
 WHEN list_contains(change_types,'conviction_increase') THEN 'The evidence around '||ticker||' strengthened materially.'
 WHEN list_contains(change_types,'large_purchase') THEN ticker||' disclosed a large open-market purchase.' ELSE ticker||' reported qualifying insider buying.' END"""
add_view(
    "feed",
    f"""SELECT *, CAST(greatest(0, filing_date-transaction_date) AS INTEGER) AS filing_delay_days, {_FEED_TEXT} AS summary,
     CAST(buyer_count AS VARCHAR)||(CASE WHEN buyer_count=1 THEN ' buyer' ELSE ' buyers' END)||' committed '||{feed_money('purchase_value')}||'.' AS detail FROM (
     SELECT CAST(filing_date AS VARCHAR)||'|'||{_IDENT} AS id, filing_date, arg_min(transaction_date,(transaction_date,purchase_value,owner_cik,headline)) AS transaction_date, any_value(upper(ticker)) AS ticker,
      any_value(company_name) AS company_name, any_value(company_slug) AS company_slug, any_value(sector) AS sector, round(sum(purchase_value),2) AS purchase_value,
      greatest(count(DISTINCT {_BUYER}), max(buyer_count), 1) AS buyer_count, max(conviction_score) AS conviction, list_sort(list_distinct(flatten(list({_TYPES})))) AS change_types
     FROM {_period_sql(90)} WHERE is_current GROUP BY filing_date, {_IDENT})""",
)


def feed(spark, sf_dir) -> DataFrame:
    return activity.activity_feed(activity.in_period(items(spark, sf_dir), "90d").filter("is_current"))


_FEED = "id, filing_date, transaction_date, ticker, company_name, company_slug, sector, purchase_value, buyer_count, conviction, filing_delay_days, summary"


@query("a19_activity_feed", f"SELECT {_FEED}, array_to_string(change_types,'|') AS change_types FROM feed", ("feed",))
def a19(spark, sf_dir):
    return feed(spark, sf_dir).select(*_FEED.split(", "), joined(F.col("change_types")).alias("change_types"))


@query("s21_feed_sentences", "SELECT id, summary, detail FROM feed", ("feed",))
def s21(spark, sf_dir):
    return feed(spark, sf_dir).select("id", "summary", "detail")


@query(
    "p11_feed_filter",
    "SELECT id, purchase_value, buyer_count FROM feed WHERE sector='ASIA' AND list_contains(change_types,'new_cluster') AND purchase_value>=50000 AND buyer_count>=2",
    ("feed",),
)
def p11(spark, sf_dir):
    return activity.filter_feed(feed(spark, sf_dir), "ASIA", "new_cluster", 50000.0, 2).select("id", "purchase_value", "buyer_count")


@query(
    "e10_feed_by_day",
    f"SELECT id, filing_date, CAST(row_number() OVER (PARTITION BY filing_date ORDER BY floor(conviction*1e4+0.5) DESC, purchase_value DESC, id) AS INTEGER) AS place FROM feed",
    ("feed",),
)
def e10(spark, sf_dir):
    return activity.feed_by_day(feed(spark, sf_dir)).select("id", "filing_date", "place")


@query(
    "r19_change_groups",
    """SELECT change_type, position, id FROM (SELECT change_type, id, CAST(row_number() OVER (PARTITION BY change_type ORDER BY filing_date DESC, conviction DESC, purchase_value DESC, id) AS INTEGER) AS position
     FROM (SELECT *, unnest(change_types) AS change_type FROM feed) WHERE change_type<>'large_purchase') WHERE position<=5""",
    ("feed",),
)
def r19(spark, sf_dir):
    return rankings.change_groups(feed(spark, sf_dir)).select("change_type", "position", "id")


@query(
    "w20_j15_sector_acceleration",
    f"""SELECT sector, current_purchases, previous_purchases, companies, buyers, purchase_value, {r('CASE WHEN previous_purchases>0 THEN current_purchases*1e0/nullif(previous_purchases,0) ELSE current_purchases*1e0 END')} AS multiplier FROM (
     SELECT coalesce(c.sector,p.sector) AS sector, coalesce(c.n,0) AS current_purchases, coalesce(p.n,0) AS previous_purchases, c.companies, c.buyers, c.v AS purchase_value FROM
      (SELECT sector, count(*) AS n, count(DISTINCT {_IDENT}) AS companies, count(DISTINCT {_BUYER}) AS buyers, round(sum(purchase_value),2) AS v FROM {_period_sql(30)} WHERE is_current GROUP BY 1) c
      FULL JOIN (SELECT sector, count(*) AS n FROM {_period_sql(30)} WHERE NOT is_current GROUP BY 1) p ON c.sector=p.sector) WHERE current_purchases>0""",
    ("items",),
)
def w20(spark, sf_dir):
    return rounded(activity.sector_acceleration(activity.in_period(items(spark, sf_dir), "30d")), 6, "multiplier")


# --- merges and timelines ---------------------------------------------------------------------------------------

@query(
    "a20_daily_bars",
    f"""SELECT issuer_cik, transaction_date AS date, round(sum(purchase_value),2) AS value, {r('avg(conviction_score)', 5)} AS conviction, count(DISTINCT owner_cik) AS buyer_count,
     count(DISTINCT nullif(array_to_string(normalized_roles,'|'),'')) AS role_count, {r('greatest(max(coalesce(ownership_increase_percent,0e0)),0e0)')} AS ownership, count(*) AS event_count FROM sig GROUP BY 1,2""",
    ("sig",),
)
def a20(spark, sf_dir):
    bars = activity.daily_bars(tables.signals(spark, sf_dir), ["issuer_cik"])
    return rounded(rounded(bars, 6, "ownership"), 5, "conviction")


_MERGE_FORMULA = {
    "consensus": "{p}conviction_score*3+{p}buyer_count*22+{p}cluster_score+log10(greatest({p}purchase_value,1e0))*5",
    "landscape": "{p}conviction_score*2+{p}behavior_change_score+log10(greatest({p}purchase_value,1e0))*8",
    "ladder": clip("{p}conviction_score*0.45e0+{p}behavior_change_score*0.18e0+{p}cluster_score*0.22e0+least({p}buyer_count,6)*2.5e0+least(log10(greatest({p}purchase_value,1e0))*1.6e0,10e0)"),
}
_SO_FAR = "OVER (PARTITION BY issuer_cik ORDER BY section_no,rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


def _merge_sql(kind: str) -> str:
    own = r(_MERGE_FORMULA[kind].replace("{p}", ""))
    held = f"max(own) {_SO_FAR}" if kind == "ladder" else r(_MERGE_FORMULA[kind].replace("{p}", "m_"))
    fields = "conviction_score behavior_change_score cluster_score buyer_count purchase_value".split()
    running = ", ".join(f"max({c}) {_SO_FAR} AS m_{c}" for c in fields)
    score = r(_MERGE_FORMULA["ladder"].replace("{p}", ""))
    return f"""SELECT issuer_cik||'|'||ticker||'|'||lower(any_value(company_name)) AS id, ticker, arg_max(CASE WHEN stronger THEN headline END, CASE WHEN stronger THEN section_no*1000000+rank END) AS headline, any_value(sector) AS sector,
     greatest(0e0,max(market_cap)) AS market_cap, max(conviction_score) AS conviction, max(behavior_change_score) AS behavior, max(cluster_score) AS cluster, max(purchase_value) AS value, max(buyer_count) AS buyers,
     max({score}) AS rank_score FROM (SELECT *, coalesce(own>{held},true) AS stronger FROM (SELECT *, {own} AS own, {running} FROM ranked_items)) GROUP BY issuer_cik, ticker"""


def _merge_query(kind: str) -> None:
    def run(spark, sf_dir):
        return activity.merge_companies(tables.ranked(spark, sf_dir), kind).drop("company_name", "multiple")

    query(f"a21_company_merge_{kind}", _merge_sql(kind), ("ranked_items",))(run)


for _kind in _MERGE_FORMULA:
    _merge_query(_kind)


@query(
    "a22_selected_day_merge",
    """SELECT transaction_date AS date, upper(ticker) AS ticker, max(purchase_value) AS purchase_value, max(conviction_score) AS conviction, max(behavior_change_score) AS behavior, max(unique_buyers) AS buyer_count,
     coalesce(arg_min(CASE WHEN lot_count>1 THEN 'Bought '||event_id END, (-conviction_score,-purchase_value,event_id)) FILTER (lot_count>1), 'An executive disclosed a purchase.') AS headline FROM sig GROUP BY 1,2""",
    ("sig",),
)
def a22(spark, sf_dir):
    named = tables.signals(spark, sf_dir).withColumn("headline", F.when(F.col("lot_count") > 1, F.concat(F.lit("Bought "), "event_id")))
    return activity.merge_day(named)


@query(
    "a23_consensus_totals",
    f"""SELECT sum(buyers)::BIGINT AS total_buyers, count(*) FILTER (buyers>=2) AS companies_with_multiple_buyers, count(*) FILTER (buyers>=3) AS companies_with_three_or_more, round(sum(value),2) AS total_purchased
    FROM (SELECT issuer_cik, max(buyer_count) AS buyers, max(purchase_value) AS value FROM ranked_items GROUP BY 1)""",
    ("ranked_items",),
)
def a23(spark, sf_dir):
    return activity.consensus_totals(activity.merge_companies(tables.ranked(spark, sf_dir), "consensus"))


@query(
    "a24_freshness",
    """SELECT 'lots' AS artifact, count(*) AS rows, max(filing_date) AS newest FROM lots UNION ALL SELECT 'prices', count(*), max(date) FROM prices UNION ALL SELECT 'purchase_events', count(*), max(transaction_date) FROM pe""",
    ("lots", "prices", "pe"),
)
def a24(spark, sf_dir):
    return activity.newest_of(
        ("lots", tables.lots(spark, sf_dir), "filing_date"), ("prices", tables.prices(spark, sf_dir), "date"), ("purchase_events", tables.events(spark, sf_dir), "transaction_date")
    )


@query(
    "a24_stage_status",
    """SELECT 'lots' AS artifact, count(*) AS rows, true AS there FROM lots UNION ALL SELECT 'purchase_events', count(*), true FROM pe UNION ALL SELECT 'signals', count(*), true FROM sig UNION ALL SELECT 'ranked', count(*), true FROM ranked""",
    ("lots", "pe", "sig", "ranked"),
)
def a24_status(spark, sf_dir):
    stages = {"lots": tables.lots, "purchase_events": tables.events, "signals": tables.signals, "ranked": tables.ranked}
    status = activity.stage_status({name: table(spark, sf_dir) for name, table in stages.items()})
    return status.select("artifact", "rows", ((F.col("files") > 0) & (F.col("bytes") > 0) & F.col("written_at").isNotNull()).alias("there"))


@query("a25_latest_of_mixed_dates", "SELECT o_orderstatus, max(CASE WHEN o_orderkey%3<2 THEN CAST(o_orderdate AS DATE) END) AS newest FROM orders GROUP BY 1")
def a25(spark, sf_dir):
    day = F.col("o_orderdate").cast("date")
    shown = pick(F.col("o_orderkey"), F.date_format(day, "yyyyMMdd"), F.concat(day.cast("string"), F.lit("T23:00:00Z")), F.lit("unknown"))
    return tables.raw(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.max(parse_date(shown)).alias("newest"))


# --- rankings on pages ------------------------------------------------------------------------------------------

@query(
    "r9_history_append",
    f"""SELECT ranking_category, rank, {sid('stable_key', 'ranking_score', 'rank')} AS snapshot_key FROM ranked WHERE rank>50""",
    ("ranked",),
)
def r9(spark, sf_dir):
    latest = tables.ranked(spark, sf_dir).select("ranking_category", "rank", "stable_key", "ranking_score")
    history = rankings.snapshot_keys(latest.filter("rank <= 50"))
    return rankings.append_history(history, latest.unionByName(latest.filter("rank < 200")), ["ranking_category", "rank"]).select("ranking_category", "rank", "snapshot_key")


@query(
    "r11_ranking_cards",
    "SELECT ranking_category AS category, rank, ticker, headline, conviction_score, latest_transaction_date AS transaction_date, source_accession_numbers FROM ranked",
    ("ranked",),
)
def r11(spark, sf_dir):
    return rankings.ranking_cards(tables.ranked(spark, sf_dir)).select(
        "category", "rank", "ticker", "headline", "conviction_score", "transaction_date", joined(F.col("source_accession_numbers")).alias("source_accession_numbers")
    )


@query(
    "r12_normalized_order",
    "SELECT rank, ranking_category, ticker, issuer_cik, conviction_score FROM ranked_items ORDER BY rank, conviction_score DESC, ticker, issuer_cik",
    ("ranked_items",),
)
def r12(spark, sf_dir):
    return rankings.normalized_order(tables.ranked(spark, sf_dir)).select("rank", "ranking_category", "ticker", "issuer_cik", "conviction_score")


@query(
    "r12_added_rank_and_category",
    "SELECT CAST(row_number() OVER (ORDER BY conviction_score DESC, ticker, issuer_cik) AS INTEGER) AS rank, 'event_signals' AS category, 'event_signals' AS ranking_category, ticker, issuer_cik, conviction_score FROM sig",
    ("sig",),
)
def r12_added(spark, sf_dir):
    """The signals as a ranking: they have neither ranks nor a category of their own."""
    rows = tables.signals(spark, sf_dir).select("ticker", "issuer_cik", "conviction_score", "event_id")
    return rankings.normalized_rows(rows, "event_signals").drop("event_id")


@query(
    "r13_top_sections",
    "SELECT ranking_category, rank, ticker, event_id, CASE WHEN rank<=8 THEN 'featured' ELSE 'section' END AS place FROM ranked WHERE rank<=100",
    ("ranked",),
)
def r13(spark, sf_dir):
    return sections(spark, sf_dir).select("ranking_category", "rank", "ticker", "event_id", F.when(F.col("rank") <= 8, "featured").otherwise("section").alias("place"))


@query(
    "r13_largest_behavior_changes",
    "SELECT event_id, behavior_change_score FROM sig ORDER BY behavior_change_score DESC, event_id LIMIT 5",
    ("sig",),
)
def r13_behavior(spark, sf_dir):
    return tables.signals(spark, sf_dir).select("event_id", "behavior_change_score").orderBy(F.desc("behavior_change_score"), "event_id").limit(5)


add_view("usable_prices", "SELECT * FROM (SELECT ticker, date, adj_close AS close, volume, row_number() OVER (PARTITION BY ticker ORDER BY date DESC)-1 AS age FROM prices WHERE adj_close>0) WHERE age<756")
add_view(
    "story_facts",
    f"""SELECT c.ticker, c.rows AS price_rows, c.price_date, c.current_price, (current_price/high_52w-1)*100 AS drawdown_from_52_week_high, (current_price/high_3y-1)*100 AS drawdown_from_3_year_high,
     CASE WHEN rows>=40 THEN (current_price/mean_200-1)*100 END AS distance_from_200_day_average, (current_price/close_63-1)*100 AS return_63_sessions, vol*100 AS realized_volatility_63d,
     CASE WHEN vol IS NOT NULL THEN share*100 END AS volatility_percentile,
     CASE WHEN rows<40 OR close_63 IS NULL THEN 'insufficient_history' WHEN current_price>=mean_200 AND current_price/close_63-1>=0.05e0 THEN 'advancing' WHEN current_price>=mean_200 AND current_price/close_63-1>-0.05e0 THEN 'holding_above_trend'
      WHEN current_price<mean_200 AND current_price/close_63-1>=0 THEN 'recovering' WHEN current_price/close_63-1<=-0.15e0 THEN 'falling' ELSE 'below_trend' END AS trend
    FROM (SELECT ticker, count(*) AS rows, max(date) AS price_date, arg_max(close,date) AS current_price, max(close) FILTER (age<252) AS high_52w, max(close) AS high_3y, avg(close) FILTER (age<200) AS mean_200,
      max(close) FILTER (age=63) AS close_63, max(last_vol) AS vol, avg(CASE WHEN round(vol63,12)<=round(last_vol,12) THEN 1e0 ELSE 0e0 END) FILTER (vol63 IS NOT NULL) AS share FROM (
      SELECT *, max(CASE WHEN age=0 THEN vol63 END) OVER (PARTITION BY ticker) AS last_vol FROM (
       SELECT *, CASE WHEN count(ret) OVER w>=40 THEN stddev_samp(ret) OVER w*sqrt(252e0) END AS vol63 FROM (SELECT *, close/lag(close) OVER (PARTITION BY ticker ORDER BY date)-1 AS ret FROM usable_prices)
       WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 62 PRECEDING AND CURRENT ROW))) GROUP BY ticker) c""",
)
_EV = params.EVIDENCE_WEIGHTS
_OWN = "greatest(0e0,least(100e0,coalesce(ownership_increase_percent,0e0)))"
_ROLEQ = "greatest(0e0,least(100e0,qualifying_operating_executive_count*18e0+buyer_count*4e0))"
_DQ = "CASE lower(score_quality) WHEN 'high' THEN 100e0 WHEN 'acceptable' THEN 78e0 WHEN 'limited' THEN 52e0 ELSE 30e0 END"
_EVSUM = f"conviction_score*{_EV['conviction']}e0+behavior_change_score*{_EV['behavior_change']}e0+cluster_score*{_EV['cluster']}e0+abnormality_score*{_EV['abnormality']}e0+silence_break_score*{_EV['silence_break']}e0+{_OWN}*{_EV['ownership']}e0+{_ROLEQ}*{_EV['role_quality']}e0+({_DQ})*{_EV['data_quality']}e0"


def _w(x: str) -> str:
    return f"floor({x}+0.5)"


add_view(
    "evidence",
    f"""SELECT k.*, CAST(floor({r(_EVSUM)}+0.5) AS BIGINT) AS evidence_score, {_w('conviction_score')} AS p_conviction, {_w('behavior_change_score')} AS p_behavior, {_w('cluster_score')} AS p_cluster,
     {_w('abnormality_score')} AS p_abnormality, {_w('silence_break_score')} AS p_silence, {_w(_OWN)} AS p_ownership, {_w(_ROLEQ)} AS p_role, {_w(_DQ)} AS p_quality,
     f.drawdown_from_52_week_high, (f.current_price/a.average-1)*100 AS percent_vs_average_purchase_price
    FROM ranked_items k LEFT JOIN story_facts f USING (ticker) LEFT JOIN (SELECT ticker, sum(weighted_average_price*total_shares)/sum(total_shares) AS average FROM pe GROUP BY 1) a USING (ticker)""",
)


def story_summary(spark, sf_dir) -> DataFrame:
    sessions = price_ops.usable_sessions(tables.prices(spark, sf_dir))
    return stories.story_summary(sessions, tables.events(spark, sf_dir))


@query(
    "s21_feed_price_sentences",
    f"""SELECT f.id, f.detail || coalesce(' The latest price is ' || {fixed('abs(a.p)', 1)} || '% ' || CASE WHEN a.p>=0 THEN 'above' ELSE 'below' END || ' their average reported cost.', '') AS detail
    FROM feed f LEFT JOIN (SELECT upper(s.ticker) AS t, (s.current_price/e.average-1)*100 AS p FROM story_facts s
      JOIN (SELECT ticker, sum(weighted_average_price*total_shares)/sum(total_shares) AS average FROM pe GROUP BY 1) e USING (ticker)) a ON a.t=f.ticker""",
    ("feed", "story_facts", "pe"),
)
def s21_price(spark, sf_dir):
    costs = story_summary(spark, sf_dir).select(F.upper("ticker").alias("ticker"), F.col("percent_vs_average_purchase_price").alias("percent_vs_cost"))
    current = activity.in_period(items(spark, sf_dir), "90d").filter("is_current")
    return activity.activity_feed(current, costs).select("id", "detail")


def evidence_items(spark, sf_dir) -> DataFrame:
    prices = story_summary(spark, sf_dir).select("ticker", "drawdown_from_52_week_high", "percent_vs_average_purchase_price")
    return evidence.with_evidence(tables.ranked(spark, sf_dir).join(prices, "ticker", "left"))


_MODE_SQL = {
    "overall": "evidence_score*1e0",
    "together": "p_cluster*0.55e0+least(100e0,buyer_count*12)*0.45e0",
    "silence": "p_silence*0.65e0+p_behavior*0.35e0",
    "ownership": "p_ownership*0.7e0+p_conviction*0.3e0",
    "drawdown": "least(100e0,abs(coalesce(drawdown_from_52_week_high,0e0)))*0.45e0+p_conviction*0.55e0",
    "below_cost": "least(100e0,greatest(0e0,-coalesce(percent_vs_average_purchase_price,0e0))*4)*0.55e0+p_conviction*0.45e0",
    "small_cap": "p_conviction*0.45e0+p_behavior*0.35e0+greatest(0e0,100-log10(greatest(market_cap,1e0))*8)*0.2e0",
}


@query(
    "r14_evidence_modes",
    "SELECT ranking_category, rank, evidence_score, " + ", ".join(f"{r(x)} AS {m}" for m, x in _MODE_SQL.items()) + " FROM evidence",
    ("evidence",),
)
def r14(spark, sf_dir):
    return evidence_items(spark, sf_dir).select(
        "ranking_category", "rank", "evidence_score", *[round_to(evidence.mode_score(m), 6).alias(m) for m in evidence.MODES]
    )


@query(
    "r14_mode_ranking",
    f"""SELECT mode, place, ranking_category, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY mode ORDER BY score DESC, evidence_score DESC, ticker, ranking_category, rank) AS INTEGER) AS place FROM (
     {" UNION ALL ".join(f"SELECT '{m}' AS mode, {r(x)} AS score, evidence_score, ticker, ranking_category, rank FROM evidence" for m, x in _MODE_SQL.items())})) WHERE place<=24""",
    ("evidence",),
)
def r14_ranking(spark, sf_dir):
    scored = evidence_items(spark, sf_dir).select("ranking_category", "rank", "ticker", "evidence_score", F.explode(F.array(*[
        F.struct(F.lit(m).alias("mode"), round_to(evidence.mode_score(m), 6).alias("score")) for m in evidence.MODES])).alias("m"))
    flat = scored.select("ranking_category", "rank", "ticker", "evidence_score", "m.*")
    order = [F.desc("score"), F.desc("evidence_score"), F.asc("ticker"), F.asc("ranking_category"), F.asc("rank")]
    return top_per_key(flat, ["mode"], order, 24, "place").select("mode", "place", "ranking_category", "rank")


@query(
    "r15_ladder_score",
    f"SELECT event_id, {r(_MERGE_FORMULA['ladder'].replace('{p}', '').replace('buyer_count', 'unique_buyers'))} AS rank_score FROM sig",
    ("sig",),
)
def r15(spark, sf_dir):
    plain = tables.signals(spark, sf_dir).select(
        "event_id", F.col("conviction_score").alias("conviction"), F.col("behavior_change_score").alias("behavior"), F.col("cluster_score").alias("cluster"),
        F.col("unique_buyers").alias("buyers"), F.col("purchase_value").alias("value"),
    )
    return plain.select("event_id", round_to(activity.ladder_score(), 6).alias("rank_score"))


@query(
    "r16_first_across_sections",
    "SELECT issuer_cik, ranking_category, rank FROM (SELECT *, row_number() OVER (PARTITION BY issuer_cik ORDER BY section_no, rank) AS rn FROM ranked_items) WHERE rn=1",
    ("ranked_items",),
)
def r16(spark, sf_dir):
    return rankings.first_across_sections(tables.ranked(spark, sf_dir)).select("issuer_cik", "ranking_category", "rank")


add_view(
    "search_items",
    """SELECT 'company' AS type, issuer_cik AS id, ticker, company_name AS label, concat_ws(' · ', sector, industry) AS secondary, concat_ws(' ', ticker, company_name, sector, industry) AS keywords FROM companies
    UNION ALL SELECT 'insider', insider_id, '', n_name, 'Officer', concat_ws(' ', n_name, 'Officer', array_to_string(roles,' ')) FROM (SELECT insider_id, n_name, list_sort(list_distinct(flatten(list(normalized_roles)))) AS roles
     FROM lots JOIN nation ON lpad(CAST(n_nationkey AS VARCHAR),10,'0')=insider_id GROUP BY 1,2)""",
)


@query("e4_search_index", "SELECT * FROM search_items", ("search_items",))
def e4(spark, sf_dir):
    return evidence.search_index(company_index(spark, sf_dir), people(spark, sf_dir)).drop("slug").withColumn("keywords", F.array_join("keywords", " "))


_Q = "nation_1"


@query(
    "r17_search",
    f"""SELECT type, id, CAST(score AS INTEGER) AS score FROM (SELECT *, (CASE WHEN lower(ticker)='{_Q}' THEN 100 ELSE 0 END)+(CASE WHEN starts_with(lower(ticker),'{_Q}') THEN 60 ELSE 0 END)
      +(CASE WHEN starts_with(lower(label),'{_Q}') THEN 40 ELSE 0 END)+(CASE WHEN contains(lower(label),'{_Q}') THEN 24 ELSE 0 END)+(CASE WHEN contains(lower(secondary),'{_Q}') THEN 12 ELSE 0 END)
      +(CASE WHEN contains(lower(keywords),'{_Q}') THEN 8 ELSE 0 END) AS score FROM search_items) WHERE score>0 ORDER BY score DESC, label, id LIMIT 12""",
    ("search_items",),
)
def r17(spark, sf_dir):
    return evidence.search(evidence.search_index(company_index(spark, sf_dir), people(spark, sf_dir)), _Q).select("type", "id", "score")


@query(
    "r18_latest_filings",
    """SELECT event_id AS id, ticker, transaction_date AS date, purchase_value AS value FROM (SELECT *, row_number() OVER (PARTITION BY ticker, transaction_date, insider_id ORDER BY conviction_score, event_id) AS rn FROM sig)
    WHERE rn=1 ORDER BY transaction_date DESC, conviction_score, event_id DESC LIMIT 6""",
    ("sig",),
)
def r18(spark, sf_dir):
    return rankings.latest_stories(tables.signals(spark, sf_dir).withColumn("headline", F.lit("")), tables.ranked(spark, sf_dir))


@query(
    "r18_latest_filings_filled_up",
    f"""SELECT id, ticker, date, value FROM (
     SELECT event_id AS id, ticker, transaction_date AS date, purchase_value AS value, 0 AS src, row_number() OVER (ORDER BY transaction_date DESC, conviction_score, event_id DESC) AS n
      FROM (SELECT *, row_number() OVER (PARTITION BY ticker, transaction_date, insider_id ORDER BY conviction_score, event_id) AS rn FROM sig) WHERE rn=1 AND ticker='S17'
     UNION ALL SELECT ticker||'-'||CAST(latest_filing_date AS VARCHAR)||'-'||headline, ticker, latest_filing_date, purchase_value, 1, row_number() OVER (ORDER BY {_SECTION}, rank)
      FROM (SELECT *, row_number() OVER (PARTITION BY ticker, latest_filing_date, headline ORDER BY {_SECTION}, rank) AS rn FROM ranked) WHERE rn=1)
    ORDER BY src, n LIMIT 2000""",
    ("sig", "ranked"),
)
def r18_filled(spark, sf_dir):
    """One company's purchases are too few for two thousand places; the rest comes from the rankings, past their first hundreds."""
    mine = tables.signals(spark, sf_dir).filter("ticker = 'S17'").withColumn("headline", F.lit(""))
    return rankings.latest_stories(mine, tables.ranked(spark, sf_dir), 2000)


# --- percentiles and variation ----------------------------------------------------------------------------------

@query(
    "w17_mid_rank_percentile",
    f"""SELECT event_id, {r('(rank() OVER (ORDER BY behavior_change_score)-1+(count(*) OVER (PARTITION BY behavior_change_score)-1)/2e0)/(count(*) OVER ()-1)', 9)} AS x_rank,
     {r('(rank() OVER (ORDER BY conviction_score DESC)-1+(count(*) OVER (PARTITION BY conviction_score)-1)/2e0)/(count(*) OVER ()-1)', 9)} AS y_rank FROM sig""",
    ("sig",),
)
def w17(spark, sf_dir):
    base = tables.signals(spark, sf_dir).select("event_id", "behavior_change_score", "conviction_score")
    both = evidence.mid_ranks(base, {"x_rank": ("behavior_change_score", False), "y_rank": ("conviction_score", True)})
    return rounded(both.select("event_id", "x_rank", "y_rank"), 9, "x_rank", "y_rank")


@query(
    "w18_cumulative_percentile",
    """SELECT event_id, CAST(floor(cume_dist() OVER (ORDER BY purchase_value)*100+0.5) AS INTEGER) AS value_percentile, CAST(floor(cume_dist() OVER (ORDER BY unique_buyers)*100+0.5) AS INTEGER) AS buyers_percentile FROM sig""",
    ("sig",),
)
def w18(spark, sf_dir):
    base = tables.signals(spark, sf_dir).select("event_id", "purchase_value", "unique_buyers")
    shares = evidence.shares_at_or_below(base, {"value_percentile": "purchase_value", "buyers_percentile": "unique_buyers"})
    return shares.select("event_id", "value_percentile", "buyers_percentile")


@query(
    "s27_axis_variation",
    """SELECT count(*) FILTER (market_cap>0)>=greatest(5,count(*)*0.35e0) AND count(DISTINCT CASE WHEN market_cap>0 THEN printf('%.5e', market_cap) END)>=greatest(4,ceil(count(*)*0.2e0)) AS market_cap_varies,
     count(*) FILTER (discount>0)>=greatest(5,count(*)*0.35e0) AND count(DISTINCT CASE WHEN discount>0 THEN printf('%.5e', discount) END)>=greatest(4,ceil(count(*)*0.2e0)) AS constant_varies
    FROM (SELECT market_cap, 7e0 AS discount FROM companies)""",
    ("companies",),
)
def s27(spark, sf_dir):
    points = tables.companies(spark, sf_dir).withColumn("constant", F.lit(7.0))
    return points.agg(
        evidence.enough_variation(points, "market_cap").alias("market_cap_varies"), evidence.enough_variation(points, "constant").alias("constant_varies")
    )


@query(
    "p14_score_components",
    """SELECT ranking_category, rank, component, value FROM (UNPIVOT (SELECT ranking_category, rank, p_conviction, p_behavior, p_cluster, p_abnormality, p_silence, p_ownership, p_role, p_quality FROM evidence WHERE ticker IN ('S1','S2','S3'))
     ON p_conviction, p_behavior, p_cluster, p_abnormality, p_silence, p_ownership, p_role, p_quality INTO NAME component VALUE value) WHERE value>0""",
    ("evidence",),
)
def p14(spark, sf_dir):
    chosen = evidence_items(spark, sf_dir).filter(F.col("ticker").isin("S1", "S2", "S3"))
    short = {"conviction": "p_conviction", "behavior_change": "p_behavior", "cluster": "p_cluster", "abnormality": "p_abnormality", "silence_break": "p_silence",
             "ownership": "p_ownership", "role_quality": "p_role", "data_quality": "p_quality"}
    wide = chosen.select("ranking_category", "rank", *[F.col(f"parts.{a}").cast("double").alias(b) for a, b in short.items()])
    return wide.unpivot(["ranking_category", "rank"], list(short.values()), "component", "value").filter("value > 0")


# --- predicates on pages ----------------------------------------------------------------------------------------

@query(
    "p8_display_ticker",
    f"SELECT p_partkey, {pick_sql('p_partkey', 'upper(p_brand[1:5])||p_partkey', 'upper(p_brand[1:5])||p_partkey', chr(39) * 2, chr(39) * 2, chr(39) * 2)} AS ticker FROM part",
)
def p8(spark, sf_dir):
    from stakewatch.functions.text import display_ticker

    name = F.concat(F.substring("p_brand", 1, 5), F.col("p_partkey").cast("string"))
    shown = pick(F.col("p_partkey"), F.lower(name), F.concat(F.lit(" "), name), F.lit("N/A"), F.concat(name, F.lit("/A")), F.lit("undefined"))
    return tables.raw(spark, sf_dir, "part").select("p_partkey", display_ticker(shown).alias("ticker"))


@query(
    "p9_company_has_evidence",
    "SELECT issuer_cik, issuer_cik IN (SELECT issuer_cik FROM pe) AS has_evidence FROM (SELECT issuer_cik FROM companies UNION ALL SELECT 'X'||issuer_cik FROM companies)",
    ("companies", "pe"),
)
def p9(spark, sf_dir):
    return _dossiers(spark, sf_dir, with_strangers(tables.companies(spark, sf_dir))).select("issuer_cik", dossiers.has_evidence({"purchase_events", "purchase_campaigns", "event_signals"}).alias("has_evidence"))


@query(
    "p10_discovery_filter",
    "SELECT ranking_category, rank, ticker FROM ranked_items WHERE sector='EUROPE' AND contains(lower(concat_ws(' ',ticker,company_name,sector,industry,headline)),'founder')",
    ("ranked_items",),
)
def p10(spark, sf_dir):
    return evidence.filter_discoveries(tables.ranked(spark, sf_dir), "EUROPE", " Founder ").select("ranking_category", "rank", "ticker")


@query(
    "p12_index_filter",
    "SELECT issuer_cik AS id, company_name AS name FROM companies WHERE contains(lower(concat_ws(' ',ticker,company_name,sector)),'#00000001') UNION ALL SELECT lpad(CAST(n_nationkey AS VARCHAR),10,'0'), n_name FROM nation WHERE contains(lower(n_name),'_1')",
    ("companies",),
)
def p12(spark, sf_dir):
    from stakewatch.functions.text import contains_folded

    firms = tables.companies(spark, sf_dir).filter(contains_folded("#00000001", F.col("ticker"), F.col("company_name"), F.col("sector")))
    persons = people(spark, sf_dir).filter(contains_folded("_1", F.col("display_name")))
    return firms.select(F.col("issuer_cik").alias("id"), F.col("company_name").alias("name")).unionByName(
        persons.select(F.col("insider_id").alias("id"), F.col("display_name").alias("name"))
    )


@query(
    "p13_usable_sessions",
    f"SELECT ticker, date, {r('close')} AS story_close FROM usable_prices",
    ("usable_prices",),
)
def p13(spark, sf_dir):
    loads = tables.prices(spark, sf_dir).withColumn("load_no", F.lit(2))
    messy = loads.withColumn("adj_close", F.lit(None).cast("double")).unionByName(
        loads.withColumn("load_no", F.lit(1)).withColumn("close", F.lit(-1.0))
    )
    return price_ops.usable_sessions(messy).select("ticker", "date", round_to(F.col("story_close"), 6).alias("story_close"))


# --- stories ----------------------------------------------------------------------------------------------------

_STORY = ["drawdown_from_52_week_high", "drawdown_from_3_year_high", "distance_from_200_day_average", "return_63_sessions", "realized_volatility_63d", "volatility_percentile"]


@query("w14_story_price_context", f"SELECT ticker, price_rows, price_date, {rs('current_price', *_STORY)}, trend FROM story_facts", ("story_facts",))
def w14(spark, sf_dir):
    df = price_ops.story_context(price_ops.usable_sessions(tables.prices(spark, sf_dir)))
    return rounded(df.select("ticker", "price_rows", "price_date", "current_price", *_STORY, "trend"), 6, "current_price", *_STORY)


add_view(
    "story_path",
    """SELECT ticker, date, close FROM (SELECT u.*, row_number() OVER (PARTITION BY u.ticker ORDER BY u.date)-1 AS n, count(*) OVER (PARTITION BY u.ticker) AS rows,
      EXISTS (SELECT 1 FROM pe e WHERE e.ticker=u.ticker AND e.transaction_date=u.date) OR EXISTS (SELECT 1 FROM pe e WHERE e.ticker=u.ticker AND e.transaction_date<u.date AND (e.transaction_date>u.prev OR u.prev IS NULL))
      OR EXISTS (SELECT 1 FROM pe e WHERE e.ticker=u.ticker AND e.transaction_date>u.date AND (e.transaction_date<u.next OR u.next IS NULL)) AS near
     FROM (SELECT *, lag(date) OVER (PARTITION BY ticker ORDER BY date) AS prev, lead(date) OVER (PARTITION BY ticker ORDER BY date) AS next FROM usable_prices) u) WHERE rows<=260 OR n%greatest(1,CAST(ceil(rows/260e0) AS BIGINT))=0 OR n=rows-1 OR near""",
)


@query("w15_downsampled_path", "SELECT ticker, date FROM story_path", ("story_path",))
def w15(spark, sf_dir):
    sessions = price_ops.usable_sessions(tables.prices(spark, sf_dir))
    days = tables.events(spark, sf_dir).select("ticker", F.col("transaction_date").alias("day"))
    return price_ops.downsample(sessions, days, 260).select("ticker", "date")


@query(
    "w16_last_markers",
    """SELECT event_id, ticker, CAST(age AS INTEGER) AS marker_age FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY transaction_date DESC, event_id DESC) AS age FROM pe) WHERE age<=250""",
    ("pe",),
)
def w16(spark, sf_dir):
    sessions = price_ops.usable_sessions(tables.prices(spark, sf_dir))
    return stories.purchase_markers(sessions, tables.events(spark, sf_dir), 250).select("event_id", "ticker", "marker_age")


@query(
    "a14_story_summary",
    f"""SELECT f.ticker, {r('f.current_price')} AS current_price, b.buyers, b.days AS purchase_days, b.n AS purchase_events, b.total AS total_reported_purchase_value, b.first_day AS first_purchase_date, b.last_day AS latest_purchase_date,
     {r('b.average', 4)} AS average_reported_purchase_price, {r('(f.current_price/b.average-1)*100')} AS percent_vs_average_purchase_price, {r('(f.current_price/coalesce(p1.close,f.current_price)-1)*100')} AS return_since_first_purchase,
     {r('(f.current_price/coalesce(p2.close,f.current_price)-1)*100')} AS return_since_latest_purchase, f.trend
    FROM story_facts f JOIN (SELECT ticker, count(DISTINCT owner_cik) AS buyers, count(DISTINCT transaction_date) AS days, count(*) AS n, round(sum(purchase_value),2) AS total, min(transaction_date) AS first_day, max(transaction_date) AS last_day,
      sum(weighted_average_price*total_shares)/sum(total_shares) AS average FROM pe GROUP BY 1) b USING (ticker)
    ASOF LEFT JOIN usable_prices p1 ON p1.ticker=b.ticker AND p1.date>=b.first_day ASOF LEFT JOIN usable_prices p2 ON p2.ticker=b.ticker AND p2.date>=b.last_day""",
    ("story_facts", "usable_prices", "pe"),
)
def a14(spark, sf_dir):
    names = ["current_price", "percent_vs_average_purchase_price", "return_since_first_purchase", "return_since_latest_purchase"]
    df = story_summary(spark, sf_dir).select(
        "ticker", *names, "buyers", "purchase_days", "purchase_events", "total_reported_purchase_value", "first_purchase_date", "latest_purchase_date",
        "average_reported_purchase_price", "trend",
    )
    return rounded(rounded(df, 6, *names), 4, "average_reported_purchase_price")


@query(
    "e3_company_stories",
    f"""SELECT issuer_cik, part, CAST(place AS INTEGER) AS place, id, date, {r('value')} AS value FROM (
     SELECT ticker, 'price_path' AS part, row_number() OVER (PARTITION BY ticker ORDER BY date) AS place, '' AS id, date, close AS value FROM story_path
     UNION ALL SELECT ticker, 'purchase_markers', row_number() OVER (PARTITION BY ticker ORDER BY transaction_date, event_id), event_id, transaction_date, purchase_value
       FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY transaction_date DESC, event_id DESC) AS age FROM pe WHERE ticker IN (SELECT ticker FROM usable_prices)) WHERE age<=250
     UNION ALL SELECT ticker, 'summary', 1, trend, price_date, current_price FROM story_facts
     UNION ALL SELECT c.ticker, 'unavailable', 1, 'missing_or_unusable_price_history', NULL, NULL FROM context c WHERE ticker NOT IN (SELECT ticker FROM story_facts)
    ) JOIN (SELECT issuer_cik, ticker FROM context) USING (ticker)""",
    ("story_path", "story_facts", "usable_prices", "pe", "context"),
)
def e3(spark, sf_dir):
    """Stories as rows: every point, every marker, the summary, and why there is none."""
    sessions = price_ops.usable_sessions(tables.prices(spark, sf_dir))
    events = stories.with_signal_scores(tables.events(spark, sf_dir), tables.signals(spark, sf_dir))
    pages = stories.company_stories(company_index(spark, sf_dir), sessions, events)
    pages = pages.withColumns({
        "summary": F.when(F.col("price_available"), F.array(F.struct(F.col("summary.trend").alias("trend"), F.col("summary.price_date").alias("date"), F.col("summary.current_price").alias("price")))),
        "unavailable": F.when(~F.col("price_available"), F.array("price_unavailable_reason")),
    })
    entry = lambda name: F.col(f"entry.{name}")
    rows = dossiers.list_rows(pages, "issuer_cik", {
        "price_path": (F.lit(""), entry("date"), entry("adjusted_close")),
        "purchase_markers": (entry("event_id"), entry("transaction_date"), entry("purchase_value")),
        "summary": (entry("trend"), entry("date"), entry("price")),
        "unavailable": (F.col("entry"), F.lit(None).cast("date"), F.lit(None)),
    })
    return rounded(rows, 6, "value")


# --- dossiers ---------------------------------------------------------------------------------------------------

def _dossiers(spark, sf_dir, companies: DataFrame | None = None) -> DataFrame:
    signals, events, lots = tables.signals(spark, sf_dir), tables.events(spark, sf_dir), tables.lots(spark, sf_dir)
    companies = tables.companies(spark, sf_dir) if companies is None else companies
    return dossiers.company_dossiers(companies, events, purchase_campaigns(events), signals, lots, best_per_issuer(signals))


def _newest_sql(part: str, source: str, key: str, day: str, ties: str, entry_id: str, value: str, most: int) -> str:
    return f"""SELECT {key} AS page, '{part}' AS part, row_number() OVER (PARTITION BY {key} ORDER BY {day} DESC, {ties}) AS place, {entry_id} AS id, {day} AS date, {value} AS value FROM {source}
     QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY {day} DESC, {ties})<={most}"""


_CAMPAIGNS = f"""(SELECT *, {sid('first_event_id', 'last_event_id', 'event_count')} AS campaign_id FROM (SELECT issuer_cik, min(transaction_date) AS start_date, round(sum(purchase_value),2) AS purchase_value,
 count(*) AS event_count, arg_min(event_id,(transaction_date,event_id)) AS first_event_id, arg_max(event_id,(transaction_date,event_id)) AS last_event_id FROM (WITH {_RUN} SELECT * FROM runs) GROUP BY issuer_cik,insider_id,ticker,run))"""


@query(
    "e1_company_dossiers",
    f"""SELECT page AS issuer_cik, part, CAST(place AS INTEGER) AS place, CAST(id AS VARCHAR) AS id, date, {r('value')} AS value FROM (
     {_newest_sql('purchase_events', 'pe', 'issuer_cik', 'transaction_date', 'event_id', 'event_id', 'purchase_value', 250)}
     UNION ALL {_newest_sql('purchase_campaigns', _CAMPAIGNS, 'issuer_cik', 'start_date', 'campaign_id', 'campaign_id', 'purchase_value', 100)}
     UNION ALL {_newest_sql('executive_histories', 'sig', 'issuer_cik', 'transaction_date', 'event_id', 'event_id', 'prior_purchase_count', 250)}
     UNION ALL {_newest_sql('event_signals', 'sig', 'issuer_cik', 'transaction_date', 'event_id', 'event_id', 'conviction_score', 250)}
     UNION ALL {_newest_sql('qualifying_transactions', '(SELECT * FROM lots WHERE is_qualifying_purchase)', 'issuer_cik', 'transaction_date', 'accession_number, line_no, shares, price_per_share', "accession_number||'-'||line_no", 'shares', 500)}
     UNION ALL {_newest_sql('latest', 'sig', 'issuer_cik', 'transaction_date', 'event_id', 'event_id', 'conviction_score', 1)}
     UNION ALL SELECT issuer_cik, 'current', 1, arg_max(event_id,(conviction_score,event_id)), arg_max(transaction_date,(conviction_score,event_id)), max(conviction_score) FROM sig GROUP BY 1
     UNION ALL SELECT issuer_cik, 'totals', 1, count(DISTINCT insider_id), NULL, round(sum(purchase_value),2) FROM pe GROUP BY 1)""",
    ("pe", "sig", "lots"),
)
def e1(spark, sf_dir):
    """Dossiers as rows: every entry of the lists, the latest and the current signal, buyers and value in all."""
    one = lambda c: F.when(c.isNotNull(), F.array(c))
    totals = F.struct(F.col("buyers").alias("buyers"), F.col("stats.total_purchase_value").alias("value"))
    pages = _dossiers(spark, sf_dir).withColumns({
        "latest": one(F.col("latest_event_signal")), "current": one(F.col("current_signal")), "totals": F.when(F.col("stats").isNotNull(), F.array(totals)),
    })
    entry = lambda name: F.col(f"entry.{name}")
    signal = (entry("event_id"), entry("transaction_date"), entry("conviction_score"))
    rows = dossiers.list_rows(pages, "issuer_cik", {
        "purchase_events": (entry("event_id"), entry("transaction_date"), entry("purchase_value")),
        "purchase_campaigns": (entry("campaign_id"), entry("start_date"), entry("purchase_value")),
        "executive_histories": (entry("event_id"), entry("transaction_date"), entry("prior_purchase_count")),
        "event_signals": signal,
        "qualifying_transactions": (F.concat_ws("-", entry("accession_number"), entry("line_no")), entry("transaction_date"), entry("shares")),
        "latest": signal, "current": signal, "totals": (entry("buyers"), F.lit(None).cast("date"), entry("value")),
    })
    return rounded(rows, 6, "value")


@query(
    "e1_dossier_counts",
    """SELECT c.issuer_cik, least(250,e.n) AS purchase_events, least(500,l.n) AS qualifying_transactions, e.buyers AS buyers, e.newest AS latest_event FROM companies c
     LEFT JOIN (SELECT issuer_cik, count(*) AS n, count(DISTINCT insider_id) AS buyers, arg_max(event_id,(transaction_date,event_id)) AS newest0,
       arg_min(event_id,(-epoch_days,event_id)) AS newest FROM (SELECT *, transaction_date-DATE '1970-01-01' AS epoch_days FROM pe) GROUP BY 1) e USING (issuer_cik)
     LEFT JOIN (SELECT issuer_cik, count(*) AS n FROM lots WHERE is_qualifying_purchase GROUP BY 1) l USING (issuer_cik)""",
    ("companies", "pe", "lots"),
)
def e1_counts(spark, sf_dir):
    return _dossiers(spark, sf_dir).select(
        "issuer_cik", *[F.size(c).cast("bigint").alias(c) for c in ("purchase_events", "qualifying_transactions")], "buyers", F.col("latest_event_signal.event_id").alias("latest_event"),
    )


@query(
    "e1_first_purchase_per_buyer",
    """SELECT issuer_cik, insider_id, owner_cik, array_to_string(normalized_roles,'|') AS roles, purchase_value, event_id, transaction_date FROM pe
     QUALIFY row_number() OVER (PARTITION BY issuer_cik, insider_id ORDER BY transaction_date DESC, event_id)=1""",
    ("pe",),
)
def e1_buyers(spark, sf_dir):
    rows = dossiers.first_purchase_per_buyer(tables.events(spark, sf_dir))
    return rows.select("issuer_cik", "insider_id", "owner_cik", joined(F.col("normalized_roles")).alias("roles"), "purchase_value", "event_id", "transaction_date")


def _cross_people(spark, sf_dir) -> DataFrame:
    """People whose owner number is that of their neighbour, so both ways of matching find rows."""
    return people(spark, sf_dir).withColumn("owner_cik", F.lpad(((F.col("insider_id").cast("bigint") + 1) % 25).cast("string"), 10, "0"))


@query(
    "j13_person_rows",
    "SELECT p.id AS person_id, e.event_id FROM (SELECT DISTINCT insider_id AS id, lpad(CAST((CAST(insider_id AS BIGINT)+1)%25 AS VARCHAR),10,'0') AS cik FROM lots) p JOIN pe e ON e.insider_id=p.id OR e.owner_cik=p.cik",
    ("lots", "pe"),
)
def j13(spark, sf_dir):
    return dossiers.person_rows(_cross_people(spark, sf_dir), tables.events(spark, sf_dir)).select("person_id", "event_id")


@query(
    "j14_person_companies",
    "SELECT DISTINCT insider_id AS person_id, issuer_cik FROM pe",
    ("pe",),
)
def j14(spark, sf_dir):
    return dossiers.person_companies(people(spark, sf_dir), tables.events(spark, sf_dir), tables.companies(spark, sf_dir)).select("person_id", "issuer_cik")


@query(
    "j14_people_of_a_company",
    "SELECT DISTINCT insider_id FROM pe WHERE ticker='S17'",
    ("pe",),
)
def j14_people(spark, sf_dir):
    there = tables.events(spark, sf_dir).filter("ticker = 'S17'").select("insider_id")
    return people(spark, sf_dir).join(there, "insider_id", "left_semi").select("insider_id")


@query(
    "e2_person_dossiers",
    f"""SELECT page AS insider_id, part, CAST(place AS INTEGER) AS place, CAST(id AS VARCHAR) AS id, date, {r('value')} AS value FROM (
     {_newest_sql('purchase_events', 'sig', 'insider_id', 'transaction_date', 'event_id', 'event_id', 'purchase_value', 500)}
     UNION ALL {_newest_sql('histories', 'sig', 'insider_id', 'transaction_date', 'event_id', 'event_id', 'prior_purchase_count', 500)}
     UNION ALL {_newest_sql('signals', 'sig', 'insider_id', 'transaction_date', 'event_id', 'event_id', 'conviction_score', 500)}
     UNION ALL SELECT insider_id, 'profile', 1, count(*), NULL, max(conviction_score) FROM sig GROUP BY 1
     UNION ALL SELECT insider_id, 'related', 1, '', NULL, count(DISTINCT issuer_cik) FROM sig GROUP BY 1)""",
    ("sig",),
)
def e2(spark, sf_dir):
    """Dossiers as rows: every entry of the lists, purchases and highest conviction, number of companies."""
    pages = dossiers.person_dossiers(people(spark, sf_dir), tables.events(spark, sf_dir), tables.signals(spark, sf_dir), tables.companies(spark, sf_dir))
    pages = pages.withColumns({"profile": F.when(F.col("behavior_profile").isNotNull(), F.array("behavior_profile")), "related": F.when(F.col("companies").isNotNull(), F.array("companies"))})
    entry = lambda name: F.col(f"entry.{name}")
    none = F.lit(None).cast("date")
    rows = dossiers.list_rows(pages, "insider_id", {
        "purchase_events": (entry("event_id"), entry("transaction_date"), entry("purchase_value")),
        "histories": (entry("event_id"), entry("transaction_date"), entry("prior_purchase_count")),
        "signals": (entry("event_id"), entry("transaction_date"), entry("conviction_score")),
        "profile": (entry("purchase_count"), none, entry("highest_conviction")), "related": (F.lit(""), none, F.col("entry")),
    })
    return rounded(rows, 6, "value")


@query(
    "e5_company_index",
    """SELECT lower(ticker) AS slug, issuer_cik, company_name, sector, discovery_eligible, e.best AS best_conviction, f.trend IS NOT NULL AS price_available, f.trend FROM context
     LEFT JOIN (SELECT issuer_cik, max(conviction_score) AS best FROM sig GROUP BY 1) e USING (issuer_cik) LEFT JOIN story_facts f USING (ticker)""",
    ("context", "sig", "story_facts"),
)
def e5(spark, sf_dir):
    best = tables.signals(spark, sf_dir).groupBy("issuer_cik").agg(F.max("conviction_score").alias("best_conviction"))
    story = story_summary(spark, sf_dir).select("ticker", "trend")
    return company_index(spark, sf_dir).join(best, "issuer_cik", "left").join(story, "ticker", "left").select(
        "slug", "issuer_cik", "company_name", "sector", "discovery_eligible", "best_conviction", F.col("trend").isNotNull().alias("price_available"), "trend"
    )


@query(
    "e5_person_index",
    """SELECT insider_id AS slug, insider_id, n_name AS name, count(*) AS purchase_count, max(conviction_score) AS highest_conviction FROM sig JOIN nation ON lpad(CAST(n_nationkey AS VARCHAR),10,'0')=insider_id GROUP BY 2,3""",
    ("sig",),
)
def e5_people(spark, sf_dir):
    signals = tables.signals(spark, sf_dir)
    profile = activity.person_profile(signals, signals, signals).select("insider_id", "purchase_count", "highest_conviction")
    return people(spark, sf_dir).join(profile, "insider_id").select(
        slug(F.col("insider_id")).alias("slug"), "insider_id", F.col("display_name").alias("name"), "purchase_count", "highest_conviction"
    )


def _section_query(name: str, size: int) -> None:
    def run(spark, sf_dir):
        """Section lists as rows."""
        lists = rankings.section_lists(tables.ranked(spark, sf_dir), size)
        rows = lists.select("ranking_category", "count", F.posexplode("items").alias("_at", "item"))
        return rows.select("ranking_category", "count", (F.col("_at") + 1).alias("place"), *[F.col(f"item.{c}").alias(c) for c in ("ticker", "headline", "conviction_score", "transaction_date", "buyer_count")],
                           F.array_join("item.source_accession_numbers", ",").alias("accessions"))

    query(
        name,
        f"""SELECT ranking_category, count, rank AS place, nullif(ticker,'') AS ticker, headline, conviction_score, latest_transaction_date AS transaction_date, buyer_count, source_accession_numbers AS accessions
        FROM ranked JOIN (SELECT ranking_category, count(*) AS count FROM ranked GROUP BY 1) USING (ranking_category) WHERE rank<={size}""",
        ("ranked",),
    )(run)


_section_query("e6_discovery_sections", 100)
_section_query("e6_featured_sections", 8)


@query(
    "e7_calendar_rows",
    """SELECT d.date, d.event_count, e.event_id, e.place FROM (SELECT transaction_date AS date, count(*) AS event_count FROM sig GROUP BY 1) d LEFT JOIN
     (SELECT transaction_date AS date, event_id, CAST(row_number() OVER (PARTITION BY transaction_date ORDER BY conviction_score DESC, purchase_value DESC, event_id) AS INTEGER) AS place FROM sig) e USING (date)""",
    ("sig",),
)
def e7(spark, sf_dir):
    days = activity.daily_activity(tables.events(spark, sf_dir), tables.signals(spark, sf_dir))
    return activity.calendar_rows(days, tables.signals(spark, sf_dir)).select("date", "event_count", "event_id", "place")


@query(
    "e8_evidence_timeline",
    f"SELECT event_id, transaction_date, {r('purchase_value/max(purchase_value) OVER ()')} AS share_of_maximum FROM sig WHERE ticker='S17' ORDER BY transaction_date DESC, event_id",
    ("sig",),
)
def e8(spark, sf_dir):
    mine = tables.signals(spark, sf_dir).filter("ticker = 'S17'").select("event_id", "transaction_date", "purchase_value")
    largest = mine.agg(F.greatest(F.max("purchase_value"), F.lit(1.0))).scalar()
    return mine.withColumn("share_of_maximum", round_to(F.col("purchase_value") / largest, 6)).drop("purchase_value").orderBy(F.desc("transaction_date"), "event_id")


@query(
    "e9_page_envelope",
    f"""SELECT 'v1' AS schema_version, '2026-01-01T00:00:00Z' AS generated_at_utc, (SELECT max(transaction_date) FROM sig) AS as_of_date, 'Purchases are research evidence, not a recommendation.' AS limitations,
     (SELECT 'prices='||max(date) FROM prices)||','||(SELECT 'purchase_events='||max(transaction_date) FROM pe) AS freshness,
     {_SECTOR_FIGURES}, {r("count(DISTINCT issuer_cik)*1e0/greatest(1,(SELECT count(*) FROM context WHERE discovery_eligible))")} AS eligible_universe_share
    FROM (SELECT s.* EXCLUDE (sector), c.sector FROM sig s LEFT JOIN context c USING (issuer_cik)) GROUP BY sector""",
    ("sig", "context", "prices", "pe"),
)
def e9(spark, sf_dir):
    newest = tables.signals(spark, sf_dir).agg(F.max("transaction_date")).scalar()
    fresh = dossiers.freshness_map(activity.newest_of(("prices", tables.prices(spark, sf_dir), "date"), ("purchase_events", tables.events(spark, sf_dir), "transaction_date")))
    payload = activity.sector_payload(tables.signals(spark, sf_dir), tables.company_context(spark, sf_dir))
    page = dossiers.envelope(payload, "2026-01-01T00:00:00Z", newest, fresh, ["Purchases are research evidence, not a recommendation."])
    shown = F.array_join(F.transform(F.array_sort(F.map_entries("freshness")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return page.withColumns({"freshness": shown, "limitations": F.array_join("limitations", ",")})


# --- charts and sentences ---------------------------------------------------------------------------------------

_U = "CAST(('0x'||substr(sha256('{}:'||c.issuer_cik),1,16))::UBIGINT AS DOUBLE)/18446744073709551615e0"
_DIR = f"(orbit*(2*pi())/sectors+({_U.format('angle')})*(2*pi())*0.18e0)"
_REACH = f"((({_U.format('radius')})*0.65e0+0.25e0)*0.42e0)"


@query(
    "s25_constellation",
    f"""SELECT c.issuer_cik AS id, c.sector, {r(f'greatest(0.03e0,least(0.97e0,0.5e0+cos({_DIR})*{_REACH}))')} AS x, {r(f'greatest(0.03e0,least(0.97e0,0.5e0+sin({_DIR})*{_REACH}))')} AS y,
     {r('3+least(log10(greatest(market_cap,1e0))/2.5e0,8e0)', 4)} AS radius, {r('coalesce(b.conviction_score,0)/100e0', 4)} AS glow, {r('coalesce(b.behavior,0)/100e0', 4)} AS pulse
    FROM context c JOIN (SELECT sector, row_number() OVER (ORDER BY sector)-1 AS orbit, count(*) OVER () AS sectors FROM (SELECT DISTINCT sector FROM context)) o USING (sector)
    LEFT JOIN (SELECT issuer_cik, max(conviction_score) AS conviction_score, arg_max(behavior_change_score,(conviction_score,event_id)) AS behavior FROM sig GROUP BY 1) b USING (issuer_cik)""",
    ("context", "sig"),
)
def s25(spark, sf_dir):
    best = best_per_issuer(tables.signals(spark, sf_dir).select("issuer_cik", "event_id", "transaction_date", "conviction_score", "behavior_change_score"))
    return visuals.constellation(tables.company_context(spark, sf_dir), best).select("id", "sector", "x", "y", "radius", "glow", "pulse")


@query(
    "s25_heartbeat",
    f"SELECT event_id, transaction_date AS date, {r('behavior_change_score/100e0', 4)} AS amplitude, {r('conviction_score/100e0', 4)} AS intensity FROM sig",
    ("sig",),
)
def s25_heartbeat(spark, sf_dir):
    return visuals.heartbeat(tables.signals(spark, sf_dir)).select("event_id", "date", "amplitude", "intensity")


@query(
    "s25_ripples",
    f"""SELECT event_id, purchase_value, {r('sqrt(purchase_value/(SELECT max(purchase_value) FROM sig))')} AS radius FROM sig ORDER BY purchase_value DESC, conviction_score DESC, event_id LIMIT 250""",
    ("sig",),
)
def s25_ripples(spark, sf_dir):
    return visuals.ripples(tables.signals(spark, sf_dir)).select("event_id", "purchase_value", "radius")


@query(
    "s25_sector_orbits",
    f"""SELECT sector, CAST(row_number() OVER (ORDER BY mc DESC, sector)-1 AS INTEGER) AS orbit_index, {r('(row_number() OVER (ORDER BY mc DESC, sector)-1)*(2*pi())/count(*) OVER ()')} AS angle, {r('pv/max(pv) OVER ()')} AS relative_mass
    FROM (SELECT sector, median(conviction_score) AS mc, round(sum(purchase_value),2) AS pv FROM sig GROUP BY 1)""",
    ("sig",),
)
def s25_orbits(spark, sf_dir):
    return visuals.sector_orbits(activity.sector_payload(tables.signals(spark, sf_dir), tables.company_context(spark, sf_dir))).select(
        "sector", "orbit_index", "angle", "relative_mass"
    )


def _mult(x: str) -> str:
    return f"(CASE WHEN {x}>=10 THEN {trimmed(x, 1)} ELSE {trimmed(x, 2)} END||'×')"


@query(
    "s23_narrative",
    f"""SELECT event_id, CASE WHEN unique_buyers>1 THEN CAST(unique_buyers AS VARCHAR)||' executives bought shares in the same company.' WHEN purchase_multiple>1 THEN 'An executive made a purchase '||{_mult('purchase_multiple')}||' larger than usual.'
      ELSE 'Executives at '||company_name||' committed personal capital.' END AS headline,
     CASE WHEN unique_buyers>=3 THEN CAST(unique_buyers AS VARCHAR)||' independent buyers reached the same decision, which makes the activity harder to dismiss as an isolated trade.'
      WHEN ownership_increase_percent>=20 THEN 'The purchase materially increased the insider’s ownership by '||{trimmed('ownership_increase_percent', 1)}||'%, creating a meaningfully larger personal exposure.'
      WHEN purchase_value>=1000000 THEN 'The reported purchase exceeded '||{money('purchase_value')}||', making it a substantial personal commitment rather than a token transaction.'
      WHEN conviction_score>=80 THEN 'The evidence remains strong after accounting for history, ownership, role relevance, confirmation, and data quality.'
      ELSE 'The purchase becomes more meaningful when viewed against the executive’s prior behavior and current ownership.' END AS why_it_matters,
     CASE WHEN prior_purchase_count=0 THEN 'This is the first recorded qualifying open-market purchase in the available history.' WHEN days_since_previous_purchase>=1095 THEN 'The executive returned after roughly '||{fixed('days_since_previous_purchase/365e0', 1)}||' years without a comparable purchase.'
      WHEN purchase_multiple>=3 THEN 'The purchase was '||{_mult('purchase_multiple')}||' the executive’s prior median purchase size.'
      WHEN behavior_change_score>=75 THEN 'The executive’s current behavior differs sharply from their own historical pattern, with a behavior-change score of '||{fixed('behavior_change_score', 0)}||'.'
      ELSE 'The timing, size, or ownership impact differs from the executive’s established pattern.' END AS why_unusual,
     array_to_string(list_filter([{money('purchase_value')}||' reported purchase', CASE WHEN purchase_multiple<>0 THEN {_mult('purchase_multiple')}||' prior median' END, CASE WHEN ownership_increase_percent<>0 THEN {trimmed('ownership_increase_percent', 1)}||'% ownership increase' END,
      CAST(unique_buyers AS VARCHAR)||' independent buyer'||(CASE WHEN unique_buyers=1 THEN '' ELSE 's' END), 'Evidence strength '||{fixed('conviction_score', 0)}], lambda x: x IS NOT NULL)[1:4],'; ') AS evidence FROM sig""",
    ("sig",),
)
def s23(spark, sf_dir):
    c = F.col
    return tables.signals(spark, sf_dir).select(
        "event_id",
        narrative.company_headline(F.lit(""), c("unique_buyers"), c("purchase_multiple"), c("company_name")).alias("headline"),
        narrative.why_it_matters(c("conviction_score"), c("unique_buyers"), c("ownership_increase_percent"), c("purchase_value")).alias("why_it_matters"),
        narrative.why_it_is_unusual(c("prior_purchase_count"), c("days_since_previous_purchase"), c("purchase_multiple"), c("behavior_change_score")).alias("why_unusual"),
        F.array_join(narrative.evidence_lines(c("purchase_value"), c("purchase_multiple"), c("ownership_increase_percent"), c("unique_buyers"), c("conviction_score")), "; ").alias("evidence"),
    )
