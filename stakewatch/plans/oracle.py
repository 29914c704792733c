"""SQL views for the oracles, written independently of the Spark jobs (plain windows, lists and joins on whole tables).

Rounding is spelled ``floor(x * 10^d + 0.5) / 10^d`` on both sides.
"""

from __future__ import annotations

import re

from stakewatch import params


def r(expression: str, digits: int = 6) -> str:
    return f"(floor(({expression})*1e{digits}+0.5)/1e{digits})"


def clip(expression: str) -> str:
    return f"greatest(0e0, least(100e0, {expression}))"


def sid(*parts: str) -> str:
    texts = ", ".join(f"CAST({p} AS VARCHAR)" for p in parts)
    return f"substr(sha256(CAST(to_json([{texts}]) AS VARCHAR)),1,24)"


def fixed(expression: str, digits: int) -> str:
    """Decimal text with a fixed number of digits."""
    units = f"CAST(floor(abs({expression})*1e{digits}+0.5) AS BIGINT)"
    sign = f"CASE WHEN ({expression}) < 0 AND {units} > 0 THEN '-' ELSE '' END"
    if digits == 0:
        return f"({sign} || CAST({units} AS VARCHAR))"
    power = 10**digits
    return f"({sign} || CAST({units}//{power} AS VARCHAR) || '.' || lpad(CAST({units}%{power} AS VARCHAR),{digits},'0'))"


def trimmed(expression: str, digits: int) -> str:
    return f"regexp_replace({fixed(expression, digits)}, '\\.0$', '')"


def feed_money(x: str) -> str:
    sign = f"CASE WHEN ({x}) < 0 THEN '-' ELSE '' END"
    return (
        f"(CASE WHEN abs({x})>=1e9 THEN {sign}||'$'||{trimmed(f'abs({x})/1e9', 1)}||'B' "
        f"WHEN abs({x})>=1e6 THEN {sign}||'$'||{trimmed(f'abs({x})/1e6', 1)}||'M' "
        f"WHEN abs({x})>=1e3 THEN {sign}||'$'||{trimmed(f'abs({x})/1e3', 1)}||'K' "
        f"ELSE {sign}||'$'||{fixed(f'abs({x})', 0)} END)"
    )


def compact(x: str) -> str:
    out = f"CASE WHEN ({x}) = floor({x}) THEN regexp_replace(CAST(CAST({x} AS BIGINT) AS VARCHAR), '(\\d)(\\d{{3}})$', '\\1,\\2') ELSE {trimmed(x, 1)} END"
    for size, suffix in (("1e3", "K"), ("1e6", "M"), ("1e9", "B"), ("1e12", "T")):
        part = f"({x})/{size}"
        text = f"CASE WHEN abs({part})<10 THEN {trimmed(part, 1)} ELSE {fixed(part, 0)} END"
        out = f"CASE WHEN abs({x})>={size} THEN ({text})||'{suffix}' ELSE ({out}) END"
    return f"({out})"


def money(x: str) -> str:
    return f"coalesce('$'||{compact(x)}, 'Not available')"


def roles_sql(title: str) -> str:
    text = f"regexp_replace(lower({title}), '\\s+', ' ', 'g')"
    parts = []
    for name, (aliases, roles) in params.ROLE_ALIASES.items():
        pattern = "(^|[^a-z0-9])(" + "|".join(aliases) + ")([^a-z0-9]|$)"
        hit = f"regexp_matches({text}, '{pattern}')"
        if name == "president":
            hit += f" AND NOT regexp_matches({text}, '(^|[^a-z0-9])vice president([^a-z0-9]|$)')"
        names = ", ".join(f"'{x}'" for x in roles)
        parts.append(f"CASE WHEN {hit} THEN [{names}] ELSE []::VARCHAR[] END")
    parts.append(f"CASE WHEN contains({text}, 'founder') THEN ['founder'] ELSE []::VARCHAR[] END")
    return "list_sort(list_distinct(flatten([" + ", ".join(parts) + "])))"


TITLE_SQL = (
    "CASE {0} WHEN 'BUILDING' THEN 'Founder, President and CEO' WHEN 'MACHINERY' THEN 'Chief Financial Officer' "
    "WHEN 'AUTOMOBILE' THEN 'Director' WHEN 'HOUSEHOLD' THEN 'Vice President' ELSE '' END"
)

ROLE_POINTS = (
    "CASE WHEN list_contains(normalized_roles,'founder') AND list_contains(normalized_roles,'ceo') THEN 100e0 ELSE coalesce(list_max(list_transform("
    "normalized_roles, lambda x: CASE x "
    + " ".join(f"WHEN '{k}' THEN {v:.1f}e0" for k, v in params.ROLE_QUALITY.items())
    + " ELSE 0e0 END)), 0e0) END"
)


def role_label_sql(roles: str) -> str:
    order = [("founder", "Founder"), ("ceo", "CEO"), ("cfo", "CFO"), ("coo", "COO"), ("president", "President"), ("director", "Director")]
    return "CASE " + " ".join(f"WHEN list_contains({roles},'{k}') THEN '{v}'" for k, v in order) + " ELSE 'Insider' END"


VIEWS: dict[str, str] = {}

VIEWS["role_table"] = (
    "SELECT seg AS segment, " + roles_sql(TITLE_SQL.format("seg")) + " AS normalized_roles FROM (SELECT DISTINCT c_mktsegment AS seg FROM customer)"
)

VIEWS["lots"] = """
SELECT b.*, sum(shares) OVER (PARTITION BY issuer_cik,insider_id
   ORDER BY transaction_date,accession_number,line_no,part_no,shares,reported_value
   ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS shares_owned_after,
  is_non_derivative AND transaction_code='P' AND acquired_disposed_code='A' AND shares>0 AND price_per_share>0 AS is_qualifying_purchase,
  t.normalized_roles, '' AS footnotes,
  CASE WHEN (transaction_code='P' AND acquired_disposed_code='A' AND shares>0 AND price_per_share>0) OR NOT is_non_derivative
   THEN 'high' ELSE 'acceptable' END AS quality
FROM (SELECT lpad(CAST(l_orderkey AS VARCHAR),10,'0') AS accession_number, l_linenumber AS line_no,
  lpad(CAST(l_suppkey AS VARCHAR),10,'0') AS issuer_cik, lpad(CAST(c_nationkey AS VARCHAR),10,'0') AS insider_id,
  lpad(CAST(c_nationkey AS VARCHAR),10,'0') AS owner_cik,
  concat('S',CAST(l_suppkey AS VARCHAR)) AS ticker, CAST(o_orderdate AS DATE) AS transaction_date,
  CAST(o_orderdate AS DATE) + CAST(l_linenumber AS INT) AS filing_date, CAST(l_shipdate AS DATE) AS filing_date_raw,
  CASE WHEN p_size % 2 = 0 THEN 'Common Stock' ELSE p_type END AS security_title,
  CASE WHEN l_linestatus='O' THEN 'D' ELSE 'I' END AS direct_indirect_code,
  CASE l_returnflag WHEN 'N' THEN 'P' WHEN 'A' THEN 'S' ELSE 'F' END AS transaction_code,
  CASE WHEN l_returnflag='N' THEN 'A' ELSE 'D' END AS acquired_disposed_code,
  p_size % 10 <> 0 AS is_non_derivative, o_orderpriority LIKE '5%' AS is_amendment, c_mktsegment AS segment,
  l_quantity AS shares, l_extendedprice/l_quantity AS price_per_share, l_extendedprice AS reported_value, l_partkey AS part_no
 FROM lineitem JOIN orders ON l_orderkey=o_orderkey JOIN customer ON o_custkey=c_custkey JOIN part ON l_partkey=p_partkey) b
JOIN role_table t USING (segment)"""

VIEWS["grouped_events"] = """
SELECT issuer_cik,owner_cik,insider_id,ticker,transaction_date,security_title,direct_indirect_code,accession_number,
 max(filing_date) AS filing_date, sum(shares) AS total_shares, round(sum(reported_value),2) AS purchase_value,
 CAST(count(*) AS INTEGER) AS lot_count, max(shares_owned_after) AS reported_holdings_after,
 list_sort(list_distinct(flatten(list(normalized_roles)))) AS normalized_roles,
 CASE WHEN bool_and(quality='high') THEN 'high' ELSE 'acceptable' END AS event_quality
FROM lots WHERE is_qualifying_purchase GROUP BY 1,2,3,4,5,6,7,8"""

VIEWS["pe"] = f"""
SELECT *, {sid('issuer_cik','owner_cik','insider_id','ticker','transaction_date','security_title','direct_indirect_code','accession_number')} AS event_id,
 purchase_value/nullif(total_shares,0) AS weighted_average_price, reported_holdings_after-total_shares AS holdings_before,
 CASE WHEN reported_holdings_after-total_shares<0 THEN NULL
  WHEN reported_holdings_after-total_shares=0 THEN CASE WHEN total_shares>0 THEN 100e0 ELSE 0e0 END
  ELSE total_shares/(reported_holdings_after-total_shares)*100 END AS ownership_increase_percent,
 reported_holdings_after-total_shares=0 AND total_shares>0 AS first_reported_position,
 direct_indirect_code NOT IN ('D','I') AS ambiguous_ownership
FROM grouped_events"""

VIEWS["prices"] = """
SELECT ticker,date,low AS open,high,low,(low+high)/2 AS close,(low+high)/2 AS adj_close,volume,0e0 AS dividends,
 CASE WHEN month(date)=7 AND day(date)=1 THEN 2e0 ELSE 0e0 END AS stock_splits FROM (
 SELECT concat('S',CAST(l_suppkey AS VARCHAR)) AS ticker, CAST(l_shipdate AS DATE) AS date, min(l_extendedprice/l_quantity) AS low,
 max(l_extendedprice/l_quantity) AS high, sum(l_quantity) AS volume FROM lineitem GROUP BY 1,2) q"""

VIEWS["companies"] = """
SELECT lpad(CAST(s_suppkey AS VARCHAR),10,'0') AS issuer_cik, concat('S',CAST(s_suppkey AS VARCHAR)) AS ticker, s_name AS company_name,
 r_name AS sector, n_name AS industry, s_acctbal*1000000 AS market_cap, CASE WHEN s_suppkey % 17 = 0 THEN 'ETF' ELSE 'EQUITY' END AS quote_type
FROM supplier JOIN nation ON s_nationkey=n_nationkey JOIN region ON n_regionkey=r_regionkey"""

VIEWS["price_facts"] = """
SELECT ticker, max_by(close,date) AS latest_price, avg(close*volume) AS average_dollar_volume_63d FROM (
 SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS age FROM prices) WHERE age<=63 GROUP BY ticker"""

VIEWS["context"] = """
SELECT *, len(eligibility_reasons)=0 AS discovery_eligible FROM (
SELECT c.*, latest_price, average_dollar_volume_63d, list_filter([
 CASE WHEN market_cap IS NULL THEN 'missing_market_cap' WHEN market_cap<50e6 THEN 'market_cap_below_minimum'
  WHEN market_cap>10e9 THEN 'market_cap_above_maximum' END,
 CASE WHEN latest_price IS NULL THEN 'missing_price' WHEN latest_price<1 THEN 'price_below_minimum' END,
 CASE WHEN average_dollar_volume_63d IS NULL OR average_dollar_volume_63d<100000 THEN 'insufficient_liquidity' END,
 CASE WHEN regexp_matches(lower(quote_type),'etf|fund|warrant|preferred') THEN 'excluded_security_type' END],
 lambda x: x IS NOT NULL) AS eligibility_reasons
FROM companies c LEFT JOIN price_facts USING (ticker))"""

_W = "(PARTITION BY ticker ORDER BY date)"
VIEWS["sessions"] = f"""
SELECT *, CASE WHEN n_ret>=63 THEN sd*sqrt(252e0) END AS realized_volatility_63d FROM (
SELECT ticker,date,close, lag(close) OVER {_W} AS prior_session_close,
 close/lag(close,21) OVER {_W}-1 AS return_prior_21d, close/lag(close,63) OVER {_W}-1 AS return_prior_63d,
 close/lag(close,126) OVER {_W}-1 AS return_prior_126d,
 close/max(high) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 251 PRECEDING AND CURRENT ROW)-1 AS drawdown_52w,
 close/max(high) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 755 PRECEDING AND CURRENT ROW)-1 AS drawdown_3y,
 CASE WHEN row_number() OVER {_W}>=200 THEN close/avg(close) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 199 PRECEDING AND CURRENT ROW)-1 END AS distance_200d_ma,
 count(ret) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 62 PRECEDING AND CURRENT ROW) AS n_ret,
 stddev_samp(ret) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 62 PRECEDING AND CURRENT ROW) AS sd,
 avg(close*volume) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 62 PRECEDING AND CURRENT ROW) AS average_dollar_volume_63d,
 coalesce(product(CASE WHEN stock_splits>0 THEN stock_splits END) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING),1e0) AS split_factor_after,
 {", ".join(f"lead(close,{n}) OVER {_W}/close-1 AS evaluation_forward_return_{n}d" for n in params.FORWARD_SESSIONS)}
FROM (SELECT *, close/lag(close) OVER {_W}-1 AS ret FROM prices))"""

VIEWS["priced"] = """
SELECT e.*, s.ticker IS NOT NULL AS price_available, s.date AS price_context_date, s.close AS transaction_date_close,
 s.* EXCLUDE (ticker,date,close,n_ret,sd,split_factor_after),
 CASE WHEN s.ticker IS NOT NULL THEN coalesce((SELECT product(stock_splits) FROM prices p
   WHERE p.ticker=e.ticker AND p.date>e.transaction_date AND p.stock_splits>0),1e0) END AS split_factor_after_event
FROM pe e ASOF LEFT JOIN sessions s ON e.ticker=s.ticker AND e.transaction_date<=s.date"""

_P = "PARTITION BY issuer_cik,insider_id ORDER BY transaction_date"
_PRE = f"({_P} RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 DAY PRECEDING)"


def _back(days: int) -> str:
    return f"({_P} RANGE BETWEEN INTERVAL {days} DAYS PRECEDING AND INTERVAL 1 DAY PRECEDING)"


_GAPPED = "lag(transaction_date) OVER (PARTITION BY issuer_cik,insider_id ORDER BY transaction_date,event_id)"
VIEWS["hist"] = f"""
SELECT *, CASE WHEN prior_purchase_count=0 THEN 'no_history' WHEN prior_purchase_count<=2 THEN 'sparse'
  WHEN prior_purchase_count<=7 THEN 'usable' ELSE 'deep' END AS history_depth,
 CASE WHEN prior_purchase_count=0 THEN 'limited' WHEN prior_purchase_count<=2 THEN 'acceptable' ELSE 'high' END AS history_quality,
 CAST(transaction_date-previous_purchase_date AS INTEGER) AS days_since_previous_purchase,
 len(list_filter(prior_list, lambda x: x<=purchase_value))*1e0/nullif(len(prior_list),0)*100 AS prior_purchase_value_percentile
FROM (SELECT *, count(*) OVER {_PRE} AS prior_purchase_count,
 {", ".join(f"count(*) OVER {_back(n)} AS {c}" for c, n in params.HISTORY_DAYS.items())},
 coalesce(sum(purchase_value) OVER {_PRE},0) AS cumulative_prior_purchase_value, avg(purchase_value) OVER {_PRE} AS prior_mean_purchase_value,
 max(purchase_value) OVER {_PRE} AS largest_prior_purchase_value, median(purchase_value) OVER {_PRE} AS prior_median_purchase_value,
 median(ownership_increase_percent) OVER {_PRE} AS prior_median_ownership_increase_percent,
 min(transaction_date) OVER {_PRE} AS first_prior_purchase_date, max(transaction_date) OVER {_PRE} AS previous_purchase_date,
 list(purchase_value) OVER {_PRE} AS prior_list,
 median(gap) OVER {_PRE} AS median_prior_gap_days, CAST(max(gap) OVER {_PRE} AS DOUBLE) AS longest_prior_gap_days
 FROM (SELECT *, CAST(transaction_date-{_GAPPED} AS INTEGER) AS gap FROM priced))"""

_ROWS = "(PARTITION BY issuer_cik,insider_id ORDER BY transaction_date,event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
_UPTO = "(PARTITION BY issuer_cik,insider_id ORDER BY transaction_date,event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
_DAY = "(PARTITION BY issuer_cik,insider_id,transaction_date ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
_LINE = "(PARTITION BY issuer_cik,insider_id ORDER BY transaction_date,event_id)"

VIEWS["placed"] = f"""
SELECT h.*, row_number() OVER {_LINE}-1 AS sequence, row_number() OVER {_DAY}-1 AS day_place,
 count(*) OVER {_ROWS} AS priors, median(purchase_value) OVER {_ROWS} AS med, max(purchase_value) OVER {_ROWS} AS largest,
 list(purchase_value) OVER {_ROWS} AS pos_list, median(ln(1+purchase_value)) OVER {_ROWS} AS med_log,
 mad(ln(1+purchase_value)) OVER {_ROWS} AS mad_log,
 {", ".join(f"round(coalesce(sum(purchase_value) OVER {_back(n)},0)+sum(purchase_value) OVER {_DAY},2) AS purchase_value_{n}d, count(*) OVER {_back(n)}+row_number() OVER {_DAY} AS purchase_count_{n}d" for n in params.VELOCITY_DAYS)},
 round(coalesce(sum(purchase_value) OVER {_back(90)},0)+sum(purchase_value) OVER {_DAY}-purchase_value,2) AS same_90,
 round(sum(purchase_value) OVER ({_P} RANGE BETWEEN INTERVAL 90 DAYS PRECEDING AND CURRENT ROW),2) AS full_90,
 regr_slope(ln(1+purchase_value), row_no) OVER {_UPTO} AS slope,
 first_value(gap2) OVER (PARTITION BY issuer_cik,insider_id ORDER BY row_no ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS gap_first
FROM (SELECT *, row_number() OVER {_LINE}-1 AS row_no,
 CAST(lead(transaction_date) OVER {_LINE}-transaction_date AS INTEGER) AS gap2 FROM hist) h"""

VIEWS["velocities"] = f"""
SELECT *, list_aggregate(list_concat(coalesce(list(full_90) OVER {_PRE}, []::DOUBLE[]), list_resize([]::DOUBLE[], CAST(day_place AS INTEGER), same_90)),'median') AS med_90
FROM placed"""

VIEWS["clusters"] = """
SELECT issuer_cik, transaction_date, CAST(count(*) AS INTEGER) AS unique_buyers, CAST(sum(CASE WHEN regexp_matches(roles,'operating_executive|ceo|cfo|founder') THEN 1 ELSE 0 END) AS INTEGER) AS unique_operating_executives,
 bool_or(regexp_matches(roles,'(^|\\|)ceo(\\||$)')) AS ceo_present, bool_or(regexp_matches(roles,'(^|\\|)cfo(\\||$)')) AS cfo_present,
 bool_or(regexp_matches(roles,'(^|\\|)founder(\\||$)')) AS founder_present, round(sum(value),2) AS cluster_purchase_value
FROM (SELECT d.issuer_cik, d.transaction_date, e.insider_id, arg_max(array_to_string(e.normalized_roles,'|'), (e.transaction_date, e.event_id)) AS roles, sum(e.purchase_value) AS value
 FROM (SELECT DISTINCT issuer_cik, transaction_date FROM pe) d JOIN pe e ON d.issuer_cik=e.issuer_cik
  AND e.transaction_date BETWEEN d.transaction_date-14 AND d.transaction_date GROUP BY 1,2,3) GROUP BY 1,2"""

_Z = "CASE WHEN priors=0 THEN NULL WHEN mad_log>0 THEN (ln(1+purchase_value)-med_log)/(mad_log*1.4826) WHEN purchase_value>med THEN 10e0 ELSE 0e0 END"
_PCT = "len(list_filter(pos_list, lambda x: x<purchase_value))*1e0/nullif(priors,0)*100"
_SLOPE = "CASE WHEN sequence>=2 THEN slope END"
_FREQ = "CASE WHEN sequence>=2 THEN (gap_first*1e0-gap)/greatest(gap_first,1) END"

VIEWS["scored_parts"] = f"""
SELECT *, LEAST(100e0, GREATEST(ownership_increase_percent,0e0)*2) AS ownership_score,
 CASE history_depth WHEN 'sparse' THEN 45e0 WHEN 'usable' THEN 80e0 WHEN 'deep' THEN 100e0 ELSE 20e0 END AS history_quality_score,
 {ROLE_POINTS} AS role_score,
 CASE WHEN first_ever_purchase THEN 60e0 ELSE {clip("historical_percentile*0.45e0+greatest(0e0,least(1e0,purchase_multiple/10))*35+greatest(0e0,least(1e0,greatest(robust_z,0e0)/5))*20")} END AS abnormality_score,
 CASE WHEN first_ever_purchase THEN 'limited' WHEN priors>=3 THEN 'high' ELSE 'acceptable' END AS abnormality_quality,
 CASE WHEN first_ever_purchase THEN 70e0 WHEN days_since_previous_purchase IS NULL THEN 0e0 ELSE least(100e0, 25+days_since_previous_purchase/365e0*12+coalesce(greatest(gap_multiple-1,0e0)*15,0e0)) END AS silence_break_score,
 least(100e0, 40+coalesce(velocity_multiple,0e0)*15) AS velocity_score,
 CASE WHEN sequence>=2 THEN {clip("50+value_acceleration*25+frequency_acceleration*25")} ELSE 0e0 END AS acceleration_score
FROM (SELECT v.*, priors=0 AS first_ever_purchase, CASE WHEN priors>0 THEN purchase_value/med END AS purchase_multiple,
 CASE WHEN priors>0 THEN purchase_value/largest END AS largest_prior_multiple, {_PCT} AS historical_percentile, {_Z} AS robust_z,
 greatest(-10e0, least(10e0, {_Z})) AS robust_z_display,
 CASE WHEN priors>0 AND days_since_previous_purchase IS NOT NULL AND median_prior_gap_days>0 THEN days_since_previous_purchase/median_prior_gap_days END AS gap_multiple,
 purchase_value_90d/nullif(med_90,0) AS velocity_multiple, {_SLOPE} AS value_acceleration, {_FREQ} AS frequency_acceleration,
 sequence+1 AS acceleration_sample_count
 FROM velocities v)"""

_BW = params.BEHAVIOR_WEIGHTS
_BC = params.BEHAVIOR_COLUMNS
_points = "+".join(f"coalesce({c}*{_BW[w]}e0,0e0)" for w, c in _BC.items())
_weight = "+".join(f"CASE WHEN {c} IS NOT NULL THEN {_BW[w]}e0 ELSE 0e0 END" for w, c in _BC.items())

VIEWS["behaviors"] = f"""
SELECT p.*, {r(f"({_points})/({_weight})", 4)} AS behavior_change_score,
 least(100e0, 25e0*c.unique_buyers+15e0*CAST(c.ceo_present AS INTEGER)+15e0*CAST(c.cfo_present AS INTEGER)+15e0*CAST(c.founder_present AS INTEGER)) AS cluster_score,
 c.* EXCLUDE (issuer_cik,transaction_date), x.company_name, x.sector, x.industry, x.market_cap, coalesce(x.discovery_eligible,false) AS discovery_eligible
FROM scored_parts p JOIN clusters c ON p.issuer_cik=c.issuer_cik AND p.transaction_date=c.transaction_date LEFT JOIN context x ON p.issuer_cik=x.issuer_cik"""

_CW = params.CONVICTION_WEIGHTS
_PEN = params.PENALTIES
VIEWS["sig"] = f"""
SELECT *, CASE WHEN conviction_score>=90 THEN 'exceptional' WHEN conviction_score>=80 THEN 'rare' WHEN conviction_score>=65 THEN 'unusual'
  WHEN conviction_score>=50 THEN 'notable' ELSE 'ordinary' END AS conviction_grade,
 array_to_string(list_filter([CASE WHEN direct_indirect_code='I' THEN 'indirect_only' END, CASE WHEN NOT discovery_eligible THEN 'microcap_or_illiquid' END,
  CASE WHEN NOT price_available THEN 'missing_price' END, CASE WHEN history_depth IN ('no_history','sparse') THEN 'sparse_history' END], lambda x: x IS NOT NULL),'|') AS reason_codes
FROM (SELECT *, {r(clip(f'''behavior_change_score*{_CW["behavior_change"]}e0+least(100e0,log10(greatest(purchase_value,1e0))/7*100)*{_CW["absolute_purchase_size"]}e0
 +coalesce(ownership_score,0e0)*{_CW["ownership_increase"]}e0+cluster_score*{_CW["cluster_confirmation"]}e0+role_score*{_CW["role_quality"]}e0
 +(CASE WHEN direct_indirect_code='D' THEN 100e0 ELSE 35e0 END)*{_CW["direct_ownership"]}e0+(CASE WHEN discovery_eligible THEN 100e0 ELSE 35e0 END)*{_CW["company_context"]}e0
 +(CASE WHEN event_quality='high' THEN 100e0 ELSE 65e0 END)*{_CW["data_quality"]}e0
 -((CASE WHEN direct_indirect_code='I' THEN {_PEN["indirect_only"]}e0 ELSE 0e0 END)+(CASE WHEN NOT discovery_eligible THEN {_PEN["microcap_or_illiquid"]}e0 ELSE 0e0 END)
 +(CASE WHEN NOT price_available THEN {_PEN["missing_price"]}e0 ELSE 0e0 END)+(CASE WHEN history_depth IN ('no_history','sparse') THEN {_PEN["sparse_history"]}e0 ELSE 0e0 END))'''), 4)} AS conviction_score
 FROM behaviors)"""

_CAP = "CASE WHEN market_cap<=1e9 THEN 100e0 ELSE greatest(0e0,100-(market_cap-1e9)/9e7) END"
_DD = "abs(least(0e0,coalesce(drawdown_52w,0e0)))"
RULES = {
    "breaking_habits": (
        "first_ever_purchase OR coalesce(purchase_multiple,0)>=2",
        "abnormality_score*0.45e0+coalesce(historical_percentile,0e0)*0.25e0+coalesce(robust_z_display,0e0)*0.2e0*10+(CASE WHEN history_depth IN ('usable','deep') THEN 100e0 ELSE 40e0 END)*0.1e0",
    ),
    "quiet_buyers": (
        "coalesce(days_since_previous_purchase,0)>=365 OR first_ever_purchase",
        "silence_break_score*0.5e0+coalesce(ownership_increase_percent,0e0)*0.25e0+conviction_score*0.25e0",
    ),
    "wolf_packs": ("unique_buyers>=2", "cluster_score*0.45e0+conviction_score*0.3e0+least(100e0,unique_buyers*25e0)*0.25e0"),
    "growing_positions": (
        "coalesce(ownership_increase_percent,0)>0",
        "least(100e0,ownership_increase_percent*2)*0.45e0+conviction_score*0.35e0+(CASE WHEN direct_indirect_code='D' THEN 100e0 ELSE 30e0 END)*0.2e0",
    ),
    "accelerating": ("acceleration_score>0 AND acceleration_sample_count>=2", "acceleration_score*0.6e0+conviction_score*0.4e0"),
    "contrarian": (f"{_DD}>=0.15e0 AND conviction_score>=50 AND history_quality<>'unusable'", f"conviction_score*0.55e0+least(100e0,{_DD}*200)*0.45e0"),
    "under_the_radar": (
        "discovery_eligible AND (market_cap=0 OR market_cap<=1e10)",
        f"conviction_score*0.45e0+behavior_change_score*0.4e0+({_CAP})*0.15e0",
    ),
}


def headline_sql(category: str) -> str:
    role = role_label_sql("normalized_roles")
    return f"""CASE WHEN {category}='wolf_packs' AND unique_buyers>=2 THEN CAST(unique_buyers AS VARCHAR)||' insiders bought within 14 days'
 WHEN {category}='quiet_buyers' AND days_since_previous_purchase>0 THEN 'First open-market purchase in '||{fixed("days_since_previous_purchase/365.25e0", 1)}||' years'
 WHEN {category}='growing_positions' AND ownership_increase_percent>0 THEN ({role})||' increased direct holdings by '||{fixed("ownership_increase_percent", 0)}||'%'
 WHEN {category}='accelerating' THEN 'Purchase size and frequency are accelerating'
 WHEN purchase_multiple>0 THEN ({role})||' purchase was '||{fixed("purchase_multiple", 1)}||'× larger than prior median'
 WHEN first_ever_purchase THEN 'First recorded open-market purchase by '||lower({role})
 ELSE 'Unusual open-market purchase by '||lower({role}) END"""


VIEWS["ranked"] = f"""
SELECT *, CAST(row_number() OVER (PARTITION BY ranking_category ORDER BY ranking_score DESC, conviction_score DESC, ticker, stable_key) AS INTEGER) AS rank
FROM (SELECT *, {sid("ranking_category", "issuer_cik", "event_id", "accession_number")} AS stable_key, {headline_sql("ranking_category")} AS headline, unique_buyers AS buyer_count,
 unique_operating_executives AS qualifying_operating_executive_count, transaction_date AS latest_transaction_date, filing_date AS latest_filing_date,
 history_quality AS score_quality, accession_number AS source_accession_numbers
 FROM ({" UNION ALL ".join(f"SELECT *, '{name}' AS ranking_category, {r(score)} AS ranking_score FROM sig WHERE {rule}" for name, (rule, score) in RULES.items())}))"""

NEEDS = {name: [v for v in VIEWS if v != name and re.search(rf"\b{v}\b", text)] for name, text in VIEWS.items()}


def add_view(name: str, sql: str) -> str:
    """Adds a shared view of a catalog."""
    VIEWS[name] = sql
    NEEDS[name] = [v for v in VIEWS if v != name and re.search(rf"\b{v}\b", sql)]
    return name


def with_views(sql: str, views: tuple[str, ...]) -> str:
    """The statement with the views it reads, and those they read, in front."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name not in ordered:
            for other in NEEDS[name]:
                visit(other)
            ordered.append(name)

    for view in views:
        visit(view)
    if not ordered:
        return sql
    return "WITH " + ",\n".join(f"{v} AS ({VIEWS[v]})" for v in ordered) + "\n" + sql
