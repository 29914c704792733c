"""The driver's tables read as filings data, and the stage tables derived from them.

Supplier stands for the issuer, the customer's nation for the buyer, an order for a filing, a line item for a lot.
A stage table is written once per session and input folder and read back, as a production run would do between its
steps: later queries then scan only the columns they need, and a lost executor costs one scan, not the whole chain.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from stakewatch import params
from stakewatch.functions.roles import roles_from_title
from stakewatch.operators import events as event_ops
from stakewatch.operators import prices as price_ops
from stakewatch.operators import rankings as ranking_ops
from stakewatch.operators import signals as signal_ops
from stakewatch.operators.grouping import may_exceed
from stakewatch.operators.history import PERSON, PERSON_DAY, has_large_days, with_daily_history
from stakewatch.operators.ordered_statistics import has_large_groups
from stakewatch.operators.total_order import CODEC, written
from stakewatch.session import DEAL_AGAIN, for_writing, shared_folder

# Market segment -> officer title (the driver's tables hold no titles).
TITLES = {
    "BUILDING": "Founder, President and CEO",
    "MACHINERY": "Chief Financial Officer",
    "AUTOMOBILE": "Director",
    "HOUSEHOLD": "Vice President",
    "FURNITURE": "",
}


def raw(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def padded(name: str) -> Column:
    return F.lpad(F.col(name).cast("string"), 10, "0")


def title_of(segment: Column) -> Column:
    out = F.lit("")
    for name, title in TITLES.items():
        out = F.when(segment == name, F.lit(title)).otherwise(out)
    return out


def segment_roles(customer: DataFrame) -> DataFrame:
    """Roles per market segment: titles are read once per distinct text, not once per lot."""
    titles = customer.select(F.col("c_mktsegment").alias("segment")).distinct()
    return titles.withColumn("normalized_roles", roles_from_title(title_of(F.col("segment"))))


def short(name: str) -> Column:
    """The number that ``padded`` shows: its first ten signs. Takes less room than the text, and tells the same rows apart."""
    return F.substring(F.col(name).cast("string"), 1, 10).cast("bigint")


#: Weights of the two flags in the codes of a lot; a flag is 0, 1 or, where it is missing, 2.
AMENDMENT, NON_DERIVATIVE = 8, 24


def flag_code(flag: Column) -> Column:
    return F.coalesce(flag.cast("int"), F.lit(2))


def flag_of(codes: Column, weight: int) -> Column:
    """The flag of that weight in the codes."""
    code = F.floor(codes / weight) % 3
    return F.when(code < 2, code == 1)


def lot_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with what their order, buyer and part say, as numbers and codes: texts are made after the last shuffle."""
    customer = raw(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    orders = raw(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.col("o_orderdate").cast("date").alias("day"), F.col("o_orderpriority").like("5%").alias("is_amendment"))
    # Buyers meet the orders, which are fewer and narrower than their lines.
    orders = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).drop("o_custkey", "c_custkey")
    part = raw(spark, sf_dir, "part").select("p_partkey", "p_size", F.when(F.col("p_size") % 2 == 0, F.lit("Common Stock")).otherwise(F.col("p_type")).alias("security_title"))
    # Codes: what was returned (2, 1 or 0), 4 more for open lines, and both flags.
    returned = F.when(F.col("l_returnflag") == "N", 2).when(F.col("l_returnflag") == "A", 1).otherwise(0)
    line = raw(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", (returned + F.when(F.col("l_linestatus") == "O", 4).otherwise(0)).alias("codes"),
        F.col("l_shipdate").cast("date").alias("ship_day"),
    )
    # Parts first: they add one text to a line, orders five columns.
    joined = line.join(part, F.col("l_partkey") == F.col("p_partkey")).join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    codes = F.col("codes") + flag_code(F.col("is_amendment")) * AMENDMENT + flag_code(F.col("p_size") % 10 != 0) * NON_DERIVATIVE
    return joined.select(
        short("c_nationkey").alias("_buyer"), short("l_orderkey").alias("_filing"), "l_suppkey", "l_partkey", "l_linenumber",
        "l_quantity", "l_extendedprice", codes.alias("codes"), "day", "ship_day", "security_title", "c_mktsegment",
    )


#: Whose holdings add up, and the place of a lot on its day.
HOLDER = ["_issuer", "_buyer"]
#: Lots of one holder that one task may add up by itself.
HOLDER_ROWS = 1_000_000


def on_its_day() -> list[Column]:
    return [F.col(c) for c in ("_text", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")]


def held_by_line(facts: DataFrame) -> DataFrame:
    """Lots with the holdings after each: one running sum per holder, only where no holder ``may_exceed`` what a task can add up.
    A lot before the first known quantity of its day has none; lots without a day come first and are not shown."""
    # Dealt out before the windows ask for it, so that the text they sort by is made after the shuffle and not sent.
    dealt = facts.dropna(subset=["l_suppkey", "_buyer"]).repartition(short("l_suppkey"), "_buyer")
    dealt = dealt.withColumns({"_issuer": short("l_suppkey"), "_text": padded("_filing")})
    so_far = Window.partitionBy(*HOLDER).orderBy("day", *on_its_day()).rowsBetween(Window.unboundedPreceding, 0)
    inside = Window.partitionBy(*HOLDER, "day").orderBy(*on_its_day()).rowsBetween(Window.unboundedPreceding, 0)
    total = dealt.withColumn("_total", F.sum("l_quantity").over(so_far)).withColumn("_known", F.count("l_quantity").over(inside))
    held = total.filter("day is not null").withColumn("shares_owned_after", F.when(F.col("_known") > 0, F.col("_total")))
    return held.drop("_total", "_known", "_text")


def held_by_day(facts: DataFrame) -> DataFrame:
    """The same for holders of any size: the sum of earlier days (one row per day) plus the running sum inside the day."""
    facts = facts.withColumn("_issuer", short("l_suppkey"))
    dealt = facts.repartition(*HOLDER, "day").withColumn("_text", padded("_filing"))
    inside = Window.partitionBy(*HOLDER, "day").orderBy(*on_its_day()).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*HOLDER).orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    days = facts.groupBy(*HOLDER, "day").agg(F.sum("l_quantity").alias("_shares"))
    days = days.withColumn("_before", F.coalesce(F.sum("_shares").over(earlier), F.lit(0.0))).drop("_shares")
    both = dealt.withColumn("_inside", F.sum("l_quantity").over(inside)).join(days, [*HOLDER, "day"])
    return both.withColumn("shares_owned_after", F.col("_before") + F.col("_inside")).drop("_before", "_inside", "_text")


def build_lots(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = written(lot_facts(spark, sf_dir), "lot-facts")
    returned = F.col("codes") % 4
    large = may_exceed(facts, [short("l_suppkey"), F.col("_buyer")], HOLDER_ROWS)
    held = held_by_day(facts) if large else held_by_line(facts)
    code = F.when(returned == 2, "P").when(returned == 1, "S").otherwise("F")
    base = held.select(
        F.col("c_mktsegment").alias("segment"),
        padded("_issuer").alias("issuer_cik"),
        padded("_buyer").alias("insider_id"),
        F.col("day").alias("transaction_date"),
        padded("_filing").alias("accession_number"),
        F.col("l_linenumber").alias("line_no"),
        padded("_buyer").alias("owner_cik"),
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("ticker"),
        F.date_add("day", F.col("l_linenumber")).alias("filing_date"),
        F.col("ship_day").alias("filing_date_raw"),
        "security_title",
        F.when(F.col("codes") % 8 >= 4, "D").otherwise("I").alias("direct_indirect_code"),
        code.alias("transaction_code"),
        F.when(returned == 2, "A").otherwise("D").alias("acquired_disposed_code"),
        flag_of(F.col("codes"), NON_DERIVATIVE).alias("is_non_derivative"),
        flag_of(F.col("codes"), AMENDMENT).alias("is_amendment"),
        F.col("l_quantity").alias("shares"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price_per_share"),
        F.col("l_extendedprice").alias("reported_value"),
        F.col("l_partkey").alias("part_no"),
        "shares_owned_after",
    )
    qualifies = (
        F.col("is_non_derivative")
        & (F.col("transaction_code") == "P")
        & (F.col("acquired_disposed_code") == "A")
        & (F.col("shares") > 0)
        & (F.col("price_per_share") > 0)
    )
    customer = raw(spark, sf_dir, "customer")
    return (
        base.withColumn("is_qualifying_purchase", qualifies)
        .join(segment_roles(customer), "segment")
        .withColumn("footnotes", F.lit(""))
        .withColumn(
            "quality",
            F.when(F.col("is_qualifying_purchase") | ~F.col("is_non_derivative"), "high").otherwise("acceptable"),
        )
    )


def build_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a price row is made from; the stage holds no column twice."""
    line = raw(spark, sf_dir, "lineitem").select("l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity")
    price = F.col("l_extendedprice") / F.col("l_quantity")
    return line.groupBy(
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("ticker"),
        F.col("l_shipdate").cast("date").alias("date"),
    ).agg(F.min(price).alias("low"), F.max(price).alias("high"), F.sum("l_quantity").alias("volume"))


def price_rows(bars: DataFrame) -> DataFrame:
    middle = (F.col("low") + F.col("high")) / 2
    split_day = (F.month("date") == 7) & (F.dayofmonth("date") == 1)
    return bars.select(
        "ticker",
        "date",
        F.col("low").alias("open"),
        "high",
        "low",
        middle.alias("close"),
        middle.alias("adj_close"),
        "volume",
        F.lit(0.0).alias("dividends"),
        F.when(split_day, F.lit(2.0)).otherwise(F.lit(0.0)).alias("stock_splits"),
    )


def companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    supplier, nation, region = (raw(spark, sf_dir, n) for n in ("supplier", "nation", "region"))
    return (
        supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            padded("s_suppkey").alias("issuer_cik"),
            F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("ticker"),
            F.col("s_name").alias("company_name"),
            F.col("r_name").alias("sector"),
            F.col("n_name").alias("industry"),
            (F.col("s_acctbal") * 1000000).alias("market_cap"),
            F.when(F.col("s_suppkey") % 17 == 0, "ETF").otherwise("EQUITY").alias("quote_type"),
        )
    )


def insiders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per buyer that appears in the filings, with the union of the roles found there."""
    named = raw(spark, sf_dir, "nation").select(padded("n_nationkey").alias("insider_id"), F.col("n_name").alias("display_name"))
    roles = lots(spark, sf_dir).groupBy("insider_id").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("normalized_roles")))).alias("normalized_roles")
    )
    return named.join(roles, "insider_id").withColumn("owner_cik", F.col("insider_id"))


_written: dict[tuple[str, str, str], str] = {}


def is_written(spark: SparkSession, sf_dir: str, name: str) -> bool:
    return (spark.sparkContext.applicationId, sf_dir, name) in _written


def stage(spark: SparkSession, sf_dir: str, name: str, build: Callable[[SparkSession, str], DataFrame], settings: dict[str, str] | None = None) -> DataFrame:
    """Stage table, written on first use, with the settings that its plan was made for."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _written:
        folder = hashlib.sha256(sf_dir.encode()).hexdigest()[:12]
        path = f"{shared_folder(spark)}/stakewatch/{key[0]}/{folder}/{name}"
        rows = build(spark, sf_dir)
        with for_writing(spark, **(settings or {})):
            rows.write.mode("overwrite").option("compression", CODEC).parquet(path)
        _written[key] = path
    return spark.read.parquet(_written[key])


def lots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stage(spark, sf_dir, "lots", build_lots)


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return price_rows(stage(spark, sf_dir, "prices", build_bars))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stage(spark, sf_dir, "events", lambda s, d: event_ops.purchase_events(lots(s, d)))


def company_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stage(
        spark, sf_dir, "company_context", lambda s, d: price_ops.company_context(companies(s, d), prices(s, d))
    )


def priced_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stage(
        spark, sf_dir, "priced_events", lambda s, d: price_ops.add_price_context(events(s, d), prices(s, d))
    )


def daily_histories(written: DataFrame) -> DataFrame:
    """Daily histories of a written table of purchases, whose days are cut into parts only where one is large."""
    return with_daily_history(written, 2 if has_large_days(written) else 0)


#: What a history is made from, and what the clusters need; prices and texts of a purchase join its signal by its id.
HISTORY_COLUMNS = [*PERSON_DAY, "event_id", "purchase_value", "ownership_increase_percent", "normalized_roles"]


def placed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases with everything that adds up over days."""
    return stage(spark, sf_dir, "placed_events", lambda s, d: daily_histories(events(s, d).select(*HISTORY_COLUMNS)))


#: Buckets that the purchases of persons are counted by.
PERSON_BUCKETS = 1 << 20


def build_histories(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = placed_events(spark, sf_dir)
    return signal_ops.complete_histories(placed, has_large_groups(placed))


def histories_by_person(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from purchases dealt out by person once, for all their windows and the join of their days; only where one task can take
    every person whole."""
    purchases = events(spark, sf_dir).select(*HISTORY_COLUMNS)
    return signal_ops.complete_histories(with_daily_history(purchases.repartition(*PERSON), 0), False)


def histories(spark: SparkSession, sf_dir: str) -> DataFrame:
    if not is_written(spark, sf_dir, "histories"):
        if not may_exceed(events(spark, sf_dir), [F.col(c) for c in PERSON], params.ARRAY_GROUP_LIMIT, PERSON_BUCKETS):
            return stage(spark, sf_dir, "histories", histories_by_person, {DEAL_AGAIN: "false"})
    return stage(spark, sf_dir, "histories", build_histories)


def build_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals, joined by the bytes of the purchase ids, which are half as long as their digits."""
    found, purchases = (rows.withColumn("event_id", F.unhex("event_id")) for rows in (histories(spark, sf_dir).drop("history_id"), priced_events(spark, sf_dir)))
    scored = signal_ops.score_histories(found, company_context(spark, sf_dir), purchases)
    return scored.drop(*signal_ops.TOLD).withColumn("event_id", F.lower(F.hex("event_id")))


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signal_ops.with_told(stage(spark, sf_dir, "signals", build_signals))


_ranked: dict[tuple[str, int, str], DataFrame] = {}


def ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranked rows, written once, in their order. Ranks are made from places and counts as the rows are read, so they need no
    second table. Columns get new identities, as those of a table read anew."""
    key = (spark.sparkContext.applicationId, id(spark), sf_dir)
    if key not in _ranked:
        _ranked[key] = ranking_ops.rank_discoveries(signals(spark, sf_dir), digits=("stable_key", "event_id"))
    return _ranked[key].select(*[F.col(c).alias(c) for c in _ranked[key].columns])
