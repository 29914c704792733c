"""Streaming jobs run to the end of their input, then read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from stakewatch.operators import rankings
from stakewatch.operators.total_order import CODEC
from stakewatch.plans import tables
from stakewatch.plans.normal import PRICE_MERGE_SQL, _loads, scratch
from stakewatch.plans.oracle import sid
from stakewatch.plans.registry import query
from stakewatch.functions.numeric import round_to
from stakewatch.streaming import jobs


def finish(stream, spark, name: str):
    """Runs the stream over its present input and reads the written table."""
    path = scratch(spark, name)
    schema = stream.schema
    jobs.to_files(stream, path, scratch(spark, f"{name}-checkpoint")).awaitTermination()
    return spark.read.schema(schema).parquet(path)


@query("st1_new_filings", "SELECT DISTINCT lpad(CAST(l_orderkey AS VARCHAR),10,'0') AS accession_number FROM lineitem")
def st1(spark, sf_dir):
    schema = tables.raw(spark, sf_dir, "lineitem").schema
    stream = jobs.file_stream(spark, sf_dir, schema, "lineitem.parquet").withColumn("accession_number", tables.padded("l_orderkey"))
    return finish(jobs.new_filings(stream, "l_shipdate").select("accession_number"), spark, "filings")


@query("st2_price_loads", PRICE_MERGE_SQL, ("prices",))
def st2(spark, sf_dir):
    stored, fresh = _loads(spark, sf_dir)
    inbox = scratch(spark, "price-loads")
    stored.write.mode("append").parquet(inbox)
    fresh.write.mode("append").parquet(inbox)
    stream = jobs.file_stream(spark, inbox, stored.schema, per_trigger=2)
    path = scratch(spark, "price-table")
    jobs.upsert_prices(stream, path, scratch(spark, "price-table-checkpoint")).awaitTermination()
    return spark.read.parquet(path).select("ticker", "date", round_to(F.col("close"), 6).alias("close"), "load_no")


@query(
    "st3_ranking_history",
    f"SELECT {sid('stable_key', 'ranking_score', 'rank')} AS snapshot_key, ranking_category, rank FROM ranked WHERE rank>50",
    ("ranked",),
)
def st3(spark, sf_dir):
    latest = tables.ranked(spark, sf_dir).select("ranking_category", "rank", "stable_key", "ranking_score").withColumn("as_of", F.to_date(F.lit("1999-01-01")))
    inbox = scratch(spark, "rankings")
    # the same ranking delivered twice
    latest.write.mode("append").option("compression", CODEC).parquet(inbox)
    latest.write.mode("append").option("compression", CODEC).parquet(inbox)
    history = rankings.snapshot_keys(latest.filter("rank <= 50"))
    stream = jobs.file_stream(spark, inbox, latest.schema)
    return finish(jobs.new_rankings(stream, history, "as_of", shown=["ranking_category", "rank"]), spark, "ranking-history").select("snapshot_key", "ranking_category", "rank")


@query(
    "st4_daily_activity",
    """SELECT date, event_count, buyer_count, purchase_value, largest_purchase FROM (SELECT CAST(ts AS DATE) AS date, count(*) AS event_count, count(DISTINCT user_id) AS buyer_count,
     round(sum(value),2) AS purchase_value, max(value) AS largest_purchase FROM events GROUP BY 1), (SELECT max(ts) AS newest FROM events) WHERE date+1<=newest-INTERVAL 2 DAYS""",
)
def st4(spark, sf_dir):
    schema = tables.raw(spark, sf_dir, "events").schema
    stream = jobs.file_stream(spark, sf_dir, schema, "events.parquet")
    return finish(jobs.daily_activity(stream, "ts", "user_id", "value"), spark, "daily-activity")
