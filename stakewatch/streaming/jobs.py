"""Structured Streaming jobs for the daily increments.

They end in the file sink, which commits each micro-batch once, or in an upsert that gives the same table however
often a batch is repeated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from stakewatch.operators.grouping import last_per_key
from stakewatch.operators.rankings import snapshot_keys
from stakewatch.operators.total_order import CODEC, written


def file_stream(spark: SparkSession, path: str, schema: object, pattern: str = "*", per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return reader.parquet(path)


def to_files(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Runs over everything there is now and stops."""
    return (
        stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).option("compression", CODEC)
        .trigger(availableNow=True).start()
    )


def new_filings(stream: DataFrame, event_time: str, delay: str = "7 days") -> DataFrame:
    """Filings once per accession number; repeats arriving within the delay are dropped, older state is let go."""
    timed = stream.withColumn("event_time", F.col(event_time).cast("timestamp"))
    return timed.withWatermark("event_time", delay).dropDuplicatesWithinWatermark(["accession_number"])


def current_prices(loads: DataFrame) -> DataFrame:
    """Table of all loads as seen by readers: the newest load of each ticker and date."""
    return last_per_key(loads, ["ticker", "date"], [F.col("load_no")])


def upsert_prices(stream: DataFrame, path: str, checkpoint: str, partition: str = "month") -> StreamingQuery:
    """Keeps the newest load of each ticker and date in a table partitioned by month, over everything there is now.

    A batch rewrites the months it brings something newer to, and no other. Rows that the table has already, in this load or a
    later one, are left out first, so a repeated batch writes nothing."""

    def merge(batch: DataFrame, batch_id: int) -> None:
        merge_prices_into(batch, path, partition)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def merge_prices_into(batch: DataFrame, path: str, partition: str = "month") -> None:
    spark, key = batch.sparkSession, ["ticker", "date"]
    dated = current_prices(batch).withColumn(partition, F.date_format("date", "yyyy-MM"))
    stored = stored_table(spark, path, dated)
    newest = stored.select(*key, F.col("load_no").alias("_stored"))
    fresh = dated.join(newest, key, "left").filter(F.coalesce(F.col("load_no") > F.col("_stored"), F.lit(True))).drop("_stored")
    fresh = written(fresh, "price-batch")
    months = fresh.select(partition).distinct()
    merged = current_prices(stored.join(months, partition, "left_semi").unionByName(fresh))
    merged.select(*dated.columns).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def stored_table(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """The table at a path, without rows where there is none yet."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there):
        return like.limit(0)
    return spark.read.schema(like.schema).parquet(path)


def new_rankings(stream: DataFrame, history: DataFrame, event_time: str, delay: str = "30 days", shown: list[str] | None = None) -> DataFrame:
    """Ranking rows not in the history yet: an anti join with the stored table, then once per snapshot key. Only the ``shown`` columns
    are sent with the keys, all where none are named.

    Keys of snapshots that arrive within the delay are kept as state; older ones are in the stored history and are let go, so
    the state holds as many rows as the delay has, however long the history grows."""
    keyed = snapshot_keys(stream).withColumn("event_time", F.col(event_time).cast("timestamp"))
    keyed = keyed if shown is None else keyed.select("snapshot_key", *shown, "event_time")
    fresh = keyed.join(history.select("snapshot_key"), "snapshot_key", "left_anti")
    return fresh.withWatermark("event_time", delay).dropDuplicatesWithinWatermark(["snapshot_key"]).drop("event_time")


def daily_activity(stream: DataFrame, event_time: str, buyer: str, value: str, delay: str = "2 days") -> DataFrame:
    """Closed days with their purchases, value, largest purchase and distinct buyers.

    First per day and buyer, then per day: state is one small row per buyer and day, spread over all tasks, instead of
    a growing set of buyers in one row.
    """
    timed = stream.withColumn("event_time", F.col(event_time).cast("timestamp")).withWatermark("event_time", delay)
    per_buyer = timed.groupBy(F.window("event_time", "1 day"), buyer).agg(
        F.count(F.lit(1)).alias("n"), F.sum(value).alias("v"), F.max(value).alias("m")
    )
    return (
        per_buyer.groupBy(F.window(F.window_time("window"), "1 day").alias("day"))
        .agg(
            F.sum("n").alias("event_count"), F.count(F.lit(1)).alias("buyer_count"),
            F.round(F.sum("v"), 2).alias("purchase_value"), F.max("m").alias("largest_purchase"),
        )
        .select(F.to_date("day.start").alias("date"), "event_count", "buyer_count", "purchase_value", "largest_purchase")
    )
