"""A total order over the rows of each key, though one key, or rows that tie in every score, may be most of the table.

Rows are range-partitioned by (key, scores, ties) and sorted inside their range. Cuts fall between full orders, so equal scores
are cut by what follows them. The sorted rows are written with a running number, counted per key and range, and
the counts' running sums shift the numbers; no window ever runs over a key or a tie group. The counts are one row per key and
range, written as well, so that Spark knows their size and broadcasts them where they are small.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from stakewatch.session import for_writing, shared_folder

#: Bits of a running number that count inside its partition (fixed by ``monotonically_increasing_id``).
INSIDE_BITS = 33

#: Codec of tables written between steps: ids are digits of a hash, which the usual one leaves at full length.
CODEC = "zstd"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder, gone with the session."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/stakewatch/order/{name}-{uuid.uuid4().hex}"
    with for_writing(spark):
        df.write.option("compression", CODEC).parquet(path)
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    return spark.read.schema(df.schema).parquet(path)


def laid_out(df: DataFrame, keys: list[str], order: list[Column], name: str) -> DataFrame:
    """The rows in ranges of the total order: ``_range`` and ``_at``, the place inside it."""
    line = [*[F.asc_nulls_first(k) for k in keys], *order]
    numbered = df.repartitionByRange(*line).sortWithinPartitions(*line).withColumn("_number", F.monotonically_increasing_id())
    at = F.col("_number").bitwiseAND((1 << INSIDE_BITS) - 1)
    return written(numbered, name).withColumns({"_range": F.shiftright("_number", INSIDE_BITS), "_at": at}).drop("_number")


def same(left: DataFrame, right: DataFrame, columns: dict[str, str]) -> Column:
    return reduce(lambda a, b: a & b, [left[a].eqNullSafe(right[b]) for a, b in columns.items()])


def shifted(rows: DataFrame, keys: list[str], weight: Column, name: str) -> DataFrame:
    """Adds ``_before`` (weight of the key's rows in earlier ranges), ``_total`` (of the key) and ``_first`` (the key's first place in this range)."""
    line = Window.partitionBy(*keys).orderBy("_range")
    sums = rows.groupBy(*keys, "_range").agg(F.sum(weight).alias("_sum"), F.min("_at").alias("_first"))
    names = {k: f"_of_{k}" for k in [*keys, "_range"]}
    sums = sums.select(
        *[F.col(k).alias(n) for k, n in names.items()], "_first", (F.sum("_sum").over(line) - F.col("_sum")).alias("_before"), F.sum("_sum").over(Window.partitionBy(*keys)).alias("_total")
    )
    # One row per key and range already; taken once more so that only the rows' own files show as where a row comes from.
    sums = written(sums, f"{name}-sums").groupBy(*names.values()).agg(*[F.max(c).alias(c) for c in ("_first", "_before", "_total")])
    return rows.join(sums, same(rows, sums, names)).drop(*names.values())


def numbered(df: DataFrame, keys: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    """Positions 1..n per key in the given order, which should end in columns that differ from row to row."""
    rows = shifted(laid_out(df, keys, order, name), keys, F.lit(1), name)
    place = F.col("_before") + F.col("_at") - F.col("_first") + 1
    return rows.select(*df.columns, place.cast("int").alias(name))


def value_positions(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Per key and distinct combination of values (missing ones last): rows equal to it, rows below it, rows in all."""
    counts = df.groupBy(*keys, *values).agg(F.count(F.lit(1)).alias("n_equal"))
    rows = laid_out(counts, keys, [F.asc_nulls_last(v) for v in values], "values")
    rows = shifted(rows, keys, F.col("n_equal"), "values")
    inside = Window.partitionBy(*keys, "_range").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    below = F.col("_before") + F.coalesce(F.sum("n_equal").over(inside), F.lit(0))
    return rows.select(*keys, *values, "n_equal", below.alias("n_below"), F.col("_total").alias("n_total"))


def column_positions(df: DataFrame, columns: dict[str, Column]) -> dict[str, DataFrame]:
    """``value_positions`` of several numeric columns over all rows, from one pass: per name a table of ``_value`` and its figures."""
    entries = F.array(*[F.struct(F.lit(name).alias("_column"), value.cast("double").alias("_value")) for name, value in columns.items()])
    unpivoted = df.select(F.explode(entries).alias("_e")).select("_e.*")
    positions = written(value_positions(unpivoted, ["_column"], ["_value"]), "positions")
    return {name: positions.filter(F.col("_column") == name).drop("_column") for name in columns}
