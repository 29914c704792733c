"""Page files and their manifest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T


def strict(df: DataFrame) -> DataFrame:
    """NaN and infinities become null in all floating columns, so the JSON stays standard."""
    fixes = {}
    for field in df.schema.fields:
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            c = F.col(field.name)
            fixes[field.name] = F.when(F.isnan(c) | (F.abs(c) == float("inf")), F.lit(None)).otherwise(c)
    return df.withColumns(fixes) if fixes else df


def page_text(df: DataFrame, *keys: str) -> DataFrame:
    """Keys and the other columns as one JSON text; missing values are written as null."""
    clean = strict(df)
    rest = [c for c in clean.columns if c not in keys]
    return clean.select(*keys, F.to_json(F.struct(*rest), {"ignoreNullFields": "false"}).alias("payload"))


def write_pages(pages: DataFrame, path: str, key: str) -> None:
    """One folder per key value, written by the tasks that hold its rows."""
    pages.select(key, F.col("payload").alias("value")).write.mode("overwrite").partitionBy(key).text(path)


def manifest(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Path below the folder, SHA-256 and size of each written file."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    )
    return files.select(
        F.regexp_extract("path", r"([^/]+(?:/[^/]+)?)$", 1).alias("path"),
        F.sha2("content", 256).alias("sha256"),
        F.col("length").alias("bytes"),
    )
