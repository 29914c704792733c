"""Reference files, delimited tables, and price loads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from stakewatch.functions.text import usable_text
from stakewatch.operators.grouping import last_per_key
from stakewatch.operators.prices import PRICE_COLUMNS


def reference_tickers(raw: DataFrame) -> DataFrame:
    """Ticker list as one JSON object of numbered entries (column ``value``) to one row per company number."""
    entries = raw.select(F.explode(F.map_values(F.from_json("value", "map<string,struct<cik_str:string,ticker:string,title:string>>"))).alias("e"))
    return entries.select(
        F.lpad("e.cik_str", 10, "0").alias("issuer_cik"),
        F.col("e.ticker").alias("reference_ticker"),
        F.col("e.title").alias("reference_title"),
    )


def read_reference_tickers(spark: SparkSession, path: str) -> DataFrame:
    return reference_tickers(spark.read.option("wholetext", "true").text(path))


METADATA_SCHEMA = "longName string, shortName string, marketCap double, sector string, industry string, exchange string, quoteType string"


def company_metadata(raw: DataFrame) -> DataFrame:
    """Metadata documents (ticker, value) with defaults for what is missing."""
    info = F.from_json("value", METADATA_SCHEMA)
    empty = F.lit("")
    return raw.withColumn("i", info).select(
        "ticker",
        F.coalesce(F.nullif("i.longName", empty), F.nullif("i.shortName", empty), empty).alias("company_name"),
        F.col("i.marketCap").alias("market_cap"),
        *[F.coalesce(f"i.{c}", empty).alias(name) for c, name in (("sector", "sector"), ("industry", "industry"), ("exchange", "exchange"), ("quoteType", "quote_type"))],
        F.when(F.coalesce("value", empty).isin("", "{}"), "limited").otherwise("high").alias("metadata_quality"),
    )


def write_csv(df: DataFrame, path: str) -> None:
    """Gzip text table with a heading; nulls are empty."""
    df.write.mode("overwrite").option("header", "true").option("compression", "gzip").csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The same with a declared schema, so padded numbers stay text."""
    return spark.read.schema(schema).option("header", "true").csv(path)


def normalize_download(raw: DataFrame, ticker: Column, source: str = "download") -> DataFrame:
    """Price download to the price table: snake-case names, missing columns added, date in UTC."""
    df = raw.withColumnsRenamed({c: c.strip().lower().replace(" ", "_") for c in raw.columns})
    for name in PRICE_COLUMNS:
        if name not in df.columns:
            df = df.withColumn(name, F.lit(0.0) if name in ("dividends", "stock_splits") else F.lit(None).cast("double"))
    day = "date" if "date" in df.columns else df.columns[0]
    return df.select(
        F.to_date(day).alias("date"), ticker.alias("ticker"), *[F.col(c).cast("double").alias(c) for c in PRICE_COLUMNS], F.lit(source).alias("source")
    )


def merge_prices(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Stored and freshly loaded sessions in one table; the higher ``load_no`` wins per ticker and date."""
    both = stored.unionByName(fresh, allowMissingColumns=True)
    return last_per_key(both, ["ticker", "date"], [F.col("load_no")])


def symbol_list(symbols: DataFrame, column: str) -> DataFrame:
    """Distinct non-empty symbols in order."""
    return symbols.select(usable_text(F.col(column)).alias(column)).filter(F.col(column) != "").distinct().orderBy(column)
