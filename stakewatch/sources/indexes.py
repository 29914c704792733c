"""Daily form indexes, archive pages and archive row counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from stakewatch.operators.grouping import first_per_key, last_per_key

ARCHIVE_LINK = r"""(?i)href=["']([^"']*/20\d{2}q[1-4]_form345\.zip)["']"""


def parse_index_lines(lines: DataFrame, default_date: Column | None = None) -> DataFrame:
    """Index lines (column ``value``) to filings of form 4 and 4/A.

    Data lines have five fields and a numeric first one, so the heading needs no line order, which splits would lose.
    """
    parts = F.transform(F.split("value", r"\|"), lambda p: F.trim(p))
    fields = lines.withColumn("_p", parts).filter(F.size("_p") == 5)
    p = F.col("_p")
    filed = F.nullif(p[3], F.lit(""))
    return fields.filter(p[0].rlike("^[0-9]+$") & p[2].isin("4", "4/A")).select(
        F.coalesce(filed, default_date if default_date is not None else F.lit("")).alias("filing_date"),
        F.lpad(p[0], 10, "0").alias("issuer_cik"),
        p[1].alias("company_name"),
        p[2].alias("form_type"),
        F.regexp_replace(F.regexp_extract(p[4], r"([^/]+)$", 1), r"\.[^.]*$", "").alias("accession_number"),
        p[4].alias("filing_path"),
    )


def read_index(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return parse_index_lines(spark.read.text(path))


def recent_filings(filings: DataFrame, as_of: Column, lookback_days: int) -> DataFrame:
    """Filings of the last weekdays, one per accession number (the newest index day wins, as it is read first)."""
    age = F.datediff(as_of, F.col("index_date"))
    weekday = F.weekday("index_date") < 5
    recent = filings.filter(weekday & (age >= 0) & (age < lookback_days))
    rest = [F.col(c) for c in filings.columns if c not in ("accession_number", "index_date")]
    return first_per_key(recent, ["accession_number"], [-F.unix_date("index_date"), *rest])


def archive_links(pages: DataFrame, base: str, start_year: int, pattern: str = ARCHIVE_LINK) -> DataFrame:
    """Links to quarterly archives in page texts: the last link of a quarter on a page wins."""
    links = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(pattern), F.lit(1))).alias("place", "href"))
    found = links.select(
        "page_id",
        "place",
        F.regexp_extract("href", r"(?i)(20\d{2})q([1-4])_", 1).cast("int").alias("year"),
        F.regexp_extract("href", r"(?i)(20\d{2})q([1-4])_", 2).cast("int").alias("quarter"),
        F.when(F.col("href").startswith("http"), F.col("href")).otherwise(F.concat(F.lit(base), F.col("href"))).alias("url"),
    ).filter(F.col("year") >= start_year)
    return last_per_key(found, ["page_id", "year", "quarter"], [F.col("place")]).drop("place")


def archive_row_counts(spark: SparkSession, path: str) -> DataFrame:
    """Data rows per text file of an extracted archive: its lines less the heading, never below zero."""
    lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").text(path)
    return lines.groupBy(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_path").alias("path")).agg(
        F.greatest(F.count(F.lit(1)) - 1, F.lit(0)).alias("rows")
    )
