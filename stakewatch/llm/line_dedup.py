"""Operator 1: cross-site boilerplate lines by the spread of their sites.

Every line of at least ``MIN_WORDS`` words gets a 96-bit hash. One aggregation by hash merges a HyperLogLog sketch of the
sites, so its memory does not grow with the sites of a line, and keeps the first place (document, line) where it occurs.
Lines whose estimate is clear of the threshold by ``MARGIN`` are decided by it; for those near it, and only those, distinct
sites are counted exactly. A line that spreads over at least ``MIN_SITES`` sites stays at its first place and is removed
everywhere else, so that a text copied to many sites survives once.

All of it is built-in functions. Lines travel as hashes; texts are read again and joined with the places to remove by
document only.

Defined results: a null text stays null and has no lines; an empty text is one line without words; lines are compared
without ASCII white space at their ends; rows of the same ``doc_id`` are one document with the same text; rows without a
site count for no site; rows without an id lose no lines; a document may lose all its lines and then has an empty text; very long texts are read whole;
ties go to the smaller id, then the earlier line; an empty table gives an empty one; other columns stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stakewatch.llm.common import table, written

MIN_SITES = 12
MIN_WORDS = 3
#: Log2 of the sketch's registers, and how far an estimate must be from the threshold to decide: over five times the
#: sketch's relative error of 1.04 / sqrt(2^10), and two sites more for small counts.
SKETCH_BITS = 10
MARGIN = 0.2
#: Shares that the rows of one line are dealt into when they meet its first place.
SALTS = 32
WHITE = " \t\n\x0b\x0c\r"


def trimmed(line: Column) -> Column:
    return F.trim(line, F.lit(WHITE))


def line_rows(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``site``, ``at`` (line number) and the line's two hashes, for lines with enough words."""
    lines = F.transform(F.split("text", "\n"), trimmed)
    rows = docs.select("doc_id", "site", F.posexplode(lines).alias("at", "line"))
    rows = rows.where(F.size(F.split("line", "[ \t\x0b\x0c\r]+")) >= MIN_WORDS)
    return rows.select("doc_id", "site", "at", F.xxhash64("line").alias("h"), F.crc32(F.col("line").cast("binary")).alias("c"))


def boilerplate(rows: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """Hashes of the lines that are on at least ``min_sites`` sites, with their first place."""
    site = F.xxhash64("site")
    sketched = rows.groupBy("h", "c").agg(
        F.count("*").alias("n"), F.hll_sketch_agg(F.when(F.col("site").isNotNull(), site), F.lit(SKETCH_BITS)).alias("sketch"), F.min(F.struct("doc_id", "at")).alias("first")
    )
    estimated = sketched.where(F.col("n") >= min_sites).select("h", "c", "first", F.hll_sketch_estimate("sketch").alias("sites"))
    low, high = min_sites * (1 - MARGIN) - 2, min_sites * (1 + MARGIN) + 2
    estimated = written(estimated.where(F.col("sites") >= low), "spread")
    near = estimated.where(F.col("sites") <= high).select("h", "c")
    exact = rows.join(near, ["h", "c"], "left_semi").where(F.col("site").isNotNull()).select("h", "c", "site").distinct()
    exact = exact.groupBy("h", "c").agg(F.count("*").alias("exact")).where(F.col("exact") >= min_sites).select("h", "c", F.lit(True).alias("enough"))
    decided = estimated.join(exact, ["h", "c"], "left").where((F.col("sites") > high) | F.col("enough"))
    return decided.select("h", "c", "first")


def removals(rows: DataFrame, spread: DataFrame) -> DataFrame:
    """``doc_id`` and the numbers of its lines that go; at most as many as the document has lines."""
    # A line may be a third of all rows. It meets copies of its first place, dealt by document; a line that spreads has
    # at least as many rows as sites, so the copies are few against the rows.
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int").alias("salt")
    copies = spread.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    found = rows.select("doc_id", "at", "h", "c", salt).join(copies, ["h", "c", "salt"])
    found = found.where(~(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("at") == F.col("first.at"))))
    return found.groupBy("doc_id").agg(F.collect_set("at").alias("removed"))


def deduplicated(docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """For every row of ``docs``: ``row`` (all its columns, as they were), the new ``text``, and ``lines`` and ``removed``, the numbers of
    lines before and taken away. As the input is one column, no name of its own can clash with those made here."""
    narrow = docs.select("doc_id", "text", F.col(site).alias("site"))
    rows = written(line_rows(narrow), "line-hashes")
    gone = removals(rows, boilerplate(rows, min_sites)).select(F.col("doc_id").alias("key"), F.col("removed").alias("gone"))
    whole = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    joined = whole.join(gone, F.col("row.doc_id") == F.col("key"), "left")
    before = F.col("row.text")
    lines = F.split(before, "\n")
    places = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("gone"))
    # Bound to a variable, the lines are split once and not again for each place.
    kept = F.get(F.transform(F.array(lines), lambda split: F.array_join(F.transform(places, lambda i: F.get(split, i)), "\n")), F.lit(0))
    text = F.when(F.col("gone").isNull() | before.isNull(), before).otherwise(kept)
    return joined.select("row", text.alias("text"), F.coalesce(F.size(lines), F.lit(0)).cast("long").alias("lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("removed"))


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    out = deduplicated(docs)
    return out.select("row.doc_id", F.when(F.col("text").isNull(), 0).otherwise(F.col("lines")).alias("n_lines"), F.col("removed").alias("n_removed"), "text")


ORACLE_SQL = f"""
WITH l AS (SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS raw, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents),
k AS (SELECT *, trim(raw, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS line FROM l),
b AS (SELECT line, arg_min(doc_id, (doc_id, pos)) AS first_doc, arg_min(pos, (doc_id, pos)) AS first_pos FROM k
  WHERE len(regexp_split_to_array(line, '[ \\t\\x0B\\x0C\\r]+')) >= {MIN_WORDS} GROUP BY line HAVING count(DISTINCT source) >= {MIN_SITES}),
m AS (SELECT k.*, b.line IS NOT NULL AND NOT (doc_id = first_doc AND pos = first_pos) AS gone FROM k LEFT JOIN b ON k.line = b.line),
o AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(raw, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS text FROM m GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, o.text AS text FROM documents d LEFT JOIN o ON d.doc_id = o.doc_id
"""
