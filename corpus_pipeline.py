"""A corpus from raw documents: language, boilerplate lines, near-duplicates, contamination, tokens.

Every stage takes (spark, docs, sf_dir) and keeps the columns of ``documents``, but the last, which gives ``doc_id``,
``ids``, ``n_tokens`` and ``decoded``. A stage works on all rows of the one before; what it decides takes effect.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stakewatch.llm import byte_bpe, decontaminate, language_id, line_dedup, near_dedup
from stakewatch.llm.common import table, written

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that are too far from every language, have no letter or no text."""
    return language_id.accepted(docs, language_id.fit(docs))


def without_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without lines that many sites share, but for their first place; documents that only had such lines go."""
    out = line_dedup.deduplicated(docs)
    left = (F.col("removed") == 0) | (F.length(line_dedup.trimmed(F.col("text"))) > 0)
    length = F.when(F.col("removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    new = {"text": F.col("text"), "n_chars": length}
    return out.where(left).select(*[new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicates the document with the smallest id."""
    copies = near_dedup.linked(docs).where(~F.col("kept")).select("doc_id")
    return docs.join(copies, "doc_id", "left_anti").select(*docs.columns)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold benchmark passages to a twentieth of their words or more."""
    found = decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark")).where("contaminated").select("doc_id")
    return docs.join(found, "doc_id", "left_anti").select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, and the text that they decode to."""
    coded = byte_bpe.decode(byte_bpe.encode(docs, RANKS), RANKS)
    return coded.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), F.col("decoded").cast("string").alias("decoded"))


STAGES = [
    ("language ID", known_language),
    ("line dedup", without_boilerplate),
    ("MinHash near-dedup", one_of_each_group),
    ("benchmark decontamination", uncontaminated),
    ("byte-level BPE", tokens),
]

#: The stages are not SQL; tests hold each against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is a table in the shared folder before the next stage reads it."""
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES, 1):
        docs = written(stage(spark, docs, sf_dir), f"stage{number}")
    return docs
