"""Hashed ids, hashed unit positions, lineage, schema versions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def stable_id(*parts: Column) -> Column:
    """First 24 hex digits of the SHA-256 of the parts as a JSON array of texts."""
    texts = [F.coalesce(part.cast("string"), F.lit("None")) for part in parts]
    return F.substring(F.sha2(F.to_json(F.array(*texts)), 256), 1, 24)


def unit_hash(value: Column, salt: str) -> Column:
    """Deterministic position in [0, 1] from a text."""
    digest = F.sha2(F.concat(F.lit(f"{salt}:"), value), 256)
    whole = F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)").cast("double")
    return whole / F.lit(float(2**64 - 1))


def lineage(source_type: str, path: Column, accession: Column) -> Column:
    return F.struct(
        F.lit("v1").alias("parser_version"),
        accession.alias("source_identifier"),
        path.alias("source_path"),
        F.lit("").alias("source_sha256"),
        F.lit(source_type).alias("source_type"),
    )


VERSION_PATTERN = r"^v(0|[1-9][0-9]*)(?:\.(0|[1-9][0-9]*))?$"


def version_part(col: Column, part: int) -> Column:
    """Major (1) or minor (2) number of ``vMAJOR[.MINOR]``; null when the text is no version."""
    text = F.trim(col)
    number = F.coalesce(F.nullif(F.regexp_extract(text, VERSION_PATTERN, part), F.lit("")), F.lit("0"))
    return F.when(text.rlike(VERSION_PATTERN), number.cast("int"))


def version_readable(reader: Column, writer: Column) -> Column:
    """Same major, and the reader's minor is at least the writer's."""
    return (version_part(reader, 1) == version_part(writer, 1)) & (version_part(reader, 2) >= version_part(writer, 2))
