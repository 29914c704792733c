"""Building blocks that stay balanced when one key holds a large part of all rows.

None of them brings a whole group into one task: they combine before the shuffle, work on counts per distinct
value, or split a group along its own order.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from stakewatch.operators.total_order import numbered, value_positions

COPY_CHUNK = 1_000_000
COUNT_BUCKETS = 1 << 14


def may_exceed(df: DataFrame, keys: list[Column], limit: int, buckets: int = COUNT_BUCKETS) -> bool:
    """Whether any key may have more rows than ``limit``. Keys are counted by buckets of their hash, so none is missed, and
    a task gives a few counts, however many keys it reads."""
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).alias("_bucket")
    return not df.groupBy(bucket).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > limit).isEmpty()


def spread_out(df: DataFrame, items: str, name: str) -> DataFrame:
    """One row per entry of the list ``items``, as ``explode``. The entries' filter stays behind the list: before it, Spark would make
    the list twice over, with all that it was read from."""
    return df.select("*", F.posexplode_outer(items).alias("_place", name)).filter("_place is not null").drop("_place")


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The row of each key that comes first in the order. An aggregate, so it combines before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    row = F.min_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(row).select(*keys, "_row.*")


def last_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    row = F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(row).select(*keys, "_row.*")


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], k: int, position: str = "position") -> DataFrame:
    """First k rows of each key, numbered. Spark limits each input partition to k rows before the shuffle."""
    ranked = df.withColumn(position, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter(F.col(position) <= k)


def mark_copies(df: DataFrame, keys: list[str], order: list[str], flag: str = "is_copy") -> DataFrame:
    """Flags every row of a key but the first.

    Fully equal rows are counted first, the first row of each key is an aggregate, and the counted rows are
    spread out again in chunks, so a row repeated billions of times is never one group in one task.
    """
    columns = df.columns
    counted = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("_copies"))
    rest = [c for c in columns if c not in order]
    place = F.struct(*order, *rest)
    firsts = counted.groupBy(*[F.col(k).alias(f"_k_{k}") for k in keys]).agg(F.min(place).alias("_first"))
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys])
    joined = counted.join(firsts, on).withColumn("_is_first", place.eqNullSafe(F.col("_first")))
    chunks = F.floor((F.col("_copies") - 1) / float(COPY_CHUNK))
    spread = joined.select(*columns, "_copies", "_is_first", F.explode(F.sequence(F.lit(0), chunks)).alias("_chunk"))
    low = F.col("_chunk") * COPY_CHUNK
    high = F.least(low + COPY_CHUNK, F.col("_copies")) - 1
    return spread.select(*columns, "_is_first", F.explode(F.sequence(low, high)).alias("_copy")).select(
        *columns, (~(F.col("_is_first") & (F.col("_copy") == 0))).alias(flag)
    )


def with_positions_of(rows: DataFrame, positions: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Rows with the figures of their value; a missing value has its own."""
    names = {c: f"_of_{c}" for c in [*keys, *values]}
    on = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(n)) for c, n in names.items()])
    return rows.join(positions.withColumnsRenamed(names), on).drop(*names.values())


def exact_median(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Exact median per key for values of any number; nulls are left out."""
    positions = value_positions(df.filter(F.col(value).isNotNull()).select(*keys, value), keys, [value])
    low = F.floor((F.col("n_total") - 1) / 2.0)
    high = F.floor(F.col("n_total") / 2.0)

    def at(index: Column) -> Column:
        hit = (F.col("n_below") <= index) & (index < F.col("n_below") + F.col("n_equal"))
        return F.max(F.when(hit, F.col(value)))

    return positions.groupBy(*keys).agg(((at(low) + at(high)) / 2).alias(name))


def rank_rows(df: DataFrame, keys: list[str], scores: list[Column], ties: list[Column], name: str = "rank") -> DataFrame:
    """Positions 1..n per key: by the scores, highest first and missing ones last, then by the tie columns."""
    return numbered(df, keys, [*[score.desc_nulls_last() for score in scores], *ties], name)
