"""Whole-number vectors in blocks, and a stated query set that meets all blocks.

A component x counts as floor(256 * x), a whole number. Rows are dealt over parts without regard to their values, so no
label, vector or id makes a part larger than another. A part is written as blocks of at most ``BLOCK_ROWS`` rows. Query groups
then go to every part; a task holds the blocks of one part and one query group at a time, so its memory is bounded
whatever the number of rows and queries.
"""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from stakewatch.llm.common import written

SCALE = 256
BLOCK_ROWS = 1 << 16
#: Most rows of a part, a few hundred megabytes of 64 components at most.
PART_ROWS = 1 << 19
GROUP_ROWS = 1 << 10
#: Above this many, sums of products are no longer exact in a double, and Python's whole numbers are used.
EXACT = 2.0**53
LONG = 2**63 - 1


@contextmanager
def one_row_batches(spark: SparkSession) -> Iterator[None]:
    """Rows go to Python one by one while tables of large cells are written; afterwards the session is as it was."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "1")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def finite(vector: Column) -> Column:
    """Holds for a vector all of whose components are there and have a finite ``SCALE``-fold, and for no null vector."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x * SCALE) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~bad, F.lit(False))


def participants(frame: DataFrame, *columns: Column) -> DataFrame:
    """``id`` and ``vector`` (doubles) of the rows that take part, and further columns."""
    vector = F.col("embedding").cast("array<double>")
    return frame.select(F.col("vec_id").cast("long").alias("id"), vector.alias("vector"), *columns).where(F.col("id").isNotNull() & finite(F.col("vector")))


def matrix(lists: pa.Array) -> np.ndarray:
    """Whole numbers (as doubles, which hold them exactly) by row; shorter rows end in zeros."""
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
    flat = np.floor(lists.flatten().to_numpy(zero_copy_only=False) * SCALE)
    out = np.zeros((len(lengths), int(lengths.max(initial=0))))
    out[np.arange(out.shape[1]) < lengths[:, None]] = flat
    return out


def stacked(parts: list[np.ndarray]) -> np.ndarray:
    width = max((x.shape[1] for x in parts), default=0)
    return np.concatenate([np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in parts]) if parts else np.zeros((0, width))


def same_width(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    width = max(left.shape[1], right.shape[1])
    return tuple(np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (left, right))


def fits(left: np.ndarray, right: np.ndarray) -> bool:
    """Whether every sum of products, and every part of one, is exact in a double."""
    return float(np.abs(left).max(initial=0)) * float(np.abs(right).max(initial=0)) * max(left.shape[1], 1) < EXACT


def whole(values: np.ndarray) -> np.ndarray:
    """Python's whole numbers of any size."""
    return np.array([[int(x) for x in row] for row in values.tolist()], object).reshape(values.shape)


def pair_scores(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Exact inner products row by row, as longs where they fit and as Python's whole numbers elsewhere."""
    left, right = same_width(left, right)
    if fits(left, right):
        return np.einsum("ij,ij->i", left, right).astype(np.int64)
    return (whole(left) * whole(right)).sum(axis=1) if left.shape[1] else np.zeros(len(left), np.int64)


def as_longs(scores: np.ndarray) -> np.ndarray:
    """Scores for output; what does not fit a long becomes the nearest one."""
    if scores.dtype != object:
        return scores.astype(np.int64)
    return np.array([max(-LONG - 1, min(LONG, int(x))) for x in scores.tolist()], np.int64)


def beyond(scores: np.ndarray) -> list[str | None]:
    """Texts that sort as the scores do, for scores at or past the ends of a long, null for all others."""
    if scores.dtype != object:
        return [None] * len(scores)

    def key(score: int) -> str | None:
        if -LONG - 1 < score < LONG:
            return None
        digits = str(abs(score))
        return f"1{len(digits):04d}{digits}" if score > 0 else "0" + f"{len(digits):04d}{digits}".translate(str.maketrans("0123456789", "9876543210"))

    return [key(int(score)) for score in scores.tolist()]


def best_first(groups: np.ndarray, scores: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
    """Places of the first ``most`` entries of every group, by falling score, then rising id; groups in ascending order."""
    if scores.dtype == object:
        order = np.array(sorted(range(len(scores)), key=lambda i: (groups[i], -scores[i], ids[i])), np.int64)
    else:
        order = np.lexsort((ids, -scores, groups))
    ordered = groups[order]
    new = np.ones(len(order), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    head = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    return order[np.arange(len(order)) - head < most]


def packed(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def unpacked(data: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(data)) as found:
        return dict(found)


def compact(values: np.ndarray) -> np.ndarray:
    """The same numbers in two bytes each, where they fit."""
    return values.astype(np.int16) if float(np.abs(values).max(initial=0)) < 2**15 else values


def parts_for(spark: SparkSession, rows: int) -> int:
    return max(spark.sparkContext.defaultParallelism, -(-rows // PART_ROWS))


def blocks(frame: DataFrame, index: Callable[[np.ndarray], dict[str, np.ndarray]], name: str, labelled: bool = False) -> tuple[DataFrame, int]:
    """A table of ``part``, ``seq`` and ``payload`` (ids, values, labels and what ``index`` makes of the values), and the
    number of parts. ``frame`` has ``id``, ``vector`` and, if ``labelled``, a long ``label``."""
    spark = frame.sparkSession
    count = parts_for(spark, frame.count())
    narrow = frame.select("id", "vector", *(["label"] if labelled else []))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, held, rows = TaskContext.get().partitionId(), 0, [], 0

        def block() -> pa.RecordBatch:
            arrays = {"ids": np.concatenate([x[0] for x in held]), "values": stacked([x[1] for x in held])}
            if labelled:
                arrays["labels"] = np.concatenate([x[2] for x in held])
            order = np.argsort(arrays["ids"], kind="stable")
            arrays = {k: v[order] for k, v in arrays.items()}
            arrays |= index(arrays["values"])
            arrays["values"] = compact(arrays["values"])
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([packed(**arrays)], pa.binary())], ["part", "seq", "payload"])

        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK_ROWS):
                piece = batch.slice(start, BLOCK_ROWS)
                if rows and rows + piece.num_rows > BLOCK_ROWS:
                    yield block()
                    seq, held, rows = seq + 1, [], 0
                held.append([piece.column(0).to_numpy(zero_copy_only=False), matrix(piece.column(1)), *(piece.column(k).to_numpy(zero_copy_only=False) for k in range(2, piece.num_columns))])
                rows += piece.num_rows
        if rows:
            yield block()

    return written(narrow.repartition(count).mapInArrow(build, "part int, seq int, payload binary"), name), count


def groups(queries: DataFrame, columns: tuple[str, ...], name: str) -> DataFrame:
    """A table of ``seq`` and ``payload`` with up to ``GROUP_ROWS`` queries each: ``vector`` and long (list) columns."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, GROUP_ROWS):
                piece = batch.slice(start, GROUP_ROWS)
                arrays = {"values": compact(matrix(piece.column("vector")))}
                for column in columns:
                    cell = piece.column(column)
                    arrays[column] = np.array(cell.to_pylist(), np.int64) if pa.types.is_list(cell.type) else cell.to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([pa.array([packed(**arrays)], pa.binary())], ["payload"])

    made = queries.select("vector", *columns).repartition(max(1, -(-queries.count() // GROUP_ROWS))).mapInArrow(build, "payload binary")
    return written(made, name)


def meet(found: DataFrame, parts: int, asked: DataFrame, answer: Callable[[list[dict], dict], Iterator[pa.RecordBatch]], schema: str | StructType, name: str) -> DataFrame:
    """``answer(blocks of a part, query group)`` for every part and group, written. Each part's blocks come first in their
    task, then one group after the other."""
    every = F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part")
    both = found.select("part", F.lit(0).alias("kind"), "seq", "payload").union(asked.select(every, F.lit(1), F.lit(0), "payload"))
    dealt = both.repartitionById(parts, F.col("part")).sortWithinPartitions("part", "kind", "seq")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = None, []
        for batch in batches:
            for row in range(batch.num_rows):
                if batch.column("part")[row].as_py() != part:
                    part, held = batch.column("part")[row].as_py(), []
                data = unpacked(batch.column("payload")[row].as_py())
                if batch.column("kind")[row].as_py() == 0:
                    held.append(data)
                elif held:
                    yield from answer(held, data)

    with one_row_batches(found.sparkSession):
        return written(dealt.mapInArrow(run, schema), name)
