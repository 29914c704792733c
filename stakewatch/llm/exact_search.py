"""Operator 13: exact top-k by inner product over a bit-sliced index.

1. **Index.** In each block of rows every attribute (component) is quantised to its ``SLICES`` most significant bits and cut
   into bit slices: one bitmap over the block's rows for each bit of each attribute. The exact values are kept beside it.
2. **Score slices.** A query's coefficients are quantised as well and written with digits -1, 0, 1. Each digit adds the
   attribute's slices, shifted, or their complements for -1; all of these bitmaps are added by full adders (three bitmaps of a
   weight become a sum and a carry), which leaves the score of all rows as bit slices.
3. **Top rows.** From the most significant slice downward, the rows still tied with the k-th best are narrowed until k are
   found; their exact scores give a lower bound. What quantisation can change is bounded by norms (Cauchy-Schwarz),
   so one comparison of the score slices with a constant, again from the top slice downward, leaves the boundary rows: all that
   could still be among the best. Those are resolved by exact inner products.

Later blocks of a part start from the bound that the earlier ones reached. The best of all parts are merged by a window.

Components count as floor(256 * x). Defined results: rows with a null id, a null vector, or a null or non-finite component
take no part; a shorter vector counts as if it ended in zeros, an empty one scores 0 with all; ties go to the smaller id; every
row of an id that repeats is a candidate for the others, and none for a query of that id; a query id with several
different vectors gets a list for each; fewer candidates give shorter lists, an empty table an empty one; scores that do not
fit a long are ranked exactly and given as the nearest long; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stakewatch.llm.common import table, written
from stakewatch.llm.vector_blocks import as_longs, best_first, beyond, blocks, groups, meet, pair_scores, participants

TOP = 5
QUERY_STEP = 50
#: Bits kept of an attribute and of a query's coefficient.
SLICES = 7
QUERY_BITS = 6
#: Words of each bitmap that are added at a time, so that they stay in a core's cache.
SPAN_WORDS = 1 << 8


def bitmap(marks: np.ndarray) -> np.ndarray:
    """Marks over rows (last axis) as words of 64."""
    rows = marks.shape[-1]
    padded = np.zeros((*marks.shape[:-1], -(-max(rows, 1) // 64) * 64), np.uint8)
    padded[..., :rows] = marks
    return np.packbits(padded, axis=-1, bitorder="little").view(np.uint64)


def marked(words: np.ndarray) -> np.ndarray:
    """Rows of a bitmap."""
    return np.flatnonzero(np.unpackbits(words.view(np.uint8), bitorder="little"))


def population(words: np.ndarray) -> int:
    return int(np.bitwise_count(words).sum())


def bit_sliced(values: np.ndarray) -> dict[str, np.ndarray]:
    """Slices [attribute, bit, word] of the quantised values, the bits dropped (``shift``), and the norms of what
    the slices say (``kept``) and of what they leave out, seen from its middle (``left``)."""
    width = int(np.abs(values).max(initial=0)).bit_length() + 1
    shift = max(0, width - SLICES)
    coarse = np.floor(np.ldexp(values, -shift))
    middle = (2.0**shift - 1) / 2
    left = values - np.ldexp(coarse, shift) - middle
    digits = (coarse + 2 ** (SLICES - 1)).astype(np.uint8).T
    slices = np.stack([bitmap((digits >> bit) & 1) for bit in range(SLICES)], axis=1) if values.shape[1] else np.zeros((0, SLICES, -(-max(len(values), 1) // 64)), np.uint64)
    norms = lambda x: float(np.sqrt((x * x).sum(axis=1).max(initial=0)))
    return {"slices": slices, "shift": np.array(shift), "kept": np.array(norms(np.ldexp(coarse, shift))), "left": np.array(norms(left)), "middle": np.array(middle)}


def signed_digits(number: int) -> list[tuple[int, int]]:
    """(weight, sign) of the digits of a number when no two neighbours are both set."""
    out, weight, rest = [], 0, abs(number)
    while rest:
        if rest & 1:
            digit = 2 - (rest & 3)
            rest -= digit
            out.append((weight, digit if number > 0 else -digit))
        rest >>= 1
        weight += 1
    return out


def added(columns: dict[int, list[np.ndarray]], words: int) -> list[np.ndarray]:
    """Bit slices of the sum, least first, of bitmaps that each count 2^weight (stacks [bitmap, word] by weight)."""
    out, weight = [], 0
    while any(at >= weight and found for at, found in columns.items()):
        found = columns.get(weight, [])
        here = np.concatenate(found) if found else np.zeros((0, words), np.uint64)
        above = columns.setdefault(weight + 1, [])
        while len(here) > 2:
            third = len(here) // 3
            a, b, c = here[:third], here[third : 2 * third], here[2 * third : 3 * third]
            either = a ^ b
            above.append((a & b) | (either & c))
            here = np.concatenate([either ^ c, here[3 * third :]])
        if len(here) == 2:
            above.append(here[:1] & here[1:])
            here = here[:1] ^ here[1:]
        out.append(here[0] if len(here) else np.zeros(words, np.uint64))
        weight += 1
    return out


def score_slices(slices: np.ndarray, coefficients: list[int]) -> tuple[list[np.ndarray], int]:
    """Slices of sum(c * u) + constant over the rows, u being the unsigned quantised attributes, and the constant."""
    digits: dict[tuple[int, int], list[int]] = {}
    for attribute, coefficient in enumerate(coefficients):
        for digit in signed_digits(coefficient):
            digits.setdefault(digit, []).append(attribute)
    # -u is ~u less the highest value, so that everything added is positive.
    constant = sum((2**SLICES - 1 << weight) * len(found) for (weight, sign), found in digits.items() if sign < 0)
    spans = []
    for start in range(0, slices.shape[-1], SPAN_WORDS):
        columns: dict[int, list[np.ndarray]] = {}
        for (weight, sign), found in digits.items():
            terms = slices[found, :, start : start + SPAN_WORDS]
            terms = terms if sign > 0 else ~terms
            for bit in range(SLICES):
                columns.setdefault(weight + bit, []).append(terms[:, bit])
        spans.append(added(columns, min(SPAN_WORDS, slices.shape[-1] - start)))
    return [np.concatenate(parts) for parts in zip(*spans, strict=True)], constant


def top_rows(score: list[np.ndarray], rows: np.ndarray, most: int) -> np.ndarray:
    """``most`` rows (or all, if fewer) of the bitmap ``rows`` with the highest scores, any of those tied at the end."""
    sure, tied, wanted = np.zeros_like(rows), rows, most
    if population(rows) <= most:
        return marked(rows)
    for bitmap_ in reversed(score):
        higher = tied & bitmap_
        count = population(higher)
        if count >= wanted:
            tied = higher
        else:
            sure, wanted, tied = sure | higher, wanted - count, tied & ~bitmap_
    return np.concatenate([marked(sure), marked(tied)[:wanted]])


def at_least(score: list[np.ndarray], rows: np.ndarray, bound: int) -> np.ndarray:
    """Bitmap of the ``rows`` whose score is at least ``bound``."""
    if bound <= 0:
        return rows
    if bound >> len(score):
        return np.zeros_like(rows)
    above, tied = np.zeros_like(rows), rows
    for weight in range(len(score) - 1, -1, -1):
        if bound >> weight & 1:
            tied = tied & score[weight]
        else:
            above |= tied & score[weight]
            tied = tied & ~score[weight]
    return above | tied


def searched(block: dict[str, np.ndarray], query: np.ndarray, query_id: int, most: int, floor: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the block that can be among the ``most`` best, and their exact scores. ``floor`` is a score that at least
    ``most`` rows are known to reach, if there is one."""
    slices, values = block["slices"], block["values"]
    width = slices.shape[0]
    aligned = np.zeros(width)
    aligned[: min(width, len(query))] = query[:width]
    rows = np.ones(len(values), bool)
    rows[np.searchsorted(block["ids"], query_id) : np.searchsorted(block["ids"], query_id, "right")] = False
    rows = bitmap(rows)
    exact = lambda at: pair_scores(np.broadcast_to(aligned, (len(at), width)), values[at].astype(np.float64))

    drop = max(0, int(np.abs(aligned).max(initial=0)).bit_length() + 1 - QUERY_BITS)
    coefficients = np.rint(np.ldexp(aligned, -drop))
    score, constant = score_slices(slices, [int(c) for c in coefficients.tolist()])
    first = top_rows(score, rows, most)
    scores = exact(first)
    if len(first) == most:
        floor = max(int(scores.min()), floor) if floor is not None else int(scores.min())
    if floor is None:
        return first, scores
    # score = 2^(shift + drop) * (A - constant - offset) + middle * sum(query), give or take the error
    shift, middle = int(block["shift"]), float(block["middle"])
    offset = 2 ** (SLICES - 1) * int(coefficients.sum())
    norm = lambda x: float(np.sqrt((x * x).sum()))
    error = (norm(aligned - np.ldexp(coefficients, drop)) * float(block["kept"]) + norm(aligned) * float(block["left"])) * (1 + 1e-9) + 1
    least = float(floor) - middle * float(aligned.sum()) - error
    least = np.floor((least - abs(least) * 1e-9) / 2.0 ** (shift + drop))
    boundary = marked(at_least(score, rows, int(least) + constant + offset) if np.isfinite(least) else rows)
    boundary = np.setdiff1d(boundary, first)
    more = exact(boundary)
    keep = more >= floor
    return np.concatenate([first, boundary[keep]]), np.concatenate([scores, more[keep]])


def answer(most: int):
    schema = ["query_id", "query_no", "vec_id", "score", "high"]

    def run(held: list[dict[str, np.ndarray]], asked: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        outs: list[tuple] = []
        for vector, query_id, number in zip(asked["values"].astype(np.float64), asked["id"].tolist(), asked["number"].tolist(), strict=True):
            ids, scores, floor = np.zeros(0, np.int64), np.zeros(0, np.int64), None
            for block in held:
                at, found = searched(block, vector, query_id, most, floor)
                ids, scores = np.concatenate([ids, block["ids"][at]]), np.concatenate([scores, found])
                best = best_first(np.zeros(len(ids), np.int64), scores, ids, most)
                ids, scores = ids[best], scores[best]
                if len(ids) == most:
                    floor = int(scores[-1])
            outs.append((np.full(len(ids), query_id), np.full(len(ids), number), ids, scores))
        if outs:
            query, number, ids, scores = (np.concatenate([x[k] for x in outs]) for k in range(4))
            yield pa.RecordBatch.from_arrays([pa.array(query), pa.array(number), pa.array(ids), pa.array(as_longs(scores)), pa.array(beyond(scores), pa.string())], schema)

    return run


def top_k(frame: DataFrame, queries: DataFrame, most: int = TOP) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id`` and ``score`` of the best rows of ``frame`` for each row of ``queries``; both have
    ``vec_id`` and ``embedding``."""
    index, parts = blocks(participants(frame), bit_sliced, "bit-slices")
    asked = participants(queries).distinct()
    asked = written(asked.withColumn("number", F.row_number().over(Window.partitionBy("id").orderBy("vector"))).withColumn("number", F.col("number").cast("long")), "queries")
    found = meet(index, parts, groups(asked, ("id", "number"), "query-groups"), answer(most), "query_id long, query_no long, vec_id long, score long, high string", "found")
    best = Window.partitionBy("query_id", "query_no").orderBy(F.col("score").desc(), F.col("high").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best))
    return ranked.where(F.col("rank") <= most).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op13_exact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return top_k(vectors, vectors.where(F.col("vec_id") % QUERY_STEP == 0))


ORACLE_SQL = f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.x, c.x)::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % {QUERY_STEP} = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= {TOP}
"""
