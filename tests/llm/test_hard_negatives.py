"""Operator 11 against brute force."""

import math
import random

import numpy as np
import pytest

from stakewatch.llm import hard_negatives as op
from stakewatch.llm import vector_blocks
from stakewatch.llm.hard_negatives import Block, hard_negatives, joined, op11_hard_negatives

SCHEMA = "vec_id long, embedding array<float>, label int, score long, part string, id string"
LONG = 2**63


def brute_force(rows, step):
    usable = []
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        usable.append((i, tuple(math.floor(256 * x) for x in v), (label + 1) % 10 if i % 7 == 0 else label))
    out = []
    score = lambda a, b: max(-LONG, min(LONG - 1, sum(x * y for x, y in zip(a, b))))
    for i, v, label in sorted({r for r in usable if r[0] % step == 0}):
        others = [(-score(v, w), j, other) for j, w, other in usable if j != i]
        for p, j, _ in sorted(x for x in others if x[2] == label)[:5]:
            window = sorted(x for x in others if x[2] != label and 30 * -p <= 100 * -x[0] <= 90 * -p)[:10]
            out += [(i, j, rank, k, -p, -s) for rank, (s, k, _) in enumerate(window, 1)]
    return sorted(out)


def check(spark, rows, step=10):
    frame = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], SCHEMA)
    got = sorted(tuple(r) for r in hard_negatives(frame, step).collect())
    assert got == brute_force(rows, step)
    return got


def vectors(rnd, count, dims=24, labels=10, size=0.3):
    return [(i, [float(np.float32(rnd.gauss(0, size))) for _ in range(dims)], rnd.randrange(labels)) for i in range(count)]


@pytest.mark.parametrize("share", [0.0, 0.15, 0.3, 0.6, -1e9])
def test_join_loses_no_pair(share):
    rnd = np.random.default_rng(3)
    rows, anchors = rnd.integers(-90, 90, (300, 37)).astype(float), rnd.integers(-90, 90, (11, 37)).astype(float)
    rows[::7] = anchors[0]
    rows[:, 5] = 0
    exact = (anchors @ rows.T).astype(int)
    least = share * np.sqrt((anchors * anchors).sum(axis=1)) * Block(rows).longest
    wanted = rnd.random(exact.shape) < 0.7
    a, r, s = joined(Block(rows), anchors, least, wanted)
    assert sorted(zip(a.tolist(), r.tolist(), s.tolist())) == [(i, j, exact[i, j]) for i in range(11) for j in range(300) if wanted[i, j] and exact[i, j] >= least[i]]


def test_random_vectors(spark):
    assert len(check(spark, vectors(random.Random(1), 600))) > 2000


def test_several_blocks_in_a_part(spark, monkeypatch):
    monkeypatch.setattr(vector_blocks, "BLOCK_ROWS", 16)
    monkeypatch.setattr(vector_blocks, "GROUP_ROWS", 7)
    monkeypatch.setattr(op, "DENSE", 64)
    check(spark, vectors(random.Random(2), 500))


def test_hot_label_and_hot_vector(spark):
    rows = vectors(random.Random(3), 400)
    check(spark, [(i, v, label if i % 3 else 4) for i, v, label in rows])
    check(spark, [(i, v if i % 3 else rows[0][1], label) for i, v, label in rows])
    check(spark, [(i, v, 4) for i, v, _ in rows])


def test_few_of_a_label_and_low_scores(spark):
    rows = [(10, [0.5, 0.1], 1), (11, [0.0, 0.0], 1), (12, [-0.5, 0.0], 1), (20, [0.5, 0.5], 2), (22, [0.4, 0.4], 2), (23, [0.0, 0.0], 3), (24, [0.3, 0.3], 3), (30, [0.2, 0.2], 9), (31, [0.01, 0.0], 3)]
    assert check(spark, rows)


def test_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, [0.5, 0.25], 1), (10, [0.5], 2), (20, [], 2), (30, None, 1), (40, [0.1, None], 1), (50, [nan, 0.0], 1), (60, [1.0, -inf], 1), (None, [9.0, 9.0], 1), (70, [0.25, 0.25], None)]
    rows += [(80, [0.5, 0.25], 2), (80, [0.5, 0.25], 2), (80, [0.3, 0.25], 3), (1, [0.25, 0.25], 2), (1, [0.1, 0.1], 3), (2, [0.5, 0.25], -1), (3, [0.4, 0.3, 0.2], 2)]
    assert check(spark, rows)


def test_large_numbers(spark):
    values = [[3e38, 1.0], [3e38, 2.0], [-3e38, 5.0], [1e12, 3.0], [2.5e7, 3e7], [1.0, 1.0], [0.25, -3e38], [1e9, 1e9], [3e6, 0.0], [1.5e6, 0.0], [3e6, 1.0]]
    assert check(spark, [(10 * i, [float(np.float32(x)) for x in v], i % 2) for i, v in enumerate(values)])


def test_empty_table(spark):
    assert hard_negatives(spark.createDataFrame([], SCHEMA)).collect() == []


def test_query(spark, sf_dir):
    rows = [(r.vec_id, list(r.embedding), r.label) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    got = sorted(tuple(r) for r in op11_hard_negatives(spark, sf_dir).collect())
    assert got == brute_force(rows, 100)
