"""Operator 13 against brute force."""

import math
import random

import numpy as np
import pytest

from stakewatch.llm import exact_search, vector_blocks
from stakewatch.llm.exact_search import TOP, added, at_least, bit_sliced, bitmap, marked, op13_exact_search, score_slices, signed_digits, top_k, top_rows

SCHEMA = "vec_id long, embedding array<float>, label int, score long, part string"


def usable(rows):
    return [r for r in rows if r[0] is not None and r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]


def whole(vector):
    return [math.floor(256 * x) for x in vector]


def brute_force(rows, asked, most=TOP):
    rows = [(r[0], whole(r[1])) for r in usable(rows)]
    asked = sorted({(r[0], tuple(r[1])) for r in usable(asked)})
    out = []
    for query_id, vector in asked:
        q = whole(vector)
        found = sorted((-sum(a * b for a, b in zip(q, v)), i) for i, v in rows if i != query_id)[:most]
        out += [(query_id, n, i, max(-(2**63), min(2**63 - 1, -s))) for n, (s, i) in enumerate(found, 1)]
    return sorted(out)


def searched(spark, rows, step=3):
    asked = [r for r in rows if r[0] is not None and r[0] % step == 0]
    frame, queries = (spark.createDataFrame([(*r, 1, 7, "x") for r in x], SCHEMA) for x in (rows, asked))
    return sorted(tuple(r) for r in top_k(frame, queries).collect()), brute_force(rows, asked)


def vectors(rnd, count, dims=24, size=0.3):
    return [(i, [float(np.float32(rnd.gauss(0, size))) for _ in range(dims)]) for i in range(count)]


def test_slices_add_and_compare():
    rnd = np.random.default_rng(1)
    values = rnd.integers(-90, 90, (200, 9)).astype(float)
    made = bit_sliced(values)
    coarse = np.floor(values / 2 ** int(made["shift"])) + 64
    coefficients = [3, -7, 0, 31, -32, 1, 13, -1, 5]
    score, constant = score_slices(made["slices"], coefficients)
    expected = (coarse @ np.array(coefficients)).astype(int) + constant
    got = sum(np.unpackbits(s.view(np.uint8), bitorder="little").astype(int)[:200] << w for w, s in enumerate(score))
    assert got.tolist() == expected.tolist()
    rows = bitmap(np.arange(200) % 3 > 0)
    for bound in [-5, 0, *np.quantile(expected, [0.1, 0.5, 0.99]).astype(int).tolist(), int(expected.max()), int(expected.max()) + 1, 1 << 40]:
        assert marked(at_least(score, rows, bound)).tolist() == [i for i in range(200) if i % 3 and expected[i] >= bound]
    best = sorted((i for i in range(200) if i % 3), key=lambda i: -expected[i])[:6]
    assert sorted(expected[top_rows(score, rows, 6)].tolist()) == sorted(expected[best].tolist())
    assert added({}, 2) == []


@pytest.mark.parametrize("number", [0, 1, -1, 3, 7, -11, 23, 32])
def test_signed_digits(number):
    found = signed_digits(number)
    assert sum(sign << weight for weight, sign in found) == number
    assert all(b - a > 1 for (a, _), (b, _) in zip(found, found[1:]))


def test_random_vectors(spark):
    got, expected = searched(spark, vectors(random.Random(5), 400))
    assert got == expected and len(got) == 134 * TOP


def test_several_blocks_in_a_part(spark, monkeypatch):
    monkeypatch.setattr(vector_blocks, "BLOCK_ROWS", 16)
    monkeypatch.setattr(vector_blocks, "GROUP_ROWS", 7)
    monkeypatch.setattr(exact_search, "SPAN_WORDS", 1)
    got, expected = searched(spark, vectors(random.Random(6), 500))
    assert got == expected


def test_a_third_of_all_rows_alike(spark):
    rnd = random.Random(7)
    rows = vectors(rnd, 300)
    rows = [(i, rows[0][1] if i % 3 else v) for i, v in rows]
    got, expected = searched(spark, rows, 5)
    assert got == expected


def test_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, [0.5, 0.25]), (3, [0.5]), (6, []), (9, None), (12, [0.1, None]), (15, [nan, 0.0]), (18, [1.0, -inf]), (None, [9.0, 9.0]), (21, [-0.001, 0.001])]
    rows += [(24, [0.5, 0.25]), (24, [0.5, 0.25]), (24, [-0.5, 0.25]), (1, [0.5, 0.25]), (1, [0.0, 0.0])]
    got, expected = searched(spark, rows)
    assert got == expected


def test_large_numbers(spark):
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate([[3e38, 1.0], [3e38, 2.0], [-3e38, 5.0], [1e12, 3.0], [2.5e7, 3e7], [1.0, 1.0], [0.25, -3e38]])]
    got, expected = searched(spark, rows, 1)
    assert got == expected


def test_few_and_none(spark):
    got, expected = searched(spark, vectors(random.Random(8), 4), 1)
    assert got == expected and len(got) == 12
    empty = spark.createDataFrame([], SCHEMA)
    assert top_k(empty, empty).collect() == []
    assert searched(spark, [(0, [1.0])]) == ([], [])


def test_session_is_as_before(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    searched(spark, vectors(random.Random(9), 8))
    assert spark.conf.get(key) == before


def test_query(spark, sf_dir):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    got = sorted(tuple(r) for r in op13_exact_search(spark, sf_dir).collect())
    assert got == brute_force(rows, [r for r in rows if r[0] % 50 == 0])
