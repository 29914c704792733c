"""Increments: bounded state, repeated batches, late corrections; moments and merges against brute force."""

import datetime as dt
import os
import random
from statistics import mean, stdev

import pytest
from pyspark.sql import functions as F

from stakewatch.operators.activity import merge_companies, with_largest_so_far
from stakewatch.operators.prices import with_trailing_moments
from stakewatch.streaming import jobs


def test_moments_of_large_values_with_small_steps(spark):
    rng = random.Random(1)
    values = [None if rng.random() < 0.05 else 1e6 + 1e-3 * rng.randrange(1000) for _ in range(150)]
    frame = spark.createDataFrame([("a", i + 1, x) for i, x in enumerate(values)] + [("b", 1, None), ("b", 2, 3.0)], "ticker string, _n int, x double")
    got = {(r.ticker, r._n): r.m for r in with_trailing_moments(frame, {"m": ("x", 20)}).collect()}
    assert got["b", 1].n == 0 and got["b", 1].mean is None and (got["b", 2].n, got["b", 2].mean, got["b", 2].m2) == (1, 3.0, 0.0)
    for i in range(150):
        last = [x for x in values[max(0, i - 19) : i + 1] if x is not None]
        m = got["a", i + 1]
        assert m.n == len(last) and m.mean == pytest.approx(mean(last), rel=1e-12)
        if len(last) > 1:
            assert (m.m2 / (m.n - 1)) ** 0.5 == pytest.approx(stdev(last), rel=1e-7)


def test_one_company_with_most_rows_keeps_the_last_rise(spark):
    rng = random.Random(2)
    rows = [("hot" if i % 3 else f"c{i % 7}", i, rng.choice([None, rng.random()]), float(rng.randrange(50))) for i in range(3000)]
    frame = spark.createDataFrame(rows, "k string, p int, x double, y double")
    got = {r.p: (r._so_far_x, r._so_far_y) for r in with_largest_so_far(frame, "k", "p", ["x", "y"]).collect()}
    so_far = {}
    for k, p, x, y in rows:
        a, b = so_far.get(k, (None, None))
        assert got[p] == (a, b)
        so_far[k] = (a if x is None else max(x, a if a is not None else x), y if b is None else max(y, b))
    plan = merge_companies(ranked_items(spark), "consensus")._jdf.queryExecution().toString()
    assert "_range" in plan


def ranked_items(spark):
    columns = "issuer_cik string, ticker string, company_name string, headline string, sector string, market_cap double, conviction_score double, behavior_change_score double, cluster_score double, purchase_value double, buyer_count int, purchase_multiple double, ranking_category string, rank int"
    return spark.createDataFrame([("1", "T", "N", f"h{i}", None, 1.0, float(c), 0.0, 0.0, 10.0, 1, None, "quiet_buyers", i) for i, c in enumerate([5, 9, 7, 9, 12, 3], 1)], columns)


@pytest.mark.parametrize("strength", ["consensus", "landscape", "ladder"])
def test_headline_of_the_last_rise(spark, strength):
    assert [r.headline for r in merge_companies(ranked_items(spark), strength).collect()] == ["h5"]


LOADS = "ticker string, date date, close double, load_no int"


def load(spark, path, rows):
    spark.createDataFrame([(t, dt.date.fromisoformat(d), c, n) for t, d, c, n in rows], LOADS).write.mode("append").parquet(path)


def files(path):
    return {os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def table(spark, path):
    return sorted((r.ticker, str(r.date), r.close, r.load_no) for r in spark.read.parquet(path).collect())


def test_upsert_is_idempotent_and_rewrites_one_month(spark, tmp_path):
    inbox, path, checkpoint = (str(tmp_path / x) for x in ("inbox", "table", "checkpoint"))
    run = lambda where: jobs.upsert_prices(jobs.file_stream(spark, inbox, LOADS), path, where).awaitTermination()
    load(spark, inbox, [("A", "2024-01-05", 1.0, 1), ("A", "2024-02-05", 2.0, 1), ("B", "2024-03-05", 3.0, 1), ("A", "2024-01-05", 1.5, 2)])
    run(checkpoint)
    first = [("A", "2024-01-05", 1.5, 2), ("A", "2024-02-05", 2.0, 1), ("B", "2024-03-05", 3.0, 1)]
    assert table(spark, path) == first
    before = files(path)
    run(str(tmp_path / "again"))  # every batch once more, as after a lost checkpoint
    assert table(spark, path) == first and files(path) == before
    load(spark, inbox, [("A", "2024-02-05", 2.5, 3), ("B", "2024-02-06", 7.0, 3)])
    run(checkpoint)
    assert table(spark, path) == [("A", "2024-01-05", 1.5, 2), ("A", "2024-02-05", 2.5, 3), ("B", "2024-02-06", 7.0, 3), ("B", "2024-03-05", 3.0, 1)]
    kept = {f for f in before if "month=2024-02" not in f}
    assert kept and kept <= files(path)


def test_history_state_levels_off(spark, tmp_path):
    schema = "ranking_category string, rank int, stable_key string, ranking_score double, as_of date"
    inbox, out, checkpoint = (str(tmp_path / x) for x in ("inbox", "history", "checkpoint"))
    states = []
    for run in range(10):
        day = dt.date(2024, 1, 1) + dt.timedelta(days=20 * run)
        old = [("c", i, f"k{run - 1}-{i}", 1.0, day) for i in range(20)] if run else []
        spark.createDataFrame(old + [("c", i, f"k{run}-{i}", 1.0, day) for i in range(20)], schema).coalesce(1).write.mode("append").parquet(inbox)
        history = spark.read.schema("snapshot_key string").parquet(out) if run else spark.createDataFrame([], "snapshot_key string")
        stream = jobs.new_rankings(jobs.file_stream(spark, inbox, schema), history, "as_of", "30 days")
        query = jobs.to_files(stream, out, checkpoint)
        query.awaitTermination()
        states.append(max(s["numRowsTotal"] for p in query.recentProgress for s in p["stateOperators"]))
        assert spark.read.parquet(out).count() == 20 * (run + 1)
    assert max(states[4:]) == min(states[4:]) < 200


def test_nothing_new_writes_nothing(spark, tmp_path):
    path = str(tmp_path / "table")
    frame = spark.createDataFrame([("A", dt.date(2024, 1, 5), 1.0, 1)], LOADS)
    jobs.merge_prices_into(frame, path)
    before = files(path)
    jobs.merge_prices_into(frame.withColumn("close", F.lit(9.0)), path)
    assert files(path) == before
