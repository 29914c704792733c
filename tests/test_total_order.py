"""Total orders and value positions where one key, or one value, is most of the table."""

import random

from pyspark.sql import functions as F

from stakewatch.operators.evidence import mid_ranks, shares_at_or_below
from stakewatch.operators.grouping import rank_rows
from stakewatch.operators.total_order import laid_out, numbered, value_positions


def test_half_of_all_rows_tied(spark):
    rng = random.Random(1)
    rows = [("hot" if i % 10 else None, 7.0 if rng.random() < 0.5 else rng.choice([None, rng.random()]), i % 3, f"t{rng.randrange(20)}", i) for i in range(4000)]
    frame = spark.createDataFrame(rows, "k string, v double, w long, t string, i int")
    got = {r.i: r["rank"] for r in rank_rows(frame, ["k"], [F.col("v"), F.col("w")], [F.col("t"), F.col("i")]).collect()}
    for key in ("hot", None):
        group = sorted((r for r in rows if r[0] == key), key=lambda r: (r[1] is None, -(r[1] or 0), -r[2], r[3], r[4]))
        assert [got[r[4]] for r in group] == list(range(1, len(group) + 1))


def test_ties_are_cut_between_ranges(spark):
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    try:
        check_ties(spark)
    finally:
        spark.conf.unset(key)


def check_ties(spark):
    frame = spark.range(20_000).select(F.lit(1).alias("k"), F.lit(5.0).alias("v"), F.col("id"))
    rows = laid_out(frame, ["k"], [F.desc("v"), F.asc("id")], "t")
    sizes = [r["count"] for r in rows.groupBy("_range").count().collect()]
    assert len(sizes) > 1 and max(sizes) < 20_000 / 2
    plan = numbered(frame, ["k"], [F.desc("v"), F.asc("id")])._jdf.queryExecution().toString()
    assert "Window" not in plan


def test_positions_of_pairs_with_one_first_value(spark):
    rng = random.Random(2)
    rows = [(1.0, rng.choice([None, float(rng.randrange(40))])) for _ in range(1500)]
    frame = spark.createDataFrame(rows, "a double, b double")
    order = lambda r: (r[1] is None, r[1] or 0)
    for r in value_positions(frame, [], ["a", "b"]).collect():
        assert (r.n_equal, r.n_below, r.n_total) == (rows.count((r.a, r.b)), sum(order(x) < order((r.a, r.b)) for x in rows), 1500)


def test_columns_in_one_pass(spark):
    rows = [(i, float(i % 4), i // 4) for i in range(40)] + [(40, None, 3)]
    frame = spark.createDataFrame(rows, "i int, x double, y long")
    got = {r.i: r for r in mid_ranks(frame, {"p": ("x", False), "q": ("y", True)}).collect()}
    assert len(got) == 41 and got[0].p == 4.5 / 40 and got[40].p == 1.0 and got[39].q == 1.5 / 40
    shares = {r.i: (r.s, r.t) for r in shares_at_or_below(frame, {"s": "x", "t": "y"}).collect()}
    assert shares[3] == (100, 10) and shares[40] == (27, 41)


def test_nothing_to_order(spark):
    empty = spark.createDataFrame([], "k string, v double")
    assert rank_rows(empty, ["k"], [F.col("v")], []).count() == 0
    assert value_positions(empty, [], ["v"]).count() == 0
    one = spark.createDataFrame([("a", 1.0)], "k string, v double")
    assert [r.p for r in mid_ranks(one, {"p": ("v", False)}).collect()] == [0.5]
