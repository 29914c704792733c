"""Medians and percentiles over everything earlier, for people with very many purchases.

A group too large for in-row arrays is cut twice: into blocks along its own order and, per value column, into ranges
at approximate quantiles. A purchase in block b then needs, exactly:

* how many earlier purchases fall into each range (one vector of counts per block);
* the earlier values of the few ranges its medians can fall into: a block of S purchases moves a median by at most S
  places, and the spread around it is bounded by the same counts;
* the purchases of its own block before it.

Each task holds one block and a few ranges. With at most ``MAX_BLOCKS`` blocks and ``RANGES`` ranges per group both
stay a small fixed share of the group, whatever its size, and all results are exact. Equal values are carried as one
row with a count, so a value shared by a third of the rows is one row per block.
"""

from __future__ import annotations

import sys
from bisect import bisect_left, bisect_right, insort

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

# Workers get the functions of this module by value, so they need not have the package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

PERSON = ["issuer_cik", "insider_id"]
BLOCK_ROWS = 20_000
MAX_BLOCKS = 1000
RANGES = 1024
#: Known values, values above zero, ownership increases, 90-day sums.
STREAMS = ["v", "w", "o", "t"]


def plan_ranges(counts: pd.DataFrame, tasks: pd.DataFrame) -> pd.DataFrame:
    """For each task of one group and column: counts before its block, and the ranges it needs value by value."""
    if tasks.empty or counts.empty:
        return pd.DataFrame(columns=[*PERSON, "stream", "bb", "ob", "ranges", "base", "edges"])
    edges = np.asarray(tasks["edges"].iloc[0], float)
    stream, size, log_edges = tasks["stream"].iloc[0], len(edges) - 1, np.log1p(np.maximum(edges, -0.999999))
    blocks = int(max(counts["block"].max(), tasks["bb"].max())) + 1
    table = np.zeros((blocks + 1, size), dtype=np.int64)
    np.add.at(table, (counts["block"].to_numpy() + 1, counts["range"].to_numpy()), counts["n"].to_numpy())
    in_block = table[1:].sum(axis=1)
    before = np.cumsum(table, axis=0)
    out = []
    for task in tasks.itertuples(index=False):
        per_range = before[task.bb]
        base = np.concatenate([[0], np.cumsum(per_range)])
        n, step = int(base[-1]), int(in_block[task.bb]) if task.bb < blocks else 0
        wanted: set[int] = set()

        def ranks(low: float, high: float) -> tuple[int, int] | None:
            """Ranges that hold the places low..high of the earlier values."""
            low, high = max(int(np.floor(low)), 0), min(int(np.ceil(high)), n - 1)
            if n == 0 or low > high:
                return None
            first, last = (int(np.searchsorted(base, place, "right")) - 1 for place in (low, high))
            wanted.update(r for r in range(first, last + 1) if per_range[r])
            return first, last

        if stream == "t":
            if task.k_low is not None and not np.isnan(task.k_low):
                ranks((n + task.k_low - step) / 2 - 2, (n + task.k_high + step) / 2 + 2)
                ranks((n - task.k_high - step) / 2 - 2, (n - task.k_low + step) / 2 + 2)
        else:
            low, high = (n - step) / 2 - 2, (n + step) / 2 + 2
            held = ranks(low, high)
            if stream == "w" and task.positional and held is not None:
                # The median lies between these; outside the known places it may reach the ends.
                least = log_edges[held[0]] if low >= 0 else log_edges[0]
                most = log_edges[held[1] + 1] if high <= n - 1 else log_edges[-1]
                near, far = spread_bounds(log_edges, per_range, least, most, (n - step) / 2 - 3, (n + step) / 2 + 3)
                for a, b in ((least - far, most - near), (least + near, most + far)):
                    touched = (log_edges[:-1] <= b) & (log_edges[1:] >= a) & (per_range > 0)
                    wanted.update(np.flatnonzero(touched).tolist())
        out.append((*[getattr(task, c) for c in PERSON], stream, task.bb, task.ob, sorted(wanted), base.tolist(), edges.tolist()))
    return pd.DataFrame(out, columns=[*PERSON, "stream", "bb", "ob", "ranges", "base", "edges"])


def spread_bounds(edges: np.ndarray, per_range: np.ndarray, least: float, most: float, below: float, above: float) -> tuple[float, float]:
    """Distances that the median distance from any centre in [least, most] lies between, from range counts alone."""
    tried = np.unique(np.concatenate([np.abs(edges - least), np.abs(edges - most)]))

    def at_most(d: float) -> int:
        return int(per_range[(edges[:-1] <= most + d) & (edges[1:] >= least - d)].sum())

    def at_least(d: float) -> int:
        return int(per_range[(edges[:-1] >= most - d) & (edges[1:] <= least + d)].sum())

    near = bisect_right(tried, below, key=at_most)
    far = bisect_left(tried, above, key=at_least)
    return (float(tried[near - 1]) if near else 0.0), (float(tried[far]) if far < len(tried) else float("inf"))


class Earlier:
    """Values before a block: exact in the needed ranges, by their upper edge elsewhere; plus those of the block."""

    def __init__(self, base: np.ndarray, edges: np.ndarray, values: np.ndarray, times: np.ndarray) -> None:
        self.base, self.edges, self.n = base, edges, int(base[-1])
        order = np.argsort(values, kind="stable")
        values, times = values[order], times[order]
        place = np.searchsorted(edges[1:-1], values, "left")
        self.held = {int(r): (values[place == r], np.cumsum(times[place == r])) for r in np.unique(place)}
        self.block: list[float] = []

    def add(self, value: float) -> None:
        if value == value:
            insort(self.block, value)

    def past(self, rank: int) -> float:
        r = int(np.searchsorted(self.base, rank, "right")) - 1
        if r not in self.held:
            return float(self.edges[r + 1])
        values, upto = self.held[r]
        return float(values[np.searchsorted(upto, rank - self.base[r], "right")])

    def __len__(self) -> int:
        return self.n + len(self.block)

    def __getitem__(self, rank: int) -> float:
        """Value at a place of the past and the block together, by halving how many come from the block."""
        block = self.block
        low, high = max(0, rank + 1 - self.n), min(len(block), rank + 1)
        while low < high:
            a = (low + high) // 2
            if block[a] < self.past(rank - a):
                low = a + 1
            else:
                high = a
        from_past = self.past(rank - low) if rank - low >= 0 else -np.inf
        return max(block[low - 1], from_past) if low else from_past

    def median(self) -> float | None:
        n = len(self)
        return (self[(n - 1) // 2] + self[n // 2]) / 2 if n else None

    def median_with(self, value: float, times: int) -> float | None:
        """Median when one value is added a number of times."""
        n = len(self)

        def at(rank: int) -> float:
            if rank < n and (first := self[rank]) < value:
                return first
            if rank - times >= 0 and (second := self[rank - times]) >= value:
                return second
            return value

        total = n + times
        return (at((total - 1) // 2) + at(total // 2)) / 2 if total else None

    def log_median_and_spread(self) -> tuple[float | None, float | None]:
        """Median of the logs and median distance of the logs from it."""
        n = len(self)
        if not n:
            return None, None
        middle = (n - 1) // 2
        centre = (np.log1p(self[middle]) + np.log1p(self[n // 2])) / 2

        def left(i: int) -> float:
            return abs(centre - np.log1p(self[middle - i])) if i <= middle else np.inf

        def right(i: int) -> float:
            return abs(np.log1p(self[middle + 1 + i]) - centre) if middle + 1 + i < n else np.inf

        def distance(rank: int) -> float:
            low, high = max(0, rank + 1 - (n - 1 - middle)), min(middle + 1, rank + 1)
            while low < high:
                a = (low + high) // 2
                if left(a) < right(rank - a):
                    low = a + 1
                else:
                    high = a
            return max(left(low - 1) if low else -np.inf, right(rank - low) if rank >= low else -np.inf)

        return float(centre), float((distance((n - 1) // 2) + distance(n // 2)) / 2)


RESULT = (
    "issuer_cik string, insider_id string, bb long, sequence long, positional boolean, stream string, v double, range int, counted long,"
    " known long, median double, median_log double, mad double, median_o double, median_t double"
)


def run_block(rows: pd.DataFrame) -> pd.DataFrame:
    """Answers of one task: its questions in the order of their bound, the block's purchases added as they pass."""
    asked = rows[rows["kind"] == "question"].sort_values("bound")
    if asked.empty:
        return pd.DataFrame(columns=[c.split()[0] for c in RESULT.split(", ")])
    inside = rows[rows["kind"] == "block"].sort_values("sequence")
    known = rows[rows["kind"] == "value"]
    earlier = {}
    for plan in rows[rows["kind"] == "plan"].itertuples(index=False):
        mine = known[known["stream"] == plan.stream]
        earlier[plan.stream] = Earlier(
            np.asarray(plan.base, np.int64), np.asarray(plan.edges, float), mine["value"].to_numpy(float), mine["times"].to_numpy(float).astype(np.int64)
        )
    for stream in STREAMS:
        earlier.setdefault(stream, Earlier(np.zeros(2, np.int64), np.zeros(2), np.zeros(0), np.zeros(0, np.int64)))
    v, w, o, t = (earlier[s] for s in STREAMS)
    passing = list(zip(inside["sequence"], inside["v"], inside["w"], inside["o"], inside["t"]))
    at, out = 0, []
    for q in asked.itertuples(index=False):
        while at < len(passing) and passing[at][0] < q.bound:
            for store, value in zip((v, w, o, t), passing[at][1:]):
                store.add(value)
            at += 1
        stream, store = ("w", w) if q.positional else ("v", v)
        if q.v == q.v:
            place = int(np.searchsorted(store.edges[1:-1], q.v, "left"))
            smaller = bisect_left(store.block, q.v) if q.positional else bisect_right(store.block, q.v)
            compared = (float(q.v), place, int(store.base[place]) + smaller)
        else:  # an unknown value is above none of the others
            compared = (None, -1, 0)
        head = (q.issuer_cik, q.insider_id, q.bb, q.sequence, q.positional, stream, *compared, len(store))
        if q.positional:
            out.append((*head, w.median(), *w.log_median_and_spread(), None, None))
        else:
            out.append((*head, v.median(), None, None, o.median(), t.median_with(q.x, int(q.k))))
    return pd.DataFrame(out, columns=[c.split()[0] for c in RESULT.split(", ")])


def run_range(rows: pd.DataFrame) -> pd.DataFrame:
    """Inside one range: earlier blocks' values below, and up to, each asked value."""
    names = [*PERSON, "stream", "bb", "v", "below", "upto"]
    asked = rows[rows["asked"]]
    if asked.empty:
        return pd.DataFrame(columns=names)
    values = rows[~rows["asked"]].sort_values("v")
    seen = np.zeros(int(max(rows["bb"].max(), 0)) + 2, np.int64)
    v, blocks, times = values["v"].to_numpy(), values["bb"].to_numpy(), values["times"].to_numpy(float).astype(np.int64)
    at, out = 0, []
    for value, group in asked.sort_values("v").groupby("v"):
        stop = int(np.searchsorted(v, value, "left"))
        np.add.at(seen, blocks[at:stop], times[at:stop])
        below = np.concatenate([[0], np.cumsum(seen)])
        at = int(np.searchsorted(v, value, "right"))
        np.add.at(seen, blocks[stop:at], times[stop:at])
        upto = np.concatenate([[0], np.cumsum(seen)])
        for q in group.itertuples(index=False):
            out.append((q.issuer_cik, q.insider_id, q.stream, q.bb, value, int(below[q.bb]), int(upto[q.bb])))
    return pd.DataFrame(out, columns=names)


def number_ranges(rows: pd.DataFrame, cuts: pd.DataFrame) -> pd.DataFrame:
    if rows.empty:
        return rows.assign(range=pd.Series(dtype="int32"))
    edges = np.asarray(cuts["edges"].iloc[0], float)
    return rows.assign(range=np.searchsorted(edges[1:-1], rows["value"].to_numpy(float), "left").astype("int32"))


def apart(df: DataFrame) -> DataFrame:
    """The same columns under new identities, so a table can be grouped together with one it came from."""
    return df.select(*[F.col(c).alias(c) for c in df.columns])


def blocked_statistics(placed: DataFrame, block_rows: int = BLOCK_ROWS, ranges: int = RANGES, max_blocks: int = MAX_BLOCKS) -> DataFrame:
    """The statistics of ``ordered_statistics.STATISTICS`` for the given purchases, all of whose groups are complete.

    As in the arrays, a missing value counts for nothing, and figures at a purchase's own position leave out values that are
    not above zero.
    """
    rows_per_block = F.greatest(F.lit(block_rows), F.ceil(F.col("group_size") / float(max_blocks)))
    hot = placed.select(
        *PERSON, "sequence", F.col("prior_purchase_count").cast("long").alias("p"), F.col("_day_place").cast("long").alias("k"),
        F.col("purchase_value").alias("v"), F.when(F.col("purchase_value") > 0, F.col("purchase_value")).alias("w"), F.col("ownership_increase_percent").cast("double").alias("o"), F.col("_full_90d").alias("t"),
        F.col("_same_day_90d").alias("x"), rows_per_block.alias("_s"),
    ).withColumns({"block": F.floor(F.col("sequence") / F.col("_s")), "strict_block": F.floor(F.col("p") / F.col("_s"))})

    def streams(*columns: str) -> DataFrame:
        entries = F.explode(F.array(*[F.struct(F.lit(s).alias("stream"), F.col(s).alias("value")) for s in STREAMS])).alias("e")
        return hot.select(*PERSON, *columns, entries).select(*PERSON, *columns, "e.*").filter("value is not null")

    # Values with their counts, and the range of each.
    values = streams("block").groupBy(*PERSON, "stream", "block", "value").agg(F.count(F.lit(1)).alias("times"))
    shares = [i / ranges for i in range(1, ranges)]
    cuts = values.groupBy(*PERSON, "stream").agg(
        F.concat(F.array(F.min("value")), F.percentile_approx("value", shares, 10 * ranges), F.array(F.max("value"))).alias("edges")
    )
    in_block = [*PERSON, "stream", "block"]
    cuts_per_block = values.select(*in_block).distinct().join(cuts, [*PERSON, "stream"])
    ranged = values.groupBy(*in_block).cogroup(apart(cuts_per_block).groupBy(*in_block)).applyInPandas(
        number_ranges, "issuer_cik string, insider_id string, stream string, block long, value double, times long, range int"
    )

    # Questions: each purchase asks at its own position and at the end of the day before.
    asks = F.explode(
        F.array(
            F.struct(F.col("block").alias("bb"), F.col("sequence").alias("bound"), F.lit(True).alias("positional")),
            F.struct(F.col("strict_block").alias("bb"), F.col("p").alias("bound"), F.lit(False).alias("positional")),
        )
    ).alias("a")
    questions = hot.select(*PERSON, F.col("block").alias("ob"), "sequence", "k", "v", "x", asks).select(
        *PERSON, "a.bb", "ob", "a.bound", "a.positional", "sequence", "k", "v", "x"
    )
    strict_k = F.when(~F.col("positional"), F.col("k")).cast("double")
    tasks = questions.groupBy(*PERSON, "bb", "ob").agg(
        F.max("positional").alias("positional"), F.min(strict_k).alias("k_low"), F.max(strict_k).alias("k_high")
    )

    # What each task needs to know of the past.
    counts = ranged.groupBy(*in_block, "range").agg(F.sum("times").alias("n"))
    task_edges = tasks.join(cuts, PERSON)
    plans = counts.groupBy(*PERSON, "stream").cogroup(apart(task_edges).groupBy(*PERSON, "stream")).applyInPandas(
        plan_ranges, "issuer_cik string, insider_id string, stream string, bb long, ob long, ranges array<int>, base array<long>, edges array<double>"
    )
    needed = (
        plans.select(*PERSON, "stream", "bb", "ob", F.explode("ranges").alias("range"))
        .join(ranged, [*PERSON, "stream", "range"])
        .filter(F.col("block") < F.col("bb"))
        .select(*PERSON, "bb", "ob", "stream", "value", F.col("times").cast("double").alias("times"), F.lit("value").alias("kind"))
    )
    own = hot.select(*PERSON, F.col("block").alias("bb"), "sequence", "v", "w", "o", "t").join(tasks.select(*PERSON, "bb", "ob"), [*PERSON, "bb"])
    together = (
        questions.withColumn("kind", F.lit("question"))
        .unionByName(own.withColumn("kind", F.lit("block")), allowMissingColumns=True)
        .unionByName(needed, allowMissingColumns=True)
        .unionByName(plans.drop("ranges").withColumn("kind", F.lit("plan")), allowMissingColumns=True)
    )
    answers = together.groupBy(*PERSON, "bb", "ob").applyInPandas(run_block, RESULT)

    # The rest of the counts: earlier values in the same range.
    in_range = answers.filter("v is not null").select(*PERSON, "stream", "range", "bb", "v").distinct().withColumns({"times": F.lit(None).cast("double"), "asked": F.lit(True)}).unionByName(
        ranged.filter("stream in ('v', 'w')").select(
            *PERSON, "stream", "range", F.col("block").alias("bb"), F.col("value").alias("v"), F.col("times").cast("double").alias("times"), F.lit(False).alias("asked")
        )
    )
    parts = in_range.groupBy(*PERSON, "stream", "range").applyInPandas(
        run_range, "issuer_cik string, insider_id string, stream string, bb long, v double, below long, upto long"
    )
    full = answers.join(parts, [*PERSON, "stream", "bb", "v"], "left").fillna(0, ["below", "upto"])
    at_place, strict = F.col("positional"), ~F.col("positional")
    statistics = full.groupBy(*PERSON, "sequence").agg(
        F.max(F.when(strict, F.col("median"))).alias("prior_median_purchase_value"),
        F.max(F.when(strict, F.col("counted") + F.col("upto"))).alias("_upto"),
        F.max(F.when(strict, F.col("known"))).alias("_known_before"),
        F.max(F.when(strict, F.col("median_o"))).alias("prior_median_ownership_increase_percent"),
        F.max(F.when(at_place, F.col("median"))).alias("_median"),
        F.max(F.when(at_place, F.col("counted") + F.col("below"))).alias("_below"),
        F.max(F.when(at_place, F.col("median_log"))).alias("_median_log"),
        F.max(F.when(at_place, F.col("mad"))).alias("_mad"),
        F.max(F.when(strict, F.col("median_t"))).alias("_median_90d"),
    )
    percentile = F.col("_upto").cast("double") / F.nullif("_known_before", F.lit(0)) * 100
    return placed.join(statistics, [*PERSON, "sequence"], "left").withColumn("prior_purchase_value_percentile", percentile).drop("_upto", "_known_before")
