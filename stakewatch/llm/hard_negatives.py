"""Operator 11: hard negatives by threshold joins over an inverted index with norm bounds.

Anchors meet all rows twice: first for their best rows of the same label (positives), then for the best rows of other labels
inside each positive's window of scores. Both are joins "score at least t" in the manner of L2AP:

1. **Index.** Dimensions have one order by rising energy and are posted in chunks of ``CHUNK``. A row's leading dimensions,
   as far as the norm of that prefix times the largest anchor norm stays below t, are not posted at all: what they add cannot
   reach t. Rows lie in the order of their first posted chunk, so the posting list of a chunk is a slice of the rows.
2. **Accumulation.** From the last chunk backwards partial scores are added up for all posted rows. A pair goes as soon as
   its partial score plus the product of the remaining norms (Cauchy-Schwarz) is below the anchor's t; once few are left they
   are continued pair by pair, over the dimensions that were not posted, too. What reaches t is exact.
3. **Thresholds.** Every anchor starts high and is joined again at a lower t until its windows are full or reach down to
   their lower ends (below every score for positives, if need be). In later blocks of a part t starts where the windows
   filled so far leave off.

Parts' results are merged by windows over at most as many rows per anchor as there are parts times the length of a list.

Components count as floor(256 * x); a positive of score p has the window 3p/10 to 9p/10, which is empty below zero. Defined
results: rows with a null id, label or vector, or a null or non-finite component take no part; a shorter vector counts as
if it ended in zeros; ties go to the smaller id; "other rows" are those of other ids; every row of an id that repeats
counts, and an anchor id with several different rows gets the lists of each; an anchor without positives, or a positive without
a row in its window, has no result; scores that do not fit a long are taken as the nearest long; an empty table gives an empty
one; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stakewatch.llm.common import table, written
from stakewatch.llm.vector_blocks import as_longs, best_first, blocks, fits, groups, meet, participants, same_width, whole

ANCHOR_STEP = 100
POSITIVES = 5
NEGATIVES = 10
#: Dimensions of a chunk.
CHUNK = 8
#: First threshold as a share of the largest possible score, factor from one to the next, and the share below which
#: every row is taken.
FIRST, LOWER, LAST = 0.55, 0.8, 0.05
#: Pairs of a dense step, and the share of them that is continued one by one.
DENSE = 1 << 21
SPARSE = 1 / 16


class Block:
    """The rows of a block, dimensions by rising energy, with the norms of all prefixes of chunks."""

    def __init__(self, values: np.ndarray) -> None:
        self.values = values.astype(np.float64)
        self.order = np.argsort((self.values * self.values).sum(axis=0), kind="stable")
        self.rows = np.ascontiguousarray(self.values[:, self.order])
        self.norms = prefix_norms(self.rows)
        self.longest = float(self.norms[:, -1].max(initial=0))

    def arranged(self, anchors: np.ndarray) -> np.ndarray:
        """Anchors in the block's order of dimensions; what the block does not have adds nothing."""
        out = np.zeros((len(anchors), self.rows.shape[1]))
        shared = min(anchors.shape[1], self.rows.shape[1])
        out[:, :shared] = anchors[:, :shared]
        return out[:, self.order]


def prefix_norms(rows: np.ndarray) -> np.ndarray:
    """Norms of the first 0, 1, 2, ... chunks of every row."""
    chunks = -(-rows.shape[1] // CHUNK)
    out = np.zeros((len(rows), chunks + 1))
    for c in range(chunks):
        part = rows[:, c * CHUNK : (c + 1) * CHUNK]
        out[:, c + 1] = out[:, c] + (part * part).sum(axis=1)
    return np.sqrt(out)


def joined(block: Block, anchors: np.ndarray, least: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, row, score) of all ``wanted`` pairs [anchor, row] that score at least the anchor's ``least``."""
    if not fits(*same_width(anchors, block.values)):
        left, right = same_width(anchors, block.values)
        scores = as_longs((whole(left) @ whole(right).T).ravel()).reshape(wanted.shape)
        pairs = np.nonzero(wanted & (scores >= least[:, None]))
        return *pairs, scores[pairs]
    arranged = block.arranged(anchors)
    norms = prefix_norms(arranged)
    chunks = norms.shape[1] - 1
    slack = 1e-9 * (norms[:, -1:] * block.longest) + 1e-6
    # First posted chunk of every row: before it, the prefix cannot bring any anchor to its threshold on its own.
    unposted = block.norms * norms[:, -1].max(initial=0) * (1 + 1e-9) < least.min(initial=np.inf)
    first = unposted.sum(axis=1) - 1
    first[first < 0] = 0
    by_first = np.argsort(first, kind="stable")
    first, rows, row_norms = first[by_first], block.rows[by_first], block.norms[by_first]
    wanted = wanted[:, by_first]
    partial = np.zeros(wanted.shape)
    alive = wanted
    done = chunks
    while done:
        done -= 1
        posted = int(np.searchsorted(first, done, "right"))
        span = slice(done * CHUNK, (done + 1) * CHUNK)
        partial[:, :posted] += arranged[:, span] @ rows[:posted, span].T
        if 2 * done <= chunks:
            ahead = np.maximum(first, done)
            rest = norms[:, ahead] * row_norms[np.arange(len(rows)), ahead]
            alive = wanted & (partial + rest + slack >= least[:, None])
            if np.count_nonzero(alive) <= SPARSE * alive.size:
                break
    anchor, row = np.nonzero(alive)
    score = partial[anchor, row]
    ahead = np.maximum(first[row], done)
    for c in range(int(ahead.max(initial=0)) - 1, -1, -1):
        span = slice(c * CHUNK, (c + 1) * CHUNK)
        open_ = ahead > c
        score[open_] += np.einsum("ij,ij->i", arranged[anchor[open_], span], rows[row[open_], span])
        rest = np.where(open_, norms[anchor, c] * row_norms[row, c], norms[anchor, ahead] * row_norms[row, ahead])
        keep = score + rest + slack[anchor, 0] >= least[anchor]
        anchor, row, score, ahead = anchor[keep], row[keep], score[keep], ahead[keep]
    keep = score >= least[anchor]
    return anchor[keep], by_first[row[keep]], score[keep].astype(np.int64)


class Lists:
    """The best ``most`` rows found so far of every list: (list, id, score), kept in order."""

    def __init__(self, count: int, most: int) -> None:
        self.count, self.most = count, most
        self.lists = self.ids = self.scores = np.zeros(0, np.int64)

    def add(self, lists: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        lists, ids, scores = (np.concatenate(x) for x in ((self.lists, lists), (self.ids, ids), (self.scores, scores)))
        best = best_first(lists, scores, ids, self.most)
        self.lists, self.ids, self.scores = lists[best], ids[best], scores[best]

    def last(self) -> np.ndarray:
        """Score of the last entry of every full list, minus infinity for the others."""
        full = np.bincount(self.lists, minlength=self.count) == self.most
        low = np.full(self.count, np.inf)
        np.minimum.at(low, self.lists, self.scores.astype(np.float64))
        return np.where(full, low, -np.inf)


def windows_filled(block: dict, anchors: np.ndarray, wanted: np.ndarray, low: np.ndarray, high: np.ndarray, lists: Lists) -> None:
    """Adds to list [anchor, window] the best rows of the block that are ``wanted`` and score ``low`` to ``high``.

    Thresholds fall until every window is full above its threshold or done down to its lower end. A window whose lower end is
    above its upper end is empty."""
    found: Block = block["block"]
    per_anchor = low.shape[1]
    largest = np.sqrt((anchors * anchors).sum(axis=1)) * found.longest
    exists = low <= high
    before = np.full(low.shape, np.inf)  # what has been joined so far, by window
    # Above a window's upper end there is nothing to find.
    level = np.where(exists, np.minimum(FIRST * largest[:, None], np.where(np.isfinite(high), LOWER * high, np.inf)), np.inf)
    while True:
        last = lists.last().reshape(low.shape)
        goal = np.maximum(low, last)  # rows below it are not wanted
        todo = exists & (before > goal)
        if not todo.any():
            return
        level = np.where(level <= LAST * largest[:, None], -np.inf, level)
        aim = np.where(todo, np.maximum(level, goal), np.inf)
        rows = np.flatnonzero(todo.any(axis=1))
        anchor, row, score = joined(found, anchors[rows], aim[rows].min(axis=1), wanted[rows])
        anchor = rows[anchor]
        ids = block["ids"][row]
        for w in range(per_anchor):
            # Only rows between this threshold and the one before are new.
            new = todo[anchor, w] & (score >= aim[anchor, w]) & (score < before[anchor, w]) & (score <= high[anchor, w])
            lists.add(anchor[new] * per_anchor + w, ids[new], score[new])
        before = np.where(todo, aim, before)
        level = level * LOWER


def mined(windows: int, most: int, same_label: bool):
    """Answers anchor groups: the best ``most`` rows for each of up to ``windows`` windows of every anchor."""

    def run(held: list[dict], asked: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for block in held:
            if "block" not in block:
                block["block"] = Block(block["values"])
        step = max(1, DENSE // max(len(block["ids"]) for block in held))
        for start in range(0, len(asked["id"]), step):
            part = {k: v[start : start + step] for k, v in asked.items()}
            anchors = part["values"].astype(np.float64)
            if same_label:
                low, high = np.full((len(anchors), 1), -np.inf), np.full((len(anchors), 1), np.inf)
            else:
                p = part["scores"].reshape(len(anchors), windows)
                tens, ones = p // 10, p % 10
                low, high = (tens * 3 - (-ones * 3 // 10)).astype(np.float64), (tens * 9 + ones * 9 // 10).astype(np.float64)
                low[p < 0] = np.inf
            lists = Lists(len(anchors) * windows, most)
            for block in held:
                wanted = part["id"][:, None] != block["ids"]
                wanted &= (part["label"][:, None] == block["labels"]) == same_label
                windows_filled(block, anchors, wanted, low, high, lists)
            at = lists.lists // windows
            yield pa.RecordBatch.from_arrays(
                [pa.array(part["id"][at]), pa.array(part["number"][at]), pa.array(lists.lists % windows), pa.array(lists.ids), pa.array(lists.scores)], ["anchor_id", "number", "window", "vec_id", "score"]
            )

    return run


RESULT = "anchor_id long, number long, window long, vec_id long, score long"


def labelled(frame: DataFrame) -> DataFrame:
    """``id``, ``vector`` and the effective ``label`` of the rows that take part."""
    label = F.col("label").cast("long")
    label = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    return participants(frame, label.alias("label")).where("label IS NOT NULL")


def best_of(found: DataFrame, keys: list[str], most: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def hard_negatives(frame: DataFrame, anchor_step: int = ANCHOR_STEP, positives: int = POSITIVES, negatives: int = NEGATIVES) -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank``, ``negative_id``, ``positive_score`` and ``negative_score`` for the rows of
    ``frame`` (``vec_id``, ``embedding``, ``label``) whose id is divisible by ``anchor_step``."""
    rows = labelled(frame)
    index, parts = blocks(rows, lambda values: {}, "labelled-vectors", labelled=True)
    anchors = rows.where(F.col("id") % anchor_step == 0).distinct()
    number = F.row_number().over(Window.partitionBy("id").orderBy("label", "vector")).cast("long")
    anchors = written(anchors.withColumn("number", number), "anchors")

    same = meet(index, parts, groups(anchors, ("id", "number", "label"), "anchor-groups"), mined(1, positives, True), RESULT, "positives")
    same = written(best_of(same, ["anchor_id", "number"], positives).select("anchor_id", "number", "rank", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "best-positives")

    # A negative score stands for a window that is empty or missing.
    scores = same.groupBy("anchor_id", "number").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "positive_score"))), lambda x: x["positive_score"]).alias("scores"))
    scores = scores.withColumn("scores", F.slice(F.concat("scores", F.array_repeat(F.lit(-1).cast("long"), positives)), 1, positives))
    asked = anchors.join(scores, (F.col("id") == F.col("anchor_id")) & (anchors.number == scores.number)).select("vector", "id", anchors.number, "label", "scores")
    other = meet(index, parts, groups(asked, ("id", "number", "label", "scores"), "window-groups"), mined(positives, negatives, False), RESULT, "negatives")
    other = best_of(other, ["anchor_id", "number", "window"], negatives).withColumnRenamed("rank", "place")

    out = same.alias("p").join(other.alias("n"), (F.col("p.anchor_id") == F.col("n.anchor_id")) & (F.col("p.number") == F.col("n.number")) & (F.col("p.rank") == F.col("n.window") + 1))
    return out.select("p.anchor_id", "positive_id", F.col("place").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives(table(spark, sf_dir, "embeddings"))


ORACLE_SQL = f"""
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_inner_product(a.x, c.x)::BIGINT AS score FROM v a JOIN v c ON a.vec_id <> c.vec_id WHERE a.vec_id % {ANCHOR_STEP} = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {POSITIVES}),
n AS (SELECT p.*, vec_id AS negative_id, score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank
  FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= {NEGATIVES}
"""
