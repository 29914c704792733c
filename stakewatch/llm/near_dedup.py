"""Operator 10: near-duplicates by an inverted join of signature coordinates.

1. Every text becomes its set of distinct 5-word shingles (64-bit hashes); equal sets are one class from then on.
2. Each class is posted under its ``COORDINATES`` minimum hashes. Values that only one class has cannot collide; a class
   with fewer than ``MATCHES`` shared values has no partner and leaves.
3. Shingles that no other remaining class has count against each class: two sets of at least ``SIMILARITY`` overlap in so
   many shingles that both must have that many shared ones. This bound is exact and keeps families that only share a
   passage from being compared at all.
4. Posts are ordered by rarity; of a class's coordinates only the rarest ``COORDINATES - MATCHES + 1`` are merged, which
   two signatures with ``MATCHES`` collisions cannot avoid having in common. The first round compares every class
   with one pivot of each of its posts only, the one with the smallest share of shingles of its own (the least edited of a
   family), and what links is one component from then on. The last round compares, in each
   post, whatever is not in the post's largest component with everything of another component: links inside a component
   cannot change the result, so a group of copies of any size is never compared pair by pair.
5. Collisions are counted on the whole signatures; pairs above the threshold are confirmed on the full sets.

A pair at exactly the similarity limit has fewer than ``MATCHES`` collisions in less than one of 10^9 cases.

Defined results: a null or blank text has an empty set, links with nothing and is its own component; repeated rows of one
``doc_id`` get the same row each; a row without an id is linked to its equals but stands for none; fewer than five words are one shingle; ties go to the smallest id; an empty table gives
an empty one; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stakewatch.llm.common import U64, SliceHash, byte_table, kept_in_worker, list_array, lower_ascii, map_batches, mixed, shingle_hashes, table, text_bytes, text_slices, word_starts_ends, written

SHINGLE = 5
SIMILARITY = 85  # percent
COORDINATES = 48
MATCHES = 22
PIVOT_ROUNDS = 1


class Shingler:
    """Distinct shingles of the texts of a batch; made once in each task."""

    def __init__(self) -> None:
        self.hash = SliceHash()
        self.word = byte_table(lambda b: not (b == 32 or 9 <= b <= 13))
        rng = np.random.default_rng(77)
        self.factor = rng.integers(1, 2**63, COORDINATES, dtype=U64) * U64(2) + U64(1)
        self.offset = rng.integers(0, 2**63, COORDINATES, dtype=U64)

    def sets(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Sorted distinct shingle hashes, text after text, and how many each text has."""
        data, offsets = text_bytes(column)
        data = lower_ascii(data)
        starts, ends = word_starts_ends(self.word[data], offsets)
        words = self.hash.slices(self.hash.prefix(data), starts, ends)
        first = np.searchsorted(starts, offsets)
        counts = np.diff(first)
        # Texts of a few words get their own hash, of the whole sequence; all others every window inside the text.
        shingles = shingle_hashes(words, SHINGLE)
        windows = np.maximum(counts - SHINGLE + 1, 0)
        owner = np.repeat(np.arange(len(counts)), windows)
        values = shingles[np.repeat(first[:-1] - (np.cumsum(windows) - windows), windows) + np.arange(int(windows.sum()))]
        short = np.flatnonzero((counts > 0) & (counts < SHINGLE))
        whole = np.array([shingle_hashes(words[first[i] : first[i + 1]], int(counts[i]))[0] + U64(counts[i]) for i in short], U64)
        owner, values = np.concatenate([owner, short]), np.concatenate([values, whole])
        order = np.lexsort((values, owner))
        owner, values = owner[order], values[order]
        new = np.ones(len(values), bool)
        new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
        return values[new], np.bincount(owner[new], minlength=len(counts))

    def signatures(self, values: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Minimum hash of every coordinate of each set that is not empty."""
        heads = (np.cumsum(counts) - counts)[counts > 0]
        out = np.empty((len(heads), COORDINATES), U64)
        for k in range(COORDINATES if len(heads) else 0):
            x = values * self.factor[k] + self.offset[k]
            out[:, k] = np.minimum.reduceat(x ^ (x >> U64(32)), heads)
        return mixed(out * U64(COORDINATES) + np.arange(COORDINATES, dtype=U64))


def shingled(frame: DataFrame) -> DataFrame:
    """``doc_id``, ``n``, two hashes of the set and ``posts``, the signature with each value mixed with its coordinate."""
    def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        shingler = kept_in_worker("shingler", Shingler)
        for part in text_slices(batch):
            values, counts = shingler.sets(part.column("text"))
            full = counts > 0
            heads = (np.cumsum(counts) - counts)[full]
            sums = np.zeros((2, len(counts)), U64)
            if len(heads):
                sums[0, full] = np.add.reduceat(mixed(values), heads)
                sums[1, full] = np.add.reduceat(mixed(values ^ U64(0xA5A5A5A5A5A5A5A5)), heads)
            posts = shingler.signatures(values, counts).view(np.int64).ravel()
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(counts.astype(np.int64)), pa.array(sums[0].view(np.int64)), pa.array(sums[1].view(np.int64)), list_array(pa.array(posts), np.where(full, COORDINATES, 0))],
                ["doc_id", "n", "h1", "h2", "posts"],
            )

    return map_batches(frame, step, "doc_id long, n long, h1 long, h2 long, posts array<long>")


def shingle_sets(frame: DataFrame) -> DataFrame:
    """``doc_id`` and its ``shingles``."""
    def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        shingler = kept_in_worker("shingler", Shingler)
        for part in text_slices(batch):
            values, counts = shingler.sets(part.column("text"))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), list_array(pa.array(values.view(np.int64)), counts)], ["doc_id", "shingles"])

    return map_batches(frame, step, "doc_id long, shingles array<long>")


def needed(n: Column, m: Column) -> Column:
    """Shingles that sets of these sizes must share: overlap >= s / (1 + s) * (n + m), in whole numbers."""
    return F.ceil(SIMILARITY * (n + m) / F.lit(100.0 + SIMILARITY) - 1e-9)


def components(links: DataFrame, name: str) -> DataFrame:
    """``node`` and the smallest node reachable, for every node of the links ``a``-``b``: large and small stars until each
    component is one star.

    Minima are combined before they are sent; the join with a hub's minimum may be split, as it adds one value a row."""
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    while True:
        edges = written(edges, f"{name}-edges")
        ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("below"), F.lit(0).alias("root"))
        ends = ends.union(edges.select("v", F.lit(0), F.lit(1))).groupBy("node").agg(F.sum("below").alias("below"), F.max("root").alias("root"))
        if ends.where("below > 1 OR (below = 1 AND root = 1)").isEmpty():
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select("v", "v").distinct())
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = written(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), f"{name}-large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = small.union(least.select("u", "m")).where("u <> v").distinct()


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs ``a``, ``b`` with enough collisions whose full sets are similar enough."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("shared").alias("sa"), F.col("signature").alias("ga"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("shared").alias("sb"), F.col("signature").alias("gb"))
    common = F.size(F.array_intersect("sa", "sb"))
    similar = 100 * common >= SIMILARITY * (F.col("na") + F.col("nb") - common)
    return pairs.join(left, "a").join(right, "b").where(F.when(F.size(F.array_intersect("ga", "gb")) >= MATCHES, similar).otherwise(False)).select("a", "b", "ca", "cb")


def candidate_sets(frame: DataFrame, classes: DataFrame) -> DataFrame:
    """The classes that may have a partner: ``n``, their ``shared`` shingles, ``signature`` and ``prefix`` of rare posts."""
    posted = classes.select("doc_id", "n", F.explode("posts").alias("post"))
    rarity = posted.groupBy("post").agg(F.count("*").alias("rarity")).where("rarity > 1")
    candidates = posted.join(rarity, "post").groupBy("doc_id").agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("rarity", "post"))).alias("common"))
    candidates = written(candidates.where(F.size("common") >= MATCHES), "candidates")

    single = written(shingle_sets(frame.join(candidates.select("doc_id"), "doc_id", "left_semi")).select("doc_id", F.explode("shingles").alias("shingle")), "shingles")
    common = single.groupBy("shingle").agg(F.count("*").alias("c")).where("c > 1").select("shingle")
    shared = single.join(common, "shingle").groupBy("doc_id").agg(F.array_distinct(F.collect_list("shingle")).alias("shared"))
    sets = candidates.join(shared, "doc_id").where(100 * F.size("shared") >= SIMILARITY * F.col("n"))
    signature = F.transform("common", lambda x: x["post"])
    # Coordinates that no other class has are the rarest of all, so they fill the first places of the prefix.
    places = F.greatest(F.lit(0), F.size("common") - MATCHES + 1)
    return written(sets.select("doc_id", "n", "shared", F.size("shared").alias("e"), signature.alias("signature"), F.slice(signature, F.lit(1), places).alias("prefix")), "sets")


def round_pairs(posts: DataFrame, sets: DataFrame, turn: int) -> DataFrame:
    """Pairs of different components to be compared in this round, each once."""
    close = (
        (F.col("x.post") == F.col("y.post"))
        & (F.col("x.component") != F.col("y.component"))
        & (100 * F.least("x.n", "y.n") >= SIMILARITY * F.greatest("x.n", "y.n"))
        & (F.least("x.e", "y.e") >= needed(F.col("x.n"), F.col("y.n")))
    )
    if turn < PIVOT_ROUNDS:
        edited = F.when(F.lit(turn) == 0, (F.col("n") - F.col("e")) / F.col("n")).otherwise(F.floor(25 * (F.col("n") - F.col("e")) / F.col("n")).cast("double"))
        pivot = F.min(F.struct(edited.alias("edited"), F.xxhash64(F.lit(turn), "doc_id").alias("order"), "doc_id", "component", "n", "e"))
        pivots = posts.groupBy("post").agg(pivot.alias("pivot"), F.min("component").alias("low"), F.max("component").alias("high"))
        pairs = posts.alias("x").join(pivots.where("low <> high").select("post", "pivot.*").alias("y"), close)
    else:
        sizes = posts.groupBy("post", "component").agg(F.count("*").alias("size"))
        largest = sizes.groupBy("post").agg(F.max(F.struct("size", "component")).alias("top"), F.count("*").alias("parts")).where("parts > 1")
        several = posts.join(largest.select("post", F.col("top.component").alias("top")), "post").join(sets.select("doc_id", "prefix", "signature"), "doc_id")
        several = written(several, "open-posts")
        once = F.element_at(F.array_intersect("x.prefix", "y.prefix"), 1) == F.col("x.post")
        minor = (F.col("y.component") == F.col("y.top")) | (F.col("x.doc_id") < F.col("y.doc_id"))
        pairs = several.where("component <> top").alias("x").join(several.alias("y"), close & minor & once & (F.size(F.array_intersect("x.signature", "y.signature")) >= MATCHES))
    first = F.col("x.doc_id") < F.col("y.doc_id")
    side = lambda name: (F.when(first, F.col(f"x.{name}")).otherwise(F.col(f"y.{name}")), F.when(first, F.col(f"y.{name}")).otherwise(F.col(f"x.{name}")))
    (a, b), (ca, cb) = side("doc_id"), side("component")
    return pairs.select(a.alias("a"), b.alias("b"), ca.alias("ca"), cb.alias("cb")).distinct()


def linked(frame: DataFrame) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` and ``kept`` for every row of ``frame`` (``doc_id``, ``text``)."""
    frame = frame.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    docs = written(shingled(frame), "signatures")
    classes = docs.where("n > 0 AND doc_id IS NOT NULL").groupBy("h1", "h2", "n").agg(F.min(F.struct("doc_id", "posts")).alias("first"))
    classes = written(classes.select("h1", "h2", F.col("first.doc_id").alias("doc_id"), "n", "first.posts"), "classes")
    sets = candidate_sets(frame, classes)
    posted = sets.select("doc_id", "n", "e", F.explode("prefix").alias("post"))
    label = sets.select("doc_id", F.col("doc_id").alias("component"))
    for turn in range(PIVOT_ROUNDS + 1):
        posts = written(posted.join(label, "doc_id"), "posts")
        found = written(confirmed(round_pairs(posts, sets, turn), sets), "links")
        if found.isEmpty():
            continue
        merged = components(found.select(F.col("ca").alias("a"), F.col("cb").alias("b")), f"turn{turn}").withColumnRenamed("component", "root")
        label = label.join(merged, label.component == merged.node, "left").select("doc_id", F.coalesce("root", "component").alias("component"))
        label = written(label, "labels")

    roots = classes.join(label, "doc_id", "left").select("h1", "h2", "n", F.coalesce("component", "doc_id").alias("component_id"))
    out = docs.select("doc_id", "n", "h1", "h2").join(roots, ["h1", "h2", "n"], "left")
    out = out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(table(spark, sf_dir, "documents"))
