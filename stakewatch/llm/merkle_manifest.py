"""Operator 12: a Merkle manifest of a table as a content-addressed graph, and proofs by descent.

1. **Leaves** are digests of the rows' values, made by built-in functions. Per tree (language) they get ranks: rows
   are range-partitioned by (tree, id), numbered inside their partition, and shifted by the counts of the partitions before.
2. **Records.** ``2^SEGMENT`` consecutive nodes of one level make a segment, whatever the size of the tree, and climb
   ``SEGMENT`` levels in one step. Every inner node is a record, digest to children; the records of a segment are kept together
   under its top digest. Tops are the nodes of the next round, until each tree has one. The subroots, ordered by tree, form one
   more tree of the same kind.
3. **Descent.** Requests go down from the root by the binary digits of their ranks, a segment at a time: at each record
   the digit names the child to go to, and the other child, if any, joins the path. Requests of all leaves below one segment
   descend as one request down to it, so no record is asked by more than ``2^SEGMENT`` requests and a
   tree with a third of all rows is as many groups as it has segments. The segments' paths, reversed, are the proof.

Defined results: null values count as ``-``, empty ones as ``0:``; texts of any length are hashed whole; rows of an id that
repeats are ordered by their digest, equal rows get proofs of their own; rows without an id come first and are not
tampered with; a null language is the first tree, an empty one the next; an empty table gives an empty result; other columns
are not part of a leaf. Digests of equal subtrees are one record, as their children are equal.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stakewatch.llm.common import table, written

#: Log2 of the nodes that meet in one segment.
SEGMENT = 10
#: The rows that the query tampers with.
TAMPERED_EACH = 7
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Characters of a digest.
HEX = 64


def field(value: Column) -> Column:
    """A value as its length in bytes, a colon and itself, or ``-``."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(values: list[Column]) -> Column:
    return F.sha2(F.concat(*(field(value) for value in values)), 256)


def tree_key(lang: Column) -> Column:
    """Sorts as the languages do bytewise, null first."""
    return F.coalesce(F.concat(F.lit("="), lang), F.lit("-"))


def ranked(frame: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Adds ``rank`` inside ``tree`` (from 0, by ``keys``) and ``n``, the tree's rows. ``frame`` is a written table."""
    spark = frame.sparkSession
    columns = frame.columns
    spread = frame.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "tree", *keys).sortWithinPartitions("tree", *keys)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, tree, seen = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            at = np.empty(batch.num_rows, np.int64)
            trees = batch.column("tree").dictionary_encode()
            codes, names = trees.indices.to_numpy(zero_copy_only=False), trees.dictionary.to_pylist()
            starts = np.flatnonzero(np.diff(codes, prepend=-1))
            for start, end in zip(starts.tolist(), [*starts[1:].tolist(), len(codes)], strict=True):
                seen = seen if names[codes[start]] == tree else 0
                tree = names[codes[start]]
                at[start:end] = np.arange(seen, seen + end - start)
                seen += end - start
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(batch.num_rows, part, np.int64)), pa.array(at)], [*columns, "part", "at"])

    schema = frame.schema.add("part", "long").add("at", "long")
    numbered = written(spread.mapInArrow(number, schema), name)
    counts = numbered.groupBy("tree", "part").agg(F.count("*").alias("rows"))
    before = F.sum("rows").over(Window.partitionBy("tree").orderBy("part")) - F.col("rows")
    counts = counts.select("tree", "part", before.alias("before"), F.sum("rows").over(Window.partitionBy("tree")).alias("n"))
    return numbered.join(counts, ["tree", "part"]).select(*columns, (F.col("before") + F.col("at")).alias("rank"), "n")


def digest(children: list[str]) -> str:
    return sha256("".join(children).encode()).hexdigest()


def levels(nodes: list[str], height: int) -> list[list[str]]:
    """The nodes of a segment, level by level, until ``height`` levels are climbed."""
    out = [nodes]
    for _ in range(height):
        nodes = [digest(nodes[i : i + 2]) for i in range(0, len(nodes), 2)]
        out.append(nodes)
    return out


def segments(nodes: DataFrame, name: str) -> DataFrame:
    """Records of one round: ``tree``, ``segment``, ``top``, the children of all inner nodes as ``records`` (from the level
    below the top down, each level's digests one after the other), ``n`` and ``climbed``."""

    def build(group: pa.Table) -> pa.Table:
        order = np.argsort(group["rank"].to_numpy())
        below = group["digest"].take(pa.array(order)).to_pylist()
        n, rank = group["n"][0].as_py(), int(group["rank"].to_numpy().min())
        # A tree of one segment ends where one node is left, others climb the whole height.
        height = min(SEGMENT, (n - 1).bit_length())
        found = levels(below, height)
        records = ["".join(level) for level in reversed(found[:-1])]
        return pa.table({"tree": [group["tree"][0].as_py()], "segment": [rank >> SEGMENT], "top": [found[-1][0]], "records": [records], "n": [n]}, schema=pa.schema([("tree", pa.string()), ("segment", pa.int64()), ("top", pa.string()), ("records", pa.list_(pa.string())), ("n", pa.int64())]))

    keyed = nodes.select("tree", "rank", "digest", "n").withColumn("segment", F.shiftright("rank", SEGMENT))
    made = keyed.groupBy("tree", "segment").applyInArrow(build, "tree string, segment long, top string, records array<string>, n long")
    return written(made, name)


def forest(nodes: DataFrame, name: str) -> list[DataFrame]:
    """Records of all rounds, the first for ``nodes`` (``tree``, ``rank``, ``digest``, ``n``), the last with one segment a tree."""
    rounds = []
    most = nodes.agg(F.coalesce(F.max("n"), F.lit(0)).alias("n")).first().n
    while True:
        found = segments(nodes, f"{name}-{len(rounds)}")
        rounds.append(found)
        if most <= 1 << SEGMENT:
            return rounds
        most = -(-most >> SEGMENT)
        # Trees that are done stay a single node, which is not climbed any further.
        nodes = found.select("tree", F.col("segment").alias("rank"), F.col("top").alias("digest"), F.ceil(F.col("n") / (1 << SEGMENT)).cast("long").alias("n"))


def descended(records: list[str], place: int) -> tuple[str, list[str]]:
    """The node at ``place`` below a segment's top, and the unselected children on the way, from the top down."""
    node, path = 0, []
    for depth, level in enumerate(records, 1):
        node = 2 * node + (place >> (len(records) - depth) & 1)
        other = node ^ 1
        if other * HEX < len(level):
            path.append(level[other * HEX : (other + 1) * HEX])
    return (records[-1][node * HEX : (node + 1) * HEX] if records else ""), path


def opened(records: DataFrame, tops: DataFrame) -> DataFrame:
    """Segments whose top digest was reached: their records, met by digest, with the path that led there. ``records`` may
    hold equal segments of several trees, of which any one serves."""
    once = records.groupBy("top").agg(F.first("records").alias("records"))
    return tops.join(once, "top")


def below(segment: DataFrame, requests: DataFrame, carried: list[str]) -> DataFrame:
    """Requests (``tree``, ``child``) one segment further down: ``tree``, ``segment`` (the child), its ``top`` and ``path``."""
    schema = pa.schema([("tree", pa.string()), ("segment", pa.int64()), ("top", pa.string()), ("path", pa.string()), *((c, pa.string()) for c in carried)])

    def step(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {c: [] for c in schema.names}
        for at in left.to_pylist():
            for child in right["child"].to_pylist():
                top, path = descended(at["records"], child & ((1 << SEGMENT) - 1))
                values = [at["tree"], child, top or at["top"], at["path"] + "".join(path), *(at[c] for c in carried)]
                for c, value in zip(schema.names, values, strict=True):
                    out[c].append(value)
        return pa.table(out, schema=schema)

    asked = requests.withColumn("segment", F.shiftright("child", SEGMENT))
    ddl = "tree string, segment long, top string, path string" + "".join(f", {c} string" for c in carried)
    return segment.groupBy("tree", "segment").cogroup(asked.groupBy("tree", "segment")).applyInArrow(step, ddl)


def descent(rounds: list[DataFrame], tops: DataFrame, requests: DataFrame, carried: list[str], name: str) -> DataFrame:
    """Opened bottom segments that hold the requested ranks. ``tops`` has ``tree``, ``top``, ``path`` and carried columns."""
    at = tops.withColumn("segment", F.lit(0).cast("long"))
    for number in range(len(rounds) - 1, 0, -1):
        wanted = requests.select("tree", F.shiftright("rank", SEGMENT * number).alias("child")).distinct()
        at = written(below(opened(rounds[number], at), wanted, carried), f"{name}-{number}")
    return opened(rounds[0], at)


def manifest(leaves: DataFrame) -> tuple[list[DataFrame], list[DataFrame], DataFrame]:
    """Records of the trees, records of the tree above them, and the ``subroots`` (``tree``, ``rank``, ``digest``, ``n``)."""
    rounds = forest(leaves.withColumnRenamed("leaf", "digest"), "records")
    last = rounds[-1].select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("top").alias("digest"))
    subroots = written(ranked(written(last, "subroots"), ["name"], "subroot-ranks"), "ranked-subroots")
    return rounds, forest(subroots, "top-records"), subroots


def folded(start: str, place: int, n: int, siblings: list[str]) -> tuple[str, int]:
    """Root of a tree of ``n`` nodes from one node and its siblings, and how many of them it took."""
    used = 0
    while n > 1:
        if place ^ 1 < n:
            other = siblings[used]
            used += 1
            start = digest([other, start] if place & 1 else [start, other])
        else:
            start = digest([start])
        place, n = place >> 1, (n + 1) >> 1
    return start, used


def proofs(leaves: DataFrame, claimed: str = "leaf") -> DataFrame:
    """``doc_id``, ``leaf``, ``subroot``, ``root``, ``proof`` (siblings from the leaf up), ``proof_sha256``, ``folded_root`` (from the
    ``claimed`` leaf) and ``verified`` for every row of ``leaves`` (``tree``, ``doc_id``, ``leaf``, ``rank``, ``n``)."""
    rounds, top_rounds, subroots = manifest(leaves)
    root = top_rounds[-1].select("tree", "top", F.lit("").alias("path"), F.col("top").alias("root"))
    bottom = descent(top_rounds, root, subroots, ["root"], "top-paths")
    reached = below(bottom, subroots.withColumn("child", F.col("rank")), ["root"])
    # The reached node of the upper tree is the subroot; its name and its place come from the rank that was asked for.
    names = subroots.select("name", F.col("rank").alias("segment"), F.col("n").alias("trees"))
    tops = written(reached.drop("tree").join(names, "segment").select(F.col("name").alias("tree"), "top", "path", "root", F.col("top").alias("subroot"), F.concat_ws(":", "segment", "trees").alias("place")), "subroot-paths")
    found = descent(rounds, tops, leaves, ["root", "subroot", "place"], "paths")
    schema = pa.schema([("doc_id", pa.int64()), *((c, pa.string()) for c in ("leaf", "subroot", "root", "proof", "proof_sha256", "folded_root")), ("verified", pa.bool_())])

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        for at in left.to_pylist():
            upper = [at["path"][i : i + HEX] for i in range(0, len(at["path"]), HEX)]
            place, trees = map(int, at["place"].split(":"))
            for row in right.to_pylist():
                _, path = descended(at["records"], row["rank"] & ((1 << SEGMENT) - 1))
                siblings = (upper + path)[::-1]
                start, used = folded(row["claimed"], row["rank"], row["n"], siblings)
                end, _ = folded(start, place, trees, siblings[used:])
                proof = "".join(siblings)
                out.append((row["doc_id"], row["leaf"], at["subroot"], at["root"], proof, sha256(proof.encode()).hexdigest(), end, end == at["root"]))
        return pa.table([list(x) for x in zip(*out, strict=True)] if out else [[] for _ in schema], schema=schema)

    rows = leaves.select("tree", F.shiftright("rank", SEGMENT).alias("segment"), "doc_id", "leaf", F.col(claimed).alias("claimed"), "rank", "n")
    ddl = "doc_id long, leaf string, subroot string, root string, proof string, proof_sha256 string, folded_root string, verified boolean"
    return found.groupBy("tree", "segment").cogroup(rows.groupBy("tree", "segment")).applyInArrow(finish, ddl)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*FIELDS)
    changed = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPERED_EACH == 0, F.lit(False))
    more = (F.col("n_chars").cast("decimal(20,0)") + 1).cast("decimal(20,0)")
    honest, tampered = ([more if name == "n_chars" and change else F.col(name) for name in FIELDS] for change in (False, True))
    claimed = F.when(changed, leaf(tampered))
    leaves = docs.select(tree_key(F.col("lang")).alias("tree"), F.col("doc_id").cast("long").alias("doc_id"), leaf(honest).alias("leaf"), claimed.alias("changed"))
    leaves = ranked(written(leaves, "leaves"), ["doc_id", "leaf"], "leaf-ranks")
    leaves = written(leaves.withColumn("claimed", F.coalesce("changed", "leaf")).drop("changed"), "ranked-leaves")
    return proofs(leaves, "claimed").drop("proof")


ORACLE_SQL = f"""
WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
d AS (SELECT doc_id, lang, n_chars, n_chars IS NOT NULL AND xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) % 256) + 1])), 4294967295) % {TAMPERED_EACH} = 0 AS changed,
  coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head,
  coalesce(strlen(text) || ':' || text, '-') AS tail FROM documents, crc),
l AS (SELECT doc_id, lang, sha256(head || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || tail) AS leaf,
  sha256(head || coalesce(strlen((n_chars + changed::INTEGER)::VARCHAR) || ':' || (n_chars + changed::INTEGER), '-') || tail) AS claimed FROM d),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS rank, count(*) OVER (PARTITION BY lang) AS n FROM l),
up AS (SELECT 0 AS lv, lang, rank AS pos, n, leaf AS digest FROM r
  UNION ALL SELECT lv + 1, lang, pos // 2, (n + 1) // 2, sha256(string_agg(digest, '' ORDER BY pos)) FROM up WHERE n > 1 GROUP BY lv, lang, pos // 2, n),
sub AS (SELECT lang, digest, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS place, count(*) OVER () AS trees FROM up WHERE n = 1),
top AS (SELECT 0 AS lv, place AS pos, trees AS n, digest FROM sub
  UNION ALL SELECT lv + 1, pos // 2, (n + 1) // 2, sha256(string_agg(digest, '' ORDER BY pos)) FROM top WHERE n > 1 GROUP BY lv, pos // 2, n),
way AS (SELECT doc_id, r.lang, place, trees, rank, r.n, leaf, claimed, digest AS subroot, (SELECT digest FROM top WHERE n = 1) AS root FROM r JOIN sub ON r.lang IS NOT DISTINCT FROM sub.lang),
step AS (SELECT w.doc_id, w.leaf, up.lv AS lv, up.digest, (up.pos % 2) = 0 AS before FROM way w JOIN up ON w.lang IS NOT DISTINCT FROM up.lang AND up.pos = xor(w.rank >> up.lv, 1)
  UNION ALL SELECT w.doc_id, w.leaf, 1000 + top.lv, top.digest, (top.pos % 2) = 0 FROM way w JOIN top ON top.pos = xor(w.place >> top.lv, 1)),
proof AS (SELECT doc_id, leaf, sha256(string_agg(digest, '' ORDER BY lv)) AS proof_sha256 FROM step GROUP BY doc_id, leaf),
fold AS (SELECT doc_id, leaf, 0 AS lv, n, claimed AS digest FROM way
  UNION ALL SELECT f.doc_id, f.leaf, f.lv + 1, (f.n + 1) // 2, sha256(CASE WHEN s.digest IS NULL THEN f.digest WHEN s.before THEN s.digest || f.digest ELSE f.digest || s.digest END)
    FROM fold f LEFT JOIN step s ON f.doc_id = s.doc_id AND f.leaf = s.leaf AND f.lv = s.lv WHERE f.n > 1),
fold2 AS (SELECT w.doc_id, w.leaf, 1000 AS lv, w.trees AS n, f.digest FROM way w JOIN fold f ON w.doc_id = f.doc_id AND w.leaf = f.leaf AND f.n = 1
  UNION ALL SELECT f.doc_id, f.leaf, f.lv + 1, (f.n + 1) // 2, sha256(CASE WHEN s.digest IS NULL THEN f.digest WHEN s.before THEN s.digest || f.digest ELSE f.digest || s.digest END)
    FROM fold2 f LEFT JOIN step s ON f.doc_id = s.doc_id AND f.leaf = s.leaf AND f.lv = s.lv WHERE f.n > 1)
SELECT w.doc_id, w.leaf, subroot, root, coalesce(proof_sha256, sha256('')) AS proof_sha256, f.digest AS folded_root, f.digest = root AS verified
FROM way w JOIN fold2 f ON w.doc_id = f.doc_id AND w.leaf = f.leaf AND f.n = 1 LEFT JOIN proof p ON w.doc_id = p.doc_id AND w.leaf = p.leaf
"""
