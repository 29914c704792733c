"""Operator 12 against a plain Merkle tree."""

import random
import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from stakewatch.llm import merkle_manifest as op
from stakewatch.llm.merkle_manifest import descended, folded, levels, op12_merkle_manifest

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, tree string, rank int"


def h(parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    return h(["-" if x is None else f"{len(str(x).encode())}:{x}" for x in row])


def climb(nodes):
    """All levels of the tree over ``nodes``."""
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(out[-1][i : i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def siblings_of(tree, at):
    return [level[(at >> lv) ^ 1] for lv, level in enumerate(tree[:-1]) if (at >> lv) ^ 1 < len(level)]


def fold_of(tree, at, node):
    for lv, level in enumerate(tree[:-1]):
        place = at >> lv
        pair = sorted([(place, node), *([(place ^ 1, level[place ^ 1])] if place ^ 1 < len(level) else [])])
        node = h([x for _, x in pair])
    return node


def brute_force(rows):
    """rows: (doc_id, source, lang, n_chars, text)."""
    order = lambda x: (x is not None, x if x is not None else 0)
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    members = {lang: sorted((r for r in rows if r[2] == lang), key=lambda r: (order(r[0]), leaf_of(r))) for lang in langs}
    trees = {lang: climb([leaf_of(r) for r in members[lang]]) for lang in langs}
    top = climb([trees[lang][-1][0] for lang in langs]) if langs else []
    out = []
    for at, lang in enumerate(langs):
        for i, row in enumerate(members[lang]):
            changed = row[0] is not None and row[3] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0
            claimed = leaf_of((*row[:3], row[3] + 1, row[4])) if changed else leaf_of(row)
            proof = siblings_of(trees[lang], i) + siblings_of(top, at)
            end = fold_of(top, at, fold_of(trees[lang], i, claimed))
            out.append((row[0], leaf_of(row), trees[lang][-1][0], top[-1][0], h(proof), end, end == top[-1][0]))
    return sorted(out, key=str)


def run(spark, rows, tmp_path, monkeypatch):
    frame = spark.createDataFrame([(*r, "t", 5) for r in rows], SCHEMA)
    monkeypatch.setattr(op, "table", lambda *_: frame)
    return sorted((tuple(r) for r in op12_merkle_manifest(spark, "").collect()), key=str)


def documents(rnd, count, langs):
    return [(i * 3, rnd.choice(["a", "b", None]), rnd.choice(langs), rnd.choice([None, 0, 7, 120]), rnd.choice([None, "", "été \U0001f600", "x" * rnd.randint(1, 50)])) for i in range(count)]


def test_segment_descends_to_every_leaf():
    for count in (1, 2, 3, 5, 8, 13):
        leaves = [h([str(i)]) for i in range(count)]
        tree = climb(leaves)
        found = levels(leaves, len(tree) - 1)
        assert found == tree
        records = ["".join(level) for level in reversed(found[:-1])]
        for i in range(count):
            node, path = descended(records, i)
            assert path[::-1] == siblings_of(tree, i) and (node == leaves[i] or count == 1)
            assert folded(leaves[i], i, count, path[::-1]) == (tree[-1][0], len(path))


@pytest.mark.parametrize("segment", [10, 2, 1])
def test_trees_of_all_sizes(spark, monkeypatch, tmp_path, segment):
    monkeypatch.setattr(op, "SEGMENT", segment)
    rnd = random.Random(segment)
    rows = documents(rnd, 90, ["en"] * 8 + ["de", "fr", None, ""])
    rows += [(1000 + i, "s", f"l{i}", 1, "one") for i in range(6)]
    assert run(spark, rows, tmp_path, monkeypatch) == brute_force(rows)


def test_odd_rows(spark, monkeypatch, tmp_path):
    rows = [(None, None, None, None, None), (None, "a", "en", 3, "x"), (5, "a", "en", 3, "x"), (5, "a", "en", 3, "x"), (5, "a", "en", 3, "y"), (14, "a", "é", 2**63 - 1, ""), (1, "a", "Z", 0, "long " * 400_000)]
    rows += [(i, "a", "Z", 2**63 - 1, "t") for i in range(2, 20)]
    assert run(spark, rows, tmp_path, monkeypatch) == brute_force(rows)


def test_one_and_none(spark, monkeypatch, tmp_path):
    assert run(spark, [(1, "a", "en", 1, "t")], tmp_path, monkeypatch) == brute_force([(1, "a", "en", 1, "t")])
    assert run(spark, [], tmp_path, monkeypatch) == []


def test_proofs_verify_on_their_own(spark):
    leaves = spark.range(23).select(F.lit("=x").alias("tree"), F.col("id").alias("doc_id"), F.sha2(F.col("id").cast("string"), 256).alias("leaf"), F.col("id").alias("rank"), F.lit(23).cast("long").alias("n"))
    got = op.proofs(leaves).collect()
    assert len(got) == 23 and all(r.verified for r in got)
    for r in got:
        assert folded(r.leaf, r.doc_id, 23, [r.proof[i : i + 64] for i in range(0, len(r.proof), 64)])[0] == r.root


def test_query(spark, sf_dir):
    rows = [(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = sorted((tuple(r) for r in op12_merkle_manifest(spark, sf_dir).collect()), key=str)
    assert got == brute_force(rows) and 0 < sum(not r[-1] for r in got) < len(got) / 3
