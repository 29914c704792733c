"""Operator 10 against brute force over all pairs."""

import random
import re

from stakewatch.llm.near_dedup import components, linked, op10_minhash


def shingles(text):
    folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", folded)
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def brute_force(rows):
    sets = {key: shingles(text) for key, text in rows}
    root = {key: key for key in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    by_shingle = {}
    for key, found in sets.items():
        for s in found:
            by_shingle.setdefault(s, []).append(key)
    near = {}
    for keys in by_shingle.values():
        for i, a in enumerate(keys):
            for b in keys[i + 1 :]:
                near[a, b] = near.get((a, b), 0) + 1
    for (a, b), common in near.items():
        if 100 * common >= 85 * (len(sets[a]) + len(sets[b]) - common):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {key: (key, len(found), find(key), find(key) == key) for key, found in sets.items()}


def family(rnd, words, size, edits):
    base = [rnd.choice(words) for _ in range(size)]
    for _ in range(rnd.randint(0, edits)):
        base[rnd.randrange(size)] = rnd.choice(words)
    return base


def test_families_against_brute_force(spark):
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(3000)]
    rows = []
    for _ in range(25):
        base = [rnd.choice(words) for _ in range(rnd.randint(3, 160))]
        for _ in range(rnd.randint(1, 12)):
            copy = list(base)
            for _ in range(rnd.randint(0, 5)):
                copy[rnd.randrange(len(copy))] = rnd.choice(words)
            rows.append(" ".join(copy))
    passage = " ".join(rnd.choice(words) for _ in range(80))
    rows += [f"{passage} " + " ".join(rnd.choice(words) for _ in range(rnd.randint(1, 30))) for _ in range(60)]
    rows += ["", None, " \t\n", "One two", "one TWO", "one  two\n", "\u00c9 a b c d e", "\u00e9 a b c d e", rows[0], rows[1].upper()]
    rnd.shuffle(rows)
    rows = list(enumerate(rows))
    frame = spark.createDataFrame([(key, text, 1, "x") for key, text in rows], "doc_id long, text string, n int, post string")
    got = {row.doc_id: tuple(row) for row in linked(frame).collect()}
    assert got == brute_force(rows)


def test_chain_of_components(spark):
    rnd = random.Random(4)
    nodes = list(range(60))
    rnd.shuffle(nodes)
    links = spark.createDataFrame([(a, b) for a, b in zip(nodes[:40], nodes[1:40])] + [(nodes[50], nodes[51])], "a long, b long")
    got = {row.node: row.component for row in components(links, "chain").collect()}
    assert got == {**{n: min(nodes[:40]) for n in nodes[:40]}, **{n: min(nodes[50:52]) for n in nodes[50:52]}}


def test_empty_table(spark):
    assert linked(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query(spark, sf_dir):
    rows = [(row.doc_id, row.text) for row in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = {row.doc_id: tuple(row) for row in op10_minhash(spark, sf_dir).collect()}
    assert got == brute_force(rows)
