"""Operator 9 against brute force over all windows."""

import hashlib
import random
import re

from stakewatch.llm.decontaminate import contaminated, op9_decontaminate


def words(text):
    folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", folded)


def brute_force(docs, items):
    wanted = {}
    for item, text in items:
        w = words(text)
        size = min(13, len(w))
        for i in range(len(w) - size + 1 if size else 0):
            wanted.setdefault(tuple(w[i : i + size]), set()).add(item)
    sizes = {len(x) for x in wanted}
    out = []
    for key, text in docs:
        w, hit, found = words(text), set(), set()
        for size in sizes:
            for i in range(len(w) - size + 1):
                if (window := tuple(w[i : i + size])) in wanted:
                    hit.update(range(i, i + size))
                    found |= wanted[window]
        out.append((key, len(w), len(hit), sorted(map(str, found)), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out)


def test_planted_passages(spark):
    rnd = random.Random(9)
    vocabulary = [f"w{i}" for i in range(40)] + ["É", "ñandú", "x", "y9"]
    some = lambda n: [rnd.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(some(rnd.choice([1, 2, 3, 5, 12, 13, 14, 20, 40])))) for i in range(30)]
    items += [(100, None), (101, " ?! "), (102, items[3][1].upper()), (3, items[4][1]), (103, "one one one one one one one one one one one one one one")]
    docs = []
    for i in range(120):
        parts = some(rnd.randint(0, 120))
        for _ in range(rnd.randint(0, 3)):
            item = words(rnd.choice(items)[1])
            cut = rnd.randint(0, 4)
            parts += (item[cut:] if rnd.random() < 0.4 else item) + some(rnd.randint(0, 9))
        docs.append((i, " ".join(parts).replace(" ", rnd.choice([" ", ", ", "\n"]))))
    docs += [(200, None), (201, ""), (202, "..."), (5, docs[5][1]), (203, "one " * 40), (204, "ONE-one")]
    frame = spark.createDataFrame([(k, t, "k", 1) for k, t in docs], "doc_id long, text string, key string, row int").repartition(4)
    got = sorted(tuple(row) for row in contaminated(frame, spark.createDataFrame(items, "item_id long, text string")).collect())
    assert got == brute_force(docs, items)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert contaminated(docs.limit(0), items).count() == 0
    assert [tuple(row) for row in contaminated(docs, items.limit(0)).collect()] == [(1, 3, 0, [], False)]


def test_query(spark, sf_dir):
    read = lambda name: [tuple(row) for row in spark.read.parquet(f"{sf_dir}/{name}.parquet").select("doc_id" if name == "documents" else "item_id", "text").collect()]
    want = [(k, n, h, len(i), hashlib.sha256(",".join(i).encode()).hexdigest(), c) for k, n, h, i, c in brute_force(read("documents"), read("benchmark"))]
    got = sorted(tuple(row) for row in op9_decontaminate(spark, sf_dir).collect())
    assert got == want
    assert any(row[-1] for row in got)
