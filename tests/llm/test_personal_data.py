"""Operator 6: the base patterns against plain regular expressions, the added spans on planted secrets."""

import hashlib
import random
import re

import numpy as np

from stakewatch.llm.personal_data import BASE_KINDS, base_spans, luhn, op6_personal_data, personal_spans, reliabilities


def plain(text):
    out = []
    for kind, pattern in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(p) > 255 for p in m.group().split(".")) or kind == "card" and not (12 <= len(digits) <= 19 and luhn(digits)) or kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), BASE_KINDS.index(kind), m.end()))
    return sorted(out)


def test_base_patterns():
    rnd = random.Random(2)
    parts = ["a", "b.c", "@", "@", ".", "-", "_", " ", "1", "23", "255", "256", "0001.2.3.4", "4111 1111 1111 1111", "+1 (555) 010-9999", "+", "é", "x@y.z", "%", "4111-1111-1111-1112", "12.13.14.15"]
    for _ in range(4000):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 25)))
        assert base_spans(text) == plain(text), text
    assert base_spans("a" * 200_000 + "@" * 1000 + "1" * 5000) == []


def test_reliable_labelers_are_believed():
    votes = np.array([[1, 1, 0], [1, 1, -1], [-1, -1, 1], [-1, -1, 0], [1, -1, 1]])
    right, given = reliabilities(votes, np.array([400.0, 300, 500, 200, 3]))
    assert right[0] > 0.9 and right[2] < 0.1
    assert given[0, 1, 2] > 0.9


def test_added_spans_and_awkward_rows(spark):
    rnd = random.Random(8)
    rows = [(i, f'é text {"".join(rnd.choice("word") for _ in range(20))} password={"".join(rnd.choice("0123456789abcdef") for _ in range(18))} end') for i in range(40)]
    rows += [(100, None), (101, ""), (102, "mail x@y.zz, call 12"), (103, "plain words only"), (103, "plain words only")]
    frame = spark.createDataFrame([(k, t, "s") for k, t in rows], "doc_id long, text string, spans string")
    got = {row.doc_id: row.spans for row in personal_spans(frame).collect()}
    for key, text in rows[:40]:
        start = text.index("password=") + 9
        assert [(s.kind, s.start, s.end, s.base) for s in got[key]] == [("secret", start, start + 18, False)]
    assert got[100] == got[101] == got[103] == []
    assert [(s.kind, s.start, s.end) for s in got[102]] == [("email", 5, 11)]
    assert personal_spans(frame.limit(0)).count() == 0


def test_query(spark, sf_dir):
    texts = {row.doc_id: row.text or "" for row in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = op6_personal_data(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for row in rows:
        want = plain(texts[row.doc_id])
        assert [row[f"n_{kind}"] for kind in BASE_KINDS] == [sum(k == i for _, k, _ in want) for i in range(4)]
        joined = ",".join(f"{BASE_KINDS[k]}:{s}:{e}" for s, k, e in want)
        assert row.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert set(filter(None, joined.split(","))) <= set(row.spans.split(","))
