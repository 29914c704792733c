"""Operator 4 on small texts; whole tables are held against SQL."""

import re
from collections import Counter

import pytest

from stakewatch.llm.quality_rules import RULES, judged, measured, ordered_rules

TEXTS = [
    None, "", " \t\n", "a b a b a b", "a b c a b c d", "one\none\n\n \none\x0btwo", "x # y $ <b>", "été naïve x", "a " * 300,
    "w " + " ".join(f"word{i}" for i in range(80)), " ".join(f"WORD{i}!!" for i in range(80)), " ".join(f"ab{i}***" for i in range(80)), "\n".join(["the same line"] * 9 + [" ".join(f"v{i}" for i in range(90))]),
]


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    windows = list(zip(words, words[1:], words[2:]))
    seen = Counter(windows)
    covered = {i + j for i, window in enumerate(windows) if seen[window] > 1 for j in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_measures_and_verdicts(spark):
    frame = spark.createDataFrame([(i, t, "old") for i, t in enumerate(TEXTS)], "doc_id long, text string, n_words string")
    rows = judged(measured(frame), list(RULES)).collect()
    for row in rows:
        want = plain(TEXTS[row.doc_id])
        assert (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words) == want, TEXTS[row.doc_id]
        assert row.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
    assert [row.doc_id for row in rows if row.kept] == [9]


@pytest.mark.parametrize("turned", [False, True])
def test_order_does_not_change_the_verdict(spark, sf_dir, turned):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    measures = measured(docs)
    order = [name for name, share, seconds in ordered_rules(docs)]
    assert sorted(order) == sorted(RULES)
    kept = judged(measures, order[::-1] if turned else order).where("kept").count()
    assert kept == judged(measures, list(RULES)).where("kept").count() > 0


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert judged(measured(docs), [name for name, _, _ in ordered_rules(docs)]).count() == 0
