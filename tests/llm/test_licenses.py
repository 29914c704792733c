"""Operator 5: alignment against the textbook recurrence, planted licenses, and the lines of the test tables."""

import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest

from stakewatch.llm.licenses import BAND, TEMPLATES, Index, aligned, license_matches, op5_license_scan


def longest_in_band(text, template, shift):
    best = [[0] * (len(text) + 1) for _ in range(len(template) + 1)]
    for i in range(1, len(template) + 1):
        for j in range(1, len(text) + 1):
            here = max(best[i - 1][j], best[i][j - 1])
            if text[j - 1] == template[i - 1] and abs((j - 1) - (i - 1) - shift) <= BAND:
                here = max(here, best[i - 1][j - 1] + 1)
            best[i][j] = here
    return best[-1][-1]


def test_alignment():
    rnd = random.Random(6)
    for _ in range(300):
        text = np.array([rnd.randint(1, 4) for _ in range(rnd.randint(0, 40))], np.uint64)
        template = np.array([rnd.randint(1, 4) for _ in range(rnd.randint(1, 25))], np.uint64)
        shift = rnd.randint(-6, 20)
        pairs = aligned(text, template, shift)
        assert all(text[a] == template[b] for a, b in pairs)
        assert len(pairs) == longest_in_band(text.tolist(), template.tolist(), shift)
        assert (np.diff(pairs, axis=0) > 0).all()


def test_planted_and_awkward_rows(spark):
    mit = TEMPLATES["mit"].replace("free of charge, ", "").replace("Software", "Material", 1)
    rows = [
        (1, f"é some words before.\n{mit}\nand after"), (2, "ALL RIGHTS RESERVED"), (3, None), (4, ""), (5, "rights reserved for all of us"),
        (6, "x " * 3000 + TEMPLATES["gpl-3.0-line"] + " y" * 3000 + " " + TEMPLATES["gpl-3.0-line"]), (2, "ALL RIGHTS RESERVED"),
    ]
    frame = spark.createDataFrame([(k, t, "l") for k, t in rows], "doc_id long, text string, license string")
    got = sorted((row.doc_id, row.license, row.first_word, row.end_word) for row in license_matches(frame).collect())
    assert [g[:2] for g in got] == [(1, "mit"), (2, "all-rights-reserved"), (2, "all-rights-reserved"), (6, "gpl-3.0-line"), (6, "gpl-3.0-line")]
    assert got[0][2] == 4 and got[3][2] == 3000
    span = license_matches(frame.where("doc_id = 1")).first()
    assert rows[0][1].encode()[span.start_byte : span.end_byte].decode().startswith("Permission") and 0.9 < span.coverage < 1
    assert license_matches(frame.limit(0)).count() == 0 and license_matches(frame, {}).count() == 0


def test_query(spark, sf_dir):
    rows = op5_license_scan(spark, sf_dir).collect()
    lines = {name: text for name, text in TEMPLATES.items() if len(text) < 80}
    for row in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        for name, line in lines.items():
            if line in (row.text or ""):
                assert any(r.doc_id == row.doc_id and r.license == name and r.coverage == 1 for r in rows), (row.doc_id, name)
    assert rows and not re.search("None", str(rows))


def found(spark, texts):
    rows = license_matches(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    return [sorted(row.license for row in rows if row.doc_id == i) for i in range(len(texts))]


def test_whole_texts_and_notices_are_known(spark):
    names = [*"apache-2.0 gpl-2.0 gpl-3.0 lgpl-2.1 lgpl-3.0 mpl-2.0 cc0-1.0 unlicense bsd-2-clause bsd-3-clause bsd-disclaimer epl-2.0-notice agpl-3.0-notice".split()]
    assert found(spark, [f"é before it {TEMPLATES[name]} after it" for name in names]) == [[name] for name in names]


def test_variants_are_told_apart(spark):
    texts = [
        "Licensed under CC BY 4.0", "Licensed under CC BY-NC 4.0.", "This work is licensed under the GNU General Public License, version 2.", "This work is licensed under the GNU General Public License, version 7.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.", "This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License.",
    ]
    assert found(spark, texts) == [["cc-by-4.0-line"], ["cc-by-nc-4.0"], ["gpl-2.0-line"], [], ["cc-by-nc-nd-4.0-statement"], ["cc-by-sa-3.0-statement"]]


def test_insertions_and_line_numbers(spark):
    words = TEMPLATES["mit"].split()
    inserted = " ".join([*words[:55], *(f"clause{i}" for i in range(30)), *words[55:]])
    lines = TEMPLATES["gpl-2.0"].splitlines()
    numbered = "\n".join(f"{i} {line}" for i, line in enumerate(lines, 1000))
    assert found(spark, [inserted, numbered, TEMPLATES["mit"] + " x " * 40 + TEMPLATES["mit"]]) == [["mit"], ["gpl-2.0"], ["mit", "mit"]]


@pytest.mark.parametrize("name, phrase", [("gpl-3.0", "of the GNU General Public License"), ("mit", "copies of the Software"), ("apache-2.0", "the terms and conditions of this License")])
def test_a_phrase_of_its_own_put_in_many_times(name, phrase):
    index = Index(TEMPLATES)
    plain = TEMPLATES[name].split(" ")
    for times in (1, 2, 50):
        words = list(plain)
        for place in (3, 2, 1):
            words[place * len(plain) // 4 : place * len(plain) // 4] = (phrase + " ").split(" ")[:-1] * times
        found = index.matches(index.words.of(pa.array([" ".join(words)]))[0])
        best = {index.names[template]: coverage for template, _, _, coverage in found}
        assert best.get(name, 0) > 0.95, (times, best)


def test_repeated_words_are_cheap():
    index = Index(TEMPLATES)
    for phrase in ("of the gnu general public license ", "copies of the software ", "permission is hereby granted "):
        text = phrase * (20_000 // len(phrase.split()))
        start = time.perf_counter()
        index.matches(index.words.of(pa.array([text]))[0])
        assert time.perf_counter() - start < 2
