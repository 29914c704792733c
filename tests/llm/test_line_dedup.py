"""Operator 1 against exact counts; whole tables are held against SQL."""

import random

from stakewatch.llm.line_dedup import deduplicated


def exact(rows, min_sites):
    sites, first = {}, {}
    split = {key: text.split("\n") for key, text, _ in rows if text is not None}
    enough = lambda line: len(line.strip(" \t\n\x0b\x0c\r").split()) >= 3
    for key, _, site in sorted(rows, key=lambda x: x[0]):
        for at, line in enumerate(split.get(key, [])):
            if enough(line):
                line = line.strip(" \t\n\x0b\x0c\r")
                first.setdefault(line, (key, at))
                if site is not None:
                    sites.setdefault(line, set()).add(site)
    out = {}
    for key, text, _ in rows:
        kept = [line for at, line in enumerate(split.get(key, [])) if not enough(line) or len(sites.get(line.strip(" \t\n\x0b\x0c\r"), ())) < min_sites or first[line.strip(" \t\n\x0b\x0c\r")] == (key, at)]
        out[key] = None if text is None else "\n".join(kept)
    return out


def test_spread_around_the_threshold(spark):
    rnd = random.Random(1)
    common = [f"shared line number {i}" for i in range(60)]
    rows = []
    for key in range(1500):
        lines = [rnd.choice(common[: 1 + rnd.randrange(60)]) + rnd.choice(["", " ", "\t"]) for _ in range(rnd.randint(0, 4))]
        rows.append((key, "\n".join([f"own line of {key}", *lines, "ok", ""]), f"site{rnd.randrange(60) if rnd.random() < 0.7 else 0}"))
    rows += [(2000, None, "a"), (2001, "", "b"), (2002, common[0], None), (2003, "\n\n", "c"), (2004, common[0] + "\n" + common[0], "d")]
    frame = spark.createDataFrame([(k, t, s, 1, 2, "g") for k, t, s in rows], "doc_id long, text string, source string, site int, at int, gone string")
    for min_sites in (12, 40):
        got = {row.row.doc_id: row for row in deduplicated(frame, min_sites=min_sites).collect()}
        assert {key: row.text for key, row in got.items()} == exact(rows, min_sites)
        assert got[5].row.site == 1 and got[5].row["at"] == 2 and got[5].row.gone == "g"


def test_repeated_ids_and_a_very_long_text(spark):
    long = "\n".join(["shared line of many sites"] + [f"own line number {i}" for i in range(200_000)])
    rows = [(7, "shared line of many sites\nmore text on it", f"s{i}") for i in range(15)] + [(3, long, "x"), (None, "shared line of many sites", "y"), (9, None, "z")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = sorted(((r.row.doc_id or 0, r.row.source, r.text, r.lines, r.removed) for r in deduplicated(frame, min_sites=12).collect()), key=str)
    # Rows without an id come first in the order of places, and keep what they have.
    assert [x for x in got if x[0] == 0] == [(0, "y", "shared line of many sites", 1, 0)]
    assert [x[2:] for x in got if x[0] == 7] == [("more text on it", 2, 1)] * 15
    assert [x[3:] for x in got if x[0] == 3] == [(200_001, 1)] and [x[2:] for x in got if x[0] == 9] == [(None, 0, 0)]


def test_empty_table(spark):
    assert deduplicated(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0
