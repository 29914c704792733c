"""Operator 5: license texts by winnowed fingerprints and banded alignment.

Templates are cut into words; every ``GRAM`` words in a row have a hash, and of each ``WINNOW`` neighbouring hashes the
smallest is kept as a fingerprint. An inverted index of these leads from the fingerprints of a text to templates and to the
diagonal (place in the text minus place in the template) on which they lie. Only fingerprints that are rare in their template
lead there. Those that ascend in both are chained, whatever number of words or of other fingerprints lies between them;
chains with enough of them for the template's size are candidates; along them banded alignments of the two word sequences,
one match point a word, tell which words of the template are there and where they begin and end in the text. The words that
tell variants apart (numbers, ``VARIANTS``) must be there, and matches of all templates that overlap compete: the one wins
with the most matched words less the unmatched ones of text and template.

The index is made of the given templates, at most ``MAX_TEMPLATE_WORDS`` words in all, so every task can hold it.

Defined results: null and empty texts have no matches; of matches that overlap one stays (of equals the earlier, then the
first by name); very long texts are read whole; a template is looked at where enough of its places are seen, and then takes a pass over its
words for each fingerprint of the text;
repeated rows repeat their matches; an empty table or no templates give no rows; other columns are not read.
"""

from __future__ import annotations

import bisect
import re
from collections import defaultdict
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stakewatch.llm.common import SliceHash, byte_table, kept_in_worker, lower_ascii, map_batches, shingle_hashes, table, text_bytes, text_slices, word_starts_ends

GRAM, WINNOW = 3, 2
#: Share of a template's words that must be matched, and half the width of the alignment's band in words.
COVERAGE, BAND = 0.7, 8
MAX_TEMPLATE_WORDS = 200_000

#: License statements and notices as they are commonly written.
TEMPLATES = {
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "mit-line": "Released under the MIT License.",
    "mit": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"),
to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.""",
    "bsd-redistribution": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation
and/or other materials provided with the distribution.""",
    "isc": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.""",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-notice": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or (at your option) any later version.""",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "all-rights-reserved": "All rights reserved.",
    "gpl-2.0-line": "This work is licensed under the GNU General Public License, version 2.",
    "gpl-2.0-notice": """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by
the Free Software Foundation; either version 2 of the License, or (at your option) any later version.""",
    "gpl-2.0-only-notice": """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2
as published by the Free Software Foundation.""",
    "lgpl-2.1-line": "This work is licensed under the GNU Lesser General Public License, version 2.1.",
    "lgpl-2.1-notice": """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by
the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.""",
    "lgpl-3.0-line": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "lgpl-3.0-notice": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by
the Free Software Foundation, either version 3 of the License, or (at your option) any later version.""",
    "agpl-3.0-line": "This work is licensed under the GNU Affero General Public License, version 3.",
    "agpl-3.0-title": "GNU Affero General Public License Version 3, 19 November 2007",
    "agpl-3.0-notice": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by
the Free Software Foundation, either version 3 of the License, or (at your option) any later version.""",
    "mpl-2.0-line": "Licensed under the Mozilla Public License, Version 2.0.",
    "mpl-2.0-notice": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file,
You can obtain one at http://mozilla.org/MPL/2.0/.""",
    "epl-1.0-notice": """All rights reserved. This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which
accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html""",
    "epl-2.0-notice": """This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at
https://www.eclipse.org/legal/epl-2.0/""",
    "epl-1.0-title": "Eclipse Public License - v 1.0",
    "epl-2.0-title": "Eclipse Public License - v 2.0",
    "cc0-1.0-line": "Licensed under CC0 1.0 Universal.",
    "cc0-1.0-notice": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work under CC0 1.0.",
    "unlicense-line": "This is free and unencumbered software released into the public domain.",
    "bsd-disclaimer": """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO,
THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT,
INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS;
OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY
OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
}
#: Creative Commons licences: short form, name and the later versions' territory.
CC_PARTS = {"by": "Attribution", "by-sa": "Attribution-ShareAlike", "by-nd": "Attribution-NoDerivatives", "by-nc": "Attribution-NonCommercial", "by-nc-sa": "Attribution-NonCommercial-ShareAlike", "by-nc-nd": "Attribution-NonCommercial-NoDerivatives"}
for _part, _name in CC_PARTS.items():
    for _version, _territory in (("2.0", "Generic"), ("2.5", "Generic"), ("3.0", "Unported"), ("4.0", "International")):
        _statement, _line = f"This work is licensed under a Creative Commons {_name} {_version} {_territory} License.", f"Licensed under CC {_part.upper()} {_version}."
        for _key, _text in ((f"cc-{_part}-{_version}-line", _line), (f"cc-{_part}-{_version}-statement", _statement), (f"cc-{_part}-{_version}-title", f"Creative Commons {_name} {_version} {_territory}")):
            if _text not in TEMPLATES.values():
                TEMPLATES[_key] = _text
#: Whole texts, one file each, named by licence and version.
TEMPLATES |= {path.stem: path.read_text(encoding="utf-8") for path in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))}

#: Words that tell variants apart, besides numbers. A template of up to ``SHORT`` words needs its own, and bears no other's
#: inside its match; a longer one bears no other's among the first ``TITLE_WORDS`` of its match.
VARIANTS = frozenset("nc nd sa noncommercial noderivatives noderivs sharealike affero lesser library".split())
SHORT, TITLE_WORDS = 120, 20
#: Places of a template that a fingerprint may stand at to be a seed (a template that has none so rare takes its rarest), and
#: how many times the template's length may lie between two neighbours in a chain.
RARE, GAP = 4, 4


class Words:
    def __init__(self) -> None:
        self.hash = SliceHash()
        self.word = byte_table(lambda b: 48 <= b <= 57 or 97 <= b <= 122 or b >= 128)

    def of(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Word hashes, their first and last bytes in their text, and where each text begins."""
        data, offsets = text_bytes(column)
        data = lower_ascii(data)
        starts, ends = word_starts_ends(self.word[data], offsets)
        first = np.searchsorted(starts, offsets)
        shift = np.repeat(offsets[:-1], np.diff(first))
        return self.hash.slices(self.hash.prefix(data), starts, ends), starts - shift, ends - shift, first


def fingerprints(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes that winnowing keeps: of each ``WINNOW`` neighbours the smallest, the last of equals."""
    grams = shingle_hashes(words, min(GRAM, len(words)) or 1)
    if len(grams) <= WINNOW:
        return np.arange(len(grams)), grams
    around = np.lib.stride_tricks.sliding_window_view(grams, WINNOW)
    places = np.unique(np.arange(len(around)) + WINNOW - 1 - around[:, ::-1].argmin(axis=1))
    return places, grams[places]


def aligned(text: np.ndarray, template: np.ndarray, shift: int) -> np.ndarray:
    """Pairs (place in the text, place in the template) of a longest common subsequence inside the band around ``shift``.

    Row by row over the template. Columns count text words from ``shift - BAND`` on; row r is kept for the columns r - 1 to
    r + 2 BAND + 1, beyond which nothing changes. As gaps cost nothing, a row is a running maximum."""
    size, width, low = len(template), 2 * BAND + 1, shift - BAND
    window = np.zeros(size + width, np.uint64)
    inside = np.zeros(size + width, bool)
    begin, end = max(0, low), min(len(text), low + size + width)
    if begin < end:
        window[begin - low : end - low], inside[begin - low : end - low] = text[begin:end], True
    best = np.zeros(size + width + 1, np.int32)
    rows = np.zeros((size + 1, width + 2), np.int32)
    for i, word in enumerate(template):
        same = (window[i : i + width] == word) & inside[i : i + width]
        best[i + 1 : i + width + 1] = np.maximum.accumulate(np.maximum(best[i + 1 : i + width + 1], np.where(same, best[i : i + width] + 1, best[i])))
        if i + width + 1 < len(best):
            best[i + width + 1] = best[i + width]
        rows[i + 1, : len(best[i : i + width + 2])] = best[i : i + width + 2]
    pairs, r, c = [], size, size + width - 1
    while r > 0 and (here := rows[r, c - r + 1]) > 0:
        if c >= r and rows[r, c - r] == here:
            c -= 1
        elif rows[r - 1, c - r + 2] == here:
            r -= 1
        else:
            pairs.append((low + c - 1, r - 1))
            r, c = r - 1, c - 1
    return np.array(pairs[::-1], np.int64).reshape(-1, 2)


def chains(seeds: list[tuple[int, int]], size: int) -> list[list[tuple[int, int]]]:
    """Runs of fingerprints (place in the text, place in the template) that ascend in both, the best first.

    A change of the diagonal costs by its size, so that an insertion or numbered lines are crossed and another occurrence
    of the template is not. For each place of the template the best and the latest run that end there are kept, and a
    fingerprint follows the best of all those at earlier places: however many words are put in between, what came before
    is not forgotten, and a fingerprint costs one pass over the template's places."""
    points = np.array(sorted(seeds), np.int64)
    score, before = np.full(len(points), float(GRAM)), np.full(len(points), -1)
    reach = GAP * size + BAND
    jumps = np.arange(reach + size + 2, dtype=float)
    cost = 0.5 * np.log2(1 + jumps) + 0.01 * jumps
    # Best and latest run by the template's place: score, place in the text, number of its last fingerprint.
    held, at, last = np.full((2, size), -np.inf), np.zeros((2, size), np.int64), np.full((2, size), -1)
    places = np.arange(size)
    first = 0
    while first < len(points):
        text = int(points[first, 0])
        end = int(np.searchsorted(points[:, 0], text, "right"))
        for i in range(first, end):
            own = int(points[i, 1])
            if not own:
                continue
            here, there = text - at[:, :own], own - places[:own]
            value = held[:, :own] + np.minimum(np.minimum(here, there), GRAM) - cost[np.minimum(np.abs(here - there), len(cost) - 1)]
            value[here > reach] = -np.inf
            best = int(value.argmax())
            if value.flat[best] > score[i]:
                score[i], before[i] = value.flat[best], last[:, :own].flat[best]
        for i in range(first, end):
            own = int(points[i, 1])
            for slot in (0, 1):
                if slot or score[i] >= held[0, own] or text - at[0, own] > reach:
                    held[slot, own], at[slot, own], last[slot, own] = score[i], text, i
        first = end
    used = np.zeros(len(points), bool)
    out = []
    for i in np.argsort(-score, kind="stable").tolist():
        chain = []
        while i >= 0 and not used[i]:
            used[i] = True
            chain.append(i)
            i = int(before[i])
        if chain:
            out.append([(int(points[i, 0]), int(points[i, 1])) for i in reversed(chain)])
    return out


def chain_pairs(text: np.ndarray, template: np.ndarray, chain: list[tuple[int, int]]) -> np.ndarray:
    """Matched pairs along a chain: a banded alignment for every group of diagonals within a band."""
    groups: list[list[tuple[int, int]]] = []
    low = high = 0
    for place, own in chain:
        low, high = min(low, place - own), max(high, place - own)
        if not groups or high - low > BAND:
            groups.append([])
            low = high = place - own
        groups[-1].append((place, own))
    out = []
    for k, group in enumerate(groups):
        shifts = [a - b for a, b in group]
        first, text_first = (0, 0) if k == 0 else (group[0][1], group[0][0])
        end, text_end = (len(template), len(text)) if k + 1 == len(groups) else (groups[k + 1][0][1], groups[k + 1][0][0])
        pairs = aligned(text[text_first:text_end], template[first:end], (min(shifts) + max(shifts)) // 2 + first - text_first)
        out.append(pairs + np.array([text_first, first]))
    return np.concatenate(out)


class Index:
    """Templates, and their fingerprints' places by hash."""

    def __init__(self, templates: dict[str, str]) -> None:
        self.words = Words()
        self.names = sorted(templates)
        self.templates, self.expected, self.needed = [], [], []
        self.variants = self.words.of(pa.array([" ".join(sorted(VARIANTS))]))[0]
        by_hash: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for i, name in enumerate(self.names):
            words = self.words.of(pa.array([templates[name]]))[0]
            places, hashes = fingerprints(words)
            plain = re.findall(r"[a-z0-9\x80-\U0010ffff]+", templates[name].lower())
            telling = sorted({word for word in plain if word in VARIANTS or word.isdigit()}) if len(words) <= SHORT else []
            self.needed.append(self.words.of(pa.array([" ".join(telling)]))[0])
            self.templates.append(words)
            _, back, often = np.unique(hashes, return_inverse=True, return_counts=True)
            rare = often[back] <= max(RARE, int(often.min(initial=RARE)))
            self.expected.append(int(rare.sum()))
            for place, value in zip(places[rare].tolist(), hashes[rare].tolist(), strict=True):
                by_hash[value].append((i, place))
        self.by_hash = dict(by_hash)
        self.hashes = np.array(sorted(by_hash), np.uint64)

    def matches(self, words: np.ndarray) -> list[tuple[int, int, int, float]]:
        """(template, first word, last word, coverage) in one text."""
        if not len(words) or not len(self.hashes):
            return []
        votes: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for size in {min(GRAM, len(t)) for t in self.templates}:
            grams = shingle_hashes(words, size)
            at = np.minimum(np.searchsorted(self.hashes, grams), len(self.hashes) - 1)
            for place in np.flatnonzero(self.hashes[at] == grams).tolist():
                for template, own in self.by_hash[int(grams[place])]:
                    votes[template].append((place, own))
        found = []
        for template, seeds in votes.items():
            whole = self.templates[template]
            # A chain takes each place of the template once.
            if len({own for _, own in seeds}) < max(1, self.expected[template] * COVERAGE / 4) or not np.isin(self.needed[template], words).all():
                continue
            for chain in chains(seeds, len(whole)):
                if len(chain) < max(1, self.expected[template] * COVERAGE / 4):
                    continue
                pairs = chain_pairs(words, whole, chain)
                if len(pairs) < COVERAGE * len(whole) or not np.isin(self.needed[template], whole[pairs[:, 1]]).all():
                    continue
                low, high = int(pairs[0, 0]), int(pairs[-1, 0])
                seen = np.setdiff1d(np.arange(low, high + 1 if len(whole) <= SHORT else min(high + 1, low + TITLE_WORDS)), pairs[:, 0])
                if not np.isin(words[seen], self.variants).any():
                    # What is missing on either side counts against a match, so that of variants the nearest one wins.
                    score = 3 * len(pairs) - (high + 1 - low) - len(whole)
                    found.append((score, template, low, high, len(pairs) / len(whole)))
        taken: list[tuple[int, int]] = []
        out = []
        for _, template, low, high, coverage in sorted(found, key=lambda x: (-x[0], x[2], x[1])):
            at = bisect.bisect_left(taken, (low, high))
            if (at == 0 or taken[at - 1][1] < low) and (at == len(taken) or taken[at][0] > high):
                taken.insert(at, (low, high))
                out.append((template, low, high, coverage))
        return sorted(out, key=lambda x: (x[1], x[0]))


def license_matches(frame: DataFrame, templates: dict[str, str] | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``license``, ``coverage`` and the match's span: words and UTF-8 bytes of the text, ends exclusive."""
    templates = TEMPLATES if templates is None else templates
    if sum(len(value.split()) for value in templates.values()) > MAX_TEMPLATE_WORDS:
        raise ValueError("the templates have too many words for one index")
    version = tuple(sorted(templates.items()))

    def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        index = kept_in_worker(("license index", version), lambda: Index(templates))
        for part in text_slices(batch):
            words, starts, ends, first = index.words.of(part.column("text"))
            rows, out = [], []
            for row, (begin, end) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
                for template, low, high, coverage in index.matches(words[begin:end]):
                    rows.append(row)
                    out.append((index.names[template], coverage, low, high + 1, int(starts[begin + low]), int(ends[begin + high])))
            columns = list(zip(*out, strict=True)) or [()] * 6
            kinds = (pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([part.column("key").take(pa.array(rows, pa.int64())), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["key", "license", "coverage", "first_word", "end_word", "start_byte", "end_byte"])

    kind = frame.schema[key].dataType.simpleString()
    found = map_batches(frame.select(F.col(key).alias("key"), F.col(text).alias("text")), step, f"key {kind}, license string, coverage double, first_word long, end_word long, start_byte long, end_byte long")
    return found.withColumnRenamed("key", key)


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_matches(table(spark, sf_dir, "documents"))
