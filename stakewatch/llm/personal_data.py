"""Operator 6: personal data, with weak labelers and a span classifier trained on what they agree on.

The base patterns (e-mail, ip, card, phone) are found as they are and always stay. Further candidates (secrets, names after
a title, telephone numbers in national form) get votes from labelers that look at patterns, word lists and context; each
votes for, against, or not at all. Candidates of all documents are counted by their votes and features, at most
``MAX_PATTERNS`` combinations a kind. Expectation-maximisation on these counts estimates how reliable each labeler is and
how likely each combination is right; a logistic classifier is trained on the features with these likelihoods as its
targets, and decides every span.

Spans are half-open code point ranges. Defined results: null and empty texts have no spans; very long texts are read whole,
in linear time; a repeated row repeats its spans; candidates that touch a base span are left out; where no kind has
candidates there is no classifier and nothing is added; an empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stakewatch.llm.common import map_batches, table, text_slices, written

BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("secret", "name", "number")
KINDS = BASE_KINDS + ADDED_KINDS
LABELERS = 5
FEATURES = 7
MAX_PATTERNS = 3**LABELERS * 2**FEATURES
ROUNDS = 40

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")

#: Word lists of the labelers.
TITLES = ("Mr", "Mrs", "Ms", "Dr", "Prof", "Herr", "Frau", "Mme", "Mlle", "Sr", "Sra", "Señor", "Señora", "Monsieur", "Madame")
GIVEN_NAMES = frozenset("James Mary John Patricia Robert Jennifer Michael Linda William Elizabeth David Susan Thomas Sarah Daniel Anna Hans Peter Klaus Ursula Karin Jean Marie Pierre Jacques Claire José María Juan Carmen Carlos Lucía Antonio Pilar".split())
SECRET_CUES = re.compile(r"(?i)(pass(?:word|wd)?|token|secret|api[_ -]?key|credential|auth)\W{0,4}$")
NUMBER_CUES = re.compile(r"(?i)\b(tel|phone|call|fax|mobile|telefon|teléfono|téléphone|anruf)\W{0,4}$")
NAME_CUES = re.compile(r"(?i)\b(contact|dear|by|from|ask|signed|liebe|cher|estimado)\W{0,3}$")
SECRET = re.compile(r"[A-Za-z0-9_+/-]{12,}")
KEY_FORMS = re.compile(r"(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{30,}|sk-[A-Za-z0-9]{20,}|xox[abp]-[A-Za-z0-9-]{10,}")
HEX = re.compile(r"[0-9a-f]{16,}|[0-9A-F]{16,}")
NAME = re.compile(r"\b(?:" + "|".join(TITLES) + r")\.?\x20((?:[A-ZÀ-Þ][a-zß-ÿ]+)(?:\x20[A-ZÀ-Þ][a-zß-ÿ]+)?)")
NUMBER = re.compile(r"(?<![0-9+(.-])\(?[0-9]{2,4}\)?[\x20.-][0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9.-])")


def luhn(digits: str) -> bool:
    total = 0
    for i, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + i % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost addresses that do not overlap, found from each @ outwards."""
    upto, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > upto and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            upto = found.end()
        at = text.find("@", max(at + 1, upto))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns."""
    spans = [(start, 0, end) for start, end in emails(text)]
    if DIGIT.search(text):
        for found in IP.finditer(text):
            if all(len(part.lstrip("0")) <= 3 and int(part[-3:]) <= 255 for part in found.group().split(".")):
                spans.append((found.start(), 1, found.end()))
        for found in CARD.finditer(text):
            digits = found.group().replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                spans.append((found.start(), 2, found.end()))
        if "+" in text:
            for found in PHONE.finditer(text):
                if 9 <= sum(map(str.isdigit, found.group())) <= 15:
                    spans.append((found.start(), 3, found.end()))
    return sorted(spans)


def votes_and_features(kind: int, value: str, before: str, after: str) -> tuple[list[int], list[bool]]:
    """Votes (1 for, -1 against, 0 none) and features of one candidate."""
    digits, upper = sum(map(str.isdigit, value)), sum(map(str.isupper, value))
    varied = len(set(value)) / len(value)
    if kind == 4:
        votes = [
            1 if KEY_FORMS.fullmatch(value) or HEX.fullmatch(value) else 0,
            1 if SECRET_CUES.search(before) else 0,
            1 if digits >= 4 and varied > 0.3 else -1,
            -1 if value.isdigit() or "/" in value or value.count("-") > 2 else 0,
            1 if before[-1:] in "=\"':" and before and after[:1] in ("", " ", "\n", '"', "'", ",", ";") else (-1 if after[:1] in ".@" and after else 0),
        ]
    elif kind == 5:
        parts = value.split(" ")
        votes = [1 if len(parts) == 2 else 0, 1 if parts[0] in GIVEN_NAMES else (-1 if len(parts) == 1 and len(value) < 3 else 0), 1 if NAME_CUES.search(before) else 0, -1 if len(value) > 30 else 0, 1 if after[:1] in (",", ".", "\n", " ", "") else -1]
    else:
        votes = [1 if 9 <= digits <= 11 else -1, 1 if NUMBER_CUES.search(before) else 0, 1 if "(" in value else 0, -1 if before[-1:] in "$€#=" and before else 0, -1 if value.count(".") == 2 else (1 if after[:1] in ("", " ", "\n", ",", ".", ";", ")") else 0)]
    shape = [len(value) >= 20, digits * 2 > len(value), upper * 2 > len(value), varied > 0.5, bool(votes[1] > 0), before[-1:] in ("=", '"', "'", ":"), votes[0] > 0]
    return votes, shape


def candidates(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int]]:
    """(start, kind, end, code) of the further candidates; the code holds votes and features."""
    found = []
    if DIGIT.search(text):
        for one in SECRET.finditer(text):
            value = one.group()
            if sum(map(str.isdigit, value)) >= 2 and sum(map(str.isalpha, value)) >= 2:
                found.append((one.start(), 4, one.end()))
        found += [(one.start(), 6, one.end()) for one in NUMBER.finditer(text)]
    found += [(one.start(1), 5, one.end(1)) for one in NAME.finditer(text)]
    out, i = [], 0
    taken = [*taken, (len(text) + 1, 0, len(text) + 1)]
    for start, kind, end in sorted(found):
        while taken[i][2] <= start and i < len(taken) - 1:
            i += 1
        if taken[i][0] < end:
            continue
        votes, features = votes_and_features(kind, text[start:end], text[max(0, start - 24) : start], text[end : end + 2])
        code = 0
        for vote in votes:
            code = code * 3 + vote + 1
        for feature in features:
            code = code * 2 + feature
        out.append((start, kind, end, code))
    return out


def scanned(frame: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and ``spans``: kind (place in ``KINDS``), start, end, and the code of a candidate (-1 for base spans)."""

    def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batch):
            spans = []
            for value in part.column("text").to_pylist():
                base = base_spans(value or "")
                found = [{"kind": k, "start": s, "end": e, "code": -1} for s, k, e in base]
                spans.append(found + [{"kind": k, "start": s, "end": e, "code": c} for s, k, e, c in candidates(value or "", base)])
            kind = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("code", pa.int32())]))
            yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(spans, kind)], ["key", "spans"])

    kind = frame.schema[key].dataType.simpleString()
    return map_batches(frame.select(F.col(key).alias("key"), F.col(text).alias("text")), step, f"key {kind}, spans array<struct<kind: int, start: long, end: long, code: int>>")


def unpacked(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Votes (-1, 0, 1) and features (0, 1) of the codes."""
    features = codes[:, None] >> np.arange(FEATURES - 1, -1, -1) & 1
    rest = codes >> FEATURES
    votes = rest[:, None] // 3 ** np.arange(LABELERS - 1, -1, -1) % 3 - 1
    return votes, features


def reliabilities(votes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Expectation-maximisation over votes that are independent given the truth: how likely each combination is right,
    and how often each labeler votes -1, 0, 1 given the truth (labeler, truth, vote)."""
    right = np.clip(0.5 + 0.2 * votes.sum(axis=1), 0.05, 0.95)
    given = np.zeros((votes.shape[1], 2, 3))
    for _ in range(ROUNDS):
        weight = np.stack([counts * (1 - right), counts * right])
        prior = (weight.sum(axis=1) + 1) / (weight.sum() + 2)
        for vote in (-1, 0, 1):
            given[:, :, vote + 1] = (weight @ (votes == vote)).T + 1
        given /= given.sum(axis=2, keepdims=True)
        like = np.log(prior)[:, None] + sum(np.log(given[i][:, votes[:, i] + 1]) for i in range(votes.shape[1]))
        right = 1 / (1 + np.exp(np.clip(like[0] - like[1], -50, 50)))
    return right, given


def logistic(features: np.ndarray, target: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Weights (the last is the constant) by Newton's steps with a small ridge."""
    x = np.hstack([features, np.ones((len(features), 1))]).astype(float)
    weights = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        slope = x.T @ (counts * (target - p)) - 0.1 * weights
        curve = (x * (counts * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(x.shape[1])
        weights += np.linalg.solve(curve, slope)
    return weights


def classifiers(found: DataFrame) -> dict[int, np.ndarray]:
    """Weights of the span classifier of each added kind, from all candidates."""
    counted = found.select(F.explode("spans").alias("s")).where("s.code >= 0").groupBy("s.kind", "s.code").agg(F.count("*").alias("n")).collect()
    out = {}
    for kind in sorted({row.kind for row in counted}):
        rows = [row for row in counted if row.kind == kind]
        codes, counts = np.array([row.code for row in rows], np.int64), np.array([row.n for row in rows], float)
        votes, features = unpacked(codes)
        right, _ = reliabilities(votes, counts)
        out[kind] = logistic(features, right, counts)
    return out


def accepted_codes(models: dict[int, np.ndarray]) -> list[int]:
    """Kind and features of the spans that the classifiers accept, as kind * 2^FEATURES + features."""
    out = []
    for kind, weights in models.items():
        for value, bits in enumerate(product((0, 1), repeat=FEATURES)):
            if np.dot(weights[:-1], bits) + weights[-1] > 0:
                out.append(kind << FEATURES | value)
    return out


def personal_spans(frame: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and ``spans`` (``kind`` by name, ``start``, ``end``, ``base``), by start and kind."""
    found = written(scanned(frame, key, text), "spans")
    accepted = accepted_codes(classifiers(found))
    mark = F.array(*[F.lit(code) for code in accepted]) if accepted else F.array().cast("array<int>")
    stays = F.filter("spans", lambda s: (s["code"] < 0) | F.array_contains(mark, F.shiftleft(s["kind"], FEATURES).bitwiseOR(s["code"].bitwiseAND(2**FEATURES - 1))))
    ordered = F.array_sort(F.transform(stays, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("place"), s["end"].alias("end"), (s["code"] < 0).alias("base"))))
    names = F.array(*map(F.lit, KINDS))
    return found.select(F.col("key").alias(key), F.transform(ordered, lambda s: F.struct(F.get(names, s["place"]).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["base"].alias("base"))).alias("spans"))


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_spans(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["base"])
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    of_kind = lambda kind: F.filter(base, lambda s: s["kind"] == kind)
    counts = [F.size(of_kind(kind)).cast("long").alias(f"n_{kind}") for kind in BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))
