"""Operator 4: quality rules as a short-circuit cascade, in DataFrame functions only.

Every rule rejects a text by one condition on a few measures. On a bounded sample the cascade estimates what each rule
rejects and what it costs (time of the measures it needs), and orders the rules by rejection per cost, so that most bad
texts are decided by the cheapest sound evidence. The order changes the work and the reported rule, never the verdict.

Defined results: a null or blank text has no words, fails the base rule and is not kept; very long texts are measured
whole; repeated rows repeat their result; ties in the order go by the rule's name; an empty table gives an empty one;
other columns of the input are left as they are, but those with the name of a measure are replaced.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stakewatch.llm.common import table, written

#: Rows that costs and rejections are estimated on.
SAMPLE_ROWS = 1000
WHITE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 3


def without(text: Column, characters: str) -> Column:
    for character in characters:
        text = F.replace(text, F.lit(character), F.lit(""))
    return text


def words(text: Column) -> Column:
    """Words between ASCII white space, none for a null."""
    plain = text
    for character in WHITE[1:]:
        plain = F.replace(plain, F.lit(character), F.lit(" "))
    return F.array_remove(F.split(plain, " "), "")


def window_keys(found: Column) -> Column:
    """A hash of each window of three words."""
    windows = F.size(found) - (WINDOW - 1)
    places = F.sequence(F.lit(0), windows - 1)
    return F.transform(places, lambda i: F.xxhash64(F.get(found, i), F.get(found, i + 1), F.get(found, i + 2)))


def named(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is evaluated once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def repeated_places(keys: Column) -> Column:
    """Ascending places of the windows that occur twice or more: equal neighbours once the windows are sorted."""

    def of(ordered: Column) -> Column:
        same = lambda x, y: F.coalesce(x["key"] == y["key"], F.lit(False))
        marked = F.transform(ordered, lambda x, i: F.when(same(x, F.get(ordered, i - 1)) | same(x, F.get(ordered, i + 1)), x["at"]))
        return F.sort_array(F.filter(marked, lambda at: at.isNotNull()))

    return named(F.sort_array(F.transform(keys, lambda key, i: F.struct(key.alias("key"), i.alias("at")))), of)


def repeated_words(found: Column) -> Column:
    """Words inside windows of three words that occur twice or more. Most texts repeat no window, which the distinct count tells."""

    def covered(places: Column) -> Column:
        after = F.slice(places, F.lit(2), F.greatest(F.size(places) - 1, F.lit(0)))
        steps = F.zip_with(places, after, lambda a, b: F.least(F.lit(WINDOW), F.coalesce(b - a, F.lit(WINDOW))))
        return F.aggregate(steps, F.lit(0), lambda total, x: total + x)

    keys = F.when(F.size(found) >= WINDOW, window_keys(found)).otherwise(F.array().cast("array<bigint>"))
    return named(keys, lambda k: F.when(F.size(F.array_distinct(k)) == F.size(k), F.lit(0)).otherwise(named(repeated_places(k), covered)))


def measured(frame: DataFrame, text: str = "text") -> DataFrame:
    """Adds the base measures: ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines`` and ``n_repeat_words``."""
    value = F.col(text)
    none = F.lit(0).cast("long")
    lines = F.filter(F.split(value, "\n"), lambda line: F.length(without(line, WHITE)) > 0)
    frame = frame.withColumns({
        "n_symbols": F.coalesce((F.octet_length(value) - F.octet_length(without(value, SYMBOLS))).cast("long"), none),
        "word_chars": F.coalesce(F.length(without(value, WHITE)).cast("long"), none),
        "n_dup_lines": F.coalesce(named(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"), none),
        # One expression, so that a filter on a measure never evaluates the words again for each of them.
        "_counts": named(F.coalesce(words(value), F.array().cast("array<string>")), lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated_words(w).cast("long").alias("repeated"))),
    })
    return frame.withColumns({"n_words": F.col("_counts.n"), "n_repeat_words": F.col("_counts.repeated")}).drop("_counts")


#: Rules of the cascade by name: the condition under which a text is rejected, on the measures and the text. The first
#: two are the base rules.
RULES: dict[str, Callable[[], Column]] = {
    "few_words": lambda: F.col("n_words") < 50,
    "repetition": lambda: 100 * F.col("n_repeat_words") > 50 * F.col("n_words"),
    "symbols": lambda: 10 * F.col("n_symbols") > F.col("n_words"),
    "repeated_lines": lambda: 2 * F.col("n_dup_lines") > F.size(F.split("text", "\n")),
    "word_length": lambda: (F.col("word_chars") < 2 * F.col("n_words")) | (F.col("word_chars") > 15 * F.col("n_words")),
    "exclamations": lambda: 10 * (F.octet_length("text") - F.octet_length(without(F.col("text"), "!"))) > F.col("n_words"),
    "capitals": lambda: 2 * (F.octet_length("text") - F.octet_length(F.regexp_replace("text", "[A-Z]+", ""))) > F.col("word_chars"),
}
BASE = ("few_words", "repetition")


def ordered_rules(frame: DataFrame) -> list[tuple[str, float, float]]:
    """Name, share of the sample that the rule rejects and its seconds, by falling rejection per second.

    ``frame`` has the text. The sample is the first ``SAMPLE_ROWS`` rows: taking them reads a few partitions, whatever the
    size of the input, while a limit inside a plan would gather so many rows of every partition."""
    rows = frame.select("text").take(SAMPLE_ROWS)
    sample = written(measured(frame.sparkSession.createDataFrame(rows, "text string")), "quality-sample")
    rows = max(sample.count(), 1)
    found = []
    for name, rule in RULES.items():
        start = time.perf_counter()
        rejected = sample.agg(F.coalesce(F.sum(rule().cast("int")), F.lit(0)).alias("n")).first().n
        found.append((name, rejected / rows, time.perf_counter() - start))
    return sorted(found, key=lambda x: (-x[1] / x[2], x[0]))


def judged(frame: DataFrame, order: list[str]) -> DataFrame:
    """Adds ``base_failed``, ``rejected_by`` (the first rule in this order that rejects, null for none) and ``kept``."""
    verdict = F.lit(None).cast("string")
    for name in reversed(order):
        verdict = F.when(RULES[name](), F.lit(name)).otherwise(verdict)
    base = F.coalesce(RULES[BASE[0]]() | RULES[BASE[1]](), F.lit(True))
    return frame.withColumns({"base_failed": base, "rejected_by": verdict}).withColumn("kept", F.col("rejected_by").isNull() & ~F.col("base_failed"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    order = [name for name, _, _ in ordered_rules(docs)]
    return judged(measured(docs), order).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_WORDS = "[^\\x20\\x09-\\x0D]+"
ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_WORDS}') AS w FROM documents),
e AS (SELECT *, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{_WORDS}')) AS l,
  list_transform(range(1, greatest(len(w) - 1, 1)), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) AS k FROM d),
g AS (SELECT doc_id AS id, unnest(k) AS key, unnest(range(len(k))) AS pos FROM e),
r AS (SELECT id, pos FROM (SELECT *, count(*) OVER (PARTITION BY id, key) AS c FROM g) WHERE c >= 2),
c AS (SELECT id, count(DISTINCT p) AS n FROM (SELECT id, unnest([pos, pos + 1, pos + 2]) AS p FROM r) GROUP BY id),
m AS (SELECT doc_id, text, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words
  FROM e LEFT JOIN c ON id = doc_id),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > n_words OR 2 * n_dup_lines > len(string_split(text, chr(10))) OR word_chars < 2 * n_words OR word_chars > 15 * n_words
    OR 10 * length(regexp_replace(text, '[^!]', '', 'g')) > n_words OR 2 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > word_chars) AS kept FROM b
"""
