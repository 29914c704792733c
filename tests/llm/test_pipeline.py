"""Every stage of the pipeline against brute force on its own input."""

import base64
import os
import sys

import public_tokenizers
import tiktoken

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import test_decontaminate  # noqa: E402
import test_line_dedup  # noqa: E402
import test_near_dedup  # noqa: E402

from pyspark.sql import functions as F  # noqa: E402

import corpus_pipeline  # noqa: E402
from stakewatch.llm import language_id, line_dedup  # noqa: E402


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = spark.createDataFrame([(10**6, None, "en", None, 0), (10**6 + 1, "", None, "src1", 0), (10**6 + 2, "123 456", "en", "src1", 7)], docs.schema)
    docs = docs.union(odd)
    columns = docs.columns
    rows = {row.doc_id: row for row in docs.collect()}
    rejected = {row.doc_id for row in language_id.predicted(docs, language_id.fit(docs)).collect() if row.rejected}
    assert {10**6, 10**6 + 1, 10**6 + 2} <= rejected and len(rejected) < 20

    stages = [stage for _, stage in corpus_pipeline.STAGES]
    docs = stages[0](spark, docs, sf_dir)
    assert docs.columns == columns
    kept = {row.doc_id: row for row in docs.collect()}
    assert kept == {key: row for key, row in rows.items() if key not in rejected}

    docs = stages[1](spark, docs, sf_dir)
    assert docs.columns == columns
    want = test_line_dedup.exact([(key, row.text, row.source) for key, row in kept.items()], line_dedup.MIN_SITES)
    want = {key: text for key, text in want.items() if text == kept[key].text or text.strip(" \t\n\x0b\x0c\r")}
    kept = {row.doc_id: row for row in docs.collect()}
    assert {key: row.text for key, row in kept.items()} == want
    assert all(row.n_chars == len(row.text) for row in kept.values())

    docs = stages[2](spark, docs, sf_dir)
    assert docs.columns == columns
    first = {key for key, row in test_near_dedup.brute_force([(key, row.text) for key, row in kept.items()]).items() if row[3]}
    kept = {row.doc_id: row for row in docs.collect()}
    assert set(kept) == first

    docs = stages[3](spark, docs, sf_dir)
    assert docs.columns == columns
    items = [tuple(row) for row in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    clean = {row[0] for row in test_decontaminate.brute_force([(key, row.text) for key, row in kept.items()], items) if not row[4]}
    kept = {row.doc_id: row for row in docs.collect()}
    assert set(kept) == clean

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {row.doc_id: row for row in stages[4](spark, docs, sf_dir).collect()}
    assert set(got) == clean
    assert all(row.ids == library.encode_ordinary(kept[key].text) and row.decoded == kept[key].text and row.n_tokens == len(row.ids) for key, row in got.items())


def test_empty_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
    assert docs.count() == 0


def test_columns_that_clash_are_kept(spark, sf_dir):
    names = ["_gone", "_key", "_lines", "_removed", "key", "site", "row", "gone", "lines", "removed", "posts", "h1", "n", "component", "kept", "found", "start", "at"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = docs.select("*", *[F.concat(F.lit(f"{name}-"), "doc_id").alias(name) for name in names])
    for _, stage in corpus_pipeline.STAGES[:4]:
        plain = {row.doc_id: row.text for row in stage(spark, docs, sf_dir).collect()}
        out = stage(spark, odd, sf_dir)
        assert out.columns == odd.columns
        rows = out.collect()
        assert {row.doc_id: row.text for row in rows} == plain
        assert all(row[name] == f"{name}-{row.doc_id}" for row in rows for name in names)
    assert corpus_pipeline.STAGES[4][1](spark, odd, sf_dir).count() == docs.count()
