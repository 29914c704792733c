"""Operator 3 against the tokenizers library and round trips of its code."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from stakewatch.llm.token_files import END_ID, op3_token_files, pack, read_files, store, unpack

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    "The Cat's hat, it's 42nd!", "", None, " ", "caf\u00e9,N\u00cfVE J\u030c x\u0301,y", "''s 's!'s don't!\"re", "a" * 4000, "<|endoftext|> <|startoftext|>x", "a.<|ENDOFTEXT|>,b <|endoftext|>.,b",
    "\u00a0a\u2003b\u0085c", "na.me@ex-ample.org (+1) 'LL 'Ll", "\u65e5\u672c\u8a9e, \U0001f642!", "I\u0307stanbul \u0130X", "tab\tline\nend", "A\u030angstr\u00f6m,A\u030a",
]


def expected(texts):
    library = Tokenizer.from_file(PATH)
    return [library.encode(text or "", add_special_tokens=False).ids + [END_ID] for text in texts]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=50))
def test_code_round_trip(values):
    control, data = pack(np.array(values, np.uint32))
    assert unpack(control, data, len(values)).tolist() == values
    assert len(control) == -(-len(values) // 4)
    assert len(data) == sum(max(1, (v.bit_length() + 7) // 8) for v in values)


def test_files(spark, tmp_path):
    rows = [(key * 3, text, "x", 1) for key, text in enumerate(TEXTS)] + [(3, TEXTS[1], "y", 2)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, ids string, part int").repartition(5)
    store(frame, PATH, str(tmp_path / "files"))
    got = sorted((row.start, row.key, row.ids) for row in read_files(spark, str(tmp_path / "files")).collect())
    assert [row[1] for row in got] == sorted(row[0] for row in rows)
    want = {key: ids for key, ids in zip([row[0] for row in rows], expected([row[1] for row in rows]), strict=True)}
    held = 0
    for start, key, ids in got:
        assert start == held and ids == want[key], key
        held += len(ids)


def test_empty_table(spark, tmp_path):
    store(spark.createDataFrame([], "doc_id long, text string"), PATH, str(tmp_path / "files"))
    assert read_files(spark, str(tmp_path / "files")).count() == 0


def test_query(spark, sf_dir):
    rows = sorted((row.doc_id, row.text) for row in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect())
    got = sorted(op3_token_files(spark, sf_dir).collect())
    held = 0
    for row, (key, _), ids in zip(got, rows, expected([row[1] for row in rows]), strict=True):
        assert (row.doc_id, row.start, row.n_tokens, row.ids_crc32) == (key, held, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        held += len(ids)
