"""Operator 8 against the public library."""

import base64
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from stakewatch.llm.byte_bpe import decode, encode, op8_byte_bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def awkward_texts():
    rnd = random.Random(5)
    parts = ["'s", "'", "'re", "'ll", "s", "t", "r", "e", "l", " ", "  ", "\n", "\t", "a", "B", "7", "\u00bd", "\u00e9", "!", "\u00a0", "\u65e5", "\U0001f642", "'ve", "'d", "' ", "x'", "\u0301", "\u2028"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 60))) for _ in range(400)]
    return [*texts, "a" * 5000, "ab" * 3000 + "!" * 777, "", None, " ", "\n\n", "x" * 97, texts[0]]


def test_encodes_like_the_library_and_decodes(spark, library):
    texts = awkward_texts()
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 AS ids", "'x' AS offsets")
    got = {row.doc_id: row for row in decode(encode(frame, PATH), PATH).collect()}
    assert len(got) == len(texts)
    for key, text in enumerate(texts):
        assert got[key].ids == library.encode_ordinary(text or ""), repr(text)
        assert bytes(got[key].decoded) == (text or "").encode()


def test_offsets_are_byte_places(spark, library):
    row = encode(spark.createDataFrame([(1, "na\u00efve caf\u00e9s' 'll")], "doc_id long, text string"), PATH).first()
    places, at = [], 0
    for token in row.ids:
        places.append(at)
        at += len(library.decode_single_token_bytes(token))
    assert row.offsets == places


def test_empty_table(spark):
    assert decode(encode(spark.createDataFrame([], "doc_id long, text string"), PATH), PATH).count() == 0


def test_query(spark, sf_dir, library):
    texts = {row.doc_id: row.text for row in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = op8_byte_bpe(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for row in rows:
        ids = library.encode_ordinary(texts[row.doc_id] or "")
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256((texts[row.doc_id] or "").encode()).hexdigest()
