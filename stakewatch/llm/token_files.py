"""Operator 3: token ids in binary files.

Ids are renumbered by falling frequency, so that frequent ones become small, and written in a byte-aligned code of
variable length whose control bits stand apart: two bits per value (its bytes less one), four values to a control
byte, the bytes of the values in an area of their own. Reading needs no branching: a table gives the four lengths of
every control byte, their running sum the places of the bytes.

A stored table holds one row per block: ``part`` and ``block`` (order within the part), ``keys`` and ``counts`` (the
documents of the block and their ids), ``start`` (ids in the part before the block), ``control`` and ``data``. Spark's
writers commit it, so a lost executor costs its tasks only, and any file system that Spark reaches will do. Parts hold
ascending ranges of keys, in ascending order. A second table holds ``id`` and ``code``, at most as long as the
vocabulary (``MAX_VOCABULARY``), which is why it may be handed to every task.

Defined results: a null or empty text is just the end id; very long texts are one block of their own; repeated keys
stay in one part, next to each other, and each row counts; an empty table gives empty files; other columns are not read.
"""

from __future__ import annotations

import os
import unicodedata
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stakewatch.llm.common import (
    PieceCache,
    SliceHash,
    byte_table,
    flat_lists,
    kept_in_worker,
    list_array,
    map_batches,
    prepare,
    ragged,
    shared_folder,
    table,
    text_bytes,
    text_slices,
    word_starts_ends,
    written,
)

END_ID = 1
#: ASCII punctuation that always ends a word; the apostrophe and the characters of special tokens are left out.
MARKS = b"!\"#$%&()*+,-./:;=?@[]^_`{}~"
#: Words sent to the library as one text.
RUN = 1000
MAX_VOCABULARY = 1 << 20
#: Bytes of text in one block, or a single longer text.
BLOCK_BYTES = 1 << 17


class WordEncoder:
    """Ids of texts by the tokenizers library, which is asked once for each distinct piece.

    Pieces are cut at ASCII white space and between an ASCII letter and ASCII punctuation other than the apostrophe:
    the vocabulary's own rule ends a word at all these places and drops the white space. Pieces of pure ASCII are
    looked up in lower case, as the vocabulary lower-cases them; all others, and those that may hold a special token, are
    left as they are.
    """

    def __init__(self, content: bytes) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(zlib.decompress(content).decode("utf-8"))
        self.tokenizer.encode_special_tokens = False
        self.hash = SliceHash()
        self.cache = PieceCache(self.make)
        self.space = byte_table(lambda b: b == 32 or 9 <= b <= 13)
        self.letter = byte_table(lambda b: 65 <= b <= 90 or 97 <= b <= 122)
        self.mark = byte_table(lambda b: b in MARKS)
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def make(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Pieces that are one word of the vocabulary's rule each are sent as running text and told apart by the ids that
        end words, as long as these are as many as the pieces; all others are sent one by one."""
        alone, together, texts = [], [], []
        for i, piece in enumerate(pieces):
            text = self.one_word(piece)
            if text is None:
                alone.append(i)
            else:
                together.append(i)
                texts.append(text)
        runs = [(together[i : i + RUN], texts[i : i + RUN]) for i in range(0, len(texts), RUN)]
        found = []
        for (indices, _), coded in zip(runs, self.tokenizer.encode_batch_fast([" ".join(text) for _, text in runs], add_special_tokens=False), strict=True):
            ids = np.array(coded.ids, np.int32)
            ends = np.flatnonzero(self.ends_word[ids]) + 1
            if len(ends) == len(indices):
                found.append((np.array(indices), ids, np.diff(ends, prepend=0)))
            else:
                alone += indices
        coded = self.tokenizer.encode_batch_fast([pieces[i].decode("utf-8") for i in alone], add_special_tokens=False)
        found.append((np.array(alone, np.int64), *flat_lists([one.ids for one in coded])))
        lengths = np.zeros(len(pieces), np.int64)
        for indices, _, own in found:
            lengths[indices] = own
        starts = np.cumsum(lengths) - lengths
        out = np.zeros(int(lengths.sum()), np.int32)
        for indices, ids, own in found:
            out[ragged(starts[indices], own)] = ids
        return out, lengths

    def one_word(self, piece: bytes) -> str | None:
        """The piece in lower case, if it is only letters or only marks and stays as it is under normalisation."""
        if piece.isascii():
            return piece.decode("ascii") if piece.isalpha() or not piece.translate(None, MARKS) else None
        text = piece.decode("utf-8")
        if not text.isalpha() or max(text) >= "\u0250" or not unicodedata.is_normalized("NFC", text):
            return None
        text = text.lower()
        return text if text.isalpha() and unicodedata.is_normalized("NFC", text) else None

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        data, offsets = text_bytes(column)
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(column), np.int64)
        high = np.zeros(len(data) + 1, np.int64)
        np.cumsum((data >= 128) | (data == ord("|")), out=high[1:])
        letter, mark = self.letter[data], self.mark[data]
        starts, ends = word_starts_ends(~self.space[data], offsets)
        cuts = np.flatnonzero((letter[:-1] & mark[1:]) | (mark[:-1] & letter[1:])) + 1
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        cuts = cuts[~edge[cuts]]
        starts = np.sort(np.concatenate([starts, cuts]))
        ends = np.sort(np.concatenate([ends, cuts]))
        folded = data.copy()
        upper = (data >= 65) & (data <= 90)
        folded[upper] += 32
        mixed_piece = high[ends] > high[starts]
        if mixed_piece.any():  # those keep their case
            keep = np.zeros(len(data) + 1, np.int8)
            keep[starts[mixed_piece]] += 1
            keep[ends[mixed_piece]] -= 1
            kept = np.cumsum(keep[:-1]).astype(bool)
            folded[kept] = data[kept]
        content = folded.tobytes()
        ids, counts = self.cache.look_up(self.hash.slices(self.hash.prefix(folded), starts, ends), lambda i: content[starts[i] : ends[i]])
        places = np.zeros(len(starts) + 1, np.int64)
        np.cumsum(counts, out=places[1:])
        return ids, np.diff(places[np.searchsorted(starts, offsets)])


def token_blocks(frame: DataFrame, tokenizer_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Blocks of neighbouring rows of each partition: ``part``, ``block``, ``start``, ``keys``, ``counts`` and ``ids``
    (little-endian, of ``width`` bytes each), with the end id after every text."""
    with open(tokenizer_path, "rb") as file:
        content = zlib.compress(file.read())
    version = zlib.crc32(content)
    kind = frame.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = kept_in_worker(("word encoder", version), lambda: WordEncoder(content))
        width = 2 if len(encoder.ends_word) <= 1 << 16 else 4
        held = block = 0
        for batch in batches:
            for step in text_slices(batch):
                coded, counts = encoder.encode(step.column("text"))
                coded = np.insert(coded, np.cumsum(counts), END_ID).astype(f"<u{width}")
                counts, row, place = (counts + 1).astype(np.int32), 0, 0
                for rows in text_slices(step, limit=BLOCK_BYTES):
                    own = counts[row : row + rows.num_rows]
                    size = int(own.sum())
                    one = lambda x: list_array(x, np.array([len(x)]))
                    yield pa.RecordBatch.from_arrays(
                        [rows.column("part")[:1], pa.array([block], pa.int32()), pa.array([held], pa.int64()), one(rows.column("key")), one(pa.array(own)), pa.array([width], pa.int32()), pa.array([coded[place : place + size].tobytes()])],
                        ["part", "block", "start", "keys", "counts", "width", "ids"],
                    )
                    held, block, row, place = held + size, block + 1, row + rows.num_rows, place + size

    prepare(frame.sparkSession)
    numbered = frame.select(F.spark_partition_id().alias("part"), F.col(key).alias("key"), F.col(text).alias("text"))
    return numbered.mapInArrow(run, f"part int, block int, start long, keys array<{kind}>, counts array<int>, width int, ids binary")


def plain_ids(batch: pa.RecordBatch, row: int) -> np.ndarray:
    return np.frombuffer(batch.column("ids")[row].as_py(), f"<u{batch.column('width')[row].as_py()}")


def frequency_codes(blocks: DataFrame) -> DataFrame:
    """``id`` and ``code``: 0 for the most frequent id, ties by id. Counts are added up in the tasks before they are sent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(0, np.int64)
        for batch in batches:
            for row in range(batch.num_rows):
                found = np.bincount(plain_ids(batch, row), minlength=len(counts))
                found[: len(counts)] += counts
                counts = found
        ids = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int32)), pa.array(counts[ids])], ["id", "n"])

    prepare(blocks.sparkSession)
    counted = blocks.select("width", "ids").mapInArrow(run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n"))
    rows = sorted((-row.n, row.id) for row in counted.limit(MAX_VOCABULARY + 1).collect())
    if len(rows) > MAX_VOCABULARY:
        raise ValueError("more distinct ids than a vocabulary may have")
    return blocks.sparkSession.createDataFrame([(i, code) for code, (_, i) in enumerate(rows)], "id int, code int")


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit values."""
    values = values.astype(np.uint32)
    extra = (values > 0xFF).astype(np.uint8) + (values > 0xFFFF) + (values > 0xFFFFFF)
    quads = np.zeros(-(-len(values) // 4) * 4, np.uint8)
    quads[: len(values)] = extra
    control = (quads.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1, dtype=np.uint8)
    data = values.astype("<u4").view(np.uint8).reshape(-1, 4)
    return control.tobytes(), data[np.arange(4) <= extra[:, None]].tobytes()


#: Bytes of each of the four values of a control byte.
LENGTHS = (np.arange(256, dtype=np.uint8)[:, None] >> np.array([0, 2, 4, 6], np.uint8) & 3) + 1


def unpack(control: bytes, data: bytes, count: int) -> np.ndarray:
    """The values back, by table lookup."""
    lengths = LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:count].astype(np.int64)
    begins = np.cumsum(lengths) - lengths
    padded = np.frombuffer(data + b"\0\0\0", np.uint8).astype(np.uint32)
    out = padded[begins].copy()
    for byte in (1, 2, 3):
        wide = np.flatnonzero(lengths > byte)
        out[wide] |= padded[begins[wide] + byte] << np.uint32(8 * byte)
    return out


def _codes(codes: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Code of every id, and id of every code; not longer than a vocabulary."""
    rows = codes.collect()
    by_id = np.zeros(max((row.id for row in rows), default=0) + 1, np.int64)
    by_code = np.zeros(len(rows) + 1, np.uint32)
    for row in rows:
        by_id[row.id], by_code[row.code] = row.code, row.id
    return by_id, by_code


def write_files(blocks: DataFrame, codes: DataFrame, path: str) -> None:
    """Writes the blocks with their ids packed, a folder for each part, and the codes below ``path``."""
    by_id, _ = _codes(codes)
    kept = [name for name in blocks.columns if name not in ("width", "ids")]

    def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1)
            control, data = pack(by_id[plain_ids(batch, i)])
            yield pa.RecordBatch.from_arrays([*(row.column(name) for name in kept), pa.array([control]), pa.array([data])], [*kept, "control", "data"])

    schema = ", ".join(f"{name} {blocks.schema[name].dataType.simpleString()}" for name in kept)
    packed = map_batches(blocks, step, f"{schema}, control binary, data binary")
    packed.sortWithinPartitions("part", "block").write.option("compression", "none").partitionBy("part").parquet(f"{path}/blocks")
    codes.coalesce(1).write.parquet(f"{path}/codes")


def read_files(spark: SparkSession, path: str, kind: str = "bigint", as_bytes: bool = False) -> DataFrame:
    """Key (of type ``kind``), ``ids`` and ``start`` (ids of all rows before) of every stored row; the ids as an array, or as
    bytes, little-endian, four each."""
    _, by_code = _codes(spark.read.parquet(f"{path}/codes"))
    blocks = spark.read.schema(f"start long, keys array<{kind}>, counts array<int>, control binary, data binary, part int").parquet(f"{path}/blocks")
    # One row per part: as many as there are files, so their running sum is the driver's work.
    sizes = sorted((row.part, row.n) for row in blocks.select("part", "start", "counts").groupBy("part").agg(F.max(F.col("start") + F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n")).collect())
    begins, held = {}, 0
    for part, count in sizes:
        begins[part], held = held, held + count

    def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for i in range(batch.num_rows):
            counts = batch.column("counts")[i].values.to_numpy()
            ids = by_code[unpack(batch.column("control")[i].as_py(), batch.column("data")[i].as_py(), int(counts.sum()))]
            start = begins[batch.column("part")[i].as_py()] + batch.column("start")[i].as_py() + np.cumsum(counts) - counts
            if as_bytes:
                places = np.append(0, np.cumsum(counts) * 4).astype(np.int32)
                out = pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(places.tobytes()), pa.py_buffer(ids.astype("<u4").tobytes())])
            else:
                out = list_array(pa.array(ids.astype(np.int32)), counts)
            yield pa.RecordBatch.from_arrays([batch.column("keys")[i].values, pa.array(start), out], ["key", "start", "ids"])

    return map_batches(blocks, step, f"key {kind}, start long, ids {'binary' if as_bytes else 'array<int>'}")


def store(frame: DataFrame, tokenizer_path: str, path: str, key: str = "doc_id", text: str = "text") -> None:
    """Tokenises ``frame`` and writes its files in ascending order of the key, in as many parts as the session's shuffles have."""
    parts = int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = frame.select(F.col(key), F.col(text)).repartitionByRange(parts, key).sortWithinPartitions(key)
    blocks = written(token_blocks(ordered, tokenizer_path, key, text), "token-blocks", "lz4")
    write_files(blocks, frequency_codes(blocks), path)


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark)}/llm/token-files-{uuid.uuid4().hex}"
    store(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), path)
    ids = F.col("ids")
    return read_files(spark, path, as_bytes=True).select(F.col("key").alias("doc_id"), "start", (F.octet_length(ids) / 4).cast("long").alias("n_tokens"), F.crc32(ids).alias("ids_crc32"))
