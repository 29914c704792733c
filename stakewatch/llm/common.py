"""Shared helpers: tables in the shared folder, texts as byte buffers, hashes of slices, ragged arrays."""

from __future__ import annotations

import sys
import tempfile
import types
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

#: Rows of a batch handed to Python, and bytes of text that one vectorised step works on (a longer text is one step).
BATCH_ROWS = 128
STEP_BYTES = 1 << 20

U64 = np.uint64

# Workers get these functions by value, so they need not have the package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__package__])

_own_folder: dict[str, str] = {}


def prepare(spark: SparkSession) -> SparkSession:
    """Small batches, so that a Python worker holds a few megabytes of text whatever the length of the texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``. Only a local session without that setting gets its own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_folder:
        _own_folder[app] = tempfile.mkdtemp(prefix="stakewatch-llm-")
    return _own_folder[app]


def written(frame: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """The rows as a table in the shared folder: cuts the lineage and survives lost executors."""
    spark = frame.sparkSession
    path = f"{shared_folder(spark)}/llm/{name}-{uuid.uuid4().hex}"
    frame.write.option("compression", compression).parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def kept_in_worker(key: object, make: Callable[[], object]) -> object:
    """An object that a Python worker makes once and keeps between tasks: vocabularies, tables, caches of bounded size.

    It hangs on a module of the process, since functions that come by value have no module of their own there."""
    holder = sys.modules.setdefault("_stakewatch_worker", types.ModuleType("_stakewatch_worker"))
    made = holder.__dict__.setdefault("made", {})
    if key not in made:
        made[key] = make()
    return made[key]


def map_batches(frame: DataFrame, step: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """Applies ``step`` to every batch of rows."""
    prepare(frame.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from step(batch)

    return frame.mapInArrow(run, schema)


def text_slices(batch: pa.RecordBatch, column: str = "text", limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a batch into runs of rows with at most ``limit`` bytes of text, at least one row each."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for row, size in enumerate(sizes.tolist()):
        if row > start and held + size > limit:
            yield batch.slice(start, row - start)
            start, held = row, 0
        held += size
    yield batch.slice(start)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, one after the other, and where each begins (one more entry for the end)."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    flat = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return flat, at - at[0]


class SliceHash:
    """64-bit hashes of any slices of a byte array, from prefix sums of a polynomial."""

    BASE = 0x9E3779B97F4A7C15

    def __init__(self) -> None:
        self.values = np.random.default_rng(20240229).integers(1, 2**64 - 1, 256, dtype=U64)
        self.power = self.inverse = np.ones(1, U64)

    def _grow(self, size: int) -> None:
        if len(self.power) <= size:
            size = max(size + 1, STEP_BYTES * 5 // 4)
            powers = []
            for factor in (self.BASE, pow(self.BASE, -1, 2**64)):
                steps = np.full(size, factor, U64)
                steps[0] = 1
                powers.append(np.multiply.accumulate(steps))
            self.power, self.inverse = powers

    def prefix(self, data: np.ndarray) -> np.ndarray:
        self._grow(len(data))
        sums = np.zeros(len(data) + 1, U64)
        np.cumsum(self.values[data] * self.power[: len(data)], out=sums[1:])
        return sums

    def slices(self, prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed((prefix[ends] - prefix[starts]) * self.inverse[starts] + (ends - starts).astype(U64))


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads every bit over the word."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def word_starts_ends(is_word: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of marked bytes that do not reach over the texts' borders."""
    if not len(is_word):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.zeros(len(is_word) + 1, bool)
    first[offsets] = True
    before = np.empty(len(is_word), bool)
    before[0] = False
    before[1:] = is_word[:-1]
    starts = np.flatnonzero(is_word & (~before | first[:-1]))
    after = np.empty(len(is_word), bool)
    after[-1] = False
    after[:-1] = is_word[1:]
    ends = np.flatnonzero(is_word & (~after | first[1:])) + 1
    return starts, ends


def byte_table(inside: Callable[[int], bool]) -> np.ndarray:
    return np.array([inside(b) for b in range(256)])


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """Lower-cases A-Z only."""
    fold = np.arange(256, dtype=np.uint8)
    fold[65:91] += 32
    return fold[data]


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of ``size`` consecutive word hashes, by first word (over the texts' borders, too: the caller leaves those out)."""
    count = len(words) - size + 1
    if count <= 0:
        return np.zeros(0, U64)
    total = np.zeros(count, U64)
    factor = 0xD6E8FEB86659FD93
    for i in range(size):
        total += words[i : i + count] * U64(pow(factor, i + 1, 2**64))
    return mixed(total)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the slices [start, start + length), one after the other."""
    total = int(lengths.sum())
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)


def list_array(values: pa.Array, lengths: np.ndarray) -> pa.Array:
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), values)


class PieceCache:
    """Ids of pieces by hash. ``make`` gets the pieces that are missing and gives their ids, one after the other, and how
    many each has. Empties itself above ``limit`` pieces."""

    def __init__(self, make: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], limit: int = 1_200_000) -> None:
        self.make, self.limit = make, limit
        self.clear()

    def clear(self) -> None:
        self.keys, self.slots = np.zeros(0, U64), np.zeros(0, np.int64)
        self.starts, self.lengths, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def look_up(self, hashes: np.ndarray, piece: Callable[[int], bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces, one after the other, and how many each has; ``piece`` gives the bytes at an index."""
        unique, back = np.unique(hashes, return_inverse=True)
        if len(self.keys) > self.limit:
            self.clear()
        at = np.searchsorted(self.keys, unique)
        known = np.zeros(len(unique), bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == unique[inside]
        missing = np.flatnonzero(~known)
        if len(missing):
            where = np.empty(len(unique), np.int64)
            where[back] = np.arange(len(hashes))
            ids, lengths = self.make([piece(i) for i in where[missing].tolist()])
            slots = len(self.starts) + np.arange(len(missing))
            self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(lengths) - lengths])
            self.lengths, self.ids = np.concatenate([self.lengths, lengths]), np.concatenate([self.ids, ids.astype(np.int32)])
            self.keys, self.slots = np.insert(self.keys, at[missing], unique[missing]), np.insert(self.slots, at[missing], slots)
            at = np.searchsorted(self.keys, unique)
        slots = self.slots[at][back]
        lengths = self.lengths[slots]
        return self.ids[ragged(self.starts[slots], lengths)], lengths


def flat_lists(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter((x for one in lists for x in one), np.int32, int(lengths.sum())), lengths
