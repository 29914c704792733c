"""Operator 9: benchmark decontamination as a prefix-filtered join of word sequences.

An item is cut into windows of ``WINDOW`` words (a shorter item is one window). All ``TOKEN``-word shingles of the windows
(shorter ones for windows of fewer words) are counted over all documents; the rarest of a window is its prefix, without
which no document can hold the window. Documents are read once more for occurrences of prefix shingles; each brings the
words around it, as far as a window may reach. Occurrences join the windows by the shingle, the length bound keeps windows
that fit into the document at this place (position minus the prefix's place in the window), and the words of the whole
window are compared one by one before the place counts as a hit.

Tasks test shingles against a bit table that is sized by the number of windows and at most ``TABLE_BITS`` large; beyond
that it lets more candidates through, which the join then drops. So neither side has to fit anywhere.

Defined results: a null text or one without words has no words, no hits and is clean; null items and items without words
have no windows; repeated rows of a document each get their own result; repeated items all count; very long texts are
read whole; an empty table on either side gives no hits; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stakewatch.llm.common import U64, SliceHash, byte_table, kept_in_worker, list_array, lower_ascii, map_batches, shingle_hashes, table, text_bytes, text_slices, word_starts_ends, written

WINDOW = 13
TOKEN = 3
#: At least so many bits of the table for a window, and the most it may have (a megabyte).
BITS_PER_WINDOW, TABLE_BITS = 64, 1 << 23


class Words:
    """Hashes of the words of a batch of texts."""

    def __init__(self) -> None:
        self.hash = SliceHash()
        self.word = byte_table(lambda b: 48 <= b <= 57 or 97 <= b <= 122 or b >= 128)

    def of(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Word hashes, text after text, and where each text begins."""
        data, offsets = text_bytes(column)
        data = lower_ascii(data)
        starts, ends = word_starts_ends(self.word[data], offsets)
        return self.hash.slices(self.hash.prefix(data), starts, ends), np.searchsorted(starts, offsets)


def _words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return kept_in_worker("decontamination words", Words).of(column)


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of ``size`` words, told apart from those of other sizes."""
    return shingle_hashes(words, size) + U64(size)


def windows(items: DataFrame, item: str = "item_id", text: str = "text") -> DataFrame:
    """``item``, ``window`` (its word hashes) and ``shingles`` (hashes of all its shingles, by place), each window once."""

    def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batch):
            words, first = _words(part.column("text"))
            rows, cuts = [], []
            for row, (begin, end) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
                size = min(WINDOW, end - begin)
                for at in range(begin, end - size + 1 if size else begin):
                    rows.append(row)
                    cuts.append(words[at : at + size])
            tokens = [shingles(cut, min(TOKEN, len(cut))) for cut in cuts]
            pack = lambda lists: list_array(pa.array(np.concatenate([np.zeros(0, U64), *lists]).view(np.int64)), np.array([len(x) for x in lists], np.int64))
            yield pa.RecordBatch.from_arrays([part.column("item").take(pa.array(rows, pa.int64())), pack(cuts), pack(tokens)], ["item", "window", "shingles"])

    kind = items.schema[item].dataType.simpleString()
    return map_batches(items.select(F.col(item).alias("item"), F.col(text).alias("text")), step, f"item {kind}, window array<long>, shingles array<long>")


def bit_table(hashes: DataFrame, count: int) -> tuple[bytes, int]:
    """Bits of the ``hash`` column folded to the table's size, collected as words of 64 bits, so at most a megabyte."""
    bits = 1 << 12
    while bits < min(TABLE_BITS, BITS_PER_WINDOW * count):
        bits *= 2
    place = F.pmod("hash", F.lit(bits))
    rows = hashes.select((place / 64).cast("int").alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(place, F.lit(64)).cast("int")).alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).collect()
    out = np.zeros(bits // 64, np.int64)
    for row in rows:
        out[row.word] = row.bits
    return np.unpackbits(out.view(np.uint8), bitorder="little").tobytes(), bits


def _hits(words: np.ndarray, first: np.ndarray, sizes: list[int], marks: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the shingles inside the texts that the table lets through."""
    ends = np.repeat(first[1:], np.diff(first))
    places, found = [np.zeros(0, np.int64)], [np.zeros(0, U64)]
    for size in sizes:
        hashes = shingles(words, size)
        passed = np.flatnonzero(marks[(hashes & U64(bits - 1)).astype(np.int64)])
        passed = passed[passed + size <= ends[passed]]
        places.append(passed)
        found.append(hashes[passed])
    return np.concatenate(places), np.concatenate(found)


def rarities(docs: DataFrame, hashes: DataFrame, count: int, sizes: list[int]) -> DataFrame:
    """``hash`` and ``rarity``, how often each of the hashes occurs in all documents."""
    table_bytes, bits = bit_table(hashes, count * TOKEN)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = np.frombuffer(table_bytes, np.uint8).view(bool)
        for batch in batches:
            for part in text_slices(batch):
                words, first = _words(part.column("text"))
                found, n = np.unique(_hits(words, first, sizes, marks, bits)[1], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n)], ["hash", "n"])

    return docs.select("text").mapInArrow(run, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("rarity"))


def occurrences(docs: DataFrame, table_bytes: bytes, bits: int, sizes: list[int]) -> DataFrame:
    """``key``, ``row`` (a number for the row), ``n_words`` and ``found``: hash, place and the words around each candidate."""
    reach = WINDOW - 1

    def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        marks = np.frombuffer(table_bytes, np.uint8).view(bool)
        for part in text_slices(batch):
            words, first = _words(part.column("text"))
            places, hashes = _hits(words, first, sizes, marks, bits)
            owner = np.searchsorted(first, places, side="right") - 1
            order = np.lexsort((places, owner))
            places, hashes, owner = places[order], hashes[order], owner[order]
            begins = np.maximum(first[owner], places - reach)
            ends = np.minimum(first[owner + 1], places + WINDOW)
            lengths = ends - begins
            around = words[np.repeat(begins - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))]
            found = pa.StructArray.from_arrays(
                [pa.array(hashes.view(np.int64)), pa.array(places - first[owner]), pa.array(places - begins), list_array(pa.array(around.view(np.int64)), lengths)], ["hash", "place", "before", "around"]
            )
            yield pa.RecordBatch.from_arrays([part.column("key"), part.column("row"), pa.array(np.diff(first)), list_array(found, np.bincount(owner, minlength=part.num_rows))], ["key", "row", "n_words", "found"])

    kind = docs.schema["key"].dataType.simpleString()
    return map_batches(docs, step, f"key {kind}, row long, n_words long, found array<struct<hash: long, place: long, before: long, around: array<long>>>")


def hit_places(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id") -> tuple[DataFrame, DataFrame]:
    """Every row of ``docs`` as ``key``, ``row`` and ``n_words``; and the verified places: ``row``, ``start``, ``end`` (words) and ``item``."""
    cut = written(windows(items, item), "item-windows")
    several = cut.select(F.explode("shingles").alias("hash")).distinct()
    count = several.count()
    sizes = [row.n for row in cut.select(F.least(F.size("window"), F.lit(TOKEN)).alias("n")).distinct().collect()]
    docs = docs.select(F.col(key).alias("key"), F.monotonically_increasing_id().alias("row"), F.col(text).alias("text"))
    rarity = written(rarities(docs, several, count, sizes), "item-rarities")
    placed = cut.select("item", "window", F.posexplode("shingles").alias("at", "hash")).join(rarity, "hash", "left")
    prefix = placed.groupBy("item", "window").agg(F.min(F.struct(F.coalesce("rarity", F.lit(0)).alias("rarity"), "hash", "at")).alias("rarest"))
    # A window whose rarest shingle no document has cannot occur.
    prefix = written(prefix.where("rarest.rarity > 0").select("item", "window", F.col("rarest.hash").alias("hash"), F.col("rarest.at").cast("long").alias("at")), "prefixes")
    keys = prefix.select("hash").distinct()
    table_bytes, bits = bit_table(keys, keys.count())
    found = written(occurrences(docs, table_bytes, bits, sizes), "occurrences")
    candidates = found.where(F.size("found") > 0).select("row", "n_words", F.explode("found").alias("f")).select("row", "n_words", "f.*")
    start = F.col("place") - F.col("at")
    size = F.size("window")
    fits = (F.col("before") >= F.col("at")) & (start + size <= F.col("n_words"))
    same = F.slice("around", (F.col("before") - F.col("at") + 1).cast("int"), size) == F.col("window")
    hits = candidates.join(prefix, "hash").where(F.when(fits, same).otherwise(False)).select("row", start.alias("start"), (start + size).alias("end"), "item")
    return found.select("key", "row", "n_words"), hits


def contaminated(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id") -> DataFrame:
    """Per row of ``docs``: ``key``, ``n_words``, ``n_hit``, ``items`` (found, as sorted strings) and ``contaminated``."""
    rows, hits = hit_places(docs, items, key, text, item)
    # Places per row are as many as the text has words, items of a place as many as repeat it; both are combined first.
    spans = hits.groupBy("row", "start").agg(F.max("end").alias("end")).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))
    empty = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("upto"))
    union = F.aggregate("spans", empty, lambda a, x: F.struct((a["n"] + F.greatest(F.lit(0).cast("long"), x["end"] - F.greatest(x["start"], a["upto"]))).alias("n"), F.greatest(a["upto"], x["end"]).alias("upto")))
    found = hits.groupBy("row").agg(F.array_sort(F.collect_set(F.col("item").cast("string"))).alias("items"))
    counted = spans.select("row", union["n"].alias("n_hit")).join(found, "row")
    out = rows.join(counted, "row", "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return out.select(F.col("key").alias(key), "n_words", n_hit.alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")
