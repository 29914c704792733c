"""Operator 8: byte-level BPE encoding and decoding.

Pre-tokenisation without a regular expression: code points become symbols, every symbol is a function between the
states of a small automaton, and since composing functions is associative, blocks of text are scanned side by side and
joined afterwards. The slices between the boundaries go through cached pair merging; every id keeps its byte offset,
by which decoding puts its bytes in place.

Defined results: a null or empty text has no ids and decodes to no bytes; very long texts and pieces are encoded
whole (long pieces by a heap); repeated rows repeat their result; an empty table gives an empty one; of the input only
the key and the text column are read, whatever else it holds.
"""

from __future__ import annotations

import base64
import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stakewatch.llm.common import PieceCache, SliceHash, flat_lists, kept_in_worker, list_array, map_batches, ragged, table, text_bytes, text_slices

#: Classes of code points.
LETTER, NUMBER, OTHER, SPACE, BLANK = range(5)
#: Symbols of the automaton: the classes with the little they need to know of what follows.
S_LETTER, S_NUMBER, S_OTHER, S_SHORT, S_LONG, S_WHITE, S_LAST_BLANK, S_LAST_WHITE = range(8)
#: States: nothing open, in letters, in numbers, in others, after a blank that joins, in white space, and one or two
#: letters of a contraction to come.
FREE, IN_LETTERS, IN_NUMBERS, IN_OTHERS, AFTER_BLANK, IN_WHITE, ONE_MORE, TWO_MORE = range(8)
BLOCK = 64
#: Bytes of text that boundaries are looked for in at a time (a longer text is one step), and pieces that a worker keeps: their
#: arrays stay in the worker's memory, whatever comes after this operator.
SCAN_BYTES = 1 << 18
CACHED_PIECES = 400_000


def code_point_classes() -> bytes:
    """Class of every code point, as the public library's own regular expressions see them (compressed)."""
    import tiktoken

    single = {bytes([b]): b for b in range(256)}
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    text, classes = "".join(points), np.full(0x110000, OTHER, np.uint8)
    for name, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        found = tiktoken.Encoding("class", pat_str=pattern, mergeable_ranks=single, special_tokens={}).encode_ordinary(text)
        classes[np.frombuffer(bytes(found).decode("utf-8").encode("utf-32-le"), np.uint32)] = name
    classes[32] = BLANK
    return zlib.compress(classes.tobytes())


def automaton() -> tuple[np.ndarray, np.ndarray]:
    """Next state and whether a slice starts, by symbol and state; the second eight symbols are those at a text's start."""
    goes = np.zeros((16, 8), np.uint8)
    starts = np.ones((16, 8), bool)
    for symbol, state in ((S_LETTER, IN_LETTERS), (S_NUMBER, IN_NUMBERS), (S_OTHER, IN_OTHERS), (S_SHORT, ONE_MORE), (S_LONG, TWO_MORE), (S_WHITE, IN_WHITE), (S_LAST_BLANK, AFTER_BLANK), (S_LAST_WHITE, FREE)):
        goes[symbol] = goes[symbol + 8] = state
    for symbol, state, to in (
        (S_LETTER, IN_LETTERS, IN_LETTERS), (S_LETTER, AFTER_BLANK, IN_LETTERS), (S_LETTER, ONE_MORE, FREE), (S_LETTER, TWO_MORE, ONE_MORE),
        (S_NUMBER, IN_NUMBERS, IN_NUMBERS), (S_NUMBER, AFTER_BLANK, IN_NUMBERS), (S_OTHER, IN_OTHERS, IN_OTHERS), (S_OTHER, AFTER_BLANK, IN_OTHERS),
        (S_SHORT, IN_OTHERS, IN_OTHERS), (S_SHORT, AFTER_BLANK, IN_OTHERS), (S_LONG, IN_OTHERS, IN_OTHERS), (S_LONG, AFTER_BLANK, IN_OTHERS),
        (S_WHITE, IN_WHITE, IN_WHITE),
    ):
        goes[symbol, state], starts[symbol, state] = to, False
    return goes, starts


def symbols(points: np.ndarray, first: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Symbol of every code point; ``first`` marks where texts begin."""
    kind = classes[points]
    size = len(points)
    following = np.full(size + 2, OTHER, np.uint8)
    following[:size] = kind
    ends = np.empty(size, bool)  # whether the text ends after this point
    ends[-1] = True
    ends[:-1] = first[1:]
    white = kind >= SPACE
    more = ~ends & (following[1 : size + 1] < SPACE)
    out = kind.copy()
    out[white] = S_WHITE
    out[white & more] = S_LAST_WHITE
    out[(kind == BLANK) & more] = S_LAST_BLANK
    quotes = np.flatnonzero(points == 39)
    if len(quotes):
        padded = np.append(points, [0, 0]).astype(np.uint32)
        closed = np.append(ends, [True, True])
        one, two = padded[quotes + 1], padded[quotes + 2]
        open_one = ~closed[quotes]
        open_two = open_one & ~closed[quotes + 1]
        short = open_one & np.isin(one, [ord(c) for c in "stmd"])
        long = open_two & (((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l"))))
        out[quotes[short]] = S_SHORT
        out[quotes[long]] = S_LONG
    return out + 8 * first.astype(np.uint8)


def scan(symbol: np.ndarray, goes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Whether a slice starts at each symbol. Every block is one function between states; these are composed by an
    inclusive scan of doubling steps, then each block is run once more from the state it really begins in."""
    size = len(symbol)
    count = -(-size // BLOCK)
    grid = np.zeros(count * BLOCK, np.uint8)
    grid[:size] = symbol
    columns = np.ascontiguousarray(grid.reshape(count, BLOCK).T)
    flat_goes, flat_starts = goes.ravel(), starts.ravel()
    function = np.tile(np.arange(8, dtype=np.uint8), (count, 1))
    for column in columns:
        function = flat_goes[(column * np.uint8(8))[:, None] + function]
    step = 1
    while step < count:
        later = np.take_along_axis(function[step:], function[:-step].astype(np.intp), axis=1)
        function = np.concatenate([function[:step], later])
        step *= 2
    state = np.zeros(count, np.uint8)
    state[1:] = function[:-1, FREE]
    marks = np.empty((BLOCK, count), bool)
    for row, column in enumerate(columns):
        at = column * np.uint8(8) + state
        marks[row] = flat_starts[at]
        state = flat_goes[at]
    return marks.T.ravel()[:size]


NO_RANK = 1 << 30
#: Pieces above this many bytes are merged one at a time by a heap.
LONG_PIECE = 96


def mergeable_pairs(ranks: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of ids that merge, as sorted keys, and the id that each becomes."""
    pairs = {}
    for token, rank in ranks.items():
        for cut in range(1, len(token)):
            left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
            if left is not None and right is not None:
                pairs[left << 20 | right] = rank
    keys = np.array(sorted(pairs), np.int64)
    return keys, np.array([pairs[key] for key in keys.tolist()], np.int32)


class Merger:
    """Pair merging by rank, as the public library does it: lowest rank first, leftmost among equals."""

    def __init__(self, ranks: dict[bytes, int], keys: np.ndarray, merged: np.ndarray) -> None:
        self.ranks, self.keys, self.merged = ranks, keys, merged
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)

    def __call__(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        out: list[list[int] | None] = [None] * len(pieces)
        several = []
        for i, piece in enumerate(pieces):
            if piece in self.ranks:
                out[i] = [self.ranks[piece]]
            elif len(piece) > LONG_PIECE:
                out[i] = self.merge_long(piece)
            else:
                several.append(i)
        for i, ids in zip(several, self.merge_many([pieces[i] for i in several]), strict=True):
            out[i] = ids
        return flat_lists(out)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 20 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.merged[at], NO_RANK)

    def merge_many(self, pieces: list[bytes]) -> list[list[int]]:
        """Merges side by side: each round does one merge in every piece that has one left."""
        done: list[list[int]] = [[]] * len(pieces)
        if not pieces:
            return done
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ids = self.of_byte[np.frombuffer(b"".join(pieces), np.uint8)]
        owner = np.repeat(np.arange(len(pieces)), lengths)
        rank = np.full(len(ids), NO_RANK, np.int64)
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        rank[inner] = self.pair_ranks(ids[inner], ids[inner + 1])
        while len(ids):
            heads = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            sizes = np.diff(np.append(heads, len(ids)))
            least = np.minimum.reduceat(rank, heads)
            over = least == NO_RANK
            if over.any():
                for head, size in zip(heads[over].tolist(), sizes[over].tolist(), strict=True):
                    done[owner[head]] = ids[head : head + size].tolist()
                left = np.repeat(~over, sizes)
                ids, owner, rank = ids[left], owner[left], rank[left]
                heads, sizes, least = None, sizes[~over], least[~over]
                if not len(ids):
                    break
            at = np.flatnonzero(rank == np.repeat(least, sizes))
            at = at[np.r_[True, owner[at[1:]] != owner[at[:-1]]]]
            ids[at] = rank[at]
            stays = np.ones(len(ids), bool)
            stays[at + 1] = False
            at = at - np.arange(len(at))
            ids, owner, rank = ids[stays], owner[stays], rank[stays]
            again = np.concatenate([at, at[at > 0] - 1])
            rank[again] = NO_RANK
            again = again[again + 1 < len(ids)]
            again = again[owner[again] == owner[again + 1]]
            rank[again] = self.pair_ranks(ids[again], ids[again + 1])
        return done

    def merge_long(self, piece: bytes) -> list[int]:
        """The same with a heap and linked neighbours, so that a piece of any length takes n log n steps."""
        ranks, size = self.ranks, len(piece)
        end, before = list(range(1, size + 1)), list(range(-1, size - 1))
        alive = [True] * size

        def pair(i: int) -> tuple[int, int, int, int] | None:
            j = end[i]
            if j >= size or (rank := ranks.get(piece[i : end[j]])) is None:
                return None
            return rank, i, j, end[j]

        heap = [found for i in range(size) if (found := pair(i))]
        heapq.heapify(heap)
        while heap:
            _, i, j, stop = heapq.heappop(heap)
            if not (alive[i] and alive[j] and end[i] == j and end[j] == stop):
                continue
            alive[j], end[i] = False, stop
            if stop < size:
                before[stop] = i
            for k in (before[i], i):
                if k >= 0 and (found := pair(k)):
                    heapq.heappush(heap, found)
        out, i = [], 0
        while i < size:
            out.append(ranks[piece[i : end[i]]])
            i = end[i]
        return out


def parse_ranks(content: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in content.splitlines() if line)}


class Encoder:
    """Encodes slices of batches; made once in each task."""

    def __init__(self, ranks: bytes, pairs: tuple[np.ndarray, np.ndarray], classes: bytes) -> None:
        self.classes = np.frombuffer(zlib.decompress(classes), np.uint8)
        self.goes, self.starts = automaton()
        self.hash = SliceHash()
        ranked = parse_ranks(zlib.decompress(ranks))
        self.cache = PieceCache(Merger(ranked, *pairs), CACHED_PIECES)
        self.token_length = np.zeros(max(ranked.values()) + 1, np.int64)
        for token, rank in ranked.items():
            self.token_length[rank] = len(token)

    def boundaries(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Byte positions at which slices start."""
        points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        lead = np.flatnonzero((data & 0xC0) != 0x80)
        first = np.zeros(len(data) + 1, bool)
        first[offsets] = True
        return lead[scan(symbols(points, first[lead], self.classes), self.goes, self.starts)]

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, their byte offsets in the text, and the count of each text."""
        data, offsets = text_bytes(column)
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(len(column), np.int64)
        starts = self.boundaries(data, offsets)
        ends = np.append(starts[1:], len(data))
        content = data.tobytes()
        ids, counts = self.cache.look_up(self.hash.slices(self.hash.prefix(data), starts, ends), lambda i: content[starts[i] : ends[i]])
        lengths = self.token_length[ids]
        at = np.cumsum(lengths) - lengths
        rows = np.searchsorted(at, offsets)
        per_text = np.diff(rows)
        return ids, (at - np.repeat(offsets[:-1], per_text)).astype(np.int32), per_text


def encode(frame: DataFrame, ranks_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``frame``: the key, ``ids`` and the byte offset of every id in the UTF-8 text."""
    with open(ranks_path, "rb") as file:
        content = file.read()
    ranks, pairs, classes = zlib.compress(content), mergeable_pairs(parse_ranks(content)), code_point_classes()
    frame = frame.select(F.col(key), F.col(text).alias("text"))
    version = zlib.crc32(content)

    def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        encoder = kept_in_worker(("byte BPE encoder", version), lambda: Encoder(ranks, pairs, classes))
        for part in text_slices(batch, limit=SCAN_BYTES):
            ids, offsets, counts = encoder.encode(part.column("text"))
            yield pa.RecordBatch.from_arrays([part.column(key), list_array(pa.array(ids), counts), list_array(pa.array(offsets), counts)], [key, "ids", "offsets"])

    return map_batches(frame, step, f"{key} {frame.schema[key].dataType.simpleString()}, ids array<int>, offsets array<int>")


def decode(frame: DataFrame, ranks_path: str, key: str = "doc_id") -> DataFrame:
    """Adds ``decoded``, the bytes that the ids stand for, each put at its offset; keeps ``ids``."""
    with open(ranks_path, "rb") as file:
        content = file.read()
    ranks, version = zlib.compress(content), zlib.crc32(content)

    def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        by_id = sorted((rank, token) for token, rank in parse_ranks(zlib.decompress(ranks)).items())
        lengths = np.zeros(by_id[-1][0] + 1, np.int64)
        for rank, token in by_id:
            lengths[rank] = len(token)
        return np.frombuffer(b"".join(token for _, token in by_id), np.uint8), np.cumsum(lengths) - lengths, lengths

    def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        flat, begins, lengths = kept_in_worker(("byte BPE decoder", version), tables)
        for at in range(0, batch.num_rows, 64):
            part = batch.slice(at, 64)
            lists, places = part.column("ids"), part.column("offsets")
            counts = np.diff(lists.offsets.to_numpy())
            ids, offsets = lists.flatten().to_numpy(), places.flatten().to_numpy()
            size = lengths[ids]
            rows = np.repeat(np.arange(len(counts)), counts)
            totals = np.zeros(len(counts), np.int64)
            np.maximum.at(totals, rows, offsets + size)
            texts = np.cumsum(totals) - totals
            out = np.zeros(int(totals.sum()), np.uint8)
            out[ragged(texts[rows] + offsets, size)] = flat[ragged(begins[ids], size)]
            ends = np.append(texts, len(out)).astype(np.int32)
            decoded = pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(out.tobytes())])
            yield pa.RecordBatch.from_arrays([part.column(key), lists, decoded], [key, "ids", "decoded"])

    return map_batches(frame.select(key, "ids", "offsets"), step, f"{key} {frame.schema[key].dataType.simpleString()}, ids array<int>, decoded binary")


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    coded = encode(table(spark, sf_dir, "documents"), path)
    return decode(coded, path).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
