"""Byte-level BPE encoding and decoding on padded numpy matrices.

The distinct pieces of a batch are sorted into buckets by length, one matrix of token ids per
bucket.  In each round every row merges its leftmost pair of minimum rank; ranks of pairs come
from an open-addressing hash table held in two arrays, merged cells are closed by compaction,
and finished rows leave the matrix.  Pieces longer than the widest bucket are merged exactly
with a heap, so no round is ever paid over a very long row.
"""

import base64
import heapq
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Widths of the matrices in bytes; longer pieces go to the heap.
WIDTHS = (6, 8, 10, 12, 16, 32, 64, 128, 256)
#: Cells of one matrix.
CELLS = 1 << 17
#: Pieces remembered by one worker before it starts afresh.
REMEMBERED = 150_000
#: Texts coded at a time.
SLICE = 500
#: Texts above this many characters are split into pieces block by block.
BLOCK_CHARS = 2_000_000

NONE = np.iinfo(np.int32).max
EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


class PairTable:
    """(left id, right id) -> id of the joined token, for whole arrays at a time."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray):
        bits = max(8, int(np.ceil(np.log2(max(1, len(merged)) * 3))))
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, EMPTY)
        self.values = np.full(1 << bits, NONE, np.int32)
        keys, values = self.key(left, right), merged.astype(np.int32)
        slot = self.slot(keys)
        while keys.size:
            free = np.flatnonzero(self.keys[slot] == EMPTY)
            _, first = np.unique(slot[free], return_index=True)
            taken = free[first]
            self.keys[slot[taken]] = keys[taken]
            self.values[slot[taken]] = values[taken]
            rest = np.ones(keys.size, bool)
            rest[taken] = False
            keys, values = keys[rest], values[rest]
            slot = (slot[rest] + 1) & self.mask

    @staticmethod
    def key(left, right):
        return (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)

    def slot(self, keys):
        return ((keys * MULTIPLIER) >> self.shift).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, NONE for pairs that are no token or hold padding (negative ids)."""
        out = np.full(left.size, NONE, np.int32)
        at = np.flatnonzero((left >= 0) & (right >= 0))
        keys = self.key(left[at], right[at])
        slot = self.slot(keys)
        while at.size:
            found = self.keys[slot]
            hit = found == keys
            out[at[hit]] = self.values[slot[hit]]
            go = ~hit & (found != EMPTY)
            at, keys, slot = at[go], keys[go], (slot[go] + 1) & self.mask
        return out


class Vocabulary:
    """Tokens by rank, the table of mergeable pairs, and a memory of encoded pieces."""

    def __init__(self, ranks: bytes, pattern: str):
        pairs = (line.split() for line in ranks.splitlines() if line.strip())
        self.ids = {base64.b64decode(token): int(rank) for token, rank in pairs}
        self.tokens = [b""] * (max(self.ids.values()) + 1)
        for token, rank in self.ids.items():
            self.tokens[rank] = token
        splits = [
            (self.ids[token[:i]], self.ids[token[i:]], rank)
            for token, rank in self.ids.items()
            for i in range(1, len(token))
            if token[:i] in self.ids and token[i:] in self.ids
        ]
        self.pairs = PairTable(*np.array(splits, np.int64).reshape(-1, 3).T)
        self.of_byte = np.array([self.ids[bytes([b])] for b in range(256)], np.int32)
        self.pattern = regex.compile(pattern)
        self.memory: dict[str, bytes] = {}

    def merge_rows(self, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merged ids of all rows one after another, and how many each row has.

        ``cells`` holds one piece per row, padded with -1.
        """
        out, sizes = np.full(cells.shape, -1, np.int32), np.zeros(len(cells), np.int64)
        row, length = np.arange(len(cells)), (cells >= 0).sum(axis=1)
        ranks = self.pairs.ranks(cells[:, :-1].ravel(), cells[:, 1:].ravel())
        ranks = ranks.reshape(len(cells), -1)
        while row.size:
            at = ranks.argmin(axis=1)  # the first of equal minima: the leftmost
            best = ranks[np.arange(len(row)), at]
            done = best == NONE
            if done.any():
                out[row[done], : cells.shape[1]] = cells[done]
                sizes[row[done]] = length[done]
                keep = ~done
                row, length, at, best = (x[keep] for x in (row, length, at, best))
                width = int(length.max(initial=0))
                cells, ranks = cells[keep, :width], ranks[keep, : max(width - 1, 0)]
                if not row.size:
                    break
            every, width = np.arange(len(row)), cells.shape[1]
            cells[every, at] = best
            length = length - 1
            moved = np.arange(width - 1)[None, :] > at[:, None]
            cells[:, :-1] = np.where(moved, cells[:, 1:], cells[:, :-1])
            cells[:, -1] = -1
            ranks[:, :-1] = np.where(moved[:, :-1], ranks[:, 1:], ranks[:, :-1])
            ranks[:, -1] = NONE
            for side in (at - 1, at):
                ok = np.flatnonzero((side >= 0) & (side < width - 1))
                s = side[ok]
                ranks[ok, s] = self.pairs.ranks(cells[ok, s], cells[ok, s + 1])
        return out[out >= 0], sizes

    def merge_long(self, piece: bytes) -> list[int]:
        """One piece of any length: a heap of (rank, start) over a linked list."""
        ids = self.of_byte[np.frombuffer(piece, np.uint8)].tolist()
        n = len(ids)
        after, ahead = list(range(1, n + 1)), list(range(-1, n - 1))
        rank = self.pairs.ranks(np.array(ids[:-1]), np.array(ids[1:])).tolist() + [NONE]
        heap = [(r, i) for i, r in enumerate(rank) if r != NONE]
        heapq.heapify(heap)
        get, tokens = self.ids.get, self.tokens

        def renew(i):
            j = after[i]
            rank[i] = NONE if j >= n else get(tokens[ids[i]] + tokens[ids[j]], NONE)
            if rank[i] != NONE:
                heapq.heappush(heap, (rank[i], i))

        while heap:
            r, i = heapq.heappop(heap)
            if rank[i] != r:
                continue
            j = after[i]
            ids[i], after[i], rank[j] = r, after[j], NONE
            if after[j] < n:
                ahead[after[j]] = i
            renew(i)
            if ahead[i] >= 0:
                renew(ahead[i])
        out, i = [], 0
        while i < n:
            out.append(ids[i])
            i = after[i]
        return out

    def learn(self, pieces) -> None:
        """Encode pieces that are not yet in memory."""
        pieces = list(pieces)
        raws = [piece.encode() for piece in pieces]
        whole = np.array([rank is not None for rank in map(self.ids.get, raws)], bool)
        sizes = np.fromiter(map(len, raws), np.int64, len(raws))
        for i in np.flatnonzero(whole):
            self.memory[pieces[i]] = self.ids[raws[i]].to_bytes(4, "little")
        for i in np.flatnonzero(~whole & (sizes > WIDTHS[-1])):
            self.memory[pieces[i]] = np.array(self.merge_long(raws[i]), "<u4").tobytes()
        for under, width in zip((0, *WIDTHS), WIDTHS, strict=False):
            bucket = np.flatnonzero(~whole & (sizes > under) & (sizes <= width))
            for i in range(0, len(bucket), CELLS // width):
                part = bucket[i : i + CELLS // width]
                flat = np.frombuffer(b"".join([raws[k] for k in part]), np.uint8)
                cells = np.full((len(part), width), -1, np.int32)
                cells[np.arange(width)[None, :] < sizes[part][:, None]] = self.of_byte[flat]
                ids, counts = self.merge_rows(cells)
                packed, ends = ids.astype("<u4").tobytes(), np.cumsum(counts * 4).tolist()
                self.memory.update(
                    (pieces[k], packed[a:b])
                    for k, a, b in zip(part, [0, *ends], ends, strict=False)
                )

    def blocks(self, text: str) -> Iterator[list[str]]:
        if len(text) <= BLOCK_CHARS:
            yield self.pattern.findall(text)
            return
        found = (m.group() for m in self.pattern.finditer(text))
        while block := list(islice(found, 200_000)):
            yield block

    def encode_block(self, pieces: list[str]) -> bytes:
        if len(self.memory) > REMEMBERED:
            self.memory.clear()
        self.learn(set(pieces).difference(self.memory))
        return b"".join(map(self.memory.__getitem__, pieces))

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(packed, "<u4").tolist()))

    def encode_series(self, texts) -> list[bytes]:
        """Packed ids of each text; short texts share their matrices."""
        out, waiting, size = [], [], 0

        def flush():
            nonlocal waiting, size
            if len(self.memory) > REMEMBERED:
                self.memory.clear()
            self.learn(set().union(*waiting).difference(self.memory))
            known = self.memory.__getitem__
            out.extend(b"".join(map(known, pieces)) for pieces in waiting)
            waiting, size = [], 0

        for text in texts:
            text = text or ""
            if len(text) > BLOCK_CHARS:
                flush()
                out.append(b"".join(map(self.encode_block, self.blocks(text))))
                continue
            waiting.append(self.pattern.findall(text))
            size += len(text)
            if size > BLOCK_CHARS:
                flush()
        flush()
        return out


_LOADED: dict[tuple, Vocabulary] = {}


def _vocabulary(ranks: bytes, pattern: str) -> Vocabulary:
    key = (hash(ranks), pattern)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Vocabulary(ranks, pattern)
    return _LOADED[key]


class Codec:
    """Column functions for one rank file.

    ``ranks_path`` is read once on the driver (a file of tokens in base64 with their ranks,
    under 1 MB for 50,000 tokens) and travels with the tasks, so executors need no copy.
    ``pattern`` splits a text before merging; every match is encoded by itself.
    """

    def __init__(self, spark: SparkSession, ranks_path: str, pattern: str):
        with open(ranks_path, "rb") as file:
            self.ranks = spark.sparkContext.broadcast(file.read())
        self.pattern = pattern

    def encode(self, text: Column) -> Column:
        """Ids of the whole text, packed as little-endian unsigned 32-bit integers.

        Null and empty texts give empty ids.  ``id_array`` unpacks them.
        """
        ranks, pattern = self.ranks, self.pattern

        @F.pandas_udf(T.BinaryType())
        def packed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            words = _vocabulary(ranks.value, pattern)
            for texts in batches:
                yield pd.Series(words.encode_series(texts), dtype=object)

        return packed(text)

    def decode(self, ids: Column) -> Column:
        """Bytes of packed ids; null ids give empty bytes."""
        ranks, pattern = self.ranks, self.pattern

        @F.pandas_udf(T.BinaryType())
        def raw(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            words = _vocabulary(ranks.value, pattern)
            for packed in batches:
                yield pd.Series([words.decode(x or b"") for x in packed], dtype=object)

        return raw(ids)


    def round_trip(self, df: DataFrame, text: str, ids: str = "ids", decoded: str = "decoded"):
        """``df`` with the packed ids of column ``text`` and the bytes decoded from those ids.

        Columns of those names are replaced, the text column too if it has one; all others stay.  One
        Python worker does both, on
        slices of a batch, so the memory of a task is bounded by a few hundred texts.
        """
        ranks, pattern = self.ranks, self.pattern
        rest = [f for f in df.schema.fields if f.name not in (ids, decoded)]
        source = df.select(*[F.col(f"`{f.name}`") for f in rest], F.col(f"`{text}`").alias("_".join(["text", *df.columns])))

        def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            words = _vocabulary(ranks.value, pattern)
            for batch in batches:
                for start in range(0, batch.num_rows, SLICE):
                    part = batch.slice(start, SLICE)
                    coded = words.encode_series(part.columns[-1].to_pylist())
                    raw = map(words.decode, coded)
                    columns = [*part.columns[:-1], pa.array(coded, pa.binary()), pa.array(raw, pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, [*part.schema.names[:-1], ids, decoded])

        added = T.StructType().add(ids, T.BinaryType()).add(decoded, T.BinaryType())
        return source.mapInArrow(code, T.StructType([*rest, *added.fields]))


@F.pandas_udf(T.ArrayType(T.LongType()))
def id_array(ids: pd.Series) -> pd.Series:
    """Packed ids as an array."""
    return pd.Series([np.frombuffer(x or b"", "<u4").astype(np.int64) for x in ids], dtype=object)
