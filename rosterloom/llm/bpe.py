"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

Merging a pre-token keeps a linked list of its parts. Every mergeable pair sits
in the bucket of its merge rank, which holds list positions; a two-level bitmap
over the ranks says which buckets are in use. Find-first-set on both levels
yields the lowest rank, the bucket its leftmost position; an entry whose pair
has changed meanwhile is stale and skipped. So a pre-token of n bytes takes
O(n log n) steps at worst, whatever its length.

Nulls encode as the empty text; a text is encoded whole, however long. Ids decode
to exactly the bytes encoded. Equal rows, and rows of equal or null id, give a row
each; an empty table gives an empty one. Extra columns are not read, whatever
their names.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from rosterloom.llm.pretoken import Lexicon, chunk_ids
from rosterloom.llm.textbuf import bounded_batches, chunks, ragged

#: Single bits. A lower bitmap has 256 ranks, the upper one a bit for each lower one.
_BIT = [1 << i for i in range(4096)]


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a .tiktoken file: a base64 token and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def merge_piece(piece: bytes, ranks: dict[bytes, int], low: list[int]) -> list[int]:
    """The ids of one pre-token. low: the lower bitmaps, all zero before and after."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    rank_of = ranks.get
    after = list(range(1, n + 1))  # start of the next part; n at the end
    before = list(range(-1, n))
    rank_at = [-1] * n  # current rank of the pair that starts here
    buckets: dict[int, list[int]] = {}
    high = 0
    for i in range(n - 1):
        rank = rank_of(piece[i : i + 2])
        if rank is not None:
            rank_at[i] = rank
            if rank in buckets:
                buckets[rank].append(i)
            else:
                buckets[rank] = [i]
                upper = rank >> 8
                low[upper] |= _BIT[rank & 255]
                high |= _BIT[upper]
    while high:
        upper = (high & -high).bit_length() - 1
        word = low[upper]
        rank = (upper << 8) + (word & -word).bit_length() - 1
        bucket = buckets[rank]
        if len(bucket) > 1:
            i = heappop(bucket)
        else:
            i = bucket[0]
            del buckets[rank]
            low[upper] = word = word & (word - 1)
            if not word:
                high &= high - 1
        if rank_at[i] != rank:
            continue  # stale
        j = after[i]
        k = after[j]
        after[i] = k
        before[k] = i
        rank_at[j] = -1
        if k < n:
            rank = rank_of(piece[i : after[k]], -1)
            rank_at[i] = rank
            if rank >= 0:
                if rank in buckets:
                    heappush(buckets[rank], i)
                else:
                    buckets[rank] = [i]
                    upper = rank >> 8
                    low[upper] |= _BIT[rank & 255]
                    high |= _BIT[upper]
        else:
            rank_at[i] = -1
        if i:
            p = before[i]
            rank = rank_of(piece[p:k], -1)
            rank_at[p] = rank
            if rank >= 0:
                if rank in buckets:
                    heappush(buckets[rank], p)
                else:
                    buckets[rank] = [p]
                    upper = rank >> 8
                    low[upper] |= _BIT[rank & 255]
                    high |= _BIT[upper]
    out, i = [], 0
    while i < n:
        j = after[i]
        out.append(ranks[piece[i:j]])
        i = j
    return out


class Encoder:
    """Encodes and decodes batches; one per Python worker, see ``encoder``."""

    def __init__(self, path: str, pattern: str) -> None:
        self.ranks = load_ranks(path)
        # the rank files' own library takes \s as the White_Space property
        self._pattern = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        self._low = [0] * ((max(self.ranks.values(), default=0) >> 8) + 1)
        self.lexicon = Lexicon(lambda pieces: [merge_piece(p, self.ranks, self._low) for p in pieces])
        tokens = [b""] * (max(self.ranks.values(), default=-1) + 1)
        for token, rank in self.ranks.items():
            tokens[rank] = token
        self._bytes = np.frombuffer(b"".join(tokens), dtype=np.uint8)
        self.lengths = np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens))
        self._at = np.cumsum(self.lengths) - self.lengths

    def encode_text(self, text: bytes) -> list[int]:
        return [i for piece in self._pattern.findall(text.decode()) for i in merge_piece(piece.encode(), self.ranks, self._low)]

    def encode(self, column: pa.Array) -> Iterator[tuple[int, int, pa.ListArray]]:
        """First row, rows and ids of each chunk of a column of texts."""
        for chunk in chunks(column):
            values, counts = chunk_ids(chunk, True, self.lexicon, self.encode_text)
            offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            yield chunk.first, chunk.n, pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))

    def decode(self, ids: pa.ListArray) -> pa.Array:
        offsets = ids.offsets.to_numpy().astype(np.int64)
        values = ids.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]].astype(np.int64)
        sizes = self.lengths[values]
        data = self._bytes[ragged(self._at[values], sizes)]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        bounds = ends[offsets - offsets[0]]
        return pa.Array.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(bounds), pa.py_buffer(data.tobytes())])


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, pattern: str) -> Encoder:
    key = (path, pattern)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(path, pattern)
    return _ENCODERS[key]


def encode(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id_col and ids array<int>. Extra columns are not read."""
    bounded_batches(df)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(ranks_path, pattern)
        for batch in batches:
            for first, n, ids in enc.encode(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, n), ids], names=[id_col, "ids"])

    kind = df.schema[id_col].dataType
    schema = T.StructType([T.StructField(id_col, kind), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return df.select(id_col, text_col).mapInArrow(run, schema)


def decode(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per input row: id_col, ids and decoded binary."""
    bounded_batches(df)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(ranks_path, pattern)
        for batch in batches:
            for first in range(0, batch.num_rows, 512):
                part = batch.slice(first, 512)
                ids = part.column(1)
                if ids.null_count:
                    ids = pa.array([x or [] for x in ids.to_pylist()], type=pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), ids, enc.decode(ids).cast(pa.binary())], names=[id_col, ids_col, "decoded"])

    kind = df.schema[id_col].dataType
    schema = T.StructType([T.StructField(id_col, kind), T.StructField(ids_col, T.ArrayType(T.IntegerType())), T.StructField("decoded", T.BinaryType())])
    return df.select(id_col, ids_col).mapInArrow(run, schema)
