"""Vectorised work on the UTF-8 bytes of a batch of texts.

A batch of texts becomes one byte buffer with offsets, cut into chunks of a
few MB so that the 8-byte columns derived from it stay small; a single longer
text is a chunk of its own and is always processed whole. Words and lines are
found with boundary masks. Slices are hashed in blocks of eight bytes by two
mixers that run side by side, and long slices by BLAKE2, so no family of texts
with a regular build collides.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

U64 = np.uint64
CHUNK_BYTES = 1 << 20
#: Slices of more bytes are hashed by BLAKE2, one by one.
LONG_SLICE = 128
#: Keeps the first k of eight bytes.
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=U64)

#: The white space of the contracts: space and \t \n \v \f \r.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


#: Bytes of a batch that Spark hands to Python; texts may be long.
BATCH_BYTES = 8 << 20


def bounded_batches(df: DataFrame) -> None:
    """Lowers the session's limit on an Arrow batch's bytes, unless it is lower already."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    now = conf.get(key).rstrip("b")
    if not now.isdigit() or int(now) > BATCH_BYTES:
        conf.set(key, str(BATCH_BYTES))


def give_back() -> None:
    """Returns the process's freed memory to the system, which allocators else keep."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def trimmed(step: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A step over Arrow batches that ends with give_back: Python workers outlive
    their tasks, and what they keep adds to the memory of the stages after."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from step(batches)
        finally:
            give_back()

    return run


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: every output bit depends on every input bit."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
        return h ^ (h >> U64(31))


def blocks_of(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on, as a little-endian number; zeros follow the end."""
    padded = np.zeros(len(data) + 8, dtype=np.uint8)
    padded[: len(data)] = data
    return np.ndarray(len(data) + 1, dtype="<u8", buffer=padded, strides=(1,))


def block_at(blocks: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The first eight bytes of slices, zeros where a slice is shorter."""
    inside = np.minimum(starts, len(blocks) - 1)
    return blocks[inside] & _MASKS[np.clip(sizes, 0, 8)]


def slice_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[starts[i]:ends[i]], equal for equal slices."""
    sizes = ends - starts
    out = np.empty(len(starts), dtype=U64)
    long = np.flatnonzero(sizes > LONG_SLICE)
    if len(long):
        raw = memoryview(np.ascontiguousarray(data))
        found = [blake2b(raw[a:b], digest_size=8).digest() for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True)]
        out[long] = np.frombuffer(b"".join(found), dtype="<u8")
    live = np.flatnonzero(sizes <= LONG_SLICE)
    blocks = blocks_of(data)
    with np.errstate(over="ignore"):
        at, left = starts[live], sizes[live]
        one = mix(block_at(blocks, at, left) ^ (left.astype(U64) * U64(0xD1B54A32D192ED03)))
        two = left.astype(U64) * U64(0xA0761D6478BD642F)
        while True:
            # whatever a block does to the first mixer, it does something unrelated to the second
            more = left > 8
            out[live[~more]] = mix(one[~more] + two[~more] * U64(0xE7037ED1A0B428DB))
            if not more.any():
                return out
            before = one[more]
            live, at, left, two = live[more], at[more] + 8, left[more] - 8, two[more]
            block = block_at(blocks, at, left)
            one = mix(before ^ block)
            two = mix((two + block) * U64(0x8EBC6AF09C88C6E3) + (before >> U64(32)))


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenated ranges [starts[i], starts[i] + lengths[i])."""
    total = int(lengths.sum())
    shift = starts - (np.cumsum(lengths) - lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(shift, lengths)


class Chunk:
    """Rows first..first+n of a batch: their bytes and offsets (starting at 0)."""

    __slots__ = ("data", "first", "n", "offsets")

    def __init__(self, first: int, data: np.ndarray, offsets: np.ndarray) -> None:
        self.first, self.data, self.offsets, self.n = first, data, offsets, len(offsets) - 1

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()

    def row_of(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.offsets, positions, side="right") - 1

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and row of each run of bytes that are not white space."""
        return self.runs(~SPACE[self.data])

    def runs(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and row of each maximal run of marked bytes within a row."""
        n = len(self.data)
        if n == 0:
            empty = np.empty(0, dtype=np.int64)
            return empty, empty, empty
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        stops = inside.copy()
        stops[:-1] &= ~inside[1:]
        edges = self.offsets[1:-1]
        edges = edges[(edges > 0) & (edges < n)]
        begins[edges] = inside[edges]
        stops[edges - 1] = inside[edges - 1]
        starts = np.flatnonzero(begins)
        return starts, np.flatnonzero(stops) + 1, self.row_of(starts)


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """The rows of a string column in order; a null text counts as an empty one."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    if len(column) == 0:
        return
    _, offsets_buffer, data_buffer = column.buffers()
    offsets = np.frombuffer(offsets_buffer, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data_buffer, dtype=np.uint8) if data_buffer is not None and data_buffer.size else np.empty(0, np.uint8)
    first, rows = 0, len(column)
    while first < rows:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), rows)
        part = offsets[first : last + 1]
        yield Chunk(first, data[part[0] : part[-1]], part - part[0])
        first = last


def per_row(rows: np.ndarray, n: int, weights: np.ndarray | None = None) -> np.ndarray:
    """Counts (or sums) by row."""
    return np.bincount(rows, weights=weights, minlength=n)
