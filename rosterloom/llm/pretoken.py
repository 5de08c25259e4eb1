"""Vectorised pre-tokenisation and a bounded word-to-ids table.

Rows whose bytes are ASCII or Latin letters of the C3 page are "simple": their
character classes follow from single bytes, so pre-tokens are found with array
operations. Every other row is handed to the caller, which treats it with the
full Unicode pattern. Both ways give the same pre-tokens.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from rosterloom.llm.textbuf import LOWER, U64, Chunk, block_at, blocks_of, mix, ragged

_LETTER, _DIGIT, _OTHER = 1, 2, 3
_CLASS = np.full(256, _OTHER, dtype=np.uint8)
_CLASS[[0x20, 0x09, 0x0A, 0x0D]] = 0
_CLASS[48:58] = _DIGIT
_CLASS[65:91] = _CLASS[97:123] = _LETTER
_CLASS[0x80:] = _LETTER
_ODD = np.zeros(256, dtype=bool)  # bytes that never occur in a simple row
_ODD[:0x20] = True
_ODD[[0x09, 0x0A, 0x0D]] = False
_ODD[0x7F] = True
_ODD[0xC0:] = True
_ODD[0xC3] = False
#: The second letters of 's 't 'm 'd, and the pairs of 're 've 'll.
_ONE = np.frombuffer(b"stmd", dtype=np.uint8)
_TWO = (b"re", b"ve", b"ll")


def simple_rows(chunk: Chunk) -> np.ndarray:
    data = chunk.data
    odd = _ODD[data]
    high = data >= 0x80
    if high.any():
        after = np.zeros(len(data), dtype=bool)
        after[1:] = data[:-1] == 0xC3
        odd |= high & (data < 0xC0) & (~after | (data == 0x97) | (data == 0xB7))
    simple = np.ones(chunk.n, dtype=bool)
    simple[chunk.row_of(np.flatnonzero(odd))] = False
    return simple


def lowered(data: np.ndarray) -> np.ndarray:
    """Lower case of simple text."""
    out = LOWER[data]
    lead = np.flatnonzero(data[:-1] == 0xC3) + 1
    if len(lead):
        upper = lead[data[lead] <= 0x9E]
        out[upper] += 0x20
    return out


def _contractions(data: np.ndarray, starts: np.ndarray, lone: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the runs numbered lone, each a single quote with a letter run after
    it, those that begin a contraction, and how many letters these take."""
    if not len(lone):
        return lone, lone
    at = starts[lone] + 1
    first = data[at]
    second = data[np.minimum(at + 1, len(data) - 1)]
    take = np.where(np.isin(first, _ONE), 1, 0)
    for a, b in _TWO:
        take[(first == a) & (second == b) & (at + 1 < len(data))] = 2
    return lone[take > 0], take[take > 0]


def _lone_quotes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, kinds: np.ndarray, rows: np.ndarray) -> np.ndarray:
    if len(starts) < 2:
        return np.empty(0, dtype=np.int64)
    quote = (data[starts[:-1]] == 0x27) & (ends[:-1] - starts[:-1] == 1)
    return np.flatnonzero(quote & (starts[1:] == ends[:-1]) & (kinds[1:] == _LETTER) & (rows[1:] == rows[:-1]))


def _class_runs(chunk: Chunk, single_digits: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    kind = _CLASS[chunk.data]
    begin = np.ones(len(kind), dtype=bool)
    begin[1:] = kind[1:] != kind[:-1]
    if single_digits:
        begin |= kind == _DIGIT
    edges = chunk.offsets[1:-1]
    begin[edges[edges < len(kind)]] = True
    starts = np.flatnonzero(begin)
    ends = np.append(starts[1:], len(kind))
    return starts, ends, kind[starts], chunk.row_of(starts)


def words_apart(chunk: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pre-tokens of lower-cased simple text: contractions, letter runs, single
    digits, runs of other signs; white space is dropped. Start, end, row."""
    starts, ends, kinds, rows = _class_runs(chunk, single_digits=True)
    solid = kinds != 0
    starts, ends, kinds, rows = starts[solid], ends[solid], kinds[solid], rows[solid]
    which, take = _contractions(chunk.data, starts, _lone_quotes(chunk.data, starts, ends, kinds, rows))
    if len(which):
        ends[which] += take
        starts[which + 1] += take
        keep = starts < ends
        starts, ends, rows = starts[keep], ends[keep], rows[keep]
    return starts, ends, rows


def words_spaced(chunk: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pre-tokens of simple text that together cover it: a word takes one blank
    before it, and white space before a word leaves its last sign apart."""
    data = chunk.data
    if not len(data):
        empty = np.empty(0, dtype=np.int64)
        return empty, empty, empty
    starts, ends, kinds, rows = _class_runs(chunk, single_digits=False)
    begin = np.zeros(len(data) + 1, dtype=bool)
    blank = kinds == 0
    row_end = chunk.offsets[rows + 1]
    begin[starts[blank]] = True
    begin[ends[blank & (ends < row_end)] - 1] = True  # the last sign before a word
    solid = np.flatnonzero(~blank)
    before = np.maximum(starts[solid] - 1, 0)
    joined = (data[before] == 0x20) & (starts[solid] > chunk.offsets[rows[solid]])
    begin[starts[solid[~joined]]] = True
    lone = _lone_quotes(data, starts, ends, kinds, rows)
    attached = np.zeros(len(starts), dtype=bool)
    attached[solid[joined]] = True
    which, take = _contractions(data, starts, lone[~attached[lone]])
    if len(which):
        begin[starts[which + 1]] = False
        begin[starts[which + 1] + take] = True  # where the run ends, something begins anyway
    begin[chunk.offsets[:-1]] = True
    first = np.flatnonzero(begin[: len(data)])
    return first, np.append(first[1:], len(data)), chunk.row_of(first)


class Lexicon:
    """Ids of pre-tokens seen before, in a direct-mapped table of bounded size.

    A slot holds a pre-token and where its ids lie in a pool; a miss is encoded
    anew and takes the slot. A hash only chooses the slot: the pre-token itself
    is compared, its first 16 bytes as two numbers and the rest byte by byte.
    Pre-tokens of more than ``LONGEST`` bytes are not stored.
    """

    LONGEST = 256

    def __init__(self, encode: Callable[[list[bytes]], list[list[int]]], slots: int = 1 << 21, pool: int = 1 << 23) -> None:
        self._encode, self._mask, self._limit = encode, U64(slots - 1), pool
        self._reset(slots)

    def _reset(self, slots: int) -> None:
        self._one, self._two = np.zeros(slots, dtype=U64), np.zeros(slots, dtype=U64)
        self._size, self._from, self._at, self._len = (np.zeros(slots, dtype=np.int32) for _ in range(4))
        self._ids, self._bytes = np.zeros(1 << 16, dtype=np.int32), np.zeros(1 << 16, dtype=np.uint8)
        self._used = self._held = 0

    @staticmethod
    def _grown(pool: np.ndarray, used: int, more: int) -> np.ndarray:
        return pool if used + more <= len(pool) else np.concatenate([pool[:used], np.zeros(max(more, len(pool)), dtype=pool.dtype)])

    def ids(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all slices, one after another, and how many each has."""
        if self._used > self._limit or self._held > 4 * self._limit:
            self._reset(len(self._one))
        sizes = ends - starts
        blocks = blocks_of(data)
        one, two = block_at(blocks, starts, sizes), block_at(blocks, starts + 8, sizes - 8)
        with np.errstate(over="ignore"):
            slot = (mix(mix(one) + two * U64(0x9E3779B97F4A7C15) + sizes.astype(U64)) & self._mask).astype(np.int64)
        same = (self._one[slot] == one) & (self._two[slot] == two) & (self._size[slot] == sizes)
        longer = np.flatnonzero(same & (sizes > 16))
        if len(longer):
            rest = sizes[longer] - 16
            equal = data[ragged(starts[longer] + 16, rest)] == self._bytes[ragged(self._from[slot[longer]].astype(np.int64), rest)]
            same[longer] = np.logical_and.reduceat(equal, np.cumsum(rest) - rest)
        at, count = self._at[slot].astype(np.int64), self._len[slot].astype(np.int64)
        missed = np.flatnonzero(~same)
        if len(missed):
            raw = data.tobytes()
            numbers: dict[bytes, int] = {}
            back = np.array([numbers.setdefault(raw[a:b], len(numbers)) for a, b in zip(starts[missed].tolist(), ends[missed].tolist(), strict=True)])
            new = missed[np.unique(back, return_index=True)[1]]
            found = self._encode(list(numbers))
            lengths = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
            flat = np.fromiter((i for ids in found for i in ids), dtype=np.int32, count=int(lengths.sum()))
            self._ids = self._grown(self._ids, self._used, len(flat))
            self._ids[self._used : self._used + len(flat)] = flat
            places = self._used + np.cumsum(lengths) - lengths
            self._used += len(flat)
            at[missed], count[missed] = places[back], lengths[back]
            # of several for one slot the first takes it
            short = np.flatnonzero(sizes[new] <= self.LONGEST)
            short = short[np.unique(slot[new[short]], return_index=True)[1]]
            kept = new[short]
            tails = np.maximum(sizes[kept] - 16, 0)
            self._bytes = self._grown(self._bytes, self._held, int(tails.sum()))
            self._bytes[self._held : self._held + int(tails.sum())] = data[ragged(starts[kept] + 16, tails)]
            where = slot[kept]
            self._one[where], self._two[where], self._size[where] = one[kept], two[kept], sizes[kept]
            self._from[where] = self._held + np.cumsum(tails) - tails
            self._at[where], self._len[where] = places[short], lengths[short]
            self._held += int(tails.sum())
        return self._ids[ragged(at, count)], count


def chunk_ids(chunk: Chunk, spaced: bool, lexicon: Lexicon, whole: Callable[[bytes], list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """The ids of a chunk's texts one after another, and how many each has.
    whole encodes the texts that are not simple."""
    counts = np.zeros(chunk.n, dtype=np.int64)
    if not len(chunk.data):
        return np.empty(0, dtype=np.int32), counts
    simple = simple_rows(chunk)
    if simple.any():
        if spaced:
            data = chunk.data
            starts, ends, rows = words_spaced(chunk)
        else:
            data = lowered(chunk.data)
            starts, ends, rows = words_apart(Chunk(chunk.first, data, chunk.offsets))
        if not simple.all():
            keep = simple[rows]
            starts, ends, rows = starts[keep], ends[keep], rows[keep]
        values, sizes = lexicon.ids(data, starts, ends)
        counts = np.bincount(rows, weights=sizes, minlength=chunk.n).astype(np.int64)
    else:
        values = np.empty(0, dtype=np.int32)
    if simple.all():
        return values, counts
    bounds = np.concatenate([[0], np.cumsum(counts)])
    parts, done = [], 0
    for row in np.flatnonzero(~simple):
        parts.append(values[done : bounds[row]])
        done = int(bounds[row])
        ids = np.asarray(whole(chunk.text(row)), dtype=np.int32)
        counts[row] = len(ids)
        parts.append(ids)
    parts.append(values[done:])
    return np.concatenate(parts), counts
