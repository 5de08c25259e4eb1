"""Token counts by section: offset-mapped attribution.

A document is encoded once, whole. The tokens' byte spans are then joined to the
spans of its sections, both sorted, and counted by section. The rule for tokens
that cross a boundary: a token belongs to the section that holds most of its
bytes, the earlier one on ties; a token with no byte in any section is counted
apart, as section -1. So the counts of a document always add up to its tokens.

Sections are the lines of a text, or given as spans. Null and empty texts have
no tokens and no lines, only the row of section -1; a text is encoded whole,
however long. Equal rows are counted each, an empty table gives an empty one.
Extra columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from rosterloom.llm.bpe import encoder
from rosterloom.llm.pretoken import chunk_ids
from rosterloom.llm.textbuf import Chunk, bounded_batches, chunks

_LONGS = ("start", "end", "n_tokens", "n_crossing", "doc_tokens")


def allot(a: np.ndarray, b: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For tokens [a, b) and sorted disjoint sections [starts, ends): each token's
    section, -1 for none, and whether it has bytes outside that section."""
    best = np.full(len(a), -1, dtype=np.int64)
    most = np.zeros(len(a), dtype=np.int64)
    if len(starts):
        first = np.searchsorted(ends, a, side="right")
        step = 0
        while True:
            at = first + step
            touches = np.flatnonzero((at < len(starts)) & (starts[np.minimum(at, len(starts) - 1)] < b))
            if not len(touches):
                break
            k = at[touches]
            shared = np.minimum(b[touches], ends[k]) - np.maximum(a[touches], starts[k])
            more = shared > most[touches]
            best[touches[more]], most[touches[more]] = k[more], shared[more]
            step += 1
    return best, (best >= 0) & (most < b - a)


def _given(chunk: Chunk, spans: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte spans of sections given in code points, clipped to their text; sections
    that begin before the last one's end lose that part."""
    points = np.flatnonzero((chunk.data & 0xC0) != 0x80)
    starts, ends, rows = [], [], []
    for row, sections in enumerate(spans.to_pylist()):
        low, high = np.searchsorted(points, chunk.offsets[row]), np.searchsorted(points, chunk.offsets[row + 1])
        place = np.append(points[low:high], chunk.offsets[row + 1])
        done = 0
        for s in sections or []:
            x, y = max(s["start"], done), min(s["end"], high - low)
            starts.append(place[min(x, high - low)])
            ends.append(place[max(min(x, high - low), y)])
            rows.append(row)
            done = max(done, y)
    return np.array(starts, dtype=np.int64), np.array(ends, dtype=np.int64), np.array(rows, dtype=np.int64)


def count_tokens(df: DataFrame, ranks_path: str, pattern: str, sections_col: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per section, and one of section -1 per input row: id_col,
    section_no, start, end (code points), n_tokens, n_crossing, doc_tokens.

    sections_col: array<struct<start, end>> in order, in code points; by default
    the lines of the text, those without a sign left out.
    """
    bounded_batches(df)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(ranks_path, pattern)
        for batch in batches:
            for chunk in chunks(batch.column(1)):
                values, counts = chunk_ids(chunk, True, enc.lexicon, enc.encode_text)
                b = np.cumsum(enc.lengths[values])
                a = b - enc.lengths[values]
                if sections_col is None:
                    starts, ends, rows = chunk.runs(chunk.data != 0x0A)
                else:
                    starts, ends, rows = _given(chunk, batch.column(2).slice(chunk.first, chunk.n))
                solid = np.flatnonzero(ends > starts)  # an empty section holds nothing
                best, crossing = allot(a, b, starts[solid], ends[solid])
                token_row = np.repeat(np.arange(chunk.n), counts)
                section = np.where(best >= 0, solid[best] if len(solid) else -1, len(starts) + token_row)
                n = np.bincount(section, minlength=len(starts) + chunk.n)
                n_crossing = np.bincount(section[crossing], minlength=len(starts) + chunk.n)
                points = np.concatenate([[0], np.cumsum((chunk.data & 0xC0) != 0x80)])
                first = np.searchsorted(rows, np.arange(chunk.n))
                number = np.concatenate([np.arange(len(rows)) - first[rows], np.full(chunk.n, -1)])
                row = np.concatenate([rows, np.arange(chunk.n)])
                base = points[chunk.offsets[rows]]
                none = np.zeros(chunk.n, dtype=np.int64)
                columns = [np.concatenate([points[starts] - base, none]), np.concatenate([points[ends] - base, none]), n, n_crossing, counts[row]]
                key = batch.column(0).slice(chunk.first, chunk.n).take(pa.array(row))
                yield pa.RecordBatch.from_arrays([key, pa.array(number.astype(np.int32)), *(pa.array(c.astype(np.int64)) for c in columns)], names=[id_col, "section_no", *_LONGS])

    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField("section_no", T.IntegerType()), *(T.StructField(n, T.LongType()) for n in _LONGS)])
    return df.select(id_col, text_col, *([sections_col] if sections_col else [])).mapInArrow(run, schema)
