"""Toxicity: cumulative-link ordinal regression on sparse words.

P(grade > k) = sigmoid(w . x - cut_k): one weight vector shared by ordered
cuts. x marks which words occur (lower-cased letter runs, told apart by 64-bit
hash). The output is the expected grade, the sum of P(grade > k); documents at
or above ``limit`` are rejected.

Training takes a bounded sample of labelled rows (``train_rows``, those with the
smallest hash of their id). The labels only say toxic or not, so the grades of
toxic rows follow from evidence: words that the sample holds almost only in
toxic rows. Grade 1 has at most one such word, grade 2 two or three, grade 3
more. Copies of one text would otherwise pass for independent evidence, so rows
sharing the least hash of their rare words share one unit of weight. Weights are
kept sparse by an L1 penalty.

Null and empty texts have no words and get the grade of no evidence; a text is
read whole, however long. Without labels, or without toxic ones, every document
is kept at severity 0. An empty table gives an empty one. Equal rows get equal
results; extra columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rosterloom.llm.textbuf import LOWER, U64, Chunk, bounded_batches, chunks, slice_hashes, trimmed

GRADES = 4
#: Least number of evidence words of grades 2 and 3.
STEPS = (2, 4)
_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = True
_LETTER[0x80:] = True


def word_hashes(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of each letter run."""
    data = LOWER[chunk.data]
    lead = np.flatnonzero(data[:-1] == 0xC3) + 1
    capital = lead[(data[lead] >= 0x80) & (data[lead] <= 0x9E) & (data[lead] != 0x97)]
    data[capital] += 0x20
    starts, ends, rows = chunk.runs(_LETTER[data])
    return slice_hashes(data, starts, ends), rows


def _distinct(h: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((h, rows))
    h, rows = h[order], rows[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (rows[1:] != rows[:-1])
    return h[new], rows[new]


@dataclass(frozen=True)
class Model:
    """Sorted word hashes with their weights, and the ordered cuts."""

    words: np.ndarray
    weights: np.ndarray
    cuts: np.ndarray

    def severity(self, chunk: Chunk) -> np.ndarray:
        """P(grade > k) for each row and k."""
        z = np.zeros(chunk.n)
        if len(self.words) and len(chunk.data):
            h, rows = word_hashes(chunk)
            sieve = np.zeros(1 << 16, dtype=bool)
            sieve[(self.words >> U64(48)).astype(np.int64)] = True
            near = np.flatnonzero(sieve[(h >> U64(48)).astype(np.int64)])
            h, rows = _distinct(h[near], rows[near])
            at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
            hit = self.words[at] == h
            z = np.bincount(rows[hit], weights=self.weights[at[hit]], minlength=chunk.n)
        return 1 / (1 + np.exp(-(z[:, None] - self.cuts[None, :])))


#: Rejects nothing.
NOTHING = Model(np.empty(0, dtype=U64), np.empty(0), np.full(GRADES - 1, 700.0))


def copy_groups(rows: np.ndarray, words: np.ndarray, col: np.ndarray, n: int, rare: float = 0.05) -> np.ndarray:
    """A number for each row, equal for most copies of one text: the least hash
    of its words that few rows have; rows without such words are on their own."""
    count = np.bincount(col)
    few = (count[col] <= rare * n) & (count[col] > 1)
    least = np.full(n, np.iinfo(np.uint64).max, dtype=U64)
    np.minimum.at(least, rows[few], words[few])
    _, group = np.unique(least, return_inverse=True)
    alone = least == np.iinfo(np.uint64).max
    group[alone] = n + np.arange(int(alone.sum()))
    return np.unique(group, return_inverse=True)[1]


def fit(rows: np.ndarray, words: np.ndarray, toxic: np.ndarray, penalty: float = 2e-4, steps: int = 400, rate: float = 0.2) -> Model:
    """rows, words: which row holds which word; toxic: 0 or 1 by row. Proximal
    gradient descent with momentum."""
    known, col = np.unique(words, return_inverse=True)
    group = copy_groups(rows, words, col, len(toxic))
    weight = 1.0 / np.bincount(group)[group]
    support = np.bincount(col, weights=weight[rows])
    in_toxic = np.bincount(col, weights=(weight * toxic)[rows])
    share = float((weight * toxic).sum() / weight.sum())
    if share == 0.0:
        return NOTHING
    spread = np.sqrt(np.maximum(support * share * (1 - share), 1e-9))
    useful = (support >= 3) & (np.abs(in_toxic - support * share) > 4 * spread)
    if not useful.any():
        return NOTHING
    evidence = useful & (in_toxic >= 0.8 * support) & (in_toxic > 2.5)
    found = np.bincount(rows, weights=evidence[col], minlength=len(toxic))
    grade = np.where(toxic == 1, 1 + sum((found >= s).astype(int) for s in STEPS), 0)
    known, place = known[useful], np.cumsum(useful) - 1
    keep = useful[col]
    rows, col = rows[keep], place[col[keep]]
    w, v = np.zeros(len(known)), np.zeros(len(known))
    total = weight.sum()
    above = np.stack([(weight * (grade > k)).sum() for k in range(GRADES - 1)]) / total
    cuts = -np.log(np.maximum(above, 1e-4) / (1 - np.minimum(above, 1 - 1e-4)))
    target = np.stack([grade > k for k in range(GRADES - 1)], axis=1).astype(float)
    scale = np.sqrt(np.maximum(np.bincount(col, weights=weight[rows], minlength=len(known)) / total, 1e-6))
    gap = np.zeros(GRADES - 1)
    for _ in range(steps):
        z = np.bincount(rows, weights=w[col], minlength=len(toxic))
        miss = (1 / (1 + np.exp(-(z[:, None] - cuts[None, :]))) - target) * (weight / total)[:, None]
        grad = np.bincount(col, weights=miss.sum(axis=1)[rows], minlength=len(known)) / scale
        v = 0.9 * v - rate * grad
        w = w + v / scale
        w = np.sign(w) * np.maximum(np.abs(w) - rate * penalty / scale**2, 0)
        gap = 0.9 * gap + 4 * rate * miss.sum(axis=0)
        cuts = np.maximum.accumulate(cuts + gap)
    used = w != 0
    return Model(known[used], w[used], cuts)


def train(df: DataFrame, labels: DataFrame, train_rows: int = 8_000, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Only the sampled rows' ids are broadcast, and only their words come to the driver."""
    bounded_batches(df)
    wanted = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).cast("int").alias("_toxic"))
    wanted = wanted.orderBy(F.xxhash64(id_col), id_col).limit(train_rows)
    sample = df.select(id_col, text_col).join(F.broadcast(wanted), id_col).select(text_col, "_toxic")

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column(0)):
                if not len(chunk.data):
                    continue
                h, rows = _distinct(*word_hashes(chunk))
                bounds = (np.searchsorted(rows, np.arange(chunk.n + 1)) * 8).astype(np.int32)
                packed = pa.Array.from_buffers(pa.binary(), chunk.n, [None, pa.py_buffer(bounds), pa.py_buffer(h.tobytes())])
                yield pa.RecordBatch.from_arrays([packed, batch.column(1).slice(chunk.first, chunk.n)], names=["words", "toxic"])

    got = sample.mapInArrow(run, "words binary, toxic int").toPandas()
    sets = [np.frombuffer(x, dtype=U64) for x in got["words"]]
    keep = [i for i, x in enumerate(sets) if len(x)]
    if not keep:
        return NOTHING
    sets, toxic = [sets[i] for i in keep], got["toxic"].to_numpy()[keep]
    rows = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    words = np.concatenate(sets)
    del got, sets
    return fit(rows, words, toxic)


def grade_toxicity(df: DataFrame, model: Model, limit: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id_col, expected_severity, grade (the median one), kept."""
    bounded_batches(df)
    shared = df.sparkSession.sparkContext.broadcast(model)

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column(1)):
                above = shared.value.severity(chunk)
                expected = above.sum(axis=1)
                grade = (above >= 0.5).sum(axis=1).astype(np.int32)
                columns = [batch.column(0).slice(chunk.first, chunk.n), pa.array(expected), pa.array(grade), pa.array(expected < limit)]
                yield pa.RecordBatch.from_arrays(columns, names=[id_col, "expected_severity", "grade", "kept"])

    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField("expected_severity", T.DoubleType()), T.StructField("grade", T.IntegerType()), T.StructField("kept", T.BooleanType())])
    return df.select(id_col, text_col).mapInArrow(run, schema)


def keep_clean(df: DataFrame, model: Model, limit: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of df below the limit, with all their columns as they are."""
    bounded_batches(df)
    shared = df.sparkSession.sparkContext.broadcast(model)
    place = df.columns.index(text_col)

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column(place)):
                kept = shared.value.severity(chunk).sum(axis=1) < limit
                yield batch.slice(chunk.first, chunk.n).filter(pa.array(kept))

    return df.mapInArrow(run, df.schema)
