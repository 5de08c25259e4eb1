"""Quality rules: hashed n-gram log-likelihood ratio of two multinomials.

Word unigrams and bigrams are hashed into a fixed number of buckets. One
multinomial is counted over the trusted target (rows labelled good), the other
over every document of the raw corpus; both are smoothed. A document's score is
its log-likelihood ratio, target over raw, divided by its number of n-grams.
Every document is held against one threshold, so equal texts get equal verdicts.

The trusted rows are all labelled good ones; raw counts take in all documents.
Half of the trusted rows, by the hash of their id, count into the target. The
threshold is the ``quantile`` of the scores of all others, to the next ``STEP``
below, less a ``margin``: those are as new to the target as any document. Scores
are counted by step, so what the driver reads does not grow with the rows.

Words are runs of bytes other than space and \\t \\n \\v \\f \\r. Null texts have
no words. A text without words scores 0 and fails the base rule. Without labels,
only the base rule decides. Equal rows give a row each, an empty table an empty
one; a text is read whole, however long. Extra columns are not read, whatever
their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rosterloom.llm.textbuf import U64, Chunk, bounded_batches, chunks, mix, per_row, slice_hashes

#: The signs that count as symbols.
SYMBOLS = np.zeros(256, dtype=bool)
SYMBOLS[np.frombuffer(b"#*$%&|<>", dtype=np.uint8)] = True

#: Scores are counted in steps of this width for the threshold.
STEP = 1e-4


def _joined(h: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each n words in a row, and where they begin."""
    if len(h) < n:
        return h[:0], rows[:0]
    with np.errstate(over="ignore"):
        out = h[: len(h) - n + 1].copy()
        for k in range(1, n):
            out = mix(out * U64(0x9E3779B97F4A7C15) + h[k : len(h) - n + 1 + k])
    at = np.flatnonzero(rows[: len(h) - n + 1] == rows[n - 1 :])
    return out[at], at


def ngram_buckets(chunk: Chunk, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The bucket and row of every word and pair of words."""
    starts, ends, rows = chunk.words()
    h = slice_hashes(chunk.data, starts, ends)
    pairs, at = _joined(h, rows, 2)
    shift = U64(64 - bits)
    return np.concatenate([h >> shift, pairs >> shift]).astype(np.int64), np.concatenate([rows, rows[at]])


def base_columns(chunk: Chunk) -> dict[str, np.ndarray]:
    """Counts of the base rule by row."""
    data, n = chunk.data, chunk.n
    if not len(data):
        zero = np.zeros(n, dtype=np.int64)
        return {k: zero for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")}
    starts, ends, rows = chunk.words()
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    h = slice_hashes(data, starts, ends)
    out = {"n_words": per_row(rows, n), "word_chars": per_row(rows, n, points[ends] - points[starts])}
    out["n_symbols"] = per_row(chunk.row_of(np.flatnonzero(SYMBOLS[data])), n)
    lines, stops, line_rows = chunk.runs(data != 0x0A)
    if len(lines):
        first = np.searchsorted(starts, lines)
        worded = (first < len(starts)) & (starts[np.minimum(first, len(starts) - 1)] < stops) if len(starts) else np.zeros(len(lines), dtype=bool)
        lines, stops, line_rows = lines[worded], stops[worded], line_rows[worded]
    line_keys = mix(slice_hashes(data, lines, stops) + line_rows.astype(U64))
    _, firsts = np.unique(line_keys, return_index=True)
    out["n_dup_lines"] = per_row(line_rows, n) - per_row(line_rows[firsts], n)
    triples, at = _joined(h, rows, 3)
    repeat = np.zeros(len(h) + 1, dtype=np.int64)
    if len(triples):
        _, back, count = np.unique(mix(triples + rows[at].astype(U64)), return_inverse=True, return_counts=True)
        twice = at[count[back] > 1]
        np.add.at(repeat, twice, 1)
        np.add.at(repeat, twice + 3, -1)
    covered = np.cumsum(repeat[:-1]) > 0
    out["n_repeat_words"] = per_row(rows[covered], n)
    return {k: v.astype(np.int64) for k, v in out.items()}


def ngram_counts(df: DataFrame, bits: int, text_col: str = "text") -> DataFrame:
    """How often each bucket occurs in all texts: bucket, n. Each task counts
    into one array; the sums are then taken by bucket."""
    bounded_batches(df)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << bits, dtype=np.int64)
        for batch in batches:
            for chunk in chunks(batch.column(0)):
                total += np.bincount(ngram_buckets(chunk, bits)[0], minlength=1 << bits)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["bucket", "n"])

    counted = df.select(text_col).mapInArrow(run, "bucket long, n long")
    return counted.groupBy("bucket").agg(F.sum("n").alias("n"))


def _array(counts: DataFrame, bits: int) -> np.ndarray:
    """At most 2**bits rows come to the driver."""
    out = np.zeros(1 << bits, dtype=np.float64)
    rows = counts.toPandas()
    out[rows["bucket"].to_numpy(dtype=np.int64)] = rows["n"]
    return out


def trusted_rows(df: DataFrame, labels: DataFrame, good_col: str, id_col: str = "doc_id") -> DataFrame:
    """The rows of df whose id is labelled good; both sides are dealt by id,
    since the good ids grow with the input."""
    ids = labels.where(F.col(good_col) == 1).select(id_col).where(F.col(id_col).isNotNull())
    return df.join(ids.hint("merge"), id_col, "left_semi")


def step_quantile(scored: DataFrame, quantile: float) -> float | None:
    """The lower end of the step that holds the quantile of llr; None without rows."""
    counts = scored.groupBy(F.floor(F.col("llr") / STEP).alias("step")).agg(F.count("*").alias("n")).toPandas().sort_values("step")
    if not len(counts):
        return None
    upto = np.cumsum(counts["n"].to_numpy())
    return float(counts["step"].iloc[int(np.searchsorted(upto, max(quantile * upto[-1], 1)))] * STEP)


def weights(raw: np.ndarray, target: np.ndarray, smoothing: float = 1.0) -> np.ndarray:
    p = (target + smoothing) / (target.sum() + smoothing * len(target))
    q = (raw + smoothing) / (raw.sum() + smoothing * len(raw))
    return np.log(p) - np.log(q)


def scores(chunk: Chunk, table: np.ndarray, bits: int) -> np.ndarray:
    if not len(chunk.data):
        return np.zeros(chunk.n)
    buckets, rows = ngram_buckets(chunk, bits)
    return per_row(rows, chunk.n, table[buckets]) / np.maximum(per_row(rows, chunk.n), 1)


def score_quality(
    df: DataFrame,
    labels: DataFrame,
    good_col: str = "quality",
    bits: int = 16,
    quantile: float = 0.001,
    margin: float = 0.05,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per input row: id_col, n_words, word_chars, n_symbols,
    n_dup_lines, n_repeat_words, base_failed, llr, threshold, kept."""
    spark = df.sparkSession
    raw = _array(ngram_counts(df, bits, text_col), bits)
    trusted = trusted_rows(df, labels, good_col, id_col)
    held_out = F.pmod(F.xxhash64(id_col), F.lit(2)) == 1
    target = _array(ngram_counts(trusted.where(~held_out), bits, text_col), bits)
    table = weights(raw, target) if target.any() else np.zeros(1 << bits)
    shared = spark.sparkContext.broadcast(table)

    def own_scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column(0)):
                base = base_columns(chunk)
                fine = ~_fails(base)
                yield pa.RecordBatch.from_arrays([pa.array(scores(chunk, shared.value, bits)[fine])], names=["llr"])

    own = step_quantile(trusted.where(held_out).select(text_col).mapInArrow(own_scores, "llr double"), quantile)
    threshold = own - margin if own is not None else float("-inf")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column(1)):
                base = base_columns(chunk)
                llr, failed = scores(chunk, shared.value, bits), _fails(base)
                columns = [*base.values(), failed, llr, np.full(chunk.n, threshold), ~failed & (llr >= threshold)]
                names = [*base, "base_failed", "llr", "threshold", "kept"]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(chunk.first, chunk.n), *map(pa.array, columns)], names=[id_col, *names])

    counts = [T.StructField(k, T.LongType()) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    verdicts = [T.StructField("base_failed", T.BooleanType()), T.StructField("llr", T.DoubleType()), T.StructField("threshold", T.DoubleType()), T.StructField("kept", T.BooleanType())]
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), *counts, *verdicts])
    return df.select(id_col, text_col).mapInArrow(run, schema)


def _fails(base: dict[str, np.ndarray]) -> np.ndarray:
    return (base["n_words"] < 50) | (100 * base["n_repeat_words"] > 50 * base["n_words"])
