"""Substring dedup by line hashing.

The unit is a line, cut further where a sentence ends, so that a passage set
into the middle of a line is found as well. A unit is normalised to its
lower-cased words (letters and digits) and digested to 128 bits. Digests are
grouped over all documents: the occurrence with the least (id, start) stays, the
others are repeats. A line that repeats as a whole is removed whatever its
length. Sentences within a line are removed in passages: neighbouring repeats of
a document, of at least ``min_words`` words together, since short sentences of
prose meet by chance; 1 removes every one.
Sentences of fewer than ``unit_words`` words are not compared; they go with a
passage or line that encloses them. Offsets are those in the original text.

Texts are cut into units once; the units are a table on shared disk. Digests are
counted with early sums, and those that occur more than once are a table as well,
so Spark knows its size: it is broadcast while it is small, and otherwise both
sides of the join are plain exchanges, of which Spark splits those that one
digest (a line in a third of all documents) makes large.

Null and empty texts have no units; an empty table gives an empty one. Rows with
one id count as one document, so an equal row repeats nothing; rows without an id
are told apart by their text and come last. A text is cut whole, however long.
Extra columns are not read, whatever their names; drop_repeats passes them
through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rosterloom.llm.scratch import Scratch
from rosterloom.llm.spans import replaced
from rosterloom.llm.textbuf import LOWER, SPACE, U64, Chunk, bounded_batches, chunks, mix, slice_hashes, trimmed

_WORD = np.zeros(256, dtype=bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = True
_WORD[0x80:] = True
_STOP = np.zeros(256, dtype=bool)
_STOP[np.frombuffer(b".!?", dtype=np.uint8)] = True
_SEEDS = (U64(0x9FB21C651E98DF25), U64(0xD6E8FEB86659FD93))


def unit_table(chunk: Chunk, unit_words: int) -> dict[str, np.ndarray]:
    """The compared units of a chunk: row, seq (their number in the row), start,
    end (code points), words, whole (1 for a whole line), and two digest halves.
    Lines of several units, and those too short for a unit, come after the units
    and have seq -1."""
    data = LOWER[chunk.data]
    starts, ends, rows = chunk.runs(_WORD[data])
    if not len(starts):
        return {k: np.empty(0, dtype=np.int64) for k in ("row", "seq", "start", "end", "words", "whole", "d1", "d2")}
    stop = _STOP[data]
    line_ends = data == 0x0A
    line_ends[chunk.offsets[1:][chunk.offsets[1:] > 0] - 1] = True
    breaks = line_ends.copy()
    breaks[:-1] |= stop[:-1] & SPACE[data[1:]]
    cuts = np.flatnonzero(breaks)
    unit = np.searchsorted(cuts, starts)
    first = np.flatnonzero(np.concatenate([[True], unit[1:] != unit[:-1]]))
    count = np.diff(np.append(first, len(unit)))
    h = slice_hashes(data, starts, ends)
    place = (np.arange(len(h)) - np.repeat(first, count)).astype(U64)
    digests = []
    with np.errstate(over="ignore"):
        for seed in _SEEDS:
            running = np.concatenate([[U64(0)], np.cumsum(mix((h ^ seed) + place * U64(0xA0761D6478BD642F)))])
            digests.append(mix(running[first + count] - running[first] + count.astype(U64) * seed).view(np.int64))
    # a line of several units is digested from theirs, so its units repeat where it does
    line = np.searchsorted(np.flatnonzero(line_ends), starts[first])
    head = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]]))
    size = np.diff(np.append(head, len(line)))
    many = size > 1
    place = (np.arange(len(line)) - np.repeat(head, size)).astype(U64)
    line_digests = []
    with np.errstate(over="ignore"):
        for d, seed in zip(digests, _SEEDS, strict=True):
            running = np.concatenate([[U64(0)], np.cumsum(mix((d.view(U64) ^ seed) + place * U64(0xE7037ED1A0B428DB)))])
            whole = mix(running[head + size] - running[head] + size.astype(U64) * seed).view(np.int64)
            line_digests.append(np.where(many, whole, d[head]))
    keep = count >= unit_words
    lines = many | ~keep[head]
    at = np.concatenate([np.flatnonzero(keep), head[lines]])
    to = np.concatenate([np.flatnonzero(keep), (head + size - 1)[lines]])
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    row = rows[first[at]]
    base = points[chunk.offsets[row]]
    last = cuts[unit[first[to]]]
    last = np.where(stop[last], last + 1, ends[first[to] + count[to] - 1])
    seq = np.full(len(at), -1, dtype=np.int64)
    n = int(keep.sum())
    new_row = np.flatnonzero(np.concatenate([[True], row[1:n] != row[: n - 1]])) if n else np.empty(0, dtype=np.int64)
    seq[:n] = np.arange(n) - np.repeat(new_row, np.diff(np.append(new_row, n)))
    whole = np.ones(len(at), dtype=np.int64)
    whole[:n] = np.repeat(size == 1, size)[keep]
    d1, d2 = (np.concatenate([d[keep], e[lines]]) for d, e in zip(digests, line_digests, strict=True))
    return {"row": row, "seq": seq, "start": points[starts[first[at]]] - base, "end": points[last] - base, "words": first[to] + count[to] - first[at], "whole": whole, "d1": d1, "d2": d2}


def _same_text(id_col: str, text_col: str) -> Column:
    """What tells rows without an id apart; 0 for the others."""
    return F.when(F.col(id_col).isNull(), F.xxhash64(text_col)).otherwise(F.lit(0).cast("long"))


def units(df: DataFrame, unit_words: int, id_col: str, text_col: str) -> DataFrame:
    """One row per compared unit: id, own (see _same_text), seq, start, end, words, whole, d1, d2."""
    bounded_batches(df)
    names = ("seq", "start", "end", "words", "whole", "d1", "d2")

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column(2)):
                found = unit_table(chunk, unit_words)
                keys = [batch.column(i).slice(chunk.first, chunk.n).take(pa.array(found["row"])) for i in (0, 1)]
                columns = [pa.array(found[n].astype(np.int32 if n in names[:5] else np.int64)) for n in names]
                yield pa.RecordBatch.from_arrays([*keys, *columns], names=["id", "own", *names])

    fields = [T.StructField("id", df.schema[id_col].dataType), T.StructField("own", T.LongType())]
    schema = T.StructType([*fields, *(T.StructField(n, T.IntegerType() if n in names[:5] else T.LongType()) for n in names)])
    return df.select(F.col(id_col).alias("id"), _same_text(id_col, text_col).alias("own"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def _passages(df: DataFrame, scratch: Scratch, min_words: int, unit_words: int, id_col: str, text_col: str) -> DataFrame:
    """One row per passage or line to remove: id, own, start, end, n_words, n_units, first."""
    every = scratch.keep(units(df, unit_words, id_col, text_col))
    # a document with an id comes before one without
    place = F.struct(F.col("id").isNull().alias("none"), "id", "own", "start")
    digests = every.groupBy("d1", "d2").agg(F.min(place).alias("first"), F.count("*").alias("n"))
    again = scratch.keep(digests.where(F.col("n") > 1).select("d1", "d2", "first"))
    repeated = every.join(again, ["d1", "d2"]).where(place != F.col("first"))
    repeated = repeated.groupBy("id", "own", "seq", "start").agg(F.max("end").alias("end"), F.max("words").alias("words"), F.max("whole").alias("whole"), F.min("first").alias("first"))
    # neighbours have consecutive numbers
    line = (F.col("seq") < 0).alias("line")
    order = Window.partitionBy("id", "own", "line").orderBy("seq", "start")
    islands = repeated.select("*", line).withColumn("island", F.col("seq") - F.row_number().over(order))
    island = Window.partitionBy("id", "own", "line", "island")
    long = ~F.col("line") & (F.sum("words").over(island) >= min_words)
    cut = islands.withColumn("long", long).withColumn("reach", F.when(F.col("long"), F.max("end").over(island)).otherwise(F.col("end"))).where(F.col("long") | (F.col("whole") == 1))
    # lines within or across a passage are one with it
    along = Window.partitionBy("id", "own").orderBy("start", "seq")
    apart = F.coalesce(F.col("start") >= F.max("reach").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    cut = cut.withColumn("apart", apart.cast("int")).withColumn("passage", F.sum("apart").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    of_long = F.when(F.col("long"), F.col("words"))
    return cut.groupBy("id", "own", "passage").agg(
        F.min("start").alias("start"),
        F.max("end").alias("end"),
        F.coalesce(F.sum(of_long), F.sum("words")).alias("n_words"),
        F.greatest(F.count(of_long), F.lit(1)).alias("n_units"),
        F.min_by("first", F.struct("start", "seq")).alias("first"),
    )


def find_repeats(df: DataFrame, scratch: Scratch, min_words: int = 10, unit_words: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per passage or line to remove: id_col, start, end, n_words and
    n_units (compared in the passage; a line alone is one unit), first_doc and
    first_start (where its first unit stays). Rows do not overlap."""
    return _passages(df, scratch, min_words, unit_words, id_col, text_col).select(
        F.col("id").alias(id_col),
        *(F.col(c).cast("long").alias(c) for c in ("start", "end", "n_words", "n_units")),
        F.col("first.id").alias("first_doc"),
        F.col("first.start").cast("long").alias("first_start"),
    )


def drop_repeats(df: DataFrame, scratch: Scratch, min_words: int = 10, unit_words: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df with repeated passages cut from the text; other columns as they are."""
    working = Scratch(scratch.spark)
    found = _passages(df, working, min_words, unit_words, id_col, text_col)
    mark = F.struct("start", "end", F.lit("").alias("mark"))
    spans = found.groupBy(F.col("id").alias("_id"), F.col("own").alias("_own")).agg(F.array_sort(F.collect_list(mark)).alias("_spans"))
    same = F.col(id_col).eqNullSafe(F.col("_id")) & (_same_text(id_col, text_col) == F.col("_own"))
    spans = scratch.keep(spans)
    working.close()  # only spans are read from here on
    joined = df.join(spans, same, "left")
    text = F.col(text_col)
    return joined.withColumn(text_col, F.when(F.col("_spans").isNotNull(), replaced(text, F.col("_spans"))).otherwise(text)).select(*df.columns)
