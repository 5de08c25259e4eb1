"""N-gram Jaccard join as a blocked sparse matrix product.

Rows of the incidence matrix are documents (one per distinct shingle set), its
columns word n-grams. Of each row only the part that a similar document must
touch is multiplied: with columns ordered from rare to frequent, two sets of
similarity s or more share a column among the first n - ceil(s * n) + 1 of
either. The order comes from a fixed-size sketch of column loads, counted over
all documents and broadcast (2**sketch_bits numbers).

The product is taken by column. A column of more than ``block`` rows is cut into
blocks of rows, and each pair of blocks is multiplied on its own, so a column in
a third of all rows is many tasks. Overlap counts are accumulated over the
columns early enough in both rows for the bound to be in reach, and a pair is
dropped when its overlap so far and the most that the rest of both sets can add
stay below the bound that follows from the sizes. What is left is held against a
second bound, from the sets' sizes by block of columns, and then compared exactly
on whole sets. ``similar_pairs`` returns the product's links.

Components need fewer: with ``prefilter`` each column first links its rows to the
most connected row of their size class and of the next, a linear number of
comparisons that finds the components of most groups of copies. Columns whose
rows lie in one component by then are left out of the product, and so are pairs
within a component. No link between components is missed; without the prefilter,
the product makes all links, and the components are the same.

Nulls, empty texts and texts without words have the empty set and link with
nothing; a text of fewer than n words is one shingle. Equal rows share a class;
of rows without an id, only those in a class with ids get one. Sets are told
apart by a 64-bit digest and their size, shingles by 64-bit hashes. An empty
table gives an empty one. Extra columns are not read, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rosterloom.llm.components import components
from rosterloom.llm.scratch import Scratch
from rosterloom.llm.textbuf import LOWER, SPACE, U64, Chunk, bounded_batches, chunks, mix, slice_hashes, trimmed


#: Blocks of columns whose sizes bound the overlap of two sets.
BLOCKS = 256


def shingle_sets(chunk: Chunk, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of a chunk's rows, sorted by row and hash: hash, row."""
    data = LOWER[chunk.data]
    starts, ends, rows = chunk.runs(~SPACE[data])
    h = slice_hashes(data, starts, ends)
    count = np.bincount(rows, minlength=chunk.n)
    step = U64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        if len(h) >= n:
            out = h[: len(h) - n + 1].copy()
            for k in range(1, n):
                out = mix(out * step + h[k : len(h) - n + 1 + k])
            whole = rows[: len(h) - n + 1] == rows[n - 1 :]
            out, out_rows = out[whole], rows[: len(h) - n + 1][whole]
        else:
            out, out_rows = h[:0], rows[:0]
        first = np.cumsum(count) - count
        few = np.flatnonzero((count > 0) & (count < n))
        short = np.empty(len(few), dtype=U64)
        for i, row in enumerate(few.tolist()):
            value = U64(count[row])
            for w in h[first[row] : first[row] + count[row]]:
                value = mix(np.array([value * step + w], dtype=U64))[0]
            short[i] = value
    out, out_rows = np.concatenate([out, short]), np.concatenate([out_rows, few])
    order = np.lexsort((out, out_rows))
    out, out_rows = out[order], out_rows[order]
    new = np.ones(len(out), dtype=bool)
    new[1:] = (out[1:] != out[:-1]) | (out_rows[1:] != out_rows[:-1])
    return out[new], out_rows[new]


def _digests(h: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """A digest of each row's set, and its size."""
    size = np.bincount(rows, minlength=n)
    with np.errstate(over="ignore"):
        running = np.concatenate([[U64(0)], np.cumsum(mix(h ^ U64(0x51ED270B35AE9D4B)))])
        ends = np.cumsum(size)
        return mix(running[ends] - running[ends - size] + size.astype(U64)).view(np.int64), size


def size_sketches(h: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Each row's shingles counted by block of columns, up to 255."""
    cells = rows * BLOCKS + (h & U64(BLOCKS - 1)).astype(np.int64)
    return np.minimum(np.bincount(cells, minlength=n * BLOCKS), 255).astype(np.uint8).reshape(n, BLOCKS)


def overlap_bounds(x: np.ndarray, y: np.ndarray, nx: np.ndarray, ny: np.ndarray) -> np.ndarray:
    """The most that pairs of sets can share, from their sizes by block. A full
    cell may hold more, so it counts as the whole smaller set."""
    low = np.minimum(x, y).astype(np.int64)
    most = low.sum(axis=1)
    full = ((x == 255) & (y == 255)).any(axis=1)
    return np.where(full, np.minimum(nx, ny), most)


def prefix_size(n: np.ndarray, num: int, den: int) -> np.ndarray:
    """How many columns of a set of n must be looked at."""
    return np.where(n > 0, n + 1 - -(-num * n // den), 0)


def _loads(df: DataFrame, n: int, bits: int, text_col: str) -> np.ndarray:
    """How many shingles fall on each cell of the sketch. Tasks count into arrays
    and send these by block, compressed; blocks are summed as they stream in."""
    bounded_batches(df)
    blocks = max(1, (1 << bits) >> 14)
    size = (1 << bits) // blocks

    @trimmed
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << bits, dtype=np.int32)
        for batch in batches:
            for chunk in chunks(batch.column(0)):
                if len(chunk.data):
                    np.add.at(total, (shingle_sets(chunk, n)[0] >> U64(64 - bits)).astype(np.int64), 1)
        if total.any():
            packed = [zlib.compress(x.tobytes(), 1) for x in total.reshape(blocks, size)]
            yield pa.RecordBatch.from_arrays([pa.array(range(blocks), type=pa.int32()), pa.array(packed, type=pa.binary())], names=["block", "counts"])

    @trimmed
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, counts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                total = sums.setdefault(block, np.zeros(size, dtype=np.int64))
                total += np.frombuffer(zlib.decompress(counts.as_py()), dtype=np.int32)
        for block, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([block], type=pa.int32()), pa.array([total.tobytes()], type=pa.binary())], names=["block", "counts"])

    schema = "block int, counts binary"
    summed = df.select(text_col).mapInArrow(count, schema).repartition("block").mapInArrow(add, schema).toPandas()
    out = np.zeros((blocks, size), dtype=np.int64)
    for block, counts in zip(summed["block"], summed["counts"], strict=True):
        out[block] = np.frombuffer(counts, dtype=np.int64)
    # only the order of loads counts; so many fit in 32 bits at any size of input
    return np.minimum(out.reshape(-1), np.iinfo(np.int32).max).astype(np.int32)


def _prefixes(df: DataFrame, n: int, num: int, den: int, bits: int, id_col: str, text_col: str) -> DataFrame:
    """One row per document: id, digest, n (set size), sketch (sizes by block),
    prefix array<long> (in column order)."""
    loads = df.sparkSession.sparkContext.broadcast(_loads(df, n, bits, text_col))

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column(1)):
                h, rows = shingle_sets(chunk, n) if len(chunk.data) else (np.empty(0, dtype=U64), np.empty(0, dtype=np.int64))
                digest, size = _digests(h, rows, chunk.n)
                order = np.lexsort((h, loads.value[(h >> U64(64 - bits)).astype(np.int64)], rows))
                first = np.cumsum(size) - size
                place = np.arange(len(h)) - np.repeat(first, size)
                take = place < np.repeat(prefix_size(size, num, den), size)
                kept = h[order][take].view(np.int64)
                bounds = np.concatenate([[0], np.cumsum(prefix_size(size, num, den))]).astype(np.int32)
                prefix = pa.ListArray.from_arrays(pa.array(bounds), pa.array(kept))
                sketch = pa.Array.from_buffers(pa.binary(), chunk.n, [None, pa.py_buffer((np.arange(chunk.n + 1) * BLOCKS).astype(np.int32)), pa.py_buffer(size_sketches(h, rows, chunk.n).tobytes())])
                columns = [batch.column(0).slice(chunk.first, chunk.n), pa.array(digest), pa.array(size.astype(np.int64)), sketch, prefix]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "digest", "n", "sketch", "prefix"])

    schema = T.StructType([T.StructField("id", df.schema[id_col].dataType), T.StructField("digest", T.LongType()), T.StructField("n", T.LongType()), T.StructField("sketch", T.BinaryType()), T.StructField("prefix", T.ArrayType(T.LongType()))])
    return df.select(id_col, text_col).mapInArrow(run, schema)


class _Verifier:
    """Compares pairs of sets exactly and remembers which pairs it has seen.

    Pairs are first held against the bound from their sizes by block, on sketches
    of fixed size. Whole sets are only built for what is left: the texts are read
    again, and a bit array of fixed size, broadcast, says which rows may be
    wanted, so that the other texts are neither shingled nor shuffled.
    """

    def __init__(self, df: DataFrame, reps: DataFrame, scratch: Scratch, n: int, num: int, den: int, id_col: str, text_col: str, filter_bits: int = 20) -> None:
        self._texts = df.select(F.xxhash64(id_col).alias("cell"), F.col(text_col).alias("text"))
        self._reps, self._scratch, self._bits = reps, scratch, filter_bits
        self._n, self._num, self._den = n, num, den
        self.seen: DataFrame | None = None

    def _within_bounds(self, pairs: DataFrame) -> DataFrame:
        num, den = self._num, self._den

        @trimmed
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                nx, ny = (batch.column(i).to_numpy() for i in (2, 3))
                x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), dtype=np.uint8).reshape(-1, BLOCKS) for i in (4, 5))
                keep = overlap_bounds(x, y, nx, ny) * (den + num) >= (nx + ny) * num
                yield batch.select([0, 1]).filter(pa.array(keep))

        side = lambda k, n, s: self._reps.select(F.col("node").alias(k), F.col("n").alias(n), F.col("sketch").alias(s))
        both = pairs.join(side("a", "nx", "sx"), "a").join(side("b", "ny", "sy"), "b")
        return both.select("a", "b", "nx", "ny", "sx", "sy").mapInArrow(run, "a long, b long")

    def _sets(self, pairs: DataFrame) -> DataFrame:
        """node, set (sorted hashes, packed) of the nodes in pairs, and of a few others."""
        nodes = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node")))
        wanted = self._reps.join(nodes, "node", "left_semi")
        shift, n = U64(64 - self._bits), self._n
        cells = wanted.select(F.shiftrightunsigned(F.xxhash64("id"), 64 - self._bits).alias("cell")).distinct().toPandas()["cell"]
        marks = np.zeros(1 << self._bits, dtype=bool)
        marks[cells.to_numpy(dtype=np.int64)] = True
        marks = self._texts.sparkSession.sparkContext.broadcast(np.packbits(marks))

        @trimmed
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            marked = np.unpackbits(marks.value).astype(bool)
            for batch in batches:
                cell = (batch.column(0).to_numpy().view(U64) >> shift).astype(np.int64)
                for chunk in chunks(batch.filter(pa.array(marked[cell])).column(1)):
                    if not len(chunk.data):
                        continue
                    h, rows = shingle_sets(chunk, n)
                    digest, size = _digests(h, rows, chunk.n)
                    bounds = (np.concatenate([[0], np.cumsum(size)]) * 8).astype(np.int32)
                    packed = pa.Array.from_buffers(pa.binary(), chunk.n, [None, pa.py_buffer(bounds), pa.py_buffer(h.tobytes())])
                    yield pa.RecordBatch.from_arrays([pa.array(digest), packed], names=["node", "set"])

        sets = self._texts.mapInArrow(run, "node long, set binary")
        return sets.join(nodes.distinct(), "node", "left_semi").dropDuplicates(["node"])

    def links(self, pairs: DataFrame) -> DataFrame:
        """Of the pairs (a, b), a < b, not seen before, those that are similar."""
        pairs = pairs.select("a", "b").distinct()
        if self.seen is not None:
            pairs = pairs.join(self.seen, ["a", "b"], "left_anti")
        pairs = self._scratch.keep(pairs)
        self.seen = pairs if self.seen is None else self.seen.union(pairs)
        close = self._scratch.keep(self._within_bounds(pairs))
        if close.isEmpty():
            return close
        num, den = self._num, self._den

        @trimmed
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.zeros(batch.num_rows, dtype=bool)
                for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                    x, y = np.frombuffer(x.as_buffer(), dtype=U64), np.frombuffer(y.as_buffer(), dtype=U64)
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    keep[i] = den * both >= num * (len(x) + len(y) - both)
                yield batch.select([0, 1]).filter(pa.array(keep))

        sets = self._scratch.keep(self._sets(close))
        left = close.join(sets.select(F.col("node").alias("a"), F.col("set").alias("x")), "a")
        full = left.join(sets.select(F.col("node").alias("b"), F.col("set").alias("y")), "b")
        found = self._scratch.keep(full.select("a", "b", "x", "y").mapInArrow(run, "a long, b long"))
        self._scratch.drop(sets, close)
        return found


def _fits(x: str, y: str, num: int, den: int) -> Column:
    """Whether sets of these sizes can be similar."""
    return F.least(x, y) * den >= F.greatest(x, y) * num


class _Matrix:
    """The incidence matrix of a table: its classes, and its shared columns."""

    def __init__(self, df: DataFrame, scratch: Scratch, n: int, num: int, den: int, sketch_bits: int, id_col: str, text_col: str) -> None:
        self._scratch, self._num, self._den = scratch, num, den
        self.docs = scratch.keep(_prefixes(df, n, num, den, sketch_bits, id_col, text_col))
        # one row per class; rows with an id come before those without
        least = F.min(F.struct(F.col("id").isNull().alias("none"), "id")).alias("least")
        grouped = self.docs.where("n > 0").groupBy(F.col("digest").alias("node")).agg(least, *(F.first(c).alias(c) for c in ("n", "sketch", "prefix")))
        self.classes = scratch.keep(grouped.select("node", "least.id", "n", "sketch", "prefix"))
        entries = self.classes.select("node", "n", F.posexplode("prefix").alias("pos", "column"))
        rows = scratch.keep(entries.groupBy("column").agg(F.count("*").alias("rows")).where(F.col("rows") > 1))
        self.shared = scratch.keep(entries.join(rows, "column"))
        self.verifier = _Verifier(df, self.classes, scratch, n, num, den, id_col, text_col)

    def near(self) -> DataFrame:
        """Pairs of rows and the most connected rows of their columns, by size class."""
        step = F.floor(F.log(F.col("n")) / F.log(F.lit(self._den / self._num))).cast("int").alias("step")
        company = self._scratch.keep(self.shared.groupBy("node").agg(F.sum("rows").alias("company")))
        led = self.shared.join(company, "node").select("column", "node", "n", "company", step)
        heads = led.groupBy("column", "step").agg(F.max(F.struct("company", "node", "n")).alias("head"))
        heads = self._scratch.keep(heads.select("column", F.explode(F.array("step", F.col("step") - 1)).alias("step"), F.col("head.node").alias("head"), F.col("head.n").alias("head_n")))
        pairs = led.join(heads, ["column", "step"]).where((F.col("node") != F.col("head")) & _fits("n", "head_n", self._num, self._den))
        return pairs.select(F.least("node", "head").alias("a"), F.greatest("node", "head").alias("b"))

    def product(self, parts: DataFrame | None, block: int) -> DataFrame:
        """Pairs of rows whose overlap can still reach the bound. parts: pairs
        within a component of it are not made."""
        num, den = self._num, self._den
        some = self.shared.select("column", "node", "n", "pos", "rows")
        if parts is None:
            some = some.withColumn("component", F.col("node"))
        else:
            some = some.join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
            mixed = some.groupBy("column").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high")
            some = some.join(self._scratch.keep(mixed.select("column")), "column")
        blocks = F.ceil(F.col("rows") / F.lit(block)).cast("int")
        some = self._scratch.keep(some.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")))
        every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
        x = some.withColumn("left", F.col("own")).withColumn("right", every).alias("x")
        y = some.withColumn("right", F.col("own")).withColumn("left", every).alias("y")
        cell = (F.col("x.column") == F.col("y.column")) & (F.col("x.left") == F.col("y.left")) & (F.col("x.right") == F.col("y.right"))
        apart = (F.col("x.node") < F.col("y.node")) & (F.col("x.component") != F.col("y.component"))
        # a similar pair meets first where the rest of both sets still reaches the bound
        early = F.least(F.col("x.n") - F.col("x.pos"), F.col("y.n") - F.col("y.pos")) * (den + num) >= (F.col("x.n") + F.col("y.n")) * num
        met = x.join(y, cell & apart & _fits("x.n", "y.n", num, den) & early).groupBy(F.col("x.node").alias("a"), F.col("y.node").alias("b"))
        overlaps = met.agg(F.count("*").alias("both"), F.max("x.pos").alias("i"), F.max("y.pos").alias("j"), F.max("x.n").alias("na"), F.max("y.n").alias("nb"))
        most = F.col("both") + F.least(F.col("na") - 1 - F.col("i"), F.col("nb") - 1 - F.col("j"))
        return overlaps.where(most * (den + num) >= (F.col("na") + F.col("nb")) * num)


def jaccard_classes(
    df: DataFrame,
    scratch: Scratch,
    n: int = 5,
    num: int = 80,
    den: int = 100,
    sketch_bits: int = 22,
    block: int = 1024,
    prefilter: bool = True,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per input row: id_col, n_shingles, class_id (least id with the
    same set) and component_id (least id reachable by links of similarity
    num / den or more, itself included)."""
    matrix = _Matrix(df, scratch, n, num, den, sketch_bits, id_col, text_col)
    if prefilter:
        near = matrix.verifier.links(matrix.near())
        links = near.union(matrix.verifier.links(matrix.product(scratch.keep(components(near, scratch)), block)))
    else:
        links = matrix.verifier.links(matrix.product(None, block))
    final = components(links, scratch)
    named = matrix.classes.select("node", "id").join(final, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("id").alias("component_id"))
    named = scratch.keep(named.join(least, "component").select(F.col("node").alias("digest"), F.col("id").alias("class_id"), "component_id"))
    out = matrix.docs.select("id", "digest", F.col("n").alias("n_shingles")).join(named, "digest", "left")
    own = lambda c: F.when(F.col("n_shingles") > 0, F.col(c)).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), "n_shingles", own("class_id").alias("class_id"), own("component_id").alias("component_id"))


def similar_pairs(
    df: DataFrame, scratch: Scratch, n: int = 5, num: int = 80, den: int = 100, sketch_bits: int = 22, block: int = 1024, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Every link between classes: a and b, the least ids of two sets of
    similarity num / den or more; jaccard_classes has the rows of each class."""
    matrix = _Matrix(df, scratch, n, num, den, sketch_bits, id_col, text_col)
    links = scratch.keep(matrix.verifier.links(matrix.product(None, block)))
    name = lambda k: matrix.classes.select(F.col("node").alias(k), F.col("id").alias(f"id_{k}"))
    named = links.join(name("a"), "a").join(name("b"), "b")
    return named.select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b"))


def keep_first(df: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", **options: int) -> DataFrame:
    """The rows of df whose id is the least of their component, with all columns.
    Rows without an id stay; of rows equal in id, all stay or none."""
    working = Scratch(scratch.spark)
    found = jaccard_classes(df, working, id_col=id_col, text_col=text_col, **options)
    later = scratch.keep(found.where(F.col("component_id") != F.col(id_col)).select(F.col(id_col)).distinct())
    working.close()  # only ids are read from here on
    return df.join(later, id_col, "left_anti").select(*df.columns)
