"""Embedding near-dedup: Euclidean p-stable hashing, then exact cosines.

For unit vectors, cosine >= c means Euclidean distance <= r = sqrt(2 - 2c). A
hash is floor((a . v + b) / w) with Gaussian a: projections of two vectors at
distance d differ like d times a normal number, so close vectors share a bucket
often and distant ones seldom. ``projections`` such hashes are a bucket key;
``tables`` independent keys make misses rare. Every pair that shares a bucket in
any table is compared by its cosine in double precision.

Equal vectors are one class with a multiplicity, so copies are never compared.
Buckets of one class are dropped before vectors move. Each class then goes to the
cells of its other buckets with its components as they were given (floats stay
floats) and the list of these buckets. Small cells are compared a batch of cells
at a time, large ones by matrix products; both yield counts and a spanning set
of links, not pairs. A bucket larger than a block becomes several cells, one per
pair of blocks. A pair counts in the first table where it shares a bucket, so
none counts twice.

Vectors that are null, empty, zero, or hold null or non-finite components link
with nothing. Vectors of different length never link. Rows of equal id are
separate vectors under one id; a row without an id keeps to its component's
least id, if there is one. An empty table gives an empty one. Extra columns are
not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rosterloom.llm.components import components
from rosterloom.llm.scratch import Scratch
from rosterloom.llm.textbuf import U64, bounded_batches, mix, ragged


#: Cells of at most so many classes are compared many at a time.
SMALL = 32
#: Pairs whose components are held at once.
PAIRS = 1 << 14


def units(x: np.ndarray) -> np.ndarray:
    """The rows at length one, in doubles; rows that are zero or not finite are not."""
    x = x.astype(np.float64)
    with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
        x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow of squares
        return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _classes(df: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, np.dtype]:
    """id and components, packed as they are; null for vectors that are not usable."""
    kind = df.schema[vec_col].dataType.elementType
    dtype = np.dtype("<f4" if isinstance(kind, T.FloatType) else "<f8")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            sizes = np.fromiter((0 if n is None else n for n in pc.list_value_length(column).to_pylist()), dtype=np.int64, count=len(column))
            flat = column.flatten()
            bad = np.zeros(len(flat) + 1, dtype=np.int64)
            if flat.null_count:
                bad[1:] = np.cumsum(flat.is_null().to_numpy(zero_copy_only=False))
            values = flat.to_numpy(zero_copy_only=False).astype(dtype)
            starts = np.cumsum(sizes) - sizes
            packed: list[bytes | None] = [None] * len(column)
            for size in np.unique(sizes[sizes > 0]).tolist():
                rows = np.flatnonzero((sizes == size) & (bad[starts + sizes] == bad[starts]))
                x = values[starts[rows][:, None] + np.arange(size)]
                fine = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
                for i, v in zip(rows[fine].tolist(), x[fine], strict=True):
                    packed[i] = v.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, type=pa.binary())], names=["id", "v"])

    schema = T.StructType([T.StructField("id", df.schema[id_col].dataType), T.StructField("v", T.BinaryType())])
    return df.select(id_col, vec_col).mapInArrow(run, schema), dtype


def bucket_keys(x: np.ndarray, tables: int, projections: int, width: float, seed: int) -> np.ndarray:
    """A 64-bit bucket for each vector and table; its low byte is the table's number."""
    rng = np.random.default_rng([seed, x.shape[1]])
    a = rng.standard_normal((x.shape[1], tables * projections))
    b = rng.uniform(0, width, tables * projections)
    cells = np.floor((x @ a + b) / width).astype(np.int64).view(U64).reshape(len(x), tables, projections)
    keys = np.full((len(x), tables), x.shape[1], dtype=U64)
    with np.errstate(over="ignore"):
        for p in range(projections):
            keys = mix(keys * U64(0x9E3779B97F4A7C15) + cells[:, :, p])
    return ((keys & ~U64(255)) | np.arange(tables, dtype=U64)).view(np.int64)


def _roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For links a-b among n rows: the least reachable row of each row."""
    root = np.arange(n)
    while True:
        least = np.minimum(root[a], root[b])
        after = root.copy()
        np.minimum.at(after, a, least)
        np.minimum.at(after, b, least)
        after = after[after]
        if (after == root).all():
            return root
        root = after


class _Cells:
    """Whole cells of one batch: rows sorted by cell."""

    def __init__(self, batch: pa.RecordBatch, dtype: np.dtype, tables: int, least: float) -> None:
        self.bucket, self.lo, self.hi, self.own, self.node, self.copies = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(6))
        self._vectors, self._dtype, self._least = batch.column(6).cast(pa.large_binary()), dtype, least
        # the kept buckets of each row by table, 0 where it has none
        lists = batch.column(7)
        row = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
        held = lists.flatten().to_numpy(zero_copy_only=False)
        self._held = np.zeros((batch.num_rows, tables), dtype=np.int64)
        self._held[row, held & 255] = held

    def _units(self, rows: np.ndarray) -> np.ndarray:
        """Unit vectors of rows, which have one length."""
        _, offsets, data = self._vectors.buffers()
        at = np.frombuffer(offsets, dtype=np.int64)[self._vectors.offset :][rows]
        size = np.frombuffer(offsets, dtype=np.int64)[self._vectors.offset + rows[0] + 1] - at[0]
        raw = np.frombuffer(data, dtype=np.uint8)[at[:, None] + np.arange(size)]
        return units(raw.view(self._dtype))

    def _first(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which pairs of rows of a cell share no bucket of an earlier table."""
        table = self.bucket[a] & 255
        first = np.ones(len(a), dtype=bool)
        for t in range(self._held.shape[1]):
            x = self._held[a, t]
            first &= (t >= table) | (x != self._held[b, t]) | (x == 0)
        return first

    def _small(self, starts: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Similar pairs of rows of small cells, all of one vector length."""
        rows = ragged(starts, sizes)
        x = self._units(rows)
        place = np.arange(len(rows)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        after = np.repeat(sizes, sizes) - 1 - place  # rows of the cell behind this one
        ends = np.cumsum(after)
        begin = 0
        while begin < len(rows):
            done = ends[begin] - after[begin]
            end = max(int(np.searchsorted(ends, done + PAIRS, side="right")), begin + 1)
            n = after[begin:end]
            a = np.repeat(np.arange(begin, end), n)
            b = ragged(np.arange(begin, end) + 1, n)
            close = np.einsum("ij,ij->i", x[a], x[b]) >= self._least
            yield rows[a[close]], rows[b[close]]
            begin = end

    def _large(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Similar pairs of rows of one cell: of one block, or between two."""
        lo, hi = self.lo[rows[0]], self.hi[rows[0]]
        x = self._units(rows)
        if lo == hi:
            a, b = np.nonzero(np.triu(x @ x.T >= self._least, 1))
            return rows[a], rows[b]
        left, right = np.flatnonzero(self.own[rows] == lo), np.flatnonzero(self.own[rows] == hi)
        a, b = np.nonzero(x[left] @ x[right].T >= self._least)
        return rows[left[a]], rows[right[b]]

    def links(self) -> pa.RecordBatch:
        """Nodes with links, a node of their component here, and how many vectors each is linked to."""
        n = len(self.node)
        cell = np.stack([self.bucket, self.lo, self.hi])
        starts = np.flatnonzero(np.concatenate([[True], (cell[:, 1:] != cell[:, :-1]).any(axis=0)]))
        sizes = np.diff(np.append(starts, n))
        small = (sizes <= SMALL) & (self.lo[starts] == self.hi[starts])
        length = pc.binary_length(self._vectors).to_numpy(zero_copy_only=False)[starts]
        found = []
        for size in np.unique(length[small]).tolist():
            mine = small & (length == size)
            found += self._small(starts[mine], sizes[mine])
        found += [self._large(np.arange(s, s + k)) for s, k in zip(starts[~small].tolist(), sizes[~small].tolist(), strict=True)]
        links, root = np.zeros(n, dtype=np.int64), np.arange(n)
        if found:
            a, b = (np.concatenate(x) for x in zip(*found, strict=True))
            first = self._first(a, b)
            a, b = a[first], b[first]
            np.add.at(links, a, self.copies[b])
            np.add.at(links, b, self.copies[a])
            root = _roots(a, b, n)
        some = np.flatnonzero(links)
        return pa.RecordBatch.from_arrays([pa.array(x[some]) for x in (self.node, self.node[root], links)], names=["node", "near", "links"])


def near_duplicates(
    df: DataFrame,
    scratch: Scratch,
    least: float = 0.95,
    tables: int = 32,
    projections: int = 20,
    width: float = 2.4,
    block: int = 1024,
    seed: int = 7,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
) -> DataFrame:
    """One row per input row: id_col, n_links (other vectors linked directly),
    component_id (least id reachable by links, itself included), kept."""
    if not 0 < tables <= 256:
        raise ValueError("tables must be 1 to 256")
    bounded_batches(df)
    vectors, dtype = _classes(df, id_col, vec_col)
    vectors = scratch.keep(vectors)
    grouped = vectors.where(F.col("v").isNotNull()).groupBy("v").agg(F.min("id").alias("least_id"), F.count("*").alias("copies"))
    classes = scratch.keep(grouped.select(F.monotonically_increasing_id().alias("node"), "v", "least_id", "copies"))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False)
            for size in np.unique(length).tolist():
                part = batch.filter(pa.array(length == size))
                x = np.frombuffer(b"".join(part.column(1).to_pylist()), dtype=dtype).reshape(part.num_rows, -1)
                keys = bucket_keys(units(x), tables, projections, width, seed)
                bounds = np.arange(part.num_rows + 1, dtype=np.int32) * tables
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(bounds), pa.array(keys.reshape(-1)))], names=["node", "buckets"])

    # a bucket of one class says nothing; the others are a table, so Spark knows its size
    places = scratch.keep(classes.select("node", "v").mapInArrow(keyed, "node long, buckets array<long>")).select("node", F.explode("buckets").alias("bucket"))
    shared = scratch.keep(places.groupBy("bucket").agg(F.count("*").alias("size")).where(F.col("size") > 1))
    held = places.join(shared, "bucket").groupBy("node").agg(F.collect_list(F.struct("bucket", "size")).alias("held"))  # at most one a table
    held = held.join(classes.select("node", "v", "copies"), "node")
    rows = held.select("node", "copies", "v", F.col("held.bucket").alias("buckets"), F.explode("held").alias("h")).select("*", "h.bucket", "h.size")
    # a large bucket is cut into blocks by a hash of the node; each pair of blocks is a cell
    many = F.when(F.col("size") <= block, F.lit(1)).otherwise(F.ceil(F.col("size") / F.lit(block // 2)).cast("int"))
    own = F.pmod(F.xxhash64("node"), F.col("many")).cast("int")
    pairs_of_blocks = F.transform(F.sequence(F.lit(0), F.col("many") - 1), lambda o: F.struct(F.least("own", o).alias("lo"), F.greatest("own", o).alias("hi")))
    rows = rows.withColumn("many", many).withColumn("own", own).withColumn("pair", F.explode(pairs_of_blocks))
    cells = rows.select("bucket", F.col("pair.lo").alias("lo"), F.col("pair.hi").alias("hi"), "own", "node", "copies", "v", "buckets")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in chain(batches, [None]):
            parts = [p for p in (rest, batch) if p is not None and p.num_rows]
            if not parts:
                continue
            rows = pa.concat_batches(parts) if len(parts) > 1 else parts[0]
            whole = rows.num_rows
            if batch is not None:  # the last cell may go on in the next batch
                last = np.ones(whole, dtype=bool)
                for i in range(3):
                    column = rows.column(i).to_numpy(zero_copy_only=False)
                    last &= column == column[-1]
                whole = int(np.flatnonzero(~last)[-1]) + 1 if not last.all() else 0
            rest = rows.slice(whole)
            if whole:
                yield _Cells(rows.slice(0, whole), dtype, tables, least).links()

    cells = cells.repartition("bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi", "node")
    found = scratch.keep(cells.mapInArrow(compare, "node long, near long, links long"))
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    parts = scratch.keep(components(found.select(F.col("node").alias("a"), F.col("near").alias("b")), scratch))
    named = classes.join(counts, "node", "left").join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    roots = scratch.keep(named.groupBy("component").agg(F.min("least_id").alias("component_id")))
    named = named.join(roots, "component").select("v", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), "component_id")
    out = vectors.join(scratch.keep(named), "v", "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
