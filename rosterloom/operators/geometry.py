"""Boxes, columns and bands."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Items of one block.
BLOCK_ITEMS = 10_000


def against_blocks(queries: DataFrame, key: str, items: DataFrame, item: Column, best: Callable[[Column], Column], out: str, block: int = BLOCK_ITEMS) -> DataFrame:
    """queries with out: the least of best(array of items) over all blocks of items.

    Items are dealt into sorted arrays of about ``block`` by their hash; every
    query folds over every array, and no pair becomes a row. One block, of
    counted size, is broadcast; of more, each query goes to each, as an equi-join
    by block, and a query's least is combined before the shuffle. key tells
    queries apart. best must be null for an empty array.
    """
    blocks = -(-items.count() // block)
    packed = items.select(item.alias("_item"))
    if blocks <= 1:
        array = packed.agg(F.array_sort(F.collect_list("_item")).alias("_items"))
        return queries.join(F.broadcast(array)).withColumn(out, best(F.col("_items"))).drop("_items")
    arrays = packed.groupBy(F.pmod(F.xxhash64("_item"), F.lit(blocks)).alias("_block")).agg(F.array_sort(F.collect_list("_item")).alias("_items"))
    spread = queries.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    least = spread.join(arrays, "_block").withColumn(out, best(F.col("_items"))).groupBy(key).agg(F.min(out).alias(out))
    return queries.join(least, key, "left")


def to_image_space(lines: DataFrame, columns: DataFrame, keys: list[str]) -> DataFrame:
    """Column-local boxes shifted by their column's corner."""
    corner = columns.select(*keys, F.col("x0").alias("_dx"), F.col("y0").alias("_dy"))
    moved = {"x0": F.col("x0") + F.col("_dx"), "x1": F.col("x1") + F.col("_dx"), "y0": F.col("y0") + F.col("_dy"), "y1": F.col("y1") + F.col("_dy")}
    return lines.join(corner, keys).withColumns(moved).drop("_dx", "_dy")


def inside_band(lines: DataFrame, columns: DataFrame, key: str = "doc_id") -> DataFrame:
    """Lines whose middle lies within the vertical extent of their page's columns."""
    extent = columns.groupBy(key).agg(F.min("y0").alias("_top"), F.max("y1").alias("_bottom"))
    middle = (F.col("y0") + F.col("y1")) / 2
    return lines.join(extent, key).where((middle >= F.col("_top")) & (middle <= F.col("_bottom"))).drop("_top", "_bottom")


def line_role(lines: DataFrame, columns: DataFrame, key: str = "doc_id", slack: int = 10) -> DataFrame:
    """title, footer or body by where a line's middle lies against the columns.
    A page without columns has titles only."""
    extent = columns.groupBy(key).agg(F.min("y0").alias("_top"), F.max("y1").alias("_bottom"))
    middle = F.floor((F.col("y0") + F.col("y1")) / 2)
    role = F.when(F.col("_top").isNull() | (middle < F.col("_top") - slack), "title").when(middle > F.col("_bottom") + slack, "footer").otherwise("body")
    return lines.join(extent, key, "left").withColumn("role", role).drop("_top", "_bottom")


def _by_cell(values: DataFrame, bands: DataFrame, keys: list[str], value: str, low: str, high: str, slack: float, cell: float) -> DataFrame:
    """Pairs of values and bands that share a cell of the axis; an equi-join, so
    that large band tables need no nested loop."""
    cells = F.sequence(F.floor((F.col(low) - slack) / cell), F.floor((F.col(high) + slack) / cell))
    spread = bands.withColumn("_cell", F.explode(cells))
    return values.withColumn("_cell", F.floor(F.col(value) / cell)).join(spread, [*keys, "_cell"]).drop("_cell")


def band_first(values: DataFrame, bands: DataFrame, row: str, value: str, low: str, high: str, band_ord: str, keys: list[str] | None = None, slack: float = 8, cell: float = 64) -> DataFrame:
    """Each value with the first band, by ordinal, that holds it within slack;
    values in no band fall out. row identifies a value."""
    pairs = _by_cell(values, bands, keys or [], value, low, high, slack, cell).where(F.col(value).between(F.col(low) - slack, F.col(high) + slack))
    first = Window.partitionBy(row).orderBy(band_ord)
    return pairs.withColumn("_rn", F.row_number().over(first)).where("_rn = 1").drop("_rn")


def band_nearest(values: DataFrame, bands: DataFrame, row: str, value: str, low: str, high: str, band_ord: str, block: int = BLOCK_ITEMS) -> DataFrame:
    """Each value with the band of least |v - low| + |v - high|, the first on ties."""
    distance = lambda b: F.abs(F.col(value) - b["lo"]) + F.abs(F.col(value) - b["hi"])
    item = F.struct(F.col(band_ord).alias("o"), F.col(low).alias("lo"), F.col(high).alias("hi"))
    nearest = lambda some: F.array_min(F.transform(some, lambda b: F.struct(distance(b).alias("d"), b["o"].alias("o"))))
    found = against_blocks(values, row, bands, item, nearest, "_best", block)
    return found.withColumns({"distance": F.col("_best.d"), band_ord: F.col("_best.o")}).drop("_best").join(bands, band_ord)


def column_of_line(lines: DataFrame, columns: DataFrame, key: str = "doc_id", slack: int = 8) -> DataFrame:
    """col_index by the first column that holds the line's middle within slack,
    otherwise by the nearest one. A page has few columns: they travel as an array."""
    packed = columns.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col("col_index").alias("o"), F.col("x0").alias("lo"), F.col("x1").alias("hi")))).alias("_cols"))
    cx = F.floor((F.col("x0") + F.col("x1")) / 2)
    holding = F.filter("_cols", lambda b: cx.between(b["lo"] - slack, b["hi"] + slack))
    nearest = F.array_min(F.transform("_cols", lambda b: F.struct((F.abs(cx - b["lo"]) + F.abs(cx - b["hi"])).alias("d"), b["o"].alias("o"))))
    found = F.when(F.size(holding) > 0, F.get(holding, F.lit(0))["o"]).otherwise(nearest["o"])
    return lines.drop("col_index").join(packed, key, "left").withColumn("col_index", found).drop("_cols")


def columns_from_grid(grid: Column, width: Column, pad: int = 2) -> Column:
    """array<struct(x0, x1)>: neighbouring grid lines with a pad where there are
    four or more lines; otherwise four equal columns (three below 1000 pixels),
    the last taking what is left over."""
    n = F.when(width < 1000, 3).otherwise(4)
    step = F.floor(width / n).cast("int")
    equal = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct((i * step).alias("x0"), F.when(i == n - 1, width).otherwise((i + 1) * step).cast("int").alias("x1")))
    pairs = F.transform(F.sequence(F.lit(0), F.greatest(F.size(grid) - 2, F.lit(0))), lambda i: F.struct((F.get(grid, i) + pad).cast("int").alias("x0"), (F.get(grid, i + 1) - pad).cast("int").alias("x1")))
    return F.when(F.size(grid) >= 4, pairs).otherwise(equal)


def clip_box(x0: str, y0: str, x1: str, y1: str, w: Column, h: Column) -> Column:
    """A box cut to the image, null when nothing is left."""
    left, top = F.greatest(F.col(x0), F.lit(0)), F.greatest(F.col(y0), F.lit(0))
    right, bottom = F.least(F.col(x1), w), F.least(F.col(y1), h)
    return F.when((right > left) & (bottom > top), F.struct(left.alias("x0"), top.alias("y0"), right.alias("x1"), bottom.alias("y1")))


def target_width(w: Column, h: Column) -> Column:
    """Width of a crop scaled to height 48, at least 320."""
    return F.greatest(F.lit(320), (48 * w / h).cast("int") + 1)


def unclip(w: Column, h: Column, ratio: float = 1.5) -> Column:
    """How far a text box grows on each side."""
    return F.greatest(F.lit(1.0), w * h * ratio / (2 * (w + h)))


def keep_component(w: Column, h: Column, score: Column, least_side: int = 3, least_score: float = 0.6, least_grown: int = 5) -> Column:
    """Whether a detected component is large and sure enough."""
    grown = F.least(w, h) + 2 * unclip(w, h)
    return (F.least(w, h) >= least_side) & (score >= least_score) & (grown >= least_grown)


def wide_enough(x0: str, x1: str, least: int = 16) -> Column:
    """Whether a crop is worth reading."""
    return F.col(x1) - F.col(x0) >= least


def largest_by_area(df: DataFrame, keys: list[str], w: Column, h: Column, value: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.max_by(value, w * h).alias(value))


def grid_counts(pixels: DataFrame, axis: str, extent: int, share: float = 0.55) -> DataFrame:
    """Positions along an axis with more marks than a share of that axis's own extent."""
    return pixels.groupBy(axis).agg(F.count("*").alias("n")).where(F.col("n") > share * extent)
