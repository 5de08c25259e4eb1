"""Ordered rows cut into sections: anchors, markers, terminators, islands, folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _window(keys: list[str], order: list[str]):
    return Window.partitionBy(*keys).orderBy(*order)


def in_reading_order(df: DataFrame, keys: list[str], y: str = "y0", x: str = "x0", ordinal: str = "line_no", out: str = "ord") -> DataFrame:
    """Numbers rows by (y, x), ties by their ordinal. With x equal to the
    ordinal this is the stable order by y alone."""
    return df.withColumn(out, F.row_number().over(_window(keys, [y, x, ordinal])))


def split_by_anchor(df: DataFrame, keys: list[str], order: list[str], anchor: Column, out: str = "section") -> DataFrame:
    """Section k holds the rows from the k-th anchor up to the next; section 0
    is the head before the first. Keys without any anchor have section 0 only."""
    return df.withColumn(out, F.sum(anchor.cast("int")).over(_window(keys, order).rowsBetween(Window.unboundedPreceding, 0)))


def days_from_anchors(df: DataFrame, keys: list[str], order: list[str], anchor: Column, out: str = "day_no") -> DataFrame:
    """split_by_anchor with the head given to the first section (in_head marks
    it), and keys without anchors dropped. Anchors stay, so an anchor followed by
    another is an empty day."""
    cut = split_by_anchor(df, keys, order, anchor, out)
    some = F.max(anchor.cast("int")).over(Window.partitionBy(*keys)) == 1
    return cut.withColumn("_some", some).where("_some").drop("_some").withColumn("in_head", F.col(out) == 0).withColumn(out, F.greatest(F.col(out), F.lit(1)))


def first_parsed(df: DataFrame, keys: list[str], parsed: str, order: list[str], out: str) -> DataFrame:
    """For each key the first value in order that parsed."""
    return df.where(F.col(parsed).isNotNull()).groupBy(*keys).agg(F.min_by(parsed, F.struct(*order)).alias(out))


def split_by_marker(df: DataFrame, keys: list[str], marker: Column, top: str = "y0", bottom: str = "y1", ordinal: str = "line_no", out: str = "shift_no") -> DataFrame:
    """Gives each line to a block between markers.

    Markers leave the lines. Block i takes the lines whose middle lies in
    [top of marker i, top of marker i+1). Lines whose bottom is at or above the
    first marker go to block 0; a line that overlaps the first marker from above
    is in no block and is dropped. Without markers all lines are block 0.
    marker_row is the marker's struct of the input columns, null without one.

    Blocks between markers are found by one window over lines and markers; no
    join and no range condition is needed.
    """
    middle = F.floor((F.col(top).cast("long") + F.col(bottom)) / 2)
    flagged = df.withColumn("_m", marker).withColumn("_at", F.when(F.col("_m"), F.col(top).cast("long")).otherwise(middle))
    # at equal heights the marker comes first, as its block includes its top
    order = [F.col("_at"), F.col("_m").desc(), F.col(ordinal)]
    before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys)
    row = F.struct(*(F.col(c) for c in df.columns))
    placed = (
        flagged.withColumn("_n", F.sum(F.col("_m").cast("int")).over(before))
        .withColumn("marker_row", F.last(F.when(F.col("_m"), row), ignorenulls=True).over(before))
        .withColumn("_first", F.min(F.when(F.col("_m"), F.col(top))).over(whole))
        .withColumn("_first_row", F.min(F.when(F.col("_m"), F.struct(F.col(top).alias("t"), F.col(ordinal).alias("o"), row.alias("r")))).over(whole))
    )
    head = (F.col("_n") == 0) & F.col("_first").isNotNull()
    above = head & (F.col(bottom) <= F.col("_first"))
    kept = placed.where(~F.col("_m") & (~head | above))
    return (
        kept.withColumn("marker_row", F.when(F.col("_n") == 0, F.col("_first_row.r")).otherwise(F.col("marker_row")))
        .withColumn(out, F.greatest(F.col("_n") - 1, F.lit(0)).cast("int"))
        .drop("_m", "_at", "_n", "_first", "_first_row")
    )


def split_by_terminator(df: DataFrame, keys: list[str], order: list[str], terminator: Column, out: str = "entry_no") -> DataFrame:
    """A terminator closes its section; rows after the last one belong to the
    last section, or to the only one if there is no terminator."""
    w = _window(keys, order)
    done = F.coalesce(F.sum(terminator.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    last = F.greatest(F.sum(terminator.cast("int")).over(Window.partitionBy(*keys)) - 1, F.lit(0))
    return df.withColumn(out, F.least(done, last))


def asof_backward(left: DataFrame, right: DataFrame, keys: list[str], at: str, right_ord: str, values: list[str]) -> DataFrame:
    """Each left row with the values of the latest right row of its key at or
    before it: a union and a window, not a range join. Later ordinals win ties.
    Values are null before the first right row."""
    wanted = F.struct(*(F.col(v) for v in values))
    rows = left.withColumn("_row", F.struct(*left.columns)).select(*keys, F.col(at).alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast(right.schema[right_ord].dataType).alias("_ord"), "_row", F.lit(None).cast(right.select(wanted.alias("v")).schema["v"].dataType).alias("_v"))
    marks = right.select(*keys, F.col(at).alias("_at"), F.lit(0).alias("_side"), F.col(right_ord).alias("_ord"), F.lit(None).cast(rows.schema["_row"].dataType).alias("_row"), wanted.alias("_v"))
    w = Window.partitionBy(*keys).orderBy("_at", "_side", "_ord").rowsBetween(Window.unboundedPreceding, 0)
    found = rows.unionByName(marks).withColumn("_v", F.last("_v", ignorenulls=True).over(w)).where("_side = 1")
    return found.select("_row.*", *(F.col(f"_v.{v}").alias(v) for v in values))


def pair_with_next(df: DataFrame, keys: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """The next row's value, null on the last."""
    return df.withColumn(out, F.lead(value).over(_window(keys, order)))


def islands(df: DataFrame, keys: list[str], value: str, gap: int = 2, out: str = "island") -> DataFrame:
    """Numbers runs of values whose steps are at most gap."""
    w = _window(keys, [value])
    new = F.coalesce((F.col(value) - F.lag(value).over(w) > gap).cast("int"), F.lit(0))
    return df.withColumn("_new", new).withColumn(out, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def island_spans(df: DataFrame, keys: list[str], value: str, gap: int = 2) -> DataFrame:
    """First, last, centre (whole number) and size of each run."""
    cut = islands(df, keys, value, gap)
    spans = cut.groupBy(*keys, "island").agg(F.min(value).alias("first"), F.max(value).alias("last"), F.count("*").alias("size"))
    return spans.withColumn("centre", F.floor((F.col("first") + F.col("last")) / 2).cast("long"))


def merge_close(values: Column, gap: int = 30, border: int = 5, size: Column | None = None) -> Column:
    """Folds a sorted array: a value closer than gap to the running merged value
    is averaged with it. The running value moves, so this is a fold and no
    window. With size, values within border of either end are dropped first."""
    kept = values if size is None else F.filter(values, lambda v: (v > border) & (v < size - border))

    def step(done: Column, v: Column) -> Column:
        last = F.get(done, F.size(done) - 1)
        merged = F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(F.floor((last + v) / 2).cast("int")))
        return F.when((F.size(done) > 0) & (v - last < gap), merged).otherwise(F.array_append(done, v.cast("int")))

    return F.aggregate(F.array_sort(kept), F.array().cast("array<int>"), step)


def fixed_batches(df: DataFrame, keys: list[str], order: list[str], width: str, size: int = 16, multiple: int = 8) -> DataFrame:
    """Batches of a fixed number of rows, each padded to its widest row rounded up.

    Rows are numbered within the values of the first order column; what comes
    before a value is a running sum over the counts of values. So the rows of a
    key are many tasks, and only the counts of values meet by key.
    """
    cell = [*keys, order[0]]
    counts = df.groupBy(*cell).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(_window(keys, order[:1]).rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(cell)), F.coalesce(before, F.lit(0)).alias("_before"))
    placed = df.withColumn("_place", F.row_number().over(_window(cell, order[1:] or order)))
    same = [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(cell)]
    place = F.col("_before") + F.col("_place") - 1
    numbered = placed.join(counts, same).withColumn("batch", F.floor(place / size).cast("int")).select(*df.columns, "batch")
    widest = F.max(width).over(Window.partitionBy(*keys, "batch"))
    return numbered.withColumn("padded", (F.ceil(widest / multiple) * multiple).cast("int"))


def ctc_collapse(best: Column, weight: Column, blank: int = 0) -> Column:
    """struct(ids, confidence): repeats and blanks of an argmax array dropped, a
    blank between equal ids keeps both; confidence is the mean weight of what is
    emitted, 0 when nothing is."""
    start = F.struct(F.lit(-1).alias("last"), F.array().cast("array<int>").alias("ids"), F.lit(0.0).alias("sum"))

    def step(done: Column, x: Column) -> Column:
        emit = (x["best"] != blank) & (x["best"] != done["last"])
        return F.struct(
            x["best"].cast("int").alias("last"),
            F.when(emit, F.array_append(done["ids"], x["best"].cast("int"))).otherwise(done["ids"]).alias("ids"),
            (done["sum"] + F.when(emit, x["weight"].cast("double")).otherwise(0.0)).alias("sum"),
        )

    pairs = F.zip_with(best, weight, lambda b, w: F.struct(b.alias("best"), w.alias("weight")))
    mean = lambda done: F.when(F.size(done["ids"]) > 0, done["sum"] / F.size(done["ids"])).otherwise(0.0)
    return F.aggregate(pairs, start, step, lambda done: F.struct(done["ids"].alias("ids"), mean(done).alias("confidence")))
