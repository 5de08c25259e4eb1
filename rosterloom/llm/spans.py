"""Spans of a text as Column expressions, in time near linear in text and spans.

Spark's folds copy an array for each element they append, and a substring walks
from the text's start. So offsets come from prefix sums by doubling (n log n),
and pieces of a text are cut from blocks of ``BLOCK`` code points, not from the
whole. Everything is a built-in function; spans are in code points, end
exclusive.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 256


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    """The running totals of an array<int> under an associative operation for
    which 0 changes nothing: after k steps each element holds 2**k of them."""

    def double(so_far: Column, back: Column) -> Column:
        return F.transform(so_far, lambda v, i: F.when(i < back, v).otherwise(join(v, F.get(so_far, i - back))))

    def total(some: Column) -> Column:
        backs = F.filter(F.array(*(F.lit(1 << k) for k in range(31))), lambda back: back < F.size(some))
        return F.aggregate(backs, some, double)

    return let(values, total)


def matches(text: Column, pattern: str) -> Column:
    """All matches from left to right: array of (start, end, found)."""
    pairs = F.zip_with(
        F.split(text, pattern, -1),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        lambda gap, found: F.struct(F.char_length(found).alias("size"), (F.char_length(gap) + F.char_length(found)).alias("step"), found.alias("found")),
    )

    def placed(whole: Column) -> Column:
        ends = running(F.transform(whole, lambda p: p["step"]), lambda a, b: a + b)
        return F.zip_with(whole, ends, lambda p, end: F.struct((end - p["size"]).alias("start"), end.alias("end"), p["found"].alias("found")))

    return let(F.filter(pairs, lambda p: p["found"].isNotNull()), placed)  # the last gap has no match after it


def blocks(text: Column) -> Column:
    """The text in blocks of BLOCK code points."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))


def piece(cut: Column, start: Column, size: Column) -> Column:
    """size code points from start on, of a text cut in blocks."""
    first = F.floor(start / BLOCK).cast("int")
    last = F.floor((start + F.greatest(size, F.lit(1)) - 1) / BLOCK).cast("int")
    held = F.when(first == last, F.coalesce(F.get(cut, first), F.lit(""))).otherwise(F.array_join(F.slice(cut, first + 1, last - first + 1), ""))
    return F.when(size > 0, F.substring(held, start - first * BLOCK + 1, size)).otherwise(F.lit(""))


def apart(some: Column, others: Column) -> Column:
    """The elements of some (structs with start and end) that overlap none of
    others. An element overlaps if, of the others that start before its end, the
    one that ends last ends after its start."""
    mine = F.transform(some, lambda s: F.struct(s["end"].alias("at"), F.lit(0).alias("other"), F.lit(0).alias("reach"), s.alias("s")))
    theirs = F.transform(others, lambda o: F.struct(o["start"].alias("at"), F.lit(1).alias("other"), o["end"].alias("reach"), F.get(some, F.lit(-1)).alias("s")))

    def free(both: Column) -> Column:
        reach = running(F.transform(both, lambda x: x["reach"]), F.greatest)
        kept = F.zip_with(both, reach, lambda x, r: F.when((x["other"] == 0) & (r <= x["s"]["start"]), x["s"]))
        return F.array_sort(F.array_compact(kept))

    return F.when(F.size(others) > 0, let(F.array_sort(F.concat(mine, theirs)), free)).otherwise(some)


def replaced(text: Column, spans: Column) -> Column:
    """The text with spans (array of (start, end, mark), in order) replaced by
    their marks. Of overlapping spans the first gives the mark, and all go."""

    def build(cut: Column, ordered: Column) -> Column:
        ends = running(F.transform(ordered, lambda s: s["end"]), F.greatest)

        def parts(reach: Column) -> Column:
            def part(s: Column, i: Column) -> Column:
                done = F.coalesce(F.get(reach, i - 1), F.lit(0))
                mark = F.when(s["start"] >= done, s["mark"]).otherwise(F.lit(""))
                return F.concat(piece(cut, done, s["start"] - done), mark)

            done = F.coalesce(F.get(reach, F.size(reach) - 1), F.lit(0))
            return F.concat(F.array_join(F.transform(ordered, part), ""), piece(cut, done, F.char_length(text) - done))

        return let(ends, parts)

    return let(blocks(text), lambda cut: let(spans, lambda ordered: build(cut, ordered)))
