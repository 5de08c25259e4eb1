"""Classified lines to entries, entries to nested schedules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterloom.functions import checks, text
from rosterloom.operators.segment import split_by_terminator


def layout_lines(ocr: DataFrame) -> DataFrame:
    """raw_text kept as read, norm_text trimmed and normalised."""
    return ocr.withColumn("raw_text", F.col("text")).withColumn("norm_text", text.trim_space(text.normalize_text("text")))


def merge_address(parts: Column) -> Column:
    """All lines with Greek letters joined, or all others if there are none."""
    greek = F.filter(parts, lambda p: p.rlike(checks.GREEK_IN_LINE))
    return F.array_join(F.when(F.size(greek) > 0, greek).otherwise(parts), " ")


def entries_from_lines(lines: DataFrame, keys: list[str], order: str, line: str) -> DataFrame:
    """A phone line closes an entry. Name lines are joined in order, address
    lines merged, the last ten-digit phone wins; entries with neither name nor
    phone fall out. entry_no is dense within keys."""
    kinds = checks.with_line_kind(lines, line, "_kind")
    cut = split_by_terminator(kinds, keys, [order], F.col("_kind") == "phone")
    last10 = F.right(text.digits_only(line), F.lit(10))

    def collected(kind: str, value: Column) -> Column:
        pairs = F.array_sort(F.collect_list(F.when(F.col("_kind") == kind, F.struct(F.col(order).alias("o"), value.alias("v")))))
        return F.transform(pairs, lambda p: p["v"])

    grouped = cut.groupBy(*keys, "entry_no").agg(
        text.clean_field(F.array_join(collected("name", F.col(line)), " ")).alias("name"),
        text.clean_field(merge_address(collected("address", F.col(line)))).alias("address"),
        F.coalesce(F.get(F.reverse(F.filter(collected("phone", last10), lambda p: F.char_length(p) == 10)), F.lit(0)), F.lit("")).alias("phone"),
    )
    return grouped.where((F.col("name") != "") | (F.col("phone") != ""))


def distinct_entries(df: DataFrame, keys: list[str], order: list[str], fields: tuple[str, ...] = ("name", "address", "phone")) -> DataFrame:
    """Keeps the first, by order, of the entries equal in normalised fields. One
    aggregation, which combines before the shuffle; no sort of whole groups."""
    key = F.concat_ws("|", *(text.normalize_text(f) for f in fields))
    rest = [c for c in df.columns if c not in order and c not in keys]
    first = df.groupBy(*keys, key.alias("_key")).agg(F.min(F.struct(*order, *rest)).alias("_row"))
    return first.select(*keys, "_row.*").select(*df.columns)


def nest(df: DataFrame, levels: list[tuple[list[str], list[str], str]]) -> DataFrame:
    """Nests rows step by step. Each level is (keys that stay, columns that go
    into the structs in that order, name of the array). Arrays are sorted by the
    struct, so its first columns must be the ordinals."""
    for keys, columns, name in levels:
        items = F.array_sort(F.collect_list(F.struct(*columns)))
        df = df.groupBy(*keys).agg(items.alias(name)) if keys else df.agg(items.alias(name))
    return df


def schedule(df: DataFrame) -> DataFrame:
    """Flat entries to one row per document: days in order of column and day."""
    return nest(
        df,
        [
            (["doc_id", "col_index", "day_no", "date", "day_name", "shift_no", "from_time", "to_time"], ["entry_no", "name", "address", "phone"], "entries"),
            (["doc_id", "col_index", "day_no", "date", "day_name"], ["shift_no", "from_time", "to_time", "entries"], "shifts"),
            (["doc_id"], ["col_index", "day_no", "date", "day_name", "shifts"], "days"),
        ],
    )
