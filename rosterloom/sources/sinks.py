"""JSON results, reports and decision tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterloom.operators.judge import latest_decisions
from rosterloom.operators.report import require
from rosterloom.sources.files import VERSION


def omit_empty(c: Column | str, kind: str) -> Column:
    """A zero value as null, which JSON leaves out."""
    c = F.col(c) if isinstance(c, str) else c
    if kind == "array":
        return F.when(F.size(c) > 0, c)
    return F.nullif(c, F.lit("" if kind == "string" else False if kind == "boolean" else 0))


def sorted_map(c: Column | str) -> Column:
    """A map with its entries in key order."""
    return F.map_from_entries(F.array_sort(F.map_entries(c)))


def as_json(df: DataFrame, columns: list[str], out: str = "json") -> DataFrame:
    """The columns as one pretty JSON document per row, fields in that order."""
    return df.select("*", F.to_json(F.struct(*columns), {"pretty": "true"}).alias(out))


def write_json(df: DataFrame, path: str) -> None:
    df.write.json(path)


def write_text(df: DataFrame, column: str, path: str) -> None:
    df.select(column).write.text(path)


def write_checked(df: DataFrame, path: str, source: str, **must_not: Column) -> None:
    """Writes to a new path after a strict check; never onto the table being read."""
    if path.rstrip("/") == source.rstrip("/"):
        raise ValueError("write to a new path")
    if must_not:
        require(df, **must_not)
    df.write.mode("error").json(path)


def put_decisions(df: DataFrame, path: str) -> None:
    """Puts decisions by key as one committed job; readers see all of it or none,
    and of each key the last put (see read_decisions)."""
    df.withColumn("version", F.lit(VERSION)).write.mode("append").parquet(path)


def compact_decisions(decisions: DataFrame, path: str) -> None:
    """Writes the last put of each key to a new path."""
    latest_decisions(decisions).withColumn("version", F.lit(VERSION)).write.mode("error").parquet(path)
