"""Counters, confusion matrices, signal statistics and text reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def counters(df: DataFrame, **conditions: Column) -> DataFrame:
    return df.agg(*(F.count_if(c).alias(k) for k, c in conditions.items()))


def require(df: DataFrame, **must_not: Column) -> None:
    """Raises if any row meets one of the conditions (strict mode, before a sink)."""
    counts = counters(df, **must_not).first().asDict()
    if any(counts.values()):
        raise ValueError(f"strict: {counts}")


def confusion(df: DataFrame, actual: str, predicted: str, values: list) -> DataFrame:
    """Counts by actual value, one column per predicted value."""
    return df.groupBy(actual).pivot(predicted, values).agg(F.count(F.lit(1))).na.fill(0)


def agreement(df: DataFrame, a: Column, b: Column) -> DataFrame:
    """How many rows agree, and the mean and largest difference."""
    gap = F.abs(a - b)
    return df.agg(F.count("*").alias("n"), F.count_if(a == b).alias("agree"), F.avg(gap).alias("mean_gap"), F.max(gap).alias("max_gap"))


def signal_stats(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Least, median and largest value by key."""
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.min(value).alias("first"), F.median(value).alias("median"), F.max(value).alias("last"))


def profile_variance(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Population variance of a profile."""
    return df.groupBy(*keys).agg(F.var_pop(value).alias("variance"))


def argmax_over_grid(df: DataFrame, keys: list[str], point: str, score: str, ordinal: str) -> DataFrame:
    """The grid point of the highest score, the first one on ties."""
    return df.groupBy(*keys).agg(F.max_by(point, F.struct(F.col(score), -F.col(ordinal))).alias(point), F.max(score).alias(score))


def raw_dump(lines: DataFrame, keys: list[str]) -> DataFrame:
    """One text per page: lines by (y, x), each with position and confidence."""
    row = F.format_string("y=%d x=%d c=%.3f %s\n", "y0", "x0", "confidence", "text")
    items = F.array_sort(F.collect_list(F.struct("y0", "x0", "line_no", row.alias("t"))))
    return lines.groupBy(*keys).agg(F.array_join(F.transform(items, lambda i: i["t"]), "").alias("dump"))


def inspect(lines: DataFrame, columns: DataFrame, key: str = "doc_id") -> DataFrame:
    """Lines, mean confidence, and lines whose middle is inside each column."""
    cx = F.floor((F.col("l.x0") + F.col("l.x1")) / 2)
    inside = columns.alias("c").join(lines.alias("l"), (F.col(f"c.{key}") == F.col(f"l.{key}")) & cx.between(F.col("c.x0"), F.col("c.x1")), "left")
    per_column = inside.groupBy(F.col(f"c.{key}").alias(key), F.col("c.col_index").alias("col_index")).agg(F.count("l.line_no").alias("in_column"))
    totals = lines.groupBy(key).agg(F.count("*").alias("n_lines"), F.avg("confidence").alias("mean_confidence"))
    return per_column.join(totals, key, "left")


def stage_timings(runs: DataFrame, stages: list[str]) -> DataFrame:
    """Mean whole milliseconds by stage over runs of nanoseconds (cut before the mean)."""
    long = runs.unpivot([], stages, "stage", "ns")
    return long.groupBy("stage").agg(F.avg(F.floor(F.col("ns") / 1_000_000)).alias("mean_ms"))


def token_usage(responses: DataFrame, keys: list[str], usage: str = "usage") -> DataFrame:
    """Tokens read and written, summed over responses with a struct usage."""
    total = lambda c: F.coalesce(F.sum(F.col(f"{usage}.{c}")), F.lit(0)).cast("long").alias(c)
    return responses.groupBy(*keys).agg(F.count("*").alias("requests"), total("input_tokens"), total("output_tokens"))


def decision_report(groups: DataFrame, key: str) -> DataFrame:
    """Judged pairs by key with the reference names involved."""
    return groups.groupBy(key).agg(F.array_sort(F.collect_set("ref_name")).alias("references"), F.array_sort(F.collect_list(F.struct("ref_name", "candidate", "outcome", "score"))).alias("pairs"))
