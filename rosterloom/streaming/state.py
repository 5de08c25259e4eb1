"""Keyed state over streams.

The lateness rule is ours: events later than the watermark are dropped, and on
input in order every stream gives what its batch form gives.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from rosterloom.functions.dates import week_key


def as_timestamps(df: DataFrame, at: str) -> DataFrame:
    """Watermarks need a timestamp with zone."""
    return df.withColumn(at, F.col(at).cast("timestamp"))


def latest_by_week(stream: DataFrame, at: str, values: list[str]) -> DataFrame:
    """The last put of each ISO week; update or complete mode."""
    last = F.max_by(F.struct(at, *values), F.col(at)).alias("_v")
    return stream.withColumn("week_key", week_key(F.to_date(at))).groupBy("week_key").agg(last).select("week_key", "_v.*")


def single_flight(stream: DataFrame, keys: list[str], at: str, lateness: str = "10 minutes") -> DataFrame:
    """One event of each key within the watermark's reach does the work."""
    return stream.withWatermark(at, lateness).dropDuplicatesWithinWatermark(keys)


def counts_by_window(stream: DataFrame, at: str, keys: list[str], width: str = "1 hour", lateness: str = "10 minutes") -> DataFrame:
    return stream.withWatermark(at, lateness).groupBy(F.window(at, width), *keys).agg(F.count("*").alias("n"))


def changed_only(stream: DataFrame, key: str, at: str, digest: str, ttl_ms: int = 3_600_000, lateness: str = "10 minutes") -> DataFrame:
    """Events whose digest differs from their key's last one. A key that is silent
    for longer than ttl_ms of event time is forgotten. Within a micro-batch events
    go by time; the state of a key is one digest."""

    def run(keys: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values(at, kind="stable")
        before = rows[digest].shift(1)
        before.iloc[0] = last
        yield rows[rows[digest] != before][[key, at, digest]]
        state.update((rows[digest].iloc[-1],))
        newest = int(rows[at].max().timestamp() * 1000)
        state.setTimeoutTimestamp(max(newest, state.getCurrentWatermarkMs()) + ttl_ms)

    schema = stream.select(key, at, digest).schema
    grouped = stream.select(key, at, digest).withWatermark(at, lateness).groupBy(key)
    return grouped.applyInPandasWithState(run, schema, "digest string", "append", GroupStateTimeout.EventTimeTimeout)


def fifo_keys(stream: DataFrame, key: str, seq: str, path: str, size: int = 20):
    """A writer that keeps the newest distinct keys by first insertion in a table at
    path/<batch>; each batch reads the one before, so a repeated batch repeats its result."""

    def put(batch: DataFrame, number: int) -> None:
        new = batch.groupBy(key).agg(F.min(seq).alias("first_seq"))
        if number:
            kept = batch.sparkSession.read.parquet(f"{path}/{number - 1}")
            new = kept.unionByName(new.join(kept, key, "left_anti"))
        new.orderBy(F.desc("first_seq")).limit(size).write.mode("overwrite").parquet(f"{path}/{number}")

    return stream.writeStream.foreachBatch(put)
