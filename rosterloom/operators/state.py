"""Keyed state in batch form: latest by key, freshness, bounded replay, change detection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rosterloom.operators.geometry import BLOCK_ITEMS, against_blocks


def latest_by_key(df: DataFrame, keys: list[str], at: list[str], values: list[str]) -> DataFrame:
    """The last put of each key."""
    last = F.max_by(F.struct(*values), F.struct(*at)).alias("_v")
    return df.groupBy(*keys).agg(last).select(*keys, "_v.*")


def fresh(df: DataFrame, at: str, now: Column, ttl: str) -> DataFrame:
    return df.where(F.col(at) > now - F.expr(f"INTERVAL {ttl}"))


def fifo_bound(df: DataFrame, key: str, seq: str, size: int = 20) -> DataFrame:
    """The newest distinct keys by first insertion; putting a key again does not renew it."""
    return df.groupBy(key).agg(F.min(seq).alias("first_seq")).orderBy(F.desc("first_seq")).limit(size)


def changes(df: DataFrame, keys: list[str], order: list[str], digest: Column) -> DataFrame:
    """Rows whose digest differs from the one before (unchanged answers are not sent again)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_d", digest).withColumn("_p", F.lag("_d").over(w)).where(F.col("_p").isNull() | (F.col("_d") != F.col("_p"))).drop("_d", "_p")


def entry(df: DataFrame, payload: list[str], at: Column) -> DataFrame:
    """A cache entry: JSON, its digest, and when it was made."""
    return df.withColumn("json", F.to_json(F.struct(*payload))).withColumn("sha", F.sha2("json", 256)).withColumn("fetched_at", at)


def serve(requests: DataFrame, state: DataFrame, key: str, if_none_match: str = "etag") -> DataFrame:
    """Requests against state: hit, unchanged (the asker has this digest) or miss.
    Stale entries are served; a miss is the caller's to compute."""
    joined = requests.join(state, key, "left")
    status = F.when(F.col("sha").isNull(), "miss").when(F.col(if_none_match) == F.col("sha"), "unchanged").otherwise("hit")
    return joined.withColumn("status", status)


def replay_by_hash(asked: DataFrame, state: DataFrame) -> DataFrame:
    """Stored payloads by digest; found is false for unknown ones."""
    return asked.join(state, "sha", "left").withColumn("found", F.col("json").isNotNull())


def single_flight(requests: DataFrame, key: str, order: str) -> DataFrame:
    """One request of each key does the work: leader marks it."""
    first = Window.partitionBy(key).orderBy(order)
    return requests.withColumn("leader", F.row_number().over(first) == 1)


def interval_pick(points: DataFrame, intervals: DataFrame, row: str, at: str, low: str, high: str, ordinal: str, block: int = BLOCK_ITEMS) -> DataFrame:
    """The first interval, by ordinal, that holds a point (both ends closed), else
    the newest one. row tells points apart."""
    item = F.struct(F.col(ordinal).alias("o"), F.col(low).alias("lo"), F.col(high).alias("hi"))

    def first(some: Column) -> Column:
        holding = F.filter(some, lambda i: F.col(at).between(i["lo"], i["hi"]))
        # a holding interval comes before every other, and of the others the newest
        held = F.struct(F.lit(0).alias("none"), F.get(holding, F.lit(0))["o"].alias("rank"), F.get(holding, F.lit(0))["o"].alias("o"))
        newest = F.get(some, F.size(some) - 1)["o"]
        return F.when(F.size(holding) > 0, held).when(F.size(some) > 0, F.struct(F.lit(1).alias("none"), (-newest).alias("rank"), newest.alias("o")))

    found = against_blocks(points, row, intervals, item, first, "_pick", block)
    return found.withColumn(ordinal, F.col("_pick.o")).drop("_pick")
