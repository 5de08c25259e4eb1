"""On input in order, a stream gives what its batch form gives."""

import datetime as dt

from pyspark.sql import functions as F

from rosterloom.operators import state
from rosterloom.streaming import run
from rosterloom.streaming import state as streams

ROWS = [(i, f"u{i % 3}", "abca"[i // 3 % 4], dt.datetime(2026, 1, 1) + dt.timedelta(minutes=i)) for i in range(24)]


def events(spark, folder):
    df = spark.createDataFrame(ROWS, "seq long, user string, kind string, ts timestamp")
    df.coalesce(1).write.parquet(f"{folder}/raw")
    part = next(p for p in (folder / "raw").iterdir() if p.suffix == ".parquet")
    (folder / "in").mkdir()
    part.rename(folder / "in" / "events.parquet")
    return df


def test_changes(spark, tmp_path):
    df = events(spark, tmp_path)
    got = run.to_end(spark, str(tmp_path / "in"), "events", lambda s: streams.changed_only(s, "user", "ts", "kind"), "append")
    want = state.changes(df, ["user"], ["ts"], F.col("kind")).select("user", "ts", "kind")
    assert sorted(got.collect()) == sorted(want.collect())


def test_windows_and_weeks(spark, tmp_path):
    df = events(spark, tmp_path)
    got = run.to_end(spark, str(tmp_path / "in"), "events", lambda s: streams.counts_by_window(s, "ts", ["user"], "10 minutes"), "complete")
    assert got.agg(F.sum("n")).first()[0] == len(ROWS)
    weeks = run.to_end(spark, str(tmp_path / "in"), "events", lambda s: streams.latest_by_week(s, "ts", ["seq"]), "complete")
    assert [(r.week_key, r.seq) for r in weeks.collect()] == [("week:2026-W01", 23)]
    assert df.count() == 24


def test_fifo(spark, tmp_path):
    events(spark, tmp_path)
    stream = spark.readStream.schema("seq long, user string, kind string, ts timestamp").parquet(str(tmp_path / "in"))
    query = streams.fifo_keys(stream, "kind", "seq", str(tmp_path / "out"), size=2).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert {r.kind for r in spark.read.parquet(str(tmp_path / "out" / "0")).collect()} == {"b", "c"}
