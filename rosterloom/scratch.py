"""Shared scratch tables: where lineage is cut.

Intermediate results are written as Parquet below ``spark.checkpoint.dir``, the
folder that driver and executors share, so a lost executor costs a re-read and
never a recomputation. The setting is read from the session; a folder of our
own is used only when it is unset (the warehouse on a cluster, a temporary
folder in local mode, as in tests).
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="rosterloom-")
    return _LOCAL[app]


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@contextlib.contextmanager
def _shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Queries that run meanwhile remove their shuffle files as they end; else these
    stay until the driver happens to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


class Scratch:
    """Writes intermediate tables and removes them.

    ``keep`` writes a DataFrame and returns a reader of what was written; its
    shuffle files go at once, as nothing reads them again. ``drop`` removes tables
    that are no longer read, ``close`` all of them; those still feeding a returned
    (lazy) DataFrame stay until the application ends.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.root = f"{shared_dir(spark)}/rosterloom-{spark.sparkContext.applicationId}-{uuid.uuid4().hex[:12]}"
        self._n = 0
        atexit.register(self._at_exit)

    def keep(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/t{self._n}"
        self._n += 1
        with _shuffles_removed(self.spark):
            df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.__dict__["_scratch_path"] = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for table in tables:
            path = table.__dict__.pop("_scratch_path", None)
            if path:
                _delete(self.spark, path)

    def close(self) -> None:
        _delete(self.spark, self.root)

    def _at_exit(self) -> None:
        with contextlib.suppress(Exception):
            _delete(self.spark, self.root)
