"""Runs a bounded stream to its end and returns what it wrote."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def work_folder(spark: SparkSession) -> str:
    """A folder that driver and executors share; a temporary one in local mode."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        local = spark.sparkContext.master.startswith("local")
        shared = "file://" + tempfile.mkdtemp(prefix="rosterloom-") if local else spark.conf.get("spark.sql.warehouse.dir")
    return f"{shared.rstrip('/')}/stream-{uuid.uuid4().hex[:12]}"


def to_end(spark: SparkSession, folder: str, name: str, transform: Callable[[DataFrame], DataFrame], mode: str) -> DataFrame:
    """Streams the Parquet table folder/name.parquet through transform until all
    input is read. complete and update keep the last result of each batch's
    table, append adds up."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(folder)
    at = work_folder(spark)
    out = transform(stream)

    def put(batch: DataFrame, _: int) -> None:
        batch.write.mode("append" if mode == "append" else "overwrite").parquet(f"{at}/out")

    query = out.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).foreachBatch(put).start()
    query.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{at}/out")
