"""Files, folders and HTTP, and JSON tables."""

from __future__ import annotations

import time
import urllib.request

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rosterloom.operators.judge import latest_decisions
from rosterloom.schema import CATALOG, DECISIONS, GOLDEN

MAX_BYTES = 32 << 20
AGENT = "rosterloom/1.0"
VERSION = 1


def fetch(url: str, attempts: int = 3, pause: float = 0.5, timeout: float = 30.0) -> bytes:
    """HTTP GET: up to three attempts with growing pauses; anything but 200 is
    tried again; at most 32 MiB are taken."""
    problem: Exception | None = None
    for n in range(attempts):
        if n:
            time.sleep(pause * n)
        try:
            with urllib.request.urlopen(urllib.request.Request(url, headers={"User-Agent": AGENT}), timeout=timeout) as answer:
                if answer.status == 200:
                    return answer.read(MAX_BYTES)
                problem = OSError(f"{url}: status {answer.status}")
        except OSError as e:
            problem = e
    raise problem or OSError(url)


def read_source(spark: SparkSession, source: str) -> DataFrame:
    """content and source of a URL or of files, by the prefix."""
    if source.startswith(("http://", "https://")):
        return spark.createDataFrame([(fetch(source), source)], "content binary, source string")
    return spark.read.format("binaryFile").load(source).select("content", F.col("path").alias("source"))


def read_folder(spark: SparkSession, folder: str, suffix: str = "jpg") -> DataFrame:
    """Files of one folder by suffix in either case; subfolders are not read."""
    pattern = "*." + "".join(f"[{c.lower()}{c.upper()}]" for c in suffix)
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "false").load(folder)


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of catalog rows; a malformed file is an error. ref_no is the place in the array."""
    fields = [f for f in T._parse_datatype_string(CATALOG) if f.name != "ref_no"]
    kind = T.ArrayType(T.StructType(fields))
    text = spark.read.text(path, wholetext=True)
    rows = text.select(F.from_json("value", kind, {"mode": "FAILFAST"}).alias("rows")).select(F.posexplode("rows").alias("ref_no", "r")).select("ref_no", "r.*")
    strings = [f.name for f in fields if isinstance(f.dataType, T.StringType)]
    return rows.na.fill("", strings)


def read_golden(spark: SparkSession, path: str, rows: str = "pharmacies") -> DataFrame:
    """A JSON envelope whose array of records is exploded."""
    kind = T.StructType([T.StructField(rows, T.ArrayType(T._parse_datatype_string(GOLDEN)))])
    return spark.read.schema(kind).option("mode", "FAILFAST").json(path, multiLine=True).select(F.inline(rows))


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of strings, at least two, as one row chars."""
    chars = spark.read.text(path, wholetext=True).select(F.from_json("value", "array<string>", {"mode": "FAILFAST"}).alias("chars"))
    return chars.select(F.when(F.size("chars") >= 2, F.col("chars")).otherwise(F.raise_error(F.lit("dictionary too small"))).alias("chars"))


def read_decisions(spark: SparkSession, path: str) -> DataFrame:
    """A decision table, one row per key: the last one put. A missing path is an empty table; a wrong version is an error."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], DECISIONS)
    rows = spark.read.schema(DECISIONS + ", version INT").parquet(path)
    checked = F.when(F.col("version") == VERSION, F.col("key")).otherwise(F.raise_error(F.concat(F.lit("decision table version "), F.coalesce(F.col("version").cast("string"), F.lit("none")))))
    return latest_decisions(rows.withColumn("key", checked).drop("version"))
