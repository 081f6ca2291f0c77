"""Readers of receipts: JSON lines and single JSON documents under a size limit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest receipt file, in bytes: a fixed value.
MOST_BYTES = 25 * 1024 * 1024


def read_jsonl(spark: SparkSession, path: str, schema: str, most_bytes: int = MOST_BYTES) -> DataFrame:
    """Rows of JSON-lines files; bad JSON fails the read, and so does a file over the limit."""
    rows = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    size = F.when(F.col("_metadata.file_size") > most_bytes, F.raise_error(F.lit("receipt is too large"))).otherwise(F.lit(True))
    return rows.filter(size)


def read_json(spark: SparkSession, path: str, schema: str, most_bytes: int = MOST_BYTES) -> DataFrame:
    rows = spark.read.schema(schema).option("mode", "FAILFAST").option("multiLine", True).json(path)
    size = F.when(F.col("_metadata.file_size") > most_bytes, F.raise_error(F.lit("receipt is too large"))).otherwise(F.lit(True))
    return rows.filter(size)


def append_jsonl(rows: DataFrame, path: str) -> None:
    """Append decisions as JSON lines, keys in order; nulls are written out."""
    rows.select(*sorted(rows.columns)).write.mode("append").option("ignoreNullFields", "false").json(path)


def read_positions(spark: SparkSession, path: str, schema: str, most_bytes: int = MOST_BYTES) -> DataFrame:
    """path, position and record of every line that is not blank of JSON-lines files: the place of a record in its
    receipt, from 0. A file is read whole, which its limit bounds; a line that is no JSON fails the read."""
    files = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size"))
    sized = files.filter(F.when(F.col("size") > most_bytes, F.raise_error(F.lit("receipt is too large"))).otherwise(F.lit(True)))
    lines = F.filter(F.split("value", "\n"), lambda x: F.trim(x) != "")
    return sized.select("path", F.posexplode(lines).alias("position", "line")).select(
        "path", "position", F.from_json("line", schema, {"mode": "FAILFAST"}).alias("record")
    )
