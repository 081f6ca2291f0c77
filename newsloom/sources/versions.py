"""Tables whose content is what the last commit names: commits are atomic, and old files never change.

A commit is a small JSON file with the next number, put in place by a rename that fails where the number is
taken. Parts are written before it; a job that dies leaves parts that no commit names, and the next run sees the
state of the last commit. Nothing but the list of parts passes the driver.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Conflict(RuntimeError):
    """Another writer has taken the commit's number."""


class Versions:
    """The commits of the table in ``folder``, a path of any file system that Spark writes to."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.path = lambda name: spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        self.files = self.path("commits").getFileSystem(spark._jsc.hadoopConfiguration())
        self.files.mkdirs(self.path("commits"))

    def number(self) -> int:
        """Of the last commit, 0 where there is none."""
        names = [s.getPath().getName() for s in self.files.listStatus(self.path("commits"))]
        return max([0, *[int(n[:-5]) for n in names if n.endswith(".json")]])

    def content(self, number: int | None = None) -> dict:
        number = self.number() if number is None else number
        if number == 0:
            return {}
        stream = self.files.open(self.path(f"commits/{number:012d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def commit(self, after: int, content: dict) -> int:
        """Make ``content`` the commit that follows ``after``; gives its number."""
        written = self.path(f"commits/.{uuid.uuid4()}")
        stream = self.files.create(written, False)
        stream.write(json.dumps(content).encode())
        stream.close()
        target = self.path(f"commits/{after + 1:012d}.json")
        if self.files.exists(target) or not self.files.rename(written, target):
            self.files.delete(written, False)
            raise Conflict(f"commit {after + 1} is there already")
        return after + 1

    def new_part(self) -> str:
        return f"{self.folder}/parts/{uuid.uuid4()}"

    def parts_of(self, path: str) -> list[str]:
        """The Parquet files of a part."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return sorted(s.getPath().toString() for s in self.files.listStatus(at) if s.getPath().getName().endswith(".parquet"))

    def remove(self, paths: list[str]) -> None:
        for path in paths:
            self.files.delete(self.spark._jvm.org.apache.hadoop.fs.Path(path), True)


class Snapshots:
    """Rows in Parquet files that the last commit lists. Retention rewrites only the files that hold expired rows."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.versions = spark, Versions(spark, folder)

    def append(self, rows: DataFrame) -> int:
        number = self.versions.number()
        content = self.versions.content(number)
        part = self.versions.new_part()
        rows.write.parquet(part)
        return self.versions.commit(number, {**content, "files": [*content.get("files", []), *self.versions.parts_of(part)], "schema": rows.schema.json()})

    def read(self, number: int | None = None) -> DataFrame:
        from pyspark.sql.types import StructType

        content = self.versions.content(number)
        schema = StructType.fromJson(json.loads(content["schema"]))
        return self.spark.read.schema(schema).parquet(*content["files"]) if content["files"] else self.spark.createDataFrame([], schema)

    def expire(self, expired: Column, reason: str) -> DataFrame:
        """Delete the rows that ``expired`` holds for (null: stays): files without one are kept as they are, the others are
        written again without them and then deleted. Gives the receipt: file, rows deleted, rows kept, reason; it is
        kept beside the table, and read by ``receipts``. A repeated run finds nothing to delete."""
        number = self.versions.number()
        content = self.versions.content(number)
        gone = F.coalesce(expired, F.lit(False))
        per_file = self.read(number).groupBy(F.col("_metadata.file_path").alias("file"))
        counted = per_file.agg(F.count_if(gone).alias("deleted"), F.count_if(~gone).alias("kept")).filter("deleted > 0")
        receipt_part = self.versions.new_part()
        counted.withColumn("reason", F.lit(reason)).write.parquet(receipt_part)
        receipt = self.spark.read.parquet(receipt_part)
        touched = {r["file"] for r in receipt.select("file").collect()}  # no more than the table has files
        if not touched:
            self.versions.remove([receipt_part])
            return self.spark.createDataFrame([], receipt.schema)
        named = {self.spark._jvm.org.apache.hadoop.fs.Path(f).toUri().getPath(): f for f in content["files"]}
        old = [named[self.spark._jvm.org.apache.hadoop.fs.Path(t).toUri().getPath()] for t in sorted(touched)]
        part = self.versions.new_part()
        self.spark.read.schema(self.read(number).schema).parquet(*old).filter(~gone).write.parquet(part)
        files = [*[f for f in content["files"] if f not in set(old)], *self.versions.parts_of(part)]
        self.versions.commit(number, {**content, "files": files, "receipts": [*content.get("receipts", []), receipt_part]})
        self.versions.remove(old)
        return receipt

    def receipts(self) -> DataFrame | None:
        found = self.versions.content().get("receipts", [])
        return self.spark.read.parquet(*found) if found else None
