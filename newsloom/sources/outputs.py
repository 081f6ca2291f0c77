"""Sinks: article files, frozen datasets, run reports and cluster results, as tables and JSON below a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.text import identity_prefix


def write_articles(articles: DataFrame, folder: str) -> None:
    """articles (canonical_url, body, ...) as JSON lines, and their bodies as a table by identity (20 hex digits)."""
    named = articles.withColumn("identity", identity_prefix(F.col("canonical_url")))
    ordered = sorted(c for c in named.columns if c != "body")
    named.select(*ordered).write.option("ignoreNullFields", "false").json(f"{folder}/articles")
    named.select("identity", "body").write.parquet(f"{folder}/bodies")


def write_frozen(rows: DataFrame, profile: DataFrame, folder: str) -> None:
    """A dataset by URL with sorted keys, and its profile (rows, undated rows and digest by source)."""
    rows.select(*sorted(rows.columns)).repartitionByRange("url").sortWithinPartitions("url").write.option(
        "ignoreNullFields",
        "false",
    ).json(f"{folder}/articles")
    profile.orderBy(profile.columns[0]).coalesce(1).write.json(f"{folder}/manifest")  # one row per source


def write_reports(reports: DataFrame, folder: str) -> None:
    """Run reports, appended: one JSON object each, keys in order."""
    reports.select(*sorted(reports.columns)).write.mode("append").option("ignoreNullFields", "false").json(f"{folder}/reports")


def write_clusters(stats: DataFrame, members: DataFrame, threshold: float, folder: str) -> None:
    """The clusters and members of one threshold, beside those of other thresholds."""
    for name, rows in (("clusters", stats), ("members", members)):
        rows.withColumn("threshold", F.lit(threshold)).write.mode("append").partitionBy("threshold").parquet(f"{folder}/{name}")


def write_scores(scores: DataFrame, folder: str) -> None:
    """Dossiers, prompts and scores of cases (case, dossier, prompt, score), appended by case."""
    scores.write.mode("append").partitionBy("case").parquet(f"{folder}/scores")


def insert_or_ignore(rows: DataFrame, path: str, key: list[str], order: str | None = None) -> int:
    """Append the rows whose key the table at ``path`` does not have, the first of each key by ``order`` (without one,
    the least in its other columns); gives how many. The table's rows of a key that is written already never change, so a write that is repeated adds none."""
    spark = rows.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
    others = [c for c in rows.columns if c not in key]
    fresh = rows.groupBy(*key).agg((F.min_by(F.struct(*others), order) if order else F.min(F.struct(*others))).alias("_r")).select(*key, "_r.*").select(*rows.columns)
    if there:
        fresh = fresh.join(spark.read.parquet(path).select(*key).distinct(), key, "left_anti")
    seen = Observation()
    fresh.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("append").parquet(path)
    return seen.get["n"]


def with_byte_size(snapshots: DataFrame, payload: str, into: str = "byte_size") -> DataFrame:
    """The size in UTF-8 bytes of each snapshot's payload as canonical JSON (text)."""
    return snapshots.withColumn(into, F.octet_length(payload).cast("long"))
