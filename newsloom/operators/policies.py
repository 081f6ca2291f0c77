"""Policy versions of sources, and which sources may be scheduled."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def policy_versions(manifests: DataFrame, attributes: list[str], existing: DataFrame | None = None) -> DataFrame:
    """source_id, content_hash, version and status of every policy after manifests were read in order.

    manifests: source_id, ord and ``attributes``. A manifest whose attributes hash to a policy that the source
    ever had uses that one again, even if it is not the latest; a new hash becomes a draft with the next version.
    """
    digest = F.sha2(F.to_json(F.struct(*sorted(attributes)), {"ignoreNullFields": "false"}), 256)
    first = manifests.groupBy("source_id", digest.alias("content_hash")).agg(F.min("ord").alias("ord"))
    if existing is not None:
        first = first.join(existing.select("source_id", "content_hash"), ["source_id", "content_hash"], "left_anti")
        had = existing.groupBy("source_id").agg(F.max("version").alias("_had"))
        first = first.join(had, "source_id", "left")
    else:
        first = first.withColumn("_had", F.lit(None).cast("int"))
    number = F.row_number().over(Window.partitionBy("source_id").orderBy("ord", "content_hash"))
    made = first.select("source_id", "content_hash", (F.coalesce("_had", F.lit(0)) + number).alias("version"), F.lit("draft").alias("status"))
    return made if existing is None else existing.select("source_id", "content_hash", "version", "status").unionByName(made)


def latest_policy(policies: DataFrame) -> DataFrame:
    """The latest policy and the latest approved one of every source."""
    newest = lambda s: F.max_by("version", F.when(s, F.col("version")))
    return policies.groupBy("source_id").agg(
        newest(F.lit(True)).alias("latest_version"),
        newest(F.col("status") == "approved").alias("approved_version"),
    )


def schedulable(manifests: DataFrame, sources: DataFrame, policies: DataFrame) -> DataFrame:
    """The manifests whose source is there and active and has an approved policy."""
    active = sources.filter("active").select("slug", "source_id")
    approved = policies.filter("status = 'approved'").select("source_id")
    return manifests.join(active.join(approved, "source_id", "left_semi").select("slug"), "slug", "left_semi")
