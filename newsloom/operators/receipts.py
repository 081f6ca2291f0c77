"""Hourly receipts: missing hours, overlaps of neighbouring slots, status by source, the soak verdict."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def hours(rows: DataFrame, at: str) -> DataFrame:
    """slot_at, receipts and sources of each hour that has receipts."""
    return rows.groupBy(F.date_trunc("hour", at).alias("slot_at")).agg(
        F.count(F.lit(1)).alias("receipts"),
        F.countDistinct("source_id").alias("sources"),
    )


def missing_hours(found: DataFrame, n: int) -> DataFrame:
    """Hours of the last ``n`` up to the latest one without receipts."""
    ends = found.agg(F.max("slot_at").alias("last"))
    expected = ends.select(F.explode(F.expr(f"sequence(last - make_interval(0, 0, 0, 0, {n - 1}), last, interval 1 hour)")).alias("slot_at"))
    return expected.join(found, "slot_at", "left_anti")


def overlaps(slots: DataFrame) -> DataFrame:
    """Neighbouring slots of a source of which the earlier ends after the later begins.

    slots: slot_id, source_id, claimed_at, finished_at. Only neighbours are compared, so a long slot
    over two later ones is reported once; ties are ordered by slot_id.
    """
    along = Window.partitionBy("source_id").orderBy("claimed_at", "slot_id")
    paired = slots.filter("finished_at IS NOT NULL").withColumns(
        {"next_id": F.lead("slot_id").over(along), "next_claimed": F.lead("claimed_at").over(along)}
    )
    return paired.filter("finished_at > next_claimed").select("source_id", "slot_id", "next_id")


def source_status(runs: DataFrame) -> DataFrame:
    """runs: source_id, status. Succeeded and failed runs of each source."""
    return runs.groupBy("source_id").agg(
        F.count_if(F.col("status") == "succeeded").alias("succeeded"),
        F.count_if(F.col("status") == "failed").alias("failed"),
    )


def issues(missing: DataFrame, overlapping: DataFrame, duplicates: DataFrame) -> DataFrame:
    """code and detail of every issue; the soak passed when there is none."""
    return (
        missing.select(F.lit("missing_cycle").alias("code"), F.date_format("slot_at", "yyyy-MM-dd HH:mm").alias("detail"))
        .unionByName(overlapping.select(F.lit("source_overlap").alias("code"), F.concat_ws(":", "source_id", "slot_id", "next_id").alias("detail")))
        .unionByName(duplicates.select(F.lit("duplicate_document").alias("code"), F.concat_ws(":", "source_id", "url").alias("detail")))
    )
