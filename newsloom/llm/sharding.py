"""Sharding by proportional stratified interleaving.

Rows are shuffled by a seeded digest inside each source, rank r of n becomes the fraction
(2r + 1) / 2n, all rows are sorted by that fraction and the sequence is cut into equal counts, so
every shard holds every source in the proportion of the whole table.

Defined results: a null doc_id is one of its own, and rows are shuffled by id and text; a null source is a source of its own; a null text has size 1 and the digest of
the empty text; identical repeated rows are interchangeable and each gets a slot; extra columns are
not read; an empty table gives no rows. Groups of equal texts are not held together: a shard is a sample of
the mixture, and ``text_group`` (a digest) tells which rows have equal texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import key_of, materialise, rank_in_group, rank_overall


def ranked(docs: DataFrame, payload: list[Column], *, shards: int, seed: str, buckets: int) -> DataFrame:
    """``payload``, size, text_crc32, text_group, source, shard and slot of every row."""
    if not 1 <= buckets <= 65536:
        raise ValueError("buckets must be from 1 to 65536")
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        *payload,
        F.col("doc_id").alias("_id"),
        F.col("source").alias("_of_source"),
        key_of("source").alias("_source"),
        (F.octet_length(text) + 1).cast("long").alias("_size"),
        F.crc32(text).alias("_crc"),
        F.md5(text).alias("_group"),
        # By id and text: rows without an id, or of one id, do not crowd one bucket.
        F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.md5(text))).alias("_u"),
    ).withColumn("_bucket", F.floor(F.conv(F.substring("_u", 1, 8), 16, 10).cast("double") / 2**32 * buckets).cast("int"))
    order = [F.col("_u"), F.col("_id"), F.col("_crc"), F.col("_size")]
    inside = rank_in_group(rows, ["_source"], "_bucket", order, "_rank", "_of")
    fraction = (2 * F.col("_rank") + 1).cast("double") / (2 * F.col("_of")).cast("double")
    placed = rank_overall(
        materialise(inside.withColumn("_at", fraction).drop("_bucket", "_rank", "_of")),
        [F.col("_at"), F.col("_source"), *order],
        "_pos",
        "_all",
    )
    shard = F.expr(f"(_pos * {shards}) div _all")
    return placed.withColumn("_shard", shard).withColumn("_slot", F.expr(f"_pos - (_shard * _all + {shards - 1}) div {shards}"))


def assign_shards(docs: DataFrame, *, shards: int = 8, seed: str = "shard-1", buckets: int = 4096) -> DataFrame:
    """doc_id, size, text_crc32, law ('rows'), shard, slot, grown_shard, source and text_group for every row.

    ``buckets`` cuts the sort of a source: no task sorts more than about rows / buckets of one at once. The
    sort of the whole is cut at sampled places. At most 65,536.
    """
    return ranked(docs, [], shards=shards, seed=seed, buckets=buckets).select(
        F.col("_id").alias("doc_id"),
        F.col("_size").alias("size"),
        F.col("_crc").alias("text_crc32"),
        F.lit("rows").alias("law"),
        F.col("_shard").cast("int").alias("shard"),
        F.col("_slot").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        F.col("_of_source").alias("source"),
        F.col("_group").alias("text_group"),
    )


def write_shards(docs: DataFrame, path: str, *, shards: int = 8, seed: str = "shard-1", buckets: int = 4096) -> None:
    """Write every row of ``docs``, with all its columns in a struct ``row``, under shard=N folders, each in
    slot order. Rows carry themselves through the ranking, so ids may repeat or be null."""
    placed = ranked(docs, [F.struct(*docs.columns).alias("row")], shards=shards, seed=seed, buckets=buckets)
    (
        placed.select("row", F.col("_shard").cast("int").alias("shard"), F.col("_slot").alias("slot"))
        .repartitionByRange(shards * 4, "shard", "slot")
        .sortWithinPartitions("shard", "slot")
        .write.partitionBy("shard")
        .parquet(path)
    )
