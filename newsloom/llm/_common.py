"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import functools
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables: the one that the cluster names in ``spark.checkpoint.dir``. A
    private one is made only where that setting is absent (local tests); a cluster must name one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    return sc.getCheckpointDir()


def materialise(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` with a reliable checkpoint in the shared folder. Its files go when nothing
    refers to them any more (``spark.cleaner.referenceTracking.cleanCheckpoints``)."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


class Stored:
    """Intermediate tables of one job, as Parquet in the shared folder.

    Unlike a checkpoint a table is compressed, is read by column, and keeps none of the constraints that
    the optimizer has inferred, whose number grows from round to round of a loop. ``drop`` removes tables
    once later ones have been written from them; what the result reads stays.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.folder = spark, f"{shared_folder(spark)}/{uuid.uuid4()}"

    def put(self, name: str, df: DataFrame) -> DataFrame:
        df.write.parquet(f"{self.folder}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.folder}/{name}")

    def drop(self, *names: str) -> None:
        for name in names:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def text_blocks(column: pa.Array, most: int) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) of runs of rows with ``most`` characters together at most (a longer text is alone),
    so that only one run at a time stands in memory as Python strings; null is ''."""
    ends = np.cumsum(pc.fill_null(pc.utf8_length(column), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    start = 0
    while start < len(ends):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield start, [t or "" for t in column.slice(start, stop - start).to_pylist()]
        start = stop


def give_back() -> None:
    """What this process has freed goes back to the system, where its C library can be asked to (glibc's can)."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def giving_back(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, a function for ``mapInArrow``, that leaves little memory behind: Python workers stay for later tasks and
    stages, and would keep the most that they ever took beside an executor's own memory."""

    @functools.wraps(run)
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return whole


#: Rows of a materialised table (a few short columns) that may be broadcast: some 50 MB.
MOST_BROADCAST = 500_000


def broadcast_if_small(table: DataFrame, most_rows: int = MOST_BROADCAST) -> DataFrame:
    """``table``, which must be materialised, marked for a broadcast if it has no more than ``most_rows``
    rows; beyond, it is joined by a shuffle."""
    return F.broadcast(table) if table.limit(most_rows + 1).count() <= most_rows else table


def key_of(column: str) -> Column:
    """A non-null string key for a nullable column: null and '' stay apart."""
    return F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit(""))


def with_row_id(df: DataFrame, name: str = "_row") -> DataFrame:
    """A row identity that does not rely on doc_id being unique; materialise before using it twice."""
    return df.withColumn(name, F.monotonically_increasing_id())


def text_digest(text: Column) -> Column:
    """SHA-256 of a text, null as empty: with doc_id the identity of a row whose decision is looked up later."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def rows_kept(docs: DataFrame, judged: DataFrame, doc_id: Column) -> DataFrame:
    """The rows of ``docs`` that ``judged`` (doc_id, text_digest, kept; one row per row of ``docs``) keeps.

    Rows are found again by doc_id (null is a value) and digest, as row numbers need not be the same in a
    second run over ``docs``. Rows equal in both are one group of ``judged``: if it is kept, one of them
    stays, the least in its other columns.
    """
    found = judged.groupBy("doc_id", "text_digest").agg(F.count(F.lit(1)).alias("n"), F.bool_or("kept").alias("kept")).filter("n > 1 OR NOT kept")
    apart = materialise(found.select(F.col("doc_id").alias("_apart_id"), F.col("text_digest").alias("_apart_digest"), "kept"))
    digest = text_digest(F.col("text"))
    same = doc_id.eqNullSafe(F.col("_apart_id")) & (digest == F.col("_apart_digest"))
    apart = broadcast_if_small(apart)  # few rows: texts need not be shuffled
    single = docs.join(apart.select("_apart_id", "_apart_digest"), same, "left_anti").select(*docs.columns)
    if not apart.filter("kept").limit(1).count():
        return single
    repeated = docs.join(apart.filter("kept").select("_apart_id", "_apart_digest"), same, "left_semi")
    order = F.struct(*[c for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind])
    one = repeated.groupBy(doc_id.alias("_id"), digest.alias("_digest")).agg(F.min_by(F.struct(*docs.columns), order).alias("_kept"))
    return single.unionByName(one.select("_kept.*"))


def rank_in_group(rows: DataFrame, group: list[str], bucket: str, order: list[Column], rank: str, total: str) -> DataFrame:
    """0-based ``rank`` and group size ``total`` without putting a whole group into one task.

    ``bucket`` must not decrease along ``order``. Rows are numbered inside (group, bucket) and the
    counts of the earlier buckets are added, so a group holding a third of the table is cut into as
    many pieces as it has buckets. Only the counts (one row per group and bucket) see a whole group.
    """
    before = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    counts = (
        rows.groupBy(*group, bucket)
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .withColumn(total, F.sum("_n").over(Window.partitionBy(*group)))
        .drop("_n")
    )
    inside = F.row_number().over(Window.partitionBy(*group, bucket).orderBy(*order))
    return (
        rows.withColumn("_inside", inside)
        .join(counts, [*group, bucket])
        .withColumn(rank, F.col("_before") + F.col("_inside") - 1)
        .drop("_inside", "_before")
    )


def rank_overall(rows: DataFrame, order: list[Column], rank: str, total: str) -> DataFrame:
    """0-based ``rank`` along ``order`` (a total order) and the number of rows, without a window over the table.

    ``rows`` (materialised, as its ranges are sampled first) are dealt by sampled ranges of the whole order,
    so that ties in its first columns do not crowd one task, and numbered inside each range; only the
    ranges' counts, one row for each partition, are summed up and broadcast.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    numbered = materialise(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id()))
    numbered = numbered.withColumns(
        {"_range": F.shiftright("_place", 33), "_inside": F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))}
    ).drop("_place")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    offsets = (
        numbered.groupBy("_range")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy()).alias(total))
    )
    return numbered.join(F.broadcast(offsets), "_range").withColumn(rank, F.col("_before") + F.col("_inside")).drop("_range", "_inside", "_before")
