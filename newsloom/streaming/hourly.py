"""Streams of receipts: hourly counts, slots delivered once, the gate over a stream, and leases with timers.

Every ``run_*`` reads what is there with a stream of its own, writes a table below the cluster's checkpoint
folder, and reads that table; the stream's own checkpoint lies beside it. Nothing is kept on the driver.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.slots import IN_MICROS, NO_TIME, STATE, Source, in_micros, replay, states, with_times
from ..sources.tables import shared_folder


def work_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/{uuid.uuid4()}"


def read_stream(spark: SparkSession, path: str) -> DataFrame:
    """A stream over a Parquet table: a folder as Spark writes it, or a single file."""
    schema = spark.read.parquet(path).schema
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    source = spark.readStream.schema(schema)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isFile():  # a stream reads folders only
        return source.option("pathGlobFilter", at.getName()).parquet(at.getParent().toString())
    return source.parquet(path)


def run_to_table(spark: SparkSession, rows: DataFrame, mode: str) -> DataFrame:
    """What ``rows`` (a stream) gives for the data that is there, as a table. In complete mode each batch
    replaces the table; in append and update mode it is added with its number in ``_batch``."""
    folder = work_folder(spark)
    schema = rows.schema

    def put(batch: DataFrame, number: int) -> None:
        if mode == "complete":
            batch.write.mode("overwrite").parquet(f"{folder}/table")
        else:  # a batch that runs again replaces itself
            batch.write.mode("overwrite").parquet(f"{folder}/table/_batch={number}")

    query = rows.writeStream.outputMode(mode).foreachBatch(put).option(
        "checkpointLocation",
        f"{folder}/checkpoint",
    ).trigger(availableNow=True).start()
    query.awaitTermination()
    if not query.recentProgress:
        return spark.createDataFrame([], schema)
    return spark.read.option("basePath", f"{folder}/table").parquet(f"{folder}/table")


def hourly_counts(rows: DataFrame, at: str = "ts", kind: str = "event_type", late: str = "2 hours") -> DataFrame:
    """Receipts by hour and kind; works on batch and streaming frames (NTZ times are taken as UTC)."""
    timed = rows.withColumn("_at", F.col(at).cast("timestamp"))
    timed = timed.withWatermark("_at", late) if rows.isStreaming else timed
    return timed.groupBy(F.window("_at", "1 hour").alias("w"), kind).agg(F.count(F.lit(1)).alias("n")).select(
        F.col("w.start").alias("hour"),
        kind,
        "n",
    )


def run_hourly(spark: SparkSession, path: str) -> DataFrame:
    return run_to_table(spark, hourly_counts(read_stream(spark, path)), "complete")


def delivered_once(receipts: DataFrame, late: str = "31 days") -> DataFrame:
    """One row of each (source_id, slot_at): a slot that is delivered again within ``late`` is dropped."""
    return receipts.withWatermark("at", late).dropDuplicatesWithinWatermark(["source_id", "slot_at"])


def late_rows(everything: DataFrame, delivered: DataFrame, key: list[str]) -> DataFrame:
    """The back-fill of what came after the watermark: rows whose key is not among the delivered ones."""
    return everything.join(delivered.select(*key).distinct(), key, "left_anti")


def gate_stream(candidates: DataFrame, known: DataFrame) -> DataFrame:
    """The stream's candidates (canonical_url, ...) with decision and reason against the known state, a static table."""
    state = known.select("canonical_url", F.lit(True).alias("_known"))
    reason = F.when(F.col("canonical_url").isNull(), "invalid_url").when(F.col("_known").isNull(), "unseen").otherwise("known_unchanged")
    return candidates.join(state, "canonical_url", "left").withColumn("reason", reason).withColumn(
        "decision",
        F.when(F.col("reason") == "unseen", "fetch").otherwise("skip"),
    ).drop("_known")


#: In a group's text a slot is the list of its key and these.
KEPT = [f.split()[0] for f in STATE.split(", ")][2:]
#: What stands for null in an integer column on its way to pandas.
NULL = -(1 << 63)


def _pack(held: dict[int | None, tuple[Source, int | None]]) -> str:
    slots = [[source_id, timer, [[at, *(s[n] for n in KEPT)] for at, s in source.slots.items()]] for source_id, (source, timer) in held.items()]
    return json.dumps(slots, separators=(",", ":"))


def _unpack(text: str) -> dict[int | None, tuple[Source, int | None]]:
    return {
        source_id: (Source({at: dict(zip(KEPT, s, strict=True)) for at, *s in slots}), timer) for source_id, timer, slots in json.loads(text)
    }


def _by_source(rows: pd.DataFrame) -> Iterator[tuple[int, Iterator[tuple]]]:
    """(source, its events in order) of a group's rows."""
    rows = rows.iloc[np.lexsort((rows["seq"], rows["micros"], rows["source_id"]))]
    source = rows["source_id"].to_numpy()
    cuts = [0, *(np.flatnonzero(source[1:] != source[:-1]) + 1).tolist(), len(source)]
    for start, stop in pairwise(cuts):
        part = rows.iloc[start:stop]
        at, slot_at, run_id = (
            [other if v == NULL else v for v in part[n].tolist()] for n, other in (("micros", NO_TIME), ("slot_at", None), ("run_id", None))
        )
        yield int(source[start]), zip(at, part["action"].tolist(), slot_at, run_id, strict=True)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    """Rows of IN_MICROS."""
    kinds = {"long": "Int64", "int": "Int32", "string": "object"}
    named = [f.split() for f in IN_MICROS.split(", ")]
    columns = zip(*rows, strict=True) if rows else [()] * len(named)
    return pd.DataFrame({n: pd.array(list(c), dtype=kinds[kind]) for (n, kind), c in zip(named, columns, strict=True)})


def lease_stream(events: DataFrame, lease_seconds: int = 3600, late: str = "1 hour", together: int = 64) -> DataFrame:
    """The changed slots of every source after each batch of ``events`` (as for ``operators.slots.fold``).

    The slots of up to ``together`` sources with neighbouring ids are one state, as a call for a state costs
    as much as hundreds of events; each source is judged alone. A source's timer stands at the end of its earliest live
    lease, in the time of the events, and a state's at the earliest of its sources': when the watermark has passed it,
    slots whose lease is over come out with status ``expired`` (they can be claimed again). A timer in processing time
    would keep a stream over given data from ever ending.
    """
    lease = lease_seconds * 1_000_000

    def timer(source: Source, now: int) -> int | None:
        ends = [s["lease_expires_at"] for s in source.slots.values() if s["status"] == "claimed" and s["lease_expires_at"] > now * 1000]
        return min(ends) // 1000 + 1 if ends else None

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = _unpack(state.get[0]) if state.exists else {}
        now = state.getCurrentWatermarkMs()
        made, told = [], set()
        for number, of_source in () if state.hasTimedOut else _by_source(pd.concat(list(batches))):
            source_id = None if pd.isna(key[0]) else number
            source, _ = held.get(source_id) or (Source(), None)
            changed = replay(source, of_source, lease)
            made += states(source_id, {at: source.slots[at] for at in changed})
            told.add(source_id)
            held[source_id] = source, timer(source, now)
        for source_id, (source, ends) in held.items():
            if source_id not in told and ends is not None and ends < now:
                over = {at: s for at, s in source.slots.items() if s["status"] == "claimed" and s["lease_expires_at"] <= now * 1000}
                made += states(source_id, {at: {**s, "status": "expired"} for at, s in over.items()})
                held[source_id] = source, timer(source, now)
        state.update((_pack(held),))
        timers = [ends for _, ends in held.values() if ends is not None]
        if timers:
            state.setTimeoutTimestamp(min(timers))
        yield _frame(made)

    or_null = lambda c: F.coalesce(c, F.lit(NULL))
    timed = events.withWatermark("at", late).select(
        F.expr(f"source_id div {together}").alias("sources"),
        "at",
        or_null(F.col("source_id")).alias("source_id"),
        or_null(in_micros("at")).alias("micros"),
        or_null(F.col("seq")).alias("seq"),
        "action",
        or_null(in_micros("slot_at")).alias("slot_at"),
        or_null(F.col("run_id")).alias("run_id"),
    )
    grouped = timed.groupBy("sources")
    return with_times(grouped.applyInPandasWithState(step, IN_MICROS, "slots string", "update", GroupStateTimeout.EventTimeTimeout))


def latest_slots(changes: DataFrame) -> DataFrame:
    """The last state of each slot from a table of changes with their batch."""
    names = [f.split()[0] for f in STATE.split(", ")]
    last = changes.groupBy("source_id", "slot_at").agg(F.max_by(F.struct(*names[2:]), "_batch").alias("_l"))
    return last.select("source_id", "slot_at", "_l.*")
