"""Leases of source-hours: claims and finishes folded to states, cycles and their completion, and the soak report."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from datetime import datetime, timedelta
from itertools import groupby, islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TERMINAL = ("succeeded", "failed")
#: A lease lasts as long as the source's time-out and five minutes more.
GRACE_SECONDS = 300
STATE = "source_id long, slot_at timestamp, status string, attempts int, claimed_at timestamp, lease_expires_at timestamp, finished_at timestamp, run_id long"
#: In Python times are microseconds, as numbers are cheaper there than times of a calendar.
IN_MICROS = STATE.replace("timestamp", "long")
ARROW = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}
#: Neither before nor after any time.
NO_TIME = float("nan")
#: Slots that leave ``fold`` together.
MOST_ROWS = 5_000


def lease_end(claimed_at: Column, timeout_seconds: Column) -> Column:
    return claimed_at + F.make_dt_interval(secs=timeout_seconds + GRACE_SECONDS)


def is_live(status: Column, lease_expires_at: Column, now: Column) -> Column:
    return (status == "claimed") & (lease_expires_at > now)


class Source:
    """The slots of one source; events come in order of time.

    A claim is refused while its slot has succeeded or any slot of the source has a live lease; otherwise
    the slot is claimed anew. A finish counts only for a claimed slot. At most one lease is live at a time, so a
    claim looks at the last one only, however many slots there are. Times are datetimes, or numbers of one unit.
    """

    def __init__(self, slots: dict | None = None):
        self.slots = slots or {}
        claimed = [s for s in self.slots.values() if s["status"] == "claimed"]
        self.last = max(claimed, key=lambda s: s["lease_expires_at"], default=None)

    def claim(self, slot_at: datetime | int | None, now: datetime | float, lease: timedelta | int) -> bool:
        slot = self.slots.get(slot_at)
        busy = self.last is not None and self.last["status"] == "claimed" and self.last["lease_expires_at"] > now
        if busy or (slot and slot["status"] == "succeeded"):
            return False
        self.last = self.slots[slot_at] = {
            "status": "claimed", "attempts": (
                slot["attempts"] if slot else 0
            ) + 1, "claimed_at": now, "lease_expires_at": now + lease, "finished_at": None, "run_id": None,
        }
        return True

    def finish(self, slot_at: datetime | int | None, now: datetime | float, status: str, run_id: int | None) -> bool:
        slot = self.slots.get(slot_at)
        if not slot or slot["status"] != "claimed" or (status == "succeeded" and run_id is None):
            return False
        slot |= {"status": status, "finished_at": now, "run_id": run_id}
        return True


def replay(source: Source, events: Iterable[tuple], lease: int) -> set:
    """The slots of ``source`` that its next ``events`` (at, action, slot_at, run_id, in order) change."""
    changed = set()
    for at, action, slot_at, run_id in events:
        if source.claim(slot_at, at, lease) if action == "claim" else source.finish(slot_at, at, action, run_id):
            changed.add(slot_at)
    return changed


def states(source_id: int | None, slots: dict) -> Iterator[tuple]:
    """Rows of STATE with times in microseconds."""
    for slot_at, s in slots.items():
        times = (None if s[n] is None or s[n] != s[n] else s[n] for n in ("claimed_at", "lease_expires_at", "finished_at"))
        yield source_id, slot_at, s["status"], s["attempts"], *times, s["run_id"]


def in_micros(column: str) -> Column:
    return F.unix_micros(F.col(column).cast("timestamp"))


def with_times(rows: DataFrame) -> DataFrame:
    """STATE from IN_MICROS."""
    names = [f.split() for f in STATE.split(", ")]
    return rows.select(*[F.timestamp_micros(n).alias(n) if kind == "timestamp" else n for n, kind in names])


def fold(events: DataFrame, lease_seconds: int = 3600) -> DataFrame:
    """The slots of every source after its ``events`` (source_id, at, seq, action, slot_at, run_id).

    Events of a source are dealt to one partition and sorted there, and pass through one at a time in
    batches: what is held of a source are its slots, not its events. The slots of many sources leave
    together. action: claim, succeeded or failed. An event without a time comes first and sees no lease.
    """
    schema = pa.schema([(n, ARROW[kind]) for n, kind in (f.split() for f in IN_MICROS.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, current, source = [], None, Source()

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made, strict=True), schema, strict=True)], schema=schema)  # noqa: B023

        for rows in batches:
            columns = {n: rows.column(n).to_pylist() for n in ("at", "action", "slot_at", "run_id")}
            columns["at"] = [NO_TIME if at is None else at for at in columns["at"]]
            told = zip(*columns.values(), strict=True)
            for source_id, of_source in groupby(rows.column("source_id").to_pylist()):
                if source_id != current:
                    made += states(current, source.slots)
                    current, source = source_id, Source()
                    if len(made) >= MOST_ROWS:
                        yield batch()
                        made = []
                replay(source, islice(told, sum(1 for _ in of_source)), lease_seconds * 1_000_000)
        made += states(current, source.slots)
        if made:
            yield batch()

    dealt = events.select(
        "source_id",
        in_micros("at").alias("at"),
        "seq",
        "action",
        in_micros("slot_at").alias("slot_at"),
        "run_id",
    ).repartition("source_id").sortWithinPartitions("source_id", "at", "seq")
    return with_times(dealt.mapInArrow(run, IN_MICROS))


def cycles(requests: DataFrame) -> DataFrame:
    """The cycle of each hour from requests (at, source_slugs array): the first request fixes the expected
    sources, sorted and distinct; later ones with another set are counted as mismatches."""
    rows = requests.select(F.date_trunc("hour", "at").alias("slot_at"), "at", F.array_sort(F.array_distinct("source_slugs")).alias("slugs"))
    first = rows.groupBy("slot_at").agg(
        F.min("at").alias("dispatched_at"),
        F.min_by("slugs", F.struct("at", F.array_join("slugs", ","))).alias("expected"),
    )
    wrong = rows.join(first, "slot_at").groupBy("slot_at").agg(F.count_if(F.col("slugs") != F.col("expected")).alias("mismatches"))
    return first.join(wrong, "slot_at").withColumn("status", F.when(F.size("expected") == 0, "completed").otherwise("dispatching"))


def completed(expected: DataFrame, slots: DataFrame) -> DataFrame:
    """slot_at, expected, terminal (sorted distinct slugs of finished slots) and whether both are equal."""
    done = slots.filter(F.col("status").isin(*TERMINAL)).groupBy("slot_at").agg(F.array_sort(F.collect_set("slug")).alias("terminal"))
    both = expected.select("slot_at", "expected").join(done, "slot_at", "left").withColumn(
        "terminal",
        F.coalesce("terminal", F.array().cast("array<string>")),
    )
    return both.withColumn("completed", F.col("expected") == F.col("terminal"))


def soak_issues(expected_hours: DataFrame, cycles: DataFrame, slots: DataFrame, runs: DataFrame, duplicates: DataFrame) -> DataFrame:
    """code and detail of every issue of the expected hours.

    expected_hours: slot_at. cycles: slot_at, status, expected (array of slugs). slots: slot_id, slot_at,
    source_id, slug, status, claimed_at, finished_at, run_id. runs: run_id, source_id, status.
    duplicates: source_id, url, n.
    """
    hour = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm")
    found = expected_hours.join(cycles, "slot_at", "left")
    missing = found.filter("status IS NULL").select(F.lit("missing_cycle").alias("code"), hour("slot_at").alias("detail"))
    there = found.filter("status IS NOT NULL")
    open_cycles = there.filter("status <> 'completed'").select(
        F.lit("cycle_not_completed").alias("code"),
        F.concat_ws(":", hour("slot_at"), "status").alias("detail"),
    )
    within = slots.join(there.select("slot_at"), "slot_at", "left_semi")
    actual = within.groupBy("slot_at").agg(F.array_sort(F.collect_set("slug")).alias("actual"))
    compared = there.join(actual, "slot_at", "left").withColumn("actual", F.coalesce("actual", F.array().cast("array<string>")))
    receipts = compared.filter("actual <> expected").select(
        F.lit("source_receipt_mismatch").alias("code"), F.concat_ws(
            "|",
            hour("slot_at"),
            F.array_join("expected", ","),
            F.array_join("actual", ","),
        ).alias("detail")
    )
    claimed = within.filter("status = 'claimed'").select(
        F.lit("source_slot_not_terminal").alias("code"),
        F.col("slot_id").cast("string").alias("detail"),
    )
    # A failed slot without a run is no issue; any other finished slot needs a run of its source and status.
    ended = within.filter("status <> 'claimed' AND NOT (status = 'failed' AND run_id IS NULL)")
    run = runs.select("run_id", F.col("source_id").alias("_of"), F.col("status").alias("_status"))
    fits = F.col("_of").eqNullSafe(F.col("source_id")) & F.col("_status").eqNullSafe(F.col("status"))
    mismatched = ended.join(run, "run_id", "left").filter(~fits)
    mismatched = mismatched.select(
        F.lit("collection_run_mismatch").alias("code"),
        F.concat_ws(":", "slot_id", "status", F.coalesce("_status", F.lit("none"))).alias("detail"),
    )
    along = Window.partitionBy("source_id").orderBy("claimed_at", "slot_id")
    finished = slots.join(expected_hours, "slot_at", "left_semi").filter("finished_at IS NOT NULL")
    pairs = finished.withColumns(
        {"next_id": F.lead("slot_id").over(along), "next_claimed": F.lead("claimed_at").over(along)}
    ).filter("finished_at > next_claimed")
    overlaps = pairs.select(F.lit("overlapping_source_runs").alias("code"), F.concat_ws(":", "source_id", "slot_id", "next_id").alias("detail"))
    twice = duplicates.select(F.lit("duplicate_canonical_document").alias("code"), F.concat_ws(":", "source_id", "url", "n").alias("detail"))
    every = missing
    for more in (open_cycles, receipts, claimed, mismatched, overlaps, twice):
        every = every.unionByName(more)
    return every


def soak_verdict(expected_hours: DataFrame, cycles: DataFrame, issues: DataFrame) -> DataFrame:
    """One row: hours, first and last hour, cycles found, number of issues, and whether there is none."""
    span = expected_hours.agg(F.count(F.lit(1)).alias("hours"), F.min("slot_at").alias("starts_at"), F.max("slot_at").alias("ends_at"))
    found = expected_hours.join(cycles.select("slot_at").distinct(), "slot_at", "left_semi").agg(F.count(F.lit(1)).alias("cycles_found"))
    counted = issues.agg(F.count(F.lit(1)).alias("issues"))
    one = span.crossJoin(found).crossJoin(counted)  # one row each
    return one.withColumn("passed", F.col("issues") == 0)
