"""Leases of source-hours as keyed state with timers: one map entry for a slot, one value for a source's live lease.

A claim reads its own slot and the source's last lease, never the other slots. Events of a key come in order of time
within a batch; the watermark decides what is late. A timer at the end of a lease reports the slot as expired
(it can be claimed again); a timer ``keep`` after a slot's end forgets it, so that the state of a source holds the
slots of that time only, however long the stream runs. Slots that are older than that at a claim are refused.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import UTC, datetime, timedelta

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.streaming import StatefulProcessor

from ..operators.slots import TERMINAL

VALUE = "status string, attempts int, claimed_at timestamp, lease_expires_at timestamp, finished_at timestamp, run_id long, cycle_id long"
OUT = f"source_id long, slot_at timestamp, {VALUE}, event string"
NAMES = [f.split()[0] for f in VALUE.split(", ")]
#: The store that keeps keyed state on disk; transformWithState needs it.
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
FOREIGN = "slot belongs to another collection cycle"


def millis(at: datetime) -> int:
    return int(at.replace(tzinfo=UTC).timestamp() * 1000)


def naive(at: object) -> datetime | None:
    return None if at is None else at.replace(tzinfo=None)


class Leases(StatefulProcessor):
    """Events (source_id, at, seq, action, slot_at, run_id, cycle_id): claim, succeeded or failed."""

    def __init__(self, lease: timedelta, keep: timedelta):
        self.lease, self.keep = lease, keep

    def init(self, handle) -> None:
        self.handle = handle
        self.slots = handle.getMapState("slots", "slot_at timestamp", VALUE)
        self.last = handle.getValueState("last", "slot_at timestamp")

    def read(self, value: tuple) -> dict:
        return {k: naive(v) if k.endswith("_at") else v for k, v in zip(NAMES, value, strict=True)}

    def slot(self, slot_at: datetime) -> dict | None:
        value = self.slots.getValue((slot_at,))
        return None if value is None else self.read(value)

    def put(self, slot_at: datetime, slot: dict) -> None:
        self.slots.updateValue((slot_at,), tuple(slot[n] for n in NAMES))

    def busy(self, now: datetime) -> bool:
        last = self.last.get()
        other = None if last is None else self.slot(naive(last[0]))
        return other is not None and other["status"] == "claimed" and other["lease_expires_at"] > now

    def claim(self, slot_at: datetime, now: datetime, cycle: int | None) -> tuple[dict, str] | None:
        slot = self.slot(slot_at)
        if slot and cycle is not None and slot["cycle_id"] not in (None, cycle):
            return slot, FOREIGN
        if (slot and slot["status"] == "succeeded") or self.busy(now):
            return None
        made = {"status": "claimed", "attempts": (slot["attempts"] if slot else 0) + 1, "claimed_at": now, "lease_expires_at": now + self.lease, "finished_at": None, "run_id": None}
        made["cycle_id"] = cycle if slot is None or slot["cycle_id"] is None else slot["cycle_id"]
        self.put(slot_at, made)
        self.last.update((slot_at,))
        self.handle.registerTimer(millis(made["lease_expires_at"]))
        return made, "claimed"

    def finish(self, slot_at: datetime, now: datetime, status: str, run_id: int | None) -> tuple[dict, str] | None:
        slot = self.slot(slot_at)
        if not slot or slot["status"] != "claimed" or (status == "succeeded" and run_id is None):
            return None
        made = {**slot, "status": status, "finished_at": now, "run_id": run_id}
        self.put(slot_at, made)
        self.handle.registerTimer(millis(now + self.keep))
        return made, status

    def row(self, key: tuple, slot_at: datetime, slot: dict, event: str) -> Row:
        return Row(source_id=key[0], slot_at=slot_at, **slot, event=event)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        oldest = datetime.fromtimestamp(max(0, timerValues.getCurrentWatermarkInMs()) / 1000, UTC).replace(tzinfo=None) - self.keep
        for e in sorted(rows, key=lambda e: (e["at"], e["seq"])):
            slot_at, at = naive(e["slot_at"]), naive(e["at"])
            if e["action"] in TERMINAL:
                found = self.finish(slot_at, at, e["action"], e["run_id"])
            else:
                found = None if slot_at < oldest else self.claim(slot_at, at, e["cycle_id"])
            if found:
                yield self.row(key, slot_at, *found)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = datetime.fromtimestamp(expiredTimerInfo.getExpiryTimeInMs() / 1000, UTC).replace(tzinfo=None)
        made, gone = [], []
        for (slot_at,), value in self.slots.iterator():
            slot_at, slot = naive(slot_at), self.read(value)
            if slot["status"] == "claimed" and slot["lease_expires_at"] == now:
                made.append(self.row(key, slot_at, {**slot, "status": "expired"}, "expired"))
                self.handle.registerTimer(millis(now + self.keep))
            if (slot["finished_at"] or slot["lease_expires_at"]) + self.keep <= now:
                gone.append(slot_at)
        for slot_at in gone:
            self.slots.removeKey((slot_at,))
        yield from made

    def close(self) -> None:
        pass


def lease_changes(events: DataFrame, *, lease_seconds: int = 3600, keep_hours: int = 48, late: str = "1 hour") -> DataFrame:
    """Every change of a slot in a stream of ``events``, with its event: claimed, succeeded, failed, expired, or the
    refusal of a claim for another cycle."""
    processor = Leases(timedelta(seconds=lease_seconds), timedelta(hours=keep_hours))
    timed = events.withWatermark("at", late)
    return timed.groupBy("source_id").transformWithState(statefulProcessor=processor, outputStructType=OUT, outputMode="Update", timeMode="EventTime")


def refreshed_cycles(changes: DataFrame) -> DataFrame:
    """The cycles (cycle_id) whose completion has to be told anew after ``changes``: those of finished slots."""
    return changes.filter(changes["event"].isin(*TERMINAL)).select("cycle_id").dropna().distinct()


class keyed_state:
    """The session keeps keyed state on disk while a stream runs; then its setting is as before."""

    NAME = "spark.sql.streaming.stateStore.providerClass"

    def __init__(self, spark: SparkSession):
        self.spark, self.before = spark, spark.conf.get(self.NAME, None)

    def __enter__(self) -> None:
        self.spark.conf.set(self.NAME, ROCKS)

    def __exit__(self, *_: object) -> None:
        self.spark.conf.unset(self.NAME) if self.before is None else self.spark.conf.set(self.NAME, self.before)
