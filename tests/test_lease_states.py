"""Leases as keyed state: the batch fold's slots, cycles, expiry, and a state that forgets."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from newsloom.operators import slots
from newsloom.plans.operations_queries import lease_events
from newsloom.streaming import hourly, leases

START = datetime(2026, 8, 1)
EVENTS = "source_id long, at timestamp, seq long, action string, slot_at timestamp, run_id long, cycle_id long"


def run(spark, tmp_path, batches, **how):
    """The changes of a stream that gets one file for each batch, and the rows of state after each."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/events")
        if i == 0:
            source = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/events")
    with leases.keyed_state(spark):
        query = (
            leases.lease_changes(source, **how)
            .writeStream.outputMode("update")
            .option("checkpointLocation", f"{tmp_path}/checkpoint")
            .foreachBatch(lambda rows, n: rows.write.mode("overwrite").parquet(f"{tmp_path}/out/_batch={n}"))
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
    assert spark.conf.get(leases.keyed_state.NAME, None) != leases.ROCKS
    kept = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    return spark.read.parquet(f"{tmp_path}/out"), kept


def test_equals_the_batch_fold(spark):
    folder = "/root/testdata/sf0.001"
    events = lease_events(hourly.read_stream(spark, f"{folder}/events.parquet")).withColumn("cycle_id", F.lit(None).cast("long"))
    with leases.keyed_state(spark):
        changes = hourly.run_to_table(spark, leases.lease_changes(events, keep_hours=10**6), "update")
    state = F.struct("status", "attempts", "claimed_at", "lease_expires_at", "finished_at", "run_id")
    last = changes.filter("event <> 'expired'").groupBy("source_id", "slot_at").agg(F.max_by(state, F.struct("attempts", "finished_at")).alias("l")).select("source_id", "slot_at", "l.*")
    want = slots.fold(lease_events(spark.read.parquet(f"{folder}/events.parquet"))).select(last.columns)
    assert last.count() == want.count() > 100 and last.exceptAll(want).count() == 0


def test_cycles(spark, tmp_path):
    at = lambda m: START + timedelta(minutes=m)
    slot, other = START, START + timedelta(hours=1)
    rows = [
        (1, at(1), 0, "claim", slot, None, None),  # without a cycle
        (1, at(2), 1, "failed", slot, None, None),
        (1, at(3), 2, "claim", slot, None, 5),  # the cycle is attached
        (1, at(4), 3, "claim", other, None, 5),  # the source has a live lease
        (1, at(5), 4, "claim", slot, None, 6),  # another cycle
        (1, at(6), 5, "succeeded", slot, None, None),  # no run
        (1, at(7), 6, "succeeded", slot, 70, None),
        (1, at(8), 7, "claim", slot, None, 5),  # it has succeeded
        (1, at(9), 8, "claim", other, None, 5),
        (2, at(9), 9, "claim", other, None, 9),
    ]
    changes, _ = run(spark, tmp_path, [rows])
    got = [(r.source_id, r.slot_at, r.event, r.attempts, r.cycle_id, r.run_id) for r in changes.orderBy("source_id", "slot_at", "attempts", "finished_at").collect()]
    assert sorted(got, key=str) == sorted([
        (1, slot, "claimed", 1, None, None), (1, slot, "failed", 1, None, None), (1, slot, "claimed", 2, 5, None), (1, slot, leases.FOREIGN, 2, 5, None),
        (1, slot, "succeeded", 2, 5, 70), (1, other, "claimed", 1, 5, None), (2, other, "claimed", 1, 9, None),
    ], key=str)
    assert [r.cycle_id for r in leases.refreshed_cycles(changes).collect()] == [5]


def test_state_forgets_and_leases_expire(spark, tmp_path):
    """Ten days of hourly slots in a file a day: what is kept are the slots of about a day, and a lease without an end expires."""
    batches = []
    for day in range(10):
        rows = []
        for hour in range(24):
            slot = START + timedelta(days=day, hours=hour)
            rows.append((1, slot + timedelta(minutes=1), 2 * hour, "claim", slot, None, None))
            if (day, hour) != (2, 5):
                rows.append((1, slot + timedelta(minutes=9), 2 * hour + 1, "succeeded", slot, hour, None))
        batches.append(rows)
    changes, kept = run(spark, tmp_path, batches, lease_seconds=1800, keep_hours=24)
    told = {r.event: r["count"] for r in changes.groupBy("event").count().collect()}
    assert told == {"claimed": 240, "succeeded": 239, "expired": 1}
    assert changes.filter("event = 'expired'").first().slot_at == START + timedelta(days=2, hours=5)
    assert max(kept) < 2.5 * 24 * 3 and kept[-1] <= kept[3] + 10


def test_sources_share_states_and_are_judged_alone(spark, tmp_path):
    """640 sources in ten states (one each before); a neighbour's receipts neither end nor prolong a lease; null sources and times as in the fold."""
    at = lambda m: START + timedelta(minutes=m)
    claims = [(i, at(i % 60), i, "claim", START, i) for i in range(640)]
    odd = [(None, at(1), 700, "claim", START, 7), (None, at(2), 701, "failed", START, None), (5, None, 702, "claim", at(60), 8)]
    later = [(7, at(200), 800, "succeeded", START, 9), (8, at(200), 801, "succeeded", START, None), (7, at(201), 802, "claim", at(180), None)]
    schema = EVENTS.rpartition(",")[0]
    for rows in (claims + odd, later):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/events")
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/events")
    query = (
        hourly.lease_stream(source)
        .writeStream.outputMode("update")
        .option("checkpointLocation", f"{tmp_path}/checkpoint")
        .foreachBatch(lambda rows, n: rows.write.mode("overwrite").parquet(f"{tmp_path}/out/_batch={n}"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress) == 11
    got = {(r.source_id, r.slot_at): r for r in hourly.latest_slots(spark.read.parquet(f"{tmp_path}/out")).collect()}
    want = {(r.source_id, r.slot_at): r for r in slots.fold(spark.read.parquet(f"{tmp_path}/events")).collect()}
    assert set(got) == set(want) and len(got) == 643
    live = {k for k, r in got.items() if r.status == "claimed"}
    assert live == {(7, at(180)), (5, at(60))}  # the first is new, the second has no end
    for k, r in got.items():
        assert r == want[k] if k in live or want[k].status != "claimed" else r.asDict() == want[k].asDict() | {"status": "expired"}
    assert got[7, START].run_id == 9 and got[None, START].status == "failed" and got[5, at(60)].lease_expires_at is None
