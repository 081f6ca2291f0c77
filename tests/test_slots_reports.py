"""Leases, the soak report, policies, manifests and reports: scripts with known ends, brute force, streams against batches."""

import json
import random
import shutil
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from newsloom.operators import manifests, policies, reports, slots
from newsloom.plans import operations_queries
from newsloom.streaming import hourly

T0 = datetime(2026, 8, 9, 12)
EVENTS = "source_id long, at timestamp, seq long, action string, slot_at timestamp, run_id long"


def minutes(n):
    return T0 + timedelta(minutes=n)


def test_lease_script(spark):
    """Claimed 12:05, refused at 12:15, claimed again after the lease, next hour blocked while live, done, refused."""
    script = [
        (1, minutes(5), 1, "claim", T0, None), (1, minutes(15), 2, "claim", T0, None), (1, minutes(66), 3, "claim", T0, None), (
            1,
            minutes(70),
            4,
            "claim",
            minutes(60),
            None,
        ),
        (1, minutes(80), 5, "succeeded", T0, 7), (1, minutes(81), 6, "claim", T0, None), (1, minutes(82), 7, "claim", minutes(60), None), (
            1,
            minutes(83),
            8,
            "failed",
            minutes(60),
            None,
        ), (2, minutes(5), 9, "failed", T0, 1),
    ]
    got = {r.slot_at: r for r in slots.fold(spark.createDataFrame(script, EVENTS)).collect()}
    assert set(got) == {T0, minutes(60)}
    assert (got[T0].status, got[T0].attempts, got[T0].run_id, got[T0].claimed_at, got[T0].finished_at) == (
        "succeeded",
        2,
        7,
        minutes(66),
        minutes(80),
    )
    assert (got[minutes(60)].status, got[minutes(60)].attempts, got[minutes(60)].run_id) == ("failed", 1, None)


def plain_fold(events):
    state = {}
    for source, at, _, action, slot_at, run in sorted(events, key=lambda e: (e[1], e[2])):
        slot = state.get((source, slot_at))
        if action == "claim":
            live = [s for (o, _), s in state.items() if o == source and s[0] == "claimed" and s[3] > at]
            if not live and not (slot and slot[0] == "succeeded"):
                state[source, slot_at] = ("claimed", (slot[1] if slot else 0) + 1, at, at + timedelta(hours=1), None, None)
        elif slot and slot[0] == "claimed" and not (action == "succeeded" and run is None):
            state[source, slot_at] = (action, slot[1], slot[2], slot[3], at, run)
    return {(o, at, *s) for (o, at), s in state.items()}


def test_fold_matches_plain_replay(spark):
    draw = random.Random(3)
    events = [
        (
            draw.randrange(4),
            minutes(draw.randrange(600)),
            i,
            draw.choice(["claim", "claim", "succeeded", "failed"]),
            minutes(60 * draw.randrange(5)),
            draw.choice([None, i]),
        ) for i in range(300)
    ]
    got = {tuple(r) for r in slots.fold(spark.createDataFrame(events, EVENTS)).collect()}
    assert got == plain_fold(events)


def test_stream_of_leases_ends_as_the_batch(spark):
    """The stream's last states are the fold's, but leases that the watermark has passed are expired."""
    sf = "/root/testdata/sf0.001"
    batch = {(r.source_id, r.slot_at): r for r in operations_queries.slot_claim_fold(spark, sf).collect()}
    got = {(r.source_id, r.slot_at): r for r in operations_queries.stream_leases(spark, sf).collect()}
    last = spark.read.parquet(f"{sf}/events.parquet").agg(F.max(F.col("ts").cast("timestamp"))).first()[0]
    assert set(got) == set(batch)
    for k, r in got.items():
        over = batch[k].status == "claimed" and batch[k].lease_expires_at <= last - timedelta(hours=1, seconds=1)
        assert r.status == "expired" if over else r.status in (batch[k].status, "expired") and r.attempts == batch[k].attempts


def test_streams_read_folders(spark, tmp_path):
    """A table as Spark writes it, in several files: no receipt is lost."""
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    for name in ("stream_hourly_counts", "stream_slots"):
        query = operations_queries.__dict__.get(name) or __import__("newsloom.plans.catalogue", fromlist=[name]).__dict__[name]
        whole, parts = (Counter(map(tuple, query(spark, folder).collect())) for folder in ("/root/testdata/sf0.001", str(tmp_path)))
        assert whole == parts and whole
    shutil.copytree(f"{tmp_path}/events.parquet", f"{tmp_path}/again.parquet")
    received = spark.createDataFrame([(1, T0, T0)], "source_id long, slot_at timestamp, at timestamp")
    later = received.unionByName(spark.createDataFrame([(1, minutes(60), T0)], received.schema))
    assert hourly.late_rows(later, received, ["source_id", "slot_at"]).first().slot_at == minutes(60)


def soak(spark, cycles, slot_rows, runs, hours=3):
    expected = spark.createDataFrame([(minutes(60 * i),) for i in range(hours)], "slot_at timestamp")
    c = spark.createDataFrame(cycles, "slot_at timestamp, status string, expected array<string>")
    s = spark.createDataFrame(
        slot_rows,
        "slot_id long, slot_at timestamp, source_id long, slug string, status string, claimed_at timestamp, finished_at timestamp, run_id long",
    )
    r = spark.createDataFrame(runs, "run_id long, source_id long, status string")
    issues = slots.soak_issues(expected, c, s, r, spark.createDataFrame([], "source_id long, url string, n long"))
    verdict = slots.soak_verdict(expected, c, issues).first()
    return Counter(i.code for i in issues.collect()), verdict


def test_soak(spark):
    slot = lambda i, status="succeeded", run=True: (
        i,
        minutes(60 * i),
        1,
        "a",
        status,
        minutes(60 * i + 7),
        None if status == "claimed" else minutes(60 * i + 9),
        i if run else None,
    )
    cycle = lambda i, status="completed", slugs=("a",): (minutes(60 * i), status, list(slugs))
    run = lambda i, status="succeeded", source=1: (i, source, status)
    issues, verdict = soak(spark, [cycle(i) for i in range(3)], [slot(i) for i in range(3)], [run(i) for i in range(3)])
    assert not issues and verdict.passed and verdict.cycles_found == 3 and verdict.hours == 3
    issues, verdict = soak(spark, [cycle(0), cycle(2, "running")], [slot(0), slot(2, "claimed")], [run(0)])
    assert issues == {"missing_cycle": 1, "cycle_not_completed": 1, "source_slot_not_terminal": 1} and not verdict.passed
    # A failed slot without a run is fine; one with another source's run, or a success without any, is not.
    issues, _ = soak(
        spark,
        [cycle(i) for i in range(3)],
        [slot(0, "failed", run=False), slot(1, "failed"), slot(2, run=False)],
        [run(1, "failed", source=2)],
    )
    assert issues == {"collection_run_mismatch": 2}
    issues, _ = soak(spark, [cycle(0, slugs=("a", "b")), cycle(1), cycle(2)], [slot(0), slot(1), slot(2)], [run(i) for i in range(3)])
    assert issues == {"source_receipt_mismatch": 1}
    long = (0, T0, 1, "a", "succeeded", T0, minutes(200), 0)
    issues, _ = soak(spark, [cycle(i) for i in range(3)], [long, slot(1), slot(2)], [run(i) for i in range(3)])
    assert issues == {"overlapping_source_runs": 1}  # neighbours only


def test_cycles(spark):
    asked = spark.createDataFrame(
        [(minutes(5), ["b", "a", "a"]), (minutes(9), ["a", "b"]), (minutes(30), ["c"]), (minutes(61), [])],
        "at timestamp, source_slugs array<string>",
    )
    got = {r.slot_at: r for r in slots.cycles(asked).collect()}
    assert (got[T0].expected, got[T0].mismatches, got[T0].status) == (["a", "b"], 1, "dispatching")
    assert got[minutes(60)].status == "completed"
    done = spark.createDataFrame(
        [(T0, "a", "succeeded"), (T0, "b", "failed"), (minutes(60), "x", "claimed")],
        "slot_at timestamp, slug string, status string",
    )
    assert {r.slot_at: r.completed for r in slots.completed(slots.cycles(asked), done).collect()} == {T0: True, minutes(60): True}
    lease = spark.createDataFrame([(T0, 900)], "at timestamp, s int").select(slots.lease_end(F.col("at"), F.col("s")).alias("e")).first().e
    assert lease == minutes(20)


def test_policies_reuse_what_was(spark):
    rows = spark.createDataFrame([(1, 1, "x"), (1, 2, "y"), (1, 3, "x"), (2, 1, None)], "source_id long, ord long, uses string")
    first = policies.policy_versions(rows.filter("ord < 3"), ["uses"])
    later = policies.policy_versions(rows.withColumn("uses", F.when(F.col("ord") == 3, "z").otherwise(F.col("uses"))), ["uses"], first)
    assert sorted((r.source_id, r.version) for r in later.collect()) == [(1, 1), (1, 2), (1, 3), (2, 1)]
    assert policies.policy_versions(rows, ["uses"], first).count() == 3  # an old hash makes no new version


SOUND = json.loads(operations_queries.MANIFEST.replace("K", "1"))


def faults(spark, *changes):
    """The faults of the sound manifest after each change."""
    texts = []
    for change in changes:
        m = json.loads(json.dumps(SOUND))
        change(m)
        texts.append(json.dumps(m))
    df = spark.createDataFrame(list(enumerate(texts)), "i int, manifest string")
    return [r.errors for r in manifests.manifest_errors(df).orderBy("i").collect()]


def test_manifests(spark):
    def put(*path):
        def change(m):
            for k in path[:-2]:
                m = m[k]
            m[path[-2]] = path[-1]

        return change

    got = faults(
        spark, lambda m: None, lambda m: m.pop("limits"), put("recipe", {"type": "project", "path": "lib/calibre_recipes/../x.recipe"}), put(
            "recipe",
            {"type": "project", "path": "lib/calibre_recipes/supplier-1.recipe"},
        ),
        put("recipe", {"type": "generic", "path": "x"}), put("discovery", "feeds", [{"url": "https://s-1.example.com/feed"}] * 2), put(
            "discovery",
            "feeds",
            [{"url": "https://s-1.example.com/feed", "x": 1}],
        ),
        put("source", "name", " padded"), put("source", "name", 5), put("limits", "article_cap", 2.5), put(
            "discovery",
            "update_strategy",
            {"mode": "trusted_marker", "field": "feed_updated"},
        ),
        put("policy_proposal", "notes", ""), put("policy_proposal", "allowed_uses", ["discovery", "resale"]), put("source", []), put(
            "discovery",
            "allowed_hosts",
            "article",
            [],
        ),
    )
    assert got[0] == [] and got[3] == [] and got[10] == []
    assert "manifest is missing keys: limits" in got[1] and got[2] == ['recipe.path must be "lib/calibre_recipes/supplier-1.recipe"']
    assert got[4] == ["recipe.path is not allowed for a generic recipe"] and got[5] == ["discovery feed URLs contains duplicates"]
    assert got[6] == ["discovery.feeds must hold an HTTP(S) url each, and nothing else"]
    assert got[7] == got[8] == ["source.name must be a non-empty string"] and got[9] == ["limits.article_cap must be an integer from 1 through 500"]
    assert got[11] == ["policy_proposal.notes must be a non-empty string"] and got[12][0].startswith("policy_proposal.allowed_uses must be among")
    assert "source must be a mapping" in got[13] and "discovery.allowed_hosts.article must contain between 1 and 50 items" in got[14]
    df = spark.createDataFrame([(None,), ("[]",), ("{",)], "manifest string")
    assert [r.errors[0] for r in manifests.manifest_errors(df).collect()] == ["invalid JSON", "manifest must be a mapping", "invalid JSON"]


def test_manifest_files(spark, tmp_path):
    import yaml

    for i, name in enumerate(["b", "a"]):
        m = json.loads(json.dumps(SOUND))
        (tmp_path / f"{name}.yml").write_text(yaml.safe_dump(m) if i else json.dumps(m))
    (tmp_path / "c.yml").write_text("a: &x 1\nb: *x\n")
    (tmp_path / "d.txt").write_text("no manifest")
    (tmp_path / "e.yml").write_text("source: {name: AT&T News, note: 'a * b'}\nurl: https://e.com/?a=1&b=2\nkept: &anchor 1\n")
    read = manifests.read_manifests(spark, str(tmp_path))
    (other,) = read.filter("path LIKE '%e.yml'").collect()
    assert json.loads(other.manifest) == {"source": {"name": "AT&T News", "note": "a * b"}, "url": "https://e.com/?a=1&b=2", "kept": 1}
    checked = manifests.manifest_errors(read.filter("path NOT LIKE '%e.yml'"))
    assert [(r.path[-5:], r.errors) for r in checked.collect()] == [("a.yml", []), ("b.yml", []), ("c.yml", ["invalid JSON"])]
    assert [tuple(r) for r in manifests.duplicate_slugs(checked).collect()] == [("supplier-1", 2)]
    assert manifests.fetch_manifest(checked.filter("path LIKE '%a.yml'"), "supplier-1").count() == 1
    for slug in ("supplier-1", "nobody"):
        with pytest.raises(Exception, match="manifests found"):
            manifests.fetch_manifest(checked, slug).collect()


@pytest.mark.parametrize(
    ("code", "late", "discovered", "eligible", "outcome"),
    [
        (0, False, 3, 0, "no_changes"),
        (0, False, 0, 0, "succeeded"),
        (0, False, 3, 1, "succeeded"),
        (1, False, 3, 0, "no_changes"),
        (1, True, 3, 0, "failed"),
        (0, True, 3, 0, "no_changes"),
        (1, False, 0, 0, "failed"),
        (2, False, 3, 1, "failed"),
    ],
)
def test_outcomes(spark, code, late, discovered, eligible, outcome):
    df = spark.createDataFrame([(code, late, discovered, eligible)], "c int, l boolean, d int, e int")
    assert df.select(reports.run_outcome(F.col("c"), F.col("l"), F.col("d"), F.col("e")).alias("o")).first().o == outcome


def test_editions_in_new_york(spark):
    """24 hours to 2:00 on weekdays, 72 on Mondays, over the change of clocks in March; nothing at weekends."""
    days = spark.createDataFrame([("2026-03-09",), ("2026-03-10",), ("2026-03-08",), ("2026-08-12",)], "d string")
    got = [r.w and (r.w["from"], r.w["to"]) for r in days.select(reports.edition_window(F.to_date("d")).alias("w")).collect()]
    at = lambda *t: datetime(2026, *t)
    assert got == [(at(3, 6, 7), at(3, 9, 6)), (at(3, 9, 6), at(3, 10, 6)), None, (at(8, 11, 6), at(8, 12, 6))]
    seen = spark.createDataFrame(
        [(at(8, 12, 5, 59), None), (at(8, 12, 6, 1), None), (None, at(8, 14, 12)), (None, at(8, 16, 12))],
        "p timestamp, s timestamp",
    )
    got = [(str(r.e.edition), r.e.fallback) for r in seen.select(reports.edition_of(F.col("p"), F.col("s")).alias("e")).collect()]
    assert got == [("2026-08-12", False), ("2026-08-13", False), ("2026-08-17", True), ("2026-08-17", True)]


def test_small_reports(spark):
    df = spark.createDataFrame(
        [(1, "one two three four five six", "x one two three four five y"), (2, "too short", "too short"), (3, "a b c d e", "")],
        "id long, story string, source_text string",
    )
    assert {r.id: r.overlap for r in reports.prose_overlap(df).collect()} == {1: 0.5, 2: 0.0, 3: 0.0}
    df = spark.createDataFrame([(200, "t", "T"), (403, "t", "T"), (404, "t", "T"), (200, " ", "T"), (200, "t", None)], "s int, x string, t string")
    got = [r[0] for r in df.select(reports.access_result(F.col("s"), F.col("x"), F.col("t"))).collect()]
    assert got == [None, "explicit access response 403", "HTTP 404", "no article text extracted", "no title extracted"]
    status = spark.range(2).select(
        reports.run_status(F.col("id") == 0, F.lit("Error"), F.repeat(F.lit("x"), 3000)).alias("s")
    ).orderBy("s.status").collect()
    assert status[0].s.status == "failed" and len(status[0].s.error_message) == 2000 and status[1].s.error_class is None


def test_cases(spark):
    stats = spark.createDataFrame(
        [(10, 2, 3, 0.5, "b"), (20, 3, 3, 0.1, "a"), (30, 2, 3, 0.5, "a")],
        "cluster long, n_sources long, size long, mean_similarity double, title string",
    )
    numbered = reports.numbered_clusters(stats)
    assert {r.cluster: r.number for r in numbered.collect()} == {20: 1, 30: 2, 10: 3}
    members = spark.createDataFrame([(10, "u1"), (30, "u2"), (99, "alone")], "cluster long, url string")
    assert [r.url for r in reports.select_case(numbered, members, "cluster:2").collect()] == ["u2"]
    assert [r.url for r in reports.select_case(numbered, members, "singleton:alone").collect()] == ["alone"]
    assert reports.select_case(numbered, members, "singleton:u1").count() == 0
    with pytest.raises(ValueError, match="a case is"):
        reports.select_case(numbered, members, "other")
