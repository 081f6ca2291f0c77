"""Tables with commits, retention, frozen sets, canonical items, and links as a table function."""

import json
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from newsloom.functions import canonical, links
from newsloom.operators import frozen, ingest, records
from newsloom.sources.corpus_table import CorpusTable
from newsloom.sources.versions import Conflict, Snapshots, Versions

ROWS = "run_id string, ord long, url string, title string, content_hash string, section string, retrieved_at string, published_at string, date_source string, date_confidence string"


def made_rows(seed, runs=4, n=40):
    draw, out = random.Random(seed), []
    for i in range(n * runs):
        dated = draw.random() < 0.6
        out.append((
            f"run-{i // n}", i, f"u{draw.randint(0, 25)}", f"t{i}", f"h{draw.randint(0, 3)}", draw.choice([None, "", "news"]), f"2026-08-{1 + i // n:02d}",
            f"d{i}" if dated else None, "feed" if dated else None, draw.choice(["high", "medium"]) if dated else None,
        ))
    return out


def state(corpus, name):
    return sorted(map(str, corpus.read(name).collect()))


def test_commits_are_the_fold_of_all_rows(spark, tmp_path):
    """Run by run, with runs given again and parts folded in between: the state of one fold."""
    rows = spark.createDataFrame(made_rows(1), ROWS)
    whole = ingest.ingest(None, rows)
    corpus, told = CorpusTable(spark, f"{tmp_path}/c"), []
    for i in range(4):
        told += corpus.commit(rows.filter(F.col("run_id") <= f"run-{i}")).collect()  # earlier runs come again
        if i == 2:
            corpus.compact()
    names = ["url", "title", "date", "source", "confidence", "first_seen_at", "last_seen_at"]
    assert sorted(map(tuple, corpus.articles().select(names).collect())) == sorted(map(tuple, whole["articles"].select(names).collect()))
    assert sorted(map(tuple, told)) == sorted(map(tuple, whole["counters"].collect()))
    assert corpus.read("versions").count() == whole["versions"].count() and corpus.read("observations").count() == whole["observations"].count()
    number, before = corpus.versions.number(), state(corpus, "articles")
    again = corpus.commit(rows)
    assert again.count() == 0 and corpus.versions.number() == number and state(corpus, "articles") == before
    assert corpus.articles(1).count() == ingest.ingest(None, rows.filter("run_id = 'run-0'"))["articles"].count()  # as of the first commit


def test_a_killed_run_changes_nothing(spark, tmp_path, monkeypatch):
    rows = spark.createDataFrame(made_rows(2, runs=2), ROWS)
    corpus = CorpusTable(spark, f"{tmp_path}/c")
    corpus.commit(rows.filter("run_id = 'run-0'"))
    before = state(corpus, "articles")
    with monkeypatch.context() as m:
        m.setattr(Versions, "commit", lambda *_: (_ for _ in ()).throw(KeyboardInterrupt()))
        with pytest.raises(KeyboardInterrupt):
            corpus.commit(rows)
    assert state(corpus, "articles") == before and corpus.versions.number() == 1
    assert corpus.commit(rows).count() == 1 and corpus.vacuum() == 1
    assert corpus.articles().count() == ingest.ingest(None, rows)["articles"].count()


def test_two_writers_conflict(spark, tmp_path):
    versions = Versions(spark, f"{tmp_path}/v")
    assert versions.number() == 0 and versions.content() == {} and versions.commit(0, {"parts": []}) == 1
    with pytest.raises(Conflict):
        versions.commit(0, {"parts": ["late"]})
    assert versions.content() == {"parts": []}


def test_retention_rewrites_only_what_it_must(spark, tmp_path):
    kept = Snapshots(spark, f"{tmp_path}/s")
    rows = spark.range(1000).select(F.col("id"), F.when(F.col("id") != 7, F.col("id")).alias("age"))
    kept.append(rows.repartitionByRange(10, "id").sortWithinPartitions("id"))
    before = {f: Path(f.removeprefix("file:")).stat().st_mtime_ns for f in kept.versions.content()["files"]}
    receipt = kept.expire(F.col("age") < 150, "rights ended").collect()
    after = kept.versions.content()["files"]
    assert sum(r.deleted for r in receipt) == 149 and 2 <= len(receipt) <= 3  # a null age stays
    unchanged = set(before) & set(after)
    assert len(unchanged) == len(before) - len(receipt) and all(Path(f.removeprefix("file:")).stat().st_mtime_ns == before[f] for f in unchanged)
    assert not any(Path(f.removeprefix("file:")).exists() for f in set(before) - set(after))
    assert kept.read().count() == 851 and kept.read().filter("age < 150").count() == 0
    assert kept.expire(F.col("age") < 150, "rights ended").count() == 0 and kept.receipts().agg(F.sum("deleted")).first()[0] == 149
    kept.expire(F.lit(True), "all")
    assert kept.read().count() == 0 and kept.receipts().agg(F.sum("deleted")).first()[0] == 1000


def test_digest_tree(spark):
    rows = spark.createDataFrame([(i, f"v{i}") for i in range(300)] + [(None, "x"), (5, "v5")], "k long, v string")
    trees = []
    for parts in (1, 7):
        tree = frozen.digest_tree(frozen.digested(rows.repartition(parts), F.col("k"), F.col("v")), 3)
        trees.append(sorted(map(tuple, tree.collect())))
    assert trees[0] == trees[1] and [t for t in trees[0] if t[0] == 0][0][2] == 302
    text_keys = frozen.digest_tree(frozen.digested(rows, F.concat(F.lit("https://e.com/"), "k"), F.col("v")), 2)
    assert text_keys.filter("level = 0").count() == 1
    nothing = frozen.digest_tree(frozen.digested(rows.limit(0), F.col("k"), F.col("v")), 2).collect()
    assert [(r.level, r.n) for r in nothing] == [(0, 0)]


def test_differences_of_frozen_sets(spark):
    a = [(str(i), f"v{i}") for i in range(200)] + [("twice", "1"), ("twice", "2")]
    b = [(k, v + "!" if k == "17" else v) for k, v in a if k != "3"] + [("new", "x")]
    sets = [frozen.digested(spark.createDataFrame(s, "k string, v string"), F.col("k"), F.col("v")).cache() for s in (a, b)]
    trees = [frozen.digest_tree(s, 3).cache() for s in sets]
    leaves = frozen.differing_leaves(*trees, 3)
    assert leaves.count() <= 3
    assert sorted(map(tuple, frozen.differences(*sets, leaves, 3).collect())) == [("17", "changed"), ("3", "removed"), ("new", "added")]
    assert frozen.differing_leaves(trees[0], trees[0], 3).count() == 0
    every = frozen.differing_leaves(trees[0], frozen.digest_tree(sets[0].limit(0), 3), 3)
    assert frozen.differences(sets[0], sets[0].limit(0), every, 3).filter("change = 'removed'").count() == 201


def test_canonical_json_of_any_shape(spark):
    draw = random.Random(3)

    def some(depth):
        kind = draw.randint(0, 6 if depth else 4)
        if kind == 5:
            return [some(depth - 1) for _ in range(draw.randint(0, 3))]
        if kind == 6:
            return {draw.choice(["b", "a", "é", "😀", "￿", "", 'q"', "Z"]): some(depth - 1) for _ in range(draw.randint(0, 4))}
        return draw.choice([None, True, 12345678901234567890, -0.0, 1.0, 0.1, "text", "\u001f\n /é😀", 1e16])

    values = [some(5) for _ in range(200)]
    texts = [json.dumps(v, ensure_ascii=draw.random() < 0.5, indent=draw.choice([None, 2])) for v in values]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    got = [r[0] for r in df.orderBy("i").select(canonical.canonical_json_text(F.col("t"))).collect()]
    want = [json.dumps(v, sort_keys=True, separators=(",", ":"), ensure_ascii=False).replace("1e+16", "1.0e+16") for v in values]
    assert got == want
    odd = {'{"a":1,"a":2}': '{"a":2}', "": None, "{": None, "NaN": None, "1e999": None, "[1E3]": "[1000.0]", "1e-7": "1.0e-07", '"\\ud800"': None, "[" * 3000 + "]" * 3000: None, " 1 ": "1"}
    df = spark.createDataFrame([(k,) for k in odd] + [(None,)], "t string")
    found = {r.t: r.c for r in df.select("t", canonical.canonical_json_text(F.col("t")).alias("c")).collect()}
    assert {k: found[k] for k in odd if len(k) < 100} == {k: v for k, v in odd.items() if len(k) < 100} and found[None] is None


def test_whole_payload_of_little(spark):
    (r,) = spark.range(1).select(records.whole_payload({"source_slug": F.lit("s"), "language": F.lit(" ")})).collect()
    got = json.loads(r[0])
    assert got["article"] == {"authors": [], "canonical_url": None, "dates": None, "description": None, "language": "en", "section": None, "title": None}
    assert got["acquisition"]["http_receipt_inferred"] is True and list(got) == sorted(got) and list(got["acquisition"]) == sorted(got["acquisition"])


def test_candidates_of_pages(spark):
    path = "/a-long-path-of-a-story-" + "x" * 10
    page = f'<a href="/short"></a><a href="{path}">One</a><a href="{path}">again</a><a href="{path}2">Two</a><a href="{path}.pdf"></a><a href="https://o.org{path}"></a><a href="{path}3"></a>'
    rows = [(1, page, "https://www.e.com/"), (2, "<p>none", "https://e.com/"), (3, None, "https://e.com"), (4, page, None)]
    got = links.candidates(spark.createDataFrame(rows, "page_id long, html string, url string"), most=2).orderBy("page_id", "position").collect()
    assert [(r.page_id, r.position, r.link, r.title, r.error) for r in got] == [
        (1, 1, f"https://www.e.com{path}", "One", None), (1, 3, f"https://www.e.com{path}2", "Two", None),
        *[(i, None, None, None, "no candidate links") for i in (2, 3, 4)],
    ]


def test_small_rules(spark):
    from newsloom.functions import places
    from newsloom.functions import text as tx
    from newsloom.operators import corpus, gate

    values = {
        '{"eng":"A","label":{"eng":"B"}}': "A", '{"label":{"eng":"B"}}': "B", '{"label":{"label":{"eng":"C"}}}': "C", '{"label":"D"}': "D", '"E"': "E", '{"deu":"F"}': None, "null": None, "{": None,
        '{"eng":null,"label":"G"}': "G", '["H"]': None,
    }
    df = spark.createDataFrame([(k,) for k in values] + [(None,)], "v string")
    assert {r.v: r.n for r in df.select("v", places.nested_value(F.col("v")).alias("n")).collect()} == {**values, None: None}
    names = {'["A, B","C"]': ["A, B", "C"], '"A, B and C"': ["A", "B", "C"], "[]": [], "7": [], "null": [], '""': []}
    df = spark.createDataFrame([(k,) for k in names] + [(None,)], "v string")
    assert {r.v: r.n for r in df.select("v", tx.listed_authors(F.col("v")).alias("n")).collect()} == {**names, None: []}
    feeds = spark.createDataFrame([("f", [("u1", "a"), ("u2", "b"), ("u1", "c"), (None, "d")]), ("g", [("u3", "x")]), ("h", [])], "feed string, articles array<struct<url: string, title: string>>")
    decisions = spark.createDataFrame([("u1", "fetch"), ("u2", "skip"), ("u3", "skip"), (None, "fetch")], "url string, decision string")
    got = {r.feed: [tuple(a) for a in r.articles] for r in gate.filter_feeds(feeds, decisions).collect()}
    assert got == {"f": [("u1", "a"), ("u1", "c")], "g": [], "h": []}
    rows = spark.createDataFrame([("a",), ("b",), (None,)], "source string")
    assert gate.of_sources(rows, ["b"]).count() == 1 and gate.of_sources(rows, None).count() == gate.of_sources(rows, []).count() == 3
    assert gate.collector_identity("Loom", "1.0", "https://e.com", " x@e.com ") == "Loom/1.0 (+https://e.com; mailto:x@e.com)"
    with pytest.raises(ValueError):
        gate.collector_identity("Loom", "1.0", "https://e.com", " ", required=True)
    latest = corpus.with_latest(spark.range(2).toDF("k"), spark.createDataFrame([(0, 1, "x"), (0, 2, "y")], "k long, n int, v string"), "k", "n").collect()
    assert {r.k: r.latest and r.latest.v for r in latest} == {0: "y", 1: None}


def test_claims_look_at_the_last_lease_only():
    """The same slots as when every slot is looked at, for random events; many slots take no longer."""
    import time
    from datetime import datetime, timedelta

    from newsloom.operators.slots import Source

    class Plain(Source):
        def claim(self, slot_at, now, lease):
            busy = any(s["status"] == "claimed" and s["lease_expires_at"] > now for s in self.slots.values())
            if busy or self.slots.get(slot_at, {}).get("status") == "succeeded":
                return False
            self.last = None
            return super().claim(slot_at, now, lease)

    draw, start = random.Random(4), datetime(2026, 8, 9)
    a, b = Source(), Plain()
    for i in range(3000):
        now, slot = start + timedelta(minutes=5 * i), start + timedelta(hours=draw.randint(0, 60))
        if draw.random() < 0.6:
            lease = timedelta(minutes=draw.choice([1, 12, 40]))
            assert a.claim(slot, now, lease) == b.claim(slot, now, lease)
        else:
            status = draw.choice(["succeeded", "failed"])
            assert a.finish(slot, now, status, 1) == b.finish(slot, now, status, 1)
        if i % 500 == 0:
            a = Source(a.slots)  # as read back from a state
    assert a.slots == b.slots
    began, many = time.time(), Source()
    for i in range(20_000):
        many.claim(start + timedelta(hours=i), start + timedelta(hours=i), timedelta(minutes=30))
    assert len(many.slots) == 20_000 and time.time() - began < 2


def test_known_state_through_a_filter(spark):
    """Nothing of the run is lost, nearly all of the rest is left out without a shuffle, and decisions stay the same."""
    from newsloom.operators import gate

    known = spark.range(20_000).select(F.concat(F.lit("https://e.com/"), "id").alias("canonical_url"), F.lit(None).cast("string").alias("source_updated_at"))
    run = spark.createDataFrame([(i, f"https://E.com/{i * 7}?utm_x=1") for i in range(500)] + [(900, None), (901, "https://e.com/new")], "ordinal long, url string")
    run = run.withColumn("source_updated_at", F.lit(None).cast("string"))
    some = gate.known_of_run(known, run, bits=1 << 16)
    wanted = {f"https://e.com/{i * 7}" for i in range(500)}
    got = {r.canonical_url for r in some.collect()}
    assert wanted <= got and len(got) < 500 + 0.002 * 20_000 + 60
    assert "Exchange hashpartitioning" not in some._jdf.queryExecution().executedPlan().toString()
    hosts = spark.createDataFrame([("e.com",)], "host string")
    a, b = (sorted(map(tuple, gate.decide(run, k, hosts=hosts, cap=10).collect()), key=str) for k in (known, some))
    assert a == b and sum(r[-1] == "known_unchanged" for r in a) == 500
    assert gate.known_of_run(known, run.limit(0)).count() == 0
