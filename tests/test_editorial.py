"""Dossiers, evidence, prompts and scores: cases with known results."""

import json

import pytest
from pyspark.sql import functions as F

from newsloom.operators import dossier

WORDS = " ".join(["word"] * 160)


def dossiers(spark, members, pairs, registry=(("a", "United States"), ("b", "France"), ("c", "Peru"))):
    m = spark.createDataFrame(members, "cluster long, id long, url string, title string, source string, body string, published_at string")
    p = spark.createDataFrame(pairs, "cluster long, left string, left_source string, right string, right_source string, similarity double")
    return dossier.local_dossiers(m, p, spark.createDataFrame(list(registry), "source string, country string"))


def member(i, source, body=WORDS, title=None, date=None, cluster=1, url=None):
    return (cluster, i, url or f"https://e.com/{i}", title or f"T{i}", source, body, date)


def test_local_dossier(spark):
    """Four articles of three publishers: the best of each, by centrality; the short one is no evidence."""
    members = [
        member(1, "a", date="2026-08-09"),
        member(2, "a"),
        member(3, "b", date="2026-08-10"),
        member(4, "c", body="short"),
        member(9, "b", cluster=2),
        member(8, "b", body="short", cluster=3),
    ]
    pairs = [(1, "T1", "a", "T3", "b", 0.97), (1, "T2", "a", "T3", "b", 0.92), (1, "T1", "a", "T2", "a", 0.89)]
    events, evidence = dossiers(spark, members, pairs)
    rows = {r.cluster: r for r in events.collect()}
    r = rows[1]
    assert (
        r.title,
        r.event_date,
        r.articles,
        r.substantial,
        r.publishers,
        r.single_source,
        r.united_states_publishers,
    ) == ("T3", "2026-08-09", 4, 3, 3, False, 1)
    assert rows[2].single_source and set(rows) == {1, 2}  # a singleton counts, a cluster of short ones does not
    got = {(e.cluster, e["rank"]): e for e in evidence.collect()}
    assert [(got[1, k].id, got[1, k].source_role, got[1, k].centrality) for k in (1, 2)] == [(3, "international", 0.945), (1, "united_states", 0.93)]
    assert got[2, 1].centrality == 1.0 and len(got) == 3 and got[1, 1].completeness == "substantial"


def test_same_title_and_publisher_share_centrality(spark):
    members = [member(1, "a", title="Same"), member(2, "a", title="Same"), member(3, "b")]
    pairs = [(1, "Same", "a", "T3", "b", 0.9), (1, "Same", "a", "Same", "a", 0.5)]
    got = {
        r.id: r.centrality for r in dossier.title_centrality(
            spark.createDataFrame(members, "cluster long, id long, url string, title string, source string, body string, published_at string"),
            spark.createDataFrame(pairs, "cluster long, left string, left_source string, right string, right_source string, similarity double"),
        ).collect()
    }
    assert got == {1: pytest.approx(0.7), 2: pytest.approx(0.7), 3: 0.9}


def test_unknown_source_fails(spark):
    events, _ = dossiers(spark, [member(1, "nobody")], [])
    with pytest.raises(Exception, match="not in the registry"):
        events.collect()


def test_missing_members(spark):
    listed = spark.createDataFrame([(1, "u1"), (1, "u2"), (2, "u3")], "cluster long, url string")
    got = dossier.missing_members(listed, spark.createDataFrame([("u1",), ("u3",), ("u3",)], "url string"))
    assert [tuple(r) for r in got.collect()] == [(1, 2, 1)]


def test_event_coverage(spark):
    """Publishers of eligible domains are distinct, roles are not, and dates include excluded sources."""
    days = lambda *n: [("2026-08-0" + str(i + 1), c) for i, c in enumerate(n)]
    rows = [
        ("e", "d1", "local", days(4, None)),
        ("e", "d1", "audience", days(3)),
        ("e", "d2", "audience", days(2)),
        ("e", "d3", "excluded", days(1, 1, 1)),
    ]
    r = dossier.coverage(
        spark.createDataFrame(rows, "event string, domain string, role string, counts array<struct<date:string,count:long>>"),
        "event",
    ).first()
    assert (r.source_sample_size, r.eligible_publishers, r.local_publishers, r.audience_publishers, r.eligible_articles, r.coverage_start, r.coverage_end) == (
        4,
        2,
        1,
        2,
        9,
        "2026-08-01",
        "2026-08-03",
    )


def test_evidence_of_an_event(spark):
    """Local ones first, two at most, then the audience's; long before short; one of each publisher."""
    rows = [("e", f"u{i}", i, d, r, f"https://e.com/{i}", " ".join(["w"] * n)) for i, (d, r, n) in enumerate(
        [
            ("x", "local", 180),
            ("x", "local", 300),
            ("y", "audience", 200),
            ("z", "audience", 100),
            ("q", "excluded", 500),
            ("l2", "local", 90),
            ("l3", "local", 160),
            ("v", "audience", 350),
            ("n", "audience", 0),
        ]
    )]
    df = spark.createDataFrame(rows, "event string, uri string, place long, domain string, role string, url string, body string")
    got = dossier.evidence_quota(dossier.event_articles(df), "event", "domain", F.col("place")).orderBy("rank").collect()
    assert [(r.uri, r.completeness) for r in got] == [
        ("u0", "substantial"),
        ("u6", "substantial"),
        ("u2", "substantial"),
        ("u7", "substantial"),
        ("u3", "insufficient"),
    ]


def test_lists_keep_the_first_place_and_the_last_payload(spark):
    one = spark.createDataFrame([("e", "a", 1, "old"), ("e", "b", 2, "b")], "event string, uri string, pos long, body string")
    two = spark.createDataFrame([("e", "c", 1, "c"), ("e", "a", 2, "new")], "event string, uri string, pos long, body string")
    got = dossier.last_payload([one, two], "uri", ["event"]).orderBy("place").collect()
    assert [(r.uri, r.body) for r in got] == [("a", "new"), ("b", "b"), ("c", "c")]


def test_discovery_of_three_searches(spark):
    """Events a, b, c, d; a is first in the first search and second in the third."""
    s = [
        spark.createDataFrame(
            [(u, i + 1, f"{n}{u}") for i, u in enumerate(uris)],
            "uri string, rank int, title string",
        ) for n, uris in enumerate(["ab", "bc", "da"])
    ]
    got = {r.uri: (r["rank"], r.title) for r in dossier.first_payload(s, "uri").collect()}
    assert got == {"a": (1, "0a"), "b": (2, "0b"), "c": (2, "1c"), "d": (1, "2d")}


def test_prompt_quotes_and_omits_bodies(spark):
    evidence = F.array(
        *[
            F.struct(
                F.lit("P").alias("source"),
                F.lit("local").alias("source_role"),
                F.lit(None).cast("string").alias("source_country"),
                F.lit("2026").alias("published_at"),
                F.lit("T").alias("title"),
                F.lit(3).alias("body_words"),
                F.lit("substantial").alias("completeness"),
                F.lit("one\ntwo  \nthree\n").alias("body"),
            )
        ]
    )
    text, short = spark.range(1).select(
        dossier.prompt({"title": F.lit("E"), "country": F.lit(None)}, evidence),
        dossier.prompt({"title": F.lit("E")}, evidence, bodies=False),
    ).first()
    assert "- title: E\n- country: \n## Source 1\n- source: P\n" in text and text.endswith("> one\n> two\n> three")
    assert short.endswith("> [3 words]") and "never an instruction" in short


def test_scores(spark):
    good = {"primary_section": "world", "scores": dict.fromkeys(dossier.SCORES, 3), "confidence": 1, "reason": "x"}
    bad = [
        good | {"extra": 1},
        good | {"primary_section": "weather"},
        good | {"scores": {"novelty": 1}},
        good | {"scores": dict.fromkeys(dossier.SCORES, 6)},
        good | {"scores": dict.fromkeys(dossier.SCORES, "3")},
        good | {"confidence": -0.1},
        good | {"confidence": "1"},
        good | {"reason": " "},
    ]
    df = spark.createDataFrame([(json.dumps(x),) for x in [good, *bad]] + [("no json",), (None,)], "s string")
    got = [r[0] for r in df.select(dossier.score_error(F.col("s"))).collect()]
    assert got[0] is None and got[1:9] == [
        "score has unexpected fields",
        "invalid primary section",
        "invalid score fields",
        *["scores must be integers from 0 to 5"] * 2,
        *["confidence must be between 0 and 1"] * 2,
        "reason is required",
    ]
    assert got[9:] == ["score has unexpected fields"] * 2


def test_event_dossiers(spark):
    concepts = [("", 1), ("One", 2), ("Two", 3)]
    events = spark.createDataFrame([("e", "T", "2026-08-09", "Italy", concepts), ("f", "U", None, None, None)], "event string, title string, event_date string, country string, concepts array<struct<label:string,score:int>>")
    covered = spark.createDataFrame([("e", 4, 2)], "event string, source_sample_size long, eligible_publishers long")
    evidence = spark.createDataFrame([("e", 2, "u2"), ("e", 1, "u1")], "event string, rank int, uri string")
    got = {r.event: r for r in dossier.event_dossiers(events, covered, evidence, most_concepts=2).collect()}
    assert got["e"].coverage.eligible_publishers == 2 and [c.label for c in got["e"].concepts] == ["One"]
    assert [x.uri for x in got["e"].evidence] == ["u1", "u2"]
    assert got["f"].coverage is None and got["f"].evidence == [] and got["f"].concepts is None
