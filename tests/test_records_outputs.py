"""Shapes of records, cleaned pages, the model's checks and sinks."""

import json

from pyspark.sql import functions as F

from newsloom.functions import html
from newsloom.operators import constraints, records
from newsloom.sources import outputs


def test_cleaned_page(spark):
    page = (
        '<html><head><title>No</title></head><body><table class="x touchscreen_navbar"><tr><td>bar</td></tr></table><h1>Title</h1><p>One <b>two</b></p><script>no()</script>'
        '<div aria-label="advertisement">buy <p>now</p></div><img src="x"><p>Three</p><div>from <a rel="calibre-downloaded-from" href="https://e.com">here</a> today</div><p>Four</body></html>'
    )
    df = spark.createDataFrame([(1, page), (2, None), (3, "<p>no body</p>")], "i long, html string")
    got = {r.i: r.body_text for r in html.clean_bodies(df).collect()}
    assert got == {1: "Title\nOne\ntwo\nThree\nFour", 2: "", 3: ""}


def test_payload_is_canonical_json(spark):
    r = spark.range(1).select(records.article_payload(*[F.lit(x) for x in ("s", "https://e.com/é", 'T"', "b\n", 1, "", "t", "r")])).first()[0]
    plain = {
        "schema_version": "calibre-article/v1", "source_slug": "s", "article": {
            "canonical_url": "https://e.com/é",
            "language": "en",
            "title": 'T"',
        }, "content": {"body_text": "b\n", "word_count": 1},
        "acquisition": {"final_url": "https://e.com/é", "http_status": 200, "requested_url": "r", "retrieved_at": "t"},
    }
    assert r == json.dumps(plain, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def test_log_and_entries(spark):
    log = "start\nhttps://e.com/a?x=1 \n  Sun, 09 Aug 2026\nhttps://e.com/b\nno date follows\n   https://e.com/c\n\t2026-08-10\nend"
    got = [tuple(r) for r in records.logged_dates(spark.createDataFrame([(log,)], "value string")).collect()]
    assert ("https://e.com/a?x=1", "Sun, 09 Aug 2026") in got and ("https://e.com/c", "2026-08-10") in got
    df = spark.createDataFrame([("u", "l"), ("", "l"), (None, None)], "u string, l string")
    assert [r[0] for r in df.select(records.article_url(F.col("u"), F.col("l"))).collect()] == ["u", "l", None]


def test_model_checks_find_each_fault(spark):
    slots = spark.createDataFrame(
        [
            (1, "2026-08-09 12:00:00", "claimed", 1, "2026-08-09 12:05:00", "2026-08-09 12:01:00", None, None),
            (1, "2026-08-09 12:00:00", "succeeded", 0, "2026-08-09 12:05:00", None, "2026-08-09 12:09:00", None),
            (2, "2026-08-09 12:30:00", "lost", 1, None, None, None, None),
        ],
        "source_id long, slot_at string, status string, attempts int, claimed_at string, lease_expires_at string, finished_at string, collection_run_id long",
    )
    for c in ("slot_at", "claimed_at", "lease_expires_at", "finished_at"):
        slots = slots.withColumn(c, F.col(c).cast("timestamp"))
    got = {r.check_name.split(".")[1]: r.violations for r in constraints.check_model({"news_collection_slots": slots}).collect()}
    assert got == {
        "status": 1,
        "source_id_slot_at_unique": 1,
        "on_the_hour": 1,
        "attempts": 1,
        "lease_after_claim": 1,
        "finished_unless_claimed": 1,
        "success_has_run": 1,
    }


def test_sinks(spark, tmp_path):
    articles = spark.createDataFrame(
        [("https://e.com/b", "B", "body", None), ("https://e.com/a", "A", "text", "x")],
        "canonical_url string, title string, body string, section string",
    )
    outputs.write_articles(articles, f"{tmp_path}/run")
    lines = [json.loads(x) for p in (tmp_path / "run/articles").glob("part-*") for x in p.read_text().splitlines()]
    assert all(list(x) == sorted(x) for x in lines) and {x["section"] for x in lines} == {None, "x"}
    bodies = {r.identity: r.body for r in spark.read.parquet(f"{tmp_path}/run/bodies").collect()}
    assert {
        x["canonical_url"]: bodies[x["identity"]] for x in lines
    } == {"https://e.com/b": "body", "https://e.com/a": "text"} and all(len(i) == 20 for i in bodies)

    outputs.write_frozen(
        articles.withColumnRenamed("canonical_url", "url"),
        spark.createDataFrame([("s", 2)], "source string, n long"),
        f"{tmp_path}/frozen",
    )
    order = [json.loads(x)["url"] for p in sorted((tmp_path / "frozen/articles").glob("part-*")) for x in p.read_text().splitlines()]
    assert order == sorted(order) and len(order) == 2

    for i in (1, 2):
        outputs.write_reports(spark.createDataFrame([(i, "succeeded")], "run_id long, outcome string"), str(tmp_path))
    assert spark.read.json(f"{tmp_path}/reports").count() == 2
    stats, members = spark.createDataFrame([(1, 2)], "cluster long, size long"), spark.createDataFrame([(1, 5)], "cluster long, id long")
    for t in (0.145, 0.2):
        outputs.write_clusters(stats, members, t, str(tmp_path))
    assert {r.threshold for r in spark.read.parquet(f"{tmp_path}/clusters").collect()} == {0.145, 0.2}
    outputs.write_scores(
        spark.createDataFrame([("cluster:1", "{}", "p", "{}")], "case string, dossier string, prompt string, score string"),
        str(tmp_path),
    )
    assert spark.read.parquet(f"{tmp_path}/scores").first().prompt == "p"

    rows = spark.createDataFrame([(1, 0, "a"), (1, 0, "b"), (1, 1, "c")], "run long, position long, url string")
    assert [outputs.insert_or_ignore(rows, f"{tmp_path}/obs", ["run", "position"]) for _ in range(2)] == [2, 0]
    assert outputs.insert_or_ignore(rows.withColumn("run", F.lit(2).cast("long")), f"{tmp_path}/obs", ["run", "position"]) == 2


def test_the_first_row_of_a_key_is_written(spark, tmp_path):
    rows = spark.createDataFrame([(1, "b", 2), (1, "a", 3), (1, "c", 1), (2, "d", 9)], "run long, what string, at long")
    assert [outputs.insert_or_ignore(rows, f"{tmp_path}/first", ["run"], "at") for _ in range(2)] == [2, 0]
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/first").collect())) == [(1, "c", 1), (2, "d", 9)]
    sized = outputs.with_byte_size(spark.createDataFrame([('{"a":"é"}',), (None,)], "p string"), "p").collect()
    assert [r.byte_size for r in sized] == [10, None]
