"""Pages, the discovery gate, and ingest: cases with known results."""

from newsloom.functions import html
from newsloom.operators import gate, ingest
from newsloom.sources import receipts
from pyspark.sql import functions as F

PAGE = """<html><head><title>Site &mdash; Title</title><meta property="article:published_time" content="2026-08-09T10:00:00Z"><meta itemprop="dateModified" content="2026-08-10T00:00:00Z">
<script>var hidden = "<p>no</p>";</script></head><body><h1>Real <b>headline</b></h1><p>First &amp;amp; second.</p><form><meta name="datePublished" content="x">gone</form><p>Third<br>line</p>
<a rel="nofollow calibre-downloaded-from" href="https://E.com/story?utm_source=a">source</a></body></html>"""


def test_article_of_a_page(spark):
    df = spark.createDataFrame(
        [(1, PAGE, "kept"), (2, None, "x"), (3, "", "y"), (4, "<p>open <b>never closed", "z")],
        "page_id long, html string, title string",
    )
    got = {r.page_id: r for r in html.parse_articles(df).collect()}
    r = got[1]
    assert r.title == "Real headline" and r.provenance_url == "https://E.com/story?utm_source=a"
    assert r.article_published == "2026-08-09T10:00:00Z" and r.article_updated == "2026-08-10T00:00:00Z"
    assert r.body_text == "Site — Title Real headline First & second.\nThird line\nsource"
    assert got[2].body_text == got[3].body_text == "" and got[4].body_text == "open never closed"


def test_links_of_a_page(spark):
    page = '<a href="/a">One <b>two</b></a><a>none</a><a href="https://x.org/b"></a><a href="c?d#e">Three</a>'
    df = spark.createDataFrame([(1, page, "https://e.com/dir/page"), (2, None, None)], "page_id long, html string, url string")
    got = [(r.position, r.link, r.title) for r in html.page_links(df).orderBy("position").collect()]
    assert got == [(0, "https://e.com/a", "One two"), (1, "https://x.org/b", None), (2, "https://e.com/dir/c?d#e", "Three")]


def decide(spark, rows, known=(), hosts=("e.com",), cap=100, trust=False):
    df = spark.createDataFrame([(i, u, m) for i, (u, m) in enumerate(rows)], "ordinal long, url string, source_updated_at string")
    state = spark.createDataFrame(list(known), "canonical_url string, source_updated_at string")
    allowed = spark.createDataFrame([(h,) for h in hosts], "host string")
    got = gate.decide(df, state, hosts=allowed, cap=cap, trust_markers=trust).orderBy("ordinal").collect()
    return [(r.decision, r.reason) for r in got]


def test_gate_reasons(spark):
    rows = [
        ("https://E.com/a/?utm_source=x", None),
        ("https://e.com/b", None),
        ("https://e.com/b?ref=1", None),
        ("https://o.org/c", None),
        ("https://o.org/c", None),
        (None, None),
        ("mailto:x", None),
        ("https://e.com/d", None),
    ]
    assert decide(spark, rows, known=[("https://e.com/a", None)], cap=1) == [
        ("skip", "known_unchanged"), ("fetch", "unseen"), (
            "skip",
            "duplicate_in_run",
        ), ("skip", "disallowed_host"), ("skip", "disallowed_host"), ("skip", "invalid_url"), ("skip", "invalid_url"), ("skip", "article_cap"),
    ]


def test_gate_trusts_markers_only_if_told(spark):
    known = [("https://e.com/a", "2026-08-09T10:00:00Z"), ("https://e.com/b", None), ("https://e.com/c", "2026-08-09T10:00:00Z")]
    rows = [
        ("https://e.com/a", "2026-08-09T11:00:00Z"),
        ("https://e.com/b", "2026-08-01T00:00:00Z"),
        ("https://e.com/c", "2026-08-09T10:00:00Z"),
        ("https://e.com/a", None),
    ]
    assert [r for _, r in decide(spark, rows, known)] == ["known_unchanged"] * 3 + ["duplicate_in_run"]
    assert [r for _, r in decide(spark, rows, known, trust=True)] == ["trusted_newer_update"] * 2 + ["known_unchanged", "duplicate_in_run"]


ROWS = "run_id string, ord long, url string, title string, content_hash string, section string, retrieved_at long, published_at string, date_source string, date_confidence string"


def test_two_runs_with_different_bodies(spark):
    first = spark.createDataFrame([("r1", 1, "u", "Old", "h1", None, 10, "d1", "m", "high")], ROWS)
    second = spark.createDataFrame(
        [("r2", 2, "u", "New", "h2", "s", 9, "d2", "f", "medium"), ("r2", 3, "u", "New", "h2", "s", 12, None, None, None)],
        ROWS,
    )
    made = ingest.ingest(first, second)
    article = made["articles"].first()
    assert (article.title, article.date, article.confidence, article.first_seen_at, article.last_seen_at) == ("New", "d1", "high", 10, 12)
    assert made["versions"].count() == 2 and made["observations"].count() == 2
    assert made["counters"].first().asDict() == {
        "run_id": "r2",
        "records": 2,
        "new_articles": 0,
        "new_versions": 1,
        "unchanged_records": 1,
        "new_observations": 1,
    }
    # A run that was imported is not taken again.
    again = ingest.ingest(first, second, imported=spark.createDataFrame([("r2",)], "run_id string"))
    assert again["counters"].count() == 0 and again["versions"].count() == 1


def test_preferred_dates(spark):
    rows = [
        ("a", 1, "d1", "medium"),
        ("a", 2, "d2", "medium"),
        ("a", 3, None, None),
        ("b", 1, "d1", "high"),
        ("b", 2, "d2", "medium"),
        ("c", 1, "d1", "medium"),
        ("c", 2, "d2", "high"),
        ("c", 3, "d3", "high"),
        ("d", 1, None, None),
    ]
    df = spark.createDataFrame(rows, "k string, ord long, d string, c string").withColumn("s", F.lit("s"))
    for strict, of_a in ((False, "d2"), (True, None)):
        got = {
            r.k: r.p and r.p.date for r in df.groupBy("k").agg(
                ingest.preferred_date("ord", "d", "s", "c", strict_reference=strict).alias("p")
            ).collect()
        }
        assert got == {"a": of_a, "b": "d1", "c": "d3", "d": None}


def test_a_bad_record_does_not_stop_its_siblings(spark):
    good = ("https://e.com/a", "https://e.com/a", " A  title ", "body", "2026-08-09T10:00:00Z", None, None, None, "2026-08-09T10:00:00Z")
    rows = [
        good,
        ("ftp://e.com/a", *good[1:]),
        (*good[:1], "https://o.org/", *good[2:]),
        (*good[:2], " \n", *good[3:]),
        (*good[:3], " ", *good[4:]),
        (*good[:4], "yesterday", *good[5:]),
        (*good[:8], "2026-08-09"),
    ]
    names = [
        "canonical_url",
        "requested_url",
        "title",
        "body",
        "article_published",
        "feed_published",
        "article_updated",
        "feed_updated",
        "retrieved_at",
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "position long, " + ", ".join(f"{n} string" for n in names))
    fine, receipts_ = ingest.isolate(df, "article", "position", ingest.article_error(F.array(F.lit("e.com"))))
    assert [r.position for r in fine.collect()] == [0]
    assert {r["index"]: r.error_message for r in receipts_.collect()} == {
        1: "canonical_url must be an HTTP URL", 2: "requested_url host is not allowed", 3: "title is blank", 4: "body text is blank", 5: "dates.article_published is not a valid time", 6: "acquisition.retrieved_at is not a valid time",
    }


def test_identities_must_match(spark):
    df = spark.createDataFrame(
        [(1, 1, 1, 5, 5, "approved"), (1, 2, 1, 5, 5, "approved"), (1, 1, 1, 5, 6, "approved"), (1, 1, 1, 5, 5, "draft")],
        "s long, ps long, rs long, p long, rp long, st string",
    )
    got = [r[0] for r in df.select(ingest.context_error(*[F.col(c) for c in ("s", "ps", "rs", "p", "rp", "st")])).collect()]
    assert got == [
        None,
        "source, policy, and collection run must match",
        "source, policy, and collection run must match",
        "source policy must be approved",
    ]
    df = spark.createDataFrame([("v1", "a"), ("v2", "a"), ("v1", "b"), (None, None)], "v string, s string")
    got = [r[0] for r in df.select(ingest.identity_error(F.col("v"), "v1", F.col("s"), F.lit("a"))).collect()]
    assert got == [None, "unsupported schema_version", "source_slug does not match a", "unsupported schema_version"]


def test_known_state(spark):
    df = spark.createDataFrame([("s", "https://e.com/b", "2026-08-09 10:00:00"), ("s", "https://e.com/a", None)], "source_slug string, canonical_url string, at string").withColumn(
        "source_updated_at",
        F.col("at").cast("timestamp"),
    )
    assert [r.line for r in ingest.known_state(df).collect()] == [
        '{"canonical_url":"https://e.com/a","source_updated_at":null}',
        '{"canonical_url":"https://e.com/b","source_updated_at":"2026-08-09T10:00:00Z"}',
    ]
    v = "calibre-known-state/v1"
    rows = [
        (v, "s", "https://e.com/a", None),
        ("v0", "s", "https://e.com/a", None),
        (v, "", "https://e.com/a", None),
        (v, "s", "x", None),
        (v, "s", "https://e.com/a", "yesterday"),
    ]
    got = [
        r[0] for r in spark.createDataFrame(rows, "a string, b string, c string, d string").select(
            ingest.known_state_error(*[F.col(c) for c in "abcd"])
        ).collect()
    ]
    assert [g is None for g in got] == [True, False, False, False, False] and len(set(got)) == 5


def test_bodies_stay_below_the_run(spark, tmp_path):
    (tmp_path / "articles" / "deep").mkdir(parents=True)
    (tmp_path / "articles" / "deep" / "one.txt").write_text("First\nsecond")
    bodies = ingest.read_bodies(spark, str(tmp_path))
    records = spark.createDataFrame(
        [("articles/deep/one.txt",), ("articles/../../etc/passwd",), ("/etc/passwd",), ("articles/none.txt",)],
        "body_text_path string",
    )
    got = records.join(bodies, "body_text_path", "left").select(
        "body_text_path",
        "body",
        ingest.path_error(F.col("body_text_path"), F.col("body")).alias("e"),
    ).collect()
    assert {r.body_text_path: (r.body, r.e) for r in got} == {
        "articles/deep/one.txt": ("First\nsecond", None), "articles/../../etc/passwd": (
            None,
            "body_text_path is outside the run root",
        ), "/etc/passwd": (None, "body_text_path is outside the run root"), "articles/none.txt": (None, "body_text_path does not exist"),
    }


def test_receipt_files(spark, tmp_path):
    lines = tmp_path / "d.jsonl"
    lines.write_text('{"a": 1, "b": null}\n\n{"a": 2, "b": "x"}\n')
    assert sorted(r.a for r in receipts.read_jsonl(spark, str(lines), "a long, b string").collect()) == [1, 2]
    lines.write_text('{"a": 1}\n{"a": \n')
    for reader, limit in ((receipts.read_jsonl, 10**6), (receipts.read_jsonl, 3)):
        try:
            reader(spark, str(lines), "a long, b string", limit).collect()
        except Exception as error:  # noqa: BLE001  (Spark's own classes of errors differ by cause)
            assert "MALFORMED" in str(error) or "too large" in str(error)
        else:
            raise AssertionError("a bad receipt was read")
    (tmp_path / "one.json").write_text('{"a":\n 7}')
    assert receipts.read_json(spark, str(tmp_path / "one.json"), "a long").first().a == 7
    receipts.append_jsonl(spark.createDataFrame([(2, None)], "b long, a string"), f"{tmp_path}/out")
    written = "".join(p.read_text() for p in (tmp_path / "out").glob("part-*"))
    assert written == '{"a":null,"b":2}\n'


def test_positions_in_receipts(spark, tmp_path):
    (tmp_path / "r.jsonl").write_text('{"a": 5}\n\n  \n{"a": 6}\n{"a": null}')
    got = receipts.read_positions(spark, str(tmp_path / "r.jsonl"), "a long").orderBy("position").collect()
    assert [(r.position, r.record.a) for r in got] == [(0, 5), (1, 6), (2, None)]


def test_first_candidates(spark):
    rows = [(1, "b", 2), (1, "a", 1), (1, "a", 0), (1, "c", 3), (2, "a", 9)]
    df = spark.createDataFrame(rows, "page long, url string, at long")
    got = {tuple(r) for r in gate.first_candidates(df, "page", "url", "at", 2).collect()}
    assert got == {(1, "a", 0), (1, "b", 2), (2, "a", 9)}


def test_dates_of_logs_and_feeds(spark):
    articles = spark.createDataFrame([("u",), ("w",)], "canonical_url string")
    logged = spark.createDataFrame([("u", "1"), ("u", "2"), ("x", "3")], "url string, raw_date string")
    got = {tuple(r) for r in ingest.with_dates(articles, logged, logged.filter("url = 'x'")).collect()}
    assert got == {("u", "2", None), ("w", None, None)}


def test_ordinary_urls_pass_the_gate(spark):
    """Hosts with an underscore or other letters, and paths with a space, brackets, a bar or a stray percent sign."""
    rows = [(u, None) for u in ("https://foo_bar.example.com/a", "https://e.com/a b", "https://e.com/x[1]", "https://e.com/a|b", "https://e.com/100%", "https://münchen.de/x")]
    assert set(decide(spark, rows, hosts=("foo_bar.example.com", "e.com", "münchen.de"))) == {("fetch", "unseen")}


def test_headings_end_no_line(spark):
    pages = ["<h1>Head</h1>Lead", "<h2>Head</h2>Lead", "a<br/>b<br>c</br>d", "<p>x</div>y", "<form><p>a</form>b</p>c", "<title>T</title><h1></h1>z", "<h1>a<h1>b</h1>c</h1>"]
    df = spark.createDataFrame(list(enumerate(pages)), "i long, html string")
    got = [(r.title, r.body_text) for r in html.parse_articles(df).orderBy("i").collect()]
    assert got == [("Head", "Head Lead"), ("", "Head\nLead"), ("", "a\nb c\nd"), ("", "x\ny"), ("", "b\nc"), ("T", "T z"), ("a b", "a b c")]


def test_selectors():
    from newsloom.functions.tree import page_tree

    import pytest

    root = page_tree("<div id=a class='x y'><p data-k='one two'>1<b>2</b><img src=s></p><section lang=en-GB><p>3</p></section></div><p>4</p>")
    found = {
        "p": "12 3 4", "div p": "12 3", "div > p": "12", "div>section > p, b": "2 3", "#a.x": "123", ".y [data-k]": "12", "[data-k~=two]": "12", "[data-k='one two'] b": "2",
        "[lang|=en]": "3", "[data-k^=one]": "12", "[data-k$=\"two\"]": "12", "[data-k*='e t']": "12", "img[src]": "", "* > b": "2", "section b": None,
    }
    for selector, texts in found.items():
        got = [e.text("") for e in root.all(selector)]
        assert sorted(got) == sorted((texts or "").split(" ") if texts is not None else []), selector
        assert (root.first(selector) is None) == (texts is None)
    for wrong in ("", "a,", "> a", "a[", "a b c d!", "pp*p"):
        with pytest.raises(ValueError):
            root.all(wrong)


def test_marks_of_dates(spark):
    page = (
        "<head><meta property='article:published_time' content='m1'><meta name=date content='m2'><meta itemprop=datePublished content='m3'></head><body><time>none</time>"
        "<time datetime='t1'>x</time><time datetime='t2'></time><div data-gu-name='dateline'>First published on <b>9 Aug</b> 2026</div>"
    )
    df = spark.createDataFrame([(1, page), (2, None), (3, "<p>x")], "i long, html string")
    got = {r.i: r.marks for r in html.page_dates(df).collect()}
    assert got == {1: ["t1", "m1", "m2", "m3", "First published on 9 Aug 2026"], 2: [None] * 5, 3: [None] * 5}


def test_heading_as_marked_up(spark, tmp_path):
    """What the SQL of html_title says of headings with other references, cut ones, none, and line ends in them."""
    import duckdb

    import __spark_entry__ as driver

    said = ["token = &quot;0b&quot;", "a &amp;&amp", "&amp;lt; &lt;b&gt;", " <b>x</b>  ", "\ta\t", "a\nb", "a\rb", "", "a</h1><h1>b"]
    pages = [f"<title>T</title><h1>{h}</h1>" for h in said] + ["<title>only</title>", "", None]
    spark.createDataFrame(list(enumerate(pages)), "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: r.title for r in driver.queries()["html_title"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert got == dict(con.execute(driver.oracle_sql()["html_title"]).fetchall())
    assert got[0] == "token = &quot;0b&quot;" and got[1] == "a &&amp" and got[len(said)] == "" and got[len(pages) - 1] is None
