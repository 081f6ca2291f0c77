"""URL identity, dates and texts against hand-made values and the standard library."""

from datetime import datetime
from urllib.parse import parse_qsl, urlencode, urlsplit

import pytest
from pyspark.sql import functions as F

from newsloom.functions import dates, places, urls
from newsloom.functions import text as tx


def values(spark, rows, *columns):
    """What each column expression over ``c`` gives for each of ``rows``, in order."""
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i long, c string")
    got = df.select("i", *[c.alias(f"v{k}") for k, c in enumerate(columns)]).orderBy("i").collect()
    return [tuple(r)[1:] if len(columns) > 1 else r.v0 for r in got]


CANONICAL = {
    " HTTPS://User:pw@WWW.Example.com:443//a///b/?utm_source=x&b=2&a=1#top ": "https://www.example.com/a/b?a=1&b=2",
    "http://e.com": "http://e.com/",
    "http://e.com:8080/": "http://e.com:8080/",
    "http://e.com:0080/x": "http://e.com/x",
    "http://e.com:/x": "http://e.com/x",
    "http://e.com:port/x": None,
    "http://e.com:70000/x": None,
    "http://[2001:DB8::1]:8080/x": "http://2001:db8::1:8080/x",
    "https://e.com/x?q=a%20b+c&empty=&flag&id=%C3%A9&t=~*": "https://e.com/x?empty=&flag=&id=%C3%A9&q=a+b+c&t=~%2A",
    "https://e.com/x?UTM_Medium=1&Ref=2&fbclid=3&gclid=4&mc_cid=5&mc_eid=6&keep=7": "https://e.com/x?keep=7",
    "https://e.com/x?a=100%&b=%zz": "https://e.com/x?a=100%25&b=%25zz",
    "https://e.com/x?b=2&a=2&a=1": "https://e.com/x?a=1&a=2&b=2",
    "ftp://e.com/x": None,
    "http:///x": None,
    "no url": None,
    "": None,
    "https://e.com/a?x=1?y=2&z==3": "https://e.com/a?x=1%3Fy%3D2&z=%3D3",
}


def test_canonical_url(spark):
    assert dict(zip(CANONICAL, values(spark, list(CANONICAL), urls.canonical_url(F.col("c"))), strict=True)) == CANONICAL
    assert values(spark, [None], urls.canonical_url(F.col("c"))) == [None]


def test_query_is_encoded_as_the_standard_library_does(spark):
    raw = ["https://e.com/?" + q for q in ("a=%41%7e.-_&b=%2B+%20", "k%20y=v%26w&z=ü", "s=/:?@!$'()*,;", "%3D=%3D&x=%E4%B8%AD")]
    expected = ["https://e.com/?" + urlencode(sorted(parse_qsl(urlsplit(u).query, keep_blank_values=True))) for u in raw]
    assert values(spark, raw, urls.canonical_url(F.col("c"))) == expected


def test_sites_and_articles(spark):
    home = F.lit("https://www.e.com/")
    rows = [
        "https://news.e.com/2026/08/09/a-long-story/",
        "https://e.com/short",
        "https://fake-e.com/2026/08/09/a-long-story",
        "https://e.com/video/2026/08/09/a-long-story",
        "https://e.com/2026/08/09/a-long-photo.jpg",
    ]
    assert values(spark, rows, urls.same_site(F.col("c"), home)) == [True, True, False, True, True]
    assert values(spark, rows, urls.likely_article(F.col("c"), home)) == [True, False, False, False, False]
    assert values(
        spark,
        ["https://e.com/2026/aug/9/x", "https://e.com/2026/08/31/x", "https://e.com/2026/02/31/x", "https://e.com/x"],
        urls.date_in_path(F.col("c")).cast("string"),
    ) == ["2026-08-09", "2026-08-31", None, None]


def test_strict_times(spark):
    rows = [
        "2026-08-09T10:00:00-04:00",
        "2026-08-09T10:00:00.987Z",
        "2026-08-09T10:00:00",
        "2026-08-09",
        "2026",
        "yesterday",
        " ",
        None,
        "Sun, 09 Aug 2026 10:00:00 GMT",
    ]
    got = values(spark, rows, dates.iso(dates.strict_time(F.col("c"))), dates.time_error(F.col("c"), "at"))
    assert [g[0] for g in got] == ["2026-08-09T14:00:00Z", "2026-08-09T10:00:00Z", *[None] * 7]
    assert [g[1] is not None for g in got] == [False, False, True, True, True, True, False, False, True]


def test_bridge_times_are_utc(spark):
    rows = ["2026-08-09T10:00:00-04:00", "2026-08-09T10:00:00", "2026-08-09 10:00", "2026-08-09", "2026-08-09T10:00:00.5Z", "09 Aug 2026", None, ""]
    assert values(spark, rows, dates.bridge_time(F.col("c"))) == [
        "2026-08-09T14:00:00Z",
        "2026-08-09T10:00:00Z",
        "2026-08-09T10:00:00Z",
        "2026-08-09T00:00:00Z",
        "2026-08-09T10:00:00.500000Z",
        None,
        None,
        None,
    ]


def test_markers_have_their_own_orders(spark):
    df = spark.createDataFrame(
        [("never", "2026-08-09T10:00:00Z", "2026-08-10"), (None, None, "x")],
        "source_updated_at string, updated_at string, updated string",
    )
    known = dates.updated_marker(F.col("source_updated_at"), F.col("updated_at"), F.col("updated"))
    raw = dates.raw_marker(F.col("updated"), F.col("updated_at"), F.col("source_updated_at"))
    assert [tuple(r) for r in df.select(known, raw).collect()] == [("2026-08-09T10:00:00Z", "2026-08-10"), (None, "x")]


def test_provenance_prefers_markup(spark):
    df = spark.createDataFrame(
        [("2026-08-09T10:00:00-04:00", "2026-08-09T09:00:00Z", None, "2026-08-10T00:00:00Z")],
        "ap string, fp string, au string, fu string",
    )
    p = dates.provenance(
        {"article_published": F.col("ap"), "feed_published": F.col("fp"), "article_updated": F.col("au"), "feed_updated": F.col("fu")}
    )
    r = df.select(p.alias("p")).select(
        "p",
        dates.chosen_date(F.col("p"), "published_at").alias("d"),
        dates.chosen_date(F.col("p"), "source_updated_at").alias("u"),
    ).first()
    assert r.d == datetime(2026, 8, 9, 14) and r.u == datetime(2026, 8, 10)
    assert r.p.article_published.confidence == "high" and r.p.feed_published.method == "recipe_feed" and r.p.article_updated.method is None


@pytest.mark.parametrize(
    ("markup", "log", "feed", "dateline", "url", "expected"),
    [
        ("2026-08-09T10:00:00-04:00", None, None, None, "https://e.com/", ("2026-08-09T14:00:00+00:00", "article_markup", "high")),
        (None, "9 Aug 2026 12:00 GMT", "2026-08-08", None, "https://e.com/", ("2026-08-09T12:00:00+00:00", "recipe_log", "high")),
        (None, None, "2026-08-08", None, "https://e.com/", ("2026-08-08T00:00:00+00:00", "recipe_feed", "high")),
        (
            "soon",
            None,
            None,
            "First published on Sun 9 Aug 2026 12.54 BST",
            "https://e.com/",
            ("2026-08-09T11:54:00+00:00", "article_text", "medium"),
        ),
        (None, None, None, "Written long ago", "https://e.com/world/2026/aug/09/story", ("2026-08-09T00:00:00+00:00", "url_path", "medium")),
        (None, None, None, None, "https://e.com/story", (None, None, None)),
    ],
)
def test_publication_date_cascade(spark, markup, log, feed, dateline, url, expected):
    df = spark.createDataFrame([(markup, log, feed, dateline, url)], "m string, l string, f string, d string, u string")
    found = dates.publication_date([F.col("m")], F.col("l"), F.col("f"), F.col("d"), F.col("u"))
    assert tuple(df.select(found.alias("p")).first().p) == expected


def test_texts(spark):
    nbsp = "a b  c\td\n \n\n e "
    assert values(spark, [nbsp], tx.bridge_body(F.col("c"))) == ["a b c d\ne"]
    assert values(spark, [nbsp], tx.ruby_words(F.col("c")), tx.python_words(F.col("c")), tx.word_count(F.col("c"))) == [(4, 5, 4)]
    assert values(spark, [" A   title\n"], tx.normalise_title(F.col("c"))) == ["A title"]
    assert values(spark, ["Ann Bell, Cy Dunn and Di Orland", None, ""], tx.authors(F.col("c"))) == [["Ann Bell", "Cy Dunn", "Di Orland"], [], []]
    assert values(spark, ["short"], tx.warnings(F.col("c"), F.lit("Please SIGN IN to continue"))) == [
        ["body_under_150_words", "possible_access_wall"]
    ]
    assert values(spark, [" ".join(f"w{i}" for i in range(60))], tx.excerpt(F.col("c"))) == [" ".join(f"w{i}" for i in range(55))]


def test_places(spark):
    df = spark.createDataFrame([({"fra": "Italie", "eng": "Italy"},), ({"fra": "Italie"},), (None,)], "m map<string,string>")
    assert [r[0] for r in df.select(places.localized(F.col("m"))).collect()] == ["Italy", "Italie", None]
    assert [r[0] for r in df.select(places.english_label(F.col("m"))).collect()] == ["Italy", None, None]
    rows = [("France", "Asia", "france"), ("Peru", "Noth America", "France"), ("Chad", "Europe", None), ("", "Africa", ""), (None, None, "France")]
    df = spark.createDataFrame(rows, "country string, continent string, event string")
    role = places.audience_role(F.col("country"), places.continent_name(F.lit(None).cast("string"), F.col("continent")), F.col("event"))
    assert [r[0] for r in df.select(role).collect()] == ["local", "audience", "audience", "excluded", "excluded"]
    assert [
        r[0] for r in df.select(places.country_name(F.lit(None).cast("string"), F.lit("country"), F.col("country"))).collect()
    ][:2] == ["France", "Peru"]
    assert values(spark, ["United States", "Peru"], places.role_by_country(F.col("c"))) == ["united_states", "international"]


HOSTS = [
    "https://foo_bar.example.com/a", "https://e.com/a b", "https://e.com/x[1]", "https://e.com/a|b", "https://e.com/100%", "https://MÜNCHEN.de/x",
    "https://[2001:DB8::1]:8080/x", "https://[::1]/", "https://2001:db8::1/a", "https://u:p@E.com:443/x", "https://e.com:/x", "http://a@b@c.org/", "//e.com/x", "ftp://e.com",
    "https://e.com?x=/y", "https://e.com#f@g.h", "https:///x", "no url", "", "mailto:x@y.z", "https://x[1].com/", "https://[bad]/", "https://[::1]x/", "  https://e.com", "ht\ntps://e.c\tom/",
]


def test_hosts_as_the_standard_library(spark):
    def plain(url):
        try:
            return urlsplit(url).hostname
        except ValueError:
            return None

    assert values(spark, [*HOSTS, None], urls.url_host(F.col("c"))) == [*map(plain, HOSTS), None]


def test_http_urls_of_the_standard(spark):
    """Only the characters of the standard; hosts may have an underscore or be IPv6 in brackets."""
    good = ["https://foo_bar.example.com/a", "http://[2001:db8::1]:8080/x", "HTTPS://E.com", "https://u:p@e.com/a%20b?q=[1]".replace("[1]", "(1)"), "https://e.com/#f"]
    bad = ["https://e.com/a b", "https://e.com/x[1]", "https://e.com/a|b", "https://e.com/100%", "https://münchen.de/", "https:///x", "ftp://e.com", "e.com", None, ""]
    got = values(spark, [*good, *bad], urls.http_url(F.col("c")), urls.http_host(F.col("c")))
    assert got == [*zip(good, ["foo_bar.example.com", "[2001:db8::1]", "e.com", "e.com", "e.com"]), *[(None, None)] * len(bad)]
