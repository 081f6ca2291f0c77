"""Queries of tables with commits, frozen sets, canonical items and pages as trees, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import canonical, dates, html, links, urls
from ..operators import corpus, frozen, gate, records, reports
from ..sources.corpus_table import CorpusTable
from ..sources.tables import Tables, shared_folder
from ..sources.versions import Snapshots
from .catalogue import CAP, ORACLES, query, table
from .corpus_queries import _runs


def _folder(spark):
    return f"{shared_folder(spark)}/{uuid.uuid4()}"


@query("""SELECT conv_id, sha256('{"conv_id":' || conv_id || ',"turns":[' || string_agg(json_object('role', role, 'text', text, 'turn', turn)::VARCHAR, ',' ORDER BY turn, role, text) || ']}') AS item_hash
  FROM conversations GROUP BY conv_id""")
def canonical_items(spark, sf_dir):
    """Whole conversations as nested items whose fields come in any order, by the hash of their canonical JSON."""
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    items = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(turns.alias("turns"))
    written = F.to_json(F.struct("turns", "conv_id"))
    return items.select("conv_id", canonical.item_hash(written).alias("item_hash"))


@query("""SELECT doc_id, sha256('{"acquisition":' || json_object('collector', 'c/1', 'final_url', u, 'http_receipt_inferred', true, 'http_status', 200, 'recipe_path', NULL, 'requested_url', u || '?r', 'retrieved_at', '2026-08-09T10:00:00Z')::VARCHAR
    || ',"article":{"authors":' || CASE WHEN doc_id % 2 = 0 THEN '["A. Writer",' || to_json(source)::VARCHAR || ']' ELSE '[]' END || ',"canonical_url":' || to_json(u)::VARCHAR
    || ',"dates":{"published_at":' || coalesce(to_json(CASE WHEN doc_id % 3 = 0 THEN '2026-08-09T00:00:00Z' END)::VARCHAR, 'null') || '},"description":null,"language":' || to_json(coalesce(lang, 'en'))::VARCHAR
    || ',"section":' || to_json(source)::VARCHAR || ',"title":"T"},"content":' || json_object('body_text', text, 'word_count', len(regexp_extract_all(text, '\\S+')))::VARCHAR
    || ',"schema_version":"calibre-article/v1","source_slug":' || to_json(source)::VARCHAR || '}') AS payload_hash
  FROM (SELECT *, 'https://e.com/' || doc_id AS u FROM documents)""".replace("\\\\", "\\"))
def whole_payloads(spark, sf_dir):
    """Article records with all their fields as stored documents."""
    from ..functions.text import word_count

    url = F.concat(F.lit("https://e.com/"), "doc_id")
    published = F.when(F.col("doc_id") % 3 == 0, "2026-08-09T00:00:00Z")
    made = records.whole_payload(
        {
            "source_slug": F.col("source"),
            "canonical_url": url,
            "title": F.lit("T"),
            "authors": F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("A. Writer"), "source")),
            "language": F.col("lang"),
            "section": F.col("source"),
            "dates": F.struct(published.alias("published_at")),
            "body_text": F.col("text"),
            "word_count": word_count(F.col("text")),
            "requested_url": F.concat(url, F.lit("?r")),
            "retrieved_at": F.lit("2026-08-09T10:00:00Z"),
            "collector": F.lit("c/1"),
        }
    )
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(made, 256).alias("payload_hash"))


@query("""SELECT page_id,
    CASE page_id % 8 WHEN 0 THEN '2026-08-09T14:00:00+00:00' WHEN 1 THEN '2026-08-09T11:54:00+00:00' WHEN 2 THEN '2026-08-08T00:00:00+00:00' WHEN 3 THEN '2026-08-07T00:00:00+00:00'
      WHEN 4 THEN '2026-08-09T05:00:00+00:00' WHEN 5 THEN '2026-08-05T00:00:00+00:00' WHEN 6 THEN '2026-08-04T00:00:00+00:00' END AS date,
    CASE WHEN page_id % 8 < 4 THEN 'article_markup' WHEN page_id % 8 = 4 THEN 'article_text' WHEN page_id % 8 = 5 THEN 'recipe_log' WHEN page_id % 8 = 6 THEN 'url_path' END AS source,
    CASE WHEN page_id % 8 IN (4, 6) THEN 'medium' WHEN page_id % 8 < 7 THEN 'high' END AS confidence FROM pages""")
def page_publication_dates(spark, sf_dir):
    """Dates of pages from their markup, dateline, log and address. The given pages have no dates: each gets one mark
    by its id, set into its body."""
    k = F.col("page_id") % 8
    marks = [
        "<time>now</time><time datetime='2026-08-09T10:00:00-04:00'>today</time>",
        "<meta property=\"article:published_time\" content=\"9 Aug 2026 12.54 BST\">",
        "<meta name=date content=2026-08-08>",
        "<meta itemprop='datePublished' content='7 August 2026'/>",
        "<meta name=date content='no date'><div data-gu-name='dateline'>First published on <b>Sun 9 Aug</b> 2026 06.00 BST</div>",
    ]
    mark = F.lit("")
    for i, m in enumerate(marks):
        mark = F.when(k == i, m).otherwise(mark)
    pages = table(spark, sf_dir, "pages").select(
        "page_id",
        F.concat(F.lit("https://e.com/"), F.when(k == 6, "2026/08/04/").otherwise("news/"), F.lit("story")).alias("url"),
        F.when(k == 5, "5 Aug 2026").alias("logged"),
        F.regexp_replace("html", F.lit("<body>"), F.concat(F.lit("<body>"), mark)).alias("html"),
    )
    found = html.page_dates(pages)
    at = [F.element_at("marks", i) for i in range(1, len(html.DATE_MARKUP) + 2)]
    date = dates.publication_date(at[:-1], F.col("logged"), F.lit(None).cast("string"), at[-1], F.col("url"))
    return found.select("page_id", date.alias("d")).select("page_id", "d.*")


@query(r"""WITH l AS (SELECT page_id, regexp_extract(url, '^(https?://[^/?#]*)', 1) AS site, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS found FROM pages),
    e AS (SELECT page_id, site, unnest(found) AS href, generate_subscripts(found, 1) AS i FROM l),
    k AS (SELECT page_id, site || href AS link, min(i) - 1 AS position FROM e WHERE length(regexp_replace(href, '/+$', '')) >= 9
      AND NOT regexp_matches(href, '(\.jpg|\.png|\.svg|\.pdf)/*$') AND NOT regexp_matches(lower(href), '/(about|contact|privacy|terms|newsletters|podcasts|video)') GROUP BY ALL),
    c AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY position) <= 3)
  SELECT p.page_id, c.position::INT AS position, c.link, CASE WHEN c.link IS NULL THEN 'no candidate links' END AS error FROM pages p LEFT JOIN c ON p.page_id = c.page_id""")
def page_candidates(spark, sf_dir):
    """Likely articles among the links of every page (here: paths of nine characters or more), three at most."""
    return links.candidates(table(spark, sf_dir, "pages"), most=3, least_path=9).select("page_id", "position", "link", "error")


@query(ORACLES["corpus_articles"])
def corpus_commits(spark, sf_dir):
    """The articles of a corpus table after a commit for each run."""
    corpus, rows = CorpusTable(spark, _folder(spark)), _runs(spark, sf_dir)
    for run in ("run-0", "run-1"):
        corpus.commit(rows.filter(F.col("run_id") == run))
    return corpus.articles().select("url", "title", "first_seen_at", "last_seen_at", "date", "confidence")


@query(ORACLES["corpus_ingest_counters"])
def corpus_commit_counters(spark, sf_dir):
    """What each commit added."""
    corpus, rows, told = CorpusTable(spark, _folder(spark)), _runs(spark, sf_dir), None
    for run in ("run-0", "run-1"):
        one = corpus.commit(rows.filter(F.col("run_id") == run))
        told = one if told is None else told.unionByName(one)
    return told


@query("SELECT source, count(*) FILTER (doc_id < 50 AND n_chars % 2 = 0) AS deleted, count(*) FILTER (NOT (doc_id < 50 AND n_chars % 2 = 0)) AS kept FROM documents GROUP BY source")
def retention_deletes(spark, sf_dir):
    """Snapshots after retention: expired rows are gone, and only the files that held some were written again."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    kept = Snapshots(spark, _folder(spark))
    kept.append(docs.repartitionByRange(8, "doc_id"))
    kept.expire((F.col("doc_id") < 50) & (F.col("n_chars") % 2 == 0), "rights ended")
    left = kept.read().groupBy("source").agg(F.count(F.lit(1)).alias("kept"))
    before = docs.groupBy("source").agg(F.count(F.lit(1)).alias("_n"))
    n = F.coalesce("kept", F.lit(0))
    return before.join(left, "source", "left").select("source", (F.col("_n") - n).alias("deleted"), n.alias("kept"))


FROZEN_SQL = r"""r AS (SELECT '=' || doc_id AS k, text FROM documents), h AS (SELECT sha256(k) AS path, sha256(k || chr(10) || text) AS d FROM r),
    l2 AS (SELECT substr(path, 1, 2) AS node, count(*) AS n, sha256(string_agg(d, '' ORDER BY d)) AS digest FROM h GROUP BY 1),
    l1 AS (SELECT substr(node, 1, 1) AS node, sum(n)::BIGINT AS n, sha256(string_agg(node || digest, '' ORDER BY node)) AS digest FROM l2 GROUP BY 1),
    l0 AS (SELECT '' AS node, sum(n)::BIGINT AS n, sha256(string_agg(node || digest, '' ORDER BY node)) AS digest FROM l1)"""


@query(f"WITH {FROZEN_SQL} SELECT 2 AS level, * FROM l2 UNION ALL SELECT 1, * FROM l1 UNION ALL SELECT 0, * FROM l0")
def frozen_digest_tree(spark, sf_dir):
    """The digest tree of all documents; its root is the digest of the whole set."""
    return frozen.digest_tree(frozen.digested(table(spark, sf_dir, "documents"), F.col("doc_id"), F.col("text")), 2)


@query("""SELECT doc_id::VARCHAR AS key, CASE WHEN doc_id % 50 = 0 THEN 'removed' ELSE 'changed' END AS change FROM documents WHERE doc_id % 50 = 0 OR doc_id % 77 = 0
  UNION ALL SELECT 'new-' || doc_id, 'added' FROM documents WHERE doc_id % 90 = 1""")
def frozen_difference(spark, sf_dir):
    """What differs between two frozen sets, found by descending their trees."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("key"), "text", "doc_id")
    changed = docs.filter("doc_id % 50 <> 0").withColumn("text", F.when(F.col("doc_id") % 77 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    changed = changed.unionByName(docs.filter("doc_id % 90 = 1").withColumn("key", F.concat(F.lit("new-"), "key")))
    tables = Tables(spark)
    before, after = (tables.put(frozen.digested(d, F.col("key"), F.col("text"))) for d in (docs, changed))
    trees = [tables.put(frozen.digest_tree(d, 3)) for d in (before, after)]
    return frozen.differences(before, after, frozen.differing_leaves(*trees, 3), 3)


@query(r"""WITH r AS (SELECT doc_id, source, 'u' || (doc_id // 3) AS url, CASE WHEN doc_id % 11 <> 0 THEN len(regexp_extract_all(text, '\S+'))::BIGINT END AS words, doc_id, lang FROM documents)
  SELECT source, count(*) AS fetched, count(words) AS normalized, count(DISTINCT url) FILTER (words IS NOT NULL) AS unique_urls, min(words) AS min_words, median(words)::DOUBLE AS median_words, max(words) AS max_words,
    count(*) FILTER (words >= 150) AS at_least_150, count(*) FILTER (words >= 300) AS at_least_300, round(100.0 * count(*) FILTER (words >= 150) / count(words), 2)::DOUBLE AS percent_150,
    round(100.0 * count(*) FILTER (words >= 300) / count(words), 2)::DOUBLE AS percent_300, round(100.0 * count(*) FILTER (words IS NOT NULL AND doc_id % 2 = 0) / count(words), 2)::DOUBLE AS published_coverage,
    round(100.0 * count(*) FILTER (words IS NOT NULL AND doc_id % 5 = 0) / count(words), 2)::DOUBLE AS updated_coverage, round(100.0 * count(*) FILTER (words IS NOT NULL AND lang = 'en') / count(words), 2)::DOUBLE AS author_coverage,
    count(*) FILTER (doc_id % 77 = 0) AS "error_403", count(*) FILTER (doc_id % 11 = 0 AND doc_id % 77 <> 0 AND doc_id % 22 = 0) AS "error_429", count(*) FILTER (doc_id % 11 = 0 AND doc_id % 77 <> 0 AND doc_id % 22 <> 0) AS error_timeout,
    0::BIGINT AS error_paywall, 0::BIGINT AS error_login, 0::BIGINT AS error_challenge, 0::BIGINT AS error_malformed_body FROM r GROUP BY source""")
def source_qualification(spark, sf_dir):
    """The whole qualification of every source; fetches fail by their ids."""
    from ..functions.text import word_count

    k = F.col("doc_id")
    failed = k % 11 == 0
    rows = table(spark, sf_dir, "documents").select(
        "source",
        F.concat(F.lit("u"), F.expr("doc_id div 3")).alias("url"),
        F.when(~failed, word_count(F.col("text")).cast("long")).alias("words"),
        F.when(k % 2 == 0, "2026").alias("published_at"),
        F.when(k % 5 == 0, "2026").alias("updated_at"),
        F.when(F.col("lang") == "en", F.array(F.lit("A"))).alias("authors"),
        F.when(k % 77 == 0, "403").when(failed & (k % 22 == 0), "429").when(failed, "timeout").alias("error"),
    )
    return reports.qualification(rows)


@query("""WITH f AS (SELECT source AS feed, doc_id, doc_id % 3 = 0 AS kept FROM documents)
  SELECT feed, count(*) FILTER (kept) AS n, coalesce(string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) FILTER (kept), '') AS articles FROM f GROUP BY feed""")
def filtered_feeds(spark, sf_dir):
    """Feeds without the articles that are not fetched."""
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", F.concat(F.lit("u"), "doc_id").alias("url"))
    feeds = docs.groupBy(F.col("source").alias("feed")).agg(F.array_sort(F.collect_list(F.struct("doc_id", "url"))).alias("articles"))
    decisions = docs.select("url", F.when(F.col("doc_id") % 3 == 0, "fetch").otherwise("skip").alias("decision"))
    kept = gate.filter_feeds(feeds, decisions)
    said = F.array_join(F.transform("articles", lambda a: a["doc_id"].cast("string")), ",")
    return kept.select("feed", F.size("articles").cast("long").alias("n"), said.alias("articles"))


@query("""WITH v AS (SELECT o_custkey, o_orderkey, o_totalprice FROM orders) SELECT c_custkey, max(o_orderkey) AS version, max_by(o_totalprice, o_orderkey) AS price FROM customer LEFT JOIN v ON c_custkey = o_custkey GROUP BY c_custkey""")
def article_versions(spark, sf_dir):
    """Every article (customers stand for them) with its latest version (their orders)."""
    versions = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_totalprice")
    made = corpus.with_latest(table(spark, sf_dir, "customer").select("c_custkey"), versions, "c_custkey", "o_orderkey")
    return made.select("c_custkey", F.col("latest.o_orderkey").alias("version"), F.col("latest.o_totalprice").alias("price"))


@query(r"""WITH w AS (SELECT conv_id, turn, regexp_split_to_array(lower(text), '\s+') AS w FROM conversations),
    s AS (SELECT conv_id, turn, list_distinct(list_transform(range(1, greatest(len(w) - 3, 1)), lambda i: array_to_string(list_slice(w, i, i + 4), ' '))) AS s FROM w)
  SELECT a.conv_id || ':' || a.turn AS id, CASE WHEN len(a.s) > 0 THEN round(len(list_intersect(a.s, b.s)) / len(a.s), 6) ELSE 0.0 END AS overlap FROM s a JOIN s b ON a.conv_id = b.conv_id AND a.turn = b.turn + 1""")
def prose_overlap_of_turns(spark, sf_dir):
    """How much of every turn's prose the turn before it has."""
    said = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    before = said.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("source_text"))
    pairs = said.join(before, ["conv_id", "turn"]).select(F.concat_ws(":", "conv_id", "turn").alias("id"), F.col("text").alias("story"), "source_text")
    return reports.prose_overlap(pairs)


@query(ORACLES["url_gate"])
def url_gate_filtered(spark, sf_dir):
    """The decisions of url_gate, with the known state read through a filter of the run's URLs."""
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("ordinal"), "url", F.lit(None).cast("string").alias("source_updated_at"))
    url = urls.canonical_url(F.col("url"))
    hosts = pages.filter("ordinal % 10 <> 9").select(urls.url_host(url).alias("host")).distinct()
    known = pages.filter("ordinal % 5 = 0").select(url.alias("canonical_url"), "source_updated_at").filter("canonical_url IS NOT NULL").distinct()
    made = gate.decide(pages, gate.known_of_run(known, pages), hosts=hosts, cap=CAP)
    return made.select(F.col("ordinal").alias("page_id"), "canonical_url", "decision", "reason")
