"""The registered queries of the library and their SQL.

The given tables stand for the newsroom's: pages are discovery candidates, documents are articles
(source = publisher), events are receipts (user_id = source), conversations are versions, supplier
with nation and region is the publisher registry.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import places, urls
from ..functions import text as tx
from ..operators import clusters, constraints, corpus, dossier, gate, receipts
from ..streaming import hourly

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


URL_SQL = r"""
  u AS (SELECT page_id, url, trim(url) AS t FROM pages),
  p AS (SELECT page_id, url,
      lower(regexp_extract(t, '^(https?)://', 1, 'i')) AS scheme,
      regexp_replace(regexp_extract(t, '^https?://([^/?#]*)', 1, 'i'), '^.*@', '') AS auth,
      regexp_replace(regexp_replace(regexp_extract(t, '^https?://[^/?#]*([^?#]*)', 1, 'i'), '/{2,}', '/', 'g'), '/$', '') AS path,
      regexp_extract(t, '^https?://[^/?#]*[^?#]*\?([^#]*)', 1, 'i') AS q FROM u),
  k AS (SELECT *, lower(regexp_extract(auth, '^([^:]*)', 1)) AS host, regexp_extract(auth, ':([0-9]+)$', 1) AS port,
      list_sort(list_filter(list_transform(list_filter(string_split(q, '&'), lambda x: x <> ''),
         lambda x: {'key': regexp_extract(x, '^([^=]*)', 1), 'value': regexp_extract(x, '^[^=]*=(.*)$', 1)}),
         lambda x: NOT starts_with(lower(x.key), 'utm_') AND lower(x.key) NOT IN ('fbclid','gclid','mc_cid','mc_eid','ref'))) AS kept FROM p),
  c AS (SELECT page_id, url, host, CASE WHEN scheme <> '' AND host <> '' THEN scheme || '://' || host
      || CASE WHEN port = '' OR (scheme = 'http' AND port = '80') OR (scheme = 'https' AND port = '443') THEN '' ELSE ':' || port END
      || CASE WHEN path = '' THEN '/' ELSE path END
      || CASE WHEN len(kept) = 0 THEN '' ELSE '?' || array_to_string(list_transform(kept, lambda x: x.key || '=' || x.value), '&') END END AS canonical_url FROM k)"""


@query(f"WITH {URL_SQL} SELECT page_id, canonical_url FROM c")
def url_canonical(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", urls.canonical_url(F.col("url")).alias("canonical_url"))


CAP = 120
GATE_SQL = f"""WITH {URL_SQL},
  hosts AS (SELECT DISTINCT host FROM c WHERE page_id % 10 <> 9),
  known AS (SELECT DISTINCT canonical_url FROM c WHERE page_id % 5 = 0 AND canonical_url IS NOT NULL),
  r AS (SELECT c.*, row_number() OVER (PARTITION BY c.canonical_url ORDER BY page_id) AS n, known.canonical_url IS NOT NULL AS is_known
        FROM c LEFT JOIN known ON c.canonical_url = known.canonical_url),
  j AS (SELECT *, CASE WHEN canonical_url IS NULL THEN 'invalid_url' WHEN host NOT IN (SELECT host FROM hosts WHERE host IS NOT NULL) THEN 'disallowed_host'
        WHEN n > 1 THEN 'duplicate_in_run' WHEN NOT is_known THEN 'unseen' ELSE 'known_unchanged' END AS reason FROM r),
  g AS (SELECT *, sum(CASE WHEN reason = 'unseen' THEN 1 ELSE 0 END) OVER (ORDER BY page_id) AS accepted FROM j),
  d AS (SELECT page_id, canonical_url, CASE WHEN reason = 'unseen' AND accepted > {CAP} THEN 'article_cap' ELSE reason END AS reason,
        CASE WHEN reason = 'unseen' AND accepted <= {CAP} THEN 'fetch' ELSE 'skip' END AS decision FROM g)"""


def _decisions(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("ordinal"), "url", F.lit(None).cast("string").alias("source_updated_at"))
    url = urls.canonical_url(F.col("url"))
    hosts = pages.filter("ordinal % 10 <> 9").select(urls.url_host(url).alias("host")).distinct()
    known = pages.filter("ordinal % 5 = 0").select(url.alias("canonical_url"), "source_updated_at").filter("canonical_url IS NOT NULL").distinct()
    return gate.decide(pages, known, hosts=hosts, cap=CAP)


@query(f"{GATE_SQL} SELECT page_id, canonical_url, decision, reason FROM d")
def url_gate(spark, sf_dir):
    return _decisions(spark, sf_dir).select(F.col("ordinal").alias("page_id"), "canonical_url", "decision", "reason")


@query(
    f"{
        GATE_SQL
    } SELECT count(*) AS discovered, count(*) FILTER (decision = 'fetch') AS eligible, count(*) FILTER (decision = 'skip') AS skipped FROM d"
)
def gate_counts(spark, sf_dir):
    return gate.counts(_decisions(spark, sf_dir))


NORM = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(text, chr(13) || chr(10), chr(10)), '[\t\f\x0B ]+', ' ', 'g'), ' *\n *', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')"""


@query(f"SELECT doc_id, sha256(json_object('body_text', {NORM}, 'title', source)::VARCHAR) AS content_hash, length({NORM}) AS n FROM documents")
def body_normalize_hash(spark, sf_dir):
    body = tx.normalise_body(F.col("text"))
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        tx.content_hash(body, F.col("source")).alias("content_hash"),
        F.char_length(body).cast("long").alias("n"),
    )


@query(f"SELECT doc_id, sha256(source || chr(10) || {NORM}) AS bridge_hash, sha256({NORM}) AS body_hash FROM documents")
def content_hashes(spark, sf_dir):
    body = tx.normalise_body(F.col("text"))
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.sha2(F.concat("source", F.lit("\n"), body), 256).alias("bridge_hash"),
        F.sha2(body, 256).alias("body_hash"),
    )


@query("""SELECT source, count(*) AS articles, count(*) FILTER (w >= 150) AS substantial, sum(w)::BIGINT AS words, min(w)::BIGINT AS least, max(w)::BIGINT AS most
  FROM (SELECT source, len(regexp_extract_all(text, '\\S+')) AS w FROM documents) GROUP BY source""".replace("\\\\", "\\"))
def substantial_by_source(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("source", tx.word_count(F.col("text")).cast("long").alias("w"))
    return rows.groupBy("source").agg(
        F.count(F.lit(1)).alias("articles"),
        F.count_if(F.col("w") >= tx.LEAST_WORDS).alias("substantial"),
        F.sum("w").alias("words"),
        F.min("w").alias("least"),
        F.max("w").alias("most"),
    )


@query(
    r"""SELECT doc_id, CASE WHEN len(regexp_extract_all(text, '\S+')) < 150 THEN 'insufficient' WHEN contains(lower(text), 'developing story') THEN 'provisional' ELSE 'substantial' END AS completeness FROM documents"""
)
def completeness(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.completeness(F.col("source"), F.col("text")).alias("completeness"))


@query(
    r"""SELECT doc_id, sha256(source || chr(10) || chr(10) || array_to_string(list_slice(string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' '), 1, 350), ' ')) AS contract FROM documents"""
)
def text_contract(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(tx.text_contract(F.col("source"), F.col("text")), 256).alias("contract"))


@query(
    "SELECT count(*) AS groups, coalesce(sum(n), 0)::BIGINT AS documents FROM (SELECT count(*) AS n FROM documents GROUP BY sha256(text) HAVING count(*) > 1)"
)
def duplicate_content_groups(spark, sf_dir):
    groups = table(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("h")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return groups.agg(F.count(F.lit(1)).alias("groups"), F.coalesce(F.sum("n"), F.lit(0)).alias("documents"))


@query("""SELECT o_custkey, max_by(o_orderstatus, o_orderkey) AS o_orderstatus, max(o_orderdate) AS o_orderdate,
  max_by(CASE WHEN o_totalprice > 100000 THEN o_totalprice END, CASE WHEN o_totalprice > 100000 THEN o_orderkey END) AS priced FROM orders GROUP BY o_custkey""")
def document_merge(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").withColumn("priced", F.when(F.col("o_totalprice") > 100000, F.col("o_totalprice")))
    return corpus.merge_documents(rows, ["o_custkey"], "o_orderkey", ["o_orderstatus"], ["o_orderdate"], ["priced"])


@query("""WITH h AS (SELECT doc_id, source, sha256(text) AS content_hash FROM documents),
  fresh AS (SELECT * FROM h a WHERE doc_id % 2 = 1 AND NOT EXISTS (SELECT 1 FROM h b WHERE b.doc_id % 2 = 0 AND b.content_hash = a.content_hash))
  SELECT content_hash, min(doc_id) AS doc_id, min_by(source, doc_id) AS source FROM fresh GROUP BY content_hash""")
def snapshot_insert_ignore(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", F.sha2("text", 256).alias("content_hash"))
    return corpus.insert_or_ignore(rows.filter("doc_id % 2 = 0"), rows.filter("doc_id % 2 = 1"), ["content_hash"], "doc_id")


@query(
    "SELECT conv_id, turn, role, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n = 1"
)
def latest_version(spark, sf_dir):
    return corpus.latest_version(table(spark, sf_dir, "conversations"), "conv_id", "turn").select("conv_id", "turn", "role", "text")


@query("""SELECT event_type, count(*) AS n, count(*) FILTER (published IS NULL) AS unknown_dates FROM
  (SELECT event_type, ts, CASE WHEN event_id % 7 <> 0 THEN ts END AS published FROM events)
  WHERE published >= (SELECT max(ts) FROM events) - INTERVAL 48 HOUR OR (published IS NULL AND ts >= (SELECT max(ts) FROM events) - INTERVAL 48 HOUR) GROUP BY event_type""")
def freeze_window(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(
        "event_type",
        "ts",
        F.when(F.col("event_id") % 7 != 0, F.col("ts")).alias("published"),
        F.lit(1).alias("one"),
    )
    anchor = rows.agg((F.max("ts") - F.expr("INTERVAL 48 HOURS")).alias("cutoff"), F.lit(1).alias("one"))
    frozen = rows.join(F.broadcast(anchor), "one").filter(corpus.in_window(F.col("published"), F.col("ts"), F.col("cutoff")))  # one row
    return corpus.profile(frozen, "event_type", "published")


def _slots(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumnsRenamed({"event_id": "slot_id", "user_id": "source_id", "ts": "claimed_at"})
    return e.withColumn("finished_at", F.col("claimed_at") + F.expr("INTERVAL 30 MINUTES"))


@query("SELECT date_trunc('hour', ts) AS slot_at, count(*) AS receipts, count(DISTINCT user_id) AS sources FROM events GROUP BY 1")
def hourly_cycles(spark, sf_dir):
    return receipts.hours(_slots(spark, sf_dir), "claimed_at")


MISSING_SQL = """f AS (SELECT DISTINCT date_trunc('hour', ts) AS slot_at FROM events WHERE event_type = 'purchase'),
  m AS (SELECT s AS slot_at FROM (SELECT unnest(generate_series(max(slot_at) - INTERVAL 167 HOUR, max(slot_at), INTERVAL 1 HOUR)) AS s FROM f) WHERE s NOT IN (SELECT slot_at FROM f))"""
OVERLAP_SQL = """o AS (SELECT user_id AS source_id, event_id AS slot_id, next_id FROM (SELECT *, lead(event_id) OVER w AS next_id, lead(ts) OVER w AS next_ts FROM events
  WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE ts + INTERVAL 30 MINUTE > next_ts)"""
DUPLICATE_SQL = """d AS (SELECT source AS source_id, sha256(text) AS url, count(*) AS n FROM documents GROUP BY 1, 2 HAVING count(*) > 1)"""


def _missing(spark, sf_dir):
    bought = _slots(spark, sf_dir).filter("event_type = 'purchase'")
    return receipts.missing_hours(receipts.hours(bought, "claimed_at"), 168)


def _duplicates(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(
        F.col("source").alias("source_id"),
        F.sha2("text", 256).alias("url"),
    ).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


@query(f"WITH {MISSING_SQL} SELECT slot_at FROM m")
def missing_hours(spark, sf_dir):
    return _missing(spark, sf_dir)


@query(f"WITH {OVERLAP_SQL} SELECT * FROM o")
def slot_overlap(spark, sf_dir):
    return receipts.overlaps(_slots(spark, sf_dir))


@query(f"WITH {DUPLICATE_SQL} SELECT * FROM d")
def duplicate_documents(spark, sf_dir):
    return _duplicates(spark, sf_dir)


@query(f"""WITH {MISSING_SQL}, {OVERLAP_SQL}, {DUPLICATE_SQL}
  SELECT 'missing_cycle' AS code, strftime(slot_at, '%Y-%m-%d %H:%M') AS detail FROM m
  UNION ALL SELECT 'source_overlap', source_id || ':' || slot_id || ':' || next_id FROM o
  UNION ALL SELECT 'duplicate_document', source_id || ':' || url FROM d""")
def soak_issues(spark, sf_dir):
    return receipts.issues(_missing(spark, sf_dir), receipts.overlaps(_slots(spark, sf_dir)), _duplicates(spark, sf_dir))


@query(
    "SELECT user_id AS source_id, count(*) FILTER (event_type = 'purchase') AS succeeded, count(*) FILTER (event_type = 'error') AS failed FROM events GROUP BY user_id"
)
def source_status(spark, sf_dir):
    status = F.when(F.col("event_type") == "purchase", "succeeded").when(F.col("event_type") == "error", "failed")
    return receipts.source_status(_slots(spark, sf_dir).withColumn("status", status))


PAIR_SQL = """p AS (SELECT a.grp, a.vec_id AS left_id, b.vec_id AS right_id, round(list_dot_product(a.v, b.v), 6) AS similarity
  FROM (SELECT vec_id, vec_id // 8 AS grp, embedding::DOUBLE[] AS v FROM embeddings) a JOIN (SELECT vec_id, vec_id // 8 AS grp, embedding::DOUBLE[] AS v FROM embeddings) b
  ON a.grp = b.grp AND a.vec_id < b.vec_id)"""


def _eights(spark, sf_dir):
    """Groups that SQL can name too; the pairs and centralities of the real clusters are cluster_pairs and cluster_centrality."""
    return table(spark, sf_dir, "embeddings").select(F.expr("vec_id div 8").alias("grp"), F.col("vec_id").alias("id"), "embedding")


def _pairs(spark, sf_dir):
    return dossier.group_pairs(_eights(spark, sf_dir), "grp", "id", "embedding")


@query(f"WITH {PAIR_SQL} SELECT * FROM p")
def pair_similarity(spark, sf_dir):
    return _pairs(spark, sf_dir)


@query(
    f"WITH {
        PAIR_SQL
    }, e AS (SELECT grp, left_id AS id, similarity FROM p UNION ALL SELECT grp, right_id, similarity FROM p) SELECT grp, id, round(avg(similarity), 6) AS centrality FROM e GROUP BY grp, id"
)
def centrality(spark, sf_dir):
    return dossier.centrality(_pairs(spark, sf_dir), _eights(spark, sf_dir), "grp")


@query("""WITH b AS (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY n_chars DESC, doc_id) AS p FROM documents),
  t AS (SELECT lang, source, doc_id, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS rank FROM b WHERE p = 1)
  SELECT * FROM t WHERE rank <= 6""")
def evidence_topk(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("lang", "source", "doc_id", "n_chars")
    return dossier.top_by_publisher(rows, "lang", "source", [F.desc("n_chars"), F.asc("doc_id")], 6).select(
        "lang",
        "source",
        "doc_id",
        F.col("rank").cast("long").alias("rank"),
    )


@query("""SELECT s_suppkey, CASE WHEN lower(n_name) = 'france' THEN 'local' WHEN r_name IN ('EUROPE', 'AMERICA') THEN 'audience' ELSE 'excluded' END AS role
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def audience_role(spark, sf_dir):
    registry = (
        table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(
            table(spark, sf_dir, "region"),
            F.col("n_regionkey") == F.col("r_regionkey"),
        )
    )
    # The table's region names stand for the continents that the rule knows.
    continent = F.when(F.col("r_name") == "EUROPE", "Europe").when(F.col("r_name") == "AMERICA", "North America").otherwise(F.col("r_name"))
    return registry.select("s_suppkey", places.audience_role(F.col("n_name"), continent, F.lit("France")).alias("role"))


@query("""WITH s AS (
  (SELECT o_orderkey, 0 AS search, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS rank, 'size' AS name FROM orders QUALIFY rank <= 50) UNION ALL
  (SELECT o_orderkey, 1, row_number() OVER (ORDER BY o_orderdate DESC, o_totalprice DESC, o_orderkey) AS rank, 'recent' FROM orders QUALIFY rank <= 50))
  SELECT o_orderkey, string_agg(name || ':' || rank, ',' ORDER BY search, rank) AS found FROM s GROUP BY o_orderkey""")
def discovery_union_ranks(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderdate")
    size, recent = [F.desc("o_totalprice"), F.asc("o_orderkey")], [F.desc("o_orderdate"), F.desc("o_totalprice"), F.asc("o_orderkey")]
    return dossier.union_with_ranks([("size", orders, size), ("recent", orders, recent)], "o_orderkey", 50)


@query("""SELECT 'order_customer' AS check_name, count(*) AS violations FROM orders WHERE o_custkey IS NOT NULL AND o_custkey NOT IN (SELECT c_custkey FROM customer)
  UNION ALL SELECT 'document_hash_unique', count(*) FROM (SELECT 1 FROM documents GROUP BY source, sha256(text) HAVING count(*) > 1)
  UNION ALL SELECT 'label_domain', count(*) FROM labels WHERE NOT coalesce(quality IN (0, 1) AND toxic IN (0, 1), false)
  UNION ALL SELECT 'role_domain', count(*) FROM conversations WHERE NOT coalesce(role IN ('user', 'assistant'), false)""")
def constraint_violations(spark, sf_dir):
    t = lambda name: table(spark, sf_dir, name)
    hashed = t("documents").select("source", F.sha2("text", 256).alias("h"))
    return (
        constraints.foreign_key(t("orders"), "order_customer", "o_custkey", t("customer"), "c_custkey")
        .unionByName(constraints.unique(hashed, "document_hash_unique", ["source", "h"]))
        .unionByName(constraints.domain(t("labels"), "label_domain", F.col("quality").isin(0, 1) & F.col("toxic").isin(0, 1)))
        .unionByName(constraints.domain(t("conversations"), "role_domain", F.col("role").isin("user", "assistant")))
    )


@query(r"""SELECT source, median(w) AS median_words, round(avg(CASE WHEN w >= 150 THEN 1.0 ELSE 0.0 END), 6) AS share_150, round(avg(CASE WHEN w >= 300 THEN 1.0 ELSE 0.0 END), 6) AS share_300
  FROM (SELECT source, len(regexp_extract_all(text, '\S+'))::DOUBLE AS w FROM documents) GROUP BY source""")
def qualification_report(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("source", tx.word_count(F.col("text")).cast("double").alias("w"))
    share = lambda n: F.round(F.avg(F.when(F.col("w") >= n, 1.0).otherwise(0.0)), 6)
    return rows.groupBy("source").agg(F.median("w").alias("median_words"), share(150).alias("share_150"), share(300).alias("share_300"))


@query("SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_hourly_counts(spark, sf_dir):
    return hourly.run_hourly(spark, f"{sf_dir}/events.parquet").withColumn("hour", F.col("hour").cast("timestamp_ntz"))


#: The given vectors are nearly orthogonal: the defaults of the operator would find no cluster in them.
DISTANCE = 0.6


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").cast("long").alias("id"),
        F.col("embedding").alias("v"),
        F.col("label").cast("string").alias("source"),
    )


def _members(spark, sf_dir):
    vectors = _vectors(spark, sf_dir)
    return vectors.join(clusters.average_linkage(vectors, DISTANCE), "id")


@query(f"""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings)
  SELECT a.vec_id AS left_id, b.vec_id AS right_id, round(list_dot_product(a.v, b.v), 6) AS similarity FROM v a JOIN v b ON a.vec_id < b.vec_id WHERE 1 - list_dot_product(a.v, b.v) < {DISTANCE}""")
def near_pairs(spark, sf_dir):
    return clusters.near_pairs(_vectors(spark, sf_dir), DISTANCE).select(
        F.col("a").alias("left_id"),
        F.col("b").alias("right_id"),
        F.round("similarity", 6).alias("similarity"),
    )


@query()
def average_linkage_clusters(spark, sf_dir):
    return _members(spark, sf_dir).select("id", "cluster")


@query()
def cluster_pairs(spark, sf_dir):
    return dossier.group_pairs(clusters.cut_lineage(_members(spark, sf_dir)), "cluster", "id", "v")


@query()
def cluster_centrality(spark, sf_dir):
    return dossier.cluster_centrality(clusters.cut_lineage(_members(spark, sf_dir)))


@query()
def cluster_stats(spark, sf_dir):
    return clusters.cluster_stats(_members(spark, sf_dir))


@query()
def cluster_summary(spark, sf_dir):
    members = clusters.cut_lineage(_members(spark, sf_dir))
    return clusters.run_summary(clusters.cluster_stats(members), members)


@query()
def nearest_outside(spark, sf_dir):
    return clusters.nearest_outside(clusters.cut_lineage(_members(spark, sf_dir)))
