"""Queries of slots, sources, policies, manifests, reports and streams, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import urls
from ..functions.text import word_count
from ..operators import constraints, manifests, policies, records, reports, slots
from ..streaming import hourly
from .catalogue import DUPLICATE_SQL, URL_SQL, _duplicates, query, table

#: Slots from receipts: one of each user and hour; what became of it is told by its first receipt.
SLOTS_SQL = """e AS (SELECT *, date_trunc('hour', ts) AS slot_at, 'u' || user_id AS slug FROM events),
  s AS (SELECT user_id AS source_id, slug, slot_at, min(event_id) AS slot_id, min(ts) AS claimed_at, max(ts) AS last, min_by(event_type, event_id) AS kind FROM e GROUP BY user_id, slug, slot_at),
  slots AS (SELECT *, CASE kind WHEN 'view' THEN 'claimed' WHEN 'error' THEN 'failed' ELSE 'succeeded' END AS status, CASE WHEN kind <> 'view' THEN last + INTERVAL 40 MINUTE END AS finished_at FROM s),
  numbered AS (SELECT *, CASE WHEN NOT (status = 'failed' AND slot_id % 2 = 0) THEN slot_id END AS run_id FROM slots),
  runs AS (SELECT slot_id AS run_id, CASE WHEN slot_id % 9 = 0 THEN source_id + 1 ELSE source_id END AS source_id, CASE WHEN slot_id % 8 = 0 THEN 'failed' ELSE status END AS status FROM slots),
  cycles AS (SELECT slot_at, CASE WHEN hour(slot_at) % 7 = 0 THEN 'running' ELSE 'completed' END AS status, coalesce(list_sort(list_distinct(list(slug) FILTER (user_id % 10 <> 0))), []) AS expected FROM e GROUP BY slot_at),
  hours AS (SELECT unnest(generate_series(max(slot_at) - INTERVAL 167 HOUR, max(slot_at), INTERVAL 1 HOUR)) AS slot_at FROM cycles)"""
ISSUES_SQL = f"""{SLOTS_SQL}, {DUPLICATE_SQL}, h AS (SELECT hours.slot_at, status, expected, strftime(hours.slot_at, '%Y-%m-%d %H:%M') AS said FROM hours LEFT JOIN cycles ON hours.slot_at = cycles.slot_at),
  w AS (SELECT * FROM numbered WHERE slot_at IN (SELECT slot_at FROM h WHERE status IS NOT NULL)),
  a AS (SELECT slot_at, list_sort(list_distinct(list(slug))) AS actual FROM w GROUP BY slot_at),
  i AS (SELECT 'missing_cycle' AS code, said AS detail FROM h WHERE status IS NULL
    UNION ALL SELECT 'cycle_not_completed', said || ':' || status FROM h WHERE status <> 'completed'
    UNION ALL SELECT 'source_receipt_mismatch', said || '|' || array_to_string(expected, ',') || '|' || array_to_string(coalesce(actual, []), ',') FROM h LEFT JOIN a ON h.slot_at = a.slot_at WHERE status IS NOT NULL AND coalesce(actual, []) <> expected
    UNION ALL SELECT 'source_slot_not_terminal', slot_id::VARCHAR FROM w WHERE status = 'claimed'
    UNION ALL SELECT 'collection_run_mismatch', slot_id || ':' || w.status || ':' || coalesce(runs.status, 'none') FROM w LEFT JOIN runs ON w.run_id = runs.run_id
      WHERE w.status <> 'claimed' AND NOT (w.status = 'failed' AND w.run_id IS NULL) AND NOT coalesce(runs.source_id = w.source_id AND runs.status = w.status, false)
    UNION ALL SELECT 'overlapping_source_runs', source_id || ':' || slot_id || ':' || next_id FROM (SELECT *, lead(slot_id) OVER o AS next_id, lead(claimed_at) OVER o AS next_claimed FROM numbered
      WHERE finished_at IS NOT NULL AND slot_at IN (SELECT slot_at FROM hours) WINDOW o AS (PARTITION BY source_id ORDER BY claimed_at, slot_id)) WHERE finished_at > next_claimed
    UNION ALL SELECT 'duplicate_canonical_document', source_id || ':' || url || ':' || n FROM d)"""


def _soak(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumns(
        {"slot_at": F.date_trunc("hour", "ts").cast("timestamp_ntz"), "slug": F.concat(F.lit("u"), "user_id")}
    )
    s = e.groupBy(F.col("user_id").alias("source_id"), "slug", "slot_at").agg(
        F.min("event_id").alias("slot_id"), F.min("ts").alias("claimed_at"), F.max("ts").alias("last"), F.min_by(
            "event_type",
            "event_id",
        ).alias("kind")
    )
    status = F.when(F.col("kind") == "view", "claimed").when(F.col("kind") == "error", "failed").otherwise("succeeded")
    s = s.withColumns({"status": status, "finished_at": F.when(F.col("kind") != "view", F.col("last") + F.expr("INTERVAL 40 MINUTES"))})
    numbered = s.withColumn("run_id", F.when(~((F.col("status") == "failed") & (F.col("slot_id") % 2 == 0)), F.col("slot_id")))
    runs = s.select(
        F.col("slot_id").alias("run_id"),
        F.when(F.col("slot_id") % 9 == 0, F.col("source_id") + 1).otherwise(F.col("source_id")).alias("source_id"),
        F.when(F.col("slot_id") % 8 == 0, "failed").otherwise(F.col("status")).alias("status"),
    )
    expected = F.array_sort(F.collect_set(F.when(F.col("user_id") % 10 != 0, F.col("slug"))))
    cycles = e.groupBy("slot_at").agg(expected.alias("expected")).withColumn(
        "status",
        F.when(F.hour("slot_at") % 7 == 0, "running").otherwise("completed"),
    )
    last = cycles.agg(F.max("slot_at").alias("last"))
    hours = last.select(F.explode(F.expr("sequence(last - INTERVAL 167 HOURS, last, INTERVAL 1 HOUR)")).alias("slot_at"))
    return hours, cycles, numbered, runs, slots.soak_issues(hours, cycles, numbered, runs, _duplicates(spark, sf_dir))


@query(f"WITH {ISSUES_SQL} SELECT * FROM i")
def soak_report(spark, sf_dir):
    """Issues of all seven kinds over the last week of receipts."""
    return _soak(spark, sf_dir)[4]


@query(f"""WITH {ISSUES_SQL} SELECT count(*) AS hours, min(slot_at) AS starts_at, max(slot_at) AS ends_at, (SELECT count(*) FROM hours WHERE slot_at IN (SELECT slot_at FROM cycles)) AS cycles_found,
    (SELECT count(*) FROM i) AS issues, (SELECT count(*) = 0 FROM i) AS passed FROM hours""")
def soak_verdict(spark, sf_dir):
    hours, cycles, _, _, issues = _soak(spark, sf_dir)
    return slots.soak_verdict(hours, cycles, issues)


@query(f"""WITH {SLOTS_SQL}, t AS (SELECT slot_at, list_sort(list_distinct(list(slug))) AS terminal FROM slots WHERE status IN ('succeeded', 'failed') GROUP BY slot_at)
  SELECT cycles.slot_at, len(expected) AS expected, len(coalesce(terminal, [])) AS terminal, expected = coalesce(terminal, []) AS completed FROM cycles LEFT JOIN t ON cycles.slot_at = t.slot_at""")
def cycle_completion(spark, sf_dir):
    _, cycles, numbered, _, _ = _soak(spark, sf_dir)
    found = slots.completed(cycles, numbered)
    return found.select("slot_at", F.size("expected").cast("long").alias("expected"), F.size("terminal").cast("long").alias("terminal"), "completed")


@query("""WITH r AS (SELECT date_trunc('hour', ts) AS slot_at, ts, list_sort(list_distinct(['u' || (user_id % 3), 'u' || (user_id % 2)])) AS slugs FROM events),
    f AS (SELECT slot_at, min(ts) AS dispatched_at, min_by(slugs, {'t': ts, 's': array_to_string(slugs, ',')}) AS expected FROM r GROUP BY slot_at)
  SELECT f.slot_at, dispatched_at, array_to_string(expected, ',') AS expected, count(*) FILTER (slugs <> expected) AS mismatches, 'dispatching' AS status FROM f JOIN r ON f.slot_at = r.slot_at GROUP BY ALL""")
def cycle_requests(spark, sf_dir):
    """Every receipt asks for its hour's cycle; the first fixes the sources."""
    name = lambda n: F.concat(F.lit("u"), (F.col("user_id") % n).cast("string"))
    asked = table(spark, sf_dir, "events").select(F.col("ts").alias("at"), F.array(name(3), name(2)).alias("source_slugs"))
    return slots.cycles(asked).withColumns({"expected": F.array_join("expected", ","), "slot_at": F.col("slot_at").cast("timestamp_ntz")})


def lease_events(events):
    """Receipts as claims and finishes of their user's slots."""
    action = F.when(F.col("event_type") == "purchase", "succeeded").when(F.col("event_type") == "error", "failed").otherwise("claim")
    at = F.col("ts").cast("timestamp")
    named = {
        "source_id": F.col("user_id"),
        "at": at,
        "seq": F.col("event_id"),
        "action": action,
        "slot_at": F.date_trunc("hour", at),
        "run_id": F.col("event_id"),
    }
    return events.select(*[c.alias(n) for n, c in named.items()])


@query()
def slot_claim_fold(spark, sf_dir):
    """The lease state of every slot after all receipts: a state machine, which SQL cannot fold."""
    return slots.fold(lease_events(table(spark, sf_dir, "events")))


@query(
    """SELECT DISTINCT s_name AS slug FROM supplier WHERE s_acctbal > 0 AND EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_returnflag = 'R' AND l_quantity >= 49)"""
)
def schedulable_sources(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    sources = s.select(F.col("s_name").alias("slug"), F.col("s_suppkey").alias("source_id"), (F.col("s_acctbal") > 0).alias("active"))
    approved = (F.col("l_returnflag") == "R") & (F.col("l_quantity") >= 49)
    drafts = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("source_id"),
        F.when(approved, "approved").otherwise("draft").alias("status"),
    )
    return policies.schedulable(sources.select("slug"), sources, drafts).distinct()


POLICY_SQL = """f AS (SELECT o_custkey AS source_id, sha256('{"o_orderpriority":"' || o_orderpriority || '"}') AS content_hash, min(o_orderkey) AS ord FROM orders GROUP BY 1, 2),
  v AS (SELECT source_id, content_hash, row_number() OVER (PARTITION BY source_id ORDER BY ord, content_hash) AS version FROM f)"""


@query(f"WITH {POLICY_SQL} SELECT *, 'draft' AS status FROM v")
def policy_versions(spark, sf_dir):
    return _policies(spark, sf_dir)


def _policies(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("source_id"), F.col("o_orderkey").alias("ord"), "o_orderpriority")
    made = policies.policy_versions(o, ["o_orderpriority"])
    return made.withColumn("version", F.col("version").cast("long"))


@query(
    f"WITH {
        POLICY_SQL
    } SELECT source_id, max(version) AS latest_version, max(version) FILTER (version % 2 = 0) AS approved_version FROM v GROUP BY source_id"
)
def latest_policies(spark, sf_dir):
    made = _policies(spark, sf_dir).withColumn("status", F.when(F.col("version") % 2 == 0, "approved").otherwise("draft"))
    return policies.latest_policy(made)


#: A sound manifest of a supplier; K stands for its number.
MANIFEST = """{"version":1,"source":{"slug":"supplier-K","name":"Supplier K","owner_name":"Owner","source_type":"primary","canonical_url":"https://s-K.example.com/"},
"recipe":{"type":"builtin","id":"supplier_K.recipe"},"discovery":{"feeds":[{"url":"https://s-K.example.com/feed"}],"allowed_hosts":{"article":["s-K.example.com"],"redirect":[]},"update_strategy":{"mode":"unseen_only"}},
"limits":{"article_cap":25,"timeout_seconds":900,"requests_per_minute":10,"max_concurrency":2},
"policy_proposal":{"status":"draft","access_method":"public_rss","endpoint_url":"https://s-K.example.com/feed","terms_url":"https://s-K.example.com/terms","robots_url":"https://s-K.example.com/robots.txt",
"retention_days":30,"allowed_uses":["discovery"],"attribution":"Supplier K"}}"""
#: By the number's remainder: what is replaced in the sound manifest, and the fault that this makes.
FAULTS = [
    ('"version":1,', '"version":2,', "version must be an integer from 1 through 1"),
    ('"limits":{', '"more":1,"limits":{', "manifest has unknown keys: more"),
    ('"owner_name":"Owner",', "", "source is missing keys: owner_name;source.owner_name must be a non-empty string"),
    ('"slug":"supplier-', '"slug":"Supplier_', "source.slug must use lower-case kebab-case"),
    (
        '"source_type":"primary"',
        '"source_type":"gossip"',
        "source.source_type must be one of: primary, licensed_reporting, public_reporting, discovery_only",
    ),
    ('"canonical_url":"https://s-', '"canonical_url":"https://me@s-', "source.canonical_url must be an HTTP(S) URL without credentials"),
    ('"id":"supplier_', '"id":"../supplier_', "recipe.id must be a .recipe filename without directories"),
    ('"type":"builtin","id"', '"type":"generic","id"', "recipe.id is not allowed for a generic recipe"),
    (
        '"feeds":[{',
        '"feeds":[],"x":[{',
        "discovery has unknown keys: x;discovery.feeds must contain between 1 and 20 items;policy_proposal.endpoint_url must match a discovery feed",
    ),
    (
        '"article":["s-',
        '"article":["other.example.com","S-',
        "discovery.allowed_hosts.article must hold lower-case hostnames;source canonical host must be in discovery.allowed_hosts.article",
    ),
    ('"redirect":[]', '"redirect":["r.example.com","r.example.com"]', "allowed hosts contains duplicates"),
    ('"mode":"unseen_only"', '"mode":"unseen_only","field":"feed_updated"', "discovery.update_strategy.field is not allowed for unseen_only"),
    ('"mode":"unseen_only"', '"mode":"trusted_marker"', "discovery.update_strategy.field must be one of: feed_updated"),
    ('"article_cap":25', '"article_cap":501', "limits.article_cap must be an integer from 1 through 500"),
    ('"max_concurrency":2', '"max_concurrency":"2"', "limits.max_concurrency must be an integer from 1 through 10"),
    ('"status":"draft"', '"status":"approved"', "policy_proposal.status must be draft"),
    ('/feed","terms_url"', '/other","terms_url"', "policy_proposal.endpoint_url must match a discovery feed"),
    ('"allowed_uses":["discovery"]', '"allowed_uses":["discovery","discovery"]', "policy_proposal.allowed_uses contains duplicates"),
    ('"retention_days":30', '"retention_days":366', "policy_proposal.retention_days must be an integer from 0 through 365"),
    ('"version":1,', '"version":1,,', "invalid JSON"),
]
FAULT_SQL = " ".join(f"WHEN {i} THEN '{fault}'" for i, (_, _, fault) in enumerate(FAULTS))


def _manifests(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", (F.col("s_suppkey") % (len(FAULTS) + 2)).alias("k"))
    made = F.replace(F.lit(MANIFEST), F.lit("K"), F.col("s_suppkey").cast("string"))
    faulty = made
    for i, (right, wrong, _) in enumerate(FAULTS):
        faulty = F.when(F.col("k") == i, F.replace(made, F.lit(right), F.lit(wrong))).otherwise(faulty)
    return s.select("s_suppkey", "s_nationkey", faulty.alias("manifest"))


@query(f"SELECT s_suppkey, CASE s_suppkey % {len(FAULTS) + 2} {FAULT_SQL} ELSE '' END AS errors FROM supplier")
def manifest_errors(spark, sf_dir):
    """Manifests of all suppliers, sound or with a fault by their number."""
    return manifests.manifest_errors(_manifests(spark, sf_dir)).select("s_suppkey", F.array_join("errors", ";").alias("errors"))


@query("SELECT 'nation-' || s_nationkey AS slug, count(*) AS n FROM supplier GROUP BY 1 HAVING count(*) > 1")
def manifest_duplicates(spark, sf_dir):
    slug = F.concat(F.lit("nation-"), F.col("s_nationkey").cast("string"))
    named = table(spark, sf_dir, "supplier").select(F.to_json(F.struct(F.struct(slug.alias("slug")).alias("source"))).alias("manifest"))
    return manifests.duplicate_slugs(manifests.manifest_errors(named))


@query("""WITH r AS (SELECT o_custkey AS source_id, count(*) AS documents, count(*) FILTER (o_orderstatus = 'F') AS succeeded, count(*) FILTER (o_orderstatus = 'O') AS failed FROM orders GROUP BY 1)
  SELECT c_custkey AS source_id, c_acctbal > 0 AS active, coalesce(documents, 0) AS documents, coalesce(succeeded, 0) AS succeeded, coalesce(failed, 0) AS failed FROM customer LEFT JOIN r ON c_custkey = source_id""")
def source_overview(spark, sf_dir):
    return _overview(spark, sf_dir)


def _overview(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("source_id"),
        F.when(F.col("o_orderstatus") == "F", "succeeded").when(F.col("o_orderstatus") == "O", "failed").alias("status"),
    )
    sources = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("source_id"), (F.col("c_acctbal") > 0).alias("active"))
    return reports.source_overview(sources, o, o)


@query(
    "SELECT (SELECT count(*) FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer)) AS documents, count(*) FILTER (c_acctbal > 0) AS active_sources, count(*) AS sources FROM customer"
)
def operations_totals(spark, sf_dir):
    return reports.totals(_overview(spark, sf_dir))


@query(
    f"""WITH {
        SLOTS_SQL
    } SELECT slot_at, count(*) AS slots, array_to_string(list_sort(list_distinct(list(slug))), ',') AS slugs FROM slots GROUP BY slot_at ORDER BY slot_at DESC LIMIT 24"""
)
def recent_cycles(spark, sf_dir):
    """A report of the last 24 hours: the limit is the feature."""
    return reports.recent_cycles(_soak(spark, sf_dir)[2])


@query("""WITH r AS (SELECT user_id AS run_id, min(ts) AS started_at, max(ts) AS finished_at, CASE WHEN user_id % 4 = 0 THEN 1 ELSE 0 END AS code, user_id % 8 = 0 AS late, CASE WHEN user_id % 5 = 0 THEN 1 ELSE 0 END AS errors,
      count(*) FILTER (event_type IN ('click', 'view')) AS discovered, count(*) FILTER (event_type = 'click' AND user_id % 3 <> 0) AS eligible, count(*) FILTER (event_type = 'purchase') AS made FROM events GROUP BY user_id),
    o AS (SELECT *, CASE WHEN discovered > 0 AND eligible = 0 AND (code = 0 OR NOT late) THEN 'no_changes' WHEN code = 0 THEN 'succeeded' ELSE 'failed' END AS outcome FROM r),
    x AS (SELECT *, CASE WHEN outcome = 'no_changes' THEN 0 ELSE code END AS exit_code FROM o)
  SELECT run_id, outcome, exit_code, discovered, eligible, discovered - eligible AS skipped, CASE WHEN outcome = 'succeeded' THEN made ELSE 0 END AS normalized,
    round(epoch_us(finished_at) / 1e6 - epoch_us(started_at) / 1e6, 6) AS elapsed_seconds, exit_code = 0 AND outcome IN ('succeeded', 'no_changes') AND errors = 0 AS successful FROM x""")
def run_reports(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("run_id", F.col("user_id"))
    k = F.col("run_id")
    runs = e.groupBy("run_id").agg(
        F.min(F.col("ts").cast("timestamp")).alias("started_at"),
        F.max(F.col("ts").cast("timestamp")).alias("finished_at"),
    )
    runs = runs.select(
        "*",
        F.when(k % 4 == 0, 1).otherwise(0).alias("exit_code"),
        (k % 8 == 0).alias("timed_out"),
        F.when(k % 5 == 0, 1).otherwise(0).alias("errors"),
    )
    fetched = (F.col("event_type") == "click") & (k % 3 != 0)
    decisions = e.filter("event_type IN ('click', 'view')").select("run_id", F.when(fetched, "fetch").otherwise("skip").alias("decision"))
    return reports.run_reports(runs, decisions, e.filter("event_type = 'purchase'").select("run_id"))


#: The edition of a New York morning: 24 hours to 2:00, three days before a Monday's.
@query("""WITH n AS (SELECT event_id, timezone('America/New_York', timezone('UTC', ts)) - INTERVAL 2 HOUR AS local, event_id % 7 = 0 AS fallback FROM events),
    d AS (SELECT event_id, local::DATE + 1 AS day, fallback FROM n)
  SELECT event_id, CASE dayofweek(day) WHEN 6 THEN day + 2 WHEN 0 THEN day + 1 ELSE day END::DATE AS edition, fallback FROM d""")
def edition_candidates(spark, sf_dir):
    seen = F.col("ts").cast("timestamp")
    e = table(spark, sf_dir, "events").select("event_id", reports.edition_of(F.when(F.col("event_id") % 7 != 0, seen), seen).alias("e"))
    return e.select("event_id", "e.*")


@query("""WITH h AS (SELECT doc_id // 4 AS cluster, sha256(array_to_string(list_sort(list_distinct(list(sha256(text)))), ',')) AS member_hash FROM documents GROUP BY 1)
  SELECT cluster, member_hash FROM h WHERE member_hash NOT IN (SELECT member_hash FROM h WHERE cluster % 3 = 0)""")
def clusters_to_score(spark, sf_dir):
    """Clusters (four ids) whose members differ from all that were scored (every third)."""
    c = table(spark, sf_dir, "documents").select(F.expr("doc_id div 4").alias("cluster"), F.sha2("text", 256).alias("content_hash"))
    nothing = c.limit(0).select(F.col("content_hash").alias("member_hash"))
    hashed = reports.to_score(c, nothing)
    return reports.to_score(c, hashed.filter("cluster % 3 = 0"))


@query(
    "SELECT o_orderkey FROM orders WHERE o_orderdate + INTERVAL 1 DAY * (o_custkey % 366) < (SELECT max(o_orderdate) FROM orders) - INTERVAL 365 DAY"
)
def expired_snapshots(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    rows = o.select("o_orderkey", F.col("o_orderdate").alias("retrieved_at"), (F.col("o_custkey") % 366).cast("int").alias("retention_days"))
    now = o.agg((F.max("o_orderdate") - F.expr("INTERVAL 365 DAYS")).alias("now"))
    return reports.expired(rows.crossJoin(F.broadcast(now)), F.col("now")).select("o_orderkey")  # one row


@query("""WITH h AS (SELECT user_id, event_id, md5(event_id::VARCHAR) AS h, lag(md5(event_id::VARCHAR)) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events)
  SELECT event_id FROM h WHERE event_id % 50 = 0 AND before IS NOT NULL""")
def chain_breaks(spark, sf_dir):
    """Audit events whose hash of the one before is lost (every fiftieth)."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.md5(F.col("event_id").cast("string")).alias("event_hash"))
    before = F.lag("event_hash").over(slots.Window.partitionBy("user_id").orderBy("event_id"))
    chained = e.withColumn("previous_hash", F.when(F.col("event_id") % 50 != 0, before))
    return reports.chain_breaks(chained, "user_id", "event_id").select("event_id")


@query(
    f"""WITH {
        URL_SQL
    } SELECT host AS feed, count(*) AS entries, sha256(array_to_string(list_sort(list_distinct(list(sha256(canonical_url || '|' || page_id)))), '')) AS fingerprint FROM c GROUP BY host"""
)
def feed_fingerprints(spark, sf_dir):
    url = urls.canonical_url(F.col("url"))
    p = table(spark, sf_dir, "pages").select(
        url.alias("url"),
        F.col("page_id").cast("string").alias("updated"),
    ).withColumn("feed", urls.url_host(F.col("url")))
    return reports.feed_fingerprints(p)


@query("""WITH t AS (SELECT lang, doc_id, sum(n_chars // 20) OVER w AS read_seconds, row_number() OVER w AS position FROM documents WINDOW w AS (PARTITION BY lang ORDER BY doc_id ROWS UNBOUNDED PRECEDING))
  SELECT lang, doc_id, read_seconds::BIGINT AS read_seconds, position FROM t WHERE read_seconds <= 2700 AND position <= 10""")
def reading_budget(spark, sf_dir):
    """The stories of each edition (a language) within 45 minutes and ten stories."""
    d = table(spark, sf_dir, "documents").select("lang", "doc_id", F.expr("n_chars div 20").alias("reading_seconds"))
    kept = reports.within_budget(d, "lang", [F.col("doc_id")], 2700, 10)
    return kept.select("lang", "doc_id", "read_seconds", F.col("position").cast("long").alias("position"))


@query(r"""WITH w AS (SELECT conv_id, turn, regexp_split_to_array(lower(text), '\s+') AS w FROM conversations),
    s AS (SELECT conv_id, turn, list_distinct(list_transform(range(1, greatest(len(w) - 3, 1)), lambda i: array_to_string(list_slice(w, i, i + 4), ' '))) AS s FROM w)
  SELECT a.conv_id AS id, CASE WHEN len(a.s) > 0 THEN round(len(list_intersect(a.s, b.s)) / len(a.s), 6) ELSE 0.0 END AS overlap FROM s a JOIN s b ON a.conv_id = b.conv_id AND a.turn = 0 AND b.turn = 1""")
def prose_overlap(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    a = c.filter("turn = 0").select(F.col("conv_id").alias("id"), F.col("text").alias("story"))
    b = c.filter("turn = 1").select(F.col("conv_id").alias("id"), F.col("text").alias("source_text"))
    return reports.prose_overlap(a.join(b, "id"))


@query("SELECT user_id AS source_id, date_trunc('hour', ts) AS slot_at FROM events GROUP BY ALL")
def stream_slots(spark, sf_dir):
    """Each source-hour of the stream of receipts once, however often it is delivered."""
    at = F.col("ts").cast("timestamp")
    received = hourly.read_stream(spark, f"{sf_dir}/events.parquet").select(
        F.col("user_id").alias("source_id"),
        F.date_trunc("hour", at).alias("slot_at"),
        at.alias("at"),
    )
    once = hourly.run_to_table(spark, hourly.delivered_once(received).select("source_id", "slot_at"), "append")
    return once.select("source_id", F.col("slot_at").cast("timestamp_ntz").alias("slot_at"))


@query(f"""WITH {URL_SQL}, s AS (SELECT DISTINCT canonical_url FROM c WHERE page_id % 5 = 0)
  SELECT page_id, CASE WHEN c.canonical_url IS NULL THEN 'invalid_url' WHEN s.canonical_url IS NULL THEN 'unseen' ELSE 'known_unchanged' END AS reason,
    CASE WHEN c.canonical_url IS NOT NULL AND s.canonical_url IS NULL THEN 'fetch' ELSE 'skip' END AS decision FROM c LEFT JOIN s ON c.canonical_url = s.canonical_url""")
def stream_gate(spark, sf_dir):
    """The pages as a stream against the known state (every fifth page), a static table."""
    path = f"{sf_dir}/pages.parquet"
    url = urls.canonical_url(F.col("url"))
    known = spark.read.parquet(path).filter("page_id % 5 = 0").select(url.alias("canonical_url")).distinct()
    candidates = hourly.read_stream(spark, path).select("page_id", url.alias("canonical_url"))
    return hourly.run_to_table(spark, hourly.gate_stream(candidates, known), "append").select("page_id", "reason", "decision")


@query()
def stream_leases(spark, sf_dir):
    """The lease state of every slot, kept by a stream of receipts."""
    received = lease_events(hourly.read_stream(spark, f"{sf_dir}/events.parquet"))
    return hourly.latest_slots(hourly.run_to_table(spark, hourly.lease_stream(received), "update"))


@query(r"""SELECT doc_id, sha256('{"acquisition":{"final_url":"https://e.com/' || doc_id || '","http_status":200,"requested_url":"https://e.com/' || doc_id || '?r","retrieved_at":"2026-08-09T10:00:00Z"},"article":{"canonical_url":"https://e.com/'
    || doc_id || '","language":"' || coalesce(lang, 'en') || '","title":"T"},"content":{"body_text":' || to_json(text) || ',"word_count":' || len(regexp_extract_all(text, '\S+')) || '},"schema_version":"calibre-article/v1","source_slug":"' || source || '"}') AS payload_hash FROM documents""")
def article_payloads(spark, sf_dir):
    url = F.concat(F.lit("https://e.com/"), "doc_id")
    made = records.article_payload(
        F.col("source"),
        url,
        F.lit("T"),
        F.col("text"),
        word_count(F.col("text")),
        F.col("lang"),
        F.lit("2026-08-09T10:00:00Z"),
        F.concat(url, F.lit("?r")),
    )
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(made, 256).alias("payload_hash"))


@query(
    """SELECT event_id, 1 + (event_id % 3 = 0)::INT AS kept, '{' || CASE WHEN event_id % 2 = 0 THEN '"kind":"' || event_type || '",' ELSE '' END || '"user":' || user_id || '}' AS metadata FROM events"""
)
def kept_metadata(spark, sf_dir):
    """Headers of the allowed names, and metadata without nulls."""
    k = F.col("event_id")
    headers = F.create_map(F.lit("ETag"), F.lit("x"), F.lit("Set-Cookie"), F.lit("y"), F.when(k % 3 == 0, "Date").otherwise("X-Date"), F.lit("z"))
    metadata = records.without_nulls({"user": F.col("user_id"), "kind": F.when(k % 2 == 0, F.col("event_type"))})
    return table(spark, sf_dir, "events").select("event_id", F.size(records.kept_headers(headers)).alias("kept"), metadata.alias("metadata"))


@query(
    "SELECT o_custkey, p_type, count(*) AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2"
)
def traversals(spark, sf_dir):
    """Orders to parts through their lines: documents of clusters, claims of stories, stories of editions."""
    link = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("p_partkey"))
    left, right = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), table(spark, sf_dir, "part").select("p_partkey", "p_type")
    return records.traverse(left, link, right, "o_orderkey", "p_partkey").groupBy("o_custkey", "p_type").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'Customer' WHEN 1 THEN 'Supplier' ELSE 'Story' END AS subject_type,
    CASE event_id % 3 WHEN 0 THEN user_id IN (SELECT c_custkey FROM customer) WHEN 1 THEN user_id IN (SELECT s_suppkey FROM supplier) ELSE false END AS found FROM events""")
def audit_subjects(spark, sf_dir):
    k = F.col("event_id") % 3
    events = table(spark, sf_dir, "events").select(
        "event_id",
        F.when(k == 0, "Customer").when(k == 1, "Supplier").otherwise("Story").alias("subject_type"),
        F.col("user_id").alias("subject_id"),
    )
    tables = {"Customer": table(spark, sf_dir, "customer").select("c_custkey"), "Supplier": table(spark, sf_dir, "supplier").select("s_suppkey")}
    return records.subjects(events, tables).select("event_id", "subject_type", "found")


@query("""WITH c AS (SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'attributed' WHEN 1 THEN 'rumour' ELSE 'confirmed' END AS status, CASE WHEN s_suppkey % 8 = 0 THEN 'A' END AS attributed_to FROM supplier),
    e AS (SELECT event_id, value / 100 AS confidence, user_id, ts FROM events)
  SELECT 'claims.status' AS check_name, count(*) FILTER (status = 'rumour') AS violations FROM c UNION ALL SELECT 'claims.attributed_to_someone', count(*) FILTER (status = 'attributed' AND attributed_to IS NULL) FROM c
  UNION ALL SELECT 'evidence_items.confidence', count(*) FILTER (NOT confidence BETWEEN 0 AND 1) FROM e
  UNION ALL SELECT 'news_collection_cycles.slot_at_unique', (SELECT count(*) FROM (SELECT 1 FROM e GROUP BY date_trunc('hour', ts) HAVING count(*) > 1))
  UNION ALL SELECT 'news_collection_cycles.status', 0 UNION ALL SELECT 'news_collection_cycles.on_the_hour', 0
  UNION ALL SELECT 'news_collection_cycles.finished_if_completed', count(*) FILTER (user_id % 2 = 0) FROM e UNION ALL SELECT 'news_collection_cycles.sorted_sources', count(*) FILTER (user_id % 10 > 4) FROM e""")
def model_checks(spark, sf_dir):
    """The data model's checks on suppliers as claims and receipts as evidence and cycles, with faults by their numbers."""
    s, e = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "events")
    k = F.col("s_suppkey")
    claims = s.select(
        F.when(k % 4 == 0, "attributed").when(k % 4 == 1, "rumour").otherwise("confirmed").alias("status"),
        F.when(k % 8 == 0, "A").alias("attributed_to"),
    )
    evidence = e.select((F.col("value") / 100).alias("confidence"))
    cycles = e.select(
        F.date_trunc("hour", "ts").alias("slot_at"), F.lit("completed").alias("status"), F.when(
            F.col("user_id") % 2 != 0,
            F.col("ts"),
        ).alias("finished_at"),
        F.array(F.lit("e"), F.when(F.col("user_id") % 10 > 4, "a").otherwise("z")).alias("expected_source_slugs"),
    )
    return constraints.check_model({"claims": claims, "evidence_items": evidence, "news_collection_cycles": cycles})
