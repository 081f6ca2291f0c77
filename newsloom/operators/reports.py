"""Reports of runs, sources and operations, and what the documents promise but no code does yet (editions,
retention, re-scoring, hash chains, reading budgets)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import bound
from ..sources.tables import Tables

NEW_YORK = "America/New_York"


def run_outcome(exit_code: Column, timed_out: Column, discovered: Column, eligible: Column) -> Column:
    """no_changes if something was discovered and nothing was to be fetched (unless the run timed out), else succeeded or failed by the exit code."""
    idle = (discovered > 0) & (eligible == 0)
    return F.when(idle & ((exit_code == 0) | ~timed_out), "no_changes").when(exit_code == 0, "succeeded").otherwise("failed")


def run_reports(runs: DataFrame, decisions: DataFrame, articles: DataFrame) -> DataFrame:
    """The report of every run: outcome, exit code after it, counts and whether it succeeded.

    runs: run_id, started_at, finished_at, exit_code, timed_out, errors. decisions: run_id, decision. articles: run_id.
    """
    counted = decisions.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("discovered"), F.count_if(
            F.col("decision") == "fetch"
        ).alias("eligible"), F.count_if(F.col("decision") == "skip").alias("skipped")
    )
    made = articles.groupBy("run_id").agg(F.count(F.lit(1)).alias("_n"))
    rows = runs.join(counted, "run_id", "left").join(made, "run_id", "left").fillna(0, ["discovered", "eligible", "skipped", "_n"])
    rows = rows.withColumn("outcome", run_outcome(F.col("exit_code"), F.col("timed_out"), F.col("discovered"), F.col("eligible")))
    after = F.when(F.col("outcome") == "no_changes", 0).otherwise(F.col("exit_code"))
    elapsed = F.round(F.unix_micros(F.col("finished_at")) / 1e6 - F.unix_micros(F.col("started_at")) / 1e6, 6)
    return rows.select(
        "run_id", "outcome", after.alias("exit_code"), "discovered", "eligible", "skipped", F.when(
            F.col("outcome") == "succeeded",
            F.col("_n"),
        ).otherwise(0).alias("normalized"),
        elapsed.alias("elapsed_seconds"), (
            (after == 0) & F.col("outcome").isin("succeeded", "no_changes") & (F.col("errors") == 0)
        ).alias("successful"),
    )


def run_status(successful: Column, error_class: Column, message: Column) -> Column:
    """succeeded, or failed with the class and the message's first 2,000 characters."""
    none = F.lit(None).cast("string")
    return F.struct(
        F.when(successful, "succeeded").otherwise("failed").alias("status"),
        F.when(successful, none).otherwise(error_class).alias("error_class"),
        F.when(successful, none).otherwise(F.substring(message, 1, 2000)).alias("error_message"),
    )


def access_result(status: Column, text: Column, title: Column) -> Column:
    """Why a fetched page is no article, else null."""
    return (
        F.when(status.isin(401, 403, 429), F.concat(F.lit("explicit access response "), status.cast("string")))
        .when(status >= 400, F.concat(F.lit("HTTP "), status.cast("string")))
        .when(F.coalesce(F.trim(text), F.lit("")) == "", "no article text extracted")
        .when(F.coalesce(F.trim(title), F.lit("")) == "", "no title extracted")
    )


def source_report(candidates: DataFrame) -> DataFrame:
    """candidates, collected, dated and the sorted distinct errors of every source, from rows (source, error, dated)."""
    return candidates.groupBy("source").agg(
        F.count(F.lit(1)).alias("candidates"),
        F.count_if(F.col("error").isNull()).alias("collected"),
        F.count_if(F.col("error").isNull() & F.col("dated")).alias("dated"),
        F.array_join(F.array_sort(F.collect_set("error")), ",").alias("errors"),
    )


def source_overview(sources: DataFrame, documents: DataFrame, runs: DataFrame) -> DataFrame:
    """documents, succeeded and failed runs of every source; each child is counted before it is joined."""
    written = documents.groupBy("source_id").agg(F.count(F.lit(1)).alias("documents"))
    ran = runs.groupBy("source_id").agg(
        F.count_if(F.col("status") == "succeeded").alias("succeeded"),
        F.count_if(F.col("status") == "failed").alias("failed"),
    )
    return sources.select("source_id", "active").join(written, "source_id", "left").join(ran, "source_id", "left").fillna(
        0,
        ["documents", "succeeded", "failed"],
    )


def totals(overview: DataFrame) -> DataFrame:
    return overview.agg(
        F.coalesce(F.sum("documents"), F.lit(0)).alias("documents"),
        F.count_if("active").alias("active_sources"),
        F.count(F.lit(1)).alias("sources"),
    )


def recent_cycles(slots: DataFrame, most: int = 24) -> DataFrame:
    """The latest ``most`` hours with the slugs of their slots in order."""
    by_hour = slots.groupBy("slot_at").agg(F.count(F.lit(1)).alias("slots"), F.array_join(F.array_sort(F.collect_set("slug")), ",").alias("slugs"))
    return by_hour.orderBy(F.desc("slot_at")).limit(most)


def grouped_digest(rows: DataFrame, group: str, key: str, digest: str, rows_per_digest: int = 1000) -> DataFrame:
    """rows, undated rows and one digest for every group: digests of the rows in the order of their keys, taken
    over ranges of ``rows_per_digest`` keys and then over the ranges, so that no list holds a whole group."""
    ranged = rows.groupBy(group, F.expr(f"{key} div {rows_per_digest}").alias("_range")).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("published_at").isNull()).alias("unknown_dates"),
        F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key, digest))), lambda x: x[digest]), ""), 256).alias("_d"),
    )
    parts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_range", "_d"))), lambda x: x["_d"]), "")
    return ranged.groupBy(group).agg(F.sum("n").alias("n"), F.sum("unknown_dates").alias("unknown_dates"), F.sha2(parts, 256).alias("digest"))


def numbered_clusters(stats: DataFrame) -> DataFrame:
    """``stats`` (n_sources, size, mean_similarity, title, ...) with number: from 1, most sources first, then
    largest, most similar, title. The clusters are ranked by sampled ranges of that order, not in one window."""
    order = [F.desc("n_sources"), F.desc("size"), F.desc("mean_similarity"), F.asc("title")]
    # Written before it is read twice: ranges that are sampled anew would number otherwise.
    ranged = stats.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    ranged = Tables(stats.sparkSession).put(ranged)
    part = ranged.withColumn("_part", F.shiftright("_at", 33))
    counts = part.groupBy("_part").agg((F.max("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return part.join(F.broadcast(offsets), "_part").withColumn(
        "number",
        F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1,
    ).drop("_at", "_part", "_before")


def select_case(numbered: DataFrame, members: DataFrame, case: str) -> DataFrame:
    """The members of ``cluster:N`` (its number in the order) or of ``singleton:URL`` (which must be in no cluster)."""
    kind, _, value = case.partition(":")
    if kind == "cluster":
        return members.join(numbered.filter(F.col("number") == int(value)).select("cluster"), "cluster", "left_semi")
    if kind == "singleton":
        return members.filter(F.col("url") == value).join(numbered.select("cluster"), "cluster", "left_anti")
    raise ValueError("a case is cluster:N or singleton:URL")


def edition_window(edition: Column) -> Column:
    """(from, to) of the candidates of a weekday's edition: the 24 hours to 2:00 in New York, on Mondays 72 hours; null at weekends."""
    to = F.to_utc_timestamp(F.concat(F.date_format(edition, "yyyy-MM-dd"), F.lit(" 02:00:00")), NEW_YORK)
    days = F.when(F.dayofweek(edition) == 2, 3).when(F.dayofweek(edition).between(3, 6), 1)
    start = F.to_utc_timestamp(F.concat(F.date_format(F.date_sub(edition, days), "yyyy-MM-dd"), F.lit(" 02:00:00")), NEW_YORK)
    return F.when(days.isNotNull(), F.struct(start.alias("from"), to.alias("to")))


def edition_of(published_at: Column, first_seen_at: Column) -> Column:
    """(edition, fallback): the date of the weekday edition that an article is a candidate for, by its date or, if it has none, by when it was first seen."""
    at = F.from_utc_timestamp(F.coalesce(published_at, first_seen_at), NEW_YORK)
    day = F.date_add(F.to_date(at - F.expr("INTERVAL 2 HOURS")), 1)  # the first edition after it
    weekday = F.dayofweek(day)
    return F.struct(
        F.when(weekday == 7, F.date_add(day, 2)).when(weekday == 1, F.date_add(day, 1)).otherwise(day).alias("edition"),
        published_at.isNull().alias("fallback"),
    )


def to_score(clusters: DataFrame, scored: DataFrame) -> DataFrame:
    """The clusters whose set of members has not been scored: cluster, member_hash. clusters: cluster, content_hash."""
    hashed = clusters.groupBy("cluster").agg(F.sha2(F.array_join(F.array_sort(F.collect_set("content_hash")), ","), 256).alias("member_hash"))
    return hashed.join(scored.select("member_hash").distinct(), "member_hash", "left_anti").select("cluster", "member_hash")


def expired(snapshots: DataFrame, now: Column) -> DataFrame:
    """The snapshots past their policy's retention: retrieved_at + retention_days before ``now``."""
    return snapshots.filter(F.col("retrieved_at") + F.make_dt_interval(days=F.col("retention_days")) < now)


def chain_breaks(events: DataFrame, subject: str, order: str) -> DataFrame:
    """The audit events whose previous_hash is not the hash of the subject's event before (null for the first)."""
    before = F.lag("event_hash").over(Window.partitionBy(subject).orderBy(order))
    return events.withColumn("_before", before).filter(~F.col("previous_hash").eqNullSafe(F.col("_before"))).drop("_before")


def feed_fingerprints(entries: DataFrame) -> DataFrame:
    """One digest of every feed's entries, whatever their order: what tells that a feed has not changed."""
    each = F.sha2(F.concat_ws("|", "url", "updated"), 256)
    return entries.groupBy("feed").agg(
        F.count(F.lit(1)).alias("entries"),
        F.sha2(F.array_join(F.array_sort(F.collect_set(each)), ""), 256).alias("fingerprint"),
    )


#: Body lengths in words whose shares a qualification tells, and classes of errors that it counts: fixed values.
QUALIFYING_WORDS = (150, 300)
ERROR_CLASSES = ("403", "429", "timeout", "paywall", "login", "challenge", "malformed_body")


def qualification(rows: DataFrame) -> DataFrame:
    """What the qualification of each source tells, from rows (source, url, words, published_at, updated_at,
    authors, error; words are null where a fetch failed)."""
    n = F.count("words")
    percent = lambda x: F.round(F.try_divide(100 * x, n), 2)
    least = [(w, F.count_if(F.col("words") >= w)) for w in QUALIFYING_WORDS]
    got = F.col("words").isNotNull()
    named = {"published": F.col("published_at").isNotNull(), "updated": F.col("updated_at").isNotNull(), "author": F.coalesce(F.size("authors") > 0, F.lit(False))}
    return rows.groupBy("source").agg(
        F.count(F.lit(1)).alias("fetched"),
        n.alias("normalized"),
        F.count_distinct(F.when(got, F.col("url"))).alias("unique_urls"),
        F.min("words").alias("min_words"),
        F.median("words").alias("median_words"),
        F.max("words").alias("max_words"),
        *[c.alias(f"at_least_{w}") for w, c in least],
        *[percent(c).alias(f"percent_{w}") for w, c in least],
        *[percent(F.count_if(got & test)).alias(f"{name}_coverage") for name, test in named.items()],
        *[F.count_if(F.col("error") == e).alias(f"error_{e}") for e in ERROR_CLASSES],
    )


def within_budget(stories: DataFrame, edition: str, order: list[Column], seconds: int, most: int) -> DataFrame:
    """The first stories of every edition that fit its reading time and number, with the time read so far."""
    along = Window.partitionBy(edition).orderBy(*order)
    timed = stories.withColumns(
        {"read_seconds": F.sum("reading_seconds").over(along.rowsBetween(Window.unboundedPreceding, 0)), "position": F.row_number().over(along)}
    )
    return timed.filter((F.col("read_seconds") <= seconds) & (F.col("position") <= most))


def prose_overlap(pairs: DataFrame, words: int = 5) -> DataFrame:
    """id and the share of a story's n-word sequences that its source's text has too (0 for shorter stories).
    pairs: id, story, source_text."""

    def shingles(said: Column) -> Column:
        places = lambda w: F.filter(F.sequence(F.lit(1), F.size(w) - words + 1), lambda i: i <= F.size(w) - words + 1)
        one = lambda w: F.transform(places(w), lambda i: F.array_join(F.slice(w, i, words), " "))
        return F.array_distinct(bound(F.split(F.lower(said), r"\s+"), lambda w: F.when(F.size(w) >= words, one(w)).otherwise(F.array().cast("array<string>"))))

    made = pairs.select("id", shingles(F.col("story")).alias("_a"), shingles(F.col("source_text")).alias("_b"))
    share = F.when(F.size("_a") > 0, F.round(F.size(F.array_intersect("_a", "_b")) / F.size("_a"), 6)).otherwise(0.0)
    return made.select("id", share.alias("overlap"))
