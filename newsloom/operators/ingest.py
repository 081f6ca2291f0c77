"""Ingest of collected records: checks that isolate bad records, joins of receipts, corpus and document state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import bridge_time, strict_time, time_error
from ..functions.text import normalise_body, normalise_title
from ..functions.urls import canonical_url, http_host, http_url

#: Longest message of an error receipt, in characters.
MOST_MESSAGE = 500


def url_error(url: Column, field: str, hosts: Column) -> Column:
    """A message where a URL is no http(s) URL with one of ``hosts`` (array), else null."""
    allowed = F.array_contains(hosts, http_host(url))
    return F.when(http_url(url).isNull(), F.lit(f"{field} must be an HTTP URL")).when(
        ~F.coalesce(allowed, F.lit(False)),
        F.lit(f"{field} host is not allowed"),
    )


def identity_error(version: Column, expected_version: str, slug: Column, expected_slug: Column) -> Column:
    """A message where a record is of another schema version or another source."""
    return F.when(~version.eqNullSafe(F.lit(expected_version)), F.lit("unsupported schema_version")).when(
        ~slug.eqNullSafe(expected_slug), F.concat(F.lit("source_slug does not match "), expected_slug)
    )


def context_error(source: Column, policy_source: Column, run_source: Column, policy: Column, run_policy: Column, status: Column) -> Column:
    """A message where source, policy and run do not belong together or the policy is not approved."""
    together = policy_source.eqNullSafe(source) & run_source.eqNullSafe(source) & run_policy.eqNullSafe(policy)
    return F.when(~together, "source, policy, and collection run must match").when(
        ~status.eqNullSafe(F.lit("approved")),
        "source policy must be approved",
    )


def article_error(hosts: Column) -> Column:
    """The first fault of an article record (canonical_url, requested_url, title, body, retrieved_at and four dates), else null."""
    dates = [time_error(F.col(d), f"dates.{d}") for d in ("article_published", "feed_published", "article_updated", "feed_updated")]
    return F.coalesce(
        url_error(F.col("canonical_url"), "canonical_url", hosts),
        url_error(F.col("requested_url"), "requested_url", hosts),
        F.when(F.coalesce(normalise_title(F.col("title")), F.lit("")) == "", "title is blank"),
        F.when(F.coalesce(normalise_body(F.col("body")), F.lit("")) == "", "body text is blank"),
        *dates,
        F.when(strict_time(F.col("retrieved_at")).isNull(), "acquisition.retrieved_at is not a valid time"),
    )


def observation_error() -> Column:
    """The first fault of a discovery decision (decision, feed_published, feed_updated), else null."""
    late = F.coalesce(*[time_error(F.col(d), "discovery date") for d in ("feed_published", "feed_updated")])
    return F.coalesce(F.when(~F.coalesce(F.col("decision").isin("fetch", "skip"), F.lit(False)), "unsupported discovery decision"), late)


def isolate(rows: DataFrame, kind: str, index: str, error: Column) -> tuple[DataFrame, DataFrame]:
    """(rows without a fault, error receipts of the others): one bad record never stops its siblings."""
    judged = rows.withColumn("_error", error)
    receipts = judged.filter("_error IS NOT NULL").select(
        F.lit(kind).alias("kind"), F.col(index).cast("long").alias("index"), F.lit("InvalidRecord").alias("error_class"), F.substring(
            "_error",
            1,
            MOST_MESSAGE,
        ).alias("error_message")
    )
    return judged.filter("_error IS NULL").drop("_error"), receipts


def with_document(observations: DataFrame, documents: DataFrame) -> DataFrame:
    """Each observation with the id of its source's document of that URL, null where there is none."""
    return observations.join(documents.select("source_id", "canonical_url", "document_id"), ["source_id", "canonical_url"], "left")


def with_decision(articles: DataFrame, decisions: DataFrame) -> DataFrame:
    """Each article with its decision to fetch; ``requested_url`` is what was discovered, or the article's own URL."""
    fetched = decisions.filter("decision = 'fetch'").groupBy("canonical_url").agg(
        F.max_by(F.struct("discovered_url", "feed_published", "feed_updated"), "position").alias("_d")
    )
    return articles.join(fetched, "canonical_url", "left").select(
        *articles.columns, F.coalesce("_d.discovered_url", "canonical_url").alias("requested_url"), "_d.feed_published", "_d.feed_updated"
    )


def with_dates(articles: DataFrame, logged: DataFrame, feed: DataFrame) -> DataFrame:
    """Each article (canonical_url, ...) with the dates that the recipe's log and the feeds name for its URL
    (url, raw_date; of several the greatest counts), for the cascade of publication dates."""
    for rows, name in ((logged, "logged_date"), (feed, "feed_date")):
        one = rows.groupBy(F.col("url").alias("canonical_url")).agg(F.max("raw_date").alias(name))
        articles = articles.join(one, "canonical_url", "left")
    return articles


def preferred_date(order: str, date: str, source: str, confidence: str, *, strict_reference: bool = False) -> Column:
    """The date that stays when rows are folded in order: one of high confidence is only replaced by
    another of high confidence, any other by whatever comes later. Struct of date, source, confidence.

    A row without a date changes nothing; with ``strict_reference`` it also replaces a date that is not of
    high confidence.
    """
    one = F.struct(F.col(date).alias("date"), F.col(source).alias("source"), F.col(confidence).alias("confidence"))
    high = F.col(date).isNotNull() & (F.col(confidence) == "high")
    usable = F.lit(True) if strict_reference else F.col(date).isNotNull()
    return F.coalesce(F.max_by(one, F.when(high, F.col(order))), F.max_by(one, F.when(usable, F.col(order))))


def ingest(existing: DataFrame | None, incoming: DataFrame, imported: DataFrame | None = None) -> dict[str, DataFrame]:
    """Corpus state after the rows of new runs, and what each run changed.

    Rows of ``existing`` (all earlier rows) and ``incoming``: run_id, ord (rising over all rows), url, title,
    content_hash, section, retrieved_at, published_at, date_source, date_confidence. Runs of ``imported``
    (run_id) are not taken again. Gives ``articles``, ``versions``, ``observations`` and ``counters``; every
    one is hash aggregations by key.
    """
    fresh = incoming if imported is None else incoming.join(imported.select("run_id").distinct(), "run_id", "left_anti")
    rows = fresh if existing is None else existing.unionByName(fresh)
    articles = rows.groupBy("url").agg(
        F.max_by("title", "ord").alias("title"),
        preferred_date("ord", "published_at", "date_source", "date_confidence").alias("_date"),
        F.min_by("retrieved_at", "ord").alias("first_seen_at"),
        F.max_by("retrieved_at", "ord").alias("last_seen_at"),
        F.min("ord").alias("first_ord"),
    )
    versions = rows.groupBy("url", "content_hash").agg(
        F.min("ord").alias("ord"),
        F.min_by("title", "ord").alias("title"),
        F.min_by("retrieved_at", "ord").alias("first_seen_at"),
    )
    section = F.coalesce("section", F.lit(""))
    observations = rows.groupBy("run_id", "url", "content_hash", section.alias("section")).agg(
        F.min("ord").alias("ord"),
        F.min_by("retrieved_at", "ord").alias("retrieved_at"),
    )
    # A row is the first of its URL, its version or its observation if its place is the least one there.
    firsts = (
        articles.select(F.col("first_ord").alias("ord"), F.lit(1).alias("a"), F.lit(0).alias("v"), F.lit(0).alias("o"))
        .unionAll(versions.select("ord", F.lit(0), F.lit(1), F.lit(0)))
        .unionAll(observations.select("ord", F.lit(0), F.lit(0), F.lit(1)))
        .groupBy("ord")
        .agg(F.max("a").alias("a"), F.max("v").alias("v"), F.max("o").alias("o"))
    )
    counters = (
        fresh.select("run_id", "ord")
        .join(firsts, "ord", "left")
        .groupBy("run_id")
        .agg(
            F.count(F.lit(1)).alias("records"),
            F.coalesce(F.sum("a"), F.lit(0)).alias("new_articles"),
            F.coalesce(F.sum("v"), F.lit(0)).alias("new_versions"),
            (F.count(F.lit(1)) - F.coalesce(F.sum("v"), F.lit(0))).alias("unchanged_records"),
            F.coalesce(F.sum("o"), F.lit(0)).alias("new_observations"),
        )
    )
    return {
        "articles": articles.select("url", "title", "_date.*", "first_seen_at", "last_seen_at"),
        "versions": versions,
        "observations": observations,
        "counters": counters,
    }


def run_counters(records: DataFrame, documents: DataFrame, snapshots: DataFrame, observations: DataFrame, errors: DataFrame) -> DataFrame:
    """One row: records seen, documents, snapshots and observations created, errors."""
    counted = [
        (records, "documents_seen"),
        (documents, "documents_created"),
        (snapshots, "snapshots_created"),
        (observations, "observations_created"),
        (errors, "errors"),
    ]
    named = None
    for rows, name in counted:
        one = rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
        named = one if named is None else named.unionAll(one)
    return named.agg(*[F.max(F.when(F.col("name") == name, F.col("n"))).alias(name) for _, name in counted])


def known_state(documents: DataFrame) -> DataFrame:
    """source_slug, canonical_url and the JSON line of every known document, ordered by URL; a missing marker is written as null."""
    line = F.to_json(
        F.struct("canonical_url", F.date_format("source_updated_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("source_updated_at")),
        {"ignoreNullFields": "false"},
    )
    return documents.select("source_slug", "canonical_url", line.alias("line")).orderBy("source_slug", "canonical_url")


def known_state_error(version: Column, slug: Column, url: Column, marker: Column) -> Column:
    """A message where an entry of a known state cannot be used, else null."""
    return (
        F.when(~version.eqNullSafe(F.lit("calibre-known-state/v1")), "known state must use calibre-known-state/v1")
        .when(F.coalesce(slug, F.lit("")) == "", "known state requires source_slug")
        .when(canonical_url(url).isNull(), "each known document requires an HTTP(S) canonical_url")
        .when(marker.isNotNull() & bridge_time(marker).isNull(), "source_updated_at must be null or an ISO 8601 timestamp")
    )


def read_bodies(spark, root: str) -> DataFrame:
    """body_text_path (below ``root``, which no path can leave) and body of every text file of a run."""
    files = spark.read.option("recursiveFileLookup", True).text(f"{root}/articles", wholetext=True)
    path = F.regexp_extract(F.col("_metadata.file_path"), r"(articles/.*)$", 1)
    return files.select(F.url_decode(path).alias("body_text_path"), F.col("value").alias("body"))


def path_error(path: Column, body: Column) -> Column:
    """A message where a record's body is named outside the run's folder or is not there, else null."""
    outside = path.startswith("/") | path.rlike(r"(^|/)\.\.(/|$)")
    return F.when(outside, "body_text_path is outside the run root").when(body.isNull(), "body_text_path does not exist")
