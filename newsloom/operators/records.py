"""Shapes of records: payloads, metadata, traversals through link tables and polymorphic subjects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Receipt headers and observation fields that are kept: fixed values of the contracts.
KEPT_HEADERS = ["content-length", "content-type", "date", "etag", "last-modified", "server"]
OBSERVED = ["decision", "feed_published", "feed_updated", "hook", "known_source_updated_at", "reason", "source_updated_at", "title"]


def canonical_json(fields: dict[str, Column]) -> Column:
    """Compact JSON with keys in order, nulls written out; nested structs must have their fields in order."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"})


def article_payload(
    slug: Column,
    url: Column,
    title: Column,
    body: Column,
    words: Column,
    language: Column,
    retrieved_at: Column,
    requested_url: Column,
) -> Column:
    """The stored document of an article record as canonical JSON; an empty language is English."""
    article = F.struct(url.alias("canonical_url"), F.coalesce(F.nullif(language, F.lit("")), F.lit("en")).alias("language"), title.alias("title"))
    content = F.struct(body.alias("body_text"), words.alias("word_count"))
    acquisition = F.struct(
        url.alias("final_url"),
        F.lit(200).alias("http_status"),
        requested_url.alias("requested_url"),
        retrieved_at.alias("retrieved_at"),
    )
    return canonical_json(
        {"schema_version": F.lit("calibre-article/v1"), "source_slug": slug, "article": article, "content": content, "acquisition": acquisition}
    )


def whole_payload(record: dict[str, Column]) -> Column:
    """The stored document of an article record with all its fields as canonical JSON. Of ``record`` source_slug,
    canonical_url, title, authors (array), language, section, description, dates (struct with its fields in order),
    body_text, word_count, requested_url, retrieved_at, collector and recipe_path; what is missing is null, no
    authors are an empty list, and an empty language is English."""
    none = F.lit(None).cast("string")
    of = lambda name: record.get(name, none)
    language = F.coalesce(F.nullif(F.trim(of("language")), F.lit("")), F.lit("en"))
    article = {
        "authors": F.coalesce(record.get("authors", F.lit(None).cast("array<string>")), F.array().cast("array<string>")),
        "canonical_url": of("canonical_url"),
        "dates": of("dates"),
        "description": of("description"),
        "language": language,
        "section": of("section"),
        "title": of("title"),
    }
    acquisition = {
        "collector": of("collector"),
        "final_url": of("canonical_url"),
        "http_receipt_inferred": F.lit(True),
        "http_status": F.lit(200),
        "recipe_path": of("recipe_path"),
        "requested_url": of("requested_url"),
        "retrieved_at": of("retrieved_at"),
    }
    content = {"body_text": of("body_text"), "word_count": of("word_count")}
    nested = lambda fields: F.struct(*[fields[k].alias(k) for k in sorted(fields)])
    return canonical_json(
        {"schema_version": F.lit("calibre-article/v1"), "source_slug": of("source_slug"), "article": nested(article), "content": nested(content), "acquisition": nested(acquisition)}
    )


def kept_headers(headers: Column, names: list[str] = KEPT_HEADERS) -> Column:
    """The entries of a map whose lower-case name is among ``names``."""
    return F.map_filter(headers, lambda k, _: F.lower(k).isin(names))


def without_nulls(fields: dict[str, Column]) -> Column:
    """JSON of the fields that are not null."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]))


def article_url(url: Column, link: Column) -> Column:
    """A feed entry's address: ``url``, else ``link``; an empty one counts as none."""
    return F.coalesce(F.nullif(url, F.lit("")), link)


def logged_dates(log: DataFrame) -> DataFrame:
    """url and raw_date from a recipe's log (value: whole text): an address at the end of a line, its date on the next."""
    pairs = F.regexp_extract_all("value", F.lit(r"(https?://\S+[ \t]*\n\s+[^\n]+)"), F.lit(1))
    each = log.select(F.explode(pairs).alias("p"))
    return each.select(F.regexp_extract("p", r"^(\S+)", 1).alias("url"), F.trim(F.regexp_extract("p", r"\n\s+([^\n]+)$", 1)).alias("raw_date"))


def traverse(left: DataFrame, link: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Rows of ``left`` with the rows of ``right`` that a link table joins to them (both keys are columns of it)."""
    return left.join(link, left_key).join(right, right_key)


def subjects(events: DataFrame, tables: dict[str, DataFrame], key: str = "subject_id") -> DataFrame:
    """Each event (subject_type, subject_id, ...) with ``found``: whether its subject is in the table of its type."""
    known = None
    for kind, rows in tables.items():
        one = rows.select(F.lit(kind).alias("subject_type"), F.col(rows.columns[0]).alias(key), F.lit(True).alias("_there")).distinct()
        known = one if known is None else known.unionByName(one)
    return events.join(known, ["subject_type", key], "left").withColumn("found", F.coalesce("_there", F.lit(False))).drop("_there")
