"""Dates of receipts: strict and lenient reading, provenance, markers and the cascade of publication dates."""

from __future__ import annotations

import re
from datetime import UTC

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .urls import date_in_path

#: A date, a time and a zone; seconds may have a fraction.
STRICT = r"^[+-]?\d{4}-\d{2}-\d{2}[Tt]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$"
#: A date, and a time that may lack seconds or a zone.
LOOSE = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}(:\d{2}(:\d{2}([.,]\d{1,9})?)?)?([Zz]|[+-]\d{2}(:?\d{2})?)?)?$"
#: Receipt field -> target, method and confidence: fixed values.
FIELDS = {
    "article_published": ("published_at", "article_markup", "high"),
    "feed_published": ("published_at", "recipe_feed", "medium"),
    "article_updated": ("source_updated_at", "article_markup", "high"),
    "feed_updated": ("source_updated_at", "recipe_feed", "medium"),
}
#: Zones that are written by name: fixed values, in seconds east of Greenwich.
ZONES = {"BST": 3600, "GMT": 0}


def blank(value: Column) -> Column:
    return F.coalesce(F.trim(F.regexp_replace(value, r"(?U)\s+", " ")), F.lit("")) == ""


def strict_time(value: Column) -> Column:
    """The time of an ISO 8601 text with date, time and zone, to the second, else null."""
    return F.when(value.rlike(STRICT), F.date_trunc("second", F.try_to_timestamp(F.upper(value))))


def time_error(value: Column, field: str) -> Column:
    """A message where a value that is not blank is no strict time."""
    return F.when(~blank(value) & strict_time(value).isNull(), F.lit(f"{field} is not a valid time"))


def iso(time: Column) -> Column:
    return F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def bridge_time(value: Column) -> Column:
    """The UTC text of a time whose zone, seconds or whole time of day may lack (then UTC and zero), else null."""
    text = F.trim(value)
    hours = F.regexp_replace(text, r"^(\d{4}-\d{2}-\d{2}[T ]\d{2})(?=$|[Zz+-])", "$1:00")
    hours = F.regexp_replace(hours, r"^(\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2})(?=$|[Zz+-])", "$1:00")
    zoned = F.regexp_replace(F.replace(hours, F.lit(","), F.lit(".")), r"([+-]\d{2})(\d{2})$", "$1:$2")
    time = F.try_to_timestamp(
        F.when(
            zoned.rlike(r"(?i)[T ].*(z|[+-]\d{2}(:\d{2})?)$"),
            F.upper(zoned),
        ).when(zoned.rlike("[T ]"), F.concat(zoned, F.lit("Z"))).otherwise(F.concat(zoned, F.lit("T00:00:00Z")))
    )
    fraction = F.regexp_replace(F.date_format(time, ".SSSSSS"), r"^\.0+$", "")
    return F.when(text.rlike(LOOSE), F.concat(F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss"), fraction, F.lit("Z")))


def updated_marker(*fields: Column) -> Column:
    """The first of the fields (source_updated_at, updated_at, updated) that can be read as a time."""
    return F.coalesce(*[bridge_time(f) for f in fields])


def raw_marker(*fields: Column) -> Column:
    """The first of the fields (updated, updated_at, source_updated_at) that is not null, as it is."""
    return F.coalesce(*fields)


def provenance(values: dict[str, Column]) -> Column:
    """Struct of raw value, normalised time, method and confidence of every given receipt field."""
    return F.struct(
        *[
            F.struct(
                raw.alias("raw_value"),
                iso(strict_time(raw)).alias("normalized_at"),
                F.when(~blank(raw), F.lit(FIELDS[name][1])).alias("method"),
                F.when(~blank(raw), F.lit(FIELDS[name][2])).alias("confidence"),
            ).alias(name)
            for name, raw in values.items()
        ]
    )


def chosen_date(found: Column, target: str) -> Column:
    """The time of a target (published_at or source_updated_at) from a provenance: markup, then feed."""
    return F.coalesce(*[F.to_timestamp(found[name]["normalized_at"]) for name, (of, _, _) in FIELDS.items() if of == target])


def lenient_time(value: Column) -> Column:
    """The UTC text of a date written for people (``9 Aug 2026 12.54 BST``), else null; no zone means UTC.
    The date parser is a Python library: an Arrow function over batches."""

    def read(text: str | None) -> str | None:
        from dateutil import parser

        if not text:
            return None
        try:
            found = parser.parse(re.sub(r"(\d{1,2})\.(\d{2})(?=\s)", r"\1:\2", text), tzinfos=ZONES)
            return (found if found.tzinfo else found.replace(tzinfo=UTC)).astimezone(UTC).isoformat()
        except (ValueError, TypeError, OverflowError):
            return None

    def run(values: pa.Array) -> pa.Array:
        return pa.array([read(v) for v in values.to_pylist()], pa.string())

    return F.arrow_udf(run, StringType())(value)


def publication_date(markup: list[Column], logged: Column, feed: Column, dateline: Column, url: Column) -> Column:
    """(date, source, confidence) of the first that is found: markup, log and feed (high), the dateline's
    text and the URL's path (medium). Dates are texts that ``lenient_time`` can read; all null where none is."""
    said = F.regexp_extract(dateline, r"(?i)(?:First published on|Published)\s+(.+)", 1)
    path = F.concat(F.date_format(date_in_path(url), "yyyy-MM-dd"), F.lit("T00:00:00+00:00"))
    tried = [
        *[(lenient_time(m), "article_markup", "high") for m in markup],
        (lenient_time(logged), "recipe_log", "high"),
        (lenient_time(feed), "recipe_feed", "high"),
        (lenient_time(F.nullif(said, F.lit(""))), "article_text", "medium"),
        (path, "url_path", "medium"),
    ]
    each = [F.when(d.isNotNull(), F.struct(d.alias("date"), F.lit(s).alias("source"), F.lit(c).alias("confidence"))) for d, s, c in tried]
    none = F.lit(None).cast("string")
    return F.coalesce(*each, F.struct(none.alias("date"), none.alias("source"), none.alias("confidence")))
