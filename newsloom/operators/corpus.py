"""Versioned corpus: document merge, insert-or-ignore, latest version, window freeze, profile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def merge_documents(rows: DataFrame, key: list[str], order: str, latest: list[str], newest: list[str], fallback: list[str]) -> DataFrame:
    """State after folding ``rows`` in ``order``: ``latest`` columns take the last value (null too),
    ``fallback`` the last that is not null, ``newest`` the greatest. One hash aggregation per key."""
    return rows.groupBy(*key).agg(
        *[F.max_by(c, order).alias(c) for c in latest],
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in fallback],
        *[F.max(c).alias(c) for c in newest],
    )


def insert_or_ignore(existing: DataFrame, incoming: DataFrame, key: list[str], order: str) -> DataFrame:
    """The incoming rows whose key is new, the first of each key by ``order``."""
    fresh = incoming.join(existing.select(*key).distinct(), key, "left_anti")
    others = [c for c in incoming.columns if c not in key]
    return fresh.groupBy(*key).agg(F.min_by(F.struct(*others), order).alias("_r")).select(*key, "_r.*")


def latest_version(versions: DataFrame, key: str, order: str) -> DataFrame:
    others = [c for c in versions.columns if c != key]
    return versions.groupBy(key).agg(F.max_by(F.struct(*others), order).alias("_r")).select(key, "_r.*")


def with_latest(articles: DataFrame, versions: DataFrame, key: str, order: str) -> DataFrame:
    """Articles with the columns of their latest version in a struct ``latest``, null where there is none."""
    others = [c for c in versions.columns if c != key]
    last = versions.groupBy(key).agg(F.max_by(F.struct(*others), order).alias("latest"))
    return articles.join(last, key, "left")


def in_window(published: Column, first_seen: Column, cutoff: Column) -> Column:
    """Published since the cutoff, or undated and first seen since then; no upper bound."""
    return (published >= cutoff) | (published.isNull() & (first_seen >= cutoff))


def profile(rows: DataFrame, source: str, published: str) -> DataFrame:
    return rows.groupBy(source).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(published).isNull()).alias("unknown_dates"))
