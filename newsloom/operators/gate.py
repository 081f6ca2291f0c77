"""The discovery gate: which candidate URLs of a run are fetched, and why."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.urls import canonical_url, url_host
from ..sources.tables import Tables


def decide(candidates: DataFrame, known: DataFrame, *, hosts: DataFrame, cap: int, trust_markers: bool = False) -> DataFrame:
    """Adds canonical_url, decision and reason to candidates (ordinal, url, source_updated_at).

    ``known`` has canonical_url (unique) and source_updated_at; ``hosts`` has host, the allow-list. The cap
    counts accepted candidates in the order of their ordinals: the last accepted ordinal is found by a top-k
    of ``cap`` rows, not by a running count over one partition. Host comes before duplicate, and a capped or
    known URL counts as seen. Rows without a valid URL are never grouped.
    """
    every = candidates.withColumn("canonical_url", canonical_url(F.col("url"))).withColumn("_host", url_host(F.col("canonical_url")))
    # Rows without a URL are decided without any join: their null would be one hot key.
    invalid = every.filter("canonical_url IS NULL").withColumns({"reason": F.lit("invalid_url")})
    rows = every.filter("canonical_url IS NOT NULL")
    # The first row of each URL, found again by (URL, ordinal): no task sorts all rows of one URL.
    first = rows.groupBy("canonical_url").agg(F.min("ordinal").alias("ordinal")).withColumn("_first", F.lit(True))
    state = known.select("canonical_url", F.col("source_updated_at").alias("_known_at"), F.lit(True).alias("_known"))
    allowed = hosts.select(F.col("host").alias("_host"), F.lit(True).alias("_allowed")).distinct()
    marker = F.col("source_updated_at")
    newer = F.lit(trust_markers) & marker.isNotNull() & (F.col("_known_at").isNull() | (marker > F.col("_known_at")))
    judged = (
        rows.join(first, ["canonical_url", "ordinal"], "left")
        .join(state, "canonical_url", "left")
        .join(allowed, "_host", "left")
        .withColumn(
            "reason",
            F.when(F.col("_allowed").isNull(), "disallowed_host")
            .when(F.col("_first").isNull(), "duplicate_in_run")
            .when(F.col("_known").isNull(), "unseen")
            .when(newer, "trusted_newer_update")
            .otherwise("known_unchanged"),
        )
        .select(*every.columns, "reason")
        .unionByName(invalid.select(*every.columns, "reason"))
    )
    fetched = F.col("reason").isin("unseen", "trusted_newer_update")
    last = judged.filter(fetched).select("ordinal").orderBy("ordinal").limit(cap).agg(
        F.coalesce(F.max("ordinal"), F.lit(-1)).alias("_last"),
        F.lit(1).alias("_one"),
    )
    return (
        judged.withColumn("_one", F.lit(1))
        .join(F.broadcast(last), "_one")  # one row
        .withColumn("reason", F.when(fetched & (F.col("ordinal") > F.col("_last")), "article_cap").otherwise(F.col("reason")))
        .withColumn("decision", F.when(fetched, "fetch").otherwise("skip"))
        .select(*candidates.columns, "canonical_url", "decision", "reason")
    )


#: Bits of the filter of a run's URLs (2 ** 28: 32 MB at most, in rows of 32,768 bits), and places that a URL has in it.
FILTER_BITS, FILTER_HASHES = 1 << 28, 2


def places(url: Column, seed: int, bits: int) -> tuple[Column, Column]:
    """The row of the filter and the bit in it of a URL under one hash."""
    at = F.pmod(F.xxhash64(url, F.lit(seed)), F.lit(bits))
    return F.bitmap_bucket_number(at), F.bitmap_bit_position(at)


def url_filter(urls: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """A Bloom filter of canonical_url as bitmaps: row (number) and bits; no more than ``bits`` / 32,768 rows."""
    each = F.explode(F.array(*[F.struct(*[c.alias(n) for c, n in zip(places(F.col("canonical_url"), s, bits), ("row", "bit"), strict=True)]) for s in range(FILTER_HASHES)]))
    return urls.filter("canonical_url IS NOT NULL").select(each.alias("p")).groupBy("p.row").agg(F.bitmap_construct_agg(F.col("p.bit")).alias("bits"))


def may_be_in(rows: DataFrame, made: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """The rows whose canonical_url the filter does not exclude: all that are in it, and a few others."""
    for seed in range(FILTER_HASHES):
        row, bit = places(F.col("canonical_url"), seed, bits)
        one = F.broadcast(made.select(F.col("row").alias("_row"), F.col("bits").alias("_bits")))  # its size has a bound
        met = rows.withColumns({"_row": row, "_bit": bit}).join(one, "_row")
        byte = "cast(conv(hex(substring(_bits, cast(_bit div 8 as int) + 1, 1)), 16, 10) as int)"
        rows = met.filter(F.expr(f"shiftright({byte}, cast(_bit % 8 as int)) & 1 = 1")).select(*rows.columns)
    return rows


def known_of_run(known: DataFrame, candidates: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """The rows of ``known`` that a run's ``candidates`` (url) may meet, for ``decide``: the state of billions of URLs is
    read once, by a filter of the run's, and only what passes is shuffled."""
    urls = candidates.select(canonical_url(F.col("url")).alias("canonical_url"))
    return may_be_in(known, Tables(known.sparkSession).put(url_filter(urls, bits)), bits)


def first_candidates(candidates: DataFrame, group: str, key: str, order: str, most: int) -> DataFrame:
    """The first ``most`` candidates of every group by ``order``, each key once, at its first place."""
    others = [c for c in candidates.columns if c not in (group, key)]
    once = candidates.groupBy(group, key).agg(F.min_by(F.struct(*others), order).alias("_c")).select(group, key, "_c.*")
    place = F.row_number().over(Window.partitionBy(group).orderBy(order))
    return once.withColumn("_place", place).filter(F.col("_place") <= most).drop("_place")


def filter_feeds(feeds: DataFrame, decisions: DataFrame) -> DataFrame:
    """Feeds (feed, articles: array of structs with url) with the articles whose url ``decisions`` (url, decision) lets
    be fetched, in their order; a feed of which nothing is left stays, with an empty list."""
    each = feeds.select("feed", F.posexplode("articles").alias("_at", "_a")).withColumn("_url", F.col("_a.url"))
    fetched = decisions.filter("decision = 'fetch' AND url IS NOT NULL").select(F.col("url").alias("_url")).distinct()
    kept = each.join(fetched, "_url", "left_semi").groupBy("feed").agg(F.array_sort(F.collect_list(F.struct("_at", "_a"))).alias("_kept"))
    kind = feeds.schema["articles"].dataType
    some = F.transform("_kept", lambda x: x["_a"]).cast(kind)
    return feeds.select("feed").join(kept, "feed", "left").select("feed", F.coalesce(some, F.array().cast(kind)).alias("articles"))


def of_sources(rows: DataFrame, names: list[str] | None, column: str = "source") -> DataFrame:
    """The rows of the named sources, all where none is named."""
    return rows.filter(F.col(column).isin(names)) if names else rows


def collector_identity(name: str, version: str, home: str, contact: str | None, *, required: bool = False) -> str:
    """How a collector names itself to publishers: name, version, home page and an address to write to."""
    contact = (contact or "").strip()
    if required and not contact:
        raise ValueError("a contact is required")
    return f"{name}/{version} ({'; '.join([f'+{home}', *([f'mailto:{contact}'] if contact else [])])})"


def counts(decisions: DataFrame) -> DataFrame:
    return decisions.agg(
        F.count(F.lit(1)).alias("discovered"), F.count_if(
            F.col("decision") == "fetch"
        ).alias("eligible"), F.count_if(F.col("decision") == "skip").alias("skipped")
    )
