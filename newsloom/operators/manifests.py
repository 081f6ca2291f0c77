"""Checks of source manifests as error arrays: one row per manifest, all its faults, never an exception per row.

A manifest is JSON text (YAML files are read as such by ``read_manifests``). Keys are checked at every level
against the fixed lists below.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Keys of every level: (allowed, required); fixed values of the manifest's contract.
KEYS = {
    "": (["version", "source", "recipe", "discovery", "limits", "policy_proposal"], None),
    "source": (["slug", "name", "owner_name", "source_type", "canonical_url"], None),
    "recipe": (["type", "id", "path"], ["type"]),
    "discovery": (["feeds", "allowed_hosts", "update_strategy"], None),
    "discovery.allowed_hosts": (["article", "redirect"], None),
    "discovery.update_strategy": (["mode", "field"], ["mode"]),
    "limits": (["article_cap", "timeout_seconds", "requests_per_minute", "max_concurrency"], None),
    "policy_proposal": (
        ["status", "access_method", "endpoint_url", "terms_url", "robots_url", "retention_days", "allowed_uses", "attribution", "notes"],
        ["status", "access_method", "endpoint_url", "terms_url", "robots_url", "retention_days", "allowed_uses", "attribution"],
    ),
}
#: Values and ranges of fields: fixed values of the manifest's contract.
SOURCE_TYPES = ["primary", "licensed_reporting", "public_reporting", "discovery_only"]
RECIPE_TYPES = ["builtin", "generic", "project"]
UPDATE_MODES = ["unseen_only", "trusted_marker"]
UPDATE_FIELDS = ["feed_updated"]
ACCESS_METHODS = ["public_rss", "public_rss_and_html", "licensed_feed", "public_api"]
ALLOWED_USES = ["discovery", "internal_analysis", "fact_extraction", "quotation_with_attribution", "temporary_storage"]
LIMITS = {"article_cap": (1, 500), "timeout_seconds": (1, 3600), "requests_per_minute": (1, 120), "max_concurrency": (1, 10)}
RETENTION = (0, 365)
MOST_FEEDS, MOST_HOSTS = 20, 50
#: What slugs, recipe files, and hosts must be: fixed values.
SLUG = r"\A[a-z0-9]+(?:-[a-z0-9]+)*\z"
RECIPE_FILE = r"\A[a-z0-9][a-z0-9_.-]*\.recipe\z"
HOST = r"\A(?=.{1,253}\z)(?:[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?\.)+[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?\z"
#: An http(s) URL with a host and without credentials.
HTTP = r"(?i)\Ahttps?://[^/?#@\s]+(?:[/?#]\S*)?\z"


def field(path: str) -> Column:
    return F.variant_get(F.col("_m"), f"$.{path}" if path else "$", "variant")


def kind(value: Column) -> Column:
    """The type of a variant: OBJECT<...>, ARRAY<...>, STRING, BIGINT, ..., or null where nothing is there."""
    return F.schema_of_variant(value)


def of_kind(value: Column, name: str) -> Column:
    return F.coalesce(F.startswith(kind(value), F.lit(name)), F.lit(False))


def text(value: Column) -> Column:
    """The text of a variant that is a string, else null."""
    return F.when(of_kind(value, "STRING"), F.try_variant_get(value, "$", "string"))


def items(value: Column) -> Column:
    """The elements of a variant that is an array, else null."""
    return F.when(of_kind(value, "ARRAY"), F.try_variant_get(value, "$", "array<variant>"))


def sound(value: Column) -> Column:
    """Whether a variant is a text that is not blank and has no white space around it."""
    t = text(value)
    return F.coalesce((t != "") & ~t.rlike(r"\A\s|\s\z"), F.lit(False))


def otherwise(test: Column, message: Column | str) -> Column:
    """The message where a test fails or is null, else null."""
    return F.when(~F.coalesce(test, F.lit(False)), F.lit(message) if isinstance(message, str) else message)


def string_error(path: str) -> Column:
    return otherwise(sound(field(path)), f"{path} must be a non-empty string")


def member_error(path: str, values: list[str]) -> Column:
    return otherwise(text(field(path)).isin(values), f"{path} must be one of: {', '.join(values)}")


def whole_number(value: Column, low: int, high: int) -> Column:
    return of_kind(value, "BIGINT") & F.try_variant_get(value, "$", "bigint").between(low, high)


def integer_error(path: str, low: int, high: int) -> Column:
    return otherwise(whole_number(field(path), low, high), f"{path} must be an integer from {low} through {high}")


def url_error(path: str) -> Column:
    return F.coalesce(string_error(path), otherwise(text(field(path)).rlike(HTTP), f"{path} must be an HTTP(S) URL without credentials"))


def key_errors(path: str) -> list[Column]:
    """Messages for a level that is no mapping, for unknown keys and for missing ones."""
    allowed, required = KEYS[path]
    name = path or "manifest"
    keys = F.when(of_kind(field(path), "OBJECT"), F.json_object_keys(F.to_json(field(path))))
    said = lambda word, found: F.when(F.size(found) > 0, F.concat(F.lit(f"{name} {word} keys: "), F.array_join(found, ", ")))
    listed = lambda names: F.array(*[F.lit(k) for k in names])
    return [
        otherwise(keys.isNotNull(), f"{name} must be a mapping"),
        said("has unknown", F.array_except(keys, listed(allowed))),
        said("is missing", F.array_except(listed(required or allowed), keys)),
    ]


def size_error(path: str, low: int, high: int) -> Column:
    found = items(field(path))
    return F.when(found.isNull(), F.lit(f"{path} must be an array")).otherwise(
        otherwise(F.size(found).between(low, high), f"{path} must contain between {low} and {high} items")
    )


def texts(path: str) -> Column:
    return F.transform(
        items(field(path)),
        lambda x: F.when(F.startswith(F.schema_of_variant(x), F.lit("STRING")), F.try_variant_get(x, "$", "string")),
    )


def feed_urls() -> Column:
    return F.transform(items(field("discovery.feeds")), lambda x: F.try_variant_get(x, "$.url", "string"))


def every(found: Column, test) -> Column:
    return F.forall(found, lambda x: F.coalesce(test(x), F.lit(False)))


def distinct(found: Column) -> Column:
    return F.size(F.array_distinct(found)) == F.size(found)


def has(path: str, key: str) -> Column:
    return F.coalesce(F.array_contains(F.json_object_keys(F.to_json(field(path))), key), F.lit(False))


def recipe_errors() -> list[Column]:
    form, slug = text(field("recipe.type")), text(field("source.slug"))
    path = text(field("recipe.path"))
    expected = F.concat(F.lit("lib/calibre_recipes/"), slug, F.lit(".recipe"))
    return [
        F.when(form.isin("builtin", "generic") & has("recipe", "path"), F.concat(F.lit("recipe.path is not allowed for a "), form, F.lit(" recipe"))),
        F.when(form.isin("generic", "project") & has("recipe", "id"), F.concat(F.lit("recipe.id is not allowed for a "), form, F.lit(" recipe"))),
        F.when(form == "builtin", otherwise(text(field("recipe.id")).rlike(RECIPE_FILE), "recipe.id must be a .recipe filename without directories")),
        F.when(form == "project", otherwise(path == expected, F.concat(F.lit('recipe.path must be "'), expected, F.lit('"')))),
    ]


def discovery_errors() -> list[Column]:
    feeds, urls = items(field("discovery.feeds")), feed_urls()
    plain = every(feeds, lambda x: F.array_except(F.json_object_keys(F.to_json(x)), F.array(F.lit("url"))) == F.array().cast("array<string>"))
    article, redirect = texts("discovery.allowed_hosts.article"), texts("discovery.allowed_hosts.redirect")
    home = F.lower(F.try_parse_url(text(field("source.canonical_url")), F.lit("HOST")))
    mode = text(field("discovery.update_strategy.mode"))
    hosts = lambda found, name: F.when(
        found.isNotNull(),
        otherwise(every(found, lambda h: h.rlike(HOST)), f"discovery.allowed_hosts.{name} must hold lower-case hostnames"),
    )
    return [
        size_error("discovery.feeds", 1, MOST_FEEDS),
        F.when(
            feeds.isNotNull(),
            otherwise(plain & every(urls, lambda u: u.rlike(HTTP)), "discovery.feeds must hold an HTTP(S) url each, and nothing else"),
        ),
        F.when(urls.isNotNull(), otherwise(distinct(urls), "discovery feed URLs contains duplicates")),
        size_error("discovery.allowed_hosts.article", 1, MOST_HOSTS),
        size_error("discovery.allowed_hosts.redirect", 0, MOST_HOSTS),
        hosts(article, "article"),
        hosts(redirect, "redirect"),
        F.when(article.isNotNull() & redirect.isNotNull(), otherwise(distinct(F.concat(article, redirect)), "allowed hosts contains duplicates")),
        F.when(article.isNotNull(), otherwise(F.array_contains(article, home), "source canonical host must be in discovery.allowed_hosts.article")),
        member_error("discovery.update_strategy.mode", UPDATE_MODES),
        F.when(
            (mode == "unseen_only") & has("discovery.update_strategy", "field"),
            F.lit("discovery.update_strategy.field is not allowed for unseen_only"),
        ),
        F.when(mode == "trusted_marker", member_error("discovery.update_strategy.field", UPDATE_FIELDS)),
    ]


def policy_errors() -> list[Column]:
    uses = texts("policy_proposal.allowed_uses")
    return [
        otherwise(text(field("policy_proposal.status")) == "draft", "policy_proposal.status must be draft"),
        member_error("policy_proposal.access_method", ACCESS_METHODS),
        url_error("policy_proposal.endpoint_url"),
        otherwise(
            F.array_contains(feed_urls(), text(field("policy_proposal.endpoint_url"))),
            "policy_proposal.endpoint_url must match a discovery feed",
        ),
        url_error("policy_proposal.terms_url"),
        url_error("policy_proposal.robots_url"),
        integer_error("policy_proposal.retention_days", *RETENTION),
        size_error("policy_proposal.allowed_uses", 1, len(ALLOWED_USES)),
        F.when(
            uses.isNotNull(),
            otherwise(every(uses, lambda u: u.isin(ALLOWED_USES)), f"policy_proposal.allowed_uses must be among: {', '.join(ALLOWED_USES)}"),
        ),
        F.when(uses.isNotNull(), otherwise(distinct(uses), "policy_proposal.allowed_uses contains duplicates")),
        string_error("policy_proposal.attribution"),
        F.when(has("policy_proposal", "notes"), string_error("policy_proposal.notes")),
    ]


def manifest_errors(manifests: DataFrame, column: str = "manifest") -> DataFrame:
    """``manifests`` with slug and errors (array of messages in the order of the contract; empty for a sound one)."""
    keys = [e for path in KEYS for e in key_errors(path)]
    slug = text(field("source.slug"))
    source = [
        string_error("source.slug"),
        F.when(sound(field("source.slug")), otherwise(slug.rlike(SLUG), "source.slug must use lower-case kebab-case")),
        string_error("source.name"),
        string_error("source.owner_name"),
        member_error("source.source_type", SOURCE_TYPES),
        url_error("source.canonical_url"),
    ]
    found = [
        otherwise(whole_number(field("version"), 1, 1), "version must be an integer from 1 through 1"),
        *source,
        member_error("recipe.type", RECIPE_TYPES),
        *recipe_errors(),
        *discovery_errors(),
        *[integer_error(f"limits.{name}", *bounds) for name, bounds in LIMITS.items()],
        *policy_errors(),
    ]
    read = manifests.withColumn("_m", F.try_parse_json(column))
    broken = F.array(F.lit("invalid JSON"))
    # The checks of one level at a time keep the generated code small.
    judged = read.withColumn("_keys", F.array_compact(F.array(*keys)))
    for i in range(0, len(found), 8):
        judged = judged.withColumn(f"_e{i}", F.array_compact(F.array(*found[i : i + 8])))
    parts = [F.col(f"_e{i}") for i in range(0, len(found), 8)]
    errors = F.when(F.col("_m").isNull(), broken).otherwise(F.concat(F.col("_keys"), *parts))
    return judged.select(*manifests.columns, slug.alias("slug"), errors.alias("errors"))


def duplicate_slugs(checked: DataFrame) -> DataFrame:
    """slug and n of every slug that several manifests have."""
    return checked.filter("slug IS NOT NULL").groupBy("slug").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def read_manifests(spark: SparkSession, folder: str) -> DataFrame:
    """path and manifest (JSON text, null for YAML that cannot be read) of every *.yml file of a folder, by name."""
    files = spark.read.option("pathGlobFilter", "*.yml").text(folder, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")

    def run(values: pa.Array) -> pa.Array:
        import json

        import yaml

        def read(value: str) -> str | None:
            try:
                aliased = any(isinstance(e, yaml.AliasEvent) for e in yaml.parse(value, Loader=yaml.SafeLoader))
                return None if aliased else json.dumps(yaml.safe_load(value))
            except (yaml.YAMLError, TypeError):
                return None

        return pa.array([read(v) for v in values.to_pylist()], pa.string())

    return files.select("path", F.arrow_udf(run, StringType())("value").alias("manifest")).orderBy("path")


def fetch_manifest(checked: DataFrame, slug: str) -> DataFrame:
    """The one manifest of a slug; the query fails if there is none or more than one."""
    found = checked.filter(F.col("slug") == slug)
    n = found.agg(F.count(F.lit(1)).alias("_n")).filter(
        F.when(F.col("_n") == 1, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit(f"{slug}: manifests found: "), F.col("_n").cast("string"))))
    )
    return found.crossJoin(F.broadcast(n)).drop("_n")  # one row
