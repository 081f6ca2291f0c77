"""Row and table constraints as data-quality queries: one row per check with its violations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def result(rows: DataFrame, name: str) -> DataFrame:
    return rows.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(name).alias("check_name"), "violations")


def domain(rows: DataFrame, name: str, valid: Column) -> DataFrame:
    return result(rows.filter(~F.coalesce(valid, F.lit(False))), name)


def unique(rows: DataFrame, name: str, key: list[str]) -> DataFrame:
    return result(rows.groupBy(*key).count().filter("count > 1"), name)


def foreign_key(rows: DataFrame, name: str, column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    return result(rows.filter(F.col(column).isNotNull()).join(parent.select(F.col(parent_column).alias(column)), column, "left_anti"), name)


#: Values that a column may have, by table and column: fixed values of the data model. Null is never one.
DOMAINS = {
    "sources": {"source_type": ["primary", "licensed_reporting", "public_reporting", "discovery_only"]},
    "source_policies": {"status": ["draft", "approved", "retired"]},
    "collection_runs": {"status": ["running", "succeeded", "failed"]},
    "news_collection_cycles": {"status": ["dispatching", "running", "completed"]},
    "news_collection_slots": {"status": ["claimed", "succeeded", "failed"]},
    "event_clusters": {"status": ["candidate", "active", "merged", "rejected"], "risk_level": ["normal", "elevated", "high"]},
    "event_cluster_documents": {"role": ["evidence", "discovery", "background"]},
    "claims": {
        "claim_type": ["fact", "allegation", "estimate", "causal", "context", "quotation"],
        "status": ["confirmed", "attributed", "disputed", "unknown"],
        "review_status": ["pending", "approved", "rejected"],
        "origin": ["extracted", "human", "imported"],
    },
    "evidence_items": {"relation": ["supports", "contradicts", "context"], "review_status": ["pending", "verified", "rejected"]},
    "stories": {"status": ["draft", "review", "approved", "published", "withdrawn"]},
    "story_versions": {"status": ["draft", "approved", "published", "superseded"]},
    "story_claims": {"usage": ["asserted", "attributed", "context"]},
    "editions": {
        "edition_type": ["weekday", "weekend"],
        "tier": ["top_ten", "complete", "weekend"],
        "status": ["draft", "review", "approved", "published", "corrected"],
    },
    "artifacts": {"artifact_type": ["web", "rss", "email", "pdf", "epub"], "status": ["pending", "generated", "failed"]},
    "deliveries": {
        "channel": ["web", "rss", "email", "download", "pdf_email", "epub_email"],
        "status": ["pending", "attempted", "delivered", "failed"],
    },
    "corrections": {"status": ["draft", "approved", "published"]},
}
#: Columns that are unique together, by table: fixed values of the data model.
KEYS = {
    "sources": [["slug"]],
    "source_policies": [["source_id", "version"]],
    "source_documents": [["source_id", "canonical_url"], ["source_id", "external_id"]],
    "document_snapshots": [["source_document_id", "content_hash"]],
    "discovery_observations": [["collection_run_id", "position"]],
    "news_collection_cycles": [["slot_at"]],
    "news_collection_slots": [["source_id", "slot_at"]],
    "event_cluster_documents": [["event_cluster_id", "source_document_id"]],
    "story_versions": [["story_id", "version"]],
    "story_claims": [["story_version_id", "claim_id"], ["story_version_id", "position"]],
}
#: Rules over the columns of one row, by table: name and SQL of what holds.
RULES = {
    "source_policies": {
        "positive_version": "version > 0",
        "approved_is_reviewed": "status <> 'approved' OR (reviewed_by IS NOT NULL AND reviewed_at IS NOT NULL)",
        "retention": "coalesce(retention_days, 0) >= 0",
    },
    "collection_runs": {"counters": "documents_seen >= 0 AND documents_created >= 0 AND snapshots_created >= 0"},
    "document_snapshots": {"byte_size": "byte_size >= 0"},
    "discovery_observations": {"position": "position >= 0"},
    "news_collection_cycles": {
        "on_the_hour": "slot_at = date_trunc('hour', slot_at)",
        "finished_if_completed": "(finished_at IS NOT NULL) = (status = 'completed')",
        "sorted_sources": "expected_source_slugs = array_sort(array_distinct(expected_source_slugs))",
    },
    "news_collection_slots": {
        "on_the_hour": "slot_at = date_trunc('hour', slot_at)",
        "attempts": "attempts > 0",
        "lease_after_claim": "status <> 'claimed' OR lease_expires_at > claimed_at",
        "finished_unless_claimed": "(finished_at IS NULL) = (status = 'claimed')",
        "success_has_run": "status <> 'succeeded' OR collection_run_id IS NOT NULL",
    },
    "claims": {"attributed_to_someone": "status <> 'attributed' OR length(trim(coalesce(attributed_to, ''))) > 0"},
    "evidence_items": {"confidence": "confidence IS NULL OR confidence BETWEEN 0 AND 1"},
    "story_versions": {"positive_version": "version > 0", "similarity": "source_similarity IS NULL OR source_similarity BETWEEN 0 AND 1"},
    "story_claims": {"position": "position >= 0"},
}


def check_model(tables: dict[str, DataFrame]) -> DataFrame:
    """check_name (table.check) and violations of every check of the data model on the tables that are given."""
    found = None
    for name, rows in tables.items():
        checks = [domain(rows, f"{name}.{c}", F.col(c).isin(values)) for c, values in DOMAINS.get(name, {}).items() if c in rows.columns]
        checks += [unique(rows, f"{name}.{'_'.join(key)}_unique", key) for key in KEYS.get(name, []) if set(key) <= set(rows.columns)]
        checks += [domain(rows, f"{name}.{rule}", F.expr(test)) for rule, test in RULES.get(name, {}).items()]
        for one in checks:
            found = one if found is None else found.unionByName(one)
    return found
