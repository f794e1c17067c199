"""Names, ids and table schemas of the registry."""

from __future__ import annotations

import uuid
from datetime import datetime, timezone

# Lifecycle states of a version.
VERSION_STATUSES = (
    "ingested",
    "validated",
    "enriched",
    "embedded",
    "gated",
    "promoted",
    "quarantined",
    "rejected",
    "rolled_back",
)
TERMINAL_STATUSES = ("promoted", "rejected", "rolled_back")

# What may start a run.
TRIGGER_TYPES = ("event", "schedule", "webhook", "manual")

PROMOTED, REJECTED, ROLLED_BACK = "promoted", "rejected", "rolled_back"
ROLLBACK_FAILED = "rollback_failed"


def new_version_id(dataset: str, now: datetime | None = None) -> str:
    """Sortable id: dataset, UTC second, eight random hex digits."""
    stamp = (now or datetime.now(timezone.utc)).strftime("%Y%m%d-%H%M%S")
    return "-".join((dataset, stamp, uuid.uuid4().hex[:8]))


# Schemas of the registry tables.
DATASET_VERSIONS = (
    "id BIGINT, dataset STRING, version_id STRING, source_uri STRING, pipeline STRING,"
    " trigger_type STRING, status STRING, record_count BIGINT, schema_hash STRING,"
    " created_at TIMESTAMP, updated_at TIMESTAMP"
)
QUALITY_REPORTS = (
    "id BIGINT, version_id STRING, check_name STRING, passed BOOLEAN, score DOUBLE,"
    " threshold DOUBLE, details STRING, created_at TIMESTAMP"
)
PROMOTIONS = (
    "id BIGINT, dataset STRING, version_id STRING, decision STRING, from_target STRING,"
    " to_target STRING, reason STRING, gate_summary STRING, decided_at TIMESTAMP"
)
QUARANTINE = (
    "version_id STRING, record_key STRING, reason STRING, payload STRING, created_at TIMESTAMP"
)
SCHEMA_REGISTRY = (
    "id BIGINT, dataset STRING, schema_version INT, json_schema STRING, is_active BOOLEAN,"
    " created_at TIMESTAMP"
)
TRANSITIONS = (
    "seq BIGINT, version_id STRING, status STRING, record_count BIGINT, schema_hash STRING,"
    " at TIMESTAMP"
)
BUS_EVENTS = (
    "id BIGINT, event_id STRING, type STRING, dataset STRING, object_key STRING, source_uri STRING, pipeline STRING,"
    " record_count BIGINT, trigger_type STRING, idempotency_key STRING, at TIMESTAMP"
)
