"""Tunable parameters. Each can be overridden by an environment variable."""

from __future__ import annotations

import os
from dataclasses import dataclass, field


def _from_env(name: str, default, cast):
    return field(default_factory=lambda: cast(os.environ.get(name, default)))


@dataclass(frozen=True)
class GateThresholds:
    """Bars of the quality gates. A bar of zero is honoured."""

    min_records: int = _from_env("GATE_MIN_RECORDS", 1, int)
    completeness: float = _from_env("GATE_COMPLETENESS_MIN", 0.95, float)
    uniqueness: float = _from_env("GATE_UNIQUENESS_MIN", 0.99, float)
    validation_pass_rate: float = _from_env("GATE_VALIDATION_PASS_RATE_MIN", 0.95, float)
    embedding_coverage: float = _from_env("GATE_EMBEDDING_COVERAGE_MIN", 0.98, float)


@dataclass(frozen=True)
class Settings:
    gates: GateThresholds = field(default_factory=GateThresholds)
    embedding_dim: int = _from_env("EMBEDDING_DIM", 256, int)
    embedding_model: str = _from_env("EMBEDDING_MODEL", "hashing-tfidf-v1", str)
    idempotency_ttl_seconds: int = _from_env("IDEMPOTENCY_TTL_SECONDS", 86400, int)
    dispatch_ttl_seconds: int = _from_env("DISPATCH_TTL_SECONDS", 86400, int)
    max_deliveries: int = _from_env("EVENT_MAX_DELIVERIES", 3, int)
    relay_batch_size: int = _from_env("RELAY_BATCH_SIZE", 50, int)
    retain_versions: int = 3
    history_limit: int = 50
    max_upload_bytes: int = 50 * 1024 * 1024
