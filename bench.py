"""Time the registered queries; prints one JSON line.

BENCH_SF_DIR names the tables, BENCH_CPUS the cores. Each query runs once to warm up
and then twice; the better time counts. Results go to a sink that keeps nothing.
"""

from __future__ import annotations

import json
import os
import time

from vouchsafe.plans import catalog
from vouchsafe.session import build_session

HEADLINE = (
    "validate_split",
    "validation_pass_rate",
    "quarantine_reasons",
    "schema_fingerprint",
    "normalize_text",
    "dedup_keep_first",
    "dedup_report",
    "lineage_meta",
    "profile_fill_rates",
    "gate_suite",
    "gate_uniqueness",
    "hash_embed_sparse",
    "hash_embed_norms",
    "topk_search_batch",
    "text_search",
    "promotion_history",
    "rollback_target",
    "retention_drops",
    "version_lineage",
    "audit_health",
    "event_rate_sliding",
    "latency_p95",
    "dedup_ttl",
    "relay_report",
    "ingest_json_records",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "8g"},
    )
    times = {}
    for name in HEADLINE:
        best = None
        for attempt in range(3):
            started = time.perf_counter()
            catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - started
            if attempt:
                best = took if best is None else min(best, took)
        times[name] = round(best, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total time of the headline queries",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
