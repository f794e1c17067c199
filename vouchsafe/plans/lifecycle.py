"""The life of a dataset version: ingest, validate, enrich, embed, judge, publish or refuse.

Two snapshots carry a version: ``validated`` holds every record with its reasons,
``embedded`` the enriched valid records with their vectors. Each is written once, so
a run that was cut short continues where it stopped. Only one-row summaries, the
checks and the decision reach the driver.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vouchsafe import model
from vouchsafe.functions.text import TEXT_FIELDS
from vouchsafe.operators import contracts as C
from vouchsafe.operators import embedding as M
from vouchsafe.operators import enrichment as E
from vouchsafe.operators import fingerprint as P
from vouchsafe.operators import gates as G
from vouchsafe.operators import ledger as L
from vouchsafe.operators import search as S
from vouchsafe.session import prepare, small_frame
from vouchsafe.settings import Settings
from vouchsafe.sources import json_records as J
from vouchsafe.sources.manifest import latest_per_group, list_objects
from vouchsafe.sources.zones import Zones, as_json


@dataclass(frozen=True)
class Batch:
    """Records to publish: JSON records in ``record``, or a typed table if that is None."""

    df: DataFrame
    order: tuple[str, ...] = ("_pos",)
    key: str = "id"
    record: str | None = "rec"
    text_fields: tuple[str, ...] = TEXT_FIELDS


@dataclass
class Run:
    version_id: str
    dataset: str
    trigger: str
    decision: str = ""
    passed: bool = False
    serving: str | None = None
    stages: list[tuple[str, str, dict[str, Any]]] = field(default_factory=list)
    reports: dict[str, dict[str, Any]] = field(default_factory=dict)

    def note(self, stage: str, status: str, **metrics: Any) -> None:
        self.stages.append((stage, status, metrics))

    def trace(self, spark: SparkSession) -> DataFrame:
        """One row per stage: number, stage, status, metrics as JSON."""
        rows = [
            {"ord": i, "stage": s, "status": status, "metrics": as_json(m)}
            for i, (s, status, m) in enumerate(self.stages)
        ]
        return small_frame(spark, rows, "ord INT, stage STRING, status STRING, metrics STRING")


def decision_row(dataset, version_id, decision, source, target, reason, summary) -> dict[str, Any]:
    return {
        "dataset": dataset, "version_id": version_id, "decision": decision, "from_target": source,
        "to_target": target, "reason": reason, "gate_summary": summary,
        "decided_at": datetime.now(timezone.utc).replace(tzinfo=None),
    }


class GovernancePlane:
    """Runs versions and answers questions about what they left behind."""

    def __init__(
        self,
        spark: SparkSession,
        base: str,
        settings: Settings | None = None,
        embedder: M.Embedder | None = None,
        contracts: dict[str, C.Contract] | None = None,
    ):
        self.spark = prepare(spark)
        self.zones = Zones(spark, base)
        self.settings = settings or Settings()
        self.embedder = embedder or M.HashingEmbedder(
            self.settings.embedding_dim, self.settings.embedding_model
        )
        self.contracts = contracts or {}

    # ------------------------------------------------------------ registry views

    def versions(self) -> DataFrame:
        return L.current_versions(
            self.zones.table("dataset_versions"), self.zones.table("transitions")
        )

    def promotions(self) -> DataFrame:
        return self.zones.table("promotions")

    def reports(self) -> DataFrame:
        return self.zones.table("quality_reports")

    def serving(self, dataset: str) -> str | None:
        alias = L.serving_alias(self.promotions().where(F.col("dataset") == dataset)).first()
        return alias["version_id"] if alias else None

    def version_detail(self, version_id: str) -> DataFrame:
        chosen = F.col("version_id") == version_id
        return L.version_detail(
            self.versions().where(chosen),
            self.reports().where(chosen),
            self.zones.quarantine().where(chosen),
        )

    def contract(self, dataset: str) -> C.Contract:
        return self.contracts.get(dataset) or C.contract_for(dataset)

    # ------------------------------------------------------------ a run

    def run(
        self,
        dataset: str,
        batch: Batch,
        trigger: str = "manual",
        version_id: str | None = None,
        source_uri: str = "",
    ) -> Run:
        """Take a batch through all stages to a decision.

        A version is decided once. Running a decided one again returns what the ledger holds
        and changes nothing: not the statuses, not the reports, and no collection is dropped.
        """
        version_id = version_id or model.new_version_id(dataset)
        run = Run(version_id, dataset, trigger)
        decided = self._decided(version_id)
        if decided:
            return self._recorded(run, decided)
        now = datetime.now(timezone.utc).replace(tzinfo=None)
        self._register(run, source_uri, now)

        validated = self.zones.snapshot(
            version_id, "validated",
            lambda: C.validate(batch.df, self.contract(dataset), batch.record),
        )
        summary, drift = self._validate(run, batch, validated)
        self._profile(run, batch, validated)
        embedded = self.zones.snapshot(
            version_id, "embedded", lambda: self._enriched(run, batch, validated, now)
        )
        checks, verdict = self._judge(run, batch, summary, drift, embedded)
        self._decide(run, batch, verdict, embedded)
        self.zones.write_reports(version_id, run.reports)
        return run

    def _decided(self, version_id: str):
        """The ledger's first decision on a version, if there is one."""
        return (
            self.promotions()
            .where(
                (F.col("version_id") == version_id)
                & F.col("decision").isin(model.PROMOTED, model.REJECTED)
            )
            .orderBy("id")
            .first()
        )

    def _recorded(self, run: Run, decided) -> Run:
        """The outcome of a decided version, from the ledger.

        A run that was cut short right after its ledger row left the version's status behind;
        only that is made good.
        """
        run.decision = decided["decision"]
        run.passed = run.decision == model.PROMOTED
        run.serving = self.serving(run.dataset)
        status = self.versions().where(F.col("version_id") == run.version_id).first()
        if status and status["status"] not in model.TERMINAL_STATUSES:
            self._status(run.version_id, {"status": run.decision})
        run.note(
            "promote", "recorded", decision=run.decision, now_serving=run.serving,
            previous=decided["from_target"],
        )
        return run

    def _register(self, run: Run, source_uri: str, now: datetime) -> None:
        row = {
            "dataset": run.dataset, "version_id": run.version_id, "source_uri": source_uri,
            "pipeline": "lifecycle", "trigger_type": run.trigger, "status": "ingested",
            "record_count": None, "schema_hash": None, "created_at": now, "updated_at": now,
        }

        def unless_known() -> list[dict[str, Any]]:
            versions = self.zones.table("dataset_versions")
            return [row] if versions.where(F.col("version_id") == run.version_id).isEmpty() else []

        with self.zones.lock:
            self.zones.append("dataset_versions", unless_known)

    def _status(self, version_id: str, *changes: dict[str, Any]) -> None:
        now = datetime.now(timezone.utc).replace(tzinfo=None)
        rows = [{"version_id": version_id, "at": now, **change} for change in changes]
        self.zones.append("transitions", rows)

    def _validate(self, run: Run, batch: Batch, validated: DataFrame):
        summary = C.validation_summary(validated).first()
        run.note("ingest", "done", raw_records=summary["total"], version_id=run.version_id)
        order = list(batch.order)
        if batch.record:
            fingerprint = P.schema_fingerprint(validated, order, batch.record)
        else:
            fingerprint = P.typed_schema_fingerprint(validated.drop(C.REASONS))
        row = fingerprint.first()
        current = row["schema_hash"]
        versions = self.versions().where(F.col("dataset") == run.dataset)
        baseline = P.last_promoted_hash(versions.where(F.col("version_id") != run.version_id)).first()
        previous = baseline["schema_hash"] if baseline else None
        hashes = [{"previous_hash": previous, "current_hash": current}]
        drift = P.detect_drift(
            small_frame(self.spark, hashes, "previous_hash STRING, current_hash STRING")
        ).first().asDict()
        read = C.field_reader(validated, batch.record)
        if summary["quarantined"]:
            payload = (
                F.to_json(F.col(batch.record))
                if batch.record
                else F.to_json(F.struct(*[c for c in batch.df.columns if not c.startswith("_")]))
            )
            rows = C.quarantine_rows(
                validated, F.lit(run.version_id), read(batch.key).as_string, payload
            ).withColumn("created_at", F.current_timestamp())
            self.zones.write_quarantine(run.version_id, rows)
        samples = C.quarantine_samples(validated, order, read(batch.key).as_string).collect()
        metrics = {
            "valid": summary["valid"],
            "quarantined": summary["quarantined"],
            "pass_rate": round(summary["pass_rate"], 4),
            "schema_hash": current,
            "drift": drift,
            "quarantine_samples": [{"reason": s["reason"], "id": s["id"]} for s in samples],
        }
        change = {"status": "validated", "record_count": summary["valid"], "schema_hash": current}
        self._status(run.version_id, change)
        run.reports["validation_report"] = metrics
        run.note("validate", "done", **metrics)
        return summary, drift

    def _profile(self, run: Run, batch: Batch, validated: DataFrame) -> None:
        valid = C.valid_records(validated)
        rates = E.variant_fill_rates(valid, batch.record) if batch.record else E.fill_rates(valid)
        self.zones.write_artifact(run.version_id, "profile", rates.orderBy("field"))

    def _enriched(self, run: Run, batch: Batch, validated: DataFrame, now: datetime) -> DataFrame:
        valid, at = C.valid_records(validated), F.lit(now)
        order = list(batch.order)
        if batch.record:
            enriched = E.enrich_records(
                valid, run.version_id, at, batch.key, order, batch.record, batch.text_fields
            )
        else:
            enriched = E.enrich_table(
                valid, run.version_id, at, batch.key, order, batch.text_fields
            )
        return M.embed(enriched, self.embedder)

    def _judge(self, run: Run, batch: Batch, summary, drift, embedded: DataFrame):
        contract = self.contract(run.dataset)
        read = C.field_reader(embedded, batch.record)
        measured = embedded.agg(
            *G.measures(read, list(contract.required), batch.key), M.coverage().alias("coverage")
        )
        measured_row = measured.first()
        one = small_frame(
            self.spark, [measured_row.asDict()],
            ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in measured.schema),
        )
        rows, coverage = measured_row["rows"], measured_row["coverage"]
        removed = summary["valid"] - rows
        enrichment = {
            "input_records": summary["valid"], "output_records": rows,
            "duplicates_removed": removed,
        }
        run.reports["enrichment_report"] = enrichment
        run.note("enrich", "done", **enrichment)
        embedding = {
            "model": self.embedder.model, "dim": self.embedder.dim, "total": rows,
            "embedded": round(coverage * rows), "coverage": coverage,
        }
        run.reports["embedding_report"] = embedding
        run.note("embed", "done", **embedding)

        inputs = G.GateInputs(
            F.lit(summary["pass_rate"]), F.col("coverage"), F.lit(drift["drifted"]),
            F.lit(as_json(drift)),
        )
        checks = G.gate_suite(one, inputs, batch.key, self.settings.gates)
        verdict = G.gate_summary(G.verdict(checks), F.lit(run.version_id)).first()
        now = datetime.now(timezone.utc).replace(tzinfo=None)
        report = [
            {"version_id": run.version_id, "created_at": now, **row.asDict()}
            for row in checks.drop("ord").collect()
        ]

        def unless_reported() -> list[dict[str, Any]]:
            return report if self.reports().where(F.col("version_id") == run.version_id).isEmpty() else []

        self.zones.append("quality_reports", unless_reported)
        self._status(
            run.version_id,
            {"status": "enriched", "record_count": rows}, {"status": "embedded"}, {"status": "gated"},
        )
        run.passed = verdict["passed"]
        shown = [c.asDict() for c in verdict["checks"]]
        run.reports["quality_report"] = {"passed": run.passed, "checks": shown}
        run.note("gate", "done" if run.passed else "failed", passed=run.passed, checks=shown)
        return checks, verdict

    def _decide(self, run: Run, batch: Batch, verdict, embedded: DataFrame) -> None:
        dataset, version_id = run.dataset, run.version_id
        if run.passed:
            # Without the ledger row below a collection is never served.
            payload = [c for c in embedded.columns if c not in ("_vector", "_dedup_key")]
            placed, position = S.positions(embedded, list(batch.order))
            points = S.stage_points(placed, position, payload).withColumn(
                "vector", F.col("vector").cast("array<float>")
            )
            self.zones.write_collection(dataset, version_id, points)
        reason = (
            L.ALL_PASSED if run.passed
            else "failed gates: " + ", ".join(verdict["failed_checks"])
        )
        run.decision = model.PROMOTED if run.passed else model.REJECTED

        def unless_decided() -> list[dict[str, Any]]:
            """The decision, on what serves now; none if another run of the version decided meanwhile."""
            if self._decided(version_id):
                return []
            target = version_id if run.passed else None
            return [decision_row(dataset, version_id, run.decision, self.serving(dataset), target, reason,
                                 verdict["gate_summary"])]

        with self.zones.lock:
            committed = self.zones.append("promotions", unless_decided)
            if not committed:
                self._recorded(run, self._decided(version_id))
                return
            previous = committed[0]["from_target"]
            if run.passed:
                self.apply_retention(dataset, previous)
        self._status(version_id, {"status": run.decision})
        run.serving = self.serving(dataset)
        metrics = {
            "decision": run.decision, "now_serving": run.serving, "previous": previous,
            "failed_gates": verdict["failed_checks"],
        }
        run.reports["promotion_decision"] = metrics
        run.note("promote", "done" if run.passed else "skipped", **metrics)

    def apply_retention(self, dataset: str, previous: str | None = None) -> list[str]:
        """Drop collections beyond the retention window and name them.

        What serves now always stays, whoever asks, and so does ``previous``. Collections
        without a promotion belong to runs that are not decided yet and are left alone.
        """
        mine = self.promotions().where(F.col("dataset") == dataset)
        kept = [{"dataset": dataset, "version_id": v} for v in (self.serving(dataset), previous)]
        keep = small_frame(self.spark, kept, "dataset STRING, version_id STRING")
        live = self.zones.live_collections(dataset).join(
            L.promoted_places(mine), ["dataset", "version_id"], "left_semi"
        )
        drops = L.retention_drops(live, keep, mine, self.settings.retain_versions)
        names = sorted(row["version_id"] for row in drops.collect())
        for name in names:
            self.zones.drop_collection(dataset, name)
        return names

    # ------------------------------------------------------------ rollback and search

    def rollback(self, dataset: str, reason: str = "manual rollback") -> dict[str, Any]:
        """Serve the version promoted before the current one, if its collection still exists."""

        def to_previous() -> list[dict[str, Any]]:
            mine = self.promotions().where(F.col("dataset") == dataset)
            found = L.rollback_targets(mine, self.zones.live_collections(dataset)).first()
            if not found or not found["target_version"]:
                return []
            left, target = found["current_version"], found["target_version"]
            return [decision_row(dataset, target, model.ROLLED_BACK, left, target, reason, "{}")]

        with self.zones.lock:
            committed = self.zones.append("promotions", to_previous)
        if not committed:
            return {"decision": model.ROLLBACK_FAILED, "reason": L.NO_LIVE_PREVIOUS}
        left, target = committed[0]["from_target"], committed[0]["to_target"]
        self._status(left, {"status": model.ROLLED_BACK})
        return {"decision": model.ROLLED_BACK, "now_serving": target, "previous": left}

    def search(self, dataset: str, text: str, limit: int = 5) -> DataFrame | None:
        """The best records of what is served now; None if nothing is."""
        if not text.strip():
            raise ValueError("the query must not be empty")
        serving = self.serving(dataset)
        if serving is None:
            return None
        # The query goes through the embedder that made the points.
        one = small_frame(self.spark, [{"text": text}], "text STRING")
        vector = list(one.select(self.embedder.vector(F.col("text"))).first()[0])
        points = self.zones.collection(dataset, serving)
        hits = S.search(points, vector, limit)
        return S.present(hits).withColumn("version_id", F.lit(serving))

    # ------------------------------------------------------------ raw zone

    def run_file(
        self, dataset: str, path: str, trigger: str = "event", version_id: str | None = None
    ) -> Run:
        """Publish one raw JSON or JSON-lines file.

        The name decides how it is read, whatever its size: ``.jsonl`` and ``.ndjson`` files are
        lines and are read in splits; any other file is one document, or lines, in one row.
        """
        if path.lower().endswith((".jsonl", ".ndjson")):
            records = J.read_json_lines(self.spark, path)
            bad = J.first_bad_line(self.spark, path)
            if bad is not None:
                raise ValueError(f"{J.BAD_LINE}{bad}")
            order = ("path", "_block", "_pos")
            return self.run(dataset, Batch(records, order), trigger, version_id, path)
        records, rejected = J.read_json_records(self.spark, path)
        refusal = rejected.first()
        if refusal:
            raise ValueError(refusal["error"])
        return self.run(dataset, Batch(records, ("path", "_pos")), trigger, version_id, path)

    def latest_raw(self, dataset: str) -> str | None:
        """The newest raw object of a dataset."""
        folder = self.zones.path("raw", dataset)
        if not self.zones.exists(folder):
            return None
        files = list_objects(self.spark, folder).withColumn("dataset", F.lit(dataset))
        newest = latest_per_group(files, ["dataset"], "path", "modified").first()
        return newest["path"] if newest else None

    def rebuild(self, datasets: list[str], concurrency: int = 2) -> dict[str, Run | None]:
        """Run each dataset again on its newest raw object, a few at a time."""

        def one(dataset: str) -> Run | None:
            path = self.latest_raw(dataset)
            return self.run_file(dataset, path, "schedule") if path else None

        with ThreadPoolExecutor(concurrency) as pool:
            return dict(zip(datasets, pool.map(one, datasets)))

    def with_settings(self, **gates: Any) -> GovernancePlane:
        """The same plane under other gate thresholds."""
        settings = replace(self.settings, gates=replace(self.settings.gates, **gates))
        return GovernancePlane(
            self.spark, self.zones.base, settings, self.embedder, self.contracts
        )
