"""The life of versions, end to end, on JSON files and typed tables."""

import json
import os

import pytest

from vouchsafe.operators.contracts import Contract
from vouchsafe.plans.lifecycle import Batch, GovernancePlane
from vouchsafe.settings import GateThresholds, Settings
from vouchsafe.streaming.arrivals import run_on_arrival

GOOD = [
    {"id": f"P{i:04d}", "title": f"Gadget number {i}", "category": "audio", "price": 9.5 + i,
     "description": "a fine thing", "brand": "Nadir", "in_stock": i % 2 == 0}
    for i in range(20)
]
BAD = (
    GOOD[:10] + GOOD[:2]
    + [{**GOOD[3], "id": "empty-title", "title": ""}]
    + [{k: v for k, v in {**GOOD[4], "id": "no-title"}.items() if k != "title"}]
    + [{**GOOD[5], "id": "cheap", "price": -0.25}]
    + [{**GOOD[6], "id": "short", "title": "Q"}]
    + [{**GOOD[7], "id": "wordy", "price": "ten"}]
)


@pytest.fixture
def plane(spark, tmp_path):
    settings = Settings(gates=GateThresholds(min_records=5), embedding_dim=64)
    return GovernancePlane(spark, str(tmp_path / "zones"), settings)


def land(plane, dataset, name, records):
    folder = plane.zones.path("raw", dataset)
    os.makedirs(folder, exist_ok=True)
    path = f"{folder}/{name}"
    with open(path, "w") as out:
        out.write(records if isinstance(records, str) else json.dumps(records, indent=1))
    return path


def metrics(run, stage):
    return next(m for s, _, m in run.stages if s == stage)


def test_promote_reject_promote_rollback(plane):
    first = plane.run_file("products", land(plane, "products", "a.json", GOOD), "manual")
    assert (first.decision, first.passed, first.serving) == ("promoted", True, first.version_id)
    checks = metrics(first, "gate")["checks"]
    assert [c["check"] for c in checks] == [
        "min_records", "completeness", "uniqueness", "validation_pass_rate",
        "embedding_coverage", "schema_drift",
    ]

    bad = plane.run_file("products", land(plane, "products", "b.json", BAD), "manual")
    assert bad.decision == "rejected" and bad.serving == first.version_id
    assert metrics(bad, "promote")["failed_gates"] == ["validation_pass_rate"]
    seen = metrics(bad, "validate")
    assert (seen["valid"], seen["quarantined"], seen["pass_rate"]) == (12, 5, 0.7059)
    assert not seen["drift"]["drifted"]
    assert [q["reason"] for q in seen["quarantine_samples"]] == [
        "missing required field 'title'; field 'title' shorter than 2",
        "missing required field 'title'",
        "field 'price' below min 0",
        "field 'title' shorter than 2",
        "field 'price' expected number, got str",
    ]
    assert metrics(bad, "enrich") == {
        "input_records": 12, "output_records": 10, "duplicates_removed": 2,
    }
    assert plane.zones.quarantine().where(f"version_id = '{bad.version_id}'").count() == 5

    lines = "\n".join(json.dumps(r) for r in GOOD[:12])
    third = plane.run_file("products", land(plane, "products", "c.jsonl", lines), "manual")
    assert third.decision == "promoted" and plane.serving("products") == third.version_id

    back = plane.rollback("products", "test")
    assert back["now_serving"] == first.version_id
    assert plane.serving("products") == first.version_id
    assert plane.rollback("products")["decision"] == "rollback_failed"
    status = {r["version_id"]: r["status"] for r in plane.versions().collect()}
    assert status == {
        first.version_id: "promoted", bad.version_id: "rejected", third.version_id: "rolled_back",
    }
    assert first.trace(plane.spark).count() == 6
    assert {r["kind"] for r in plane.version_detail(bad.version_id).collect()} == {"check", "quarantine"}
    assert plane.zones.read_artifact(first.version_id, "profile").where("field = 'title'").first()["fill_rate"] == 1.0


def test_search_reads_what_serves(plane):
    assert plane.search("products", "gadget") is None
    run = plane.run_file("products", land(plane, "products", "a.json", GOOD), "manual")
    hits = plane.search("products", "gadget number 7", 3).collect()
    assert len(hits) == 3 and hits[0]["version_id"] == run.version_id
    assert json.loads(str(hits[0]["rec"]))["id"] == "P0007"
    with pytest.raises(ValueError):
        plane.search("products", "  ")


def test_drift_blocks_a_changed_schema(plane):
    plane.run_file("products", land(plane, "products", "a.json", GOOD), "manual")
    changed = [{**r, "colour": "red"} for r in GOOD]
    run = plane.run_file("products", land(plane, "products", "b.json", changed), "manual")
    assert metrics(run, "promote")["failed_gates"] == ["schema_drift"]


def state(plane):
    tables = (plane.promotions(), plane.versions(), plane.reports(), plane.zones.table("transitions"))
    return [sorted(map(str, t.collect())) for t in tables] + [
        sorted(map(str, plane.zones.live_collections("products").collect())),
        plane.zones.quarantine().count(),
    ]


def test_a_repeated_run_changes_nothing(plane):
    path = land(plane, "products", "a.json", BAD)
    one = plane.run_file("products", path, "manual", "products-x")
    before = state(plane)
    again = plane.run_file("products", path, "manual", "products-x")
    assert (one.decision, again.decision) == ("rejected", "rejected")
    assert state(plane) == before


def test_a_replay_never_drops_what_serves(plane):
    for name in "DCBA":  # promoted against the order of their names
        plane.run_file("products", land(plane, "products", f"{name}.json", GOOD), "manual", name)
    live = lambda: {r["version_id"] for r in plane.zones.live_collections("products").collect()}
    assert plane.serving("products") == "A" and live() == {"A", "B", "C"}
    before = state(plane)
    for name in "DCB":
        again = plane.run_file("products", land(plane, "products", "r.json", GOOD), "manual", name)
        assert (again.decision, again.serving) == ("promoted", "A")
    assert state(plane) == before
    assert plane.search("products", "gadget").count() == 5


def test_a_replay_after_a_rollback_keeps_the_history(plane):
    for name in ("v1", "v2"):
        plane.run_file("products", land(plane, "products", f"{name}.json", GOOD), "manual", name)
    plane.rollback("products")
    before = state(plane)
    changed = [{**r, "colour": "red"} for r in GOOD]
    plane.run_file("products", land(plane, "products", "v2.json", changed), "manual", "v2")
    assert state(plane) == before and plane.serving("products") == "v1"


def test_a_run_cut_short_after_its_ledger_row(plane):
    plane.run_file("products", land(plane, "products", "a.json", GOOD), "manual", "v1")
    plane._status("v1", {"status": "gated"})
    plane.run_file("products", land(plane, "products", "a.json", GOOD), "manual", "v1")
    assert plane.versions().first()["status"] == "promoted"


def test_rollback_beyond_fifty_promotions(spark):
    from vouchsafe.operators import ledger as L

    rows = [(i, f"v{i:03d}", "promoted", "d") for i in range(1, 61)] + [(61, "v005", "rolled_back", "d")]
    promotions = spark.createDataFrame(rows, "id INT, version_id STRING, decision STRING, dataset STRING")
    live = spark.createDataFrame([("d", r[1]) for r in rows[:60]], "dataset STRING, version_id STRING")
    assert L.rollback_targets(promotions, live).first()["target_version"] == "v004"
    current = spark.createDataFrame([("d", "v060")], "dataset STRING, current STRING")
    assert L.previous_promoted(promotions, current).first()["previous_version"] == "v059"


def test_a_folder_of_files_gives_every_record_its_own_id(plane):
    for i in range(4):
        land(plane, "parts", f"{i}.json", GOOD[5 * i : 5 * i + 5])
    run = plane.run_file("parts", plane.zones.path("raw", "parts"), "manual")
    points = plane.zones.collection("parts", run.version_id)
    got = {r["id"]: json.loads(str(r["rec"]))["id"] for r in points.collect()}
    assert got == {i: f"P{i:04d}" for i in range(20)}


def test_the_query_goes_through_the_embedder(spark, tmp_path):
    from pyspark.sql import functions as F

    class Lengths:
        """Texts of odd length look one way, those of even length another."""

        dim, model = 2, "parity"

        def vector(self, text):
            odd = F.length(text) % 2
            return F.when(F.length(text) > 0, F.array(odd.cast("double"), (1 - odd).cast("double")))

    settings = Settings(gates=GateThresholds(min_records=2), embedding_dim=2)
    plane = GovernancePlane(spark, str(tmp_path / "zones"), settings, Lengths())
    plane.run_file("notes", land(plane, "notes", "n.json", [
        {"id": "odd", "title": "abc", "category": "c", "price": 1.0},
        {"id": "even", "title": "abcd", "category": "c", "price": 1.0},
    ]), "manual")
    for text, want in (("x", "odd"), ("xy", "even")):
        hit = plane.search("notes", text, 1).first()
        assert json.loads(str(hit["rec"]))["id"] == want


def test_json_keys_keep_their_type(json_batch):
    from vouchsafe.functions.records import VariantField
    from pyspark.sql import functions as F

    keys = [1, 1.0, True, "true", "1", False, 2.5, None, [1], 10**20]
    rows = json_batch([{"id": k} for k in keys]).orderBy("_pos")
    got = [r[0] for r in rows.select(VariantField(F.col("rec"), "id").as_string).collect()]
    assert got == ["1", "1.0", "True", "true", "1", "False", "2.5", None, "[1]", str(10**20)]


def test_retention_keeps_three_collections(plane):
    runs = [
        plane.run_file("products", land(plane, "products", f"{i}.json", GOOD[: 10 + i]), "manual", f"v{i}")
        for i in range(5)
    ]
    assert all(r.decision == "promoted" for r in runs)
    live = sorted(r["version_id"] for r in plane.zones.live_collections("products").collect())
    assert live == ["v2", "v3", "v4"]


def test_an_empty_version_is_rejected(plane):
    run = plane.run_file("products", land(plane, "products", "e.json", "[]"), "manual")
    assert run.decision == "rejected"
    assert metrics(run, "promote")["failed_gates"] == [
        "min_records", "validation_pass_rate", "embedding_coverage",
    ]


def test_records_that_are_no_objects(plane):
    mixed = [5, "x", *GOOD[:10]]
    run = plane.run_file("products", land(plane, "products", "m.json", mixed), "manual")
    reasons = {r["reason"]: r["record_key"] for r in plane.zones.quarantine().collect()}
    assert reasons == {"record is not an object": ""}
    assert metrics(run, "validate")["quarantined"] == 2


def test_typed_tables_run_too(spark, plane):
    documents = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plane.contracts["docs"] = Contract(
        required=("doc_id", "text"), types={"doc_id": "int"}, constraints={"text": {"min_length": 10}}
    )
    run = plane.run("docs", Batch(documents, ("doc_id",), "doc_id", None))
    assert run.decision == "promoted"
    assert plane.zones.collection("docs", run.version_id).count() == metrics(run, "enrich")["output_records"]


def test_rebuild_takes_the_newest_file(plane):
    old = land(plane, "products", "old.json", GOOD[:6])
    os.utime(old, (1_000_000_000, 1_000_000_000))
    land(plane, "products", "new.json", GOOD)
    runs = plane.rebuild(["products", "documents"])
    assert runs["documents"] is None
    assert runs["products"].trigger == "schedule"
    assert metrics(runs["products"], "ingest")["raw_records"] == 20


def test_arriving_files_start_versions_once(plane, tmp_path):
    land(plane, "products", "a.json", GOOD)
    land(plane, "products", "b.json", "{oops")
    checkpoint = str(tmp_path / "checkpoint")
    run_on_arrival(plane, checkpoint).awaitTermination()
    assert plane.versions().count() == 1
    # Nothing new: nothing runs. The same content under a new name is the same version.
    run_on_arrival(plane, checkpoint).awaitTermination()
    land(plane, "products", "copy.json", GOOD)
    run_on_arrival(plane, checkpoint).awaitTermination()
    assert plane.versions().count() == 1 and plane.promotions().count() == 1


def test_bad_files_are_refused(plane):
    with pytest.raises(ValueError, match="line 2"):
        plane.run_file("products", land(plane, "products", "x.jsonl", '{"id": 1}\n{bad}'), "manual")


def test_the_name_decides_how_a_file_is_read(spark, tmp_path):
    settings = Settings(gates=GateThresholds(min_records=5), embedding_dim=16, max_upload_bytes=100)
    plane = GovernancePlane(spark, str(tmp_path / "zones"), settings)
    lines = "\n".join(json.dumps(r) for r in GOOD + GOOD[:3])
    run = plane.run_file("products", land(plane, "products", "big.jsonl", lines), "manual")
    assert run.decision == "promoted"
    assert metrics(run, "enrich")["duplicates_removed"] == 3
    with pytest.raises(ValueError, match="line 25"):
        plane.run_file("products", land(plane, "products", "bad.jsonl", lines + "\n\n{oops"), "manual")
    one_line = json.dumps(GOOD)
    run = plane.run_file("products", land(plane, "products", "array.json", one_line), "manual")
    assert metrics(run, "ingest")["raw_records"] == 20 and run.decision == "promoted"
