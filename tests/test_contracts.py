"""Contracts, fingerprints and gates on JSON and typed records."""

import pytest
from pyspark.sql import functions as F

from vouchsafe.operators import contracts as C
from vouchsafe.operators import fingerprint as P
from vouchsafe.operators import gates as G
from vouchsafe.settings import GateThresholds


def judge(batch, contract):
    rows = C.validate(batch, contract, "rec").orderBy("_pos").collect()
    return [list(r["reasons"]) for r in rows]


PRODUCTS = C.CONTRACTS["products"]


def test_valid_batch(json_batch, make_product):
    batch = json_batch([make_product(i) for i in range(20)])
    summary = C.validation_summary(C.validate(batch, PRODUCTS, "rec")).first()
    assert (summary["valid"], summary["quarantined"], summary["pass_rate"]) == (20, 0, 1.0)


@pytest.mark.parametrize(
    "changes, reasons",
    [
        ({"title": ""}, ["missing required field 'title'", "field 'title' shorter than 2"]),
        ({"title": ...}, ["missing required field 'title'"]),
        ({"title": None}, ["missing required field 'title'"]),
        ({"title": "  "}, []),
        ({"title": []}, ["field 'title' expected str, got list"]),
        ({"title": {"a": 1}}, ["field 'title' expected str, got dict"]),
        ({"price": -5}, ["field 'price' below min 0"]),
        ({"price": 0}, []),
        ({"price": 5}, []),
        ({"price": True}, []),
        ({"price": "12.5"}, ["field 'price' expected number, got str"]),
        ({"price": "free"}, ["field 'price' expected number, got str"]),
        ({"title": "\U0001F600"}, ["field 'title' shorter than 2"]),
        ({"id": 5}, ["field 'id' expected str, got int"]),
        ({"id": 5.5}, ["field 'id' expected str, got float"]),
        ({"id": 2.0}, ["field 'id' expected str, got float"]),
        ({"id": 2**70}, ["field 'id' expected str, got int"]),
        ({"id": False}, ["field 'id' expected str, got bool"]),
    ],
)
def test_reasons(json_batch, make_product, changes, reasons):
    assert judge(json_batch([make_product(1, **changes)]), PRODUCTS) == [reasons]


def test_max_and_allowed(json_batch):
    contract = C.Contract(constraints={"n": {"max": 3}, "c": {"allowed": ["a", 1, None]}})
    records = [
        {"n": 3, "c": "a"}, {"n": 3.5, "c": 1.0}, {"n": "9", "c": "b"}, {"c": True}, {"c": None},
        {"c": "1"}, {"c": [1]},
    ]
    outside = "field 'c' not in allowed set"
    assert judge(json_batch(records), contract) == [
        [], ["field 'n' above max 3"], [outside], [], [], [outside], [outside],
    ]


def test_unknown_types_and_odd_names(json_batch):
    contract = C.Contract(required=("it's", "a b"), types={"a b": "decimal"})
    assert judge(json_batch([{"it's": 1, "a b": 2}, {"a b": ""}]), contract) == [
        [], ["missing required field 'it's'", "missing required field 'a b'"],
    ]


def test_no_objects_and_no_contract(json_batch):
    assert judge(json_batch([[1], 5, {"id": 1}]), C.FALLBACK_CONTRACT) == [
        [C.NOT_AN_OBJECT], [C.NOT_AN_OBJECT], [],
    ]
    assert judge(json_batch([{}]), C.Contract()) == [[]]


def test_typed_rows_agree_with_json(spark, json_batch):
    contract = C.Contract(
        required=("id", "t"), types={"id": "str", "n": "int", "missing": "str"},
        constraints={"n": {"min": 0, "max": 5}, "t": {"min_length": 3, "allowed": ["abc", "abcd"]}},
    )
    rows = [("a", "abc", 1), (None, "", -1), ("", "ab", 9), ("b", None, None)]
    typed = spark.createDataFrame(rows, "id STRING, t STRING, n BIGINT")
    as_json = json_batch([dict(zip(("id", "t", "n"), r)) for r in rows])
    mine = [list(r["reasons"]) for r in C.validate(typed, contract).collect()]
    assert sorted(mine) == sorted(judge(as_json, contract))


@pytest.mark.parametrize(
    "records, expected",
    [
        ([{"id": "1", "title": "t", "category": "c", "price": 1.5, "description": "d", "brand": "b",
           "in_stock": True}], "54b056680225c097"),
        ([{"author": "a", "content": "c", "id": "i", "title": "t"}], "8505b15233fa2ec8"),
    ],
)
def test_known_fingerprints(json_batch, records, expected):
    assert P.schema_fingerprint(json_batch(records), ["_pos"], "rec").first()[0] == expected


def test_fingerprint_rules(json_batch):
    def fingerprint(records, **options):
        return P.schema_fingerprint(json_batch(records), ["_pos"], "rec", **options).first()[0]

    base = fingerprint([{"a": 1, "b": "x"}])
    assert fingerprint([{"b": "other", "a": 7}]) == base
    assert fingerprint([{"a": 1.5, "b": "x"}]) != base
    assert fingerprint([{"a": 1, "b": "x", "c": None}]) != base
    assert fingerprint([{"a": None, "b": "x"}, {"a": 1}]) != base
    assert fingerprint([{"a": None, "b": "x"}, {"a": 1}], ignore_nulls=True) == base
    assert fingerprint([5, {"a": 1, "b": "x"}]) == base
    late = [{"a": 1, "b": "x"}] * 200 + [{"new": 1}]
    assert fingerprint(late) != base and fingerprint(late, leading=200) == base
    # The text that is hashed is ASCII JSON.
    import hashlib
    import json

    fields = {"grü\"n": "int"}
    expected = hashlib.sha256(json.dumps(fields, sort_keys=True).encode()).hexdigest()[:16]
    assert fingerprint([{"grü\"n": 1}]) == expected


def test_drift_cases(spark):
    rows = [(None, "x"), ("x", "x"), ("x", "y")]
    df = spark.createDataFrame(rows, "previous_hash STRING, current_hash STRING")
    found = {(r[0], r[1]): (r["drifted"], r["reason"]) for r in P.detect_drift(df).collect()}
    assert found == {
        (None, "x"): (False, P.FIRST_INGEST), ("x", "x"): (False, P.STABLE), ("x", "y"): (True, P.CHANGED),
    }


def suite(batch, required=("id", "title"), bars=None, rate=1.0, coverage=None, drifted=None):
    measured = batch.agg(*G.measures(C.field_reader(batch, "rec"), list(required), "id"))
    inputs = G.GateInputs(
        F.lit(rate), None if coverage is None else F.lit(coverage),
        None if drifted is None else F.lit(drifted),
    )
    return G.gate_suite(measured, inputs, "id", bars)


def checks_of(df):
    return {r["check_name"]: r for r in df.collect()}


def test_all_gates_pass(json_batch, make_product):
    df = suite(json_batch([make_product(i) for i in range(20)]), coverage=1.0, drifted=False)
    assert [r["check_name"] for r in df.orderBy("ord").collect()] == list(G.CHECKS)
    verdict = G.verdict(df).first()
    assert verdict["passed"] and verdict["failed_checks"] == [] and verdict["total_checks"] == 6


def test_uniqueness_counts_missing_keys(json_batch):
    check = checks_of(suite(json_batch([{"id": "A"}, {"id": "B"}, {}, {}]), required=()))["uniqueness"]
    assert check["score"] == 0.5 and not check["passed"]
    assert '"records_missing_key":2' in check["details"]
    keyless = checks_of(suite(json_batch([{}, {}]), required=()))["uniqueness"]
    assert keyless["score"] == 0.0 and not keyless["passed"]
    same = checks_of(suite(json_batch([{"id": 1}, {"id": "1"}]), required=()))["uniqueness"]
    assert same["score"] == 0.5


def test_completeness_counts_empty_lists(json_batch):
    records = [{"id": "1", "title": "x"}, {"id": "2", "title": []}, {"id": "", "title": None}, {"id": "4"}]
    check = checks_of(suite(json_batch(records)))["completeness"]
    assert check["score"] == 0.5 and check["details"] == '{"filled_cells":4,"total_cells":8}'


def test_empty_version(json_batch):
    checks = checks_of(suite(json_batch([]), rate=0.0, coverage=0.0))
    assert {n for n, r in checks.items() if not r["passed"]} == {
        "min_records", "validation_pass_rate", "embedding_coverage",
    }


def test_thresholds(json_batch, make_product):
    batch = json_batch([make_product(i) for i in range(4)])
    checks = checks_of(suite(batch, bars=GateThresholds(min_records=5, completeness=0.5), rate=0.8))
    assert not checks["min_records"]["passed"] and not checks["validation_pass_rate"]["passed"]
    # A bar of zero is a bar of zero, and the rate is judged unrounded.
    assert checks_of(suite(batch, bars=GateThresholds(validation_pass_rate=0.0), rate=0.0))[
        "validation_pass_rate"]["passed"]
    assert not checks_of(suite(batch, rate=0.94996))["validation_pass_rate"]["passed"]


def test_threshold_gate(spark):
    def gate(scores, bars):
        s = spark.createDataFrame(scores, "name STRING, score DOUBLE")
        t = spark.createDataFrame(bars, "name STRING, threshold DOUBLE")
        return G.threshold_gate(s, t)

    bars = [("completeness", 0.95), ("uniqueness", 0.99)]
    good = gate([("completeness", 0.99), ("uniqueness", 1.0), ("other", 0.0)], bars).first()
    assert good["passed"] and good["decision"] == "promoted" and good["total_checks"] == 2
    bad = gate([("completeness", 0.8), ("uniqueness", 1.0)], bars).first()
    assert not bad["passed"] and bad["failed_checks"] == ["completeness"]
    assert gate([("completeness", 1.0)], bars).first()["failed_checks"] == ["uniqueness"]
    assert not gate([("a", 1.0)], []).first()["passed"]
    with pytest.raises(G.GateRejected, match="completeness"):
        G.enforce(gate([("completeness", 0.1)], bars[:1]))
