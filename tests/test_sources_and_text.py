"""JSON payloads, names, text functions, hashes, profiles."""

import hashlib
import json
import unicodedata
import random
import re
import string

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vouchsafe.functions import hashing, identifiers, text as X
from vouchsafe.functions.records import strict_json
from vouchsafe.operators import enrichment as E
from vouchsafe.sources import json_records as J
from vouchsafe.sources import manifest as M


def parse(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i INT, content STRING")
    rows = J.parse_payloads(df).select("i", "error", F.to_json(F.struct("records")).alias("r")).orderBy("i")
    return [r["error"] or json.loads(r["r"])["records"] for r in rows.collect()]


PAYLOADS = [
    *((json.dumps(list(r), indent=i), list(r)) for r in ([{"k": 7}], [{"k": "a"}, {"m": []}]) for i in (None, 3)),
    *((json.dumps(r, indent=i), [r]) for r in ({"k": 0.5}, {"k": {"m": "n"}}) for i in (None, 1)),
    ("\n".join(json.dumps({"row": n}) for n in range(4)), [{"row": n} for n in range(4)]),
    ('　{"id": 1}\r\n \r\n{"id": 2}\n', [{"id": 1}, {"id": 2}]),
    ("   ", J.EMPTY),
    ("", J.EMPTY),
    ("42", J.NO_CONTAINER),
    ("null", J.NO_CONTAINER),
    ('{"id": 1}\n{bad}', J.BAD_LINE + "2"),
    ('{"id": 1}\n\n{"id": 2} trailing', J.BAD_LINE + "3"),
    ('{"id": 1},{"id": 2}', J.BAD_LINE + "1"),
    ('{"id": 1}] [2', J.BAD_LINE + "1"),
    ('{"id": 1}} {', J.BAD_LINE + "1"),
    ('42\n"x"', [42, "x"]),
    ("[]", []),
    ('{"a": NaN}', J.BAD_LINE + "1"),
    ('{"a": 1, "a": 2}', [{"a": 2}]),
]


def test_payloads(spark):
    assert parse(spark, [p for p, _ in PAYLOADS]) == [e for _, e in PAYLOADS]


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet='{}[]",:1a \n', max_size=12), min_size=20, max_size=60))
def test_strict_json_accepts_what_json_accepts(spark, texts):
    def valid(t):
        try:
            json.loads(t, parse_constant=lambda c: 1 / 0)
            return True
        except (ValueError, ZeroDivisionError):
            return False

    df = spark.createDataFrame(list(enumerate(texts)), "i INT, t STRING")
    got = [r[0] for r in df.orderBy("i").select(strict_json(F.col("t")).isNotNull()).collect()]
    assert got == [valid(t) for t in texts]


def test_files(spark, tmp_path):
    folder = tmp_path / "products"
    folder.mkdir()
    (folder / "a.json").write_text('[{"id": 1}, {"id": 2}]')
    (folder / "b.jsonl").write_text('{"id": 3}\n{oops')
    (folder / "c d.txt").write_text("[]")
    records, rejected = J.read_json_records(spark, str(folder))
    assert [(r["_pos"], str(r["rec"])) for r in records.where("path like '%a.json'").orderBy("_pos").collect()] == [
        (0, '{"id":1}'), (1, '{"id":2}'),
    ]
    assert [r["error"] for r in rejected.collect()] == [J.BAD_LINE + "2"]
    lines = J.read_json_lines(spark, str(folder / "b.jsonl")).orderBy("_block", "_pos").collect()
    assert [str(r["rec"]) for r in lines] == ['{"id":3}', "None"]

    manifest = {r["file_name"]: r for r in M.landing_manifest(M.read_uploads(spark, str(folder))).collect()}
    digest = hashlib.sha256(b'[{"id": 1}, {"id": 2}]').hexdigest()[:12]
    assert manifest["a.json"]["object_key"] == f"{digest}-a.json"
    assert (manifest["a.json"]["accepted"], manifest["a.json"]["record_count"]) == (True, 2)
    assert manifest["b.jsonl"]["reject_reason"] == M.BAD_JSON + J.BAD_LINE + "2"
    assert manifest["c d.txt"]["reject_reason"] == M.BAD_SUFFIX
    listed = M.list_objects(spark, str(tmp_path)).withColumn("d", F.lit("products"))
    assert listed.count() == 3
    assert M.latest_per_group(listed, ["d"], "path", "modified").count() == 1
    small = {r["file_name"]: r for r in M.read_uploads(spark, str(folder), max_bytes=20).collect()}
    assert {n: r["content"] is None for n, r in small.items()} == {n: r["size"] > 20 for n, r in small.items()}
    assert any(r["content"] is None for r in small.values())
    assert M.landing_manifest(M.read_uploads(spark, str(folder), max_bytes=20), 20).where(
        F.col("reject_reason") == M.too_large(20)
    ).count() == sum(r["size"] > 20 for r in small.values())


def test_manifest_limits(spark):
    rows = [("ok", "a.json", b"[1]"), ("Bad!", "a.json", b"[1]"), ("ok", "a.json", b"\xff\xfe"), ("ok", "b.json", b"[1,22222]")]
    df = spark.createDataFrame(rows, "dataset STRING, file_name STRING, content BINARY")
    found = {(r["dataset"], r["file_name"], r["size"]): r["reject_reason"] for r in M.landing_manifest(df, 5).collect()}
    assert found == {
        ("ok", "a.json", 3): None, ("Bad!", "a.json", 3): M.BAD_DATASET,
        ("ok", "a.json", 2): M.NOT_UTF8, ("ok", "b.json", 9): "file exceeds 5 byte limit",
    }


def test_envelopes(spark):
    bodies = [
        '{"dataset": "docs", "records": [{"b": 1.50, "a": "é"}], "pipeline": "p"}',
        '{"dataset": "docs", "records": []}', '{"records": [{}]}', "nope",
    ]
    df = J.parse_envelopes(spark.createDataFrame([(b,) for b in bodies], "body STRING"))
    rows = {r["body"]: r for r in df.collect()}
    expected = hashlib.sha256(json.dumps([{"b": 1.5, "a": "é"}]).encode()).hexdigest()[:12]
    assert rows[bodies[0]]["content_hash"] == expected and rows[bodies[0]]["pipeline"] == "p"
    assert [rows[b]["error"] for b in bodies[1:]] == ["no records", "invalid dataset", "body is not valid JSON"]


def test_identifiers_and_keys(spark):
    rng = random.Random(21)
    allowed = string.ascii_lowercase + string.digits + "_-"
    draw = lambda alphabet, n: "".join(rng.choice(alphabet) for _ in range(n))
    values = {draw(allowed, n) for n in (1, 2, 9, 63, 64, 65, 90)} | {"", "tail\n", "\nhead"}
    values |= {draw(allowed, 6) + c + draw(allowed, 3) for c in "/.;A \u00e9\u0663"}
    good = {v for v in values if 1 <= len(v) <= 64 and set(v) <= set(allowed)}
    df = spark.createDataFrame([(v,) for v in values], "v STRING")
    assert {r[0] for r in df.where(identifiers.is_identifier(F.col("v"))).collect()} == good and len(good) == 5

    def plain_key(name):
        last = name.replace("\\", "/").rsplit("/", 1)[-1]
        kept = "".join(c if c in string.ascii_letters + string.digits + "._-" else "_" for c in last).lstrip(".")
        return kept[:128] or "upload"

    names = {draw("ab.Z9/\\ ?\u00fc-", n) for n in (1, 3, 5, 8, 13, 30) for _ in range(12)} | {"." * 4, "q/" * 3, "k" * 131}
    df = spark.createDataFrame([(v,) for v in names], "v STRING")
    got = {r[0]: r[1] for r in df.select("v", identifiers.safe_object_key(F.col("v"))).collect()}
    assert got == {name: plain_key(name) for name in names}
    paths = spark.createDataFrame([("/versions/x",), ("/demo/search/q/r",), ("/healthz",)], "p STRING")
    assert {r[0] for r in paths.select(identifiers.route_template(F.col("p"))).collect()} == {
        "/versions/{param}", "/demo/search/{param}", "/healthz",
    }


@settings(max_examples=10, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet="aAéé 　\u001c\t\n 가 \u0085", max_size=12), min_size=20, max_size=50))
def test_normalize(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i INT, t STRING").orderBy("i")
    got = [r[0] for r in df.select(X.normalize(F.col("t"))).collect()]
    assert got == [re.sub(r"\s+", " ", unicodedata.normalize("NFC", t)).strip() for t in texts]


def test_search_text_is_whole_or_cut_by_characters(spark):
    long = "\U0001F600" * 5000
    df = spark.createDataFrame([("t", "", None, long)], "a STRING, b STRING, c STRING, d STRING")
    parts = [F.col(c) for c in "abcd"]
    whole, cut = df.select(X.search_text(parts), X.search_text(parts, 4096)).first()
    assert whole == "t | " + long and cut == whole[:4096]


def test_content_hashes(spark):
    df = spark.createDataFrame([("1", "Widget")], "id STRING, title STRING")
    record = df.select(F.to_json(F.struct("title", "id")).alias("j"))
    assert record.select(hashing.repr_content_hash("j")).first()[0] == "acbc08a0b5209453"
    swapped = df.select("title", "id")
    assert (df.select(hashing.content_hash(df.columns)).first()[0]
            == swapped.select(hashing.content_hash(swapped.columns)).first()[0])


def test_enrichment(spark, json_batch):
    records = [
        {"id": 1, "title": "  A  b ", "text": "x", "tags": []}, {"id": "1", "title": "dup"},
        {"title": "no id"}, {"title": "no id"}, {"id": None, "title": "no id"}, {"id": "", "content": ""},
    ]
    at = F.lit("2024-01-01").cast("timestamp")
    rows = E.enrich_records(json_batch(records), "v1", at).orderBy("_pos").collect()
    assert [r["_pos"] for r in rows] == [0, 2, 4, 5]
    assert rows[0]["_texts"]["title"] == "A b" and rows[0]["_search_text"] == "A b | x"
    meta = rows[0]["_meta"]
    assert (meta["version_id"], meta["text_length"], meta["field_count"]) == ("v1", 7, 4)
    assert rows[3]["_search_text"] == ""


def test_profiles(spark, json_batch):
    batch = json_batch([{"a": 1, "b": "", "c": []}, {"a": None, "b": "x"}, {"a": 0}])
    rates = {r["field"]: r["fill_rate"] for r in E.variant_fill_rates(batch).collect()}
    assert rates == {"a": 0.667, "b": 0.333}
    assert E.variant_fill_rates(json_batch([])).count() == 0
    typed = spark.createDataFrame([(1, "", []), (None, "x", [1])], "a INT, b STRING, c ARRAY<INT>")
    assert {r["field"]: r["fill_rate"] for r in E.fill_rates(typed).collect()} == {"a": 0.5, "b": 0.5, "c": 0.5}
    assert E.fill_rates(typed.limit(0)).count() == 0
