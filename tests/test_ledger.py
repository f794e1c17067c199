"""Ledger, rollback, retention, audit."""

import pytest
from pyspark.sql import functions as F

from vouchsafe.operators import audit as A
from vouchsafe.operators import ledger as L


def ledger(spark, *rows):
    return spark.createDataFrame(
        [(i + 1, "d", v, decision) for i, (v, decision) in enumerate(rows)],
        "id LONG, dataset STRING, version_id STRING, decision STRING",
    )


def live(spark, *names):
    return spark.createDataFrame([("d", n) for n in names], "dataset STRING, version_id STRING")


PROMOTED = [("v1", "promoted"), ("v2", "promoted"), ("v3", "promoted")]


@pytest.mark.parametrize(
    "rows, collections, target",
    [
        (PROMOTED, "v1 v2 v3", "v2"),
        ([*PROMOTED, ("v2", "rolled_back")], "v1 v2 v3", "v1"),
        ([*PROMOTED, ("v2", "rolled_back"), ("v1", "rolled_back")], "v1 v2 v3", None),
        (PROMOTED, "v1 v3", "v1"),
        (PROMOTED[:2], "v2", None),
        ([*PROMOTED, ("v1", "promoted")], "v1 v2 v3", "v3"),
        ([("v1", "promoted"), ("x", "rolled_back")], "v1 x", "v1"),
        ([("v1", "promoted"), ("v2", "rejected")], "v1 v2", None),
    ],
)
def test_rollback_target(spark, rows, collections, target):
    found = L.rollback_targets(ledger(spark, *rows), live(spark, *collections.split())).first()
    assert found["target_version"] == target
    assert found["decision"] == ("rolled_back" if target else "rollback_failed")


def test_history_is_limited_after_removing_repeats(spark):
    rows = [("v1", "promoted"), ("v2", "promoted"), ("v1", "promoted"), ("v1", "promoted")]
    history = L.promotion_history(ledger(spark, *rows), 2).orderBy("position").collect()
    assert [r["version_id"] for r in history] == ["v1", "v2"]


def test_previous_accepts_collection_names(spark):
    for current in ("v3", "d__v3"):
        frame = spark.createDataFrame([("d", current)], "dataset STRING, current STRING")
        assert L.previous_promoted(ledger(spark, *PROMOTED), frame).first()["previous_version"] == "v2"


@pytest.mark.parametrize(
    "names, keep, dropped",
    [
        ("a b c d e", "e d", "a b"), ("a b c d e", "e", "a b"), ("a b c", "c b", ""),
        ("d e", "e d", ""), ("a b c d", "a d", "b"), ("a b c d", "z d", "a b"),
    ],
)
def test_retention(spark, names, keep, dropped):
    rows = [("promoted", name) for name in names.split()]
    drops = L.retention_drops(
        live(spark, *names.split()), live(spark, *keep.split()), ledger(spark, *rows)
    )
    assert sorted(r["version_id"] for r in drops.collect()) == dropped.split()


def test_retention_minds_the_dataset(spark):
    both = live(spark, *"abcde").unionAll(
        spark.createDataFrame([("d__x", n) for n in "ab"], "dataset STRING, version_id STRING"))
    drops = L.retention_drops(both, live(spark, "e", "d"), ledger(spark, ("promoted", "a")))
    assert {r["dataset"] for r in drops.collect()} == {"d"}


def test_latest_status_keeps_the_count(spark):
    rows = [(1, "v", "validated", 9), (2, "v", "embedded", None), (3, "v", "promoted", None)]
    df = spark.createDataFrame(rows, "seq LONG, version_id STRING, status STRING, record_count LONG")
    row = L.latest_status(df.withColumn("at", F.lit("2024-01-01").cast("timestamp"))).first()
    assert (row["status"], row["record_count"]) == ("promoted", 9)


def test_health_edges(spark):
    as_of = F.lit("2024-01-02 00:00:00").cast("timestamp")
    rows = [("promoted", "2024-01-01 00:00:01")] * 3 + [("rejected", "2024-01-01 12:00:00"), ("rejected", "2024-01-01 00:00:00")]
    promotions = spark.createDataFrame(rows, "decision STRING, at STRING").select(
        "decision", F.to_timestamp("at").alias("decided_at"))
    versions = spark.createDataFrame(
        [("v", "validated", "2024-01-01 22:00:00")], "version_id STRING, status STRING, at STRING"
    ).select("version_id", "status", F.to_timestamp("at").alias("updated_at"))
    report = A.health(promotions, versions, as_of).first()
    # A rate of exactly a quarter is healthy; two hours ago exactly is not stuck.
    assert (report["failure_rate"], report["stuck"], report["healthy"]) == (0.25, 0, True)
    assert not A.health(promotions, versions, as_of + F.expr("INTERVAL 1 SECOND")).first()["healthy"]
    empty = A.health(promotions.limit(0), versions.limit(0), as_of).first()
    assert (empty["failure_rate"], empty["healthy"]) == (0.0, True)


def test_histogram_quantile(spark):
    values = [0.1] * 90 + [0.6] * 5 + [99.0] * 5
    df = spark.createDataFrame([("a", v) for v in values], "g STRING, v DOUBLE")
    q = lambda p: A.histogram_quantile(df, [F.col("g")], "v", p, (0.5, 1.0)).first()["quantile"]
    assert q(0.45) == pytest.approx(0.25) and q(0.925) == pytest.approx(0.75) and q(0.99) == 1.0
