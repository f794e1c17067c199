"""Event bus: batch operators against brute force, streams against their batch twins."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from vouchsafe.operators import events as V
from vouchsafe.operators.audit import sliding_rate, sliding_rate_stream
from vouchsafe.streaming import idempotency, relay
from vouchsafe.streaming.running import drain as run_out

START = dt.datetime(2024, 1, 1)
EVENT = "event_id LONG, k STRING, ts TIMESTAMP_NTZ"


def random_events(n, keys, span_seconds, seed):
    rng = random.Random(seed)
    return [
        # A third of all events belong to one key.
        (i, "hot" if rng.random() < 0.34 else f"k{rng.randrange(keys)}",
         START + dt.timedelta(seconds=rng.randrange(span_seconds), microseconds=rng.choice([0, 0, 1])))
        for i in range(n)
    ]


def brute_force(events, ttl):
    taken, accepted = {}, set()
    for event_id, key, ts in sorted(events, key=lambda e: (e[2], e[0])):
        if key not in taken or ts >= taken[key] + dt.timedelta(seconds=ttl):
            taken[key] = ts
            accepted.add(event_id)
    return accepted


@pytest.mark.parametrize("fold_limit", [50_000, 5])
@pytest.mark.parametrize("ttl, span", [(60, 2000), (7200, 90_000), (1, 300)])
def test_dedup_ttl(spark, fold_limit, ttl, span):
    events = random_events(600, 4, span, seed=ttl)
    df = spark.createDataFrame(events, EVENT)
    got = V.dedup_ttl(df, ["k"], ttl_seconds=ttl, max_moments_per_fold=fold_limit)
    assert {r["event_id"] for r in got.collect()} == brute_force(events, ttl)


def test_dedup_ttl_boundary_and_keyless(spark):
    at = lambda s: START + dt.timedelta(seconds=s)
    rows = [(1, "a", at(0)), (2, "a", at(9)), (3, "a", at(10)), (4, None, at(0)), (5, None, at(0)), (6, "a", at(19))]
    got = V.dedup_ttl(spark.createDataFrame(rows, EVENT), ["k"], ttl_seconds=10)
    assert {r["event_id"] for r in got.collect()} == {1, 3, 4, 5}
    assert V.dedup_ttl(spark.createDataFrame([], EVENT), ["k"]).count() == 0


def test_markers_expire_one_by_one(spark):
    as_of = F.lit("2024-01-02 00:00:00").cast("timestamp_ntz")
    events = spark.createDataFrame([(i, "k", START) for i in range(4)], EVENT)
    marked = [(0, START), (1, START + dt.timedelta(seconds=1)), (2, START + dt.timedelta(days=3))]
    markers = spark.createDataFrame(marked, "event_id LONG, marked_at TIMESTAMP_NTZ")
    left = V.undispatched(events, markers, as_of)
    assert sorted(r["event_id"] for r in left.collect()) == [0, 2, 3]


def test_claims_prefer_the_backlog(spark):
    schema = "consumer STRING, event_id LONG, ts TIMESTAMP_NTZ"
    backlog = spark.createDataFrame([("a", i, START) for i in range(60)], schema).withColumn("deliveries", F.lit(1).cast("bigint"))
    fresh = spark.createDataFrame([(c, 100 + i, START) for i, c in enumerate("aabb")], schema)
    markers = spark.createDataFrame([(0, START)], "event_id LONG, marked_at TIMESTAMP_NTZ")
    claimed = V.claim_batch(backlog, fresh, markers, F.lit("2024-01-01 01:00:00").cast("timestamp_ntz"), ["ts", "event_id"]).collect()
    mine = sorted(r["event_id"] for r in claimed if r["consumer"] == "a")
    assert mine == list(range(1, 50)) and {r["deliveries"] for r in claimed if r["consumer"] == "a"} == {2}
    assert sorted(r["event_id"] for r in claimed if r["consumer"] == "b") == [102, 103]


ATTEMPTS = [
    ("poison", [False] * 6, "dead_lettered", 4), ("late", [False, False, False, True], "dead_lettered", 4),
    ("third", [False, False, True, False], "dispatched", 3), ("waiting", [False, False], "pending", 2),
    ("fine", [True, True], "dispatched", 1),
]


def attempts(spark):
    rows = [(m, i, ok) for m, tries, _, _ in ATTEMPTS for i, ok in enumerate(tries)]
    return spark.createDataFrame(rows, "message STRING, tick LONG, ok BOOLEAN")


def test_relay_outcomes(spark):
    steps = V.relay_steps(attempts(spark), ["message"], ["tick"], "ok")
    got = {r["message"]: (r["outcome"], r["deliveries"]) for r in V.delivery_outcomes(steps, ["message"]).collect()}
    assert got == {m: (outcome, n) for m, _, outcome, n in ATTEMPTS}
    last = V.relay_report(steps, F.col("tick")).where("tick = 3").first()
    assert (last["scanned"], last["dead_lettered"], last["retry_pending"]) == (2, 2, 0)


def stream(spark, folder, df, files):
    """The rows of ``df`` in as many files, one per micro-batch, in event order."""
    rows = df.orderBy("ts", "event_id").collect() if "ts" in df.columns else df.orderBy("tick").collect()
    per = -(-len(rows) // files)
    for i in range(files):
        spark.createDataFrame(rows[i * per:(i + 1) * per], df.schema).coalesce(1).write.mode("append").parquet(str(folder))
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def drain(df, tmp_path, name, empty_batches=False):
    out = str(tmp_path / f"{name}-out")
    writer = df.writeStream.format("parquet").option("path", out).option(
        "checkpointLocation", str(tmp_path / f"{name}-checkpoint"))
    if empty_batches:
        writer.trigger(availableNow=True).start().awaitTermination()
    else:
        run_out(df.sparkSession, writer)
    return df.sparkSession.read.schema(df.schema).parquet(out)


def test_publish_stream_equals_its_batch_twin(spark, tmp_path):
    events = random_events(200, 3, 3000, seed=7)
    df = spark.createDataFrame(events, EVENT)
    accepted = idempotency.publish_stream(stream(spark, tmp_path / "in", df, 3), ["k"], ttl_seconds=60)
    got = drain(accepted, tmp_path, "publish").collect()
    assert {r["event_id"] for r in got} == brute_force(events, 60)
    assert set(accepted.columns) == {"event_id", "k", "ts"}


def test_relay_stream_equals_its_batch_twin_and_restarts(spark, tmp_path):
    tries = attempts(spark)
    steps = relay.relay_stream(stream(spark, tmp_path / "in", tries, 3), ["message"], ["tick"])
    sink = relay.relay_sink(str(tmp_path / "out"), "message", "message", "message")

    def run():
        run_out(spark, steps.writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "cp")))

    run()
    columns = ["message", "tick", "delivery", "effect"]
    expected = V.relay_steps(tries, ["message"], ["tick"], "ok").select(*columns)
    read = lambda part: spark.read.parquet(str(tmp_path / "out" / part))
    as_set = lambda d: sorted(tuple(r) for r in d.select(*columns).collect())
    assert as_set(read("steps")) == as_set(expected)
    assert {r["original_id"] for r in read("dead_letters").collect()} == {"poison", "late"}
    assert {r["event_id"] for r in read("markers").collect()} == {"third", "fine"}
    # A restart finds nothing new; a later attempt continues from the kept count.
    run()
    assert as_set(read("steps")) == as_set(expected)
    more = spark.createDataFrame([("waiting", 10, False), ("waiting", 11, True), ("fine", 12, True)], tries.schema)
    more.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run()
    everything = V.relay_steps(tries.unionAll(more), ["message"], ["tick"], "ok").select(*columns)
    assert as_set(read("steps")) == as_set(everything)


def test_a_replayed_batch_is_written_once(spark, tmp_path):
    sink = relay.batch_sink((str(tmp_path / "out"), lambda b: b))
    sink(spark.range(5), 0)
    sink(spark.range(5), 0)
    sink(spark.range(2), 1)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 7


def test_undispatched_stream(spark, tmp_path):
    at = lambda m: START + dt.timedelta(minutes=m)
    events = spark.createDataFrame([(1, "k", at(0)), (2, "k", at(1)), (3, "k", at(2)), (9, "k", at(600))], EVENT)
    markers = spark.createDataFrame([(1, at(5)), (2, at(300)), (8, at(600))], "event_id LONG, marked_at TIMESTAMP_NTZ")
    as_ts = lambda d, c: d.withColumn(c, F.col(c).cast("timestamp"))
    events, markers = as_ts(events, "ts"), as_ts(markers, "marked_at")
    markers.coalesce(1).write.parquet(str(tmp_path / "m"))
    left = relay.undispatched_stream(
        stream(spark, tmp_path / "e", events, 1),
        spark.readStream.schema(markers.schema).parquet(str(tmp_path / "m")),
    )
    assert {r["event_id"] for r in drain(left, tmp_path, "left", empty_batches=True).collect()} == {2, 3}


def test_sliding_rate_stream_equals_batch(spark, tmp_path):
    events = spark.createDataFrame(random_events(100, 2, 900, seed=3), EVENT).withColumn("ts", F.col("ts").cast("timestamp"))
    rates = sliding_rate_stream(stream(spark, tmp_path / "in", events, 1), "k")
    query = rates.writeStream.format("memory").queryName("rates").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    as_set = lambda d: sorted((str(r["window_start"]), r["label"], r["rate"]) for r in d.collect())
    assert as_set(spark.table("rates")) == as_set(sliding_rate(events, "k"))
