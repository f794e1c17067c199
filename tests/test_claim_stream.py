"""Claims and markers as streams against their batch twins and a plain bus."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from vouchsafe.operators import events as V
from vouchsafe.streaming import claims, idempotency, relay
from vouchsafe.streaming.running import drain

START = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
BUS = "consumer string, event_id string, kind string, at timestamp, deliveries bigint"


@pytest.fixture
def small_chunks(spark):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    yield
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def run(spark, folder, rows, files, **options):
    """The claims of a bus whose rows come in as many files, in order of time but shuffled within each."""
    rows = sorted(rows, key=lambda r: r[3])
    per = -(-len(rows) // files)
    r = random.Random(1)
    for i in range(files):
        part = rows[i * per : (i + 1) * per]
        r.shuffle(part)
        spark.createDataFrame(part, BUS).coalesce(1).write.mode("append").parquet(str(folder / "in"))
    bus = spark.readStream.schema(BUS).option("maxFilesPerTrigger", 1).parquet(str(folder / "in"))
    claimed = claims.claim_stream(bus, **options)
    query = (
        claimed.writeStream.format("parquet").option("path", str(folder / "out"))
        .option("checkpointLocation", str(folder / "cp")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(claimed.schema).parquet(str(folder / "out"))


def after(seconds):
    return START + dt.timedelta(seconds=seconds)


def test_first_tick_equals_the_batch_twin(spark, tmp_path, small_chunks):
    r = random.Random(2)
    of = lambda n, first: [(r.choice("aaabcd"), first + i, r.randrange(50)) for i in range(n)]
    backlog, fresh = [(c, i, s) for c, i, s in of(60, 0) if c in "ab"], of(150, 1000)
    marked = [(c, i, 55) for c, i, _ in r.sample(backlog, 9) + r.sample(fresh, 40)]
    rows = [(c, str(i), claims.DELIVERED, after(s), 1) for c, i, s in backlog]
    rows += [(c, str(i), claims.PUBLISHED, after(s), 0) for c, i, s in fresh]
    rows += [(c, str(i), claims.MARKED, after(s), 0) for c, i, s in marked]
    rows += [("z", "0", claims.PUBLISHED, after(5000), 0)]
    got = run(spark, tmp_path, rows, 3, tick_seconds=60, batch_size=20, ttl_seconds=3600)
    got = {(x.consumer, x.event_id, x.deliveries) for x in got.where(F.col("tick") == F.lit(after(60))).collect()}
    frame = lambda rows: spark.createDataFrame(
        [(c, str(i), after(s)) for c, i, s in rows], "consumer string, event_id string, ts timestamp"
    )
    markers = frame(marked).select("event_id", F.col("ts").alias("marked_at"))
    want = V.claim_batch(
        frame(backlog).withColumn("deliveries", F.lit(1).cast("bigint")), frame(fresh), markers, F.lit(after(60)),
        ["ts", "event_id"], batch_size=20, ttl_seconds=3600,
    )
    assert got == {(x.consumer, x.event_id, x.deliveries) for x in want.collect()} and len(got) > 40


def plain_bus(rows, tick, size, ttl, until):
    """All ticks of a bus in plain Python."""
    out = set()
    for consumer in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == consumer), key=lambda r: (r[3], r[1]))
        pending, fresh, done = {}, [], 0
        for now in range(tick, until + 1, tick):
            acked = []
            while done < len(own) and own[done][3] < after(now):
                _, i, kind, at, times = own[done]
                if kind == claims.PUBLISHED:
                    fresh.append((at, i))
                elif kind == claims.DELIVERED:
                    pending[i] = (at, times)
                elif kind == claims.ACKED:
                    acked.append((i, at))
                done += 1
            for i, _ in acked:
                pending.pop(i, None)
            if pending:
                batch = sorted((at, i, times) for i, (at, times) in pending.items())[:size]
            else:
                batch, fresh = [(at, i, 0) for at, i in fresh[:size]], fresh[size:]
            for at, i, times in batch:
                marks = [m[3] for m in own if m[1] == i and m[2] == claims.MARKED and m[3] <= after(now)]
                if marks and max(marks) + dt.timedelta(seconds=ttl) > after(now):
                    pending.pop(i, None)
                    continue
                pending[i] = (at, times + 1)
                out.add((consumer, after(now), i, times + 1))
    return out


def test_ticks_equal_a_plain_bus(spark, tmp_path, small_chunks):
    r = random.Random(5)
    rows = [(r.choice("aaab"), f"{i:03}", claims.PUBLISHED, after(r.randrange(300) + 0.5), 0) for i in range(60)]
    for c, i, _, at, _ in list(rows):
        later = at + dt.timedelta(seconds=r.randrange(1, 200))
        if r.random() < 0.8:
            rows.append((c, i, claims.ACKED, later, 0))
        elif r.random() < 0.5:
            rows.append((c, i, claims.MARKED, later, 0))
    rows += [(c, i, claims.ACKED, after(600.5 + j), 0) for j, (c, i, k, _, _) in enumerate(rows) if k == claims.PUBLISHED]
    rows += [(c, "end", claims.PUBLISHED, after(1500), 0) for c in "ab"]
    got = run(spark, tmp_path, rows, 6, tick_seconds=20, batch_size=5, ttl_seconds=150, lateness="1 second")
    got = {(x.consumer, x.tick.replace(tzinfo=dt.timezone.utc), x.event_id, x.deliveries) for x in got.collect()}
    want = plain_bus(rows, 20, 5, 150, 1480)
    assert got == want and len(want) > 100


def test_many_waiting_events_are_taken_part_by_part(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(claims, "PART", 3)
    rows = [("a", f"{i:02}", claims.PUBLISHED, after(i % 7), 0) for i in range(25)]
    rows += [("a", f"{i:02}", claims.ACKED, after(11 + 10 * i), 0) for i in range(25)] + [("b", "x", claims.PUBLISHED, after(900), 0)]
    got = run(spark, tmp_path, rows, 2, tick_seconds=10, batch_size=4, lateness="1 second")
    got = {(x.tick.replace(tzinfo=dt.timezone.utc), x.event_id, x.deliveries) for x in got.where("consumer = 'a'").collect()}
    assert got == {x[1:] for x in plain_bus(rows, 10, 4, 86400, 890) if x[0] == "a"}


def write_files(spark, folder, rows, schema, files, order):
    rows = sorted(rows, key=order)
    per = -(-len(rows) // files)
    r = random.Random(3)
    for i in range(files):
        part = rows[i * per : (i + 1) * per]
        r.shuffle(part)
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(folder))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def test_marker_lifetimes_equal_the_batch_twin_at_any_time(spark, tmp_path, small_chunks):
    r = random.Random(6)
    event, marker = "event_id bigint, ts timestamp", "event_id bigint, marked_at timestamp"
    events = [(i, after(r.randrange(600))) for i in range(40)] + [(99, after(4000))]
    markers = [(i, t + dt.timedelta(seconds=r.randrange(-50, 900))) for i, t in events for _ in range(r.randrange(4))]
    markers = [m for m in markers if START <= m[1] < after(2000)] + [(77, after(30)), (98, after(4000))]
    changes = relay.dispatch_changes(
        write_files(spark, tmp_path / "e", events, event, 3, lambda x: x[1]),
        write_files(spark, tmp_path / "m", markers, marker, 3, lambda x: x[1]),
        ttl_seconds=100, lateness="30 minutes",
    )
    out = str(tmp_path / "out")
    writer = changes.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp"))
    writer.trigger(availableNow=True).start().awaitTermination()
    told = spark.read.schema(changes.schema).parquet(out)
    e, m = spark.createDataFrame(events, event), spark.createDataFrame(markers, marker)
    returned = 0
    for seconds in (0, 100, 333, 599, 700, 1000, 1500, 2099):
        as_of = F.lit(after(seconds))
        want = {x.event_id for x in V.undispatched(e.where(F.col("ts") <= as_of), m, as_of, ttl_seconds=100).collect()}
        assert {x.event_id for x in V.undispatched_at(told, as_of).collect()} == want, seconds
        returned += len(want)
    assert returned > 100 and told.where("undispatched").count() > 45


def test_order_does_not_depend_on_chunks(spark, tmp_path, small_chunks):
    r = random.Random(8)
    events = [(i, r.choice("aab"), after(r.randrange(3000))) for i in range(150)]
    schema = "event_id bigint, k string, ts timestamp"
    accepted = idempotency.publish_stream(
        write_files(spark, tmp_path / "in", events, schema, 2, lambda x: x[2]), ["k"], ttl_seconds=60
    )
    out = str(tmp_path / "out")
    drain(spark, accepted.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")))
    want = V.dedup_ttl(spark.createDataFrame(events, schema), ["k"], ttl_seconds=60)
    got = spark.read.schema(accepted.schema).parquet(out)
    assert {x.event_id for x in got.collect()} == {x.event_id for x in want.collect()}
    tries = [(m, t, r.random() < 0.25) for m in "pqrstu" for t in range(7)]
    schema = "message string, tick bigint, ok boolean"
    steps = relay.relay_stream(
        write_files(spark, tmp_path / "in2", tries, schema, 2, lambda x: x[1]), ["message"], ["tick"]
    )
    out = str(tmp_path / "out2")
    drain(spark, steps.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp2")))
    columns = ["message", "tick", "delivery", "effect"]
    want = V.relay_steps(spark.createDataFrame(tries, schema), ["message"], ["tick"], "ok").select(*columns)
    got = spark.read.schema(steps.schema).parquet(out).select(*columns)
    report = lambda df: {tuple(x) for x in V.relay_report(df, F.col("tick")).collect()}
    assert {tuple(x) for x in got.collect()} == {tuple(x) for x in want.collect()} and report(got) == report(want)
