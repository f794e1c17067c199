"""Tumbling and session windows: plain Python, and the stream against the batch twin."""

import datetime as dt
import random

from pyspark.sql import functions as F

from vouchsafe.operators import windows as W
from vouchsafe.streaming import windows as S
from vouchsafe.streaming.running import drain

START = dt.datetime(2024, 1, 1)
SCHEMA = "id bigint, k string, ts timestamp_ntz, value double, batch bigint"
WIDTH, LATENESS, GAP = 60, 30, 25


def rows_in_batches():
    r = random.Random(9)
    rows = []
    for i in range(300):
        batch = i // 50
        at = batch * 50 + r.randrange(50) - (r.randrange(200) if r.random() < 0.2 else 0)
        rows.append((i, r.choice(["hot", "hot", "b", None]), START + dt.timedelta(seconds=at, microseconds=r.randrange(3)),
                     r.choice([None, float(i)]), batch))
    return rows + [(300, "b", None, 1.0, 2), (301, "hot", rows[4][2], 4.0, 0)]


def plain(rows):
    windows, late_ids, seen = {}, set(), None
    for batch in sorted({r[4] for r in rows}):
        mark = None if seen is None else seen - dt.timedelta(seconds=LATENESS)
        own = [r for r in rows if r[4] == batch and r[2] is not None]
        for i, k, ts, value, _ in own:
            start = START + dt.timedelta(seconds=((ts - START) // dt.timedelta(seconds=WIDTH)) * WIDTH)
            late = mark is not None and start + dt.timedelta(seconds=WIDTH) <= mark
            entry = windows.setdefault((k, start), [0, [], 0])
            entry[2 if late else 0] += 1
            late_ids |= {i} if late else set()
            if not late and value is not None:
                entry[1].append(value)
        seen = max([*([seen] if seen else []), *(r[2] for r in own)])
    return {(k, s, n, min(v, default=None), max(v, default=None), late) for (k, s), (n, v, late) in windows.items()}, late_ids


def plain_sessions(rows):
    out = set()
    for key in {r[1] for r in rows}:
        session = []
        for r in sorted((r for r in rows if r[1] == key and r[2] is not None), key=lambda r: r[2]):
            if session and r[2] >= session[-1][2] + dt.timedelta(seconds=GAP):
                out.add((key, session[0][2], session[-1][2], len(session)))
                session = []
            session.append(r)
        if session:
            out.add((key, session[0][2], session[-1][2], len(session)))
    return out


def test_windows_and_sessions_equal_plain_ones(spark, monkeypatch):
    monkeypatch.setattr(W, "SLOT_GAPS", 3)
    rows = rows_in_batches()
    df = spark.createDataFrame(rows, SCHEMA)
    got = W.tumbling_windows(df, ["k"], "ts", "value", "batch", WIDTH, LATENESS)
    want, late = plain(rows)
    columns = ["k", "window_start", "n", "least", "greatest", "n_late"]
    assert {tuple(x) for x in got.select(*columns).collect()} == want and len(late) > 10
    sessions = W.session_windows(df, ["k"], "ts", "value", GAP).select("k", "first", "last", "n")
    assert {tuple(x) for x in sessions.collect()} == plain_sessions(rows)
    nothing = df.limit(0)
    assert W.tumbling_windows(nothing, ["k"], "ts", "value", "batch", WIDTH, LATENESS).count() == 0


def test_the_stream_equals_its_batch_twin_and_replays(spark, tmp_path):
    rows = rows_in_batches()
    for batch in range(6):
        part = [r for r in rows if r[4] == batch]
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    base = str(tmp_path / "out")
    sink = S.window_sink(base, ["k"], "ts", "value", WIDTH, LATENESS, GAP)
    drain(spark, source.writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "cp")))
    want, late = plain(rows)
    in_time = [r for r in rows if r[0] not in late]

    def holds():
        got = S.read_windows(spark, base, ["k"]).select("k", "window_start", "n", "least", "greatest")
        assert {tuple(x) for x in got.collect()} == {w[:5] for w in want if w[2]}
        assert {x.id for x in S.read_late(spark, base).collect()} == late
        sessions = S.read_sessions(spark, base, ["k"], GAP).select("k", "first", "last", "n")
        assert {tuple(x) for x in sessions.collect()} == plain_sessions(in_time)

    holds()
    # a batch that is run again after a failure changes nothing
    sink(spark.createDataFrame([r for r in rows if r[4] == 5], SCHEMA), 5)
    holds()
