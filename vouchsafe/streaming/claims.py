"""Claiming as a stream: what each consumer gets at every tick, its unacknowledged backlog first.

Times are event times. A tick acts when the watermark has passed it, so that all that happened before it is known,
in whatever order and portions it came; its outcome depends on nothing else.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from vouchsafe.settings import Settings

DEFAULTS = Settings()
MICROS = 1_000_000

#: What a row of the bus says about an event.
PUBLISHED, DELIVERED, ACKED, MARKED = "published", "delivered", "acked", "marked"
#: Rows of a part of a consumer's waiting events. A tick reads and writes a part or two, not all that waits.
PART = 1000

_PART_ROWS = T.StructType([T.StructField("ats", T.ArrayType(T.LongType())), T.StructField("ids", T.ArrayType(T.StringType()))])
CLAIMED = {"tick": "long", "event_id": "string", "at": "long", "deliveries": "long"}


class Claims(StatefulProcessor):
    """A consumer's bus.

    Waiting events are kept by the tick before which they were published. When that tick comes they are complete,
    are put in order once, and are then taken part by part. Delivered ones are at most a batch, as new events are
    taken only when none is left, apart from those that were delivered elsewhere.
    """

    def __init__(self, tick_seconds: int, batch_size: int, ttl_seconds: int):
        self.tick, self.size, self.ttl = tick_seconds * MICROS, batch_size, ttl_seconds * MICROS

    def init(self, handle: StatefulProcessorHandle) -> None:
        number = T.StructType([T.StructField("n", T.LongType())])
        moments = T.StructType([T.StructField("ats", T.ArrayType(T.LongType()))])
        name = T.StructType([T.StructField("event_id", T.StringType())])
        place = T.StructType([T.StructField("tick", T.LongType()), T.StructField("part", T.LongType())])
        known = T.StructType([T.StructField("first", T.LongType()), T.StructField("end", T.LongType()),
                              T.StructField("ordered", T.BooleanType())])
        delivery = T.StructType([T.StructField("at", T.LongType()), T.StructField("deliveries", T.LongType()),
                                 T.StructField("since", T.LongType())])
        self.handle = handle
        self.waiting = handle.getMapState("waiting", place, _PART_ROWS)
        self.ticks = handle.getMapState("ticks", number, known)
        self.pending = handle.getMapState("pending", name, delivery)
        self.acks = handle.getMapState("acks", name, moments)
        self.marks = handle.getMapState("marks", name, moments)
        self.done = handle.getValueState("done", number)

    # ------------------------------------------------------------ what comes in

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        timers = set()
        for chunk in rows:
            for kind, part in chunk.groupby("kind"):
                ats, ids = part["moment_micros"].astype("int64"), part["event_id"]
                if kind == PUBLISHED:
                    for tick, own in part.groupby(ats // self.tick + 1):
                        self._wait(int(tick), own["moment_micros"].astype("int64").tolist(), own["event_id"].tolist())
                        timers.add(int(tick))
                elif kind == DELIVERED:
                    for at, event_id, times in zip(ats.tolist(), ids, part["deliveries"].tolist()):
                        self.pending.updateValue((event_id,), (at, int(times), at))
                        timers.add(at // self.tick + 1)
                else:
                    state = self.acks if kind == ACKED else self.marks
                    for event_id, own in ats.groupby(ids):
                        before = state.getValue((event_id,))[0] if state.containsKey((event_id,)) else []
                        state.updateValue((event_id,), ([*before, *own.tolist()],))
                    timers.add(int(ats.max()) // self.tick + 1)
        for tick in timers:
            self.handle.registerTimer(tick * self.tick // 1000)
        return iter(())

    def _wait(self, tick: int, ats: list[int], ids: list[str]) -> None:
        first, end, _ = self.ticks.getValue((tick,)) if self.ticks.containsKey((tick,)) else (0, 0, False)
        self.waiting.updateValue((tick, end), (ats, ids))
        self.ticks.updateValue((tick,), (first, end + 1, False))

    # ------------------------------------------------------------ ticks

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """All ticks up to the watermark that have something to do, each once."""
        tick = expiredTimerInfo.getExpiryTimeInMs() * 1000 // self.tick
        if self.done.exists():
            tick = max(tick, self.done.get()[0] + 1)
        last = timerValues.getCurrentWatermarkInMs() * 1000 // self.tick
        while tick <= last:
            claimed = self._claim(tick)
            self.done.update((tick,))
            if claimed:
                moment = tick * self.tick
                yield pd.DataFrame([(*key, moment, *row) for row in claimed], columns=["consumer", *CLAIMED])
            busy = self.pending.exists() or any(t[0] <= tick for t in self.ticks.keys())
            if not busy:
                return
            tick += 1
        self.handle.registerTimer(tick * self.tick // 1000)

    def _claim(self, tick: int) -> list[tuple[str, int, int]]:
        now = tick * self.tick
        pending = {k[0]: tuple(v) for k, v in self.pending.iterator()}
        for (event_id,), (ats,) in list(self.acks.iterator()):
            if any(at <= now for at in ats):
                if event_id in pending and any(pending[event_id][2] <= at <= now for at in ats):
                    del pending[event_id]
                    self.pending.removeKey((event_id,))
                self._keep(self.acks, event_id, [at for at in ats if at > now])
        known = [(v[0], k, v[1]) for k, v in pending.items() if v[2] <= now]
        taken = sorted(known)[: self.size] if known else [(at, event_id, 0) for at, event_id in self._next(tick)]
        out = []
        for at, event_id, times in taken:
            if self._is_marked(event_id, now):
                if event_id in pending:
                    self.pending.removeKey((event_id,))
                continue
            self.pending.updateValue((event_id,), (at, times + 1, now))
            out.append((event_id, at, times + 1))
        return out

    def _is_marked(self, event_id: str, now: int) -> bool:
        if not self.marks.containsKey((event_id,)):
            return False
        ats = self.marks.getValue((event_id,))[0]
        self._keep(self.marks, event_id, [at for at in ats if now < at + self.ttl])
        return any(at <= now < at + self.ttl for at in ats)

    @staticmethod
    def _keep(state, event_id: str, ats: list[int]) -> None:
        if ats:
            state.updateValue((event_id,), (ats,))
        else:
            state.removeKey((event_id,))

    def _next(self, tick: int) -> list[tuple[int, str]]:
        """Take the first events published before this tick, as many as a batch holds."""
        out: list[tuple[int, str]] = []
        for earlier in sorted(t[0] for t in self.ticks.keys() if t[0] <= tick):
            first, end, ordered = self.ticks.getValue((earlier,))
            if not ordered:
                first, end = self._order(earlier, first, end)
            while first < end and len(out) < self.size:
                ats, ids = self.waiting.getValue((earlier, first))
                rows = list(zip(ats, ids))
                free = self.size - len(out)
                out += rows[:free]
                if rows[free:]:
                    self.waiting.updateValue((earlier, first), tuple(map(list, zip(*rows[free:]))))
                else:
                    self.waiting.removeKey((earlier, first))
                    first += 1
            if first < end:
                self.ticks.updateValue((earlier,), (first, end, True))
                break
            self.ticks.removeKey((earlier,))
        return out

    def _order(self, tick: int, first: int, end: int) -> tuple[int, int]:
        rows = sorted(row for part in range(first, end) for row in zip(*self.waiting.getValue((tick, part))))
        for part in range(first, end):
            self.waiting.removeKey((tick, part))
        parts = range(0, len(rows), PART)
        for number, start in enumerate(parts):
            self.waiting.updateValue((tick, number), tuple(map(list, zip(*rows[start : start + PART]))))
        return 0, len(parts)

    def close(self) -> None:
        pass


def bus_rows(rows: DataFrame, kind: str, at: str, consumer: str = "consumer", deliveries: str | None = None) -> DataFrame:
    """Rows of one kind as the claiming stream takes them: what happened to which event of which consumer, and when."""
    return rows.select(
        F.col(consumer).cast("string").alias("consumer"), F.col("event_id").cast("string").alias("event_id"),
        F.lit(kind).alias("kind"), F.col(at).cast("timestamp").alias("at"),
        (F.col(deliveries) if deliveries else F.lit(0)).cast("bigint").alias("deliveries"),
    )


def claim_stream(
    bus: DataFrame, tick_seconds: int = 60, batch_size: int = DEFAULTS.relay_batch_size,
    ttl_seconds: int = DEFAULTS.dispatch_ttl_seconds, lateness: str = "10 minutes",
) -> DataFrame:
    """``consumer, tick, event_id, at, deliveries``: what every consumer claims at each tick.

    ``bus`` is a union of ``bus_rows``. A consumer with unacknowledged deliveries gets those again, the oldest first;
    only one without gets new events. A batch is filled before dispatched events, which have a live mark, are left
    out; those count as acknowledged. Rows later than ``lateness`` are dropped, as in any stream with a watermark.
    """
    timed = bus.withWatermark("at", lateness)
    rows = timed.select("consumer", "event_id", "kind", "deliveries", F.unix_micros("at").alias("moment_micros"), "at")
    schema = ", ".join(["consumer string", *(f"{name} {kind}" for name, kind in CLAIMED.items())])
    claimed = rows.groupBy("consumer").transformWithStateInPandas(
        Claims(tick_seconds, batch_size, ttl_seconds), schema, "Append", "EventTime"
    )
    return claimed.select(
        "consumer", F.timestamp_micros("tick").alias("tick"), "event_id", F.timestamp_micros("at").alias("at"), "deliveries"
    )
