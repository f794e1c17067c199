"""Redelivery and dead-lettering as a stateful stream, with restartable sinks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from vouchsafe.operators.events import DEAD_LETTERED, DISPATCHED, PENDING, dead_letters
from vouchsafe.settings import Settings


class Deliveries(StatefulProcessor):
    """Counts a message's delivery attempts until it is dispatched or dead-lettered."""

    def __init__(self, order: list[str], ok: str, max_deliveries: int, state_ttl_ms: int):
        self.order, self.ok = order, ok
        self.max_deliveries, self.state_ttl_ms = max_deliveries, state_ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        schema = T.StructType(
            [T.StructField("deliveries", T.LongType()), T.StructField("over", T.BooleanType())]
        )
        self.state = handle.getValueState("deliveries", schema, self.state_ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        done, over = self.state.get() if self.state.exists() else (0, False)
        before = (done, over)
        # An attempt after the allowed number ends the message, so no more can count.
        left = 0 if over else self.max_deliveries + 1 - done
        first = None
        for chunk in rows:
            # the first attempts of the whole batch, wherever Arrow cut it
            first = chunk if first is None else pd.concat([first, chunk])
            first = first.sort_values(self.order, kind="stable").head(left)
        if left and first is not None:
            delivery = done + 1 + np.arange(len(first))
            effect = np.where(
                delivery > self.max_deliveries,
                DEAD_LETTERED,
                np.where(first[self.ok].to_numpy(), DISPATCHED, PENDING),
            )
            ends = np.nonzero(effect != PENDING)[0]
            taken = int(ends[0]) + 1 if len(ends) else len(first)
            done, over = done + taken, bool(len(ends))
            yield first.head(taken).assign(delivery=delivery[:taken], effect=effect[:taken])
        if (done, over) != before:
            self.state.update((done, over))

    def close(self) -> None:
        pass


def relay_stream(
    attempts: DataFrame,
    message: list[str],
    order: list[str],
    ok: str = "ok",
    max_deliveries: int = Settings().max_deliveries,
    state_ttl_seconds: int = 7 * Settings().dispatch_ttl_seconds,
) -> DataFrame:
    """The attempts that take place, with ``delivery`` number and ``effect``."""
    ordered = attempts.select(*message, *[c for c in attempts.columns if c not in message])
    schema = T.StructType(
        [*ordered.schema.fields, T.StructField("delivery", T.LongType()),
         T.StructField("effect", T.StringType())]
    )
    processor = Deliveries(order, ok, max_deliveries, state_ttl_seconds * 1000)
    return ordered.groupBy(*message).transformWithStateInPandas(
        processor, schema, "Append", "ProcessingTime"
    )


class MarkerLifetimes(StatefulProcessor):
    """Whether an event lacks a live marker, told at each moment at which that changes.

    Timers at an event's time, and at the beginning and end of each marker, fire once the watermark has
    passed them, so that all markers of that moment are known.
    """

    def __init__(self, ttl_seconds: int, forget_seconds: int):
        self.ttl, self.forget = ttl_seconds * 1_000_000, forget_seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        moments = T.StructType([T.StructField("at", T.LongType())])
        told = T.StructType([T.StructField("at", T.LongType()), T.StructField("waits", T.BooleanType())])
        self.event = handle.getValueState("event", moments)
        self.marks = handle.getListState("marks", moments)
        self.told = handle.getValueState("told", told)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for chunk in rows:
            for is_mark, at in zip(chunk["is_mark"].tolist(), chunk["moment_micros"].tolist()):
                if is_mark:
                    self.marks.appendValue((at,))
                    self._wake(at)
                    self._wake(at + self.ttl)
                elif not self.event.exists() or at < self.event.get()[0]:
                    self.event.update((at,))
                    self._wake(at)
        return iter(())

    def _wake(self, at: int) -> None:
        self.handle.registerTimer(-(-at // 1000))  # milliseconds, not before the moment

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = timerValues.getCurrentWatermarkInMs() * 1000
        marks = sorted(m[0] for m in self.marks.get())
        last, waits = self.told.get() if self.told.exists() else (None, None)
        if self.event.exists():
            begin = self.event.get()[0]
            changes = {begin, *marks, *(m + self.ttl for m in marks)}
            told = []
            for at in sorted(c for c in changes if begin <= c <= until and (last is None or c > last)):
                now = not any(m <= at < m + self.ttl for m in marks)
                last = at
                if now != waits:
                    waits = now
                    told.append((key[0], at, now))
            if last is not None:
                self.told.update((last, waits))
            if told:
                yield pd.DataFrame(told, columns=["event_id", "at", "undispatched"])
        # a marker is needed until it has ended; an event until it has been served and forgotten
        kept = [m for m in marks if m + self.ttl > until]
        if len(kept) < len(marks):
            self.marks.put([(m,) for m in kept]) if kept else self.marks.clear()
        if last is not None and not kept:
            if last + self.forget <= until:
                self.event.clear()
                self.told.clear()
            else:
                self._wake(last + self.forget)

    def close(self) -> None:
        pass


def dispatch_changes(
    events: DataFrame, markers: DataFrame, at: str = "ts", ttl_seconds: int = Settings().dispatch_ttl_seconds,
    lateness: str = "10 minutes", forget_seconds: int = 30 * Settings().dispatch_ttl_seconds,
) -> DataFrame:
    """``event_id, at, undispatched``: when each event came to lack a live marker, got one, and lacked one again.

    A marker lives for ``ttl_seconds``, each on its own. ``operators.events.undispatched_at`` reads the state of any
    moment from the changes. An event of which nothing was heard for ``forget_seconds`` is no longer followed.
    """

    def timed(rows: DataFrame, column: str, is_mark: bool) -> DataFrame:
        return rows.select(
            "event_id", F.lit(is_mark).alias("is_mark"), F.col(column).cast("timestamp").alias("_at")
        ).withWatermark("_at", lateness)

    both = timed(events, at, False).unionByName(timed(markers, "marked_at", True))
    rows = both.select("event_id", "is_mark", F.unix_micros("_at").alias("moment_micros"), "_at")
    id_type = events.schema["event_id"].dataType.simpleString()
    changes = rows.groupBy("event_id").transformWithStateInPandas(
        MarkerLifetimes(ttl_seconds, forget_seconds), f"event_id {id_type}, at long, undispatched boolean", "Append", "EventTime"
    )
    return changes.withColumn("at", F.timestamp_micros("at"))


def undispatched_stream(
    events: DataFrame, markers: DataFrame, at: str = "ts", wait: str = "1 hour",
    lateness: str = "10 minutes",
) -> DataFrame:
    """Events that no marker followed within ``wait``; they appear once the watermark has passed."""
    late_events = events.withWatermark(at, lateness)
    late_markers = markers.select(
        F.col("event_id").alias("_marked"), F.col("marked_at")
    ).withWatermark("marked_at", lateness)
    follows = (
        (F.col("event_id") == F.col("_marked"))
        & (F.col("marked_at") >= F.col(at))
        & (F.col("marked_at") <= F.col(at) + F.expr(f"INTERVAL {wait}"))
    )
    joined = late_events.join(late_markers, follows, "left_outer")
    return joined.where(F.col("_marked").isNull()).drop("_marked", "marked_at")


def batch_sink(*writers: tuple[str, Callable[[DataFrame], DataFrame]]):
    """A ``foreachBatch`` function that writes each output of a batch under the batch's number.

    A batch that is replayed after a failure overwrites what it wrote before, so
    every output holds it once.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            for path, part in writers:
                part(batch).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
        finally:
            batch.unpersist()

    return write


def relay_sink(
    base: str, original_id: str, event_type: str, payload: str,
    max_deliveries: int = Settings().max_deliveries,
):
    """Dispatch markers, dead letters and all steps of the relay, each in its own folder."""
    return batch_sink(
        (f"{base}/steps", lambda b: b),
        (
            f"{base}/markers",
            lambda b: b.where(F.col("effect") == DISPATCHED).select(
                F.col(original_id).alias("event_id"), F.current_timestamp().alias("marked_at")
            ),
        ),
        (
            f"{base}/dead_letters",
            lambda b: dead_letters(b, original_id, event_type, payload, max_deliveries),
        ),
    )
