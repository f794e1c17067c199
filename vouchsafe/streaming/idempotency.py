"""Idempotent publishing as a stateful stream."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from vouchsafe.settings import Settings

MICROS = 1_000_000
# Spark hands rows over as named tuples, whose names cannot begin with an underscore.
MOMENT = "moment_micros"


class FirstWins(StatefulProcessor):
    """Keeps, per key, when its lock was taken.

    Duplicates do not touch the state, so they do not extend the lock. A key's rows of
    one micro-batch are ordered together; the source's limit per trigger bounds them.
    """

    def __init__(self, ttl_seconds: int, state_ttl_seconds: int, event_id: str):
        self.ttl = ttl_seconds * MICROS
        self.state_ttl_ms = state_ttl_seconds * 1000
        self.event_id = event_id

    def init(self, handle: StatefulProcessorHandle) -> None:
        schema = T.StructType([T.StructField("taken_at", T.LongType())])
        self.lock = handle.getValueState("lock", schema, self.state_ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        taken = self.lock.get()[0] if self.lock.exists() else None
        before = taken
        # In order of time within the batch, wherever Arrow cut it; what the lock covers already is not kept.
        chunks = [c if taken is None else c[c[MOMENT] >= taken + self.ttl] for c in rows]
        batch = pd.concat(chunks).sort_values([MOMENT, self.event_id], kind="stable")
        moments = batch[MOMENT].to_numpy()
        accepted, at = [], 0
        while at < len(moments):
            accepted.append(at)
            taken = int(moments[at])
            at = max(at + 1, int(np.searchsorted(moments, taken + self.ttl)))
        if accepted:
            yield batch.iloc[accepted].drop(columns=MOMENT)
        if taken != before:
            self.lock.update((taken,))

    def close(self) -> None:
        pass


def publish_stream(
    events: DataFrame,
    keys: list[str],
    at: str = "ts",
    event_id: str = "event_id",
    ttl_seconds: int = Settings().idempotency_ttl_seconds,
    state_ttl_seconds: int | None = None,
) -> DataFrame:
    """The accepted events of a stream, in arrival order per key.

    The lock runs in event time from the accepted event. State is cleaned up in
    processing time, by default after twice the lock, so that a query that lags
    behind its events by less than a lock still finds it. Events without a key are
    never duplicates and pass as they are.
    """
    moment = F.unix_micros(F.col(at).cast("timestamp"))
    columns = [*keys, *[c for c in events.columns if c not in keys]]
    ordered = events.select(*columns)
    keyed = functools.reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in keys))
    accepted = (
        ordered.where(keyed)
        .withColumn(MOMENT, moment)
        .groupBy(*keys)
        .transformWithStateInPandas(
            FirstWins(ttl_seconds, state_ttl_seconds or 2 * ttl_seconds, event_id),
            ordered.schema,
            "Append",
            "ProcessingTime",
        )
    )
    return accepted.unionByName(ordered.where(~keyed))


def publish_stream_windowed(
    events: DataFrame, keys: list[str], at: str = "ts", ttl: str = "24 hours"
) -> DataFrame:
    """The built-in operator: drops duplicates for at least ``ttl``, often for longer."""
    return events.withWatermark(at, ttl).dropDuplicatesWithinWatermark(keys)
