"""Tumbling and session windows of a stream, with late rows in an output of their own.

Each micro-batch writes, under its number: the partial windows and sessions of the rows in time, the late rows, and
the greatest event time so far. A batch that is replayed overwrites what it wrote, and reads the mark that the batch
before it left, so its split is the same again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vouchsafe.operators import windows as W
from vouchsafe.session import small_frame


def window_sink(
    base: str, by: list[str], at: str, value: str, width_seconds: int, lateness_seconds: int, gap_seconds: int
) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function. Sessions take the rows that are in time for their tumbling window."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = None
        if batch_id:
            before = spark.read.parquet(f"{base}/seen/batch_id={batch_id - 1}").first()["seen"]
        batch.persist()
        try:
            mark = None if before is None else before - lateness_seconds * W.MICROS
            late = W.is_late(F.col(at), F.lit(mark).cast("bigint"), width_seconds)
            in_time = batch.where(~F.coalesce(late, F.lit(False)))
            for name, rows in (
                ("windows", W.partial_windows(in_time, by, at, value, width_seconds)),
                ("sessions", W.partial_sessions(in_time, by, at, value, gap_seconds)),
                ("late", batch.where(late)),
            ):
                rows.write.mode("overwrite").parquet(f"{base}/{name}/batch_id={batch_id}")
            seen = batch.agg(F.max(F.unix_micros(F.col(at).cast("timestamp")))).first()[0]
            seen = max((x for x in (before, seen) if x is not None), default=None)
            row = [{"seen": seen}]
            small_frame(spark, row, "seen BIGINT").coalesce(1).write.mode("overwrite").parquet(f"{base}/seen/batch_id={batch_id}")
        finally:
            batch.unpersist()

    return write


def read_windows(spark: SparkSession, base: str, by: list[str]) -> DataFrame:
    return W.merged_windows(spark.read.parquet(f"{base}/windows").drop("batch_id"), by)


def read_sessions(spark: SparkSession, base: str, by: list[str], gap_seconds: int) -> DataFrame:
    return W.merged_sessions(spark.read.parquet(f"{base}/sessions").drop("batch_id"), by, gap_seconds)


def read_late(spark: SparkSession, base: str) -> DataFrame:
    """Late rows, with the number of the batch that they came in."""
    return spark.read.parquet(f"{base}/late")
