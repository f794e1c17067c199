"""Session and tumbling windows over events, with a defined fate for rows that come late.

Events arrive in batches. Before each batch the watermark is the greatest event time of all earlier batches less the
allowed lateness; a row is late if its window had ended by then, and counts apart. Window results are kept as partial
ones that merge, so a stream writes the partial results of a batch and readers merge what there is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MICROS = 1_000_000


def _micros(column: Column) -> Column:
    return F.unix_micros(column.cast("timestamp"))


def _ntz(micros: Column) -> Column:
    return F.timestamp_micros(micros).cast("timestamp_ntz")


def window_start(at: Column, width_seconds: int) -> Column:
    """Start of the tumbling window, in microseconds."""
    width = width_seconds * MICROS
    return F.floor(_micros(at) / width) * width


def watermarks(events: DataFrame, batch: str, at: str, lateness_seconds: int) -> DataFrame:
    """``batch, watermark`` (microseconds; null before the first batch). One row per batch takes part."""
    seen = events.groupBy(batch).agg(F.max(_micros(F.col(at))).alias("_seen"))
    before = Window.orderBy(batch).rowsBetween(Window.unboundedPreceding, -1)
    return seen.select(batch, (F.max("_seen").over(before) - lateness_seconds * MICROS).alias("watermark"))


def is_late(at: Column, watermark: Column, width_seconds: int) -> Column:
    """Whether the row's window ended before or at the watermark. A null watermark makes nothing late."""
    return F.coalesce(window_start(at, width_seconds) + width_seconds * MICROS <= watermark, F.lit(False))


def partial_windows(rows: DataFrame, by: list[str], at: str, value: str, width_seconds: int) -> DataFrame:
    """``by, window_start, n, least, greatest`` of rows that have a time."""
    return rows.where(F.col(at).isNotNull()).groupBy(
        *by, _ntz(window_start(F.col(at), width_seconds)).alias("window_start")
    ).agg(F.count(F.lit(1)).alias("n"), F.min(value).alias("least"), F.max(value).alias("greatest"))


def merged_windows(partial: DataFrame, by: list[str]) -> DataFrame:
    return partial.groupBy(*by, "window_start").agg(
        F.sum("n").alias("n"), F.min("least").alias("least"), F.max("greatest").alias("greatest")
    )


def tumbling_windows(
    events: DataFrame, by: list[str], at: str, value: str, batch: str, width_seconds: int, lateness_seconds: int
) -> DataFrame:
    """Windows of the rows in time, with the number of those that came late (``n_late``).

    A window that only late rows fell into has ``n`` 0. Rows without a time are in no window.
    """
    marks = watermarks(events, batch, at, lateness_seconds)
    late = is_late(F.col(at), F.col("watermark"), width_seconds)
    judged = events.join(marks, batch).where(F.col(at).isNotNull()).withColumn("_late", late)
    in_time = F.when(~F.col("_late"), F.col(value))
    return judged.groupBy(*by, _ntz(window_start(F.col(at), width_seconds)).alias("window_start")).agg(
        F.count_if(~F.col("_late")).alias("n"), F.min(in_time).alias("least"), F.max(in_time).alias("greatest"),
        F.count_if("_late").alias("n_late"),
    )


# ------------------------------------------------------------------ sessions


#: Sessions are first found within slots of time of so many gaps.
SLOT_GAPS = 64


def partial_sessions(rows: DataFrame, by: list[str], at: str, value: str, gap_seconds: int) -> DataFrame:
    """``by, first, last, n, greatest``: a key's rows that follow each other in less than the gap, cut at slots of time.

    The slot is part of the shuffle's key, so that a key with very many rows is spread over its slots; what is left
    to merge is a row for each session and slot.
    """
    window = F.session_window(F.col(at), f"{gap_seconds} seconds")
    slot = window_start(F.col(at), gap_seconds * SLOT_GAPS)
    return (
        rows.where(F.col(at).isNotNull()).groupBy(*by, slot.alias("_slot"), window.alias("_w"))
        .agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count(F.lit(1)).alias("n"), F.max(value).alias("greatest"))
        .drop("_slot", "_w")
    )


def session_windows(rows: DataFrame, by: list[str], at: str, value: str, gap_seconds: int) -> DataFrame:
    """``by, first, last, n, greatest``: the sessions of each key. Rows without a time are in none."""
    return merged_sessions(partial_sessions(rows, by, at, value, gap_seconds), by, gap_seconds)


def merged_sessions(partial: DataFrame, by: list[str], gap_seconds: int) -> DataFrame:
    """Partial sessions of several batches as whole ones: those that begin in less than the gap after an earlier end merge."""
    in_order = Window.partitionBy(*by).orderBy("first", "last")
    end_before = F.max(_micros(F.col("last"))).over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.coalesce(_micros(F.col("first")) >= end_before + gap_seconds * MICROS, F.lit(True))
    numbered = partial.withColumn("_opens", opens.cast("int")).withColumn("_session", F.sum("_opens").over(in_order))
    return numbered.groupBy(*by, "_session").agg(
        F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n").alias("n"), F.max("greatest").alias("greatest")
    ).drop("_session")
