"""Mergeable sketches: distinct keys and quantiles of groups, merged when they are read.

A sketch row stands for its group's rows at a fixed size, so windows and versions are sketched once,
kept as a table, and added up over any span of windows, datasets or versions without their rows.
Distinct keys come from HyperLogLog, quantiles from KLL sketches.

Null keys are counted as rows without a key, null and NaN values are left out. A group without values has null
quantiles; a table without rows has no sketches.
"""

from __future__ import annotations

from math import sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: 2^18 registers: at most 256 KB a group, for a relative error of 0.16 %.
LOG_REGISTERS = 18
#: Items of a quantile sketch's level: ranks within half a percent.
KLL_SIZE = 800
#: How many standard errors an estimate must lie from a bar to be believed.
SURE = 3.0


def key_error(log_registers: int = LOG_REGISTERS) -> float:
    """The relative standard error of merged counts of distinct keys."""
    return 0.8326 / sqrt(2.0**log_registers)


def sketch(
    df: DataFrame, by: list[Column], key: Column, value: Column | None = None,
    log_registers: int = LOG_REGISTERS, kll_size: int = KLL_SIZE,
) -> DataFrame:
    """A row for each group: rows, rows with a key, and its sketches.

    Both are partial aggregates: what is shuffled is a sketch for each group and task, and a hot group
    costs no more than another.
    """
    made = [
        F.count(F.lit(1)).alias("rows"),
        F.count(key).alias("rows_with_key"),
        F.hll_sketch_agg(key.cast("string"), log_registers).alias("key_sketch"),
    ]
    if value is not None:
        made += [
            F.count_if(value.isNotNull() & ~F.isnan(value.cast("double"))).alias("values"),
            F.kll_sketch_agg_double(value.cast("double"), kll_size).alias("value_sketch"),
        ]
    return df.groupBy(*by).agg(*made)


def merge(sketches: DataFrame, by: list[Column]) -> DataFrame:
    """Sketch rows of the coarser groups ``by``; without any, of all rows."""
    merged = [
        F.sum("rows").alias("rows"),
        F.sum("rows_with_key").alias("rows_with_key"),
        F.hll_union_agg("key_sketch").alias("key_sketch"),
    ]
    if "value_sketch" in sketches.columns:
        merged += [
            F.sum("values").alias("values"),
            F.kll_merge_agg_double("value_sketch").alias("value_sketch"),
        ]
    return sketches.groupBy(*by).agg(*merged)


def unique_keys() -> Column:
    """Estimated distinct keys of a sketch row; never more than there are rows with a key."""
    return F.least(F.hll_sketch_estimate("key_sketch"), F.col("rows_with_key"))


def uniqueness(sketches: DataFrame, bar: float, log_registers: int = LOG_REGISTERS) -> DataFrame:
    """The uniqueness gate on estimates: score, verdict, and whether the estimate settles it.

    Rows that are not ``decided`` lie too near to the bar and want the exact gate
    (``gates.uniqueness_check``). Without rows, or without any key, the verdict needs no estimate.
    """
    rows, keyed = F.col("rows"), F.col("rows_with_key")
    score = (
        F.when(rows == 0, 1.0)
        .when(keyed == 0, 0.0)
        .otherwise(unique_keys() / F.nullif(rows, F.lit(0)))
    )
    margin = F.lit(SURE * key_error(log_registers)) * F.col("score")
    kept = [c for c in sketches.columns if not c.endswith("_sketch")]
    return (
        sketches.withColumn("score", score)
        .withColumn("passed", (rows == 0) | ((keyed > 0) & (F.col("score") >= F.lit(bar))))
        .withColumn("decided", (rows == 0) | (keyed == 0) | (F.abs(F.col("score") - F.lit(bar)) >= margin))
        .select(*kept, "score", "passed", "decided")
    )


def quantile(share: float) -> Column:
    """The estimated quantile of a sketch row's values; null without values."""
    return F.when(
        F.col("values") > 0, F.kll_sketch_get_quantile_double("value_sketch", F.lit(float(share)))
    )
