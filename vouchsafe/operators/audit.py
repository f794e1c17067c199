"""Governance KPIs. Every report takes its time of reference; none reads the clock."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vouchsafe.model import PROMOTED, REJECTED, ROLLED_BACK
from vouchsafe.operators.ledger import serving_alias, stuck

# Fixed values.
MAX_FAILURE_RATE = 0.25
STUCK_AFTER_HOURS = 2
# Upper bounds of the latency histogram, in seconds; a last bucket is unbounded.
LATENCY_BUCKETS = (
    0.005, 0.01, 0.025, 0.05, 0.075, 0.1, 0.25, 0.5, 0.75, 1.0, 2.5, 5.0, 7.5, 10.0,
)


def within(at: str, as_of: Column, hours: int) -> Column:
    """Strictly later than ``hours`` before ``as_of``, and not later than it."""
    return (F.col(at) > as_of - F.make_dt_interval(hours=F.lit(hours))) & (F.col(at) <= as_of)


def decision_counts(promotions: DataFrame, as_of: Column, hours: int = 24) -> DataFrame:
    return (
        promotions.where(within("decided_at", as_of, hours))
        .groupBy("decision")
        .agg(F.count(F.lit(1)).alias("decisions"))
    )


def quarantine_by_dataset(
    quarantine: DataFrame, versions: DataFrame, as_of: Column, hours: int = 24
) -> DataFrame:
    """Records are counted per version first, so the join moves a row per version."""
    per_version = (
        quarantine.where(within("created_at", as_of, hours))
        .groupBy("version_id")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return (
        per_version.join(versions.select("version_id", "dataset"), "version_id")
        .groupBy("dataset")
        .agg(F.sum("n").alias("records"))
    )


def quarantine_total(quarantine: DataFrame, as_of: Column, hours: int = 24) -> DataFrame:
    return quarantine.where(within("created_at", as_of, hours)).agg(
        F.count(F.lit(1)).alias("value")
    )


def stuck_versions(versions: DataFrame, as_of: Column, hours: int = STUCK_AFTER_HOURS) -> DataFrame:
    return stuck(versions, as_of - F.make_dt_interval(hours=F.lit(hours))).select(
        "version_id", "status"
    )


def health(promotions: DataFrame, versions: DataFrame, as_of: Column) -> DataFrame:
    """One row: decisions of a day, failure rate, stuck versions, and whether all is well."""
    stuck_count = stuck_versions(versions, as_of).agg(F.count(F.lit(1)).alias("n")).scalar()
    recent = promotions.where(within("decided_at", as_of, 24)).agg(
        F.count_if(F.col("decision") == PROMOTED).alias("promoted"),
        F.count_if(F.col("decision") == REJECTED).alias("rejected"),
    )
    decided = F.col("promoted") + F.col("rejected")
    rate = F.coalesce(F.col("rejected") / F.nullif(decided, F.lit(0)), F.lit(0.0))
    return (
        recent.withColumn("stuck", stuck_count)
        .withColumn("healthy", (rate <= MAX_FAILURE_RATE) & (F.col("stuck") == 0))
        .withColumn("failure_rate", F.round(rate, 3))
        .withColumn("alert", ~F.col("healthy"))
    )


def versions_by_status(versions: DataFrame) -> DataFrame:
    return (
        versions.groupBy("dataset", "status")
        .agg(F.count(F.lit(1)).alias("versions"), F.max("created_at").alias("latest"))
        .orderBy("dataset", "status")
    )


def pass_rate_by_check(reports: DataFrame, as_of: Column, hours: int = 7 * 24) -> DataFrame:
    return (
        reports.where(within("created_at", as_of, hours))
        .groupBy("check_name")
        .agg(
            F.round(F.avg(F.col("passed").cast("int")), 3).alias("pass_rate"),
            F.count(F.lit(1)).alias("runs"),
        )
        .orderBy("pass_rate", "check_name")
    )


def plane_stats(promotions: DataFrame, versions: DataFrame, live: DataFrame) -> DataFrame:
    """Counters, and one row per dataset for what it serves."""
    decided = promotions.agg(
        *[
            F.count_if(F.col("decision") == d).alias(d)
            for d in (PROMOTED, REJECTED, ROLLED_BACK)
        ]
    )
    known = versions.agg(
        F.count(F.lit(1)).alias("versions"), F.count_distinct("dataset").alias("datasets")
    )
    collections = live.agg(F.count(F.lit(1)).alias("collections"))
    counters = None
    for counted in (decided, known, collections):
        rows = counted.unpivot(
            [], counted.columns, "metric", "value"
        ).select("metric", F.lit("").alias("label"), F.col("value").cast("string"))
        counters = rows if counters is None else counters.unionAll(rows)
    serving = serving_alias(promotions)
    per_dataset = (
        versions.select("dataset").distinct().join(serving, "dataset", "left")
        .select(F.lit("serving"), F.col("dataset"), F.col("version_id"))
    )
    return counters.unionAll(per_dataset)


def sliding_rate(
    events: DataFrame, label: str, at: str = "ts", minutes: int = 5, slide_minutes: int = 1
) -> DataFrame:
    """Events per second and label over trailing windows.

    Counting per slide first keeps the window expansion off the raw rows.
    """
    steps = events.groupBy(
        F.window(at, f"{slide_minutes} minutes").alias("step"), F.col(label).alias("label")
    ).agg(F.count(F.lit(1)).alias("n"))
    back = F.explode(F.sequence(F.lit(0), F.lit(minutes // slide_minutes - 1)))
    return (
        steps.select("step", "label", "n", back.alias("k"))
        .groupBy(
            (F.col("step.start") - F.make_dt_interval(mins=F.col("k") * slide_minutes)).alias(
                "window_start"
            ),
            "label",
        )
        .agg((F.sum("n") / F.lit(minutes * 60.0)).alias("rate"))
    )


def sliding_rate_stream(
    events: DataFrame, label: str, at: str = "ts", minutes: int = 5, slide_minutes: int = 1,
    lateness: str = "10 minutes",
) -> DataFrame:
    """The same report as one streaming aggregation."""
    window = F.window(at, f"{minutes} minutes", f"{slide_minutes} minutes")
    return (
        events.withWatermark(at, lateness)
        .groupBy(window.alias("w"), F.col(label).alias("label"))
        .agg((F.count(F.lit(1)) / F.lit(minutes * 60.0)).alias("rate"))
        .select(F.col("w.start").alias("window_start"), "label", "rate")
    )


def histogram_quantile(
    df: DataFrame, by: list[Column], value: str, quantile: float,
    bounds: tuple[float, ...] = LATENCY_BUCKETS,
) -> DataFrame:
    """Quantile interpolated within histogram buckets: a few counters per group, whatever its size.

    Within a bucket values count as evenly spread. A quantile in the unbounded
    last bucket is reported as the largest bound.
    """
    counted = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col(value) <= bound).alias(f"le_{i}") for i, bound in enumerate(bounds)],
    )
    rank = F.col("total") * F.lit(quantile)
    estimate = F.lit(bounds[-1])
    for i in reversed(range(len(bounds))):
        low = F.lit(bounds[i - 1] if i else 0.0)
        below = F.col(f"le_{i - 1}") if i else F.lit(0)
        share = (rank - below) / F.nullif(F.col(f"le_{i}") - below, F.lit(0))
        inside = low + (F.lit(bounds[i]) - low) * share
        estimate = F.when(F.col(f"le_{i}") >= rank, inside).otherwise(estimate)
    names = [c for c in counted.columns if not c.startswith("le_")]
    return counted.select(*names, estimate.alias("quantile"))
