"""Quality gates: one aggregation measures a version, a row per check judges it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vouchsafe.operators.contracts import FieldReader
from vouchsafe.settings import GateThresholds

# The checks in the order they are reported.
CHECKS = (
    "min_records",
    "completeness",
    "uniqueness",
    "validation_pass_rate",
    "embedding_coverage",
    "schema_drift",
)

_CHECK = "ord INT, check_name STRING, passed BOOLEAN, score DOUBLE, threshold DOUBLE, details STRING"


def measures(read: FieldReader, required: list[str], key: str, keep: Column | None = None) -> list[Column]:
    """Aggregates behind the table gates, for one pass. ``keep`` restricts them to some rows."""
    keep = F.lit(True) if keep is None else keep
    rows = F.count_if(keep)
    cells = [F.count_if(keep & read(name).filled) for name in required]
    filled = cells[0] if cells else F.lit(0).cast("bigint")
    for cell in cells[1:]:
        filled = filled + cell
    ident = read(key)
    return [
        rows.alias("rows"),
        filled.alias("filled_cells"),
        (rows * F.lit(len(required))).alias("total_cells"),
        F.count_distinct(F.when(keep & ident.present, ident.as_string)).alias("unique_keys"),
        F.count_if(keep & ident.present).alias("rows_with_key"),
    ]


def _row(name: str, passed: Column, score: Column, threshold, details: Column) -> Column:
    return F.struct(
        F.lit(CHECKS.index(name)).alias("ord"),
        F.lit(name).alias("check_name"),
        passed.alias("passed"),
        score.cast("double").alias("score"),
        F.lit(threshold).cast("double").alias("threshold"),
        details.alias("details"),
    ).cast(f"struct<{', '.join(part.strip().replace(' ', ':') for part in _CHECK.split(','))}>")


def _at_least(name: str, score: Column, threshold, details: Column | None = None) -> Column:
    bar = F.lit(threshold)
    return _row(name, score >= bar, score, threshold, F.lit("{}") if details is None else details)


def min_records_check(bar: int) -> Column:
    rows = F.col("rows")
    return _at_least("min_records", rows, bar, F.to_json(F.struct(rows.alias("record_count"))))


def completeness_check(bar: float) -> Column:
    """Vacuously complete without rows or without required fields."""
    filled, total = F.col("filled_cells"), F.col("total_cells")
    vacuous = total == 0
    score = F.when(vacuous, 1.0).otherwise(filled / F.nullif(total, F.lit(0)))
    details = F.when(vacuous, "{}").otherwise(F.to_json(F.struct(filled, total)))
    return _row("completeness", vacuous | (score >= F.lit(bar)), score, bar, details)


def uniqueness_check(bar: float, key: str) -> Column:
    """Distinct keys over all rows; rows without a key count against the score."""
    rows, unique, keyed = F.col("rows"), F.col("unique_keys"), F.col("rows_with_key")
    score = (
        F.when(rows == 0, 1.0).when(keyed == 0, 0.0).otherwise(unique / F.nullif(rows, F.lit(0)))
    )
    passed = (rows == 0) | ((keyed > 0) & (score >= F.lit(bar)))
    details = (
        F.when(rows == 0, "{}")
        .when(
            keyed == 0,
            F.to_json(F.struct(F.lit(f"no records contain key field '{key}'").alias("error"))),
        )
        .otherwise(
            F.to_json(
                F.struct(
                    unique,
                    rows.alias("total_records"),
                    (rows - keyed).alias("records_missing_key"),
                )
            )
        )
    )
    return _row("uniqueness", passed, score, bar, details)


def pass_rate_check(bar: float, rate: Column) -> Column:
    return _at_least("validation_pass_rate", rate, bar)


def coverage_check(bar: float, coverage: Column) -> Column:
    return _at_least("embedding_coverage", coverage, bar)


def drift_check(drifted: Column, report: Column | None = None) -> Column:
    score = F.when(drifted, 0.0).otherwise(1.0)
    return _row("schema_drift", ~drifted, score, 1.0, F.lit("{}") if report is None else report)


@dataclass(frozen=True)
class GateInputs:
    """Results of earlier stages. A gate whose input is None is left out."""

    pass_rate: Column
    embedding_coverage: Column | None = None
    drifted: Column | None = None
    drift_report: Column | None = None


def gate_checks(inputs: GateInputs, key: str, bars: GateThresholds) -> list[Column]:
    """The checks, in order, as structs over the columns of ``measures``."""
    checks = [
        min_records_check(bars.min_records),
        completeness_check(bars.completeness),
        uniqueness_check(bars.uniqueness, key),
        pass_rate_check(bars.validation_pass_rate, inputs.pass_rate),
    ]
    if inputs.embedding_coverage is not None:
        checks.append(coverage_check(bars.embedding_coverage, inputs.embedding_coverage))
    if inputs.drifted is not None:
        checks.append(drift_check(inputs.drifted, inputs.drift_report))
    return checks


def gate_suite(
    measured: DataFrame, inputs: GateInputs, key: str = "id", bars: GateThresholds | None = None
) -> DataFrame:
    """A row per check from the single row of ``measures``."""
    return measured.select(F.inline(F.array(*gate_checks(inputs, key, bars or GateThresholds()))))


def verdict(checks: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Verdict and failed checks in check order. A version has at most six checks."""
    failed = F.array_sort(
        F.collect_list(F.when(~F.col("passed"), F.struct("ord", "check_name")))
    )
    scores = F.array_sort(
        F.collect_list(
            F.struct(
                "ord",
                F.col("check_name").alias("check"),
                "passed",
                F.round("score", 4).alias("score"),
                "threshold",
                "details",
            )
        )
    )
    return (
        checks.groupBy(*(by or []))
        .agg(
            F.bool_and("passed").alias("passed"),
            F.count(F.lit(1)).alias("total_checks"),
            F.transform(failed, lambda c: c["check_name"]).alias("failed_checks"),
            F.transform(scores, lambda c: c.dropFields("ord")).alias("checks"),
        )
    )


def gate_summary(verdict_row: DataFrame, version_id: Column) -> DataFrame:
    """Add the verdict as one JSON text, the form the ledger keeps."""
    return verdict_row.withColumn(
        "gate_summary",
        F.to_json(
            F.struct(
                version_id.alias("version_id"), "passed", "total_checks", "failed_checks", "checks"
            )
        ),
    )


class GateRejected(RuntimeError):
    """Raised by a threshold gate that was asked to fail on rejection."""


def threshold_gate(scores: DataFrame, thresholds: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Judge ``(name, score)`` rows against ``(name, threshold)`` rows.

    Every threshold needs a score that reaches it; a missing score fails, other
    scores are ignored. Failed names are kept in name order; there are no more of
    them than thresholds, which are a driver-side configuration.
    """
    keys = [*(by or []), "name"]
    judged = thresholds.join(scores, keys, "left").withColumn(
        "ok", F.coalesce(F.col("score") >= F.col("threshold"), F.lit(False))
    )
    failed = F.array_sort(F.collect_list(F.when(~F.col("ok"), F.col("name"))))
    passed = F.coalesce(F.bool_and("ok"), F.lit(False))
    return (
        judged.groupBy(*(by or []))
        .agg(
            passed.alias("passed"),
            F.count(F.lit(1)).alias("total_checks"),
            failed.alias("failed_checks"),
        )
        .withColumn("decision", F.when(F.col("passed"), "promoted").otherwise("rejected"))
    )


def enforce(judged: DataFrame) -> DataFrame:
    """Fail the run if the single verdict is a rejection."""
    row = judged.first()
    if not row["passed"]:
        raise GateRejected(
            "promotion gate rejected the version; failed checks: " + ", ".join(row["failed_checks"])
        )
    return judged
