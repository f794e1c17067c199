"""The append-only ledger: versions, decisions, serving alias, rollback, retention.

Every question is answered from ``versions (dataset, version_id, ...)`` and
``promotions (id, version_id, decision, ...)``. Aggregates are used where a window
over a whole dataset would put one dataset's rows into one task; the windows that
remain are cut to a few rows per dataset before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vouchsafe.model import PROMOTED, REJECTED, ROLLBACK_FAILED, ROLLED_BACK, TERMINAL_STATUSES
from vouchsafe.settings import Settings

DEFAULTS = Settings()
ALL_PASSED = "all quality gates passed"
NO_LIVE_PREVIOUS = "no previous promoted version with a live collection"


def with_dataset(promotions: DataFrame, versions: DataFrame) -> DataFrame:
    """Ledger rows of known versions, with their dataset."""
    return promotions.join(versions.select("version_id", "dataset"), "version_id")


def register_versions(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming versions that are not registered yet; a known id is left untouched."""
    return incoming.join(existing, "version_id", "left_anti")


def latest_status(transitions: DataFrame) -> DataFrame:
    """Current state per version. A transition without a record count keeps the last one."""
    place = F.struct("at", "seq")
    return transitions.groupBy("version_id").agg(
        F.max_by("status", place).alias("status"),
        F.max_by("record_count", F.when(F.col("record_count").isNotNull(), place)).alias(
            "record_count"
        ),
        F.max("at").alias("updated_at"),
    )


def current_versions(versions: DataFrame, transitions: DataFrame) -> DataFrame:
    """Registered versions with the state their transitions have led to."""
    place = F.struct("at", "seq")
    state = transitions.groupBy("version_id").agg(
        F.max_by("status", place).alias("_status"),
        F.max_by("record_count", F.when(F.col("record_count").isNotNull(), place)).alias("_count"),
        F.max_by("schema_hash", F.when(F.col("schema_hash").isNotNull(), place)).alias("_hash"),
        F.max("at").alias("_at"),
    )
    newer = {
        "status": "_status", "record_count": "_count", "schema_hash": "_hash", "updated_at": "_at",
    }
    columns = [
        F.coalesce(newer[c], c).alias(c) if c in newer else F.col(c) for c in versions.columns
    ]
    return versions.join(state, "version_id", "left").select(*columns)


def list_versions(versions: DataFrame, dataset: str | None = None, limit: int = 50) -> DataFrame:
    """The newest versions; the limit is the size of the list."""
    chosen = versions if dataset is None else versions.where(F.col("dataset") == dataset)
    return chosen.orderBy(F.desc("created_at"), F.desc("version_id")).limit(limit)


def list_promotions(promotions: DataFrame, limit: int = 50) -> DataFrame:
    return promotions.orderBy(F.desc("decided_at"), F.desc("id")).limit(limit)


def quality_reports_of(reports: DataFrame, version_id: str | Column, order: list[str]) -> DataFrame:
    return reports.where(F.col("version_id") == version_id).orderBy(*order)


def serving_alias(promotions: DataFrame) -> DataFrame:
    """Per dataset, the version its last promotion or rollback made current."""
    return (
        promotions.where(F.col("decision").isin(PROMOTED, ROLLED_BACK))
        .groupBy("dataset")
        .agg(F.max_by("version_id", "id").alias("version_id"), F.max("id").alias("ledger_id"))
    )


def promoted_places(promotions: DataFrame) -> DataFrame:
    """Every version that was ever promoted, at its newest ledger place."""
    return (
        promotions.where(F.col("decision") == PROMOTED)
        .groupBy("dataset", "version_id")
        .agg(F.max("id").alias("ledger_id"))
    )


def promotion_history(promotions: DataFrame, limit: int = DEFAULTS.history_limit) -> DataFrame:
    """Per dataset, a list of its last promoted versions; the limit is the size of the list."""
    newest = Window.partitionBy("dataset").orderBy(F.desc("ledger_id"))
    places = promoted_places(promotions)
    return places.withColumn("position", F.row_number().over(newest)).where(
        F.col("position") <= limit
    )


def bare_version(dataset: Column, name: Column) -> Column:
    """Accept a version id or a collection name."""
    prefix = F.concat(dataset, F.lit("__"))
    return F.when(F.startswith(name, prefix), F.substr(name, F.length(prefix) + 1)).otherwise(name)


def previous_promoted(promotions: DataFrame, current: DataFrame) -> DataFrame:
    """Per dataset, the newest promoted version other than ``current (dataset, current)``."""
    exclude = current.select(
        "dataset", bare_version(F.col("dataset"), F.col("current")).alias("excluded")
    )
    return (
        promoted_places(promotions)
        .join(exclude, "dataset")
        .where(~F.col("version_id").eqNullSafe(F.col("excluded")))
        .groupBy("dataset")
        .agg(F.max_by("version_id", "ledger_id").alias("previous_version"))
    )


def rollback_targets(promotions: DataFrame, live: DataFrame) -> DataFrame:
    """Per dataset, where a rollback would lead: the newest version that was promoted before the
    current one and whose collection still exists.

    If the current version itself was never promoted, every other version counts as older.
    """
    places = promoted_places(promotions)
    current = serving_alias(promotions).select("dataset", F.col("version_id").alias("current_version"))
    of_current = places.select(
        "dataset", F.col("version_id").alias("current_version"), F.col("ledger_id").alias("_bound")
    )
    located = current.join(of_current, ["dataset", "current_version"], "left")
    targets = (
        places.join(live.select("dataset", "version_id"), ["dataset", "version_id"], "left_semi")
        .join(located, "dataset")
        .where(F.col("_bound").isNull() | (F.col("ledger_id") < F.col("_bound")))
        .where(F.col("version_id") != F.col("current_version"))
        .groupBy("dataset")
        .agg(F.max_by("version_id", "ledger_id").alias("target_version"))
    )
    return current.join(targets, "dataset", "left").withColumn(
        "decision",
        F.when(F.col("target_version").isNull(), ROLLBACK_FAILED).otherwise(ROLLED_BACK),
    )


def retention_drops(
    live: DataFrame, keep: DataFrame, promotions: DataFrame, retain: int = DEFAULTS.retain_versions
) -> DataFrame:
    """Collections beyond the retention window.

    ``keep (dataset, version_id)`` names what serves now and what served before. Of the other
    collections the last ``retain`` minus kept by promotion stay, older ones go; one that was never
    promoted counts as oldest.
    """
    kept = keep.where(F.col("version_id").isNotNull()).dropDuplicates(["dataset", "version_id"])
    candidates = live.join(kept, ["dataset", "version_id"], "left_anti").join(
        promoted_places(promotions), ["dataset", "version_id"], "left"
    )
    spare = kept.groupBy("dataset").agg((F.lit(retain) - F.count(F.lit(1))).alias("spare"))
    last = Window.partitionBy("dataset").orderBy(
        F.desc_nulls_last("ledger_id"), F.desc("version_id")
    )
    staying = (
        candidates.withColumn("place", F.row_number().over(last))
        .where(F.col("place") <= retain)
        .join(spare, "dataset", "left")
        .where(F.col("place") <= F.coalesce("spare", F.lit(retain)))
    )
    return candidates.join(staying, ["dataset", "version_id"], "left_anti").select(
        "dataset", "version_id"
    )


def decisions(verdicts: DataFrame, serving: DataFrame) -> DataFrame:
    """Ledger rows for ``verdicts (dataset, version_id, passed, failed_checks)``."""
    previous = serving.select("dataset", F.col("version_id").alias("from_target"))
    passed = F.col("passed")
    return verdicts.join(previous, "dataset", "left").select(
        "dataset",
        "version_id",
        F.when(passed, PROMOTED).otherwise(REJECTED).alias("decision"),
        "from_target",
        F.when(passed, F.col("version_id")).alias("to_target"),
        F.when(passed, F.lit(ALL_PASSED))
        .otherwise(F.concat(F.lit("failed gates: "), F.concat_ws(", ", "failed_checks")))
        .alias("reason"),
    )


def orphans(rows: DataFrame, versions: DataFrame) -> DataFrame:
    """Rows that refer to no registered version; none should exist."""
    return rows.join(versions, "version_id", "left_anti")


def version_detail(versions: DataFrame, reports: DataFrame, quarantine: DataFrame) -> DataFrame:
    """Versions with their checks and quarantined records, one row per item.

    The long form keeps a version with very many items spread over tasks. So does the
    inner join, whose hot keys Spark splits on either side; versions without items
    are added apart.
    """
    checks = reports.select(
        "version_id", F.lit("check").alias("kind"), F.col("check_name").alias("name"),
        "passed", "score",
    )
    failing = quarantine.select(
        "version_id", F.lit("quarantine").alias("kind"), F.col("reason").alias("name"),
        F.lit(None).cast("boolean").alias("passed"), F.lit(None).cast("double").alias("score"),
    )
    items = checks.unionAll(failing)
    listed = items.select("version_id").distinct()
    bare = versions.join(listed, "version_id", "left_anti")
    return versions.join(items, "version_id").unionByName(bare, allowMissingColumns=True)


def stuck(versions: DataFrame, before: Column) -> DataFrame:
    return versions.where(~F.col("status").isin(*TERMINAL_STATUSES) & (F.col("updated_at") < before))
