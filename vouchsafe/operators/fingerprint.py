"""Schema fingerprints and drift."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vouchsafe.functions.hashing import short_sha256
from vouchsafe.functions.records import TypedField, is_object, json_literal, variant_type_name

FIRST_INGEST = "no previous version (first ingest)"
CHANGED = "schema fingerprint changed"
STABLE = "schema stable"


def _hash_of_fields(fields: DataFrame) -> DataFrame:
    """One row: the hash of the sorted ``{"key": "type"}`` object.

    ``fields`` holds ``key``, the key as a JSON literal, and ``type``.
    """
    entry = F.struct("key", F.concat("literal", F.lit(': "'), "type", F.lit('"')).alias("text"))
    entries = F.array_sort(F.collect_list(entry))
    joined = F.concat_ws(", ", F.transform(entries, lambda e: e["text"]))
    text = F.concat(F.lit("{"), joined, F.lit("}"))
    return fields.agg(short_sha256(text).alias("schema_hash"))


def observed_fields(
    df: DataFrame, order: list[str], record: str, ignore_nulls: bool = False,
    leading: int | None = None,
) -> DataFrame:
    """First seen type of each key, in input order; with ``leading`` among so many first records.

    Records that are no objects take a place among the leading ones but have no keys.
    """
    seen = df.select(*order, record)
    if leading is not None:
        seen = seen.orderBy(*order).limit(leading)
    place = F.struct(*order)
    entries = (
        seen.where(is_object(F.col(record)))
        .select(place.alias("place"), F.col(record).alias("r"))
        .lateralJoin(_variant_entries(df.sparkSession))
        .select("place", "key", variant_type_name(F.col("value")).alias("type"))
    )
    if ignore_nulls:
        entries = entries.where(F.col("type") != "NoneType")
    return entries.groupBy("key").agg(F.min_by("type", "place").alias("type"))


def _variant_entries(spark) -> DataFrame:
    return spark.tvf.variant_explode(F.col("r").outer()).select("key", "value")


def schema_fingerprint(
    df: DataFrame, order: list[str], record: str, ignore_nulls: bool = False,
    leading: int | None = None,
) -> DataFrame:
    """One row ``schema_hash`` for JSON records held as VARIANT."""
    fields = observed_fields(df, order, record, ignore_nulls, leading)
    return _hash_of_fields(fields.withColumn("literal", json_literal("key")))


def typed_schema_hash(schema: T.StructType, ignore_nulls: bool = False) -> Column:
    """The hash of a typed table as an aggregate, so that it joins other aggregates in one pass.

    A column has its declared type as soon as one row fills it.
    """
    parts = []
    for name in sorted(n for n in schema.names if not n.startswith("_")):
        field = TypedField(schema, name)
        filled = F.coalesce(F.bool_or(field.present), F.lit(False))
        text = F.lit(f"{json.dumps(name)}: \"{field.kind}\"")
        absent = None if ignore_nulls else f"{json.dumps(name)}: \"NoneType\""
        parts.append(F.when(filled, text).otherwise(F.lit(absent)))
    return short_sha256(F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}")))


def typed_schema_fingerprint(df: DataFrame, ignore_nulls: bool = False) -> DataFrame:
    """One row ``schema_hash`` for a typed table."""
    return df.agg(typed_schema_hash(df.schema, ignore_nulls).alias("schema_hash"))


def has_drifted(previous: Column, current: Column) -> Column:
    return F.coalesce(previous != current, F.lit(False))


def drift_reason(previous: Column, current: Column) -> Column:
    return (
        F.when(previous.isNull(), FIRST_INGEST).when(previous != current, CHANGED).otherwise(STABLE)
    )


def detect_drift(
    df: DataFrame, previous: str = "previous_hash", current: str = "current_hash"
) -> DataFrame:
    """Add ``drifted`` and ``reason`` to rows that hold a baseline hash and a current hash."""
    before, now = F.col(previous), F.col(current)
    return df.withColumn("drifted", has_drifted(before, now)).withColumn(
        "reason", drift_reason(before, now)
    )


def last_promoted_hash(versions: DataFrame) -> DataFrame:
    """Per dataset, the schema hash of the most recently updated promoted version."""
    return (
        versions.where(F.col("status") == "promoted")
        .groupBy("dataset")
        .agg(F.max_by("schema_hash", F.struct("updated_at", "version_id")).alias("schema_hash"))
    )
