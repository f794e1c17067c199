"""Enrichment: normalised text, first-wins deduplication, search text, lineage metadata, profile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vouchsafe.functions import text as X
from vouchsafe.functions.hashing import SHORT_HASH, content_digest, variant_content_digest
from vouchsafe.functions.records import TypedField
from vouchsafe.operators.contracts import field_reader

DEDUP_KEY = "_dedup_key"
DIGEST = "_digest"


def dedup_key(key: Column, digest: Column) -> Column:
    """The key as a string, or the content digest where the key is missing or empty.

    The digest enters in full: a short hash would collide among very many records.
    """
    return F.coalesce(F.nullif(key.cast("string"), F.lit("")), digest)


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Per key, the first row in input order.

    The filter on the row number lets Spark cut each map task's rows to one per key
    before the shuffle, so a hot key sends one row per task.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(window)).where("_rn = 1").drop("_rn")


def dedup_counts(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row: input, output and removed records. Counts are combined before the shuffle."""
    return (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("copies"))
        .agg(
            F.coalesce(F.sum("copies"), F.lit(0)).alias("input_records"),
            F.count(F.lit(1)).alias("output_records"),
            F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("duplicates_removed"),
        )
    )


def lineage(
    version_id: Column, digest: Column, text: Column, field_count: Column, at: Column
) -> Column:
    return F.struct(
        version_id.alias("version_id"),
        F.substring(digest, 1, SHORT_HASH).alias("content_hash"),
        F.char_length(text).cast("bigint").alias("text_length"),
        field_count.cast("bigint").alias("field_count"),
        at.alias("enriched_at"),
    )


def enrich_table(
    df: DataFrame,
    version_id: str,
    run_at: Column,
    key: str,
    order: list[str],
    text_fields: tuple[str, ...] = X.TEXT_FIELDS,
) -> DataFrame:
    """Enrich a typed table. Hashes and field counts are those of the original record."""
    original = [name for name in df.columns if not name.startswith("_")]
    texts = [name for name in text_fields if name in df.columns]
    hashed = df.withColumn(DIGEST, content_digest(original))
    keyed = hashed.withColumn(DEDUP_KEY, dedup_key(F.col(key), F.col(DIGEST)))
    first = keep_first(keyed, [DEDUP_KEY], order).drop(DEDUP_KEY)
    clean = first.withColumns({name: X.normalize(F.col(name)) for name in texts})
    parts = [F.col(name).cast("string") for name in texts]
    return (
        clean.withColumn("_search_text", X.search_text(parts) if parts else F.lit(""))
        .withColumn(
            "_meta",
            lineage(
                F.lit(version_id),
                F.col(DIGEST),
                F.col("_search_text"),
                F.lit(len(original)),
                run_at,
            ),
        )
        .drop(DIGEST)
    )


def _display(value) -> Column:
    """A text field as it enters the search text: strings as they are, other values unless empty or zero."""
    return (
        F.when(value.type_name == "str", value.text)
        .when(value.type_name == "bool", F.when(value.number == 1, "True"))
        .when(value.type_name.isin("int", "float"), F.when(value.number != 0, value.as_string))
        .when(value.type_name.isin("list", "dict"), F.nullif(F.nullif(value.as_string, F.lit("[]")), F.lit("{}")))
    )


def enrich_records(
    df: DataFrame,
    version_id: str,
    run_at: Column,
    key: str = "id",
    order: list[str] | None = None,
    record: str = "rec",
    text_fields: tuple[str, ...] = X.TEXT_FIELDS,
) -> DataFrame:
    """Enrich JSON records. ``_texts`` holds the normalised text fields that a record has."""
    read = field_reader(df, record)
    hashed = df.withColumn(DIGEST, variant_content_digest(F.col(record)))
    keyed = hashed.withColumn(DEDUP_KEY, dedup_key(read(key).as_string, F.col(DIGEST)))
    first = keep_first(keyed, [DEDUP_KEY], order or ["_pos"]).drop(DEDUP_KEY)
    raw = first.withColumns({f"_raw_{n}": _display(read(n)) for n in text_fields})
    clean = raw.withColumns(
        {
            f"_raw_{n}": F.when(read(n).type_name == "str", X.normalize(F.col(f"_raw_{n}")))
            .otherwise(F.col(f"_raw_{n}"))
            for n in text_fields
        }
    )
    texts = F.struct(*[F.col(f"_raw_{n}").alias(n) for n in text_fields])
    field_count = F.size(F.map_keys(F.try_variant_get(F.col(record), "$", "map<string,variant>")))
    return (
        clean.withColumn("_texts", texts)
        .withColumn("_search_text", X.search_text([F.col(f"_raw_{n}") for n in text_fields]))
        .withColumn(
            "_meta",
            lineage(
                F.lit(version_id), F.col(DIGEST), F.col("_search_text"), field_count, run_at
            ),
        )
        .drop(DIGEST, *[f"_raw_{n}" for n in text_fields])
    )


def fill_rates(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Per column of a typed table, the share of rows that fill it, in one pass.

    Columns that no row fills are left out, and so is everything for an empty table.
    """
    schema = df.schema
    names = columns or [name for name in schema.names if not name.startswith("_")]
    total = df.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(TypedField(schema, n).filled).alias(f"f{i}") for i, n in enumerate(names)],
    )
    pairs = F.array(
        *[
            F.struct(F.lit(n).alias("field"), F.col(f"f{i}").alias("filled"), F.col("n").alias("n"))
            for i, n in enumerate(names)
        ]
    )
    return _rates(total.select(F.inline(pairs)))


def variant_fill_rates(df: DataFrame, record: str = "rec") -> DataFrame:
    """Per observed key of JSON records, the share of all records that fill it."""
    entries = df.select(F.col(record).alias("r")).lateralJoin(
        df.sparkSession.tvf.variant_explode(F.col("r").outer()).select("key", "value")
    )
    value = F.col("value")
    kind = F.schema_of_variant(value)
    empty = (
        (kind == "VOID")
        | ((kind == "STRING") & (F.try_variant_get(value, "$", "string") == ""))
        | (kind.startswith("ARRAY") & (F.to_json(value) == "[]"))
    )
    filled = (
        entries.where(~empty).groupBy(F.col("key").alias("field")).agg(F.count(F.lit(1)).alias("filled"))
    )
    total = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    return _rates(filled.withColumn("n", total))


def _rates(counts: DataFrame) -> DataFrame:
    return counts.where("filled > 0").select(
        "field", F.round(F.col("filled") / F.col("n"), 3).alias("fill_rate")
    )

