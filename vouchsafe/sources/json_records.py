"""JSON and JSON-lines payloads as record tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vouchsafe.functions.identifiers import is_identifier
from vouchsafe.functions.records import redump_json, strict_json
from vouchsafe.functions.text import is_blank, strip
from vouchsafe.functions.hashing import KEY_HASH, short_sha256

# The ways a payload can be refused.
EMPTY = "payload is empty"
NO_CONTAINER = "top-level JSON must be an object or array"
BAD_LINE = "invalid JSON on line "

LINE_END = r"\r\n|[\n\r\x0B\x0C\x1C\x1D\x1E\x{0085}\x{2028}\x{2029}]"


def read_payloads(spark: SparkSession, *paths: str) -> DataFrame:
    """Whole files as rows ``(path, content)``. Uploads are limited in size, so a file fits a row."""
    return spark.read.text(list(paths), wholetext=True).select(
        F.col("_metadata.file_path").alias("path"), F.col("value").alias("content")
    )


def parse_payloads(payloads: DataFrame, content: str = "content") -> DataFrame:
    """Add ``records ARRAY<VARIANT>`` and ``error`` to payload rows.

    The whole text is tried as one JSON document: a list gives its elements, an
    object itself. Only where that fails, every non-blank line is a document. One
    bad line refuses the payload.
    """
    lines = F.split(F.col("_text"), LINE_END)
    parsed = (
        payloads.withColumn("_text", strip(F.col(content)))
        .withColumn("_doc", strict_json(F.col("_text")))
        .withColumn("_kind", F.schema_of_variant("_doc"))
        .withColumn(
            "_lines",
            F.when(
                F.col("_doc").isNull() & (F.col("_text") != ""),
                F.filter(
                    F.transform(
                        lines,
                        lambda line, i: F.struct(
                            (i + 1).alias("number"), line.alias("line"),
                            strict_json(line).alias("doc"),
                        ),
                    ),
                    lambda entry: ~is_blank(entry["line"]),
                ),
            ),
        )
    )
    bad = F.filter(F.col("_lines"), lambda entry: entry["doc"].isNull())
    error = (
        F.when(F.coalesce(F.col("_text"), F.lit("")) == "", EMPTY)
        .when(
            F.col("_doc").isNotNull() & ~F.col("_kind").rlike("^(ARRAY|OBJECT)"), NO_CONTAINER
        )
        .when(F.size(bad) > 0, F.concat(F.lit(BAD_LINE), bad[0]["number"].cast("string")))
    )
    records = (
        F.when(
            F.col("_kind").startswith("ARRAY"), F.try_variant_get("_doc", "$", "array<variant>")
        )
        .when(F.col("_doc").isNotNull(), F.array("_doc"))
        .otherwise(F.transform(F.col("_lines"), lambda entry: entry["doc"]))
    )
    return (
        parsed.withColumn("error", error)
        .withColumn("records", F.when(F.col("error").isNull(), records))
        .drop("_text", "_doc", "_kind", "_lines")
    )


def records_of(parsed: DataFrame, keep: list[str]) -> DataFrame:
    """One row per record: the kept columns, ``_pos`` within the payload, ``rec``."""
    return parsed.where(F.col("error").isNull()).select(
        *keep, F.posexplode("records").alias("_pos", "rec")
    ).withColumn("_pos", F.col("_pos").cast("bigint"))


def rejects_of(parsed: DataFrame, keep: list[str]) -> DataFrame:
    return parsed.where(F.col("error").isNotNull()).select(*keep, "error")


def read_json_records(spark: SparkSession, *paths: str) -> tuple[DataFrame, DataFrame]:
    """Records ``(path, _pos, rec)`` and refused files ``(path, error)``."""
    parsed = parse_payloads(read_payloads(spark, *paths))
    return records_of(parsed, ["path"]), rejects_of(parsed, ["path"])


def first_bad_line(spark: SparkSession, *paths: str) -> int | None:
    """The number of the first line that is no JSON value, in the first file that has one."""
    lines = spark.read.text(list(paths)).select(
        F.struct(
            F.col("_metadata.file_path").alias("path"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("pos"),
        ).alias("at"),
        F.col("value"),
    )
    wrong = ~is_blank(F.col("value")) & strict_json(F.col("value")).isNull()
    bad = lines.where(wrong).agg(F.min("at").alias("at")).first()["at"]
    if bad is None:
        return None
    up_to = (F.col("at.path") == bad["path"]) & (
        (F.col("at.block") < bad["block"])
        | ((F.col("at.block") == bad["block"]) & (F.col("at.pos") <= bad["pos"]))
    )
    return lines.where(up_to).count()


def read_json_lines(spark: SparkSession, *paths: str) -> DataFrame:
    """Large JSON-lines files, read in splits: ``(path, _block, _pos, rec)``.

    Order within a file is that of ``(_block, _pos)``; positions have gaps. A bad line
    has no ``rec``.
    """
    lines = spark.read.text(list(paths)).select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_pos"),
        F.col("value"),
    )
    return lines.where(~is_blank(F.col("value"))).select(
        "path", "_block", "_pos", strict_json(F.col("value")).alias("rec")
    )


def parse_envelopes(envelopes: DataFrame, body: str = "body") -> DataFrame:
    """Webhook envelopes ``{dataset, records, pipeline}`` taken apart and judged.

    Adds ``dataset, pipeline, records, record_count, content_hash, error``. The hash is
    over the records as re-serialised JSON.
    """
    doc = F.col("_doc")
    opened = (
        envelopes.withColumn("_doc", strict_json(F.col(body)))
        .withColumn("dataset", F.try_variant_get(doc, "$.dataset", "string"))
        .withColumn(
            "pipeline",
            F.coalesce(F.try_variant_get(doc, "$.pipeline", "string"), F.lit("generic")),
        )
        .withColumn("records", F.try_variant_get(doc, "$.records", "array<variant>"))
    )
    objects_only = F.forall("records", lambda r: F.schema_of_variant(r).startswith("OBJECT"))
    error = (
        F.when(doc.isNull(), "body is not valid JSON")
        .when(~is_identifier(F.col("dataset")), "invalid dataset")
        .when(F.coalesce(F.size("records"), F.lit(0)) < 1, "no records")
        .when(~objects_only, "records must be objects")
    )
    judged = opened.withColumn("error", error)
    accepted: Column = F.col("error").isNull()
    texts = F.when(accepted, F.get_json_object(F.col(body), "$.records"))
    return (
        judged.withColumn("record_count", F.when(accepted, F.size("records")).cast("bigint"))
        .withColumn("content_hash", short_sha256(redump_json(texts), KEY_HASH))
        .withColumn("records", F.when(accepted, F.col("records")))
        .drop("_doc")
    )
