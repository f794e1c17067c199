"""Landing of raw uploads: the manifest says what each file is and whether it is taken."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vouchsafe.functions.hashing import KEY_HASH
from vouchsafe.functions.identifiers import is_identifier, safe_object_key
from vouchsafe.settings import Settings
from vouchsafe.sources.json_records import parse_payloads

# The ways an upload can be refused.
BAD_DATASET = "invalid dataset"
BAD_SUFFIX = "only .json / .jsonl files are accepted"
NOT_UTF8 = "file is not valid UTF-8 text"
BAD_JSON = "invalid JSON payload: "


def too_large(max_bytes: int) -> str:
    mega = 1024 * 1024
    shown = f"{max_bytes // mega}MB" if max_bytes % mega == 0 else f"{max_bytes} byte"
    return f"file exceeds {shown} limit"


def read_uploads(
    spark: SparkSession, *paths: str, max_bytes: int = Settings().max_upload_bytes
) -> DataFrame:
    """Raw files as ``(dataset, file_name, content, size, path, modified)``; the folder names the dataset.

    The content of a file beyond the limit is not read: its row has the size alone.
    """
    files = spark.read.format("binaryFile").load(list(paths))
    nothing = F.lit(None).cast("binary")
    # the reader skips the content of files that the filter on their length drops
    rows = files.where(F.col("length") <= max_bytes).unionByName(
        files.where(F.col("length") > max_bytes).withColumn("content", nothing)
    )
    parts = F.split("path", "/")
    return rows.select(
        F.element_at(parts, -2).alias("dataset"),
        F.element_at(parts, -1).alias("file_name"),
        "content",
        F.col("length").alias("size"),
        "path",
        F.col("modificationTime").alias("modified"),
    )


def landing_manifest(uploads: DataFrame, max_bytes: int = Settings().max_upload_bytes) -> DataFrame:
    """Judge uploads ``(dataset, file_name, content BINARY[, size])`` and name their objects."""
    size = F.col("size") if "size" in uploads.columns else F.octet_length("content")
    is_text = F.is_valid_utf8(F.col("content").cast("string"))
    sized = (
        uploads.withColumn("size", size.cast("bigint"))
        .withColumn("content_hash", F.substring(F.sha2("content", 256), 1, KEY_HASH))
        .withColumn(
            "object_key",
            F.concat_ws("-", "content_hash", safe_object_key(F.col("file_name"))),
        )
        .withColumn(
            "_refused",
            F.when(~is_identifier(F.col("dataset")), BAD_DATASET)
            .when(~F.coalesce(F.col("file_name").rlike(r"\.jsonl?\z"), F.lit(False)), BAD_SUFFIX)
            .when(F.col("size") > max_bytes, too_large(max_bytes))
            .when(~is_text, NOT_UTF8),
        )
        # Only what is still acceptable is parsed.
        .withColumn("_text", F.when(F.col("_refused").isNull(), F.col("content").cast("string")))
    )
    parsed = parse_payloads(sized, "_text")
    reason = F.coalesce("_refused", F.concat(F.lit(BAD_JSON), F.col("error")))
    return (
        parsed.withColumn("reject_reason", reason)
        .withColumn("accepted", F.col("reject_reason").isNull())
        .withColumn("record_count", F.when(F.col("accepted"), F.size("records")).cast("bigint"))
        .drop("_refused", "_text", "error", "records", "content")
    )


def latest_per_group(files: DataFrame, by: list[str], path: str, modified: str) -> DataFrame:
    """Per group the most recently modified path; equal times go to the greater path."""
    return files.groupBy(*by).agg(F.max_by(path, F.struct(modified, path)).alias(path))


def list_objects(spark: SparkSession, prefix: str) -> DataFrame:
    """Files below a prefix, without reading their content."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(prefix)
        .select("path", F.col("modificationTime").alias("modified"), "length")
    )
