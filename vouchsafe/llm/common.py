"""Shared ground of the operators: materialised intermediates, row keys, Arrow helpers."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vouchsafe.session import checkpoint_root

#: Bytes of text that a numpy kernel handles at once; bounds its memory, not its result.
BLOCK_BYTES = 1 << 20


def shared_folder(spark: SparkSession, what: str) -> str:
    """A new folder below the checkpoint folder that all executors share."""
    return f"{checkpoint_root(spark)}/{what}-{uuid.uuid4().hex}"


def settle(df: DataFrame, what: str = "settled", compression: str = "snappy") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Later uses read the file instead of computing again, and a lost executor costs
    only its tasks: the table needs no lineage.
    """
    path = shared_folder(df.sparkSession, what)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def row_key(id_column: str = "doc_id", text_column: str = "text") -> Column:
    """A key of (id, text): rows that agree in both are the same document twice."""
    return F.unhex(
        F.md5(
            F.concat(
                F.coalesce(F.col(id_column).cast("string"), F.lit("-")),
                F.lit("\n"),
                text_or_empty(text_column),
            ).cast("binary")
        )
    )


def fresh_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, lengthened until no column of ``df`` has it (names ignore case)."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; null rows are empty."""
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or offsets[0] == offsets[-1]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def small_batches(
    batches: Iterator[pa.RecordBatch], text: str, limit: int = BLOCK_BYTES
) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``limit`` bytes of text; a longer text is alone."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        _, offsets = texts_of(column)
        start = 0
        while start < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1
            end = min(max(end, start + 1), batch.num_rows)
            yield batch.slice(start, end - start)
            start = end


def crc32_of(column: str) -> Column:
    return F.crc32(F.col(column).cast("string").cast("binary"))
