"""Running a stream over what has arrived."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.readwriter import DataStreamWriter

_EMPTY_BATCHES = "spark.sql.streaming.noDataMicroBatches.enabled"


def drain(spark: SparkSession, writer: DataStreamWriter) -> StreamingQuery:
    """Process all available data, then stop.

    State with a processing-time lifetime asks for one more batch for ever, so this
    query runs no batches without data; expired state goes with the next data.
    """
    before = spark.conf.get(_EMPTY_BATCHES)
    spark.conf.set(_EMPTY_BATCHES, "false")
    try:
        query = writer.trigger(availableNow=True).start()
        query.awaitTermination()
        return query
    finally:
        spark.conf.set(_EMPTY_BATCHES, before)
