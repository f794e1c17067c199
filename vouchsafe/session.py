"""Session settings and lineage cutting."""

from __future__ import annotations

import tempfile
from collections.abc import Iterable
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

ROCKSDB_PROVIDER = (
    "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
)

# Settings that decide results, so every entry point applies them.
RESULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    # A repeated key in a JSON object keeps its last value.
    "spark.sql.variant.allowDuplicateKeys": "true",
}

# Bounds a task's memory, not its result: executor and Python worker each hold an Arrow batch several times
# over, outside the heap. A longer row is alone. A limit that the session already has is kept.
ARROW_BYTES_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"
ARROW_BYTES = 4 << 20


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the settings that results depend on to an existing session, and a bound on Arrow batches."""
    for key, value in RESULT_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    if spark.conf.get(ARROW_BYTES_KEY, None) is None:
        spark.conf.set(ARROW_BYTES_KEY, str(ARROW_BYTES))
    return spark


def build_session(
    app_name: str = "vouchsafe", master: str | None = None, **conf: str
) -> SparkSession:
    """A session for scripts and tests. On a cluster, sizes come from spark-submit."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.ui.enabled": "false",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.streaming.stateStore.providerClass": ROCKSDB_PROVIDER,
        **RESULT_CONF,
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for checkpoints, as the cluster configures it.

    Without a configured folder a temporary one is made, but only in local mode:
    on a cluster a machine-local folder would be lost together with its machine.
    """
    context = spark.sparkContext
    current = context._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        configured = tempfile.mkdtemp(prefix="vouchsafe-checkpoint-")
    context.setCheckpointDir(configured)
    return context._jsc.sc().getCheckpointDir().get()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and drop its history."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


def small_frame(spark: SparkSession, rows: Iterable[dict[str, Any]], schema: str) -> DataFrame:
    """A few driver-side rows as a local relation, which needs no job to read."""
    arrow = to_arrow_schema(T._parse_datatype_string(schema))
    return spark.createDataFrame(pa.Table.from_pylist(list(rows), arrow), schema)


# Inputs up to this size are spread over all cores before work that is heavy on CPU.
SMALL_INPUT_BYTES = 1 << 30


def spread(df: DataFrame) -> DataFrame:
    """Spread a small input over the cores; a large one has enough splits and is left alone.

    A small file is often one row group and so one task, whatever the cluster.
    """
    if df.isStreaming:
        return df
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    if int(str(size)) > SMALL_INPUT_BYTES:
        return df
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)
