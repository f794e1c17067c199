"""Token ids in training order: a keyed permutation gives every sequence its slot.

Documents are cut into sequences of at most ``length`` ids. Every sequence gets a dense number, and a
keyed Feistel network with cycle-walking maps the numbers 0..n-1 one to one onto the slots 0..n-1:
the order of a training run, drawn without sorting by a random key and reproducible from the key.
A shard is ``per_shard`` slots. A file holds a range of whole shards in slot order, so which file a slot goes to
follows from the slot alone, and nothing is sampled. Each sequence has the same stride, ``length`` ids of ``dtype``
padded with ``pad``; the true lengths are in the index. Readers go through files in order, or to any range of
slots: row groups that hold none of it are skipped by their statistics.

Null texts hold the end id alone. Repeated rows are written once each. No documents, no shards. Ids that do not fit
``dtype`` are refused. Extra columns are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vouchsafe.llm.common import settle, texts_of
from vouchsafe.session import small_frame
from vouchsafe.llm.packing import pieces
from vouchsafe.llm.words import mix

LENGTH = 1024
PER_SHARD = 4096
PAD = 0
SHARDS_PER_FILE = 4
#: Bytes of a row group: what a reader of a few slots unpacks.
ROW_GROUP = 4 << 20
ROUNDS = 6
#: Sequences that a task pads at once.
BLOCK = 2048
ORDER = "key bigint, sequences bigint, length bigint, stride bigint, dtype string, per_shard bigint"


def feistel(numbers: np.ndarray, n: int, key: int, rounds: int = ROUNDS) -> np.ndarray:
    """A keyed permutation of 0..n-1, applied to ``numbers``.

    The network permutes 0..4**h-1, the least such range that holds n; a result outside 0..n-1 is
    mapped again until it is inside. As the range is less than 4n, that takes few rounds.
    """
    half = np.uint64(max(1, ((n - 1).bit_length() + 1) // 2))
    mask = np.uint64((1 << int(half)) - 1)
    keys = mix(np.uint64(key % (1 << 64)) + np.arange(1, rounds + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    out = numbers.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> half, out[todo] & mask
        for k in keys:
            left, right = right, left ^ (mix(right ^ k) & mask)
        out[todo] = (left << half) | right
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def unfeistel(slots: np.ndarray, n: int, key: int, rounds: int = ROUNDS) -> np.ndarray:
    """The numbers that ``feistel`` maps to these slots."""
    half = np.uint64(max(1, ((n - 1).bit_length() + 1) // 2))
    mask = np.uint64((1 << int(half)) - 1)
    keys = mix(np.uint64(key % (1 << 64)) + np.arange(1, rounds + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    out = slots.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> half, out[todo] & mask
        for k in keys[::-1]:
            left, right = right ^ (mix(left ^ k) & mask), left
        out[todo] = (left << half) | right
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def numbered(cut: DataFrame) -> tuple[DataFrame, int]:
    """Settled ``pieces`` with the first number of their task, and how many there are.

    A task's pieces are numbered by its own counter; running sums over the tasks' counts make
    the numbers dense. One row for each task takes part, never the pieces.
    """
    of_task = cut.groupBy("_task").agg(F.count("*").alias("_n"))
    group = F.floor(F.col("_task") / 1024)
    before = Window.partitionBy("_group").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    # sums of 1024 tasks each first, so no task sees more than that and the list of groups
    of_group = {r[0]: r[1] for r in of_task.groupBy(group.alias("g")).agg(F.sum("_n")).collect()}
    spark = cut.sparkSession
    total, rows = 0, []
    for g in sorted(of_group):
        rows.append((g, total))
        total += of_group[g]
    starts = spark.createDataFrame(rows or [(0, 0)], "_group bigint, _start bigint")
    firsts = (
        of_task.withColumn("_group", group)
        .select("_task", "_group", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_in"))
        .join(starts, "_group").select("_task", (F.col("_start") + F.col("_in")).alias("_first"))
    )
    # Two numbers for each task of one stage: far less than the driver itself keeps of a task.
    return cut.join(F.broadcast(firsts), "_task"), total


def write_shards(
    docs: DataFrame, path: str, key: int = 0, length: int = LENGTH, per_shard: int = PER_SHARD,
    id_column: str = "doc_id", text_column: str = "text", dtype: str = "<u2", pad: int = PAD,
    shards_per_file: int = SHARDS_PER_FILE,
) -> DataFrame:
    """Write the shards below ``path`` and return the index.

    ``path``/shards: the index (slot, shard, position, id, piece, start, length, ids_crc32) with ``payload``, the
    sequence in its stride. ``path``/order: one row with what a reader must know.
    """
    spark = docs.sparkSession
    cut = pieces(docs, id_column, text_column, capacity=length).select(
        id_column, "piece", "start", "length", "ids_crc32", "ids", F.monotonically_increasing_id().alias("_made")
    )
    # The upper bits name the task that made a row, the lower 33 count its rows.
    made = settle(cut, "sequences", "zstd").select(
        "*", F.shiftright("_made", 33).alias("_task"), (F.col("_made").bitwiseAND(2**33 - 1)).alias("_serial")
    )
    table, total = numbered(made)
    stride, narrow = length * np.dtype(dtype).itemsize, np.dtype(dtype)
    most = np.iinfo(narrow).max
    columns = [id_column, "piece", "start", "length", "ids_crc32"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(begin, BLOCK)
                slot = feistel(batch.column("_first").to_numpy() + batch.column("_serial").to_numpy(), total, key)
                data, offsets = texts_of(batch.column("ids"))
                ids = data.view("<u4")
                if len(ids) and ids.max() > most:
                    raise ValueError(f"ids up to {ids.max()} do not fit {dtype}")
                padded = np.full((len(slot), length), pad, narrow)
                padded[np.arange(length) < (np.diff(offsets) // 4)[:, None]] = ids
                ends = pa.array(np.arange(len(slot) + 1, dtype=np.int32) * stride).buffers()[1]
                payload = pa.Array.from_buffers(pa.binary(), len(slot), [None, ends, pa.py_buffer(padded)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(slot), *(batch.column(c) for c in columns), payload], ["slot", *columns, "payload"]
                )

    id_type = made.schema[id_column].dataType.simpleString()
    schema = f"slot bigint, `{id_column}` {id_type}, piece int, start bigint, length bigint, ids_crc32 bigint, payload binary"
    files = max(1, -(-total // (per_shard * shards_per_file)))
    (
        table.mapInArrow(place, schema)
        .withColumns({"shard": F.floor(F.col("slot") / per_shard), "position": F.col("slot") % per_shard})
        .repartitionById(files, F.floor(F.col("slot") / (per_shard * shards_per_file)).cast("int"))
        .sortWithinPartitions("slot")
        .write.option("compression", "zstd").option("parquet.block.size", ROW_GROUP).parquet(f"{path}/shards")
    )
    order = {"key": key, "sequences": total, "length": length, "stride": stride, "dtype": dtype, "per_shard": per_shard}
    small_frame(spark, [order], ORDER).write.parquet(f"{path}/order")
    return spark.read.parquet(f"{path}/shards").select("slot", "shard", "position", *columns)


def read_slots(spark: SparkSession, path: str, start: int, stop: int) -> DataFrame:
    """The sequences of the slots start..stop-1: (slot, payload); only their row groups are read."""
    shards = spark.read.parquet(f"{path}/shards")
    return shards.where((F.col("slot") >= start) & (F.col("slot") < stop)).select("slot", "payload")
