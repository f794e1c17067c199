"""Files that arrive in the raw zone start versions."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vouchsafe.functions.hashing import KEY_HASH
from vouchsafe.functions.identifiers import is_identifier
from vouchsafe.plans.lifecycle import GovernancePlane
from vouchsafe.session import small_frame

DATASETS_AT_ONCE = 4
_LISTED = "path STRING, modificationTime TIMESTAMP, length BIGINT, content BINARY"


def arrivals(plane: GovernancePlane, files_per_batch: int) -> DataFrame:
    """New raw objects as ``(dataset, path, content_hash)``; the folder names the dataset."""
    files = (
        plane.spark.readStream.format("binaryFile")
        .schema(_LISTED)
        .option("maxFilesPerTrigger", files_per_batch)
        .option("recursiveFileLookup", "true")
        .load(plane.zones.path("raw"))
    )
    dataset = F.element_at(F.split("path", "/"), -2)
    return files.select(
        dataset.alias("dataset"),
        "path",
        F.substring(F.sha2("content", 256), 1, KEY_HASH).alias("content_hash"),
    ).where(is_identifier(F.col("dataset")))


def run_on_arrival(
    plane: GovernancePlane, checkpoint: str, files_per_batch: int | None = None
) -> StreamingQuery:
    """Publish every file that has arrived, then stop.

    A version is named after its content, so a batch that is replayed finds its own
    finished snapshots and ledger row, and a file that arrives twice makes one version.
    """
    limit = files_per_batch or plane.settings.relay_batch_size

    def run_in_turn(rows: list) -> None:
        """A dataset's files in the order of their names."""
        for row in rows:
            version_id = f"{row['dataset']}-{row['content_hash']}"
            try:
                plane.run_file(row["dataset"], row["path"], "event", version_id)
            except ValueError as refused:
                plane.zones.write_artifact(
                    version_id,
                    "refused",
                    small_frame(
                        plane.spark,
                        [{"path": row["path"], "error": str(refused)}],
                        "path STRING, error STRING",
                    ),
                )

    def publish(batch: DataFrame, batch_id: int) -> None:
        # At most ``limit`` short rows; the content stays where it is.
        of_dataset: dict[str, list] = {}
        for row in batch.orderBy("path").collect():
            of_dataset.setdefault(row["dataset"], []).append(row)
        with ThreadPoolExecutor(DATASETS_AT_ONCE) as pool:
            list(pool.map(run_in_turn, of_dataset.values()))

    return (
        arrivals(plane, limit)
        .writeStream.foreachBatch(publish)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
