"""The data zones: raw uploads, staged snapshots, quarantine, collections, artifacts, registry tables.

All paths go through Hadoop's file system API, so a base folder may be local, HDFS
or an object store.
"""

from __future__ import annotations

import json
import threading
import uuid
from collections import defaultdict
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vouchsafe import model
from vouchsafe.session import small_frame
from vouchsafe.sources.commits import CommitLog

_LOCKS: dict[str, threading.RLock] = defaultdict(threading.RLock)


@dataclass
class Zones:
    spark: SparkSession
    base: str
    _logs: dict[str, CommitLog] = field(default_factory=dict)

    @property
    def lock(self) -> threading.RLock:
        """Planes on a base folder in one driver take turns, which saves attempts; commits are safe without."""
        return _LOCKS[self.base.rstrip("/")]

    # ------------------------------------------------------------ files

    def path(self, *parts: str) -> str:
        return "/".join((self.base.rstrip("/"), *parts))

    def _file_system(self, path: str):
        jvm = self.spark._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark._jsc.hadoopConfiguration()), target

    def exists(self, path: str) -> bool:
        system, target = self._file_system(path)
        return system.exists(target)

    def delete(self, path: str) -> bool:
        system, target = self._file_system(path)
        return system.delete(target, True)

    def folders(self, path: str) -> list[str]:
        """Names of the folders directly below a path."""
        system, target = self._file_system(path)
        if not system.exists(target):
            return []
        return sorted(s.getPath().getName() for s in system.listStatus(target) if s.isDirectory())

    def files(self, path: str) -> list[str]:
        """Names of the files directly below a path."""
        system, target = self._file_system(path)
        return sorted(s.getPath().getName() for s in system.listStatus(target) if s.isFile())

    def make_folder(self, path: str) -> None:
        system, target = self._file_system(path)
        system.mkdirs(target)

    # ------------------------------------------------------------ staged snapshots

    def spill(self, df: DataFrame, *parts: str) -> DataFrame:
        """``df``, written once below a folder of the zones and read back."""
        path = self.path(*parts, uuid.uuid4().hex)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def snapshot(self, version_id: str, stage: str, make: Callable[[], DataFrame]) -> DataFrame:
        """The output of a stage, written once. A finished one is read, an unfinished one redone."""
        path = self.path("staged", version_id, stage)
        if not self.exists(f"{path}/_SUCCESS"):
            make().write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)

    # ------------------------------------------------------------ quarantine

    def write_quarantine(self, version_id: str, rows: DataFrame) -> None:
        path = self.path("quarantine", f"version_id={version_id}")
        if not self.exists(f"{path}/_SUCCESS"):
            rows.drop("version_id").write.mode("overwrite").parquet(path)

    def quarantine(self) -> DataFrame:
        return self._read(self.path("quarantine"), model.QUARANTINE)

    # ------------------------------------------------------------ collections

    def collection_path(self, dataset: str, version_id: str) -> str:
        return self.path("collections", f"dataset={dataset}", f"version_id={version_id}")

    def write_collection(self, dataset: str, version_id: str, points: DataFrame) -> None:
        path = self.collection_path(dataset, version_id)
        if not self.exists(f"{path}/_SUCCESS"):
            points.write.mode("overwrite").parquet(path)

    def collection(self, dataset: str, version_id: str) -> DataFrame:
        return self.spark.read.parquet(self.collection_path(dataset, version_id))

    def drop_collection(self, dataset: str, version_id: str) -> bool:
        return self.delete(self.collection_path(dataset, version_id))

    def live_collections(self, dataset: str | None = None) -> DataFrame:
        """Collections that exist, as ``(dataset, version_id)``: a listing of folders."""
        datasets = [f"dataset={dataset}"] if dataset else self.folders(self.path("collections"))
        rows = [
            {"dataset": d.split("=", 1)[1], "version_id": v.split("=", 1)[1]}
            for d in datasets
            for v in self.folders(self.path("collections", d))
        ]
        return small_frame(self.spark, rows, "dataset STRING, version_id STRING")

    # ------------------------------------------------------------ artifacts

    def write_artifact(self, version_id: str, name: str, report: DataFrame) -> None:
        report.coalesce(1).write.mode("overwrite").json(
            self.path("artifacts", version_id, f"name={name}")
        )

    def write_reports(self, version_id: str, reports: dict[str, dict[str, Any]]) -> None:
        """Several JSON reports in one job, each in its own folder."""
        rows = [{"name": name, "report": as_json(report)} for name, report in reports.items()]
        frame = small_frame(self.spark, rows, "name STRING, report STRING")
        frame.coalesce(1).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic"
        ).partitionBy("name").text(self.path("artifacts", version_id))

    def read_artifact(self, version_id: str, name: str) -> DataFrame:
        return self.spark.read.json(self.path("artifacts", version_id, f"name={name}"))

    # ------------------------------------------------------------ registry tables

    def _read(self, path: str, schema: str) -> DataFrame:
        if not self.exists(path):
            return small_frame(self.spark, [], schema)
        return self.spark.read.schema(schema).parquet(path)

    def log(self, name: str) -> CommitLog:
        if name not in self._logs:
            ids = REGISTRY[name].split()[0]  # a registry table's id is its first column
            self._logs[name] = CommitLog(self.spark, self.path("registry", name), REGISTRY[name], ids)
        return self._logs[name]

    def table(self, name: str) -> DataFrame:
        return self.log(name).rows()

    def append(self, name: str, rows: Iterable[dict[str, Any]] | Callable[[], list[dict[str, Any]]]) -> list[dict[str, Any]]:
        """Commit a few rows, or those that a function makes of the present tables; see ``CommitLog.append``."""
        return self.log(name).append(rows)


# The registry tables and their schemas.
REGISTRY = {
    "dataset_versions": model.DATASET_VERSIONS,
    "transitions": model.TRANSITIONS,
    "quality_reports": model.QUALITY_REPORTS,
    "promotions": model.PROMOTIONS,
    "schema_registry": model.SCHEMA_REGISTRY,
    "bus_events": model.BUS_EVENTS,
}


def as_json(value: Any) -> str:
    return json.dumps(value, default=str)
