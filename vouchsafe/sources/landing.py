"""Landing of uploads and webhook records in the raw zone: each content once, with one event.

An object's name holds the hash of its content. It is written under another name first and then given its own, which
fails if it is there, so that the same delivery, or two at once, make one object. What is to land is noted before; an
event is published for each noted object that is there and has none. A landing that was cut short anywhere is
finished by the next one, and a repeated delivery changes nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime, timezone
from itertools import islice
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vouchsafe.session import small_frame
from vouchsafe.sources.commits import give_name
from vouchsafe.sources.json_records import parse_envelopes
from vouchsafe.sources.manifest import landing_manifest, list_objects, read_uploads
from vouchsafe.sources.zones import Zones

# Fixed values.
INGESTED, GENERIC = "dataset.ingested", "generic"
#: Files renamed at a time, and events in a commit.
RENAMES_AT_ONCE, EVENTS_PER_COMMIT = 16, 500

NOTED = "dataset STRING, object_key STRING, content_hash STRING, record_count BIGINT, pipeline STRING, trigger_type STRING"


def raw_path(zones: Zones, dataset: str, object_key: str) -> str:
    return zones.path("raw", dataset, object_key)


def note(zones: Zones, accepted: DataFrame) -> None:
    """Write down what is going to land."""
    names = [c.split()[0] for c in NOTED.split(", ")]
    accepted.select(*names).dropDuplicates(["dataset", "object_key"]).write.parquet(
        zones.path("landing", "noted", uuid.uuid4().hex)
    )


def _give_names(zones: Zones, files: Iterable[tuple[str, str, str]]) -> int:
    """Rename (path, dataset, object key) into the raw zone; returns how many are new there."""

    def one(file: tuple[str, str, str]) -> bool:
        source, dataset, key = file
        target = raw_path(zones, dataset, key)
        zones.make_folder(zones.path("raw", dataset))
        return not zones.exists(target) and give_name(zones.spark, source, target)

    new = 0
    with ThreadPoolExecutor(RENAMES_AT_ONCE) as pool:
        files = iter(files)
        while some := list(islice(files, 20 * RENAMES_AT_ONCE)):
            new += sum(pool.map(one, some))
    return new


def land_uploads(zones: Zones, *folders: str, pipeline: str = GENERIC) -> dict[str, int]:
    """Move the acceptable files below ``folders`` (one folder a dataset) into the raw zone; the others stay.

    Names pass the driver, a few hundred at a time; contents do not. Files that are there already stay where they are.
    """
    manifest = zones.spill(landing_manifest(read_uploads(zones.spark, *folders)), "landing", "manifest")
    accepted = manifest.where("accepted")
    note(zones, accepted.withColumns({"pipeline": F.lit(pipeline), "trigger_type": F.lit("event")}))
    rows = accepted.select("path", "dataset", "object_key").toLocalIterator()
    new = _give_names(zones, ((r["path"], r["dataset"], r["object_key"]) for r in rows))
    counts = manifest.agg(F.count(F.lit(1)).alias("n"), F.count_if("accepted").alias("accepted")).first()
    return {"delivered": counts["n"], "refused": counts["n"] - counts["accepted"], "new": new, "events": publish(zones)}


def land_envelopes(zones: Zones, envelopes: DataFrame, body: str = "body") -> dict[str, int]:
    """Write the records of each acceptable webhook envelope as one raw object.

    Executors write the objects, each under a name of its own below the landing folder; the driver renames them.
    """
    judged = parse_envelopes(envelopes, body).withColumn(
        "object_key", F.concat(F.lit("webhook-"), F.col("content_hash"), F.lit(".json"))
    )
    records = F.when(F.col("error").isNull(), F.to_json("records")).alias("value")
    judged = zones.spill(
        judged.select(
            "dataset", "object_key", "content_hash", "record_count", "pipeline", "error", records,
            F.lit("webhook").alias("trigger_type"),
        ), "landing", "envelopes",
    )
    accepted = judged.where("error IS NULL")
    note(zones, accepted)
    staging = zones.path("landing", "objects", uuid.uuid4().hex)
    accepted.dropDuplicates(["dataset", "object_key"]).select(
        "value", F.col("dataset").alias("_dataset"), F.col("object_key").alias("_key")
    ).write.partitionBy("_dataset", "_key").text(staging)
    new = _give_names(zones, _written(zones, staging))
    zones.delete(staging)
    counts = judged.agg(F.count(F.lit(1)).alias("n"), F.count("error").alias("refused")).first()
    return {"delivered": counts["n"], "refused": counts["refused"], "new": new, "events": publish(zones)}


def _written(zones: Zones, staging: str) -> Iterator[tuple[str, str, str]]:
    """The staged files, as (path, dataset, object key)."""
    for dataset in zones.folders(staging):
        for key in zones.folders(f"{staging}/{dataset}"):
            folder = f"{staging}/{dataset}/{key}"
            for name in zones.files(folder):
                if name.startswith("part-"):
                    yield f"{folder}/{name}", dataset.split("=", 1)[1], key.split("=", 1)[1]


def publish(zones: Zones) -> int:
    """One event for each noted object that is in the raw zone and has none; returns their number."""
    spark = zones.spark
    batches = zones.folders(zones.path("landing", "noted"))
    if not batches or not zones.exists(zones.path("raw")):
        return 0
    noted = spark.read.schema(NOTED).parquet(*(zones.path("landing", "noted", b) for b in batches))
    parts = F.split("path", "/")
    there = list_objects(spark, zones.path("raw")).select(
        F.element_at(parts, -2).alias("dataset"), F.element_at(parts, -1).alias("object_key"), "path"
    )
    waiting = (
        noted.dropDuplicates(["dataset", "object_key"]).join(there, ["dataset", "object_key"])
        .join(zones.table("bus_events").select("dataset", "object_key"), ["dataset", "object_key"], "left_anti")
        .select("dataset", "object_key", "content_hash", "record_count", "pipeline", "trigger_type", "path")
    )
    rows, published = waiting.toLocalIterator(), 0
    while some := [r.asDict() for r in islice(rows, EVENTS_PER_COMMIT)]:
        published += len(zones.append("bus_events", lambda some=some: _unpublished(zones, some)))
    if published or len(batches) > 1:
        _tidy(zones, noted, batches)
    return published


def _unpublished(zones: Zones, rows: list[dict[str, Any]]) -> list[dict[str, Any]]:
    """Those of the rows that have no event yet, as events."""
    pairs = small_frame(zones.spark, [{k: r[k] for k in ("dataset", "object_key")} for r in rows], "dataset STRING, object_key STRING")
    known = zones.table("bus_events").join(F.broadcast(pairs), ["dataset", "object_key"], "left_semi")
    done = {(r["dataset"], r["object_key"]) for r in known.select("dataset", "object_key").collect()}
    now = datetime.now(timezone.utc).replace(tzinfo=None)
    return [
        {
            "event_id": f"{r['dataset']}/{r['object_key']}", "type": INGESTED, "dataset": r["dataset"],
            "object_key": r["object_key"], "source_uri": r["path"], "pipeline": r["pipeline"],
            "record_count": r["record_count"], "trigger_type": r["trigger_type"],
            "idempotency_key": r["content_hash"], "at": now,
        }
        for r in rows if (r["dataset"], r["object_key"]) not in done
    ]


def _tidy(zones: Zones, noted: DataFrame, batches: list[str]) -> None:
    """Keep only the notes of objects without an event, so that notes do not pile up."""
    events = zones.table("bus_events").select("dataset", "object_key")
    left = noted.join(events, ["dataset", "object_key"], "left_anti")
    left.coalesce(1).write.parquet(zones.path("landing", "noted", uuid.uuid4().hex))
    for batch in batches:
        zones.delete(zones.path("landing", "noted", batch))


