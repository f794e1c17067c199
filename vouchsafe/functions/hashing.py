"""Content hashes."""

from __future__ import annotations

import hashlib
import json

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SHORT_HASH = 16
KEY_HASH = 12


def short_sha256(value: Column, digits: int = SHORT_HASH) -> Column:
    return F.substring(F.sha2(value, 256), 1, digits)


def canonical_json(columns: list[str]) -> Column:
    """Key-sorted JSON of a typed row. Nulls are kept, so that absent and null columns differ."""
    return F.to_json(
        F.struct(*[F.col(f"`{name}`") for name in sorted(columns)]), {"ignoreNullFields": "false"}
    )


def content_digest(columns: list[str]) -> Column:
    """Full digest of a typed row, independent of the order of its columns."""
    return F.sha2(canonical_json(columns), 256)


def variant_content_digest(record: Column) -> Column:
    """Full digest of a JSON record; VARIANT keeps its keys sorted."""
    return F.sha2(F.to_json(record), 256)


def content_hash(columns: list[str]) -> Column:
    """The short form that lineage metadata shows."""
    return F.substring(content_digest(columns), 1, SHORT_HASH)


@F.arrow_udf(T.StringType())
def repr_content_hash(record_json: pa.Array) -> pa.Array:
    """Hash over the sorted item list as Python prints it, for hashes that existing data carries."""

    def digest(text):
        if text is None:
            return None
        items = repr(sorted(json.loads(text).items()))
        return hashlib.sha256(items.encode()).hexdigest()[:SHORT_HASH]

    return pa.array([digest(text) for text in record_json.to_pylist()], pa.string())
