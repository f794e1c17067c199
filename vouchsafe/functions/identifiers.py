"""Safe names for datasets, object keys and metric labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
IDENTIFIER = r"\A[a-z0-9_-]{1,64}\z"
UNSAFE_KEY_CHARS = "[^a-zA-Z0-9._-]"
FALLBACK_KEY = "upload"
KEY_CHARS = 128
ROUTE_PREFIXES = (
    "/versions/",
    "/rollback/",
    "/search/",
    "/demo/versions/",
    "/demo/rollback/",
    "/demo/search/",
)


def is_identifier(value: Column) -> Column:
    return F.coalesce(value.rlike(IDENTIFIER), F.lit(False))


def safe_object_key(file_name: Column) -> Column:
    base = F.substring_index(F.replace(file_name, F.lit("\\"), F.lit("/")), "/", -1)
    cleaned = F.regexp_replace(F.regexp_replace(base, UNSAFE_KEY_CHARS, "_"), r"\A\.+", "")
    return F.substring(F.coalesce(F.nullif(cleaned, F.lit("")), F.lit(FALLBACK_KEY)), 1, KEY_CHARS)


def route_template(path: Column, prefixes: tuple[str, ...] = ROUTE_PREFIXES) -> Column:
    """Replace what follows a known prefix by a placeholder, so that labels stay few."""
    templated = [
        F.when(path.startswith(prefix), F.lit(prefix + "{param}")) for prefix in prefixes
    ]
    return F.coalesce(*templated, path)
