"""Compare a Spark result with the result of its check SQL in DuckDB."""

from __future__ import annotations

import datetime as dt
import decimal
import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages"
    " benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _kind(arrow_type) -> str:
    return str(arrow_type).replace("large_string", "string").replace("timestamp[us]", "timestamp")


def _cell(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return float(f"{value:.12g}") + 0.0
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, (dt.datetime, dt.date)):
        return str(value)
    if isinstance(value, list):
        return tuple(_cell(v) for v in value)
    return value


def _rows(table, names):
    columns = [table.column(n).to_pylist() for n in names]
    rows = [tuple(_cell(v) for v in row) for row in zip(*columns)] if names else []
    return sorted(rows, key=lambda r: tuple((v is not None, str(type(v)), str(v)) for v in r))


def differences(spark_df, con, sql: str) -> list[str]:
    """Human-readable differences; empty if the results agree."""
    ours, theirs = spark_df.toArrow(), con.execute(sql).to_arrow_table()
    problems = []
    if sorted(ours.column_names) != sorted(theirs.column_names):
        return [f"columns {sorted(ours.column_names)} against {sorted(theirs.column_names)}"]
    names = sorted(ours.column_names)
    for n in names:
        a, b = _kind(ours.schema.field(n).type), _kind(theirs.schema.field(n).type)
        if a != b and not (ours.num_rows == 0 or b == "null"):
            problems.append(f"type of {n}: {a} against {b}")
    if ours.num_rows != theirs.num_rows:
        problems.append(f"rows {ours.num_rows} against {theirs.num_rows}")
    a, b = _rows(ours, names), _rows(theirs, names)
    if a != b:
        shown = [(x, y) for x, y in zip(a, b) if x != y][:2]
        problems.append(f"values, e.g. {str(shown)[:600]}")
    return problems
