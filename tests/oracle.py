"""Side-by-side comparison of a Spark query and its DuckDB oracle."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
from pyspark.sql import DataFrame

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        if Path(f"{sf_dir}/{name}.parquet").exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _cell(value):
    if value is None:
        return "\x00null"
    if isinstance(value, bool):
        return f"b:{value}"
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"f:{value!r}"
    return f"{type(value).__name__}:{value}"


def _rows(columns: list[str], rows) -> list[tuple[str, ...]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(row[i]) for i in order) for row in rows)


TYPES = {
    "VARCHAR": "string",
    "BIGINT": "bigint",
    "INTEGER": "int",
    "DOUBLE": "double",
    "BOOLEAN": "boolean",
}


def type_differences(df: DataFrame, con: duckdb.DuckDBPyConnection, sql: str) -> list[str]:
    """Columns whose Spark and DuckDB types are not the same type."""
    found = {row[0]: row[1] for row in con.execute(f"DESCRIBE {sql}").fetchall()}
    return [
        f"{name}: {kind} vs {found.get(name)}"
        for name, kind in df.dtypes
        if TYPES.get(found.get(name)) != kind
    ]


def differences(df: DataFrame, con: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """None when columns and rows agree exactly, else what differs."""
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    expected = _rows(names, cursor.fetchall())
    actual = _rows(df.columns, [tuple(r) for r in df.collect()])
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} vs {sorted(names)}"
    if len(expected) != len(actual):
        return f"{len(actual)} rows vs {len(expected)}"
    wrong = [(a, e) for a, e in zip(actual, expected) if a != e]
    if wrong:
        a, e = wrong[0]
        cells = [(x[:200], y[:200]) for x, y in zip(a, e) if x != y]
        return f"{len(wrong)} of {len(actual)} rows differ, e.g. {cells} in {[x[:60] for x in a]}"
    return None
