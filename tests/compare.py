"""Run a registered query and its SQL counterpart and compare the results."""

from __future__ import annotations

import math

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(folder: str):
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return connection


def _cell(value):
    if value is None:
        return ""
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return f"{value + 0.0:.5f}" if abs(value) < 1e6 else f"{value:.9e}"
    return str(value)


def _sorted(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_cell(row[i]) for i in order) for row in rows)


def _close(a: str, b: str) -> bool:
    if a == b:
        return True
    try:
        return math.isclose(float(a), float(b), rel_tol=1e-9, abs_tol=2e-6)
    except ValueError:
        return False


def compare(df, connection, sql: str) -> str | None:
    """None if equal, else a short description of the first difference."""
    result = connection.execute(sql)
    want_columns, want = _sorted([c[0] for c in result.description], result.fetchall())
    have_columns, have = _sorted(df.columns, [tuple(r) for r in df.collect()])
    if have_columns != want_columns:
        return f"columns {have_columns} != {want_columns}"
    if len(have) != len(want):
        return f"{len(have)} rows != {len(want)}"
    for a, b in zip(have, want):
        if not all(_close(x, y) for x, y in zip(a, b)):
            return f"{dict(zip(have_columns, a))} != {dict(zip(want_columns, b))}"
    return None
