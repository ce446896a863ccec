"""Runs a registered query and its SQL side by side and compares the results."""

from __future__ import annotations

import datetime
import decimal
import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()

KIND = {
    "tinyint": "int", "smallint": "int", "int": "int", "bigint": "int", "hugeint": "huge",
    "TINYINT": "int", "SMALLINT": "int", "INTEGER": "int", "BIGINT": "int", "HUGEINT": "huge",
    "double": "float", "float": "float", "DOUBLE": "float", "FLOAT": "float",
    "string": "text", "VARCHAR": "text", "boolean": "bool", "BOOLEAN": "bool",
    "timestamp": "time", "TIMESTAMP": "time", "date": "date", "DATE": "date",
}


def connect(root: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{root}/{name}.parquet')")
    return con


def plain(value):
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return value


def sorted_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=lambda r: tuple(map(str, r)))


def compare(spark, root: str, query, sql: str | None, con=None) -> str | None:
    """None when both sides agree, else a short description of the first difference."""
    df = query(spark, root)
    rows = [tuple(r) for r in df.collect()]
    if not rows:
        return "no rows"
    if sql is None:
        return None
    con = con or connect(root)
    cursor = con.execute(sql)
    columns = [d[0] for d in cursor.description]
    kinds = {d[0]: KIND.get(str(d[1]), str(d[1])) for d in cursor.description}
    expected = cursor.fetchall()
    if sorted(df.columns) != sorted(columns):
        return f"columns {sorted(df.columns)} != {sorted(columns)}"
    for name, dtype in df.dtypes:
        if KIND.get(dtype, dtype) != kinds[name]:
            return f"type of {name}: {dtype} != {kinds[name]}"
    if len(rows) != len(expected):
        return f"{len(rows)} rows != {len(expected)}"
    left, right = sorted_rows(df.columns, rows), sorted_rows(columns, expected)
    for a, b in zip(left, right):
        if a != b:
            names = sorted(df.columns)
            return "; ".join(f"{n}: {x!r} != {y!r}" for n, x, y in zip(names, a, b) if x != y)[:600]
    return None
