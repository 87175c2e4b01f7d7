"""Order-blind comparison of a Spark result with its SQL counterpart."""

from __future__ import annotations

import datetime
import decimal
import math
from pathlib import Path

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(value):
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.10g}")
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return value


def _table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    body = sorted((tuple(_plain(row[i]) for i in order) for row in rows), key=repr)
    return [columns[i] for i in order], body


def spark_table(df):
    return _table(df.columns, [tuple(r) for r in df.collect()])


def sql_table(con, sql):
    cursor = con.execute(sql)
    return _table([d[0] for d in cursor.description], cursor.fetchall())


def kinds(rows, n):
    """Python type names per column, to catch numbers that come back as texts."""
    return [sorted({type(r[i]).__name__ for r in rows if r[i] is not None}) for i in range(n)]
