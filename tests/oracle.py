"""Run a registered query and its SQL side by side and compare whole results."""

from __future__ import annotations

import math
import time
from collections import Counter
from pathlib import Path

import duckdb

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
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    if isinstance(value, bool) or value is None or isinstance(value, str):
        return value
    if isinstance(value, int):
        return value
    return str(value)


def _rows(columns, rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_cell(row[i]) for i in order) for row in rows)


def spark_rows(df) -> tuple[list[str], Counter, int]:
    rows = df.collect()
    return sorted(df.columns), _rows(df.columns, rows), len(rows)


def duck_rows(con, sql: str) -> tuple[list[str], Counter, int]:
    cursor = con.execute(sql)
    names = [c[0] for c in cursor.description]
    rows = cursor.fetchall()
    return sorted(names), _rows(names, rows), len(rows)


def compare(spark, con, query, sql: str, sf_dir: str) -> tuple[str | None, int, float]:
    """(difference or None, row count, seconds)."""
    started = time.time()
    names, ours, n = spark_rows(query(spark, sf_dir))
    seconds = time.time() - started
    other_names, theirs, _ = duck_rows(con, sql)
    if names != other_names:
        return f"columns {names} != {other_names}", n, seconds
    if ours != theirs:
        extra, missing = ours - theirs, theirs - ours
        return (
            f"{sum(extra.values())} rows only here, {sum(missing.values())} only in SQL; "
            f"here {sorted(extra, key=str)[:2]} / SQL {sorted(missing, key=str)[:2]}"
        ), n, seconds
    return None, n, seconds
