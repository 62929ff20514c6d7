"""Registry of queries and small helpers to make results comparable."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Register a query under a name, with the equivalent SQL if there is one."""

    def keep(query: Query) -> Query:
        _QUERIES[name] = query
        if sql is not None:
            _SQL[name] = sql
        return query

    return keep


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def tidy(df: DataFrame) -> DataFrame:
    """Doubles rounded to six places (and no negative zero), so that both engines agree."""
    return df.select(
        *[(F.round(c, 6) + 0.0).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes]
    )


def tidied(sql: str, *doubles: str) -> str:
    """The same for SQL: the named columns are rounded."""
    rounded = ", ".join(f"round({c}, 6) + 0.0::DOUBLE AS {c}" for c in doubles)
    return f"SELECT * REPLACE ({rounded}) FROM ({sql})"
