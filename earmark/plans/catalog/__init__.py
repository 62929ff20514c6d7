"""Registered queries: each operator over the given tables, with its check as SQL where SQL can say it."""

from earmark.plans.catalog.registry import oracle_sql, queries
from earmark.plans.catalog import (  # noqa: F401  (registration)
    fusion_forms,
    incremental,
    inputs,
    metrics,
    review,
    sampling,
    scores,
    signal,
)

__all__ = ["oracle_sql", "queries"]
