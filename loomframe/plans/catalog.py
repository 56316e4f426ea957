"""Registry of the engine's own queries and their SQL."""

from __future__ import annotations

from loomframe.plans import candidate_queries, dedup_queries, export_queries, label_queries, metric_queries, review_queries, teaching_queries, time_queries  # noqa: F401
from loomframe.plans.registry import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(SQL)
