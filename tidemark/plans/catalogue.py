"""The catalogue of queries over the reference's own operators."""

from __future__ import annotations

from tidemark.plans import other_queries, registry, run_queries, text_queries, trend_queries

MODULES = (trend_queries, text_queries, other_queries, run_queries)


def queries() -> dict:
    return dict(registry.QUERIES)


def oracle_sql() -> dict:
    return dict(registry.SQL)
