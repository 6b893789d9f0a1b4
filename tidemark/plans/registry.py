"""Registration of queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.sources.scratch import spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
#: Tables of texts, whose rows cost far more to work on than to move.
TEXTS = {"documents", "pages"}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    found = spark.read.parquet(f"{sf}/{name}.parquet")
    return spread(found) if name in TEXTS else found


def plan(sql: str | None):
    """Registers the query under its function's name."""

    def add(query):
        QUERIES[query.__name__] = query
        if sql:
            SQL[query.__name__] = sql
        return query

    return add
