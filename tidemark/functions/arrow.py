"""Arrow UDFs that are built at their first use, when a session exists."""

from __future__ import annotations

import functools

from pyspark.sql import Column
from pyspark.sql import functions as F


def arrow(returns: str):
    """A decorator like pandas_udf with a DDL return type."""

    def wrap(work):
        made: list = []

        @functools.wraps(work)
        def call(*columns: Column | str) -> Column:
            if not made:
                made.append(F.pandas_udf(work, returns))
            return made[0](*columns)

        return call

    return wrap
