"""Every catalogue query with SQL gives the rows that DuckDB gives on sf0.001."""

from __future__ import annotations

import duckdb
import pytest

from tidemark.plans import catalogue

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SMALL}/{t}.parquet')")
    return con


def plain(frame) -> list:
    frame = frame[sorted(frame.columns)]
    cell = lambda v: None if v is None or v != v else repr(round(float(v), 4)) if isinstance(v, int | float) and not isinstance(v, bool) else str(v)
    return sorted((tuple(cell(v) for v in row) for row in frame.astype(object).where(frame.notna(), None).values.tolist()), key=str)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    got = catalogue.queries()[name](spark, SMALL).toPandas()
    want = duck.execute(catalogue.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


def test_entry_point(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
