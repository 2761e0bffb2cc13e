"""Every catalogued query against its DuckDB statement, on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

from quillstat import catalog

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(rows, columns):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(repr(tuple(float(r[k]) if isinstance(r[k], (int, float)) and not isinstance(r[k], bool) else r[k] for k in order)) for r in rows)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    got = catalog.queries()[name](spark, DIR)
    rows = [tuple(r) for r in got.collect()]
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    want = duck.execute(sql)
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert norm(rows, got.columns) == norm(want.fetchall(), columns)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
