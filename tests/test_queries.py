"""Every registered query against its SQL oracle, on the smallest tables."""

import os

import duckdb
import pytest

from __spark_entry__ import SMOKE_DIR, entry, oracle_sql, queries
from check import TABLES, normal
from workload.queries import QUERIES

pytestmark = pytest.mark.skipif(not os.path.isdir(SMOKE_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for table in TABLES:
        connection.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SMOKE_DIR}/{table}.parquet'")
    return connection


def test_entry(spark):
    assert entry(spark).count() > 0


def test_every_query_has_an_oracle():
    """The queries of this package; those of a subpackage may have tests of their own instead."""
    assert set(QUERIES) <= set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", list(oracle_sql()))
def test_query(spark, db, name):
    got = queries()[name](spark, SMOKE_DIR).toPandas()
    want = db.sql(oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert normal(got) == normal(want)
    assert len(got) > 0
