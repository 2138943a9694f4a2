"""Every registered query against its SQL equivalent, on the smallest data."""

import duckdb
import pytest

import __spark_entry__ as entry
from sparcel.checks.base import TABLES
from tools.check import rows_of

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def db(sf_dir):
    connection = duckdb.connect()
    for table in TABLES:
        connection.sql(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return connection


def test_entry(spark):
    assert entry.entry(spark).count() == 11


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", QUERIES)
def test_query(name, spark, db, sf_dir):
    df = QUERIES[name](spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if name in ORACLES:
        relation = db.sql(ORACLES[name])
        assert sorted(df.columns) == sorted(relation.columns)
        assert got == rows_of(relation.columns, relation.fetchall())
