"""Every registered query against its SQL twin on the smallest tables."""

import duckdb
import pytest
from conftest import SMALL

import __spark_entry__ as entry
from ledgerloom.workload import all_oracles, all_queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, ORACLES = all_queries(), all_oracles()


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SMALL}/{name}.parquet'")
    return connection


def normal(value):
    return (value is not None, repr(value) if isinstance(value, float) else str(value))


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, SMALL)
    columns = sorted(df.columns)
    got = sorted(tuple(normal(r[c]) for c in columns) for r in df.collect())
    cursor = db.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    expected = sorted(tuple(normal(r[names.index(c)]) for c in columns) for r in cursor.fetchall())
    assert got == expected


def test_entry(spark):
    assert entry.entry(spark).count() == 150
