"""Every query against its SQL on the small tables, where these are there."""

import os

import duckdb
import pytest

from routeloom import queries

FOLDER = "/root/testdata/sf0.001"
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(str(tuple(round(r[k], 9) if isinstance(r[k], float) else r[k] for k in order)) for r in rows)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query(spark, db, name):
    df = queries.QUERIES[name](spark, FOLDER)
    found = db.sql(queries.ORACLES[name])
    assert sorted(df.columns) == sorted(found.columns)
    assert plain(df.collect(), df.columns) == plain(found.fetchall(), list(found.columns))


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_every_query_has_sql():
    assert set(queries.QUERIES) == set(queries.ORACLES)
