"""Every query with SQL gives the same rows as DuckDB on the small tables."""

import datetime
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from heddle.plans import catalog

DATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(value):
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    return round(value, 5) + 0.0 if isinstance(value, float) else value


def rows(columns, found):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(repr([plain(r[i]) for i in order]) for r in found)


@pytest.mark.parametrize("name", list(catalog.ORACLES))
def test_query_equals_sql(spark, db, name):
    got = catalog.QUERIES[name](spark, str(DATA))
    want = db.execute(catalog.ORACLES[name])
    columns = [x[0] for x in want.description]
    assert sorted(got.columns) == sorted(columns)
    found = rows(got.columns, got.collect())
    assert found == rows(columns, want.fetchall())
    assert found


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
