import __spark_entry__ as entry
import pytest

from lattica.plans.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for table in ("nation", "part", "orders", "supplier", "lineitem", "events", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    return con


def test_flagship(spark):
    assert entry.entry(spark).columns == ["i", "v"]


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_agrees_with_sql(spark, duck, name):
    want = duck.sql(ORACLES[name])
    order = sorted(want.columns)
    got = entry.queries()[name](spark, FOLDER).select(*order).collect()
    assert sorted(map(tuple, got)) == sorted(want.project(", ".join(f'"{c}"' for c in order)).fetchall())


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
