"""Every query of the engine against its SQL."""

import duckdb
import pytest

from tidemark.plans.queries import QUERIES, SQL

from .conftest import DATA

SF = f"{DATA}/sf0.001"


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for t in ("events", "orders", "customer"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def test_all_have_sql():
    assert QUERIES.keys() == SQL.keys()


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, tables, name):
    got = QUERIES[name](spark, SF)
    names = sorted(got.columns)
    found = tables.sql(SQL[name])
    assert names == sorted(found.columns)
    want = tables.sql(f"SELECT {', '.join(names)} FROM ({SQL[name]})").fetchall()
    key = lambda r: tuple(map(repr, r))
    assert sorted(map(tuple, got.select(*names).collect()), key=key) == sorted(want, key=key)
