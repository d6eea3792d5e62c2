"""Every query of the library against its SQL in DuckDB, on the smallest tables."""

import math

import duckdb
import pytest

from lodestrata.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, bool):
        return v
    return round(float(v), 5) if isinstance(v, (int, float)) else str(v)


def rows_of(rows, names, columns):
    at = [names.index(c) for c in columns]
    return sorted((tuple(plain(r[i]) for i in at) for r in rows), key=str)


def test_every_sql_has_a_query():
    assert set(catalogue.oracle_sql()) <= set(catalogue.queries())


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_same_as_sql(spark, duck, name):
    got = catalogue.queries()[name](spark, SF)
    want = duck.sql(catalogue.oracle_sql()[name])
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    a, b = rows_of(got.collect(), got.columns, columns), rows_of(want.fetchall(), want.columns, columns)
    assert len(a) == len(b)
    for x, y in zip(a, b):
        for u, v in zip(x, y):
            assert u == v or isinstance(u, float) and isinstance(v, float) and math.isclose(u, v, rel_tol=1e-6, abs_tol=2e-5)


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_runs_without_sql(spark, name):
    assert catalogue.queries()[name](spark, SF).count() > 0
