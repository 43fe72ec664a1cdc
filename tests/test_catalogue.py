"""Every query of the catalogue against its SQL on the smallest tables."""

import decimal
import os

import duckdb
import pytest

from tracequarry.plans import catalogue

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def plain(v):
    """A value as text that keeps its kind: a whole number and a fraction never look alike."""
    if v is None:
        return "null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (float, decimal.Decimal)):
        return "nan" if v != v else f"{float(v) + 0.0:.6f}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    return str(v)


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(v[i]) for i in order) for v in values)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the given tables are absent")
@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, con, name):
    got = catalogue.queries()[name](spark, DATA)
    if name in catalogue.oracle_sql():
        want = con.sql(catalogue.oracle_sql()[name])
        assert sorted(got.columns) == sorted(want.columns)
        found = rows(got.columns, got.collect())
        assert found == rows(want.columns, want.fetchall())
    else:
        assert got.count() >= 0
