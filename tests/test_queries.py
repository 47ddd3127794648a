"""Every registered query against its SQL twin on the smallest tables."""

import os

import duckdb
import pytest

from swathe import registry

DATA = "/root/testdata/sf0.001"


def norm(x):
    if isinstance(x, bool) or x is None:
        return x
    if isinstance(x, (int, float)):
        return None if x != x else round(float(x), 6) + 0.0
    return str(x)


def ordered(rows):
    return sorted(rows, key=lambda r: [(v is None, str(type(v)), 0 if v is None else v) for v in r])


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.sql(f"create view {name.split('.')[0]} as select * from '{DATA}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = [tuple(norm(r[c]) for c in columns) for r in df.collect()]
    if name in registry.SQL:
        rel = duck.sql(registry.SQL[name])
        names = list(rel.columns)
        assert sorted(names) == columns
        assert ordered(got) == ordered([tuple(norm(r[names.index(c)]) for c in columns) for r in rel.fetchall()])
    else:
        assert got
