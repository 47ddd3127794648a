"""Suppliers that share a segment's name, as keys of more than four digits do: gaps stay one row a segment and ring."""

import duckdb
import pytest

from swathe import registry
from test_queries import DATA, norm, ordered


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path, con = tmp_path_factory.mktemp("tables"), duckdb.connect()
    for name in ("lineitem", "nation", "region"):
        con.sql(f"copy (select * from '{DATA}/{name}.parquet') to '{path}/{name}.parquet' (format parquet)")
    con.sql(f"copy (select * from '{DATA}/supplier.parquet' union all select * from '{DATA}/supplier.parquet' union all select * replace ((s_nationkey + 7) % 25 as s_nationkey) from '{DATA}/supplier.parquet') to '{path}/supplier.parquet' (format parquet)")
    return str(path)


@pytest.mark.parametrize("name", ["a7_typical_gap", "t3_distance_order", "a30_bootstrap_unweighted", "v5_segment_record", "w5_unbroken_run"])
def test_repeated_segments(spark, folder, name):
    con = duckdb.connect()
    for table in ("lineitem", "nation", "region", "supplier"):
        con.sql(f"create view {table} as select * from '{folder}/{table}.parquet'")
    rel, df = con.sql(registry.SQL[name]), registry.QUERIES[name](spark, folder)
    columns, names = sorted(df.columns), list(rel.columns)
    assert ordered([tuple(norm(r[c]) for c in columns) for r in df.collect()]) == ordered([tuple(norm(r[names.index(c)]) for c in columns) for r in rel.fetchall()])


def test_an_image_a_pass_takes_one_sort(spark):
    """Of equal images the first, one without a count last; the rows of a task are sorted once."""
    from swathe.operators.corridor import one_image_per_pass

    rows = [("a", 1, 0, 2, 5), ("a", 1, 0, 2, 5), ("a", 1, 0, 1, 10), ("a", 1, 0, 0, 9), ("b", 1, 0, 1, None), ("b", 1, 0, 0, None), ("b", 1, 1, 1, 0), ("b", 1, 1, 0, None), ("b", 1, 1, None, 0)]
    obs = spark.createDataFrame(rows, "segment_id string, pass_date int, orbit int, image int, n long")
    found = one_image_per_pass(obs, "segment_id")
    assert sorted(map(tuple, found.collect()), key=str) == [("a", 1, 0, 1, 10), ("b", 1, 0, 0, None), ("b", 1, 1, 1, 0)]
    assert found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Sort [") == 1
