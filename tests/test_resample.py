"""Resamples split over buckets: as many picks as rows, the same as their SQL, and close to what theory says."""

import random

import duckdb
import numpy as np
import pandas as pd
import pytest

from swathe.operators import corridor, resample
from swathe.operators import events as E

DRAWS = 40


@pytest.fixture(scope="module")
def table():
    rng = random.Random(1)
    sizes = {("a", "s1"): 1, ("a", "s2"): 61, ("a", "s3"): 7, ("b", "s1"): 130, ("b", "s2"): 14}
    rows = [(ring, s, f"{ring}{s}{k:04}", round(rng.gauss(0, 1), 3 if k % 3 else 1), 1 + k % 5) for (ring, s), n in sizes.items() for k in range(n)]
    return pd.DataFrame(rows, columns=["ring", "stratum", "segment_id", "v", "weight"])


@pytest.mark.parametrize("bucket,ranges", [(7, 8), (1000, 256), (1, 2)])
def test_medians_of_draws_equal_their_sql(spark, table, monkeypatch, bucket, ranges):
    monkeypatch.setattr(resample, "BUCKET_ROWS", bucket)
    monkeypatch.setattr(resample, "RANGES", ranges)
    got = {(r.ring, r.draw): r["median"] for r in resample.weighted_medians(spark.createDataFrame(table), ["ring"], "stratum", "segment_id", "v", "weight", DRAWS, 392).collect()}
    steps = {"src": "select * from given"} | resample.picks_sql("src", ["ring"], ["stratum"], "segment_id", DRAWS, 392) | resample.medians_sql(["ring"], "v", "weight")
    con = duckdb.connect()
    con.register("given", table)
    want = con.sql("with " + ",\n".join(f"{k} as ({v})" for k, v in steps.items()) + " select ring, draw, m from med").fetchall()
    assert got == {(ring, draw): m for ring, draw, m in want} and len(got) == 2 * DRAWS
    assert len({m for (ring, _), m in got.items() if ring == "b"}) > 3


@pytest.mark.parametrize("bucket", [7, 1000])
def test_every_draw_has_as_many_picks_as_rows(spark, table, monkeypatch, bucket):
    monkeypatch.setattr(resample, "BUCKET_ROWS", bucket)
    held = resample.buckets(spark.createDataFrame(table), ["ring", "stratum"], "segment_id", ["v"], DRAWS, 7)
    picks = resample.picks(held, DRAWS, "ring", "stratum").toPandas()
    sizes = table.groupby(["ring", "stratum"]).size()
    assert (picks.groupby(["ring", "stratum", "draw"]).size().unstack("draw") == sizes.to_frame().values).all().all()
    # in a draw, about a share of 1/e of the rows of a large stratum isn't picked
    own = picks[(picks.ring == "b") & (picks.stratum == "s1")]
    missed = own.groupby("draw")["pick"].agg(lambda p: 1 - len({x["_i"] + 1000 * 0 for x in p}) / 130)
    assert 0.3 < missed.mean() < 0.44


def test_interval_is_about_right(spark):
    rng = random.Random(2)
    rows = pd.DataFrame([("all", "x", f"{k:05}", rng.gauss(0, 1), 1) for k in range(3000)], columns=["ring", "stratum", "segment_id", "v", "weight"])
    r = corridor.bootstrap(spark.createDataFrame(rows), ["ring"], "stratum", "segment_id", "v", "weight", 300).first()
    # a median of n normal values has a standard error of 1.2533 / sqrt(n)
    width = 2 * 1.96 * 1.2533 / 3000**0.5
    assert 0.7 * width < r.hi95 - r.lo95 < 1.35 * width and r.segments == 3000


def test_few_rows_nulls_and_no_rows(spark):
    rows = spark.createDataFrame([("a", "x", 1, 1.0, 1), ("a", "x", 2, None, 1), ("b", None, 1, 2.0, 1), ("b", None, 2, 2.0, 1), ("b", "y", 3, 2.0, 1)], "ring string, stratum string, id int, v double, weight int")
    got = {r.ring: (r.segments, r.lo95, r.hi95) for r in corridor.bootstrap(rows, ["ring"], "stratum", "id", "v", "weight", 20).collect()}
    assert got == {"a": (1, None, None), "b": (3, 2.0, 2.0)}
    assert corridor.bootstrap(rows.limit(0), ["ring"], "stratum", "id", "v", "weight", 20).count() == 0


def test_nothing_of_rows_times_draws_is_exchanged(spark, table):
    """Picks are made and summed on one side of an exchange."""
    held = resample.buckets(spark.createDataFrame(table), ["ring", "stratum"], "segment_id", ["v"], DRAWS, 7)
    plan = resample.picks(held, DRAWS, "ring").groupBy("ring", "draw").count()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Generate explode") == 2 and plan.count("Exchange") == 1 and plan.rindex("Generate explode") > plan.index("Exchange")


def test_statistics_make_no_row_a_pick(spark, table):
    """Picks are summed in arrays inside a task: no plan has rows times draws, and means are those of the picks."""
    rows = spark.createDataFrame(table)
    found = resample.means(rows, ["ring"], "segment_id", "v", DRAWS, 7)
    events = spark.createDataFrame([("all", 1, 0.5), ("all", 2, 0.1), ("all", 3, 0.2)], "subset string, event_no int, e1 double")
    fakes = spark.createDataFrame([(k, s, (k - s) / 10) for k in (1, 2, 3) for s in (0, 1, 2)], "event_no int, site_k int, e1 double")
    for df in (found, resample.weighted_medians(rows, ["ring"], "stratum", "segment_id", "v", "weight", DRAWS, 392), E.permutation_p(events, ["subset"], fakes, 50)):
        assert "Generate explode" not in df._jdf.queryExecution().executedPlan().toString()
    held = resample.buckets(rows.withColumn("_v", rows.v), ["ring"], "segment_id", ["_v"], DRAWS, 7)
    want = resample.picks(held, DRAWS, "ring").selectExpr("ring", "draw", "pick._v").groupBy("ring", "draw").avg("_v").collect()
    assert {(r.ring, r.draw): round(r["avg(_v)"], 9) for r in want} == {(r.ring, r.draw): round(r["mean"], 9) for r in found.collect()}


def test_the_hash_of_arrays_is_that_of_columns(spark):
    keys = [0, 1, 44488, resample.PRIME - 1, resample.PRIME, 2 * resample.PRIME, (1 << 40) - 1, *(random.Random(3).randrange(1 << 40) for _ in range(500))]
    # numbers whose remainder is 0
    keys += [k for k in ((m * resample.PRIME - 11) // resample.FACTOR for m in range(1, 400000)) if (k * resample.FACTOR + 11) % resample.PRIME == 0][:5]
    want = [r[0] for r in spark.createDataFrame([(k,) for k in keys], "k long").select(resample.mixed(resample.F.col("k"))).collect()]
    assert resample.mixed_array(np.array(keys)).tolist() == want
