"""Edges of a cell stream by its spots, however a batch cuts lines and cells."""

import math
import random

from swathe.operators import spatial as S


def test_lines_over_many_batches_by_brute_force(spark):
    rng = random.Random(3)
    spots = [(k, rng.uniform(0, 300), rng.uniform(0, 300), True, 1) for k in range(60)]
    edges = [(f"L{k % 7}", k, *(rng.uniform(0, 300) for _ in range(4))) for k in range(80)]

    def far(x, y, x1, y1, x2, y2):
        dx, dy = x2 - x1, y2 - y1
        t = min(max(((x - x1) * dx + (y - y1) * dy) / (dx * dx + dy * dy), 0), 1)
        return math.hypot(x - x1 - t * dx, y - y1 - t * dy)

    want = {}
    for place, x, y, *_ in spots:
        for name, _, *edge in edges:
            if far(x, y, *edge) <= 40:
                want[place, name] = min(far(x, y, *edge), want.get((place, name), math.inf))
    places = spark.createDataFrame(spots, "place long, x double, y double, alone boolean, n long")
    lines = spark.createDataFrame(edges, "line_uid string, seq int, x1 double, y1 double, x2 double, y2 double")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        out = S.near_lines(places, lines, 40.0)
        got = {(r.place, r.line_uid): r.dist for r in out.collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    # no list of edges for each line and cell, over which every spot went element by element
    assert "collect_list" not in out._jdf.queryExecution().analyzed().toString()
