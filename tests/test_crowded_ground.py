"""Crowded cells split by a quadtree and by parts: the same pairs, and no task with a whole cell."""

import math
import random

import pytest
from pyspark.sql import functions as F

from swathe.operators import spatial as S

REACH = 100.0


@pytest.fixture(scope="module")
def ground(spark):
    rng = random.Random(1)
    spots = [(k, rng.uniform(0, 99), rng.uniform(0, 99)) for k in range(600)]  # all in one cell
    spots += [(1000 + k, 40.0, 40.0) for k in range(300)]  # on one spot of it
    spots += [(2000 + k, rng.uniform(-500, 900), rng.uniform(-500, 900)) for k in range(300)]
    lines = [("a", 0, -50.0, 20.0, 30.0, 60.0), ("b", 0, 150.0, 150.0, 260.0, 90.0), ("c", 0, 300.0, -300.0, 500.0, 700.0), ("d", 0, 40.0, 40.0, 40.0, 40.0)]
    rows = [(n, s, x1, y1, x2, y2, math.hypot(x2 - x1, y2 - y1), 0.0) for n, s, x1, y1, x2, y2 in lines]
    return (
        spark.createDataFrame(spots, "id int, x double, y double"), spark.createDataFrame(rows, "line_uid string, seq int, x1 double, y1 double, x2 double, y2 double, len double, start double"), spots, lines,
    )


def distance(x, y, x1, y1, x2, y2):
    dx, dy = x2 - x1, y2 - y1
    t = ((x - x1) * dx + (y - y1) * dy) / (dx * dx + dy * dy) if dx or dy else 0.0
    t = min(max(t, 0.0), 1.0)
    return math.hypot(x - (x1 + t * dx), y - (y1 + t * dy))


@pytest.mark.parametrize("full", [20, 100, 10_000])
def test_same_pairs_of_points_and_edges(ground, full):
    points, lines, spots, edges = ground
    got = {(r.id, r.line_uid): r.dist for r in S.near_edges(points, lines, REACH, full).collect()}
    want = {(k, n): d for k, x, y in spots for n, _, *e in edges if (d := distance(x, y, *e)) <= REACH}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


@pytest.mark.parametrize("full", [20, 10_000])
def test_same_pairs_of_points(ground, full):
    points, _, spots, _ = ground
    others = points.select(F.col("id").alias("other"), F.col("x").alias("x2"), F.col("y").alias("y2")).where("id % 7 = 0")
    got = [(r.id, r.other) for r in S.pairs_within(points, others, REACH, full).select("id", "other").collect()]
    want = {(a[0], b[0]) for a in spots for b in spots if b[0] % 7 == 0 and math.hypot(a[1] - b[1], a[2] - b[2]) <= REACH}
    assert len(got) == len(want) and set(got) == want
    some = {r.id for r in S.pairs_within(points, others, REACH, full, F.col("id") != F.col("other"), "left_semi").collect()}
    assert some == {a for a, b in want if a != b}


def test_no_leaf_holds_many_more_than_it_may(ground):
    points, lines, _, _ = ground
    boxed = S.edges_by_cell(lines, REACH).withColumns({"x_low": F.least("x1", "x2"), "x_high": F.greatest("x1", "x2"), "y_low": F.least("y1", "y2"), "y_high": F.greatest("y1", "y2")})
    left, right = S.deal(points, boxed, REACH, 50)
    sizes = [r["count"] for r in left.where("leaf is not null").groupBy("cx", "cy", "leaf").count().collect()]
    assert max(sizes) <= 90 and sum(sizes) >= 900
    assert {r.level for r in S.leaves(points, REACH, 50).select("level").distinct().collect()} > {S.HALVINGS}  # coarse where few, fine where many
    # an edge isn't sent to leaves that it can't reach
    assert right.where("line_uid = 'b' and cx = 0 and cy = 0").count() < right.where("line_uid = 'a' and cx = 0 and cy = 0").count()


def test_nearest_of_crowded_points(ground, monkeypatch):
    points, lines, spots, edges = ground
    monkeypatch.setattr(S, "FULL", 30)
    got = {r.id: (r.line_uid, round(r.dist, 9)) for r in S.nearest_line(points, lines, "id", REACH).collect()}
    for k, x, y in spots:
        near = sorted((d, n) for n, _, *e in edges if (d := distance(x, y, *e)) <= REACH)
        assert got.get(k) == ((near[0][1], round(near[0][0], 9)) if near else None)


def test_no_points(ground):
    points, lines, _, _ = ground
    assert S.near_edges(points.limit(0), lines, REACH).count() == 0 and S.near_edges(points, lines.limit(0), REACH).count() == 0


def test_a_long_edge_is_in_cells_along_it_and_not_in_its_box(spark):
    lines = spark.createDataFrame([("a", 0, 10.0, 10.0, 9990.0, 9900.0), ("u", 0, 50.0, -700.0, 50.0, 900.0)], "line_uid string, seq int, x1 double, y1 double, x2 double, y2 double")
    cells = {(r.line_uid, r.cx, r.cy) for r in S.edges_by_cell(lines, REACH).collect()}
    assert len([k for k in cells if k[0] == "a"]) < 1000  # its box has 102 x 102
    rng = random.Random(3)
    for name, *edge in [("a", 10.0, 10.0, 9990.0, 9900.0), ("u", 50.0, -700.0, 50.0, 900.0)]:
        for _ in range(3000):
            t, side, turn = rng.random(), rng.uniform(0, REACH), rng.uniform(0, 7)
            x, y = edge[0] + t * (edge[2] - edge[0]) + side * math.cos(turn), edge[1] + t * (edge[3] - edge[1]) + side * math.sin(turn)
            assert (name, math.floor(x / REACH), math.floor(y / REACH)) in cells


@pytest.mark.parametrize("full", [20, 10_000])
def test_lines_near_places_of_one_spot_and_of_several(ground, full):
    points, lines, spots, edges = ground
    keyed = points.withColumn("key", F.when(F.col("id") < 400, F.col("id") % 100).otherwise(F.col("id")))  # 100 keys on 4 spots each
    places = S.places(keyed, "key", least=F.min("key"))
    assert places.where("least = 1000").first().n == 300 and places.where("not alone").count() == 400
    got = {(r.least, r.line_uid): (r.n, r.dist) for r in S.near_lines(places, lines, REACH, full=full).collect()}
    want = {}
    for k, x, y in spots:
        for n, _, *e in edges:
            key = (1000 if 1000 <= k < 2000 else k % 100 if k < 400 else k, n)
            if (d := distance(x, y, *e)) <= REACH:
                want[key] = min(d, want.get(key, d))
    assert got.keys() == want.keys() and all(abs(got[k][1] - want[k]) < 1e-9 for k in want)


def test_hot_spots_of_points_that_share_spots(spark):
    rows = [(1, 0.0, 0.0, 5.0), (2, 0.0, 0.0, None), (3, 1.0, 0.0, 2.0), (4, 9.0, 9.0, 1.0)]
    got = {r.id: r.z for r in S.getis_ord(spark.createDataFrame(rows, "id int, x double, y double, v double"), "id", "v", 3.0).collect()}
    mean, sd = 8 / 3, (sum((v - 8 / 3) ** 2 for v in (5, 2, 1)) / 3) ** 0.5
    z = lambda s, w: (s - mean * w) / (sd * ((4 * w - w * w) / 3) ** 0.5)
    assert all(abs(got[k] - v) < 1e-9 for k, v in {1: z(7, 3), 2: z(7, 3), 3: z(7, 3), 4: z(1, 1)}.items())


def test_points_on_one_spot_are_counted_once(spark, monkeypatch):
    """A thousand points on few spots, some keys on several of them: the same counts as by hand, and pairs of spots only."""
    rng = random.Random(6)
    spots = [(rng.randrange(0, 300) * 1.0, rng.randrange(0, 300) * 1.0) for _ in range(20)]
    rows = [(k if k < 900 else k - 900, *rng.choice(spots)) for k in range(1000)] + [(None, *spots[0])]
    zones, seen = {"r0-25": (0, 25), "r25-100": (25, 100), "c100": (0, 100)}, []
    whole = S.pairs_within
    monkeypatch.setattr(S, "pairs_within", lambda a, b, *more: seen.append(a.count() * b.count()) or whole(a, b, *more))
    got = {r[0]: tuple(r[1:]) for r in S.counts_within(spark.createDataFrame(rows, "id int, x double, y double"), "id", zones, 2.0).collect()}
    want = {k: [0, 0, 0] for k, _, _ in rows}
    for k, x, y in rows:
        for other, x2, y2 in rows:
            if k is not None and other is not None and k != other:
                d = math.hypot(x - x2, y - y2) / 2
                for at, (low, high) in enumerate(zones.values()):
                    want[k][at] += low <= d < high
    assert got == {k: tuple(v) for k, v in want.items()} and seen[0] <= 400


@pytest.mark.parametrize("together", [100, 7])
def test_an_edge_meets_a_spot_of_many_keys_once(ground, spark, monkeypatch, together):
    """Keys that share a spot, one of them null and one twice: the pairs of all of them, from a row a list of keys."""
    _, lines, _, edges = ground
    monkeypatch.setattr(S, "TOGETHER", together)
    seen, whole = [], S.near_edges
    monkeypatch.setattr(S, "near_edges", lambda points, *more: seen.append(points.count()) or whole(points, *more))
    rows = [(k, 40.0 + k % 3, 40.0) for k in range(90)] + [(None, 41.0, 40.0), (5, 42.0, 40.0), (999, 5000.0, 5000.0)]
    near = S.near_edges_of_keys(spark.createDataFrame(rows, "id int, x double, y double"), "id", lines, REACH)
    got = sorted(((r.id, r.line_uid) for r in near.select(F.inline("keys").alias("id"), "line_uid").collect()), key=str)
    assert got == sorted(((k, e[0]) for k, x, y in rows for e in edges if distance(x, y, *e[2:]) <= REACH), key=str)
    assert seen[0] <= 4 if together == 100 else seen[0] <= 16
