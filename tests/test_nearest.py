"""Nearest probes through cells of angles: the same as comparing every pair, and far fewer pairs."""

import numpy as np
import pandas as pd
import pytest

from swathe.operators import search


def clustered(rng, n, clusters, dims=16, spread=0.05):
    centres = np.random.default_rng(1).normal(size=(clusters, dims))
    return (centres[rng.integers(0, clusters, n)] + rng.normal(size=(n, dims)) * spread).tolist()


def by_hand(rows, probes):
    a, b = (np.array(x) / np.linalg.norm(x, axis=1, keepdims=True) for x in (rows, probes))
    cosines = a @ b.T
    return cosines.max(1), cosines


@pytest.mark.parametrize("kind", ["clustered", "spread out"])
def test_same_as_every_pair(spark, kind):
    rng = np.random.default_rng(2)
    rows, probes = (clustered(rng, n, 30) if kind == "clustered" else rng.normal(size=(n, 16)).tolist() for n in (400, 300))
    probes[7] = probes[3]  # equals: the lesser name wins
    best, cosines = by_hand(rows, probes)
    left = spark.createDataFrame(pd.DataFrame({"id": range(len(rows)), "vec": rows}))
    right = spark.createDataFrame(pd.DataFrame({"probe": range(len(probes)), "pvec": probes}))
    got = {r.id: r for r in search.looked_at(left, right, "id").collect()}
    assert len(got) == len(rows)
    for k, r in got.items():
        assert abs(r.cosine - best[k]) < 1e-9 and abs(cosines[k, r.nearest] - best[k]) < 1e-9 and r.nearest != 7 and r.pairs <= len(probes)


def test_share_of_pairs_falls_with_size(spark):
    shares = []
    for n in (100, 400, 1600):
        rng = np.random.default_rng(3)
        rows, probes = clustered(rng, 300, n // 20), clustered(rng, n, n // 20)
        left = spark.createDataFrame(pd.DataFrame({"id": range(300), "vec": rows}))
        right = spark.createDataFrame(pd.DataFrame({"probe": range(n), "pvec": probes}))
        pairs = search.looked_at(left, right, "id").toPandas().pairs.sum()
        shares.append(pairs / (300 * n))
    assert shares[0] > shares[1] > shares[2] and shares[2] < 0.1


def test_no_direction_no_rows_one_probe(spark):
    left = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (1, [1.0, 0.0])], "id int, vec array<double>")
    right = spark.createDataFrame([("a", [3.0, 0.0]), ("b", [0.0, 0.0]), ("c", None)], "probe string, pvec array<double>")
    assert [(r.id, round(r.cosine, 9), r.nearest) for r in search.nearest(left, right, "id").collect()] == [(1, 1.0, "a")]
    assert search.nearest(left, right.limit(0), "id").count() == 0
    assert search.nearest(left.limit(0), right, "id").count() == 0


def test_copies_are_compared_once(spark, monkeypatch):
    """Vectors without clusters in many dimensions, each under fifty names: small blocks, the least name, and no more products than distinct vectors."""
    monkeypatch.setattr(search, "CELL_PACK", 4)
    monkeypatch.setattr(search, "ROW_BLOCK", 16)
    rng = np.random.default_rng(4)
    rows, probes = rng.normal(size=(120, 64)).tolist(), rng.normal(size=(40, 64)).tolist()
    best, cosines = by_hand(rows, probes)
    left = spark.createDataFrame(pd.DataFrame({"id": range(120), "vec": rows}))
    right = spark.createDataFrame(pd.DataFrame({"probe": range(2000), "pvec": probes * 50}))
    got = {r.id: r for r in search.looked_at(left, right, "id").collect()}
    assert len(got) == 120
    for k, r in got.items():
        assert abs(r.cosine - best[k]) < 1e-9 and r.nearest == int(cosines[k].argmax()) and r.pairs <= 40
