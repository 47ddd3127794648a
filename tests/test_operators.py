"""Hand-made edge cases of the operators."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from swathe.operators import corridor, events, labels, linear, pixels, ranks, sampling, search, spatial, tables


def test_weighted_median_is_the_lower_one_for_equal_weights(spark):
    df = spark.createDataFrame([("a", v, 1) for v in (1.0, 2.0, 4.0, 8.0)] + [("b", None, 1)], "g string, v double, w int")
    assert [tuple(r) for r in corridor.weighted_median(df, ["g"], "v", "w").collect()] == [("a", 4, 2.0)]


def test_bootstrap_of_two_has_no_interval(spark):
    df = spark.createDataFrame([("a", "s", "1", 1.0, 1), ("a", "s", "2", 2.0, 1)], "g string, st string, id string, v double, w int")
    assert corridor.bootstrap(df, ["g"], "st", "id", "v", "w", 10).first()["lo95"] is None


def test_one_image_wins_ties_by_name(spark):
    df = spark.createDataFrame([("u", 1, 0, "b", 5), ("u", 1, 0, "a", 5)], "u string, pass_date int, orbit int, image string, n int")
    assert [r["image"] for r in corridor.one_image_per_pass(df, "u").collect()] == ["a"]


def test_rows_alike_in_pixels_and_value_stand_by_their_day(spark):
    rows = [("u", "0-50", 41, 1, 0, 5, 0.5, day) for day in (9, 3, 7)]
    for given in (rows, rows[::-1], rows[1:] + rows[:1]):
        df = spark.createDataFrame(given, "segment_id string, ring string, landcover int, pass_date int, orbit int, n long, m double, doy int").coalesce(1)
        assert [r.doy for r in corridor.one_row_per_class_pass(df).collect()] == [3]


def test_unique_or_fail(spark):
    df = spark.createDataFrame([(1,), (1,)], "k int")
    with pytest.raises(Exception, match="twice"):
        corridor.unique_or_fail(df, ["k"]).collect()


def test_fips_never_cuts(spark):
    df = spark.createDataFrame([("7",), ("1234",)], "c string")
    assert [r[0] for r in df.select(labels.fips(F.col("c"))).collect()] == ["48007", "481234"]


def test_diameter_bins(spark):
    df = spark.createDataFrame([("4.5",), ("0",), ("x",), ("36",), (None,)], "c string")
    assert [r[0] for r in df.select(labels.diameter_class(F.col("c"))).collect()] == ["4.5-8.6 in", "Not recorded", "Not recorded", "Over 36 in", "Not recorded"]


def test_normalized_masks_negative_and_zero(spark):
    df = spark.createDataFrame([(0.0, 0.0), (-1.0, 2.0), (3.0, 1.0)], "a double, b double")
    assert [r[0] for r in df.select(pixels.normalized(F.col("a"), F.col("b"))).collect()] == [None, None, 0.5]


@pytest.mark.parametrize("sizes", [[100, 50, 2, 1], [7], [3, 3, 3], [1000, 999, 10, 5, 5, 1]])
def test_allocation_by_a_scan_of_scales(spark, sizes):
    """The least scale at which rounded shares, kept between the floor and the size, add up to the total."""
    rows = spark.createDataFrame([(f"s{k}", n) for k, n in enumerate(sizes)], "stratum string, n long")
    got = {r["stratum"]: r["given"] for r in sampling.allocation(rows, "stratum", "n", 30, 3).collect()}
    given = lambda t: [max(min(3, n), min(n, math.floor(n * t + 0.5))) for n in sizes]
    scales = sorted({0.0} | {(k + 0.5) / n for n in sizes for k in range(n)})
    want = next((given(t + 1e-12) for t in scales if sum(given(t + 1e-12)) >= 30), given(2.0))
    assert [got[f"s{k}"] for k in range(len(sizes))] == want


@pytest.mark.parametrize(("given", "first", "second", "want"), [(1, 5, 5, 0), (2, 5, 5, 1), (4, 0, 9, 0), (4, 3, 0, 3), (6, 2, 9, 2), (9, 9, 2, 8), (3, 1, 50, 1)])
def test_split_between_two_groups(spark, given, first, second, want):
    assert spark.range(1).select(sampling.split_given(F.lit(given), F.lit(first), F.lit(second), 2.0)).first()[0] == want


def test_numbers_sums_and_quantiles_over_parts(spark):
    """One group holds nearly all rows, many of them equal; numbers, ranks and quantiles are those of a sort."""
    values = [float(k % 37) for k in range(900)] + [None] * 3
    df = spark.createDataFrame([("a", k, v) for k, v in enumerate(values)] + [("b", 1000, 5.0), (None, 1001, 7.0)], "g string, k int, v double").repartition(7)
    got = ranks.numbered(df, ["g"], ["k"], "n").collect()
    assert sorted((r["g"] or "", r["k"], r["n"], r["n_total"]) for r in got) == sorted([("a", k, k + 1, 903) for k in range(903)] + [("b", 1000, 1, 1), ("", 1001, 1, 1)])
    points = {r["g"]: (r["low"], r["high"]) for r in ranks.quantiles(df, ["g"], "v", {"low": 0.3, "high": 0.95}).collect()}
    ordered = sorted(v for v in values if v is not None)
    between = lambda q: (ordered[math.floor((len(ordered) - 1) * q)], ordered[math.ceil((len(ordered) - 1) * q)])
    for q, x in zip((0.3, 0.95), points["a"], strict=True):
        low, high = between(q)
        assert low <= x <= high
    assert points["b"] == (5.0, 5.0) and points[None] == (7.0, 7.0)
    averaged = {r["k"]: r["avg_rank"] for r in ranks.average_ranks(df.where("g = 'a'"), "v").collect()}
    assert averaged[0] == averaged[37] and sum(averaged.values()) == 900 * 901 / 2 and len(averaged) == 900


def test_signed_rank_by_all_sign_patterns(spark):
    values = [0.3, -1.2, 2.5, 0.7, -0.1, 4.0, 3.3]
    order = sorted(map(abs, values))
    signed = {v: order.index(abs(v)) + 1 for v in values}
    w = min(sum(r for v, r in signed.items() if v > 0), sum(r for v, r in signed.items() if v < 0))
    sums = [sum(k + 1 for k in range(7) if m >> k & 1) for m in range(1 << 7)]
    got = events.signed_rank(spark.createDataFrame([(v,) for v in values], "v double"), "v").first()
    assert (got["n"], got["w"]) == (7, w) and abs(got["p"] - min(1, 2 * sum(x <= w for x in sums) / 128)) < 1e-12
    tied = events.signed_rank(spark.createDataFrame([(v,) for v in (1.0, -1.0, 2.0, 0.0, None)], "v double"), "v").first()
    assert (tied["n"], tied["w"]) == (3, 1.5) and 0 < tied["p"] <= 1
    assert events.signed_rank(spark.createDataFrame([(0.0,)], "v double"), "v").first()["p"] is None


def sites_and_passes(spark):
    """One event: four candidates of which two match, one other spill nearby, one of another soil; two springs before, one after."""
    sites = [(1, 0, "spill", 0, True, False), (1, 1, "candidate", -500, True, False), (1, 2, "candidate", 500, True, False), (1, 3, "candidate", 1000, True, True), (1, 4, "candidate", 1500, True, False), (2, 0, "spill", 0, True, False)]
    traits = [(1, 0, 5.0, 1.0, 1, 41), (1, 1, 7.0, 1.0, 1, 41), (1, 2, 5.0, 1.0, 1, 41), (1, 3, 5.0, 1.0, 1, 41), (1, 4, 5.0, 1.0, 2, 41), (2, 0, 5.0, None, 1, 41)]
    passes = [(1, k, "spill" if k == 0 else "candidate", y, 1, 0, v, 30) for y, vs in ((1996, (5.0, 1.0, 3.0, 90.0)), (1997, (6.0, 2.0, 2.0, 90.0)), (1999, (1.0, 1.0, 1.0, 90.0))) for k, v in enumerate(vs)]
    return (
        spark.createDataFrame(sites, "event_no long, site_k long, site string, offset_m int, same_ecoregion boolean, other_within_1km boolean"),
        spark.createDataFrame(traits, "event_no long, site_k long, hand_m double, slope_deg double, soil int, landcover int"),
        spark.createDataFrame(passes, "event_no long, site_k long, site string, year int, qtr int, orbit int, v double, n long"),
        spark.createDataFrame([(1, "1998-04-15")], "event_no long, d string").select("event_no", F.to_date("d").alias("event_date")),
    )


def test_only_matched_spots_are_compared(spark):
    sites, traits, passes, when = sites_and_passes(spark)
    judged = events.reasons(sites, traits)
    assert {(r["event_no"], r["site_k"]): r["reason"] for r in judged.collect()} == {(1, 1): "", (1, 2): "", (1, 3): "another spill within 1 km", (1, 4): "other soil texture", (2, 0): "spill site not measured"}
    matched = events.matches(judged)
    assert sorted(r["site_k"] for r in matched.collect()) == [1, 2]
    effect = events.effects(events.event_springs(events.same_pass(passes, matched), when)).first()
    assert (effect["e1"], effect["n_before"], effect["n_after"]) == (0.0 - (3.0 + 4.0) / 2, 2, 1)
    fakes = {r["site_k"]: r["e1"] for r in events.fakes_same_line(passes, matched, when).collect()}
    assert fakes == {1: 0.0 - (-2.0 + 0.0) / 2, 2: 0.0 - (2.0 + 0.0) / 2}
    moved = events.effects(events.event_springs(events.same_pass(passes, matched), events.earlier(when))).first()
    assert moved["e1"] is None  # nothing was measured before 1996


def test_three_a_side_and_ten_regional(spark):
    rows = [(1, k, "candidate", (k - 8) * 500, "") for k in range(17) if k != 8] + [(1, 100 + k, "regional", None, "") for k in range(30)]
    got = events.matches(spark.createDataFrame(rows, "event_no long, site_k long, site string, offset_m int, reason string")).collect()
    assert sorted(r["offset_m"] for r in got if r["kind"] == "same line") == [-1500, -1000, -500, 500, 1000, 1500] and sum(r["kind"] == "regional" for r in got) == 10


def test_permutation_needs_three_events_with_fakes(spark):
    real = spark.createDataFrame([(k, -5.0) for k in range(4)] + [(9, 100.0)], "event_no long, e1 double")
    fakes = lambda n: spark.createDataFrame([(k, s, float(s)) for k in range(n) for s in (1, 2)], "event_no long, site_k long, e1 double")
    got = events.permutation_p(real, [], fakes(3), 50).first()
    assert got["n"] == 3 and got["p"] == 1 / 51  # event 9 has no fakes, so its value doesn't count
    assert events.permutation_p(real, [], fakes(2), 50).first()["p"] is None


def test_no_divisor_of_zero(spark):
    rows = spark.createDataFrame([("a", 1.0, 0), ("a", 2.0, 4), ("b", 1.0, 0)], "g string, m double, n int")
    assert [tuple(r) for r in corridor.pooled(rows, ["g"]).collect()] == [("a", 2.0, 4)]
    assert tables.share_of_total(spark.createDataFrame([("a", 0.0)], "g string, v double"), ["g"], F.col("v")).first()["amount_pct"] is None
    assert tables.profile(rows.where("false"), "g", "m").first()["blank_pct"] is None
    vectors = spark.createDataFrame([(1, [0.0, 0.0]), (2, [3.0, 4.0])], "place_id int, vec array<double>")
    assert {r["place_id"]: r["u"] for r in vectors.select("place_id", search.unit(F.col("vec")).alias("u")).collect()} == {1: None, 2: [0.6, 0.8]}
    probe = vectors.select(F.col("place_id").alias("probe"), F.col("vec").alias("pvec"))
    assert [(r["place_id"], r["nearest"]) for r in search.nearest(vectors, probe, "place_id").collect()] == [(2, 2)]
    line = spark.createDataFrame([("l", 0, 0.0, 0.0), ("l", 1, 0.0, 0.0), ("l", 2, 10.0, 0.0)], "line_uid string, seq int, x double, y double")
    points = spark.createDataFrame([("p", 3.0, 4.0, 7.0), ("q", 3.5, 4.0, 7.0)], "id string, x double, y double, v double")
    assert {r["id"]: r["dist"] for r in spatial.nearest_line(points, spatial.edges(line), "id", 50.0).collect()} == {"p": 4.0, "q": 4.0}
    assert [r["z"] for r in spatial.getis_ord(points, "id", "v", 3.0).collect()] == [None, None]


def test_probes_in_parts_give_the_same(spark, monkeypatch):
    rows = spark.createDataFrame([(k, [math.cos(k), math.sin(k)]) for k in range(40)], "place_id int, vec array<double>")
    probes = spark.createDataFrame([(k, [math.cos(3 * k + 0.1), math.sin(3 * k + 0.1)]) for k in range(15)], "probe int, pvec array<double>")
    whole = {r["place_id"]: (r["nearest"], round(r["cosine"], 12)) for r in search.nearest(rows, probes, "place_id").collect()}
    monkeypatch.setattr(search, "PACK", 4)
    assert {r["place_id"]: (r["nearest"], round(r["cosine"], 12)) for r in search.nearest(rows, probes, "place_id").collect()} == whole and len(whole) == 40
    assert search.against(rows, probes).count() == 600


def test_quotes_and_numbers(spark):
    said = spark.createDataFrame([("yes", "", "x"), ("unknown", "", "x"), (None, None, None), ("yes", " Soil-REMOVED ", "the soil removed."), ("no", "gone", "x")], "a string, q string, t string")
    assert [r[0] for r in said.select(search.supported(F.col("a"), F.col("q"), F.col("t"))).collect()] == [False, True, True, True, False]
    cases = [
        ("It was 1,234 units in 2024.", "1234.4", 1, []), ("It was 1234 in 1999.", "1234", 2, ["1999"]), ("25% of it", "share 0.25", 1, []), ("25 of it", "share 0.25", 1, ["25"]), ("3.9e-04", "0.00039", 1, []),
        ("-0.5 and +0.5", "0.52", 2, []), ("0.50", "0.52", 1, ["0.50"]), ("S123 of 001-000001-02-3-4", "", 0, []), ("x12 y", "", 0, []),
    ]
    df = spark.createDataFrame([(k, a, e) for k, (a, e, _, _) in enumerate(cases)], "k int, a string, e string")
    got = {r["k"]: (r["x"]["checked"], r["x"]["unsupported"]) for r in df.select("k", search.number_check(F.col("a"), F.col("e")).alias("x")).collect()}
    assert got == {k: (n, bad) for k, (_, _, n, bad) in enumerate(cases)}


def test_last_tile_wins_in_each_pixel(spark):
    px = spark.createDataFrame([("z", 1, 1, 1, 0, 0, 0.1, 10.0), ("z", 1, 1, 1, 0, 1, 0.9, 20.0), ("z", 1, 2, 1, 0, 0, 0.5, 10.0)], "zone string, px int, py int, dt int, orbit int, tile int, v double, sun double")
    got = {r["py"]: (r["v"], r["tiles"], r["sun"]) for r in pixels.mosaic(px, ["zone", "px", "py"], "v", "sun").collect()}
    assert got == {1: (0.9, "0,1", 15.0), 2: (0.5, "0,1", 15.0)}


def test_regression_errors_by_hand(spark):
    """Two terms and a category, with errors, interval and fit as numpy gives them."""
    rng = np.random.default_rng(3)
    x, kind = rng.normal(size=60), rng.integers(0, 3, 60)
    y = 1 + 2 * x + (kind == 1) * 3 + rng.normal(size=60) * (1 + np.abs(x))
    df, terms = linear.design(spark.createDataFrame([(float(a), f"k{b}", float(c)) for a, b, c in zip(x, kind, y, strict=True)], "x double, kind string, y double"), "y", ["x", "kind"])
    assert terms == ["x", "kind=k1", "kind=k2"]
    names = terms[1:]
    fit = {r["term"]: r for r in linear.robust_fit(df, "y", ["x", *names])}
    m = np.column_stack([np.ones(60), x, kind == 1, kind == 2]).astype(float)
    inverse = np.linalg.inv(m.T @ m)
    beta = inverse @ m.T @ y
    e, h = y - m @ beta, np.einsum("ij,jk,ik->i", m, inverse, m)
    se = np.sqrt(np.diag(inverse @ (m.T * (e / (1 - h)) ** 2) @ m @ inverse))
    for k, term in enumerate(["intercept", "x", *names]):
        assert np.allclose([fit[term]["estimate"], fit[term]["se"], fit[term]["hi95"]], [beta[k], se[k], beta[k] + 1.959964 * se[k]])
    assert abs(fit["x"]["r2"] - (1 - (e @ e) / ((y - y.mean()) ** 2).sum())) < 1e-9 and fit["x"]["p"] < 0.01


def test_terms_of_a_model(spark):
    """Logarithms with a floor, flags, levels of the rows that count, products; rows without a term don't count."""
    rows = [(1.0, 0.5, "b", True, 2.0), (2.0, 100.0, "a", False, 3.0), (3.0, 1000.0, "c", True, None), (4.0, 10.0, "a", True, 5.0), (None, 10.0, "d", True, 5.0)]
    table, terms = linear.design(spark.createDataFrame(rows, "y double, barrels double, kind string, dug boolean, hand double"), "y", ["log_barrels", "kind", "dug", "hand", "kind:dug", "dug:hand"], {"barrels": 1.0})
    assert terms == ["log_barrels", "kind=b", "dug", "hand", "kind=b:dug", "dug:hand"]
    assert sorted(tuple(r) for r in table.collect()) == [(1.0, 0.0, 1.0, 1.0, 2.0, 1.0, 2.0), (2.0, 2.0, 0.0, 0.0, 3.0, 0.0, 0.0), (4.0, 1.0, 0.0, 1.0, 5.0, 0.0, 5.0)]
    many = spark.range(300).selectExpr("double(id) y", "string(id) kind")
    with pytest.raises(ValueError, match="more than"):
        linear.design(many, "y", ["kind"])
    # a column that others add up to leaves the fit as it is
    twice = spark.createDataFrame([(float(k), float(k % 7), 2.0 * (k % 7)) for k in range(30)], "y double, a double, b double")
    assert np.isfinite([r["estimate"] for r in linear.robust_fit(twice, "y", ["a", "b"])]).all()


def test_every_check_can_fail(spark):
    """Each registered check agrees on the data, and no longer does when one of the answer's values is changed."""
    from swathe.operators import tables as T
    from swathe.plans import checks

    d = "/root/testdata/sf0.001"
    assert set(checks.CHECKS) == {"corridor summary", "distance profile", "segment record", "event effect", "event summary", "left out", "hot spots"}
    for name, (key, values, fn) in checks.CHECKS.items():
        first, second = fn(spark, d)
        rows = [r.asDict() for r in first.collect()]
        whole = T.agreement(name, spark.createDataFrame([tuple(r[c] for c in first.columns) for r in rows], first.schema), second, key, values).first()
        assert whole.items == whole.agree == len(rows) > 0
        k = next(k for k, r in enumerate(rows) if r[values[-1]] is not None)
        rows[k][values[-1]] += 1
        changed = spark.createDataFrame([tuple(r[c] for c in first.columns) for r in rows], first.schema)
        assert T.agreement(name, changed, second, key, values).first().agree == len(rows) - 1
        less = T.agreement(name, changed.limit(0), second, key, values).first()
        assert (less.items, less.agree) == (len(rows), 0)


def test_answers_with_alternatives(spark):
    cases = [
        ("About 1,234.56 km", [(None, 1234.56, 2)], True), ("About 1,234.57 km", [(None, 1234.56, 2)], False), ("it fell by 0.0312", [(None, -0.03124, 4)], True), ("it fell by 0.0313", [(None, -0.03124, 4)], False),
        ("exactly half: 0.5", [(None, 1.0, 0)], True), ("−3.9e-04", [(None, 0.00039, 5)], True), ("The Right–of-Way", [("right-of-way", None, 0)], True), ("none", [("some", None, 0), (None, 3.0, 0)], False),
        ("we saw 3", [("some", None, 0), (None, 3.0, 0)], True), (None, [("x", None, 0)], False), ("x", [], False),
    ]
    df = spark.createDataFrame([(k, a, e) for k, (a, e, _) in enumerate(cases)], "k int, a string, e array<struct<word:string,value:double,places:int>>")
    assert {r["k"]: r["x"] for r in df.select("k", search.expected_in(F.col("a"), F.col("e")).alias("x")).collect()} == {k: want for k, (_, _, want) in enumerate(cases)}


def test_known_ids_of_two_kinds(spark):
    rows = spark.createDataFrame([(1, "S001 S002 xS001 S0011 001-000001-02-3-4 S002"), (2, "none"), (3, None)], "k int, t string")
    known = spark.createDataFrame([("S002",), ("S001",), ("S002",), ("S003",)], "id string")
    assert [(r.k, r.ids) for r in search.known_ids(rows, "k", "t", r"\bS\d{3}\b", known).collect()] == [(1, ["S001", "S002"])]
    assert search.known_ids(rows, "k", "t", r"\bS\d{3}\b", known, 1).first().ids == ["S001"]


def test_fields_with_their_quotes(spark):
    rows = spark.createDataFrame([(1, "The farmer found OIL.", "landowner", "yes", "farmer FOUND", "river")], "n int, text string, how string, water string, q1 string, q2 string")
    got = {r.field: (r.answer, r.quote, r.supported) for r in search.evidence(rows, "n", {"how": "q1", "water": "q2"}, "text").collect()}
    assert got == {"how": ("landowner", "farmer FOUND", True), "water": ("yes", "river", False)}


def test_sets_match_whatever_their_order(spark):
    found = spark.createDataFrame([(["a", "b"],), (["b", "a"],), (["a"],), ([],)], "members array<string>")
    recorded = spark.createDataFrame([(["b", "a", "a"],), (["c"],), ([],), ([],)], "members array<string>")
    got = {tuple(r.members): (r.found, r.recorded) for r in spatial.match_sets(found, recorded).collect()}
    assert got == {("a", "b"): (True, True), ("a",): (True, False), ("c",): (False, True), (): (True, True)}
    keys = [tuple(r[0]) for r in found.select(spatial.set_key(F.col("members"))).collect()]
    assert keys[0] == keys[1] and len(set(keys)) == 3


def test_parts_joined_end_to_end():
    from swathe.plans.spatial import away, merge_parts

    assert merge_parts([(1, 0, 0, 0), (1, 0, 2, 0), (5, 0, 4, 0)]) == [[(0, 0), (1, 0), (2, 0)], [(4, 0), (5, 0)]]
    assert merge_parts([(0, 0, 1, 0), (1, 0, 2, 0), (1, 0, 1, 5)]) == [[(0, 0), (1, 0)], [(1, 0), (1, 5)], [(1, 0), (2, 0)]]  # no way goes on where three meet
    assert away((3, 4), [(0, 0), (0, 0), (10, 0)]) == 4


def test_most_and_least_negative_groups(spark):
    from swathe.plans.corridor import with_ends

    rows = [("r", "a", 5, -2.0, -3.0, -1.0), ("r", "b", 5, 0.0, -0.5, 0.5), ("r", "c", 2, -9.0, None, None), ("s", "a", 5, 1.0, 0.0, 2.0)]
    got = {(r["ring"], r["ecoregion"]): (r["most_negative"], r["least_negative"], r["overlap"]) for r in with_ends(spark.createDataFrame(rows, "ring string, ecoregion string, segments int, wmed double, lo95 double, hi95 double"), 3).collect()}
    assert got[("r", "c")] == ("a", "b", False) and got[("s", "a")] == (None, None, None)


def test_each_member_draws_others_of_its_group(spark):
    df = spark.createDataFrame([("g", f"k{n}") for n in range(200)] + [("h", "x"), ("i", "y"), ("i", "z")], "g string, k string")
    got = spatial.draw_from_group(df, ["g"], "k", 50, 5).collect()
    by = {}
    for r in got:
        by.setdefault(r["k"], set()).add(r["other"])
    assert all(len(by[f"k{n}"]) == 50 and f"k{n}" not in by[f"k{n}"] for n in range(200)) and "x" not in by and by["y"] == {"z"}
    assert len(got) == 200 * 50 + 2


def test_scratch_needs_a_shared_folder(spark):
    from swathe.sources import files

    class Cluster:
        conf = type("Conf", (), {"get": staticmethod(lambda k, d=None: d)})
        sparkContext = type("Context", (), {"master": "spark://host:7077"})

    with pytest.raises(ValueError, match="checkpoint"):
        files.scratch(Cluster(), "x")
    Cluster.sparkContext.master = "local[2]"
    assert files.scratch(Cluster(), "x").startswith("file:///")  # one machine has its own folder
    df = files.written(spark.range(3), "gone")
    path = files.WRITTEN[-1]
    files.drop(spark, path)
    assert path not in files.WRITTEN
    with pytest.raises(Exception, match="(?i)not|exist"):
        df.count()
    files.drop(spark, "file:///root/testdata")  # nothing that wasn't given out


def test_point_on_an_l_shaped_line(spark):
    line = spark.createDataFrame([("l", 0, 0.0, 0.0), ("l", 1, 100.0, 0.0), ("l", 2, 100.0, 100.0)], "line_uid string, seq int, x double, y double")
    points = spark.createDataFrame([("p", 90.0, 20.0), ("q", -500.0, 0.0)], "id string, x double, y double")
    got = [tuple(r) for r in spatial.nearest_line(points, spatial.edges(line), "id", 50.0).collect()]
    assert got == [("p", "l", 10.0, 120.0)]


def test_projection_round_trip(spark):
    df = spark.createDataFrame([(-97.5, 30.25), (-100.0, 18.0)], "lon double, lat double")
    x, y = spatial.albers(F.col("lon"), F.col("lat"))
    lon, lat = spatial.lonlat(F.col("x"), F.col("y"))
    for r in df.select("lon", "lat", x.alias("x"), y.alias("y")).select("lon", "lat", "x", "y", lon.alias("a"), lat.alias("b")).collect():
        assert math.isclose(r["lon"], r["a"], abs_tol=1e-9) and math.isclose(r["lat"], r["b"], abs_tol=1e-9)
        if r["lon"] == -100.0:
            assert math.isclose(r["x"], 1_500_000, abs_tol=1e-6) and math.isclose(r["y"], 6_000_000, abs_tol=1e-6)


def test_concave_polygon(spark):
    corners = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (5.0, 4.0), (0.0, 10.0)]
    edges = [("r", *a, *b) for a, b in zip(corners, corners[1:] + corners[:1], strict=True)]
    df = spark.createDataFrame(edges, "region string, x1 double, y1 double, x2 double, y2 double")
    points = spark.createDataFrame([("in", 2.0, 3.0), ("notch", 5.0, 8.0), ("out", 11.0, 1.0)], "id string, x double, y double")
    assert [r["id"] for r in spatial.inside(points, df, "id", 3.0).collect()] == ["in"]


def test_equality_with_tolerance(spark):
    a = spark.createDataFrame([(1, 1.0), (2, float("nan")), (3, 5.0)], "k int, v double")
    b = spark.createDataFrame([(1, 1.0 + 1e-12), (2, float("nan")), (4, 5.0)], "k int, v double")
    assert sorted(r["k"] for r in tables.same_rows(a, b, ["k"], ["v"]).collect()) == [3, 4]


def test_regression_recovers_a_line(spark):
    df = spark.createDataFrame([(float(k), 2.0 + 3.0 * k) for k in range(20)], "x double, y double")
    fit = {r["term"]: r for r in linear.robust_fit(df, "y", ["x"])}
    assert abs(fit["x"]["estimate"] - 3) < 1e-9 and abs(fit["intercept"]["estimate"] - 2) < 1e-9
    assert linear.robust_fit(df.limit(5), "y", ["x"]) == []


def test_no_spring_after_means_no_effect(spark):
    df = spark.createDataFrame([(1, 2000, 0.5, "before", -1)], "event_no int, year int, d double, status string, years_from_event int")
    assert events.effects(df).first()["e1"] is None
