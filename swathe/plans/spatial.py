"""Queries of lines, points, bands and hot spots."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import spatial as S
from ..registry import query
from .corridor import LABELS, labelled
from .fixtures import twin, view

c = F.col


def N():
    return F.count(F.lit(1))

EDGES = {
    "e0": "select line_uid, seq, x x1, y y1, lead(x) over w x2, lead(y) over w y2 from line_vertices window w as (partition by line_uid order by seq)",
    "ed": "select *, sqrt((x2-x1)*(x2-x1)+(y2-y1)*(y2-y1)) len, ((x2-x1)*(x2-x1)+(y2-y1)*(y2-y1)) l2 from e0 where x2 is not null",
    "el": "select *, sum(len) over (partition by line_uid order by seq rows unbounded preceding)-len as start from ed",
    "ll": "select line_uid, sum(len) total from el group by 1",
}
T = "least(greatest(((p.x-e.x1)*(e.x2-e.x1)+(p.y-e.y1)*(e.y2-e.y1))/e.l2,0),1)"
DIST = f"sqrt((p.x-(e.x1+{T}*(e.x2-e.x1)))*(p.x-(e.x1+{T}*(e.x2-e.x1)))+(p.y-(e.y1+{T}*(e.y2-e.y1)))*(p.y-(e.y1+{T}*(e.y2-e.y1))))"


def lines(spark, d):
    return S.edges(view(spark, d, "line_vertices"))


def points(spark, d):
    return view(spark, d, "spill_points")


@query("g1_albers", f"select c_custkey, round({S.EAST}::double+rho*sin(theta),4) as x, round({S.NORTH}::double+{S.RHO0!r}::double-rho*cos(theta),4) as y from (select c_custkey, sqrt({S.CONST!r}::double-{S.CONE!r}::double*(1-{S.ECC2!r}::double)*(s/(1-{S.ECC2!r}::double*s*s)-ln((1-{S.ECC!r}::double*s)/(1+{S.ECC!r}::double*s))/(2*{S.ECC!r}::double)))*{S.AXIS / S.CONE!r}::double rho, {S.CONE!r}::double*(radians(lon)-({S.LON0!r}::double)) theta from (select c_custkey, sin(radians(26+c_custkey%1000/cast(100 as double))) s, -106+c_custkey%1300/cast(100 as double) lon from customer))")
def _(spark, d):
    x, y = S.albers(-106 + c("c_custkey") % 1300 / 100, 26 + c("c_custkey") % 1000 / 100)
    from .fixtures import table

    return table(spark, d, "customer").select("c_custkey", F.round(x, 4).alias("x"), F.round(y, 4).alias("y"))


@query("g32_lonlat", "select c_custkey, round(-106+c_custkey%1300/cast(100 as double),6) as lon, round(26+c_custkey%1000/cast(100 as double),6) as lat from customer")
def _(spark, d):
    from .fixtures import table

    x, y = S.albers(-106 + c("c_custkey") % 1300 / 100, 26 + c("c_custkey") % 1000 / 100)
    lon, lat = S.lonlat(c("x"), c("y"))
    return table(spark, d, "customer").select("c_custkey", x.alias("x"), y.alias("y")).select("c_custkey", F.round(lon, 6).alias("lon"), F.round(lat, 6).alias("lat"))


@query("g2_line_length", twin("select line_uid, round(total,6) as metres, round(total/1000,9) as km from ll", **EDGES))
def _(spark, d):
    return lines(spark, d).groupBy("line_uid").agg(F.sum("len").alias("t")).select("line_uid", F.round("t", 6).alias("metres"), F.round(c("t") / 1000, 9).alias("km"))


PIECES = EDGES | {"pc": "select line_uid, k piece, k*1000.0::double f, least((k+1)*1000.0::double,total) t from (select line_uid, total, unnest(range(0, cast(ceil(total/1000) as bigint))) k from ll) where least((k+1)*1000.0::double,total)-k*1000>=1"}


def pieces(spark, d):
    """Pieces of at most 1 km, the last one shorter; pieces under 1 m are dropped."""
    total = lines(spark, d).groupBy("line_uid").agg(F.sum("len").alias("total"), F.max("seq").alias("last"))
    rows = total.withColumn("piece", F.explode(F.sequence(F.lit(0), F.ceil(c("total") / 1000).cast("int") - 1))).withColumns({"f": c("piece") * 1000.0, "t": F.least((c("piece") + 1) * 1000.0, c("total"))})
    return rows.where(c("t") - c("f") >= 1)


@query("g3_cut_pieces", twin("select line_uid, piece, f as from_m, round(t,6) as to_m, round(t-f,6) as piece_m from pc", **PIECES))
def _(spark, d):
    return pieces(spark, d).select("line_uid", "piece", c("f").alias("from_m"), F.round("t", 6).alias("to_m"), F.round(c("t") - c("f"), 6).alias("piece_m"))


@query("g6_interpolate", twin("select p.line_uid, p.piece, round(e.x1+((p.f+p.t)/2-e.start)/e.len*(e.x2-e.x1),6) as x, round(e.y1+((p.f+p.t)/2-e.start)/e.len*(e.y2-e.y1),6) as y from pc p join el e on p.line_uid=e.line_uid and (p.f+p.t)/2>=e.start and (p.f+p.t)/2<e.start+e.len", **PIECES))
def _(spark, d):
    rows = pieces(spark, d).withColumn("at", (c("f") + c("t")) / 2)
    return S.along(lines(spark, d), rows).select("line_uid", "piece", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


NEAR = EDGES | {"nr": f"select p.spill_id, e.line_uid, e.seq, {DIST} dist, e.start+{T}*e.len as at_m from spill_points p, el e where {DIST}<=2000", "best": "select * from (select *, row_number() over (partition by spill_id order by dist, line_uid, seq) rn from nr) where rn=1"}


@query("g13_nearest_line", twin("select spill_id, line_uid, round(dist,6) as dist from best", **NEAR))
def _(spark, d):
    return S.nearest_line(points(spark, d), lines(spark, d), "spill_id", 2000.0).select("spill_id", "line_uid", F.round("dist", 6).alias("dist"))


@query("g7_locate_on_line", twin("select spill_id, line_uid, round(at_m,6) as at_m from best", **NEAR))
def _(spark, d):
    return S.nearest_line(points(spark, d), lines(spark, d), "spill_id", 2000.0).select("spill_id", "line_uid", F.round("at", 6).alias("at_m"))


@query("g8_distance_bands", twin("select ring, count(*) as points from (select spill_id, line_uid, case when min(dist)<250 then '0-250' when min(dist)<500 then '250-500' when min(dist)<1000 then '500-1000' when min(dist)<2000 then '1000-2000' end ring from nr2 group by 1,2) where ring is not null group by 1", **(NEAR | {"fe": f"select line_uid, max(seq) last from el group by 1", "nr2": f"select n.* from (select p.spill_id, e.line_uid, e.seq, {DIST} dist, ((p.x-e.x1)*(e.x2-e.x1)+(p.y-e.y1)*(e.y2-e.y1))/e.l2 raw from spill_points p, el e where {DIST}<=2000) n join fe using (line_uid) where not (seq=0 and raw<0) and not (seq=last and raw>1)"})))
def _(spark, d):
    """Ends are flat: a point before the first or beyond the last edge is in no band of that line."""
    edge = lines(spark, d)
    ends = edge.join(edge.groupBy("line_uid").agg(F.max("seq").alias("last")), "line_uid")

    def keep(x, y, e):
        raw = ((x - e["x1"]) * e["dx"] + (y - e["y1"]) * e["dy"]) / e["l2"]
        return ~((e["seq"] == 0) & (raw < 0)) & ~((e["seq"] == e["last"]) & (raw > 1))

    near = S.near_lines(S.places(points(spark, d), "spill_id"), ends, 2000.0, keep)
    rows = near.withColumn("ring", S.band(c("dist"), [0, 250, 500, 1000, 2000]))
    return rows.where("ring is not null").groupBy("ring").agg(F.sum("n").alias("points"))


OWN = NEAR | {"per": "select spill_id, line_uid, min(dist) d from nr group by 1,2", "any1": "select spill_id, min(d) dmin from per group by 1"}


@query("g9_clean_bands", twin("select line_uid, count(*) as kept from per join any1 using (spill_id) where d>=500 and d<1000 and dmin>=500 group by 1", **OWN))
def _(spark, d):
    """Ground of the outer band stays where no line is nearer than the band's inner edge; only places that far from every line are held against lines."""
    return clear(spark, d)[0].groupBy("line_uid").agg(F.sum("n").alias("kept"))


def clear(spark, d):
    """Places and lines 500 to 1,000 apart where no line is within 500, and all places and edges."""
    edge = S.written(lines(spark, d), "edges").repartition("line_uid")
    spots = S.places(points(spark, d), "spill_id")
    near = S.near_edges(spots, edge, 500.0).where("dist < 500").select("place").distinct()
    return S.near_lines(spots.join(near, "place", "left_anti"), edge, 1000.0).where("dist >= 500 and dist < 1000"), spots, edge


@query("g26_contamination", twin("select count(*) as points, round(avg(case when dmin<500 then 1.0::double else 0 end),9) as share from per join any1 using (spill_id) where d>=500 and d<1000", **OWN))
def _(spark, d):
    """All places and lines 500 to 1,000 apart, and those of them where no line is within 500."""
    clean, spots, edge = clear(spark, d)
    rows = S.near_lines(spots, edge, 1000.0).where("dist >= 500 and dist < 1000")
    counts = rows.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("points")).crossJoin(F.broadcast(clean.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("clean"))))
    return counts.select("points", F.round(F.try_divide((c("points") - c("clean")).cast("double"), c("points")), 9).alias("share"))


@query("g27_overlap_depth", twin("select round(avg(k),9) as mean, median(k) as median, quantile_cont(k,0.9) as p90, count(*) as covered from (select spill_id, count(distinct line_uid) k from nr group by 1)", **NEAR))
def _(spark, d):
    """Places are counted by depth first, so quantiles stand on a few rows."""
    per = S.near_lines(S.places(points(spark, d), "spill_id"), lines(spark, d), 2000.0).groupBy("place", "n").agg(N().alias("k"))
    deep = per.groupBy("k").agg(F.sum("n").alias("n"))
    return deep.agg(F.round(F.sum(c("k") * c("n")) / F.sum("n"), 9).alias("mean"), F.percentile("k", 0.5, c("n")).alias("median"), F.percentile("k", 0.9, c("n")).alias("p90"), F.sum("n").alias("covered"))


#: Pieces on record: what most points lie under, written in the opposite order, and some that no point lies under.
PATTERNS = NEAR | {
    "under": "select spill_id, list_sort(list(distinct line_uid)) members from nr group by 1",
    "kept": "select distinct members from under where cast(substr(spill_id,2) as bigint)%3<>0 union select list_concat(members, ['none']) from under where cast(substr(spill_id,2) as bigint)%7=0",
    "sides": "select f.members f, k.members k from (select distinct members from under) f full join kept k on f.members=k.members",
}


@query("g28_overlap_patterns", twin("select count(f) as patterns, count(k) as recorded, count(*) filter (f is not null and k is not null) as matched, (select count(*) from under) as points from sides", **PATTERNS))
def _(spark, d):
    """Sets of lines that points lie under, the pieces on record, and how many of one are the other, whatever the order of their members."""
    number = F.substring("spill_id", 2, 20).cast("long")
    spots = S.places(points(spark, d), "spill_id", most=F.bool_or(number % 3 != 0), more=F.bool_or(number % 7 == 0))
    under = S.written(S.near_lines(spots, lines(spark, d), 2000.0).groupBy("place", "n", "most", "more").agg(F.collect_list("line_uid").alias("members")), "under")
    recorded = under.where("most").select(F.reverse(F.array_sort("members")).alias("members"))
    recorded = recorded.unionByName(under.where("more").select(F.concat(F.array(F.lit("none")), "members").alias("members")))
    sums = S.match_sets(under, recorded).agg(F.count_if("found").alias("patterns"), F.count_if("recorded").alias("recorded"), F.count_if(c("found") & c("recorded")).alias("matched"))
    return sums.crossJoin(F.broadcast(under.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("points"))))


@query("g29_signed_offset", twin(f"select p.spill_id, e.line_uid, e.seq, round(sign((e.x2-e.x1)*(p.y-e.y1)-(e.y2-e.y1)*(p.x-e.x1))*{DIST},6) as offset_m from spill_points p, el e where {DIST}<=500", **EDGES))
def _(spark, d):
    near = S.near_edges_of_keys(points(spark, d), "spill_id", lines(spark, d), 500.0)
    side = F.signum((c("x2") - c("x1")) * (c("y") - c("y1")) - (c("y2") - c("y1")) * (c("x") - c("x1")))
    offsets = near.select("keys", "line_uid", "seq", F.round(side * c("dist"), 6).alias("offset_m"))
    return offsets.select(F.inline("keys").alias("spill_id"), "line_uid", "seq", "offset_m")


IN = {"ins": "select spill_id, region from (select p.spill_id, r.region, count(*) n from spill_points p, region_edges r where r.y1<>r.y2 and ((r.y1>p.y)<>(r.y2>p.y)) and p.x<(r.x2-r.x1)*(p.y-r.y1)/(r.y2-r.y1)+r.x1 group by 1,2) where n%2=1"}


@query("g14_point_in_polygon", twin("select p.spill_id, i.region from spill_points p left join ins i using (spill_id)", **IN))
def _(spark, d):
    return points(spark, d).select("spill_id").join(S.inside(points(spark, d), view(spark, d, "region_edges"), "spill_id", 5000.0), "spill_id", "left")


@query("g15_within_radius", twin("select a.spill_id, exists(select 1 from spill_points b where b.spill_id<>a.spill_id and (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)<=1000000) as other_within from spill_points a"))
def _(spark, d):
    p = points(spark, d)
    others = p.select(c("spill_id").alias("other"), c("x").alias("x2"), c("y").alias("y2"))
    near = S.pairs_within(p, others, 1000.0, apart=c("spill_id") != c("other"), how="left_semi").select("spill_id", F.lit(True).alias("near"))
    return p.join(near, "spill_id", "left").select("spill_id", F.coalesce("near", F.lit(False)).alias("other_within"))


@query("g16_comparison_spots", twin("select spill_id, line_uid, o as offset_m, round(at_m+o,6) as at_m from best join ll using (line_uid), (select unnest([-3000,-2500,-2000,-1500,-1000,-500,500,1000,1500,2000,2500,3000]) o) where at_m+o>=0 and at_m+o<=total", **NEAR))
def _(spark, d):
    total = lines(spark, d).groupBy("line_uid").agg(F.sum("len").alias("total"))
    near = S.nearest_line(points(spark, d), lines(spark, d), "spill_id", 2000.0).join(total, "line_uid")
    rows = near.withColumn("offset_m", F.explode(F.array(*(F.lit(k * 500) for k in range(-6, 7) if k)))).withColumn("at_m", c("at") + c("offset_m"))
    return rows.where("at_m >= 0 and at_m <= total").select("spill_id", "line_uid", "offset_m", F.round("at_m", 6).alias("at_m"))


MD5 = "cast('0x'||substr(md5({0}),1,8) as bigint)"
#: Rings and circles around a site, in units of 20 metres here, where points lie far apart.
RINGS, CIRCLES, UNIT = [(0, 25), (25, 50), (50, 100), (100, 200)], [50, 100], 20
ZONES = [("ring", a, b, f"_r{a}-{b}") for a, b in RINGS] + [("circle", 0, r, f"_c{r}") for r in CIRCLES]


@query("g18_point_rings", twin(f"select a.spill_id||z.tag as zone_id, z.kind as zone_type, count(b.spill_id) as points from spill_points a cross join (values {', '.join(str(z) for z in ZONES)}) as z(kind, low, high, tag) left join spill_points b on a.spill_id<>b.spill_id and sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y))/{UNIT}<z.high and sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y))/{UNIT}>=z.low group by 1,2"))
def _(spark, d):
    """Every site's four rings and two circles with the points in them; a circle is the union of its rings."""
    every = S.counts_within(points(spark, d), "spill_id", {tag: (a, b) for _, a, b, tag in ZONES}, UNIT)
    zones = F.array(*(F.struct(F.concat("spill_id", F.lit(tag)).alias("zone_id"), F.lit(kind).alias("zone_type"), c(f"`{tag}`").alias("points")) for kind, _, _, tag in ZONES))
    return every.select(F.explode(zones).alias("z")).select("z.*")


@query("g31_hot_spots", twin("select spill_id, round(z,6) as z, cast(sign(z)*(case when abs(z)>=2.576 then 3 when abs(z)>=1.96 then 2 when abs(z)>=1.645 then 1 else 0 end) as int) as bin from (select spill_id, (s-mean*w)/(sd*sqrt((n*w-w*w)/(n-1.0::double))) z from (select a.spill_id, sum(b.barrels) s, count(*) w from spill_points a, spill_points b where (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)<=9000000 group by 1), (select count(*) n, avg(barrels) mean, stddev_pop(barrels) sd from spill_points))"))
def _(spark, d):
    return S.getis_ord(points(spark, d), "spill_id", "barrels", 3000.0).withColumn("z", F.round("z", 6))


PROFILE = {"bn": "select zone, px//20 as b, median(b8) v from pixels group by 1,2", "sm": "select zone, b, case when count(*) over w>=3 then avg(v) over w end s from bn window w as (partition by zone order by b rows between 2 preceding and 2 following)"}


def profile(spark, d):
    bins = view(spark, d, "pixels").groupBy("zone", F.expr("px div 20").alias("b")).agg(F.median("b8").alias("v"))
    w = Window.partitionBy("zone").orderBy("b").rowsBetween(-2, 2)
    return bins.withColumn("s", F.when(F.count("v").over(w) >= 3, F.avg("v").over(w)))


@query("w4_centred_mean", twin("select zone, b, round(s,9) as s from sm", **PROFILE))
def _(spark, d):
    return profile(spark, d).select("zone", "b", F.round("s", 9).alias("s"))


@query("g30_profile_trough", twin("select zone, round(base,9) as base, round(low,9) as low, at_b, width from (select zone, any_value(base) base, any_value(low) low, any_value(at_b) at_b, count(*) filter (grp=own_grp and deep) as width from (select *, max(case when b=at_b then grp end) over (partition by zone) own_grp from (select *, sum(case when deep then 0 else 1 end) over (partition by zone order by b rows unbounded preceding) grp from (select *, s<=(base+low)/2 deep from sm join (select zone, median(s) base, min(s) low from sm group by 1) using (zone) join (select zone, min(b) at_b from (select *, min(s) over (partition by zone) m from sm) where s=m group by 1) using (zone)))) group by 1)", **PROFILE))
def _(spark, d):
    """The run of bins at least half as deep as the trough, around its least bin."""
    part = Window.partitionBy("zone")
    rows = profile(spark, d)
    sums = rows.groupBy("zone").agg(F.median("s").alias("base"), F.min("s").alias("low"), F.min_by("b", F.struct("s", "b")).alias("at_b"))
    deep = rows.join(sums, "zone").withColumn("deep", c("s") <= (c("base") + c("low")) / 2)
    grp = deep.withColumn("grp", F.sum(F.when(c("deep"), 0).otherwise(1)).over(part.orderBy("b").rowsBetween(Window.unboundedPreceding, 0)))
    own = grp.withColumn("own", F.max(F.when(c("b") == c("at_b"), c("grp"))).over(part))
    return own.groupBy("zone").agg(F.round(F.first("base"), 9).alias("base"), F.round(F.first("low"), 9).alias("low"), F.first("at_b").alias("at_b"), F.count_if((c("grp") == c("own")) & c("deep")).alias("width"))


def split_by_regions(edge, regions):
    """Parts of each edge between its crossings with region edges, each in the region its middle lies in."""
    e, r = edge, regions.withColumnsRenamed({k: "r" + k for k in ("x1", "y1", "x2", "y2")}).select("rx1", "ry1", "rx2", "ry2")
    dx, dy, rx, ry = c("x2") - c("x1"), c("y2") - c("y1"), c("rx2") - c("rx1"), c("ry2") - c("ry1")
    den = dx * ry - dy * rx
    t, u = F.try_divide((c("rx1") - c("x1")) * ry - (c("ry1") - c("y1")) * rx, den), F.try_divide((c("rx1") - c("x1")) * dy - (c("ry1") - c("y1")) * dx, den)
    size = 5000.0
    cell = lambda a, b, w: F.explode(S.cells(F.least(a, b), F.greatest(a, b), w))
    left = e.withColumn("cy", cell(c("y1"), c("y2"), size))
    right = r.withColumn("cy", cell(c("ry1"), c("ry2"), size))
    cuts = left.join(right, "cy").withColumns({"t": t, "u": u}).where("t > 0 and t < 1 and u >= 0 and u <= 1").groupBy("line_uid", "seq").agg(F.collect_set(F.round("t", 12)).alias("cuts"))
    steps = e.join(cuts, ["line_uid", "seq"], "left").withColumn("s", F.array_sort(F.array_union(F.coalesce("cuts", F.array().cast("array<double>")), F.array(F.lit(0.0), F.lit(1.0)))))
    parts = steps.withColumn("k", F.explode(F.sequence(F.lit(0), F.size("s") - 2))).withColumns({"a": F.get("s", c("k")), "b": F.get("s", c("k") + 1)})
    middle = (c("a") + c("b")) / 2
    return parts.withColumns({"part_m": (c("b") - c("a")) * c("len"), "x": c("x1") + middle * (c("x2") - c("x1")), "y": c("y1") + middle * (c("y2") - c("y1")), "pid": F.concat_ws("|", "line_uid", "seq", "k")})


CUTS = EDGES | {
    "ct": "select e.line_uid, e.seq, ((r.x1-e.x1)*(r.y2-r.y1)-(r.y1-e.y1)*(r.x2-r.x1))/nullif((e.x2-e.x1)*(r.y2-r.y1)-(e.y2-e.y1)*(r.x2-r.x1),0) t, ((r.x1-e.x1)*(e.y2-e.y1)-(r.y1-e.y1)*(e.x2-e.x1))/nullif((e.x2-e.x1)*(r.y2-r.y1)-(e.y2-e.y1)*(r.x2-r.x1),0) u from el e, region_edges r",
    "bd": "select line_uid, seq, round(t,12) t from ct where t>0 and t<1 and u>=0 and u<=1 union select line_uid, seq, 0.0 from el union select line_uid, seq, 1.0 from el",
    "pt": "select line_uid, seq, t a, lead(t) over (partition by line_uid, seq order by t) b from bd",
    "md": "select p.line_uid, p.seq, a, b, (b-a)*len part_m, x1+(a+b)/2*(x2-x1) x, y1+(a+b)/2*(y2-y1) y from pt p join el using (line_uid, seq) where b is not null",
    "rg": "select line_uid, seq, a, region from (select m.line_uid, m.seq, m.a, r.region, count(*) n from md m, region_edges r where r.y1<>r.y2 and ((r.y1>m.y)<>(r.y2>m.y)) and m.x<(r.x2-r.x1)*(m.y-r.y1)/(r.y2-r.y1)+r.x1 group by 1,2,3,4) where n%2=1",
}


@query("g4_split_by_region", twin("select m.line_uid, g.region, round(sum(part_m),6) as metres, count(*) as parts from md m left join rg g on m.line_uid=g.line_uid and m.seq=g.seq and m.a=g.a group by 1,2", **CUTS))
def _(spark, d):
    regions = view(spark, d, "region_edges")
    parts = split_by_regions(lines(spark, d), regions)
    found = S.inside(parts.select("pid", "x", "y"), regions, "pid", 5000.0)
    return parts.join(found, "pid", "left").groupBy("line_uid", "region").agg(F.round(F.sum("part_m"), 6).alias("metres"), N().alias("parts"))


#: Lines that run through a region, by their length in it.
POOL = CUTS | {
    "lb": LABELS,
    "iv": "select m.line_uid, region, m.seq, m.a, m.b, part_m, sum(part_m) over (partition by m.line_uid, region order by m.seq, m.a)-part_m begins from md m join rg g on m.line_uid=g.line_uid and m.seq=g.seq and m.a=g.a",
    "tot": "select line_uid, region, sum(part_m) total from iv group by 1,2 having sum(part_m)>=1",
    "pos": "select line_uid, region, total, commodity_group, diameter_class, row_number() over (partition by region, commodity_group, diameter_class order by md5('5|'||line_uid), line_uid)-1 n from tot join lb on segment_id=line_uid",
    "siz": "select region, commodity_group, diameter_class, count(*) m from pos group by 1,2,3",
    "trn": f"select segment_id, region, lb.commodity_group, lb.diameter_class, j, ({MD5.format('concat_ws(chr(124), chr(53), chr(102)||chr(114)||chr(111)||chr(109), segment_id)')}%m+j)%m as at_n from lb join siz on ecoregion=region and lb.commodity_group=siz.commodity_group and lb.diameter_class=siz.diameter_class, (select unnest(range(0,51)) j) where j<m",
    "pck": "select t.segment_id, t.region, o.line_uid as other, total, row_number() over (partition by t.segment_id order by j) rn from trn t join pos o on t.region=o.region and t.commodity_group=o.commodity_group and t.diameter_class=o.diameter_class and t.at_n=o.n where o.line_uid<>t.segment_id",
    "pnt": f"select segment_id, region, other, {MD5.format('concat_ws(chr(124), chr(57), segment_id, other)')}/4294967296.0::double*total at_m from pck where rn<=50",
}


@query("g17_regional_pool", twin("select segment_id, other, round(at_m,6) as at_m, round(e.x1+(i.a+(at_m-begins)/part_m*(i.b-i.a))*(e.x2-e.x1),6) as x, round(e.y1+(i.a+(at_m-begins)/part_m*(i.b-i.a))*(e.y2-e.y1),6) as y from pnt p join iv i on i.line_uid=other and i.region=p.region and at_m>=begins and at_m<begins+part_m join el e on e.line_uid=other and e.seq=i.seq", **POOL))
def _(spark, d):
    """Up to 50 other lines of a segment's group and diameter class that run through its region, and a hashed point on each one's part in there."""
    edge, regions = lines(spark, d), view(spark, d, "region_edges")
    parts = split_by_regions(edge, regions)
    parts = S.written(parts.join(S.inside(parts.select("pid", "x", "y"), regions, "pid", 5000.0), "pid").select("line_uid", "region", "seq", "a", "b", "part_m", "x1", "y1", "x2", "y2"), "parts")
    of_line = Window.partitionBy("line_uid", "region").orderBy("seq", "a").rowsBetween(Window.unboundedPreceding, 0)
    placed = parts.withColumn("begins", F.sum("part_m").over(of_line) - c("part_m"))
    total = parts.groupBy("line_uid", "region").agg(F.sum("part_m").alias("total")).where("total >= 1")
    own = labelled(spark, d).select("segment_id", "ecoregion", "commodity_group", "diameter_class")
    group = ["ecoregion", "commodity_group", "diameter_class"]
    through = total.join(own.select(c("segment_id").alias("line_uid"), "commodity_group", "diameter_class"), "line_uid").select(c("line_uid").alias("segment_id"), c("region").alias("ecoregion"), "commodity_group", "diameter_class")
    picks = S.draw_from_group(own, group, "segment_id", 50, 5, through).join(own.select("segment_id", "ecoregion"), "segment_id")
    at = picks.join(total, (c("other") == c("line_uid")) & (c("ecoregion") == c("region"))).withColumn("at", S.draw(9, "segment_id", "other") / 4294967296.0 * c("total")).select("segment_id", "other", "line_uid", "region", "at")
    spot = at.join(placed, ["line_uid", "region"]).where("at >= begins and at < begins + part_m").withColumn("t", c("a") + (c("at") - c("begins")) / c("part_m") * (c("b") - c("a")))
    return spot.select("segment_id", "other", F.round("at", 6).alias("at_m"), F.round(c("x1") + c("t") * (c("x2") - c("x1")), 6).alias("x"), F.round(c("y1") + c("t") * (c("y2") - c("y1")), 6).alias("y"))


def merge_parts(pdf):
    """Edges of one line, in any order and direction, chained at ends that two of them share: (part, points in order from the lesser end)."""
    at = {}
    for k, (x1, y1, x2, y2) in enumerate(pdf):
        at.setdefault((x1, y1), []).append(k)
        at.setdefault((x2, y2), []).append(k)
    left, out = set(range(len(pdf))), []
    while left:
        k = left.pop()
        chain = [pdf[k][:2], pdf[k][2:]]
        for end in (-1, 0):
            while len(at[chain[end]]) == 2 and (nxt := next((j for j in at[chain[end]] if j in left), None)) is not None:
                left.discard(nxt)
                a, b = pdf[nxt][:2], pdf[nxt][2:]
                chain.insert(len(chain) if end else 0, b if a == chain[end] else a)
        out.append(chain if chain[0] <= chain[-1] else chain[::-1])
    return sorted(out)


def away(point, chain) -> float:
    """Distance of a point from a chain of points."""
    best = float("inf")
    for (x1, y1), (x2, y2) in zip(chain, chain[1:], strict=False):
        dx, dy = x2 - x1, y2 - y1
        t = min(max(((point[0] - x1) * dx + (point[1] - y1) * dy) / (dx * dx + dy * dy), 0), 1) if dx or dy else 0
        best = min(best, ((point[0] - x1 - t * dx) ** 2 + (point[1] - y1 - t * dy) ** 2) ** 0.5)
    return best


G5 = EDGES | {
    "kept": "select *, cast(line_uid as int)%3=0 and seq>=3 as after_gap from el where not (cast(line_uid as int)%3=0 and seq=2)",
    "rn": "select line_uid, after_gap, count(*)+1 points, sum(len) metres, least(min(row(x1,y1)), min(row(x2,y2))) first from kept group by 1,2",
}


@query("g5_join_parts", twin("select line_uid, row_number() over (partition by line_uid order by first) as part, points, round(metres,6) as metres, first[1] as x, first[2] as y, after_gap or count(*) over (partition by line_uid)=1 as nearest from rn", **G5))
def _(spark, d):
    """Parts of a line joined end to end, and which joined part is nearest to a spot, here the line's last vertex.

    Edges come in any direction; every third line has a gap.
    """
    import pandas as pd

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        chains = merge_parts(list(pdf[["x1", "y1", "x2", "y2"]].itertuples(index=False, name=None)))
        spot = (pdf["sx"].iloc[0], pdf["sy"].iloc[0])
        nearest = min(range(len(chains)), key=lambda k: away(spot, chains[k]))
        length = lambda ch: sum(((a[0] - b[0]) ** 2 + (a[1] - b[1]) ** 2) ** 0.5 for a, b in zip(ch, ch[1:], strict=False))
        return pd.DataFrame([(pdf["line_uid"].iloc[0], k + 1, len(ch), round(length(ch), 6), *ch[0], k == nearest) for k, ch in enumerate(chains)], columns=["line_uid", "part", "points", "metres", "x", "y", "nearest"])

    edge = lines(spark, d).where(~((c("line_uid").cast("int") % 3 == 0) & (c("seq") == 2))).withColumn("f", c("seq") % 2 == 1)
    swap = {a: F.when(c("f"), c(b)).otherwise(c(a)) for a, b in (("x1", "x2"), ("x2", "x1"), ("y1", "y2"), ("y2", "y1"))}
    last = view(spark, d, "line_vertices").groupBy("line_uid").agg(F.max_by("x", "seq").alias("sx"), F.max_by("y", "seq").alias("sy"))
    return edge.select("line_uid", *(v.alias(k) for k, v in swap.items())).join(last, "line_uid").groupBy("line_uid").applyInPandas(join, "line_uid string, part long, points long, metres double, x double, y double, nearest boolean")
