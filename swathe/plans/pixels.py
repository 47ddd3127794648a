"""Queries of pixels and zonal measurement."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import pixels as P
from ..registry import query
from .fixtures import twin, view

c = F.col


def N():
    return F.count(F.lit(1))

ND = "case when {a}>=0 and {b}>=0 and {a}+{b}<>0 then ({a}-{b})/({a}+{b}) end"


def nd(a, b):
    return ND.format(a=a, b=b)


def px(spark, d):
    return view(spark, d, "pixels")


@query("p12_spectral_indices", twin(f"select zone, round(avg({nd('b8', 'b4')}),9) as ndvi, round(avg({nd('b8', 'b11')}),9) as ndmi, round(avg(1.5*(b8-b4)/(b8+b4+0.5)),9) as savi, round(avg({nd('b2', 'b11')}),9) as mndwi, round(avg({nd('b8', 'b2')}),9) as ndre, round(avg(705+35*(((b4+b8)/2-b2)/nullif(b11-b2,0))),6) as s2rep, round(avg(((b11+b4)-(b8+b2))/nullif((b11+b4)+(b8+b2),0)),9) as bsi from pixels group by 1"))
def _(spark, d):
    a = {"ndvi": P.normalized(c("b8"), c("b4")), "ndmi": P.normalized(c("b8"), c("b11")), "savi": P.savi(c("b8"), c("b4")), "mndwi": P.normalized(c("b2"), c("b11")), "ndre": P.normalized(c("b8"), c("b2")), "bsi": P.bare_soil(c("b11"), c("b4"), c("b8"), c("b2"))}
    return px(spark, d).groupBy("zone").agg(*(F.round(F.avg(v), 9).alias(k) for k, v in a.items()), F.round(F.avg(P.red_edge_position(c("b4"), c("b2"), c("b11"), c("b8"))), 6).alias("s2rep"))


@query("p13_earlier_indices", twin(f"select zone, round(avg({nd('b8', 'b11')}),9) as ndwi, round(avg({nd('b2', 'b11')}),9) as ndwi_legacy from pixels group by 1"))
def _(spark, d):
    return px(spark, d).groupBy("zone").agg(F.round(F.avg(P.normalized(c("b8"), c("b11"))), 9).alias("ndwi"), F.round(F.avg(P.normalized(c("b2"), c("b11"))), 9).alias("ndwi_legacy"))


@query("p14_clear_sky", twin("select zone, count(*) as n from pixels where cs_cdf>=0.6 and scl not in (1,2,11) group by 1"))
def _(spark, d):
    return px(spark, d).where(P.clear(c("cs_cdf"), c("scl"))).groupBy("zone").agg(N().alias("n"))


@query("p15_class_masks", twin("select count(*) filter (scl not in (3,8,9,10,11)) as legacy, count(*) filter (scl not in (1,2,3,6,8,9,10,11)) as v2 from pixels"))
def _(spark, d):
    return px(spark, d).agg(F.count_if(~c("scl").isin(3, 8, 9, 10, 11)).alias("legacy"), F.count_if(~c("scl").isin(1, 2, 3, 6, 8, 9, 10, 11)).alias("v2"))


@query("p16_water_in_image", twin(f"select zone, count(*) as n from pixels where not (scl=6 or coalesce({nd('b2', 'b11')},-1)>0) group by 1"))
def _(spark, d):
    wet = (c("scl") == 6) | (F.coalesce(P.normalized(c("b2"), c("b11")), F.lit(-1.0)) > 0)
    return px(spark, d).where(~wet).groupBy("zone").agg(N().alias("n"))


WET = "landcover=11 or (px+py)%50=0"


@query("p17_static_water", twin(f"select count(*) as cells from (select distinct px, py from pixels where not ({WET})) a anti join (select distinct px+i px, py+j py from (select distinct px, py from pixels where {WET}), (select unnest(range(-2,3)) i), (select unnest(range(-2,3)) j) where i*i+j*j<=4) using (px, py)"))
def _(spark, d):
    """Water is what is open water by class or wet in more than 5 percent of the time, and two cells around it."""
    occurrence = F.when((c("px") + c("py")) % 50 == 0, 20).otherwise(0)
    wet = (c("landcover") == 11) | (occurrence > 5)
    p = px(spark, d)
    return P.near(p.where(~wet).select("px", "py").distinct(), p.where(wet), 2).agg(N().alias("cells"))


@query("p18_bit_mask", twin("select zone, count(*) as n from pixels where ((px*7+py) & 191)=0 or (px & 3)=0 group by 1"))
def _(spark, d):
    return px(spark, d).where(P.bits_clear(c("px") * 7 + c("py"), [0, 1, 2, 3, 4, 5, 7]) | P.bits_clear(c("px"), [0, 1])).groupBy("zone").agg(N().alias("n"))


@query("p19_thermal_scaling", twin("select zone, round(avg((px*40+20000)*0.00341802::double+149-273.15::double),6) as lst, count(*) as n from pixels where py*0.01::double<=3.5 group by 1"))
def _(spark, d):
    return px(spark, d).where(c("py") * 0.01 <= 3.5).groupBy("zone").agg(F.round(F.avg(P.kelvin_to_celsius(c("px") * 40 + 20000)), 6).alias("lst"), N().alias("n"))


RAW = {"blue": "b2", "green": "b11", "red": "b4", "nir": "b8", "swir1": "b11", "swir2": "b2"}
ROY = [("blue", "b2", 0.8474, 0.0003), ("green", "b11", 0.8483, 0.0088), ("red", "b4", 0.9047, 0.0061), ("nir", "b8", 0.8462, 0.0412), ("swir1", "b11", 0.8937, 0.0254), ("swir2", "b2", 0.9071, 0.0172)]


@query("p20_harmonization", twin("select zone, " + ", ".join(f"round(avg(case when tile=0 then {x}*30000*0.0000275::double-0.2::double else ({x}*30000*0.0000275::double-0.2::double)*{m}::double+{k}::double end),9) as {n}" for n, x, m, k in ROY) + " from pixels group by 1"))
def _(spark, d):
    """Six bands; tile 1 stands for the older sensors."""
    return px(spark, d).groupBy("zone").agg(*(F.round(F.avg(P.reflectance(c(x) * 30000, band, c("tile") == 1)), 9).alias(band) for band, x in RAW.items()))


@query("p21_season_window", twin("select year(dt) as year, count(*) as n from pixels where month(dt) in (3,4) and cs_cdf*100<60 group by 1"))
def _(spark, d):
    return px(spark, d).where(F.month("dt").isin(3, 4) & (c("cs_cdf") * 100 < 60)).groupBy(F.year("dt").alias("year")).agg(N().alias("n"))


@query("p23_wetness", twin("select zone, round(avg(ln(greatest(py*1e6/90,1))-ln(greatest(tan(radians(px/20.0::double)),0.001))),6) as twi from pixels group by 1"))
def _(spark, d):
    return px(spark, d).groupBy("zone").agg(F.round(F.avg(P.wetness(c("py"), c("px") / 20)), 6).alias("twi"))


NDVI = twin("", p="select *, (b8-b4)/(b8+b4) ndvi from pixels")


def ndvi(spark, d):
    return px(spark, d).withColumn("ndvi", P.normalized(c("b8"), c("b4")))


@query("g19_zonal_mean", NDVI + "select zone, landcover, dt, orbit, round(avg(ndvi),9) as mean, count(ndvi) as n from p group by 1,2,3,4")
def _(spark, d):
    return P.zonal(ndvi(spark, d), ["zone", "landcover", "dt", "orbit"], "ndvi").withColumn("mean", F.round("mean", 9))


MOSAIC = {
    "p": "select *, (b8-b4)/(b8+b4) ndvi from pixels",
    "lst": "select zone, landcover, px, py, dt, orbit, max(row(tile, ndvi))[2] v from p group by 1,2,3,4,5,6",
    "tl": "select dt, orbit, string_agg(distinct cast(tile as varchar), ',' order by cast(tile as varchar)) tiles from p group by 1,2",
    "ag": "select dt, orbit, avg(a) sun from (select dt, orbit, tile, avg(sun_zenith) a from p group by 1,2,3) group by 1,2",
}


@query("g20_pass_mosaic", twin("select zone, landcover, l.dt, l.orbit, tiles, round(sun,9) as sun_zenith, round(avg(v),9) as mean, count(v) as n from lst l join tl on l.dt=tl.dt and l.orbit=tl.orbit join ag on l.dt=ag.dt and l.orbit=ag.orbit group by 1,2,3,4,5,6", **MOSAIC))
def _(spark, d):
    """One value a pixel and pass, then each zone's mean and count by class."""
    one = P.mosaic(ndvi(spark, d), ["zone", "landcover", "px", "py"], "ndvi", "sun_zenith")
    return one.groupBy("zone", "landcover", "dt", "orbit", "tiles", F.round("sun_zenith", 9).alias("sun_zenith")).agg(F.round(F.avg("ndvi"), 9).alias("mean"), F.count("ndvi").alias("n"))


SUMMED = ", ".join(f"round(avg({v}),9) as {v}_mean, round(stddev_pop({v}),9) as {v}_sd, count({v}) as {v}_n, round(quantile_cont({v},0.1),9) as {v}_p10, round(median({v}),9) as {v}_median, round(quantile_cont({v},0.9),9) as {v}_p90" for v in ("med", "top", "clear"))


@query("g21_temporal_composite", NDVI + f"select zone, landcover, {SUMMED} from (select zone, landcover, px, py, median(ndvi) med, quantile_cont(ndvi,0.9) top, count(ndvi) clear from p group by 1,2,3,4) group by 1,2")
def _(spark, d):
    cells = P.composite(ndvi(spark, d), ["zone", "landcover", "px", "py"], "ndvi").withColumnsRenamed({"median": "med", "p90": "top"})
    found = P.zone_summary(cells, ["zone", "landcover"], ["med", "top", "clear"])
    return found.withColumns({x: F.round(x, 9) for x, kind in found.dtypes if kind == "double"})


@query("g22_mean_composite", NDVI + "select zone, round(avg(m),9) as mean, round(avg(med),9) as median, count(*) as pixels, round(avg(k),9) as clear_images from (select zone, px, py, avg(ndvi) m, median(ndvi) med, count(ndvi) k from p group by 1,2,3) group by 1")
def _(spark, d):
    cells = ndvi(spark, d).groupBy("zone", "px", "py").agg(F.avg("ndvi").alias("m"), F.median("ndvi").alias("med"), F.count("ndvi").alias("k"))
    return cells.groupBy("zone").agg(F.round(F.avg("m"), 9).alias("mean"), F.round(F.avg("med"), 9).alias("median"), N().alias("pixels"), F.round(F.avg("k"), 9).alias("clear_images"))


LAYERS = {"elevation_m": "px", "slope_deg": "py/20.0::double", "hand_m": "(px+py)/100.0::double", "twi": "ln(greatest(py*1e6/90,1))-ln(greatest(tan(radians(px/20.0::double)),0.001))", "water_share": "case when landcover=11 then 1.0::double else 0 end"}


@query("g23_fixed_values", twin("select zone, " + ", ".join(f"round(avg({x}),6) as {n}" for n, x in LAYERS.items()) + ", any_value(soil) as soil from pixels join (select zone, scl as soil from (select zone, scl, row_number() over (partition by zone order by count(*) desc, scl) rn from pixels group by 1,2) where rn=1) using (zone) group by 1"))
def _(spark, d):
    """Means of five layers and the most frequent soil class, of equals the lower; sums and counts by class come first."""
    layers = {"elevation_m": c("px"), "slope_deg": c("py") / 20, "hand_m": (c("px") + c("py")) / 100, "twi": P.wetness(c("py"), c("px") / 20), "water_share": (c("landcover") == 11).cast("double")}
    counts = px(spark, d).groupBy("zone", "scl").agg(N().alias("n"), *(F.sum(v).alias(k) for k, v in layers.items()))
    return counts.groupBy("zone").agg(*(F.round(F.sum(k) / F.sum("n"), 6).alias(k) for k in layers), F.max_by("scl", F.struct("n", -c("scl"))).alias("soil"))


@query("g24_season_grid_mean", twin("select zone, year, round(avg(v),9) as pdsi from (select distinct zone, px//100 gx from pixels) z join (select px//100 gx, year(dt) as year, avg(b11) v from pixels where month(dt) in (3,4) group by 1,2) g using (gx) group by 1,2"))
def _(spark, d):
    cell = F.expr("px div 100").alias("gx")
    grid = px(spark, d).where(F.month("dt").isin(3, 4)).groupBy(cell, F.year("dt").alias("year")).agg(F.avg("b11").alias("v"))
    return px(spark, d).select("zone", cell).distinct().join(grid, "gx").groupBy("zone", "year").agg(F.round(F.avg("v"), 9).alias("pdsi"))


SPOT = {
    "p": "select *, (b8-b4)/(b8+b4) ndvi from pixels where (px-500)*(px-500)+(py-500)*(py-500)<=90000",
    "im": "select dt, orbit, avg(ndvi) v from p group by 1,2",
    "cp": "select year, avg(m) composite from (select year(dt) as year, px, py, median(ndvi) m from p group by 1,2,3) group by 1",
    "again": "select year, avg(v) again from (select year(dt) as year, v, row_number() over (partition by year(dt) order by v, dt, orbit) rn, count(*) over (partition by year(dt)) n from im) where rn in ((n+1)//2, n//2+1) group by 1",
}


@query("v10_spot_history", twin("select year, round(median(v),9) as median_ndvi, count(*) as clear_images, abs(median(v)-any_value(again))<=1e-9 as same, round(median(v)-any_value(composite),9) as less_composite from (select year(dt) as year, v from im) join cp using (year) join again using (year) group by 1", **SPOT))
def _(spark, d):
    """A circle's mean in each image and the spring's median; the same median from ranks, and what a composite of pixel medians gives instead."""
    from ..operators import ranks

    spot = ndvi(spark, d).where((c("px") - 500) * (c("px") - 500) + (c("py") - 500) * (c("py") - 500) <= 90000).withColumn("year", F.year("dt"))
    images = spot.groupBy("year", "dt", "orbit").agg(F.avg("ndvi").alias("v"))
    again = ranks.quantiles(images, ["year"], "v", {"again": 0.5})
    pixels = spot.groupBy("year", "px", "py").agg(F.median("ndvi").alias("m")).groupBy("year").agg(F.avg("m").alias("composite"))
    rows = images.groupBy("year").agg(F.median("v").alias("m"), N().alias("clear_images")).join(again, "year").join(pixels, "year")
    return rows.select("year", F.round("m", 9).alias("median_ndvi"), "clear_images", (F.abs(c("m") - c("again")) <= 1e-9).alias("same"), F.round(c("m") - c("composite"), 9).alias("less_composite"))


RINGS = ["0-50", "50-100", "100-250", "250-500", "500-1000"]
#: Cells of a ring by a piece's own length: shares that stay after cleaning are those of cells that are not water.
BANDS = {"b": "select zone, case px//200 when 0 then '0-50' when 1 then '50-100' when 2 then '100-250' when 3 then '250-500' else '500-1000' end ring, count(*)*100.0::double full_area, count(*) filter (landcover<>11)*100.0::double area from pixels group by 1,2"}
LEAST_AREA = 8000.0


def bands(spark, d):
    """Area of each zone's rings before and after cleaning, in square metres of cells of 100."""
    name = F.element_at(F.array(*map(F.lit, RINGS)), F.expr("px div 200").cast("int") + 1)
    rows = px(spark, d).groupBy("zone", name.alias("ring")).agg((N() * 100.0).alias("full_area"), (F.count_if(c("landcover") != 11) * 100.0).alias("area"))
    return rows.withColumn("kept_share", F.try_divide("area", "full_area"))


@query("g10_g11_band_area", twin(f"select zone, max(area) filter (area>={LEAST_AREA}) is not null as has_zones, coalesce(bool_or(ring='500-1000' and area>={LEAST_AREA}),false) as has_comparison, round(max(area/full_area) filter (ring='500-1000' and area>={LEAST_AREA}),9) as comparison_kept_share, count(*) filter (area>={LEAST_AREA}) as rings, round(sum(area) filter (area>={LEAST_AREA}),6) as kept_area from b group by 1", **BANDS))
def _(spark, d):
    """Rings under the least area are dropped; a zone's flags and its comparison ring's kept share."""
    usable, outer = c("area") >= LEAST_AREA, c("ring") == "500-1000"
    return bands(spark, d).groupBy("zone").agg(
        F.coalesce(F.max(usable), F.lit(False)).alias("has_zones"), F.coalesce(F.max(usable & outer), F.lit(False)).alias("has_comparison"),
        F.round(F.max(F.when(usable & outer, c("kept_share"))), 9).alias("comparison_kept_share"), F.count_if(usable).alias("rings"), F.round(F.sum(F.when(usable, c("area"))), 6).alias("kept_area"),
    )


@query("g10_ring_summary", twin(f"select ring, count(*) as rings, count(*) filter (area>={LEAST_AREA}) as kept, round(avg(area/full_area),9) as mean_kept_share from b group by 1", **BANDS))
def _(spark, d):
    return bands(spark, d).groupBy("ring").agg(N().alias("rings"), F.count_if(c("area") >= LEAST_AREA).alias("kept"), F.round(F.avg("kept_share"), 9).alias("mean_kept_share"))


LABELS = "commodity_group, status, quality_cd"
LEDGER = {
    "ln": "select segment_id, ecoregion, commodity_group, status, quality_cd, k, weight*1.0::double line_km, case when k%9=0 then 0.0::double when k%4=0 then weight*0.5::double else weight*1.0::double end covered, k%10=7 as repeated from segment_dim",
    "pc": "select ecoregion, 'measured' as reason, true as kept, commodity_group, status, quality_cd, 1 as pieces, covered as km from ln where not repeated and covered>0 and k%5<>1 union all select ecoregion, 'piece shorter than 50 m', false, commodity_group, status, quality_cd, 1, covered from ln where not repeated and covered>0 and k%5=1 union all select '(none)', 'outside the regions', false, commodity_group, status, quality_cd, 0, greatest(line_km-covered,0) from ln where not repeated and line_km-covered>0.001 union all select '(any)', 'exact duplicate of another line', false, commodity_group, status, quality_cd, 0, line_km from ln where repeated",
}


@query("g12_coverage_ledger", twin(f"select ecoregion, reason, kept, {LABELS}, cast(sum(pieces) as bigint) as pieces, count(*) as lines, round(sum(km),9) as km from pc group by 1,2,3,4,5,6", **LEDGER))
def _(spark, d):
    """Every line's length once: measured or too short inside the regions, what no region covers, and lines that repeat another; null labels count too."""
    line = view(spark, d, "segment_dim").withColumns({"line_km": c("weight") * 1.0, "covered": F.when(c("k") % 9 == 0, 0.0).when(c("k") % 4 == 0, c("weight") * 0.5).otherwise(c("weight") * 1.0), "repeated": c("k") % 10 == 7})
    own = line.where(~c("repeated"))
    part = lambda rows, region, reason, kept, n, km: rows.select(region.alias("ecoregion"), reason.alias("reason"), kept.alias("kept"), "commodity_group", "status", "quality_cd", F.lit(n).alias("pieces"), km.alias("km"))
    short = c("k") % 5 == 1
    inside = part(own.where("covered > 0"), c("ecoregion"), F.when(short, "piece shorter than 50 m").otherwise("measured"), ~short, 1, c("covered"))
    outside = part(own.where(c("line_km") - c("covered") > 0.001), F.lit("(none)"), F.lit("outside the regions"), F.lit(False), 0, F.greatest(c("line_km") - c("covered"), F.lit(0.0)))
    twice = part(line.where("repeated"), F.lit("(any)"), F.lit("exact duplicate of another line"), F.lit(False), 0, c("line_km"))
    rows = inside.unionByName(outside).unionByName(twice)
    return rows.groupBy("ecoregion", "reason", "kept", "commodity_group", "status", "quality_cd").agg(F.sum("pieces").cast("long").alias("pieces"), N().alias("lines"), F.round(F.sum("km"), 9).alias("km"))
