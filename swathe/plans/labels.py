"""Queries of labels, filters and samples."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import labels as L
from ..operators import ranks
from ..operators import sampling as X
from ..registry import query
from .fixtures import table, twin, view

#: Codes as they come: in either case, with blanks, some of them unknown; one for each supplier in turn.
RAW = ["aa", " CO2", "cro ", "CRL", "cfl", "CRA", "hvl", " ngt ", "NGG", "NFG", "ngz", "PRD", "ogt", "zzz", "CRD"]
CODES = "case s_suppkey%15 " + " ".join(f"when {k} then '{x}'" for k, x in enumerate(RAW)) + " end"
#: The code list as the study's definitions give it: code, commodity, service, group; the last line is for any other code.
CODE_LIST = [
    ("AA", "Anhydrous ammonia", "Transmission", "Other"),
    ("CO2", "Carbon dioxide", "Transmission", "Other"),
    ("CRO", "Crude oil", "Transmission", "Crude oil"),
    ("CRL", "Crude oil", "Gathering", "Crude oil"),
    ("CFL", "Crude full well stream", "Gathering", "Crude oil"),
    ("CRA", "Crude oil, offshore", "Offshore gathering", "Crude oil"),
    ("HVL", "Highly volatile liquid", "Transmission", "Highly volatile liquid"),
    ("NGT", "Natural gas", "Transmission", "Natural gas"),
    ("NGG", "Natural gas", "Gathering", "Natural gas"),
    ("NFG", "Natural gas, full well stream", "Gathering", "Natural gas"),
    ("NGZ", "Natural gas, offshore", "Offshore gathering", "Natural gas"),
    ("PRD", "Refined liquid product", "Transmission", "Refined product"),
    ("OGT", "Other gas", "Transmission", "Other"),
    ("", "Not in the RRC code list", "Unknown", "Unknown"),
]


def listed(column: int) -> str:
    """SQL of one column of the code list for a code ``x``."""
    cases = " ".join(f"when '{row[0]}' then '{row[column]}'" for row in CODE_LIST[:-1])
    return f"case upper(trim(x)) {cases} else '{CODE_LIST[-1][column]}' end"


@query("p1_code_labels", f"select s_suppkey, {listed(1)} as commodity, {listed(2)} as service, {listed(3)} as commodity_group from (select s_suppkey, {CODES} x from supplier)")
def _(spark, d):
    rows = table(spark, d, "supplier").select("s_suppkey", F.expr(CODES).alias("c"))
    return L.commodity(rows, "c").select("s_suppkey", "commodity", "service", "commodity_group")


STATE = "case s_suppkey%4 when 0 then 'i' when 1 then ' B' when 2 then 'R' else 'q' end"
SIDE = "case s_suppkey%3 when 0 then 'y' when 1 then 'N ' end"


@query("p2_accuracy_labels", twin(f"select segment_id, case quality_cd when 'E' then 'Within 50 ft' when 'V' then '51-300 ft' when 'G' then '301-500 ft' when 'P' then '501-1,000 ft' when 'U' then 'Unknown' else 'Not recorded' end as accuracy, case quality_cd when 'E' then 15.2::double when 'V' then 91.4 when 'G' then 152.4 when 'P' then 304.8 end as max_error_m, case upper(trim({STATE})) when 'I' then 'In service' when 'B' then 'Abandoned' when 'R' then 'Revoked (code not in the RRC definitions; inferred)' else 'Not recorded' end as status, case upper(trim({SIDE})) when 'Y' then 'Interstate' when 'N' then 'Intrastate' else 'Not recorded' end as interstate_type from segment_dim".replace("s_suppkey", "k")))
def _(spark, d):
    q, status, side = F.col("quality_cd"), F.expr(STATE.replace("s_suppkey", "k")), F.expr(SIDE.replace("s_suppkey", "k"))
    return view(spark, d, "segment_dim").select(
        "segment_id", L.lookup({k: v for k, (v, _) in L.ACCURACY.items()}, q).alias("accuracy"), L.lookup({k: m for k, (_, m) in L.ACCURACY.items()}, q, None).cast("double").alias("max_error_m"),
        L.lookup(L.STATUS, status).alias("status"), L.lookup(L.INTERSTATE, side).alias("interstate_type"),
    )


@query("p3_diameter_class", twin("select segment_id, case when diameter_in<=0 then 'Not recorded' when diameter_in<4.5 then 'Under 4.5 in' when diameter_in<8.63 then '4.5-8.6 in' when diameter_in<12.75 then '8.6-12.75 in' when diameter_in<16 then '12.75-16 in' when diameter_in<24 then '16-24 in' when diameter_in<36 then '24-36 in' else 'Over 36 in' end as diameter_class from segment_dim"))
def _(spark, d):
    return view(spark, d, "segment_dim").select("segment_id", L.diameter_class(F.col("diameter_in").cast("string")).alias("diameter_class"))


@query("p4_fips", "select c_custkey, '48' || case when length(cast(c_custkey as varchar))<3 then lpad(cast(c_custkey as varchar),3,'0') else cast(c_custkey as varchar) end as county_fips from customer")
def _(spark, d):
    return table(spark, d, "customer").select("c_custkey", L.fips(F.col("c_custkey").cast("string")).alias("county_fips"))


@query("p5_station", "select o_orderkey, cast(cast(round_even(o_totalprice*3.28084,0) as bigint)//100 as varchar)||'+'||lpad(cast(cast(round_even(o_totalprice*3.28084,0) as bigint)%100 as varchar),2,'0') as station from orders")
def _(spark, d):
    return table(spark, d, "orders").select("o_orderkey", L.station(F.col("o_totalprice")).alias("station"))


@query("p6_ordinal_key", "select c_custkey, c_mktsegment||'-'||lpad(cast(row_number() over (partition by c_mktsegment order by c_custkey)-1 as varchar),6,'0') as line_uid from customer")
def _(spark, d):
    """Numbers of a whole segment, however large: counted by ranges of keys."""
    rows = ranks.numbered(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), ["c_mktsegment"], ["c_custkey"], "n")
    return rows.select("c_custkey", F.concat("c_mktsegment", F.lit("-"), F.lpad((F.col("n") - 1).cast("string"), 6, "0")).alias("line_uid"))


@query("p7_zone_key_split", twin("select unit, ring, count(*) as n_rows from (select regexp_extract(z,'^(.*)_r(.*)$',1) unit, regexp_extract(z,'^(.*)_r(.*)$',2) ring from (select segment_id||'_r1_r'||ring z from zone_obs)) group by 1,2"))
def _(spark, d):
    unit, ring = L.split_zone(F.col("z"))
    return view(spark, d, "zone_obs").select(F.concat("segment_id", F.lit("_r1_r"), "ring").alias("z")).select(unit.alias("unit"), ring.alias("ring")).groupBy("unit", "ring").agg(F.count(F.lit(1)).alias("n_rows"))


@query("p8_date_parts", "select year(l_shipdate) as year, dayofyear(l_shipdate) as doy, count(*) as n_rows from lineitem group by 1,2")
def _(spark, d):
    return table(spark, d, "lineitem").groupBy(F.year("l_shipdate").alias("year"), F.dayofyear("l_shipdate").alias("doy")).agg(F.count(F.lit(1)).alias("n_rows"))


@query("p9_id_normalization", twin("select k, regexp_replace(raw_id,'^(\\d+)[ _]','\\1_') as norm_id, regexp_extract(raw_id,'^(\\d+)',1) as number from part_tables"))
def _(spark, d):
    return view(spark, d, "part_tables").select("k", L.normal_id(F.col("raw_id")).alias("norm_id"), F.regexp_extract("raw_id", r"^(\d+)", 1).alias("number"))


@query("p10_region_keyword", "select n_name, case when contains(regexp_replace(lower(n_name),'[^a-z]','','g'),'an') then 'an' when contains(regexp_replace(lower(n_name),'[^a-z]','','g'),'i') then 'i' else 'none' end as region_key from nation")
def _(spark, d):
    return table(spark, d, "nation").select("n_name", L.keyword_region(F.col("n_name"), ["an", "i"]).alias("region_key"))


@query("p11_slug", "select p_partkey, replace(replace(lower(p_name),'/','_'),' ','_') as slug from part")
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", L.slug(F.col("p_name")).alias("slug"))


@query("p22_season_windows", "select y as year, make_date(y,3,1) as start_date, make_date(y,5,1) as end_date, (select count(*) from lineitem where cast(l_shipdate as date)>=make_date(y,3,1) and cast(l_shipdate as date)<make_date(y,5,1)) as n_rows from (select unnest(range(1995,2000)) y)")
def _(spark, d):
    windows = spark.range(1).select(F.explode(F.sequence(F.lit(1995), F.lit(1999))).alias("year")).select("year", F.make_date("year", F.lit(3), F.lit(1)).alias("start_date"), F.make_date("year", F.lit(5), F.lit(1)).alias("end_date"))
    days = table(spark, d, "lineitem").groupBy(F.to_date("l_shipdate").alias("day"), F.year("l_shipdate").alias("year")).agg(F.count(F.lit(1)).alias("n"))
    return windows.join(days, "year", "left").groupBy("year", "start_date", "end_date").agg(F.coalesce(F.sum(F.when((F.col("day") >= F.col("start_date")) & (F.col("day") < F.col("end_date")), F.col("n"))), F.lit(0)).alias("n_rows"))


@query("p24_coercing_cast", "select o_orderkey, try_cast(case when o_orderkey%3=0 then 'n/a' else cast(o_totalprice as varchar) end as double) as price from orders where coalesce(try_cast(case when o_orderkey%3=0 then 'n/a' else cast(o_totalprice as varchar) end as double),150000.0) between 100000 and 200000")
def _(spark, d):
    text = F.when(F.col("o_orderkey") % 3 == 0, "n/a").otherwise(F.col("o_totalprice").cast("string"))
    return table(spark, d, "orders").select("o_orderkey", text.try_cast("double").alias("price")).where(F.coalesce("price", F.lit(150000.0)).between(100000, 200000))


@query("p25_report_selection", twin("select spill_id, round(barrels,6) as barrels, barrels>=50 as large from spill_points where contains(cause,'M') and regexp_matches(cause,'MACH|AUTO|FURN') and barrels>=5"))
def _(spark, d):
    c = F.col("cause")
    return view(spark, d, "spill_points").where(c.contains("M") & c.rlike("MACH|AUTO|FURN") & (F.col("barrels") >= 5)).select("spill_id", F.round("barrels", 6).alias("barrels"), (F.col("barrels") >= 50).alias("large"))


@query("p26_duplicate_flag", "select o_orderkey, row_number() over (partition by o_custkey, o_orderstatus order by o_orderkey)>1 as duplicate from orders")
def _(spark, d):
    return table(spark, d, "orders").select("o_orderkey", (F.row_number().over(Window.partitionBy("o_custkey", "o_orderstatus").orderBy("o_orderkey")) > 1).alias("duplicate"))


@query("p27_spring_status", twin("select event_no, y as year, case when make_date(y,5,1)<event_date then 'before' when make_date(y,3,1)>event_date then 'after' else 'during' end as status from event_dim, (select unnest(range(1995,2001)) y)"))
def _(spark, d):
    rows = view(spark, d, "event_dim").withColumn("year", F.explode(F.sequence(F.lit(1995), F.lit(2000))))
    return rows.select("event_no", "year", L.spring_status(F.make_date("year", F.lit(3), F.lit(1)), F.make_date("year", F.lit(5), F.lit(1)), F.col("event_date")).alias("status"))


@query("p28_years_from_event", twin("select event_no, year, case status when 'after' then year-min(case when status='after' then year end) over (partition by event_no)+1 when 'before' then year-max(case when status='before' then year end) over (partition by event_no)-1 else 0 end as years_from_event from (select event_no, y as year, case when make_date(y,5,1)<event_date then 'before' when make_date(y,3,1)>event_date then 'after' else 'during' end as status from event_dim, (select unnest(range(1995,2001)) y))"))
def _(spark, d):
    from ..operators.events import years_from_event

    rows = view(spark, d, "event_dim").withColumn("year", F.explode(F.sequence(F.lit(1995), F.lit(2000))))
    status = L.spring_status(F.make_date("year", F.lit(3), F.lit(1)), F.make_date("year", F.lit(5), F.lit(1)), F.col("event_date"))
    return years_from_event(rows.withColumn("status", status)).select("event_no", "year", "years_from_event")


@query("p30_utm_zone", twin("select spill_id, cast(floor((x/1000-100+180)/6)+1 as int) as utm, 32600+cast(floor((x/1000-100+180)/6)+1 as int) as epsg from spill_points"))
def _(spark, d):
    zone = L.utm_zone(F.col("x") / 1000 - 100)
    return view(spark, d, "spill_points").select("spill_id", zone.alias("utm"), (zone + 32600).alias("epsg"))


@query("p31_broad_class", twin("select landcover//10 as landcover_group, count(*) as n_rows from site_obs group by 1"))
def _(spark, d):
    return view(spark, d, "site_obs").groupBy(F.expr("landcover div 10").alias("landcover_group")).agg(F.count(F.lit(1)).alias("n_rows"))


@query("p32_first_reason", twin("select segment_id, case when quality_cd='X' then 'unknown accuracy' when diameter_in<=0 then 'no diameter' when weight>5 then 'heavy' else '' end as reason from segment_dim"))
def _(spark, d):
    c = F.col
    return view(spark, d, "segment_dim").select("segment_id", L.first_reason((c("quality_cd") == "X", "unknown accuracy"), (c("diameter_in") <= 0, "no diameter"), (c("weight") > 5, "heavy")).alias("reason"))


@query("p33_unpivot", twin("select segment_id, ring, 'total' as measure, cast(sum(n) as double) as val from zone_obs group by 1,2 union all select segment_id, ring, 'largest', cast(max(n) as double) from zone_obs group by 1,2"))
def _(spark, d):
    wide = view(spark, d, "zone_obs").groupBy("segment_id", "ring").agg(F.sum("n").cast("double").alias("total"), F.max("n").cast("double").alias("largest"))
    return wide.unpivot(["segment_id", "ring"], ["total", "largest"], "measure", "val")


@query("p34_report_type", "select p_partkey, case when regexp_matches(lower(p_name),'[ae]') then 'combined' else 'region' end as kind from part")
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", F.when(F.lower("p_name").rlike("[ae]"), "combined").otherwise("region").alias("kind"))


STRATA = "select ecoregion||'|'||commodity_group stratum, sum(case when quality_cd='E' then 1 else 0 end) n_e, sum(case when quality_cd<>'E' then 1 else 0 end) n_o from segment_dim group by 1"


def strata(spark, d):
    e = F.col("quality_cd") == "E"
    return view(spark, d, "segment_dim").groupBy(F.concat_ws("|", "ecoregion", "commodity_group").alias("stratum")).agg(F.count_if(e).alias("n_e"), F.count_if(~e).alias("n_o"))


@query("x1_strata", twin("select stratum, cast(n_e as bigint) as n_e, cast(n_o as bigint) as n_o, cast(n_e*2+n_o as double) as boosted from strata", strata=STRATA))
def _(spark, d):
    return strata(spark, d).withColumn("boosted", (F.col("n_e") * 2 + F.col("n_o")).cast("double"))


POINTS = {
    "sz": "select stratum, cast(n_e+n_o as bigint) n, least(2, cast(n_e+n_o as bigint)) least_n from strata",
    "pt": "select stratum, (k+0.5::double)/n at_scale from (select stratum, n, unnest(range(least_n, n)) k from sz)",
    "sc": "select coalesce(max(at_scale), 0) scale from (select at_scale, row_number() over (order by at_scale, stratum) rn from pt) where rn<=40-(select sum(least_n) from sz)",
}


@query("x2_allocation", twin("select stratum, cast(least_n+(select count(*) from pt where pt.stratum=sz.stratum and at_scale<=scale) as bigint) as given from sz, sc", strata=STRATA, **POINTS))
def _(spark, d):
    s = strata(spark, d).withColumn("size", F.col("n_e") + F.col("n_o"))
    return X.allocation(s, "stratum", "size", 40, 2)


@query("x3_group_split", twin("select stratum, cast(case when n_e=0 then 0 when n_o=0 then least(g,n_e) else least(g-least(g-i,n_o),n_e) end as bigint) as given_e from (select *, least(greatest(round_even(g*n_e*2.0::double/(n_e*2.0::double+n_o),0),1),n_e,greatest(g-1,0)) i from (select *, least(1+length(stratum)%4, n_e+n_o) g from strata))", strata=STRATA))
def _(spark, d):
    g = F.least(1 + F.length("stratum") % 4, F.col("n_e") + F.col("n_o"))
    return strata(spark, d).select("stratum", X.split_given(g, F.col("n_e"), F.col("n_o"), 2.0).alias("given_e"))


PICK = "select *, row_number() over (partition by ecoregion order by md5('392|'||segment_id), segment_id) rn, count(*) over (partition by ecoregion) group_size from segment_dim"


@query("x4_sample_in_groups", twin("select segment_id, ecoregion, group_size, least(5,group_size) as group_drawn, round(cast(group_size as double)/least(5,group_size),9) as weight from picked where rn<=5", picked=PICK))
def _(spark, d):
    return X.draw_in_groups(view(spark, d, "segment_dim").drop("weight"), "ecoregion", "segment_id", 392, 5).select("segment_id", "ecoregion", "group_size", F.col("group_drawn").cast("long").alias("group_drawn"), F.round("weight", 9).alias("weight"))


@query("x5_sample_summary", twin("select ecoregion, commodity_group, count(*) as segments, round(sum(cast(group_size as double)/least(5,group_size)),6) as weight from picked where rn<=5 group by grouping sets ((ecoregion),(commodity_group),())", picked=PICK))
def _(spark, d):
    rows = X.draw_in_groups(view(spark, d, "segment_dim").drop("weight"), "ecoregion", "segment_id", 392, 5)
    return rows.groupingSets([["ecoregion"], ["commodity_group"], []], "ecoregion", "commodity_group").agg(F.count(F.lit(1)).alias("segments"), F.round(F.sum("weight"), 6).alias("weight"))


@query("x6_n_per_class", twin("select landcover, segment_id from (select *, row_number() over (partition by landcover order by md5('7|'||segment_id), segment_id) rn from (select distinct landcover, segment_id from zone_obs)) where rn<=3"))
def _(spark, d):
    rows = view(spark, d, "zone_obs").select("landcover", "segment_id").distinct()
    return X.draw_in_groups(rows, "landcover", "segment_id", 7, 3).select("landcover", "segment_id")
