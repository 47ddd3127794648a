"""Stand-in views on the given tables.  One text serves both engines; braces mark tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "zone_obs": """select lpad(cast(l_suppkey as string),4,'0') segment_id,
 case l_linenumber when 1 then '0-50' when 2 then '50-100' when 3 then '100-250' when 4 then '250-500' else '500-1000' end ring,
 case l_returnflag when 'A' then 41 when 'N' then 52 else 71 end landcover,
 year(l_shipdate)*10+quarter(l_shipdate) pass_date, year(l_shipdate) as year, l_partkey % 2 orbit,
 l_orderkey % 2 image, l_discount*5 - l_tax m, cast(l_quantity as bigint) n, cast(dayofyear(l_shipdate) as int) doy from {lineitem}""",
    "segment_dim": """select lpad(cast(s_suppkey as string),4,'0') segment_id, r_name ecoregion,
 case s_suppkey%4 when 0 then 'Crude oil' when 1 then 'Natural gas' when 2 then 'Refined product' else 'Other' end commodity_group,
 cast((s_suppkey*7)%50 as double) diameter_in, s_suppkey k,
 case s_suppkey%5 when 0 then 'E' when 1 then 'V' when 2 then 'G' when 3 then 'P' else 'X' end quality_cd, 1+s_suppkey%7 weight,
 case s_suppkey%3 when 0 then 'Transmission' when 1 then 'Gathering' end service, case s_suppkey%4 when 0 then 'In service' when 1 then 'Abandoned' else 'Not recorded' end status
 from {supplier} join {nation} on s_nationkey=n_nationkey join {region} on n_regionkey=r_regionkey""",
    "drought": """select lpad(cast(l_suppkey as string),4,'0') segment_id, year(l_shipdate) as year, l_discount*100-5 pdsi from {lineitem} where month(l_shipdate) in (3,4)""",
    "line_vertices": """select lpad(cast(s_suppkey as string),4,'0') line_uid, k.seq seq,
 cast((s_suppkey*7919)%100000 + k.seq*700 as double) x, cast((s_suppkey*104729)%100000 + ((k.seq*s_suppkey)%3)*200 as double) y
 from {supplier} cross join (values (0),(1),(2),(3),(4)) as k(seq)""",
    "spill_points": """select concat('S',lpad(cast(c_custkey as string),6,'0')) spill_id, cast((c_custkey*6151)%100000 as double) x,
 cast((c_custkey*3571)%100000 as double) y, abs(c_acctbal)/100 barrels, c_mktsegment cause from {customer}""",
    "region_edges": """select r_name region, e.i i, cast(r_regionkey*21000.0+e.ax as double) x1, cast(e.ay as double) y1, cast(r_regionkey*21000.0+e.bx as double) x2, cast(e.by2 as double) y2
 from {region} cross join (values (0,0.0,0.0,21000.0,0.0),(1,21000.0,0.0,21000.0,101000.0),(2,21000.0,101000.0,10500.0,60000.0),
 (3,10500.0,60000.0,0.0,101000.0),(4,0.0,101000.0,0.0,0.0)) as e(i,ax,ay,bx,by2)""",
    "pixels": """select (l_orderkey*37+l_linenumber)%1000 px, (l_partkey*53)%1000 py, cast(l_shipdate as date) dt, l_suppkey%2 orbit, l_orderkey%2 tile,
 l_discount+0.05 b4, l_quantity/50 b8, l_tax+0.1 b11, l_discount*l_tax+0.02 b2, (l_partkey%100)/cast(100.0 as double) cs_cdf, cast(l_suppkey%12 as int) scl,
 case l_returnflag when 'A' then 41 when 'N' then 52 else 11 end landcover, l_suppkey%50 zone, cast(l_linenumber*7 as double) sun_zenith from {lineitem}""",
    "site_obs": """select cast(floor(l_partkey/10) as bigint) event_no, l_partkey%10 site_k,
 case when l_partkey%10=0 then 'spill' when l_partkey%10<=5 then 'candidate' else 'regional' end site,
 ((l_partkey%10)-3)*500 offset_m, year(l_shipdate) as year, quarter(l_shipdate) as qtr, l_orderkey%2 orbit, l_orderkey%3 image,
 case l_linenumber%2 when 0 then '0-25' else '25-50' end ring, case l_returnflag when 'A' then 41 when 'N' then 42 else 71 end landcover,
 l_discount*5-l_tax m, cast(l_quantity as bigint) n from {lineitem}""",
    "sites": """select cast(floor(p_partkey/10) as bigint) event_no, p_partkey%10 site_k,
 case when p_partkey%10=0 then 'spill' when p_partkey%10<=5 then 'candidate' else 'regional' end site, ((p_partkey%10)-3)*500 offset_m,
 (p_partkey*7)%11<>3 same_ecoregion, (p_partkey*5)%13=4 other_within_1km from {part}""",
    "site_fixed": """select cast(floor(l_partkey/10) as bigint) event_no, l_partkey%10 site_k, case l_linenumber%2 when 0 then '0-25' else '25-50' end ring,
 case when l_quantity>15 then 1 else 2 end soil, l_discount*200 hand_m, l_tax*200 slope_deg from {lineitem}""",
    "event_dim": """select cast(floor(p_partkey/10) as bigint) event_no, make_date(cast(1997+cast(floor(p_partkey/10) as bigint)%3 as int),4,15) event_date,
 cast(p_size*3 as double) barrels, p_type cause from {part} where p_partkey%10=0""",
    "places": """select vec_id place_id, case when label<=1 then 'spill site' else 'segment band' end kind, 2017+vec_id%3 as year, label, embedding vec from {embeddings}""",
    "embedding_export": """select case vec_id%4 when 0 then 'sample_row' when 1 then 'sample_comparison' else 'sites' end which, vec_id%9 pixels, 2017+cast(floor(vec_id/4) as bigint)%3 as year, embedding,
 case when vec_id%4<2 then lpad(cast(cast(floor(vec_id/4) as bigint)%12 as string),4,'0') else concat('P',cast(cast(floor(vec_id/4) as bigint) as string)) end place_id from {embeddings}""",
    "place_sites": """select distinct concat('P',cast(cast(floor(vec_id/4) as bigint) as string)) site_id, concat('S',cast(cast(floor(vec_id/4) as bigint)%40 as string)) spill_id,
 case cast(floor(vec_id/4) as bigint)%3 when 0 then 'spill' else 'candidate' end site, concat('region ',cast(cast(floor(vec_id/4) as bigint)%5 as string)) site_ecoregion from {embeddings}""",
    "reports": """select doc_id report_no, text narrative, case doc_id%3 when 0 then 'yes' when 1 then 'no' else 'unknown' end soil_removed,
 case doc_id%2 when 0 then 'patrol' else 'landowner' end how_found, case when doc_id%3=0 then 'vacuum, soil removed' end cleanup, case when doc_id%5=0 then 'yes' else 'no' end reached_water, case doc_id%4 when 0 then 'yes' when 1 then 'no' when 2 then 'unknown' end plants, 2010+doc_id%15 as year,
 case when doc_id%7=0 then ' .' when doc_id%2=0 then substr(text,5,30) else 'QZX not in the text' end quote from {documents}""",
    "part_tables": """select concat(cast(o_orderkey as string), case when o_orderkey%2=0 then ' ' else '_' end, o_orderstatus) raw_id, o_orderstatus region,
 case when o_orderkey%10=0 then null else o_totalprice end val, o_orderkey k from {orders}""",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view as a lazy DataFrame over the Parquet tables."""
    text = VIEWS[name]
    return spark.sql(text, **{t: table(spark, sf_dir, t) for t in set(re.findall(r"{(\w+)}", text))})


def twin(body: str, **ctes: str) -> str:
    """DuckDB text of ``body`` with the views it names, and further steps, before it."""
    used = [v for v in VIEWS if re.search(rf"\b{v}\b", body + " ".join(ctes.values()))]
    steps = [f"{v} as ({re.sub(r'[{}]', '', VIEWS[v])})" for v in used] + [f"{k} as ({v})" for k, v in ctes.items()]
    return ("with " + ",\n".join(steps) + "\n" if steps else "") + body
