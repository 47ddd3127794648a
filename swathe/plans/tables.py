"""Queries of audits, joins, sets and top lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ranks
from ..operators import tables as T
from ..registry import query
from .fixtures import table, twin, view


def N():
    return F.count(F.lit(1))


@query("a6_thermal_springs", "select l_suppkey, year, round(median(v),9) as lst, count(*) as dates from (select l_suppkey, year(l_shipdate) as year, cast(l_shipdate as date) dt, sum(l_tax*l_quantity)/sum(l_quantity) v from lineitem group by 1,2,3 having sum(l_quantity)>=5) group by 1,2")
def _(spark, d):
    per = table(spark, d, "lineitem").groupBy("l_suppkey", F.year("l_shipdate").alias("year"), F.to_date("l_shipdate").alias("dt")).agg((F.sum(F.col("l_tax") * F.col("l_quantity")) / F.sum("l_quantity")).alias("v"), F.sum("l_quantity").alias("q")).where("q >= 5")
    return per.groupBy("l_suppkey", "year").agg(F.round(F.median("v"), 9).alias("lst"), N().alias("dates"))


@query("a19_describe", "select o_orderpriority, count(*) as n, count(distinct o_custkey) as customers, round(quantile_cont(o_totalprice,0.25),6) as p25, round(quantile_cont(o_totalprice,0.5),6) as p50, round(quantile_cont(o_totalprice,0.75),6) as p75 from orders group by 1")
def _(spark, d):
    o = table(spark, d, "orders").select("o_orderpriority", "o_custkey", "o_totalprice")
    counts = o.groupBy("o_orderpriority").agg(N().alias("n"), F.countDistinct("o_custkey").alias("customers"))
    points = ranks.quantiles(o, ["o_orderpriority"], "o_totalprice", {"p25": 0.25, "p50": 0.5, "p75": 0.75})
    return counts.join(points, "o_orderpriority").withColumns({p: F.round(p, 6) for p in ("p25", "p50", "p75")})


@query("a20_threshold_counts", twin("select cause, count(*) as n, count(*) filter (barrels<=10) as within_10, count(*) filter (barrels<=25) as within_25, count(*) filter (barrels<=50) as within_50 from spill_points group by 1 union all select 'all', count(*), count(*) filter (barrels<=10), count(*) filter (barrels<=25), count(*) filter (barrels<=50) from spill_points"))
def _(spark, d):
    rows = view(spark, d, "spill_points").withColumn("cause", F.explode(F.array("cause", F.lit("all"))))
    return rows.groupBy("cause").agg(N().alias("n"), *(F.count_if(F.col("barrels") <= k).alias(f"within_{k}") for k in (10, 25, 50)))


@query("a21_table_audit", twin("select count(*) as n_rows, count(*) filter (val is null) as blanks, round(100.0::double*count(*) filter (val is null)/count(*),6) as blank_pct, count(raw_id)-count(distinct raw_id) as duplicates, count(*) filter (contains(raw_id,' ')) as spaces, count(*) filter (contains(raw_id,'_')) as underscores, min(val) as least, round(avg(val),6) as mean, max(val) as most, max(length(regexp_extract(raw_id,'^(\\d+)',1))) as longest_number from part_tables"))
def _(spark, d):
    return T.profile(view(spark, d, "part_tables"), "raw_id", "val")


COMBINED = "select raw_id, val + case when k%7=0 then 0.25::double else 0 end val from part_tables where region<>'P' and k%11<>0"


@query("a22_combined_vs_parts", twin("select coalesce(region,'all') as region, count(*) as n_rows, count(c.raw_id) as found, count(*)-count(c.raw_id) as missing, round(max(abs(p.val-c.val)),6) as max_diff from part_tables p left join combined c on p.raw_id=c.raw_id group by grouping sets ((region),())", combined=COMBINED))
def _(spark, d):
    """The combined table leaves region P and some rows out and differs in others; parts are looked up in it by key."""
    parts, k = view(spark, d, "part_tables"), F.col("k")
    combined = parts.where("region <> 'P' and k % 11 <> 0").select("raw_id", (F.col("val") + F.when(k % 7 == 0, 0.25).otherwise(0.0)).alias("val"))
    return T.lineage(parts, combined, "raw_id", "region", "val").withColumn("max_diff", F.round("max_diff", 6))


@query("a23_share_of_total", "select o_orderstatus, count(*) as pieces, round(sum(o_totalprice),2) as amount, round(100.0::double*count(*)/sum(count(*)) over (),6) as pieces_pct, round(100*sum(o_totalprice)/sum(sum(o_totalprice)) over (),6) as amount_pct from orders group by 1")
def _(spark, d):
    return T.share_of_total(table(spark, d, "orders"), ["o_orderstatus"], F.col("o_totalprice")).select("o_orderstatus", "pieces", F.round("amount", 2).alias("amount"), F.round("pieces_pct", 6).alias("pieces_pct"), F.round("amount_pct", 6).alias("amount_pct"))


@query("a24_step_retention", "select l_returnflag, count(*) as before, count(*) filter (l_quantity>=10) as after, round(100.0::double*count(*) filter (l_quantity>=10)/count(*),6) as kept_pct, round(100*sum(case when l_quantity>=10 then l_quantity end)/sum(l_quantity),6) as kept_area_pct, count(*) filter (l_quantity<2) as small from lineitem group by 1")
def _(spark, d):
    q = F.col("l_quantity")
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(N().alias("before"), F.count_if(q >= 10).alias("after"), F.round(100 * F.count_if(q >= 10) / N(), 6).alias("kept_pct"), F.round(100 * F.sum(F.when(q >= 10, q)) / F.sum(q), 6).alias("kept_area_pct"), F.count_if(q < 2).alias("small"))


@query("a25_repeat_spread", "select count(*) as keys, count(*) filter (n>1) as repeated, round(median(spread) filter (n>1),9) as median_spread, round(quantile_cont(spread,0.95) filter (n>1),9) as p95_spread from (select l_suppkey, l_partkey, cast(l_shipdate as date), count(*) n, max(l_tax)-min(l_tax) spread from lineitem group by 1,2,3)")
def _(spark, d):
    per = table(spark, d, "lineitem").groupBy("l_suppkey", "l_partkey", F.to_date("l_shipdate").alias("dt")).agg(N().alias("n"), (F.max("l_tax") - F.min("l_tax")).alias("spread"))
    sums = per.agg(N().alias("keys"), F.count_if(F.col("n") > 1).alias("repeated"))
    points = ranks.quantiles(per.where("n > 1"), [], "spread", {"median_spread": 0.5, "p95_spread": 0.95})
    return sums.crossJoin(F.broadcast(points)).withColumns({c: F.round(c, 9) for c in ("median_spread", "p95_spread")})


@query("a28_clear_date_coverage", twin("select median(k) as median_dates, quantile_cont(k,0.1) as p10_dates, min(k) as least_dates, count(*) filter (k<5) as under_5 from (select zone, count(distinct dt) k from pixels where cs_cdf>=0.6 group by 1)"))
def _(spark, d):
    per = view(spark, d, "pixels").where("cs_cdf >= 0.6").groupBy("zone").agg(F.countDistinct("dt").alias("k"))
    return per.agg(F.median("k").alias("median_dates"), F.percentile("k", 0.1).alias("p10_dates"), F.min("k").alias("least_dates"), F.count_if(F.col("k") < 5).alias("under_5"))


@query("a29_class_mix", twin("select landcover, round(sum(n)/(select sum(n) from zone_obs)::double,9) as share from zone_obs group by 1 order by share desc, landcover limit 8"))
def _(spark, d):
    sums = view(spark, d, "zone_obs").groupBy("landcover").agg(F.sum("n").alias("n"))
    total = sums.agg(F.sum("n").alias("t"))
    return sums.crossJoin(F.broadcast(total)).select("landcover", F.round(F.col("n") / F.col("t"), 9).alias("share")).orderBy(F.desc("share"), "landcover").limit(8)


@query("a31_two_method_agreement", "select l_returnflag, count(*) as n, count(*) filter (abs(l_quantity-l_linenumber*7)<=20) as agree, round(median(case when abs(l_quantity-l_linenumber*7)<=20 then (l_quantity+l_linenumber*7)/2 end),6) as median_value from lineitem group by 1")
def _(spark, d):
    a, b = F.col("l_quantity"), F.col("l_linenumber") * 7
    rows = table(spark, d, "lineitem").select("l_returnflag", (F.abs(a - b) <= 20).alias("ok"), ((a + b) / 2).alias("value"))
    counts = rows.groupBy("l_returnflag").agg(N().alias("n"), F.count_if("ok").alias("agree"))
    points = ranks.quantiles(rows.where("ok"), ["l_returnflag"], "value", {"median_value": 0.5})
    return counts.join(points, "l_returnflag", "left").withColumn("median_value", F.round("median_value", 6))


@query("j6_semi_anti", "select 'semi' as side, count(*) as n from customer where c_custkey in (select o_custkey from orders) union all select 'anti', count(*) from customer where c_custkey not in (select o_custkey from orders)")
def _(spark, d):
    c, o = table(spark, d, "customer"), table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return c.join(o, "c_custkey", "left_semi").agg(F.lit("semi").alias("side"), N().alias("n")).unionByName(c.join(o, "c_custkey", "left_anti").agg(F.lit("anti").alias("side"), N().alias("n")))


@query("j7_text_key_join", twin("select r.report_no, l.quality from reports r left join labels l on cast(r.report_no as varchar)=cast(l.doc_id as varchar)"))
def _(spark, d):
    key = lambda c: F.regexp_replace(F.trim(c), r"\.0$", "")
    left = view(spark, d, "reports").select("report_no", key(F.concat(F.col("report_no").cast("string"), F.lit(".0"))).alias("k"))
    right = table(spark, d, "labels").select(key(F.col("doc_id").cast("string")).alias("k"), "quality")
    return left.join(right, "k", "left").select("report_no", "quality")


TWO = {"old": "select o_orderkey k, o_totalprice a from orders", "new": "select o_orderkey k, case when o_orderkey%10=0 then null else o_totalprice + (o_orderkey%7)*0.01 end b from orders where o_orderkey%9<>0"}


def two(spark, d):
    o = table(spark, d, "orders")
    k = F.col("o_orderkey")
    return o.select(k.alias("k"), F.col("o_totalprice").alias("a")), o.where("o_orderkey % 9 <> 0").select(k.alias("k"), F.when(k % 10 != 0, F.col("o_totalprice") + (k % 7) * F.lit(0.01)).alias("b"))


@query("j8_table_comparison", twin("select count(*) as n_rows, round(corr(a,b),6) as r, round(median(abs(a-b)),6) as median_diff, round(quantile_cont(abs(a-b),0.95),6) as p95_diff, round(max(abs(a-b)),6) as max_diff, round(avg(case when abs(a-b) is null then null when abs(a-b)<=0.025 then 1.0::double else 0 end),6) as within, count(*) filter (a is null and b is not null) as only_new, count(*) filter (a is not null and b is null) as only_old from old join new using (k)", **TWO))
def _(spark, d):
    return T.compare(*two(spark, d), "k", "a", "b", 0.025)


@query("j12_field_join", "select o.o_orderkey, c.c_mktsegment from orders o left join customer c on o.o_custkey=c.c_custkey and c.c_custkey%2=0")
def _(spark, d):
    right = table(spark, d, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    return table(spark, d, "orders").join(right, "o_custkey", "left").select("o_orderkey", "c_mktsegment")


@query("j13_row_reconciliation", "select s.o_orderstatus, s.o_orderpriority, s.n as shape_rows, coalesce(t.n,0) as table_rows, s.n-coalesce(t.n,0) as difference from (select o_orderstatus,o_orderpriority,count(*) n from orders group by 1,2) s left join (select o_orderstatus,o_orderpriority,count(*) n from orders where o_orderkey%5<>0 and o_orderstatus<>'P' group by 1,2) t using (o_orderstatus,o_orderpriority)")
def _(spark, d):
    o, by = table(spark, d, "orders"), ["o_orderstatus", "o_orderpriority"]
    there = o.where("o_orderkey % 5 <> 0 and o_orderstatus <> 'P'").groupBy(*by).agg(N().alias("t"))
    return o.groupBy(*by).agg(N().alias("shape_rows")).join(there, by, "left").select(*by, "shape_rows", F.coalesce("t", F.lit(0)).alias("table_rows"), (F.col("shape_rows") - F.coalesce("t", F.lit(0))).alias("difference"))


LINKS = {"ds": "select n_nationkey id, concat_ws(',', cast(n_regionkey as varchar)||'r', case when n_nationkey>=5 then cast(n_nationkey-5 as varchar) end) inputs from nation"}


def datasets(spark, d):
    k = F.col("n_nationkey")
    return table(spark, d, "nation").select(k.alias("id"), F.concat_ws(",", F.concat(F.col("n_regionkey").cast("string"), F.lit("r")), F.when(k >= 5, (k - 5).cast("string"))).alias("inputs"))


@query("j14_v11_lineage", twin("select a.id, b.id as downstream from ds a join (select id, unnest(string_split(inputs,',')) i from ds) b on b.i=cast(a.id as varchar)", **LINKS))
def _(spark, d):
    ds = datasets(spark, d)
    links = ds.select(F.col("id").alias("downstream"), F.explode(F.split("inputs", ",")).alias("i"))
    return ds.join(links, F.col("id").cast("string") == F.col("i")).select("id", "downstream")


@query("j15_composite_agreement", twin("select landcover, count(*) as n, round(corr(a,b),6) as r, round(avg(a-b),9) as bias, round(sqrt(avg((a-b)*(a-b))),9) as rmse from (select segment_id, landcover, avg(m) a, median(m) b from zone_obs group by 1,2 having count(distinct pass_date)>=5 and sum(n)>=10) group by 1"))
def _(spark, d):
    per = view(spark, d, "zone_obs").groupBy("segment_id", "landcover").agg(F.avg("m").alias("a"), F.median("m").alias("b"), F.countDistinct("pass_date").alias("k"), F.sum("n").alias("px")).where("k >= 5 and px >= 10")
    e = F.col("a") - F.col("b")
    return per.groupBy("landcover").agg(N().alias("n"), F.round(F.corr("a", "b"), 6).alias("r"), F.round(F.avg(e), 9).alias("bias"), F.round(F.sqrt(F.avg(e * e)), 9).alias("rmse"))


@query("t1_top_k", "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 10")
def _(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10)


@query("t2_limited_display", "select o_orderkey, (select count(*) from orders where o_orderstatus='P') as total from orders where o_orderstatus='P' order by o_orderkey limit 15")
def _(spark, d):
    rows = table(spark, d, "orders").where("o_orderstatus = 'P'")
    return rows.select("o_orderkey").orderBy("o_orderkey").limit(15).crossJoin(F.broadcast(rows.agg(N().alias("total"))))


@query("t4_newest_first", "select o_orderkey, row_number() over (order by o_orderdate desc, o_orderkey) as place from orders qualify place<=20")
def _(spark, d):
    from pyspark.sql import Window

    head = table(spark, d, "orders").select("o_orderkey", "o_orderdate").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(20)
    return head.select("o_orderkey", F.row_number().over(Window.orderBy(F.desc("o_orderdate"), "o_orderkey")).alias("place"))


@query("u1_concat", "select src, count(*) as n from (select 'orders' src, o_orderkey from orders union all select 'lineitem', l_orderkey from lineitem) group by 1")
def _(spark, d):
    a = table(spark, d, "orders").select(F.lit("orders").alias("src"), F.col("o_orderkey").alias("k"))
    return a.unionByName(table(spark, d, "lineitem").select(F.lit("lineitem").alias("src"), F.col("l_orderkey").alias("k"))).groupBy("src").agg(N().alias("n"))


@query("u2_intersections", "select a.s as first_layer, b.s as second_layer, count(*) as shared from (select distinct o_orderstatus s, o_custkey k from orders) a join (select distinct o_orderstatus s, o_custkey k from orders) b on a.k=b.k and a.s<b.s group by 1,2")
def _(spark, d):
    """Pairs of layers come from each customer's few layers, so the large table meets itself nowhere."""
    sets = table(spark, d, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_set("o_orderstatus")).alias("s"))
    pairs = F.flatten(F.transform("s", lambda a: F.transform(F.filter("s", lambda b: b > a), lambda b: F.struct(a.alias("first_layer"), b.alias("second_layer")))))
    return sets.select(F.explode(pairs).alias("p")).groupBy("p.first_layer", "p.second_layer").agg(N().alias("shared"))


@query("u3_set_difference", "select count(*) as only_in_customers from (select c_custkey from customer except select o_custkey from orders)")
def _(spark, d):
    return table(spark, d, "customer").select("c_custkey").subtract(table(spark, d, "orders").select("o_custkey")).agg(N().alias("only_in_customers"))


@query("u5_table_equality", twin("select coalesce(old.k,new.k) as k from old full join new on old.k=new.k where old.a is distinct from new.b and (old.a is null or new.b is null or abs(old.a-new.b)>1e-12+1e-9*abs(new.b))", **TWO))
def _(spark, d):
    a, b = two(spark, d)
    return T.same_rows(a, b.withColumnRenamed("b", "a"), ["k"], ["a"]).select("k")


#: Table, columns and what it holds.
TABLES = {
    "region": (2, "regions"), "nation": (3, "nations"), "customer": (5, "places of events"), "supplier": (4, "segments"), "part": (6, "sites of events"), "orders": (6, "part tables"),
    "lineitem": (11, "measurements"), "events": (6, "event stream"), "documents": (5, "reports"), "embeddings": (3, "places"), "pages": (3, "raw pages"), "benchmark": (2, "passages"),
    "labels": (3, "labels of reports"), "conversations": (4, "turns of conversations"),
}


@query("v1_table_listing", " union all ".join(f"select '{t}' as name, count(*) as n_rows, {n} as n_columns, '{what}' as description from {t}" for t, (n, what) in TABLES.items()))
def _(spark, d):
    found = None
    for name, (_, what) in TABLES.items():
        t = table(spark, d, name)
        row = t.agg(F.lit(name).alias("name"), N().alias("n_rows"), F.lit(len(t.columns)).alias("n_columns"), F.lit(what).alias("description"))
        found = row if found is None else found.unionByName(row)
    return found


@query("v2_ad_hoc_select", twin("select ecoregion, count(*) as n from segment_dim group by 1 limit 200"))
def _(spark, d):
    return spark.sql("select ecoregion, count(*) as n from {segments} group by 1", segments=view(spark, d, "segment_dim")).limit(200)


@query("v8_left_out", twin("select case when o_orderkey%10=0 then 'no comparison' when o_orderkey%7=0 then 'short' else 'kept' end as reason, round(sum(o_totalprice)/1000,6) as km, round(100*sum(o_totalprice)/sum(sum(o_totalprice)) over (),6) as pct, (select count(*) from segment_dim) as sample, (select cast(sum(weight) as bigint) from segment_dim) as population from orders group by 1"))
def _(spark, d):
    """Kilometres kept and left out by reason, beside the sample and the population that its weights add up to."""
    from ..operators.labels import first_reason

    k = F.col("o_orderkey")
    reason = first_reason((k % 10 == 0, "no comparison"), (k % 7 == 0, "short"))
    rows = table(spark, d, "orders").withColumn("reason", F.when(reason == "", "kept").otherwise(reason))
    sample = view(spark, d, "segment_dim").agg(N().alias("sample"), F.sum("weight").cast("long").alias("population"))
    return T.share_of_total(rows, ["reason"], F.col("o_totalprice")).select("reason", F.round(F.col("amount") / 1000, 6).alias("km"), F.round("amount_pct", 6).alias("pct")).crossJoin(F.broadcast(sample))


CHUNK = 1000
BATCHES = {
    "sz": f"select cast(floor((o_orderkey-1)/{CHUNK}) as bigint) chunk, row_number() over (partition by floor((o_orderkey-1)/{CHUNK}) order by o_orderkey) rn, cast(ceil(o_totalprice/1000) as bigint) size from orders",
    "st": "select chunk, batch from (with recursive w(chunk, rn, batch, filled) as (select chunk, rn, 1::bigint, size from sz where rn=1 union all select s.chunk, s.rn, case when filled+s.size>4000 then batch+1 else batch end, case when filled+s.size>4000 then s.size else filled+s.size end from w join sz s on s.chunk=w.chunk and s.rn=w.rn+1) select * from w)",
}


@query("s9_size_bounded_batches", twin("select chunk, max(batch) as batches, count(*) as n from st group by 1", **BATCHES))
def _(spark, d):
    """Greedy batches of at most 4,000 units over the whole table, restarted at each range of keys: a fold over a range's ordered list, which the range bounds."""
    size = F.ceil(F.col("o_totalprice") / 1000).cast("long")
    chunk = F.floor((F.col("o_orderkey") - 1) / CHUNK)
    lists = table(spark, d, "orders").groupBy(chunk.alias("chunk")).agg(F.sort_array(F.collect_list(F.struct("o_orderkey", size.alias("size")))).alias("all"))
    start = F.struct(F.lit(0).cast("long").alias("batches"), F.lit(4001).cast("long").alias("filled"))
    step = lambda a, x: F.when(a["filled"] + x["size"] > 4000, F.struct((a["batches"] + 1).alias("batches"), x["size"].alias("filled"))).otherwise(F.struct(a["batches"].alias("batches"), (a["filled"] + x["size"]).alias("filled")))
    return lists.select("chunk", F.aggregate("all", start, step, lambda a: a["batches"]).alias("batches"), F.size("all").cast("long").alias("n"))


@query("s10_id_range_chunks", "select 'ids' as kind, cast(floor((o_orderkey-lo)/2000) as bigint) as part, count(*) as n from orders, (select min(o_orderkey) lo from orders) group by 2 union all select 'width', least(cast(floor((o_totalprice-lo)/((hi-lo)/8)) as bigint), 7), count(*) from orders, (select min(o_totalprice) lo, max(o_totalprice) hi from orders) group by 2")
def _(spark, d):
    """Chunks of 2,000 ids, and eight parts of equal width of an amount; the largest amount is in the last part."""
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    ends = o.agg(F.min("o_orderkey").alias("first"), F.min("o_totalprice").alias("lo"), F.max("o_totalprice").alias("hi"))
    both = o.crossJoin(F.broadcast(ends))
    width = F.least(F.floor(F.try_divide(F.col("o_totalprice") - F.col("lo"), (F.col("hi") - F.col("lo")) / 8)), F.lit(7))
    parts = F.array(F.struct(F.lit("ids").alias("kind"), F.floor((F.col("o_orderkey") - F.col("first")) / 2000).alias("part")), F.struct(F.lit("width").alias("kind"), width.alias("part")))
    return both.select(F.explode(parts).alias("p")).groupBy("p.kind", "p.part").agg(N().alias("n"))


@query("s14_runs_union", "select 'strict' as matching, count(*) as n, null::bigint as extra from orders where o_orderstatus='F' union all select 'broader', count(*), 1 from orders")
def _(spark, d):
    o = table(spark, d, "orders")
    a = o.where("o_orderstatus = 'F'").agg(N().alias("n")).withColumn("matching", F.lit("strict"))
    return a.unionByName(o.agg(N().alias("n")).withColumns({"matching": F.lit("broader"), "extra": F.lit(1).cast("long")}), allowMissingColumns=True)


FACTS = """select 'rows' as fact, '' as "group", cast(count(*) as double) as val from part_tables union all select 'duplicates', '', count(raw_id)-count(distinct raw_id) from part_tables
 union all select 'empty', '', count(*) filter (val is null) from part_tables union all select 'pieces', region, count(*) from part_tables group by region union all select 'km', region, round(sum(val)/1000,6) from part_tables group by region"""


@query("s15_load_summary", twin(FACTS))
def _(spark, d):
    rows = view(spark, d, "part_tables")
    whole = rows.agg(N().cast("double").alias("r"), (F.count("raw_id") - F.countDistinct("raw_id")).cast("double").alias("u"), F.count_if(F.col("val").isNull()).cast("double").alias("e"))
    by = rows.groupBy("region").agg(N().cast("double").alias("p"), F.round(F.sum("val") / 1000, 6).alias("k"))
    return whole.select(F.expr("stack(3, 'rows', '', r, 'duplicates', '', u, 'empty', '', e) as (fact, `group`, val)")).unionByName(by.select(F.expr("stack(2, 'pieces', region, p, 'km', region, k) as (fact, `group`, val)")))


@query("s16_allow_list", "select c_custkey, c_mktsegment from customer")
def _(spark, d):
    return table(spark, d, "customer").select("c_custkey", "c_mktsegment")


@query("s6_pushed_scan", "select l_orderkey, l_linenumber, l_quantity from lineitem where l_orderkey between 100 and 300 and l_suppkey in (1,2,3,4,5)")
def _(spark, d):
    return table(spark, d, "lineitem").where(F.col("l_orderkey").between(100, 300) & F.col("l_suppkey").isin(1, 2, 3, 4, 5)).select("l_orderkey", "l_linenumber", "l_quantity")


@query("s4_named_tables", twin("select (select count(*) from segment_dim) as segments, (select count(*) from spill_points) as spills"))
def _(spark, d):
    return spark.sql("select (select count(*) from {a}) as segments, (select count(*) from {b}) as spills", a=view(spark, d, "segment_dim"), b=view(spark, d, "spill_points"))
