"""Queries of files and of the incremental ingest; each writes what it reads to the shared folder first."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import linear
from ..registry import query
from ..sources import files
from ..streaming import springs
from . import corridor
from .fixtures import table, twin, view
from .tables import TABLES


def N():
    return F.count(F.lit(1))


#: What a piece of a spring's measurements holds, in its file's order.
PIECE = "segment_id string, ring string, landcover int, pass_date long, orbit long, image long, m double, n long, doy int, remark string"


@query("s1_measurement_scan", twin("select year, count(*) as rows_read, sum(n) as pixels from zone_obs group by 1"))
def _(spark, d):
    """Pieces of springs as files of delimited text; three columns of them are read."""
    path = files.scratch(spark, "pieces")
    names = [f.split(" ")[0] for f in PIECE.split(", ")]
    rows = view(spark, d, "zone_obs").withColumns({"remark": F.lit("as measured, 20 m"), "spring": F.concat(F.lit("per_image_"), F.col("year").cast("string"))})
    rows.select(*names, "spring").write.partitionBy("spring").option("header", True).csv(path)
    read = files.scan_springs(spark, path, PIECE, ["segment_id", "n"])
    return read.groupBy(F.col("spring").alias("year")).agg(N().alias("rows_read"), F.sum("n").alias("pixels"))


@query("s2_year_from_name", "select year(l_shipdate) as year, count(*) as n from lineitem group by 1")
def _(spark, d):
    path = files.scratch(spark, "springs")
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_quantity", F.concat(F.lit("spring_"), F.year("l_shipdate").cast("string")).alias("spring"))
    rows.write.partitionBy("spring").csv(path)
    read = files.scan(spark, path, "l_orderkey long, l_quantity double", recursiveFileLookup="true")
    return read.groupBy(files.year_of(F.col("source_path")).alias("year")).agg(N().alias("n"))


@query("s3_wide_text", "select c_mktsegment, count(*) as n, round(sum(c_acctbal),2) as balance from customer group by 1")
def _(spark, d):
    path = files.scratch(spark, "reports")
    rows = table(spark, d, "customer").select(*(F.col(c).cast("string") for c in ("c_custkey", "c_mktsegment", "c_acctbal")), F.lit("café").alias("note"))
    rows.write.option("sep", "\t").option("encoding", "ISO-8859-1").csv(path)
    read = files.scan(spark, path, "c_custkey string, c_mktsegment string, c_acctbal string, note string", sep="\t", encoding="ISO-8859-1").where("note = 'café'")
    return read.groupBy("c_mktsegment").agg(N().alias("n"), F.round(F.sum(F.col("c_acctbal").try_cast("double")), 2).alias("balance"))


@query("s5_merge_with_provenance", "select count(*) as n, count(distinct n_regionkey) as files, round(sum(s_acctbal),2) as balance from supplier join nation on s_nationkey=n_nationkey")
def _(spark, d):
    path = files.scratch(spark, "regions")
    rows = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    rows.select("s_suppkey", "s_acctbal", F.lit(4267).alias("srid"), F.col("n_regionkey").alias("part")).write.partitionBy("part").parquet(path)
    merged = files.merge(spark.read.parquet(path))
    return merged.agg(N().alias("n"), F.countDistinct("part").alias("files"), F.round(F.sum("s_acctbal"), 2).alias("balance"))


@query("s7_skip_finished", twin("select ecoregion, count(*) as segments from segment_dim group by 1"))
def _(spark, d):
    """Three regions are written first; the second run adds only the others."""
    path, rows = files.scratch(spark, "zones"), view(spark, d, "segment_dim")
    first = files.write_missing(rows.where("ecoregion < 'B'"), path, "ecoregion")
    return files.write_missing(rows, path, "ecoregion", done=first).groupBy("ecoregion").agg(N().alias("segments"))


@query("s8_wkt_export", twin("select line_uid as zone_id, 'LINESTRING ('||string_agg(printf('%.6f %.6f', x, y), ', ' order by seq)||')' as wkt from line_vertices group by 1"))
def _(spark, d):
    path = files.scratch(spark, "wkt")
    lists = view(spark, d, "line_vertices").groupBy("line_uid").agg(F.array_sort(F.collect_list(F.struct("seq", "x", "y"))).alias("p"))
    out = lists.select(F.col("line_uid").alias("zone_id"), files.wkt(F.col("p")).alias("wkt"))
    out.repartitionByRange("zone_id").sortWithinPartitions("zone_id").write.option("header", "true").csv(path)
    return spark.read.option("header", "true").schema("zone_id string, wkt string").csv(path)


@query("s11_manifest")
def _(spark, d):
    """Every file of every table."""
    return files.manifest(spark, d).select("name", "bytes", "sha256")


@query("s12_catalog", "select name, case when regexp_matches(name,'^(line|supp|part)') then 'measurement table' when regexp_matches(name,'^(cust|nation|region)') then 'place table' when regexp_matches(name,'^(doc|page|bench|label|conv)') then 'text table' when regexp_matches(name,'^(embed)') then 'discovery table' else 'other table' end as kind, n_rows, n_columns, true as has_files from (" + " union all ".join(f"select '{t}' as name, count(*) as n_rows, {n} as n_columns from {t}" for t, (n, _) in TABLES.items()) + ")")
def _(spark, d):
    found = files.catalog(spark, d, list(TABLES))
    return found.select("name", "kind", "n_rows", F.size(F.split("columns", ", ")).alias("n_columns"), ((F.col("files") > 0) & (F.col("bytes") > 0) & F.col("updated").isNotNull()).alias("has_files"))


@query("s13_sinks", twin("select year, count(*) as n_rows from per group by 1", **corridor.SPRINGS))
def _(spark, d):
    path = files.scratch(spark, "tables")
    corridor.springs(spark, d).write.partitionBy("year").parquet(path)
    return spark.read.parquet(path).groupBy(F.col("year")).agg(N().alias("n_rows"))


@query("m1_incremental_ingest", twin("select year, ring, count(*) as segments, round(sum(diff_all),6) as total from per group by 1,2", **corridor.SPRINGS))
def _(spark, d):
    """Measurements arrive in two lots, the second with late pieces of springs that the first had too."""
    base = files.scratch(spark, "ingest")
    obs = view(spark, d, "zone_obs")
    schema = obs.schema
    for lot in (0, 1):
        obs.where(F.col("orbit") == lot).write.mode("append").parquet(f"{base}/in")
        springs.ingest(spark, f"{base}/in", schema, f"{base}/store", f"{base}/out", f"{base}/state")
    return springs.current(spark, f"{base}/out").groupBy("year", "ring").agg(N().alias("segments"), F.round(F.sum("diff_all"), 6).alias("total"))


HC3 = {
    "xy": "select cast(l_linenumber as double) x, l_quantity y from lineitem",
    "mm": "select count(*) n, avg(x) mx, avg(y) my, regr_slope(y,x) b, regr_intercept(y,x) a, regr_r2(y,x) r2, regr_sxx(y,x) sxx from xy",
    "rs": "select x-mx dx, (y-a-b*x)/(1-(1.0::double/n+(x-mx)*(x-mx)/sxx)) e, n, mx, sxx from xy, mm",
    "se": "select sqrt(sum(dx*dx*e*e))/any_value(sxx) sb, sqrt(sum((1.0::double/n-mx*dx/sxx)*(1.0::double/n-mx*dx/sxx)*e*e)) sa from rs",
    "bt": "select 'line' as term, b as estimate, sb as s, n, r2 from mm, se union all select 'intercept', a, sa, n, r2 from mm, se",
}


@query("a18_robust_regression", twin("select term, round(estimate,6) as estimate, round(s,6) as se, round(estimate-1.959964*s,6) as lo95, round(estimate+1.959964*s,6) as hi95, n, round(r2,6) as r2 from bt", **HC3))
def _(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_linenumber").cast("double").alias("line"), "l_quantity")
    fit = linear.robust_fit(rows, "l_quantity", ["line"])
    return spark.createDataFrame([(r["term"], *(round(r[k], 6) for k in ("estimate", "se", "lo95", "hi95")), r["n"], round(r["r2"], 6)) for r in fit], "term string, estimate double, se double, lo95 double, hi95 double, n long, r2 double")
