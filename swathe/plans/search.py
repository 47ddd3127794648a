"""Queries of search, similarity and evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import search as S
from ..registry import query
from .fixtures import table, twin, view

c = F.col


def N():
    return F.count(F.lit(1))

WORDS = "list_distinct(list_filter(regexp_extract_all(lower({0}),'([a-z0-9]+)',1), lambda w: length(w)>2))"
ASKED = "the license and their tion"
SCORE = "len(list_intersect(" + WORDS.format(f"'{ASKED}'") + "," + WORDS.format("narrative") + "))/len(" + WORDS.format(f"'{ASKED}'") + ")::double"
PLAIN = "trim(regexp_replace(lower({0}),'[^a-z0-9]+',' ','g'))"


def places(spark, d):
    return view(spark, d, "places")


@query("e1_unit_vectors", twin("select place_id, round(list_sum(list_transform(vec::double[], lambda x: x*x))/list_dot_product(vec::double[],vec::double[]),6) as norm, round((vec::double[])[1]/sqrt(list_dot_product(vec::double[],vec::double[])),6) as first_value from places"))
def _(spark, d):
    rows = places(spark, d).select("place_id", S.unit(c("vec")).alias("u"))
    return rows.select("place_id", F.round(S.dot(c("u"), c("u")), 6).alias("norm"), F.round(F.get("u", F.lit(0)), 6).alias("first_value"))


@query("e2_similar_places", twin("select place_id, kind, round(list_cosine_similarity(vec::double[], s.v),6) as cosine from places, (select vec::double[] v from places where place_id=3) s where place_id<>3 and year=2017 and kind='segment band' order by list_cosine_similarity(vec::double[], s.v) desc, place_id limit 10"))
def _(spark, d):
    p = places(spark, d)
    seed = p.where("place_id = 3").select(c("place_id").alias("probe"), c("vec").alias("pvec"))
    rows = S.against(p.where("year = 2017 and kind = 'segment band' and place_id <> 3"), seed)
    return rows.orderBy(F.desc("cosine"), "place_id").limit(10).select("place_id", "kind", F.round("cosine", 6).alias("cosine"))


@query("e3_j11_places_like_spills", twin("select place_id, round(max(cs),6) as cosine, min_by(probe, (-cs, probe)) as nearest from (select a.place_id, b.place_id probe, list_cosine_similarity(a.vec::double[], b.vec::double[]) cs from places a, places b where a.kind='segment band' and a.year=2018 and b.kind='spill site' and b.year=2018) group by 1 order by max(cs) desc, place_id limit 25"))
def _(spark, d):
    p = places(spark, d).where("year = 2018")
    best = S.nearest(p.where("kind = 'segment band'"), p.where("kind = 'spill site'").select(c("place_id").alias("probe"), c("vec").alias("pvec")), "place_id")
    return best.orderBy(F.desc("cosine"), "place_id").limit(25).select("place_id", F.round("cosine", 6).alias("cosine"), "nearest")


@query("a27_pixel_weighted_embedding", twin("select label, k as dim, round(sum(x*w)/sum(w),6) as val from (select label, 1+place_id%7 w, unnest(vec::double[]) x, generate_subscripts(vec,1)-1 k from places) group by 1,2"))
def _(spark, d):
    rows = places(spark, d).select("label", (1 + c("place_id") % 7).alias("w"), F.posexplode("vec").alias("dim", "x"))
    return rows.groupBy("label", "dim").agg(F.round(F.sum(c("x").cast("double") * c("w")) / F.sum("w"), 6).alias("val"))


@query("g25_embedding_zonal_mean", twin("select label, year, k as band, count(*) as pixels, round(avg(x),6) as mean from (select label, year, unnest(vec::double[]) x, generate_subscripts(vec,1)-1 k from places) group by 1,2,3"))
def _(spark, d):
    """Mean and pixel count of all 64 bands of each zone and year."""
    long = places(spark, d).select("label", "year", F.posexplode("vec").alias("band", "x"))
    return long.groupBy("label", "year", "band").agg(F.round(F.avg(c("x").cast("double")), 6).alias("mean"), N().alias("pixels"))


@query("e4_keyword_score", twin(f"select report_no, round({SCORE},6) as score from reports"))
def _(spark, d):
    return view(spark, d, "reports").select("report_no", F.round(S.keyword_score(ASKED, c("narrative")), 6).alias("score"))


HYBRID = f"0.8::double*list_cosine_similarity(e.embedding::double[], s.v)+0.2::double*({SCORE})"


def hybrid(spark, d, rows=None):
    e = table(spark, d, "embeddings")
    probe = e.where("vec_id = 0").select(c("vec_id").alias("probe"), c("embedding").alias("pvec"))
    cos = S.against(e.select(c("vec_id").alias("report_no"), "embedding"), probe, "embedding")
    rows = view(spark, d, "reports") if rows is None else rows
    return rows.join(cos, "report_no").withColumn("score", 0.8 * c("cosine") + 0.2 * S.keyword_score(ASKED, c("narrative")))


@query("e5_hybrid_rank", twin(f"select report_no, round({HYBRID},6) as score from reports join embeddings e on report_no=e.vec_id, (select embedding::double[] v from embeddings where vec_id=0) s order by {HYBRID} desc, report_no limit 10"))
def _(spark, d):
    return hybrid(spark, d).orderBy(F.desc("score"), "report_no").limit(10).select("report_no", F.round("score", 6).alias("score"))


FILTERS = "how_found='patrol' and contains(coalesce(cleanup,''),'soil') and soil_removed='yes' and reached_water='no' and year>=2012"


@query("e6_filtered_search", twin(f"select report_no, round({HYBRID},6) as score, (select count(*) from reports where {FILTERS}) as matching, (select count(*) from reports) as searched from (select * from reports where {FILTERS}) join embeddings e on report_no=e.vec_id, (select embedding::double[] v from embeddings where vec_id=0) s order by {HYBRID} desc, report_no limit 8"))
def _(spark, d):
    """The reports that pass the filters, closest first by meaning and words together, beside how many pass and how many there are."""
    every = view(spark, d, "reports")
    rows = every.where((c("how_found") == "patrol") & F.coalesce(c("cleanup"), F.lit("")).contains("soil") & (c("soil_removed") == "yes") & (c("reached_water") == "no") & (c("year") >= 2012))
    top = hybrid(spark, d, rows).orderBy(F.desc("score"), "report_no").limit(8).select("report_no", F.round("score", 6).alias("score"))
    return top.crossJoin(F.broadcast(rows.agg(N().alias("matching")))).crossJoin(F.broadcast(every.agg(N().alias("searched"))))


CLAIMED = f"soil_removed='unknown' or ({PLAIN.format('quote')}<>'' and contains({PLAIN.format('narrative')},{PLAIN.format('quote')}))"


@query("e7_v12_quote_support", twin(f"select report_no, soil_removed, how_found, year, coalesce({CLAIMED},false) as supported from reports"))
def _(spark, d):
    """A report's facts and whether the answer's quote is really in it."""
    return view(spark, d, "reports").select("report_no", "soil_removed", "how_found", "year", S.supported(c("soil_removed"), c("quote"), c("narrative")).alias("supported"))


#: Fields that are read from a report, and where the quote for each comes from here.
QUOTES = {"how_found": "quote", "cleanup": "substr(narrative,1,20)", "soil_removed": "quote", "reached_water": "case when report_no%3=0 then substr(narrative,3,25) else 'QZX never said' end", "plants": "case when report_no%6=0 then '...' else substr(narrative,2,12) end"}
HELD = f"({PLAIN.format('quote')}<>'' and contains({PLAIN.format('narrative')},{PLAIN.format('quote')}))"
FIELDS = " union all ".join(f"select report_no, narrative, '{f}' as field, {f} as answer, coalesce({q},'') as quote from reports" for f, q in QUOTES.items())


@query("v12_report_fields", twin(f"select report_no, field, answer, quote, coalesce(answer is null or answer in ('unknown','none stated','') or {HELD},false) as supported from fl", fl=FIELDS))
def _(spark, d):
    """Every field that was read from a report, with its quote and whether the report says so."""
    rows = view(spark, d, "reports").selectExpr("*", *(f"{q} as q_{f}" for f, q in QUOTES.items()))
    return S.evidence(rows, "report_no", {f: f"q_{f}" for f in QUOTES}, "narrative")


@query("e8_number_support", "select o_orderkey, 4 as checked, case when o_orderkey%5=0 then 1 else 0 end + case when o_orderkey%3=0 then 1 else 0 end as unsupported from orders")
def _(spark, d):
    """Answers built from a table: an amount with thousands, altered for every fifth order, a percentage of a fraction, a fraction that nothing supports
    in every third, a power of ten, and a year and ids that aren't checked."""
    p, k = F.round("o_totalprice", 1), c("o_orderkey")
    said = F.concat(F.lit("In 2024 S123 came to "), F.format_number(F.when(k % 5 == 0, p + 7).otherwise(p), 1), F.lit(" or 25% of A12, that is "), F.when(k % 3 == 0, "25.0").otherwise("0.25"), F.lit(" at 3.9e-04."))
    proof = F.concat(F.lit("amount "), F.format_string("%.1f", p), F.lit(" share 0.25 rate -0.00039"))
    return table(spark, d, "orders").select("o_orderkey", S.number_check(said, proof).alias("x")).select("o_orderkey", "x.checked", F.size("x.unsupported").alias("unsupported"))


#: Answers about orders: an amount that is wrong for every fifth, a word that is missing in two of three, a count.
SCORED = {
    "an": "select o_orderpriority, o_orderkey k, round(o_totalprice,2)::double p, 'The total is '||printf('%.2f', round(o_totalprice,2)::double + case when o_orderkey%5=0 then 7 else 0 end)||case when o_orderkey%3=0 then ', and the Order-Status is settled' else ', still open' end||case when o_orderkey%4=0 then ', -'||(o_orderkey%9)||' items' else '' end answer from orders",
    "nm": r"select *, list_transform(regexp_extract_all(answer, '[-−]?(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?(?:[eE][-+]?\d+)?'), lambda t: abs(replace(replace(t,'−','-'),',','')::double)) said from an",
    "hit": "select o_orderpriority, len(list_filter(said, lambda n: abs(n-p)<=0.005+1e-9))>0 a, contains(replace(lower(answer),'-',' '),'order status is settled') or len(list_filter(said, lambda n: abs(n-k%9)<=0.5+1e-9))>0 b from nm",
}


@query("e9_answer_scoring", twin("select o_orderpriority, round(avg((a::int+b::int)/2.0::double),9) as score, count(*) filter (a and b) as all_right from hit group by 1", **SCORED))
def _(spark, d):
    """Two things are expected of an answer: an amount to two places, and a word or else a whole number."""
    k, p = c("o_orderkey"), F.round("o_totalprice", 2).cast("double")
    answer = F.concat(
        F.lit("The total is "), F.format_string("%.2f", p + F.when(k % 5 == 0, 7).otherwise(0)), F.when(k % 3 == 0, ", and the Order-Status is settled").otherwise(", still open"),
        F.when(k % 4 == 0, F.concat(F.lit(", -"), (k % 9).cast("string"), F.lit(" items"))).otherwise(""),
    )
    one = lambda word, value, places: F.struct(F.lit(word).cast("string").alias("word"), (value if value is not None else F.lit(None)).cast("double").alias("value"), F.lit(places).alias("places"))
    first, second = S.expected_in(answer, F.array(one(None, p, 2))), S.expected_in(answer, F.array(one("order status is settled", None, 0), one(None, k % 9, 0)))
    rows = table(spark, d, "orders").select("o_orderpriority", first.alias("a"), second.alias("b"))
    return rows.groupBy("o_orderpriority").agg(F.round(F.avg((c("a").cast("int") + c("b").cast("int")) / 2), 9).alias("score"), F.count_if(c("a") & c("b")).alias("all_right"))


@query("e10_overlap_of_top_k", twin(f"select count(*) as shared from (select report_no from reports order by {SCORE} desc, report_no limit 50) join (select report_no from reports join embeddings e on report_no=e.vec_id, (select embedding::double[] v from embeddings where vec_id=0) s order by {HYBRID} desc, report_no limit 50) using (report_no)"))
def _(spark, d):
    words = view(spark, d, "reports").withColumn("s", S.keyword_score(ASKED, c("narrative"))).orderBy(F.desc("s"), "report_no").limit(50).select("report_no")
    return words.intersect(hybrid(spark, d).orderBy(F.desc("score"), "report_no").limit(50).select("report_no")).agg(N().alias("shared"))


PLACES = {
    "xb": "select place_id, case which when 'sample_row' then 'segment band' else 'segment comparison' end kind, x.year as year, null::varchar spill_id, ecoregion, commodity_group commodity, pixels, embedding::double[] e from embedding_export x left join segment_dim on place_id=segment_id where which<>'sites' and pixels>0",
    "xl": "select place_id, year, pixels, unnest(embedding::double[]) x, generate_subscripts(embedding,1) k from embedding_export where which='sites' and pixels>0",
    "xd": "select place_id, year, k, sum(x*pixels)/sum(pixels) m, sum(pixels) px from xl group by 1,2,3",
    "xs": "select place_id, year, list(m order by k) e, max(px) pixels from xd group by 1,2",
    "xt": "select * from xb union all select place_id, case site when 'spill' then 'spill site' else 'comparison spot' end, xs.year, spill_id, site_ecoregion, null, pixels, e from xs left join place_sites on place_id=site_id",
}


@query("e11_place_table", twin("select place_id, kind, year, spill_id, ecoregion, commodity, cast(pixels as bigint) as pixels, len(e) as bands, round(e[1],6) as first_band, round(e[64],6) as last_band, round(list_dot_product(e,e),6) as squared from xt", **PLACES))
def _(spark, d):
    t = S.place_table(view(spark, d, "embedding_export"), view(spark, d, "segment_dim"), view(spark, d, "place_sites"))
    e = c("embedding")
    return t.select("place_id", "kind", "year", "spill_id", "ecoregion", "commodity", c("pixels").cast("long").alias("pixels"), F.size(e).alias("bands"), F.round(e[0], 6).alias("first_band"), F.round(e[63], 6).alias("last_band"), F.round(S.dot(e, e), 6).alias("squared"))


@query("e12_entity_lookup", twin("select spill_id as place, x, y from spill_points where spill_id in ('S000003','S000017') union all select '12.5, -7.25', 12.5, -7.25"))
def _(spark, d):
    asked = spark.createDataFrame([("S000003",), ("S000017",), ("12.5, -7.25",)], "place string")
    point = r"^\s*(-?\d+(?:\.\d+)?)\s*,\s*(-?\d+(?:\.\d+)?)\s*$"
    typed = asked.where(c("place").rlike(point)).select("place", F.regexp_extract("place", point, 1).cast("double").alias("x"), F.regexp_extract("place", point, 2).cast("double").alias("y"))
    known = view(spark, d, "spill_points").join(F.broadcast(asked), c("spill_id") == c("place")).select("place", "x", "y")
    return known.unionByName(typed)


#: Ids of events and of segments, and how many of a kind are shown.
EVENT_ID, SEGMENT_ID, SHOWN = r"\bS\d{6}\b", r"\b\d{3}-\d{6}-\d{2}-\d{1,3}-\d{1,4}\b", 3
SEGMENT_NAME = "concat(lpad(cast({0}%254 as string),3,'0'),'-',lpad(cast({0} as string),6,'0'),'-01-1-',cast({0}%10 as string))"
SEEN = f"concat('see S',lpad(cast(o_custkey as string),6,'0'),' and S999999, pieces ',{SEGMENT_NAME.format('(o_orderkey%40)')},' or 1234-000001-01-1-1.')"
IDS = {
    "an": f"select o_custkey k, string_agg({SEEN}, chr(10)) said from orders group by 1",
    "sg": f"select distinct k, id from (select k, unnest(regexp_extract_all(said,'{SEGMENT_ID}')) id from an) where id in (select {SEGMENT_NAME.format('s_suppkey')} from supplier)",
    "ev": f"select distinct k, id from (select k, unnest(regexp_extract_all(said,'{EVENT_ID}')) id from an) where id in (select 'S'||lpad(cast(c_custkey as varchar),6,'0') from customer where c_custkey%2=0)",
    "sl": f"select k, string_agg(id, ' ' order by id) ids from (select *, row_number() over (partition by k order by id) n from sg) where n<={SHOWN} group by 1",
}


@query("e13_known_ids", twin("select a.k as asked, coalesce(s.ids,'') as segments, coalesce(e.ids,'') as events from an a left join sl s using (k) left join (select k, string_agg(id,' ' order by id) ids from ev group by 1) e using (k)", **IDS))
def _(spark, d):
    """Known segments and events that an answer and its evidence name, the first few segments only."""
    answers = table(spark, d, "orders").selectExpr("o_custkey as asked", f"{SEEN} as line").groupBy("asked").agg(F.array_join(F.collect_list("line"), "\n").alias("said"))
    segments = table(spark, d, "supplier").selectExpr(f"{SEGMENT_NAME.format('s_suppkey')} as id")
    spills = view(spark, d, "spill_points").where(F.substring("spill_id", 2, 6).cast("long") % 2 == 0).select(c("spill_id").alias("id"))
    shown = lambda ids, name: ids.select("asked", F.array_join("ids", " ").alias(name))
    rows = answers.select("asked").join(shown(S.known_ids(answers, "asked", "said", SEGMENT_ID, segments, SHOWN), "segments"), "asked", "left")
    rows = rows.join(shown(S.known_ids(answers, "asked", "said", EVENT_ID, spills), "events"), "asked", "left")
    return rows.select("asked", F.coalesce("segments", F.lit("")).alias("segments"), F.coalesce("events", F.lit("")).alias("events"))
