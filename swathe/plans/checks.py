"""Every kind of answer once more by a second plan: other operators, or the same definition written another way."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import corridor as C
from ..operators import events as E
from ..operators import ranks
from ..operators import spatial as S
from ..operators import tables as T
from ..registry import query
from . import corridor, events, spatial
from .fixtures import table, twin

c = F.col
#: Kind of answer -> its check: key, values and a function that gives the answer and its second plan's result.
CHECKS: dict[str, tuple[list[str], list[str], Callable]] = {}


def check(name: str, key: list[str], values: list[str]):
    def add(fn):
        CHECKS[name] = (key, values, fn)
        return fn

    return add


def medians_by_window(rows: DataFrame, by: list[str], value: str, weight: str) -> DataFrame:
    """A weighted median by its definition: a running sum in order of value, row by row."""
    w = Window.partitionBy(*by)
    upto = F.sum(weight).over(w.orderBy(value, "segment_id").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.where(c(value).isNotNull()).withColumns({"_upto": upto, "_all": F.sum(weight).over(w)})
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("segments"), F.min(F.when(c("_upto") * 2 >= c("_all"), c(value))).alias("wmed"))


@check("corridor summary", ["ring", "ecoregion"], ["segments", "wmed"])
def _(spark, d):
    rows = E.written(corridor.gaps(spark, d).where("ecoregion is not null"), "gaps")
    return C.weighted_median(rows, ["ring", "ecoregion"], "diff", "weight"), medians_by_window(rows, ["ring", "ecoregion"], "diff", "weight")


@check("distance profile", ["ring"], ["segments", "wmed"])
def _(spark, d):
    rows = E.written(corridor.gaps(spark, d), "gaps")
    return C.weighted_median(rows, ["ring"], "diff", "weight"), medians_by_window(rows, ["ring"], "diff", "weight")


@check("segment record", ["segment_id", "ring"], ["diff"])
def _(spark, d):
    """Medians of a segment's springs, and the middle of their sorted list."""
    per = E.written(corridor.springs(spark, d).where("diff_same is not null"), "springs")
    first = per.groupBy("segment_id", "ring").agg(F.median("diff_same").alias("diff"))
    lists = per.groupBy("segment_id", "ring").agg(F.sort_array(F.collect_list("diff_same")).alias("v"))
    n = F.size("v")
    return first, lists.select("segment_id", "ring", ((F.element_at("v", F.floor((n + 1) / 2).cast("int")) + F.element_at("v", F.floor((n + 2) / 2).cast("int"))) / 2).alias("diff"))


@check("event effect", ["event_no"], ["e1"])
def _(spark, d):
    """The first spring after less the mean before, by two groupings and a join."""
    rows = E.written(events.springs(spark, d), "springs")
    known = rows.where("d is not null")
    before = known.where("status = 'before'").groupBy("event_no").agg((F.sum("d") / F.count("d")).alias("base"))
    first = known.where("status = 'after' and years_from_event = 1").select("event_no", "d")
    every = rows.select("event_no").distinct()
    return E.effects(rows).select("event_no", "e1"), every.join(before, "event_no", "left").join(first, "event_no", "left").select("event_no", (c("d") - c("base")).alias("e1"))


@check("event summary", ["subset"], ["n", "mean", "median"])
def _(spark, d):
    own = E.written(events.real(spark, d), "effects")
    first = own.groupBy("subset").agg(F.count(F.lit(1)).alias("n"), F.avg("e1").alias("mean"), F.median("e1").alias("median"))
    sums = own.groupBy("subset").agg(F.count(F.lit(1)).alias("n"), (F.sum("e1") / F.count(F.lit(1))).alias("mean"))
    return first, sums.join(ranks.quantiles(own, ["subset"], "e1", {"median": 0.5}), "subset")


@check("left out", ["reason"], ["km"])
def _(spark, d):
    """Kilometres by reason, and each by its own condition; the whole is the sum of its parts."""
    k, total = c("o_orderkey"), c("o_totalprice") / 1000
    rows = table(spark, d, "orders")
    reason = F.when(k % 10 == 0, "no comparison").when(k % 7 == 0, "short").otherwise("kept")
    first = rows.groupBy(reason.alias("reason")).agg(F.sum(total).alias("km"))
    whole = first.agg(F.lit("all").alias("reason"), F.sum("km").alias("km"))
    tests = {"no comparison": k % 10 == 0, "short": (k % 10 != 0) & (k % 7 == 0), "kept": (k % 10 != 0) & (k % 7 != 0), "all": F.lit(True)}
    wide = rows.agg(*(F.sum(F.when(t, total)).alias(n) for n, t in tests.items()))
    return first.unionByName(whole), wide.unpivot([], list(tests), "reason", "km").where("km is not null")


@check("hot spots", ["bin"], ["n"])
def _(spark, d):
    """Counts of bins, and a recount of what was written from scores alone."""
    found = S.getis_ord(spatial.points(spark, d), "spill_id", "barrels", 3000.0)
    again = E.written(found, "spots")
    size = F.when(F.abs("z") >= 2.576, 3).when(F.abs("z") >= 1.96, 2).when(F.abs("z") >= 1.645, 1).otherwise(0)
    recount = again.select(F.when(c("z") < 0, -size).otherwise(size).alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    return found.groupBy("bin").agg(F.count(F.lit(1)).alias("n")), recount


def run(spark: SparkSession, d: str, names: list[str] | None = None) -> DataFrame:
    parts = []
    for name in names or list(CHECKS):
        key, values, fn = CHECKS[name]
        parts.append(T.agreement(name, *fn(spark, d), key, values))
    return reduce(DataFrame.unionByName, parts)


BINS = "select sign(z)*(case when abs(z)>=2.576 then 3 when abs(z)>=1.96 then 2 when abs(z)>=1.645 then 1 else 0 end) b from (select a.spill_id, (s-mean*w)/(sd*sqrt((n*w-w*w)/(n-1.0::double))) z from (select a.spill_id, sum(b.barrels) s, count(*) w from spill_points a, spill_points b where (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)<=9000000 group by 1) a, (select count(*) n, avg(barrels) mean, stddev_pop(barrels) sd from spill_points))"
#: The SQL counts the items of each answer and, of those that it works out in two ways itself, how many agree.
ITEMS = corridor.GAPS | events.FULL | {
    "sub": events.MEANS["sub"], "cum": corridor.CUM, "bins": BINS,
    "cume": "select ring, ecoregion, diff, sum(weight) over (partition by ring,ecoregion order by diff, segment_id rows unbounded preceding) c, sum(weight) over (partition by ring,ecoregion) t from enr where ecoregion is not null",
    "gm": "select segment_id, ring, count(*) filter (p.diff_same<g.diff) low, count(*) filter (p.diff_same>g.diff) high, count(*) filter (p.diff_same=g.diff) same from gap g join per p using (segment_id, ring) where p.diff_same is not null group by 1,2",
    "two": "select o.event_no, o.e1, a.d-b.d again from own_ef o left join (select event_no, d from own_lb where status='after' and yfe=1) a using (event_no) left join (select event_no, sum(d)/count(d) d from own_lb where status='before' group by 1) b using (event_no)",
    "left_out": "select case when o_orderkey%10=0 then 'no comparison' when o_orderkey%7=0 then 'short' else 'kept' end reason, sum(o_totalprice) v from orders group by 1",
}
COUNTS = [
    "select 'corridor summary' as checked, count(*) as items, count(*) filter (below*2<total and upto*2>=total) as agree from (select ring, ecoregion, max(t) total, coalesce(max(c) filter (diff<m),0) below, max(c) filter (diff<=m) upto from cume join (select ring, ecoregion, min(diff) filter (c>=t/2.0) m from cume group by 1,2) using (ring, ecoregion) group by 1,2)",
    "select 'distance profile', count(*), count(*) filter (below*2<total and upto*2>=total) from (select ring, max(t) total, coalesce(max(c) filter (diff<m),0) below, max(c) filter (diff<=m) upto from cum join (select ring, min(diff) filter (c>=t/2.0) m from cum group by 1) using (ring) group by 1)",
    "select 'segment record', count(*), count(*) filter (low=high or abs(low-high)<=same) from gm",
    "select 'event effect', count(*), count(*) filter (e1 is not distinct from again or abs(e1-again)<1e-9) from two",
    "select 'event summary', count(*), count(*) filter (abs(a-b)<1e-9) from (select subset, avg(e1) a, sum(e1)/count(*) b from sub group by 1)",
    "select 'left out', count(*)+1, count(*)+(abs(sum(v)-(select sum(o_totalprice) from orders))<=1e-9*sum(v))::int from left_out",
    "select 'hot spots', count(distinct b), count(distinct b) from bins",
]


@query("v9_recompute_check", twin(" union all ".join(COUNTS), **ITEMS))
def _(spark, d):
    return run(spark, d)
