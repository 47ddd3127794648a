"""Queries of the event study.  Their SQL follows the study's own steps, by joins where the operators use windows or conditional sums."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import events as E
from ..operators import linear
from ..operators import resample as R
from ..registry import query
from .fixtures import twin, view

c = F.col
BOOT, DRAWS = 2000, 10_000

PASSES = {
    "spx": "select event_no, site_k, year, qtr, orbit, image, sum(n) c from site_obs group by 1,2,3,4,5,6",
    "sbest": "select * from (select *, row_number() over (partition by event_no, site_k, year, qtr, orbit order by c desc, image) rn from spx) where rn=1",
    "sone": "select * from (select o.*, row_number() over (partition by o.event_no, o.site_k, ring, landcover, o.year, o.qtr, o.orbit order by n desc, o.image, m) rn from site_obs o join sbest b on o.event_no=b.event_no and o.site_k=b.site_k and o.year=b.year and o.qtr=b.qtr and o.orbit=b.orbit and o.image=b.image) where rn=1",
    "ps": "select event_no, site_k, site, year, qtr, orbit, sum(m*n)/sum(n) v, cast(sum(n) as bigint) n from sone where n>0 group by 1,2,3,4,5,6 having sum(n)>=20",
}
MAIN = PASSES | {"main": "select event_no, site_k, landcover from (select *, row_number() over (partition by event_no, site_k order by px desc, landcover) rn from (select event_no, site_k, landcover, sum(n) px from sone group by 1,2,3)) where rn=1"}
TRAITS = MAIN | {
    "rng": "select event_no, site_k, ring, avg(hand_m) hand_m, avg(slope_deg) slope_deg, case ring when '0-25' then 1.0::double else 3.0 end area from site_fixed group by 1,2,3",
    "terrain": "select event_no, site_k, sum(hand_m*area)/sum(area) hand_m, sum(slope_deg*area)/sum(area) slope_deg from rng group by 1,2",
    "soils": "select event_no, site_k, soil from (select event_no, site_k, soil, row_number() over (partition by event_no, site_k order by count(*) desc, soil) rn from site_fixed where ring='25-50' group by 1,2,3) where rn=1",
    "traits": "select t.event_no, t.site_k, hand_m, slope_deg, soil, landcover from terrain t left join soils using (event_no, site_k) left join main using (event_no, site_k)",
    "st": "select s.*, t.hand_m, t.slope_deg, t.soil, t.landcover from sites s left join traits t using (event_no, site_k)",
    "me": "select event_no, hand_m, slope_deg, soil, landcover, landcover is not null and soil is not null and hand_m is not null and slope_deg is not null as measured from st where site='spill'",
}
STRICT = "when r.landcover is null or r.landcover<>m.landcover then 'other land cover' when r.soil is distinct from m.soil then 'other soil texture'"
BROAD = "when r.landcover is null or r.landcover//10<>m.landcover//10 then 'other land cover'"


def judged(rules: str) -> str:
    why = f"case when not r.same_ecoregion then 'other ecoregion' when r.other_within_1km then 'another spill within 1 km' {rules} when abs(r.hand_m-m.hand_m)>2 or abs(r.slope_deg-m.slope_deg)>2 then 'other terrain' else '' end"
    return f"select r.event_no, r.site_k, r.site, r.offset_m, {why} reason from st r join me m using (event_no) where r.site<>'spill' and m.measured union all select event_no, site_k, site, offset_m, 'spill site not measured' from st join me using (event_no) where site='spill' and not measured"


def matched(source: str) -> str:
    return (
        f"select event_no, site_k, 'same line' kind, offset_m from (select *, row_number() over (partition by event_no, sign(offset_m) order by abs(offset_m), site_k) rn from {source} where reason='' and site='candidate') where rn<=3"
        f" union all select event_no, site_k, 'regional', offset_m from (select *, row_number() over (partition by event_no order by md5('392|'||cast(event_no as string)||'|'||cast(site_k as string)), site_k) rn from {source} where reason='' and site='regional') where rn<=10"
    )


MATCH = TRAITS | {"judged": judged(STRICT), "mt": matched("judged")}
SAME = MATCH | {
    "spots": "select event_no, year, qtr, orbit, avg(v) v from ps join mt using (event_no, site_k) where kind='same line' group by 1,2,3,4",
    "df": "select s.event_no, s.year, s.qtr, s.orbit, s.v-o.v d from ps s join spots o using (event_no, year, qtr, orbit) where s.site='spill'",
}


def status(event: str) -> str:
    return f"case when make_date(cast(year as int),5,1)<{event} then 'before' when make_date(cast(year as int),3,1)>{event} then 'after' else 'during' end"


def effects_sql(springs: str, keys: str, name: str) -> dict[str, str]:
    """Steps that label springs (keys, year, d, event_date) and take their effects."""
    return {
        f"{name}_st": f"select *, {status('event_date')} status from {springs}",
        f"{name}_lb": f"select *, case status when 'after' then year-min(case when status='after' then year end) over w+1 when 'before' then year-max(case when status='before' then year end) over w-1 else 0 end yfe from {name}_st window w as (partition by {keys})",
        f"{name}_ef": f"select {keys}, max(case when status='after' and yfe=1 then d end)-avg(case when status='before' then d end) e1, avg(case when status='after' then d end)-avg(case when status='before' then d end) e_all, count(*) filter (status='before' and d is not null) n_before, count(*) filter (status='after' and d is not null) n_after, stddev_samp(case when status='before' then d end) sd_before from {name}_lb group by {keys}",
    }


FULL = SAME | {"sp0": "select event_no, year, median(d) d, count(*) passes, any_value(event_date) event_date, any_value(barrels) barrels from df join event_dim using (event_no) group by 1,2"} | effects_sql("sp0", "event_no", "own")
SHIFT = FULL | {"sp2": "select * replace (cast(event_date - interval 24 month as date) as event_date) from sp0"} | effects_sql("sp2", "event_no", "sh")
LINE = MATCH | {
    "ml": "select * from mt where kind='same line'",
    "lp": "select f.event_no, f.site_k, f.year, f.qtr, f.orbit, f.v-avg(o.v) d from (select ps.* from ps join ml using (event_no, site_k)) f join (select ps.* from ps join ml using (event_no, site_k)) o on f.event_no=o.event_no and f.year=o.year and f.qtr=o.qtr and f.orbit=o.orbit and f.site_k<>o.site_k group by 1,2,3,4,5,f.v",
    "l0": "select event_no, site_k, year, median(d) d, any_value(event_date) event_date from lp join event_dim using (event_no) group by 1,2,3",
} | effects_sql("l0", "event_no, site_k", "ln")
REGIONAL = MATCH | {
    "sv": "select event_no, site_k, year, median(v) v from ps join mt using (event_no, site_k) where kind='regional' group by 1,2,3",
    "ry": "select event_no, site_k, year from (select distinct event_no, site_k from sv), (select distinct year from ps)",
    "r0": "select a.event_no, a.site_k, a.year, any_value(f.v)-avg(o.v) d, any_value(event_date) event_date from ry a join event_dim using (event_no) left join sv f on f.event_no=a.event_no and f.site_k=a.site_k and f.year=a.year left join sv o on o.event_no=a.event_no and o.site_k<>a.site_k and o.year=a.year group by 1,2,3",
} | effects_sql("r0", "event_no, site_k", "rg")


def chosen(spark, d):
    return E.chosen(view(spark, d, "site_obs"))


def verdicts(spark, d, rows=None, **how):
    rows = chosen(spark, d) if rows is None else rows
    return E.reasons(view(spark, d, "sites"), E.traits(rows, view(spark, d, "site_fixed")), **how)


def study(spark, d, **how):
    """Passes and matched spots of one study, from one choice of rows."""
    rows = E.written(chosen(spark, d), "chosen")
    return E.site_passes(rows), E.written(E.matches(verdicts(spark, d, rows, **how)), "matches")


def springs(spark, d, given=None, **how):
    return E.event_springs(E.same_pass(*(given or study(spark, d, **how))), view(spark, d, "event_dim"))


@query("a5_circle_from_rings", twin("select event_no, site_k, year, qtr, orbit, round(v,9) as v, n from ps", **PASSES))
def _(spark, d):
    return E.site_passes(chosen(spark, d)).select("event_no", "site_k", "year", "qtr", "orbit", F.round("v", 9).alias("v"), "n")


@query("a9_area_weighted_ring_mean", twin("select event_no, site_k, round(hand_m,9) as hand_m, round(slope_deg,9) as slope_deg from terrain", **TRAITS))
def _(spark, d):
    rings = view(spark, d, "site_fixed").groupBy("event_no", "site_k", "ring").agg(F.avg("hand_m").alias("hand_m"), F.avg("slope_deg").alias("slope_deg"))
    return E.area_mean(rings, "hand_m", "slope_deg").withColumns({x: F.round(x, 9) for x in ("hand_m", "slope_deg")})


@query("a10_main_class", twin("select event_no, site_k, landcover from main", **MAIN))
def _(spark, d):
    return E.main_class(chosen(spark, d))


@query("b1_site_traits", twin("select event_no, site_k, landcover, soil, round(hand_m,9) as hand_m, round(slope_deg,9) as slope_deg from traits", **TRAITS))
def _(spark, d):
    return E.traits(chosen(spark, d), view(spark, d, "site_fixed")).withColumns({x: F.round(x, 9) for x in ("hand_m", "slope_deg")})


@query("b2_rule_matching", twin("select event_no, site_k, reason from judged", **MATCH))
def _(spark, d):
    return verdicts(spark, d).select("event_no", "site_k", "reason")


@query("w6_nearest_on_each_side", twin("select event_no, site_k, offset_m from mt where kind='same line'", **MATCH))
def _(spark, d):
    return E.matches(verdicts(spark, d)).where("kind = 'same line'").select("event_no", "site_k", "offset_m")


@query("x7_regional_head", twin("select event_no, site_k from mt where kind='regional'", **MATCH))
def _(spark, d):
    return E.matches(verdicts(spark, d)).where("kind = 'regional'").select("event_no", "site_k")


@query("b3_reason_tally", twin("select reason, count(*) as n from judged where reason<>'' group by 1", **MATCH))
def _(spark, d):
    return verdicts(spark, d).where("reason <> ''").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


WIDE = MATCH | {"jw": judged(BROAD), "mw": matched("jw")}


@query("b9_broader_rerun", twin("select 'strict' as matching, event_no, site_k, kind from mt union all select 'broader', event_no, site_k, kind from mw", **WIDE))
def _(spark, d):
    """S14 too: two runs of one table, with the run's name."""
    rows = E.written(chosen(spark, d), "chosen")
    runs = [E.matches(verdicts(spark, d, rows, **how)).select(F.lit(name).alias("matching"), "event_no", "site_k", "kind") for name, how in (("strict", {}), ("broader", {"broad": True, "soil": False}))]
    return runs[0].unionByName(runs[1], allowMissingColumns=True)


@query("j9_same_pass_difference", twin("select event_no, year, qtr, orbit, round(d,9) as d from df", **SAME))
def _(spark, d):
    return E.same_pass(*study(spark, d)).select("event_no", "year", "qtr", "orbit", F.round("d", 9).alias("d"))


@query("b4_event_springs", twin("select event_no, year, round(d,9) as d, passes, status, yfe as years_from_event from own_lb", **FULL))
def _(spark, d):
    return springs(spark, d).select("event_no", "year", F.round("d", 9).alias("d"), "passes", "status", "years_from_event")


@query("w7_first_last_of_event", twin("select event_no, min(case when status='after' then year end) as first_after, max(case when status='before' then year end) as last_before from own_lb group by 1", **FULL))
def _(spark, d):
    y = F.col("year")
    return springs(spark, d).groupBy("event_no").agg(F.min(F.when(c("status") == "after", y)).alias("first_after"), F.max(F.when(c("status") == "before", y)).alias("last_before"))


EFFECT = "round(e1,9) as e1, round(e_all,9) as e_all, n_before, n_after, round(sd_before,9) as sd_before"


def shown(df, *keys):
    return df.select(*keys, F.round("e1", 9).alias("e1"), F.round("e_all", 9).alias("e_all"), "n_before", "n_after", F.round("sd_before", 9).alias("sd_before"))


@query("a14_baci_effect", twin(f"select event_no, {EFFECT} from own_ef", **FULL))
def _(spark, d):
    return shown(E.effects(springs(spark, d)), "event_no")


@query("b5_placebo_leave_one_out", twin(f"select event_no, site_k, {EFFECT} from ln_ef", **LINE))
def _(spark, d):
    return shown(E.fakes_same_line(*study(spark, d), view(spark, d, "event_dim")), "event_no", "site_k")


@query("b6_placebo_regional", twin(f"select event_no, site_k, {EFFECT} from rg_ef", **REGIONAL))
def _(spark, d):
    return shown(E.fakes_regional(*study(spark, d), view(spark, d, "event_dim")), "event_no", "site_k")


def shifted(spark, d):
    return E.effects(E.event_springs(E.same_pass(*study(spark, d)), E.earlier(view(spark, d, "event_dim"))))


@query("b7_placebo_in_time", twin(f"select event_no, {EFFECT} from sh_ef", **SHIFT))
def _(spark, d):
    return shown(shifted(spark, d), "event_no")


MEANS = FULL | {
    "sub": "select 'all' as subset, event_no, e1 from own_ef where e1 is not null union all select '50 barrels or more', event_no, e1 from own_ef join event_dim using (event_no) where e1 is not null and barrels>=50",
} | R.picks_sql("sub", ["subset"], [], "event_no", BOOT, 392) | {
    "mn": "select subset, draw, avg(e1) m from pick group by 1,2",
    "bt": "select subset, quantile_cont(m,0.025) lo95, quantile_cont(m,0.975) hi95, count(*) draws from mn group by 1",
}


def subsets(effects, events):
    """The event's effects in each subset they belong to: all, and those of 50 barrels or more."""
    names = F.when(c("barrels") >= 50, F.array(F.lit("all"), F.lit("50 barrels or more"))).otherwise(F.array(F.lit("all")))
    return effects.join(events.select("event_no", "barrels"), "event_no").withColumn("subset", F.explode(names))


def real(spark, d, given=None):
    return subsets(E.effects(springs(spark, d, given)).where("e1 is not null"), view(spark, d, "event_dim"))


@query("a15_bootstrap_mean", twin("select subset, round(lo95,9) as lo95, round(hi95,9) as hi95, draws from bt", **MEANS))
def _(spark, d):
    return E.bootstrap_mean(real(spark, d), ["subset"], "event_no", "e1", BOOT).withColumns({x: F.round(x, 9) for x in ("lo95", "hi95")})


@query("w8_average_rank", twin("select event_no, rank() over (order by abs_e)+(count(*) over (partition by abs_e)-1)/2.0 as avg_rank from (select event_no, round(abs(e1),6) abs_e from own_ef where e1 is not null)", **FULL))
def _(spark, d):
    rows = E.effects(springs(spark, d)).where("e1 is not null").select("event_no", F.round(F.abs("e1"), 6).alias("abs_e"))
    return E.ranks.average_ranks(rows, "abs_e").select("event_no", "avg_rank")


def ranked_sql(source: str, name: str) -> dict[str, str]:
    """Rank sums of ``e1`` in ``source``, exact p by adding one rank at a time, normal p from the tail's series."""
    tail = "exp(-x*x/2)/sqrt(2*pi())*t*(0.319381530+t*(-0.356563782+t*(1.781477937+t*(-1.821255978+t*1.330274429))))"
    return {
        f"{name}_v": f"select e1, rank() over (order by abs(e1))+(count(*) over (partition by abs(e1))-1)/2.0::double r, count(*) over (partition by abs(e1)) k from {source} where e1<>0",
        f"{name}_s": f"select count(*) n, coalesce(sum(r) filter (e1>0),0) up, coalesce(sum(r) filter (e1<0),0) down, coalesce(sum(k*k-1),0) tied, (select count(*) from {source} where e1=0) zeros from {name}_v",
        f"{name}_dp": f"select k, s, c from (with recursive dp(k, s, c) as (select 0::bigint, 0::bigint, 1.0::double union all select k+1, s2, sum(c) from (select k, s+u*(k+1) s2, c from dp, (values (0),(1)) as t(u) where k<(select case when n<={E.EXACT} then n else 0 end from {name}_s)) group by k, s2) select * from dp)",
        f"{name}_z": f"select *, least(up,down) w, abs((least(up,down)-n*(n+1)/4.0::double)/nullif(sqrt(n*(n+1)*(2*n+1)/24.0::double-tied/48.0::double),0)) x from {name}_s",
        f"{name}_p": f"select n, w, case when n=0 then null when n<={E.EXACT} and tied=0 and zeros=0 then least(1.0, 2*(select sum(c) from {name}_dp, {name}_z z where k=z.n and s<=z.w)/pow(2.0,n)) else least(1.0, 2*{tail}) end p from (select *, 1/(1+0.2316419::double*x) t from {name}_z)",
    }


@query("a16_signed_rank", twin("select n, w, round(p,6) as p from wx_p", **(FULL | {"src": "select e1 from own_ef where e1 is not null"} | ranked_sql("src", "wx"))))
def _(spark, d):
    return E.signed_rank(E.effects(springs(spark, d)), "e1").select("n", "w", F.round("p", 6).alias("p"))


@query("v6_event_timeline", twin("select s.event_no, s.year, s.status, s.yfe as years_from_event, s.passes, round(s.d,9) as d, round(f.e1,9) as e1 from own_lb s left join own_ef f using (event_no)", **FULL))
def _(spark, d):
    rows = springs(spark, d)
    return rows.join(E.effects(rows).select("event_no", "e1"), "event_no", "left").select("event_no", "year", "status", "years_from_event", "passes", F.round("d", 9).alias("d"), F.round("e1", 9).alias("e1"))


def perm_sql(fakes: str, name: str) -> dict[str, str]:
    return {
        f"{name}_f": f"select event_no, e1 fake, row_number() over (partition by event_no order by site_k)-1 k, count(*) over (partition by event_no) n from {fakes} where e1 is not null",
        f"{name}_s": f"select subset, event_no, n, cast('0x'||substr(md5(concat_ws('|','11',cast(event_no as string))),1,7) as bigint) seed from sub join (select distinct event_no, n from {name}_f) using (event_no)",
        f"{name}_d": f"select subset, event_no, draw, ({R.mixed_sql(f'seed+draw*{R.OF_DRAW}')}) % n j from {name}_s, (select unnest(range(1,{DRAWS + 1})) draw)",
        f"{name}_m": f"select subset, draw, avg(fake) m from {name}_d a join {name}_f f on a.event_no=f.event_no and a.j=f.k group by 1,2",
        f"{name}_r": f"select subset, avg(e1) r, count(*) n from sub where event_no in (select event_no from {name}_f) group by 1",
        f"{name}_p": f"select subset, any_value(r.n) n, case when any_value(r.n)>=3 then (count(*) filter (m<=r.r)+1)/(count(*)+1)::double end p from {name}_m join {name}_r r using (subset) group by 1",
    }


PERM = MEANS | {k: v for k, v in LINE.items() if k not in MEANS} | {k: v for k, v in REGIONAL.items() if k not in MEANS} | perm_sql("ln_ef", "pl") | perm_sql("rg_ef", "pr")


@query("a17_permutation_p", twin("select subset, n, round(p,9) as p from pl_p", **PERM))
def _(spark, d):
    """One fake a draw for each event that has some; p counts draws whose mean is at most the real mean of those events."""
    given = study(spark, d)
    fakes = E.fakes_same_line(*given, view(spark, d, "event_dim"))
    return E.permutation_p(real(spark, d, given), ["subset"], fakes, DRAWS).select("subset", "n", F.round("p", 9).alias("p"))


SUMMARY = PERM | {k: v for k, v in SHIFT.items() if k not in PERM} | {
    "sa": "select e1 from sub where subset='all'", "sb": "select e1 from sub where subset<>'all'",
} | ranked_sql("sa", "wa") | ranked_sql("sb", "wb") | {
    "wp": "select 'all' as subset, p from wa_p union all select '50 barrels or more', p from wb_p",
    "sf": "select subset, avg(s.e1) date_shift_mean, count(s.e1) date_shift_n from sub join sh_ef s using (event_no) group by 1",
    "b8": "select u.subset, count(*) n, avg(u.e1) mean_e1, median(u.e1) median_e1, any_value(lo95) lo95, any_value(hi95) hi95, any_value(wp.p) wilcoxon_p, any_value(pl_p.p) perm_p_same_line, any_value(pr_p.p) perm_p_regional, any_value(date_shift_mean) date_shift_mean, any_value(coalesce(date_shift_n,0)) date_shift_n from sub u join bt using (subset) left join wp using (subset) left join pl_p using (subset) left join pr_p using (subset) left join sf using (subset) group by 1 having count(*)>=3",
}
NUMBERS = ["mean_e1", "median_e1", "lo95", "hi95", "wilcoxon_p", "perm_p_same_line", "perm_p_regional", "date_shift_mean"]
ROUNDED = ", ".join(f"round({x},{6 if x == 'wilcoxon_p' else 9}) as {x}" for x in NUMBERS)


def summary(spark, d, names=("all", "50 barrels or more")):
    """Each subset's mean and median effect, interval, signed-rank p, two permutation p and the effect two years earlier."""
    sites, matched_ = study(spark, d)
    sites = E.written(sites, "passes")
    events = view(spark, d, "event_dim")
    diffs = E.same_pass(sites, matched_)
    own = E.written(subsets(E.effects(E.event_springs(diffs, events)).where("e1 is not null"), events).where(c("subset").isin(*names)), "effects")
    out = own.groupBy("subset").agg(F.count(F.lit(1)).alias("n"), F.avg("e1").alias("mean_e1"), F.median("e1").alias("median_e1")).where("n >= 3")
    out = out.join(E.bootstrap_mean(own, ["subset"], "event_no", "e1", BOOT).drop("draws"), "subset")
    tests = [E.signed_rank(own.where(c("subset") == name), "e1").select(F.lit(name).alias("subset"), c("p").alias("wilcoxon_p")) for name in names]
    out = out.join(reduce(DataFrame.unionByName, tests), "subset", "left")
    for name, fakes in (("perm_p_same_line", E.fakes_same_line(sites, matched_, events)), ("perm_p_regional", E.fakes_regional(sites, matched_, events))):
        out = out.join(E.permutation_p(own, ["subset"], fakes, DRAWS).select("subset", c("p").alias(name)), "subset", "left")
    shift = E.effects(E.event_springs(diffs, E.earlier(events))).select("event_no", c("e1").alias("s"))
    moved = own.join(shift, "event_no").groupBy("subset").agg(F.avg("s").alias("date_shift_mean"), F.count("s").alias("date_shift_n"))
    return out.join(moved, "subset", "left").withColumn("date_shift_n", F.coalesce("date_shift_n", F.lit(0)))


def rounded(df):
    return df.withColumns({x: F.round(x, 6 if x == "wilcoxon_p" else 9) for x in NUMBERS})


@query("b8_v7_subset_summary", twin(f"select subset, n, date_shift_n, {ROUNDED} from b8", **SUMMARY))
def _(spark, d):
    return rounded(summary(spark, d))


@query("v7_event_summary_verdict", twin("select n, round(mean_e1,9) as mean_e1, round(date_shift_mean,9) as date_shift_mean, case when hi95<0 and coalesce(perm_p_same_line,1.0)<0.05 then 'clear effect' else 'no clear effect' end as verdict from b8 where subset='all'", **SUMMARY))
def _(spark, d):
    """Clear: the whole interval lies below zero and fakes rarely look as bad; no permutation p counts as 1."""
    clear = (c("hi95") < 0) & (F.coalesce("perm_p_same_line", F.lit(1.0)) < 0.05)
    return summary(spark, d, ("all",)).select("n", F.round("mean_e1", 9).alias("mean_e1"), F.round("date_shift_mean", 9).alias("date_shift_mean"), F.when(clear, "clear effect").otherwise("no clear effect").alias("verdict"))


#: The model's steps in SQL; of the kinds of cause the first is the reference.
MODEL = FULL | {k: v for k, v in TRAITS.items() if k not in FULL} | {
    "obs": "select event_no, e1 y, log10(greatest(barrels,1.0)) log_barrels, cause kind, (event_no%4=0)::int::double excavation, t.hand_m, t.slope_deg from own_ef join event_dim using (event_no) join (select event_no, hand_m, slope_deg from st where site='spill') t using (event_no) where e1 is not null and t.hand_m is not null and t.slope_deg is not null and barrels is not null",
    "lv": "select kind, row_number() over (order by kind) r from (select distinct kind from obs)",
    "tm": "select 1 i, 'intercept' as term union all select 2, 'log_barrels' union all select 1+r, 'kind='||kind from lv where r>1 union all select 2+(select max(r) from lv), 'excavation' union all select 3+(select max(r) from lv), 'hand_m' union all select 4+(select max(r) from lv), 'slope_deg'",
    "xs": "select event_no, y, i, case when term='intercept' then 1.0::double when term='log_barrels' then log_barrels when term='excavation' then excavation when term='hand_m' then hand_m when term='slope_deg' then slope_deg else (term='kind='||kind)::int::double end x from obs, tm",
    "xx": "select a.i, b.i j, sum(a.x*b.x) v from xs a join xs b using (event_no) group by 1,2",
    "sz": "select max(i) k, count(distinct event_no) n from xs",
    # Gauss and Jordan: the matrix beside the unit matrix, a pivot at a time
    "inv0": """select list_reduce(list_concat([{'p': 0::bigint, 'm': m}], list_transform(range(1, k+1), lambda p: {'p': p, 'm': []::double[]})),
      lambda s, e: {'p': e.p, 'm': list_transform(range(1, len(s.m)+1), lambda x: case when (x-1)//(2*k)+1 = e.p then s.m[x]/s.m[(e.p-1)*2*k+e.p]
        else s.m[x]-s.m[((x-1)//(2*k))*2*k+e.p]*s.m[(e.p-1)*2*k+(x-1)%(2*k)+1]/s.m[(e.p-1)*2*k+e.p] end)}).m m, k from (select list(v order by i, j) m from (select i, j, v from xx union all select a.i, b.i+k, (a.i=b.i)::int::double from tm a, tm b, sz)), sz""",
    "iv": "select i, j, m[(i-1)*2*k+k+j] v from inv0, (select a.i i, b.i j from tm a, tm b)",
    "be": "select iv.i, sum(iv.v*xy) b from iv join (select i j, sum(x*y) xy from xs group by 1) using (j) group by 1",
    "er": "select event_no, any_value(y)-sum(x*b) e, any_value(y) y from xs join be using (i) group by 1",
    "hv": "select a.event_no, sum(a.x*b.x*iv.v) h from xs a join xs b using (event_no) join iv on iv.i=a.i and iv.j=b.i group by 1",
    "me2": "select a.i, b.i j, sum(a.x*b.x*e*e/((1-h)*(1-h))) v from xs a join xs b using (event_no) join er using (event_no) join hv using (event_no) group by 1,2",
    "cv": "select p.i, sqrt(sum(p.v*me2.v*q.v)) se from iv p join me2 on me2.i=p.j join iv q on q.i=me2.j and q.j=p.i group by 1",
    "r2": "select 1-sum(e*e)/sum((y-my)*(y-my)) r2 from er, (select avg(y) my from er)",
}


@query("a18_effect_model", twin("select term, round(b,6) as estimate, round(se,6) as se, round(b-1.959964*se,6) as lo95, round(b+1.959964*se,6) as hi95, n, round(r2,6) as r2 from tm join be using (i) join cv using (i), sz, r2 where n>=12", **MODEL))
def _(spark, d):
    """What goes with a larger effect: size, a category, a flag and terrain, with robust errors."""
    given = study(spark, d)
    own = E.traits(chosen(spark, d), view(spark, d, "site_fixed")).join(view(spark, d, "sites").where("site = 'spill'").select("event_no", "site_k"), ["event_no", "site_k"]).select("event_no", "hand_m", "slope_deg")
    rows = E.written(E.effects(springs(spark, d, given)).where("e1 is not null").join(view(spark, d, "event_dim"), "event_no").join(own, "event_no"), "model")
    rows = rows.withColumns({"kind": c("cause"), "excavation": c("event_no") % 4 == 0})
    table, terms = linear.design(rows, "e1", ["log_barrels", "kind", "excavation", "hand_m", "slope_deg"], {"barrels": 1.0})
    fit = linear.robust_fit(table, "e1", terms)
    return spark.createDataFrame([(r["term"], *(round(r[k], 6) for k in ("estimate", "se", "lo95", "hi95")), r["n"], round(r["r2"], 6)) for r in fit], "term string, estimate double, se double, lo95 double, hi95 double, n long, r2 double")
