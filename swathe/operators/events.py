"""Before-after-control-impact studies of events against matched spots."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.files import written
from . import ranks, resample
from .corridor import one_image_per_pass, one_row_per_class_pass, pooled
from .labels import first_reason, spring_status
from .sampling import hashed

SITE = ["event_no", "site_k"]
PASS = ["year", "qtr", "orbit"]


# --- sites -----------------------------------------------------------------------------------------------------------


def chosen(obs: DataFrame) -> DataFrame:
    """Of each pass of a site one image, and of each of its rings and classes one row.  A study reads these rows twice, so it writes them first."""
    return one_row_per_class_pass(one_image_per_pass(obs, *SITE, keys=tuple(PASS)), (*SITE, "ring", "landcover", *PASS), ("-n", "image", "m"))


def site_passes(rows: DataFrame, min_pixels: int = 20) -> DataFrame:
    """A5: a site's circle in a pass: rings and classes of the chosen rows pooled by pixels; circles with too few pixels are dropped."""
    return pooled(rows, [*SITE, "site", *PASS]).where(F.col("n") >= min_pixels)


def main_class(rows: DataFrame) -> DataFrame:
    """A10: a site's class with the most pixels of the chosen rows, of equals the lower code."""
    sums = rows.groupBy(*SITE, "landcover").agg(F.sum("n").alias("px"))
    return sums.groupBy(*SITE).agg(F.max_by("landcover", F.struct("px", -F.col("landcover"))).alias("landcover"))


def area_mean(rings: DataFrame, *values: str) -> DataFrame:
    """Means of a site's two rings, weighted by their areas of 1 and 3."""
    area = F.when(F.col("ring") == "0-25", 1.0).otherwise(3.0)
    return rings.groupBy(*SITE).agg(*((F.sum(F.col(v) * area) / F.sum(F.when(F.col(v).isNotNull(), area))).alias(v) for v in values))


def traits(rows: DataFrame, fixed: DataFrame) -> DataFrame:
    """B1: terrain of the circle, soil class of its outer ring (the most frequent, of equals the lower) and main land cover class."""
    rings = fixed.groupBy(*SITE, "ring").agg(F.avg("hand_m").alias("hand_m"), F.avg("slope_deg").alias("slope_deg"))
    counts = fixed.where("ring = '25-50'").groupBy(*SITE, "soil").agg(F.count(F.lit(1)).alias("_n"))
    soil = counts.groupBy(*SITE).agg(F.max_by("soil", F.struct("_n", -F.col("soil"))).alias("soil"))
    return area_mean(rings, "hand_m", "slope_deg").join(soil, SITE, "left").join(main_class(rows), SITE, "left")


# --- matching --------------------------------------------------------------------------------------------------------


def reasons(sites: DataFrame, found: DataFrame, hand_m: float = 2.0, slope_deg: float = 2.0, broad: bool = False, soil: bool = True) -> DataFrame:
    """B2: every candidate and regional spot with the first rule it fails, or an empty text.

    An event whose own site lacks a trait has one row, for its site, and no spots.
    """
    all_sites = sites.join(found, SITE, "left")
    names = ["landcover", "soil", "hand_m", "slope_deg"]
    own = all_sites.where("site = 'spill'").select("event_no", *(F.col(c).alias(f"own_{c}") for c in names))
    measured = F.lit(True)
    for c in names:
        measured = measured & F.col(f"own_{c}").isNotNull()
    kind = (lambda c: F.expr(f"{c} div 10")) if broad else F.col
    other_terrain = (F.abs(F.col("hand_m") - F.col("own_hand_m")) > hand_m) | (F.abs(F.col("slope_deg") - F.col("own_slope_deg")) > slope_deg)
    rules = [
        (~F.col("same_ecoregion"), "other ecoregion"), (F.col("other_within_1km"), "another spill within 1 km"),
        (F.col("landcover").isNull() | (kind("landcover") != kind("own_landcover")), "other land cover"),
        *([(~F.col("soil").eqNullSafe(F.col("own_soil")), "other soil texture")] if soil else []), (other_terrain, "other terrain"),
    ]
    joined = all_sites.join(own.withColumn("measured", measured), "event_no")
    spots = joined.where("site <> 'spill' and measured").withColumn("reason", first_reason(*rules))
    lost = joined.where("site = 'spill' and not measured").withColumn("reason", F.lit("spill site not measured"))
    columns = [*SITE, "site", "offset_m", "reason"]
    return spots.select(*columns).unionByName(lost.select(*columns))


def matches(judged: DataFrame, each_side: int = 3, regional: int = 10, seed: int = 392) -> DataFrame:
    """Of the spots that pass, the nearest on each side of the event, and a hashed head of the regional ones."""
    passed = judged.where("reason = ''")
    side = Window.partitionBy("event_no", F.signum("offset_m")).orderBy(F.abs("offset_m"), "site_k")
    near = passed.where("site = 'candidate'").withColumn("_rn", F.row_number().over(side)).where(F.col("_rn") <= each_side)
    drawn = Window.partitionBy("event_no").orderBy(hashed(seed, *SITE), "site_k")
    far = passed.where("site = 'regional'").withColumn("_rn", F.row_number().over(drawn)).where(F.col("_rn") <= regional)
    return near.withColumn("kind", F.lit("same line")).unionByName(far.withColumn("kind", F.lit("regional"))).select(*SITE, "kind", "offset_m")


# --- effects ---------------------------------------------------------------------------------------------------------


def years_from_event(rows: DataFrame, keys: tuple[str, ...] = ("event_no",)) -> DataFrame:
    """1, 2, ... from the first spring after; -1, -2, ... back from the last before; 0 during."""
    w = Window.partitionBy(*keys)
    first, last = F.min(F.when(F.col("status") == "after", F.col("year"))).over(w), F.max(F.when(F.col("status") == "before", F.col("year"))).over(w)
    return rows.withColumn("years_from_event", F.when(F.col("status") == "after", F.col("year") - first + 1).when(F.col("status") == "before", F.col("year") - last - 1).otherwise(0))


def same_pass(passes: DataFrame, matched: DataFrame) -> DataFrame:
    """The event's value less the mean over its matched same-line spots in the same pass.

    Each pass's spots meet their event by conditional aggregation: one shuffle.
    """
    spots = matched.where("kind = 'same line'").select(*SITE, F.lit(True).alias("_same"))
    rows = passes.join(spots, SITE, "left").where("site = 'spill' or _same").withColumn("_spot", F.col("_same").isNotNull())
    both = rows.groupBy("event_no", *PASS).agg(F.avg(F.when(~F.col("_spot"), F.col("v"))).alias("own"), F.avg(F.when(F.col("_spot"), F.col("v"))).alias("others"))
    return both.where("own is not null and others is not null").withColumn("d", F.col("own") - F.col("others"))


def without_own(rows: DataFrame, group: list[str], value: str = "v") -> DataFrame:
    """Each row less the mean of the others of its group, (sum - own) / (n - 1); null where there are no others."""
    w = Window.partitionBy(*group)
    mean = F.try_divide(F.sum(value).over(w) - F.col(value), F.count(value).over(w) - 1)
    return rows.withColumn("d", F.col(value) - mean)


def labelled(springs: DataFrame, events: DataFrame, keys: tuple[str, ...] = ("event_no",)) -> DataFrame:
    """Springs with their status and their distance in springs from the event."""
    status = spring_status(F.make_date("year", F.lit(3), F.lit(1)), F.make_date("year", F.lit(5), F.lit(1)), F.col("event_date"))
    return years_from_event(springs.join(events.select("event_no", "event_date"), "event_no").withColumn("status", status), keys)


def event_springs(diffs: DataFrame, events: DataFrame, keys: tuple[str, ...] = ("event_no",)) -> DataFrame:
    """Median difference of each spring, labelled."""
    return labelled(diffs.groupBy(*keys, "year").agg(F.median("d").alias("d"), F.count(F.lit(1)).alias("passes")), events, keys)


def effects(springs: DataFrame, keys: tuple[str, ...] = ("event_no",)) -> DataFrame:
    """First spring after, and mean of springs after, less the mean before; null without springs on both sides."""
    before, after = (F.col("status") == "before") & F.col("d").isNotNull(), (F.col("status") == "after") & F.col("d").isNotNull()
    base = F.avg(F.when(before, F.col("d")))
    return springs.groupBy(*keys).agg(
        (F.max(F.when(after & (F.col("years_from_event") == 1), F.col("d"))) - base).alias("e1"), (F.avg(F.when(after, F.col("d"))) - base).alias("e_all"),
        F.count_if(before).alias("n_before"), F.count_if(after).alias("n_after"), F.stddev_samp(F.when(before, F.col("d"))).alias("sd_before"),
    )


def earlier(events: DataFrame, months: int = 24) -> DataFrame:
    """The events moved back in time."""
    return events.withColumn("event_date", F.add_months("event_date", -months))


def fakes_same_line(passes: DataFrame, matched: DataFrame, events: DataFrame) -> DataFrame:
    """Effects of each matched same-line spot as if it were the event, the other matched spots of its pass as its comparison."""
    spots = passes.join(matched.where("kind = 'same line'").select(*SITE), SITE, "left_semi")
    return effects(event_springs(without_own(spots, ["event_no", *PASS]).where("d is not null"), events, tuple(SITE)), tuple(SITE))


def fakes_regional(passes: DataFrame, matched: DataFrame, events: DataFrame) -> DataFrame:
    """Effects of each drawn regional spot by its spring medians, the other drawn ones as its comparison.

    A spring counts as the first one after if it is the study's first, even where the spot has no value then.
    """
    per = passes.join(matched.where("kind = 'regional'").select(*SITE), SITE, "left_semi").groupBy(*SITE, "year").agg(F.median("v").alias("v"))
    # the study has a few dozen springs at most
    springs = passes.agg(F.sort_array(F.collect_set("year")).alias("years"))
    every = per.select(*SITE).distinct().crossJoin(F.broadcast(springs)).select(*SITE, F.explode("years").alias("year")).join(per, [*SITE, "year"], "left")
    return effects(labelled(without_own(every, ["event_no", "year"]), events, tuple(SITE)), tuple(SITE))


# --- tests -----------------------------------------------------------------------------------------------------------


def bootstrap_mean(values: DataFrame, group: list[str], key: str, value: str, draws: int = 2000, seed: int = 392) -> DataFrame:
    """The 2.5 and 97.5 percent points of the resampled means of each group."""
    means = resample.means(values, group, key, value, draws, seed)
    return means.groupBy(*group).agg(F.percentile("mean", 0.025).alias("lo95"), F.percentile("mean", 0.975).alias("hi95"), F.count(F.lit(1)).alias("draws"))


class Fakes:
    """Sum over events of the fake that each draw takes of an event, and their number."""

    def __init__(self, draws: int):
        self.steps, self.sums, self.events = np.arange(1, draws + 1) * resample.OF_DRAW, np.zeros(draws), 0

    def add(self, batch: pa.RecordBatch, row: int) -> None:
        fakes = batch.column("fakes")[row].values.to_numpy(zero_copy_only=False)
        self.sums += fakes[resample.mixed_array(batch.column("_seed")[row].as_py() + self.steps) % len(fakes)]
        self.events += 1

    def columns(self) -> list:
        return [np.arange(1, len(self.sums) + 1), self.sums, np.full(len(self.sums), self.events)]


def permutation_p(real: DataFrame, group: list[str], fakes: DataFrame, draws: int = 10_000, seed: int = 11) -> DataFrame:
    """The share of draws of one fake an event whose mean is at most the real mean, of the events that have fakes; null for fewer than three.

    ``real`` has the group, ``event_no`` and ``e1``; ``fakes`` ``event_no``, ``site_k`` and ``e1``.
    """
    lists = fakes.where("e1 is not null").groupBy("event_no").agg(F.transform(F.sort_array(F.collect_list(F.struct("site_k", "e1"))), lambda f: f["e1"]).alias("fakes"))  # a few spots an event
    both = written(real.where("e1 is not null").select(*group, "event_no", "e1").join(lists, "event_no"), "fakes")
    means = both.groupBy(*group).agg(F.avg("e1").alias("real"), F.count(F.lit(1)).alias("n"))
    dealt = both.select(*group, "event_no", "fakes", resample.seed_of(seed, ["event_no"]).alias("_seed"))
    sums = resample.by_group(dealt, group, "event_no", lambda: Fakes(draws), "draw int, _s double, _k long")
    sims = sums.groupBy(*group, "draw").agg((F.sum("_s") / F.sum("_k")).alias("m"))
    joined = resample.alike(sims, means, group) if group else sims.crossJoin(F.broadcast(means))
    return joined.groupBy(*group).agg(F.max("n").alias("n"), F.when(F.max("n") >= 3, (F.count_if(F.col("m") <= F.col("real")) + 1) / (F.count(F.lit(1)) + 1)).alias("p"))


#: Up to so many differences without ties or zeros the exact distribution is used.
EXACT = 50


def signed_rank(rows: DataFrame, value: str) -> DataFrame:
    """Number of differences, the smaller of the rank sums, and its two-sided p; zeros are left out.

    Up to 50 differences without ties or zeros the p is exact, else that of the normal distribution with tie correction.
    """
    values = rows.where(F.col(value).isNotNull())
    zeros = values.agg(F.count_if(F.col(value) == 0).alias("zeros"))
    ranked = ranks.average_ranks(values.where(F.col(value) != 0).select(F.abs(value).alias("_a"), F.col(value).alias("_v")), "_a")
    # every one of k equal values adds k * k - 1, so all of them k * (k * k - 1)
    sums = ranked.agg(
        F.coalesce(F.sum(F.when(F.col("_v") > 0, F.col("avg_rank"))), F.lit(0.0)).alias("up"), F.coalesce(F.sum(F.when(F.col("_v") < 0, F.col("avg_rank"))), F.lit(0.0)).alias("down"),
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.col("ties") * F.col("ties") - 1), F.lit(0)).alias("tied"),
    )
    w = F.least("up", "down")
    z = F.try_divide(w - F.expr("n * (n + 1) / 4"), F.sqrt(F.expr("n * (n + 1) * (2 * n + 1) / 24 - tied / 48")))
    exact = (F.col("n") <= EXACT) & (F.col("tied") == 0) & (F.col("zeros") == 0)
    p = F.when(F.col("n") == 0, F.lit(None)).when(exact, exact_p(F.col("n").cast("int"), w)).otherwise(F.least(F.lit(1.0), 2 * normal_tail(z)))
    return sums.crossJoin(F.broadcast(zeros)).select("n", w.alias("w"), p.alias("p"))


def exact_p(n: Column, w: Column) -> Column:
    """Twice the share of the 2^n sign patterns whose rank sum is at most ``w``: counts of sums, one rank added at a time."""
    none = lambda k: F.array_repeat(F.lit(0.0), k)
    counts = F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.array(F.lit(1.0)), lambda a, k: F.zip_with(F.concat(a, none(k)), F.concat(none(k), a), lambda x, y: x + y))
    below = F.aggregate(F.slice(counts, F.lit(1), F.floor(w).cast("int") + 1), F.lit(0.0), lambda a, x: a + x)
    return F.least(F.lit(1.0), 2 * below / F.pow(F.lit(2.0), n))


def normal_tail(z: Column) -> Column:
    """The normal distribution function for z <= 0, by a rational series to about 1e-7 (Abramowitz and Stegun 26.2.17)."""
    x = F.abs(z)
    t = 1 / (1 + 0.2316419 * x)
    series = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.exp(-x * x / 2) / (2 * 3.141592653589793) ** 0.5 * series
