"""Ring against own comparison ring in the same satellite pass, medians over passes, weighted summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import ranks, resample
from ..sources.files import written

COMPARISON = "500-1000"
MIN_PIXELS = 20


def one_image_per_pass(obs: DataFrame, *unit: str, count: str = "n", keys: tuple[str, ...] = ("pass_date", "orbit")) -> DataFrame:
    """Rows of the image with the most counted pixels of a unit's pass; of equals the first image."""
    of_image, of_pass = Window.partitionBy(*unit, *keys, "image"), Window.partitionBy(*unit, *keys)
    # dealt by unit and pass once, which serves those windows too that follow on a unit's pass; none of these has an order of its own, so a task sorts its rows once
    pixels = obs.repartition(*unit, *keys).withColumn("_px", F.sum(count).over(of_image)).withColumn("_top", F.max("_px").over(of_pass))
    best = F.min(F.when(F.col("_px").eqNullSafe(F.col("_top")), F.col("image"))).over(of_pass)
    return pixels.withColumn("_best", best).where("image = _best").drop("_px", "_top", "_best")


def one_row_per_class_pass(obs: DataFrame, keys: tuple[str, ...] = ("segment_id", "ring", "landcover", "pass_date", "orbit"), order: tuple = ("-n", "m")) -> DataFrame:
    """The row with the most pixels of each zone, class and pass; rows alike in the order stand by their day, so that every run takes the same."""
    order = (*order, "doy") if "doy" in obs.columns and "doy" not in order else order
    by = [F.desc(c[1:]) if c[0] == "-" else F.col(c) for c in order]
    return obs.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*by))).where("_rn = 1").drop("_rn")


def pooled(rows: DataFrame, keys: list[str], mean: str = "m", count: str = "n") -> DataFrame:
    """A1: means weighted by their counts, the counts' sum and, if there is one, the first day; what has no count is left out."""
    day = [F.min("doy").alias("doy")] if "doy" in rows.columns else []
    return rows.where(F.col(count) > 0).groupBy(*keys).agg((F.sum(F.col(mean) * F.col(count)) / F.sum(count)).alias("v"), F.sum(count).alias("n"), *day)


def pool_rings(rows: DataFrame, groups: dict[str, list[str]]) -> DataFrame:
    """A2: rename rings to the wider ring that they are part of; rings in no group keep their name."""
    name = F.coalesce(*(F.when(F.col("ring").isin(parts), wide) for wide, parts in groups.items()), F.col("ring"))
    return rows.withColumn("ring", name)


def against_comparison(values: DataFrame, min_pixels: int = MIN_PIXELS) -> DataFrame:
    """Each ring's pooled value less the comparison ring's in the same pass, both with enough pixels.

    The comparison value reaches its pass's other rings through a window, so the table is shuffled once and joined with nothing.
    """
    own = F.max(F.when((F.col("ring") == COMPARISON) & (F.col("n") >= min_pixels), F.col("v"))).over(Window.partitionBy("segment_id", "year", "pass_date", "orbit"))
    return values.withColumn("_c", own).where((F.col("ring") != COMPARISON) & (F.col("n") >= min_pixels) & F.col("_c").isNotNull()).select("segment_id", "year", "pass_date", "orbit", "ring", (F.col("v") - F.col("_c")).alias("diff_all"), *(["doy"] if "doy" in values.columns else []))


def like_for_like(rows: DataFrame) -> DataFrame:
    """Differences within a land cover class, weighted by the smaller count; null when no class is shared."""
    w = Window.partitionBy("segment_id", "year", "pass_date", "orbit", "landcover")
    at = lambda c: F.max(F.when(F.col("ring") == COMPARISON, F.col(c))).over(w)
    both = rows.where("n > 0").withColumns({"_m": at("m"), "_n": at("n")}).where((F.col("ring") != COMPARISON) & F.col("_m").isNotNull() & F.col("m").isNotNull())
    least = F.least("n", "_n")
    return both.groupBy("segment_id", "year", "pass_date", "orbit", "ring").agg((F.sum((F.col("m") - F.col("_m")) * least) / F.sum(least)).alias("diff_same"))


def segment_springs(obs: DataFrame, min_pixels: int = MIN_PIXELS) -> DataFrame:
    """A4 over W1, W2, A1, J2, A3: one row for each segment, year and ring.

    Rows are dealt by segment and pass once; the comparison ring's values reach the other rings through windows of that pass, both
    kinds of difference come from one grouping, and only passes' differences go on to the medians.
    """
    one = one_row_per_class_pass(one_image_per_pass(obs, "segment_id")).where("n > 0")
    of_pass = ["segment_id", "year", "pass_date", "orbit"]
    own_class, whole = Window.partitionBy(*of_pass, "landcover"), Window.partitionBy(*of_pass)
    compared = F.col("ring") == COMPARISON
    rows = one.withColumns({c: F.max(F.when(compared, F.col(x))).over(own_class) for c, x in (("_m", "m"), ("_n", "n"))})
    shared = F.when(~compared & F.col("_m").isNotNull() & F.col("m").isNotNull(), F.least("n", "_n"))
    days = [F.min("doy").alias("doy")] if "doy" in obs.columns else []
    per = rows.groupBy(*of_pass, "ring").agg(
        (F.sum(F.col("m") * F.col("n")) / F.sum("n")).alias("v"), F.sum("n").alias("n"), (F.sum((F.col("m") - F.col("_m")) * shared) / F.sum(shared)).alias("diff_same"), *days,
    )
    enough = F.col("n") >= min_pixels
    gaps = per.withColumn("_c", F.max(F.when(compared & enough, F.col("v"))).over(whole)).where(~compared & enough & F.col("_c").isNotNull())
    middle = [F.median("doy").alias("doy_median")] if days else []
    return gaps.groupBy("segment_id", "year", "ring").agg(F.median(F.col("v") - F.col("_c")).alias("diff_all"), F.median("diff_same").alias("diff_same"), F.count(F.lit(1)).alias("passes"), *middle)


def enrich(rows: DataFrame, sample: DataFrame, labels: tuple[str, ...] = ("ecoregion", "commodity_group")) -> DataFrame:
    """Labels and weights of the sample; a row outside it has weight 1 and a stratum that says so."""
    joined = rows.join(sample.select("segment_id", *labels, "weight", F.concat_ws("|", "ecoregion", "commodity_group").alias("stratum")), "segment_id", "left")
    return joined.withColumns({"weight": F.coalesce("weight", F.lit(1)), "stratum": F.coalesce("stratum", F.lit("(not in sample)"))})


def weighted_median(rows: DataFrame, by: list[str], value: str, weight: str, name: str = "wmed") -> DataFrame:
    """The least value whose cumulative weight reaches half of the total.

    Weights of equal values are summed first, and the running sum is split over tasks: a group may hold all rows.
    """
    sums = rows.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_v")).agg(F.sum(weight).alias("_w"), F.count(F.lit(1)).alias("_k"))
    cum = ranks.running(sums, by, ["_v"], {"_c": F.col("_w")})
    return cum.groupBy(*by).agg(F.sum("_k").alias("segments"), F.min(F.when(F.col("_c") >= F.col("_c_total") / 2, F.col("_v"))).alias(name))


def bootstrap(rows: DataFrame, by: list[str], stratum: str, order: str, value: str, weight: str, draws: int, seed: int = 392) -> DataFrame:
    """The 2.5 and 97.5 percent points of weighted medians over resamples within strata; null for fewer than three rows."""
    known = written(rows.where(F.col(value).isNotNull()).select(*by, stratum, order, value, weight), "values")
    medians = resample.weighted_medians(known, by, stratum, order, value, weight, draws, seed)
    counts = known.groupBy(*by).agg(F.count(F.lit(1)).alias("segments"))
    # so many draws a group, whatever the data
    points = medians.groupBy(*by).agg(F.percentile("median", 0.025).alias("_lo"), F.percentile("median", 0.975).alias("_hi"))
    return points.join(counts, by).select(*by, "segments", *(F.when(F.col("segments") >= 3, F.col(c)).alias(n) for c, n in (("_lo", "lo95"), ("_hi", "hi95"))))


def scopes(rows: DataFrame, groups: list[str], measures: dict[str, str]) -> DataFrame:
    """Rows for the summary over everything and over each grouping, for each measure (column -> name): ``scope``, ``group``, ``measure``, ``_v``; a null group is no group."""
    pairs = F.array(F.struct(F.lit("statewide").alias("scope"), F.lit("all").alias("group")), *(F.struct(F.lit(g).alias("scope"), F.col(g).cast("string").alias("group")) for g in groups))
    values = F.array(*(F.struct(F.lit(name).alias("measure"), F.col(c).alias("_v")) for c, name in measures.items()))
    long = rows.withColumn("_p", F.explode(pairs)).withColumn("_q", F.explode(values))
    return long.select("*", "_p.scope", "_p.group", "_q.measure", "_q._v").where(F.col("group").isNotNull() & F.col("_v").isNotNull()).drop("_p", "_q")


def verdict(lo: Column, hi: Column) -> Column:
    """What an interval says."""
    return F.when(lo.isNull() | hi.isNull(), "no interval").when(hi < 0, "below").when(lo > 0, "above").otherwise("no difference")


def reach(rows: DataFrame, by: list[str], order: Column, flag: Column) -> DataFrame:
    """Length of the unbroken run of true flags from the first band, and of true flags after it."""
    w = Window.partitionBy(*by).orderBy("_o").rowsBetween(Window.unboundedPreceding, 0)
    runs = rows.withColumns({"_f": F.coalesce(flag, F.lit(False)).cast("int"), "_o": order}).withColumn("_r", F.min("_f").over(w))
    return runs.groupBy(*by).agg(F.sum("_r").alias("run_bands"), (F.sum("_f") - F.sum("_r")).alias("isolated_bands"))


def ring_start(ring: Column) -> Column:
    """Rings in order of distance."""
    return F.split(ring, "-")[0].cast("int")


def unique_or_fail(rows: DataFrame, keys: list[str]) -> DataFrame:
    """U4: the rows, or an error when a key occurs twice."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    return rows.withColumn("_n", n).where(F.assert_true(F.col("_n") == 1, F.lit("a key occurs twice")).isNull()).drop("_n")
