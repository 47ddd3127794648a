"""Stratified samples with exact weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import ranks


def hashed(seed: int, *keys: str) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.col(k).cast("string") for k in keys)))


def allocation(strata: DataFrame, key: str, size: str, total: int, minimum: int) -> DataFrame:
    """About ``total`` draws in proportion to the sizes, at least ``minimum`` and at most all of each stratum.

    As the scale of size * scale rises, a stratum gets its draw number k + 1 at scale (k + 1/2) / size.  Those points in order
    say at which scale the draws add up; points beyond twice the proportional scale can't matter and aren't made.
    """
    least = F.least(F.lit(minimum).cast("long"), F.col("_size"))
    rows = strata.select(F.col(key), F.col(size).cast("long").alias("_size")).withColumn("_least", least)
    sums = rows.agg(F.sum("_size").alias("_all"), F.sum("_least").alias("_given"), F.count(F.lit(1)).alias("_strata"))
    beside = rows.crossJoin(F.broadcast(sums))
    most = F.least(F.col("_size"), F.ceil(2 * (F.lit(total) + F.col("_strata")) * F.col("_size") / F.col("_all")).cast("long"))
    points = beside.where(most > F.col("_least")).withColumn("_k", F.explode(F.sequence(F.col("_least"), most - 1))).select(key, "_given", ((F.col("_k") + 0.5) / F.col("_size")).alias("_at"))
    ordered = ranks.numbered(points, [], ["_at", key], "_n")
    reached = ordered.where(F.col("_n") <= F.lit(total) - F.col("_given")).agg(F.coalesce(F.max("_at"), F.lit(0.0)).alias("_scale"))
    more = points.crossJoin(F.broadcast(reached)).where(F.col("_at") <= F.col("_scale")).groupBy(key).agg(F.count(F.lit(1)).alias("_more"))
    return rows.join(more, key, "left").select(key, (F.col("_least") + F.coalesce("_more", F.lit(0))).alias("given"))


def split_given(given: Column, first: Column, second: Column, boost: float) -> Column:
    """How many of a stratum's draws the first group gets: its boosted share, one at least for each group that has rows if there are two draws; a group that runs short leaves the rest to the other."""
    share = F.bround(given * first * boost / F.greatest(first * boost + second, F.lit(1))).cast("long")
    inner = F.least(F.greatest(share, F.lit(1)), first, F.greatest(given - 1, F.lit(0)))
    return F.least(F.greatest(inner, given - second), first).cast("long")


def draw_in_groups(rows: DataFrame, group: str, key: str, seed: int, k: int) -> DataFrame:
    """K rows of each group by hash, without replacement; each stands for group size / drawn rows.

    Ranks up to k are cut off in each task before anything is exchanged; sizes are counted apart.
    """
    top = rows.withColumn("_rn", F.row_number().over(Window.partitionBy(group).orderBy(hashed(seed, key), key))).where(F.col("_rn") <= k).drop("_rn")
    sizes = rows.groupBy(group).agg(F.count(F.lit(1)).alias("group_size"))
    return top.join(sizes, group).withColumn("group_drawn", F.least(F.lit(k), F.col("group_size"))).withColumn("weight", F.col("group_size") / F.col("group_drawn"))
