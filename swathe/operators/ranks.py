"""Running sums, numbers, ranks and quantiles of ordered rows, split over tasks however few the groups are."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.files import written


def running(rows: DataFrame, by: list[str], order: list, sums: dict[str, Column], deal: list | None = None) -> DataFrame:
    """Rows with running sums in order within their group, the own row included, and the group's sums as ``<name>_total``.

    The order must be total; ``deal`` is a coarser one that agrees with it, for ranges whose limits needn't hold long texts.  Rows are dealt by ranges of group and order and written once, so a part's number says where it
    stands in its group; what the parts before it sum up to is one small row a group and part.
    """
    names = list(sums)
    dealt = rows.withColumns({f"_{n}": c for n, c in sums.items()}).repartitionByRange(*by, *(deal or order)).withColumn("_part", F.spark_partition_id())
    held = written(dealt, "ranges")
    keys = [*by, "_part"]
    parts = held.groupBy(*keys).agg(*(F.sum(f"_{n}").alias(n) for n in names))
    whole = Window.partitionBy(*by)
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(*(F.col(k).alias(f"_at{i}") for i, k in enumerate(keys)), *(x for n in names for x in (F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"_before_{n}"), F.sum(n).over(whole).alias(f"{n}_total"))))
    own = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_at{i}")) for i, k in enumerate(keys)])
    joined = held.withColumns({n: F.sum(f"_{n}").over(own) for n in names}).join(offsets, same)
    return joined.select(*rows.columns, *((F.col(n) + F.col(f"_before_{n}")).alias(n) for n in names), *(f"{n}_total" for n in names))


def numbered(rows: DataFrame, by: list[str], order: list, name: str = "place") -> DataFrame:
    """Rows with their number in order within their group, from 1, and the group's size as ``<name>_total``."""
    return running(rows, by, order, {name: F.lit(1).cast("long")})


def quantiles(rows: DataFrame, by: list[str], value: str, at: dict[str, float]) -> DataFrame:
    """Interpolated quantiles of each group, from counts of equal values."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_k"))
    ranked = running(counts, by, ["_v"], {"_c": F.col("_k")})
    place = {n: (F.col("_c_total") - 1) * F.lit(q) for n, q in at.items()}
    pick = lambda r: F.min(F.when(F.col("_c") > r, F.col("_v")))
    sums = ranked.groupBy(*by).agg(F.max("_c_total").alias("_n"), *(x for n, p in place.items() for x in (pick(F.floor(p)).alias(f"_lo_{n}"), pick(F.ceil(p)).alias(f"_hi_{n}"))))
    within = {n: (F.col("_n") - 1) * F.lit(q) - F.floor((F.col("_n") - 1) * F.lit(q)) for n, q in at.items()}
    return sums.select(*by, *((F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * w).alias(n) for n, w in within.items()))


def average_ranks(rows: DataFrame, value: str, name: str = "avg_rank") -> DataFrame:
    """Ranks in which equal values share the mean of their places; equal values are counted before anything is ordered."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("_ranked")).agg(F.count(F.lit(1)).alias("_k"))
    ranked = running(counts, [], ["_ranked"], {"_c": F.col("_k")}).select("_ranked", (F.col("_c") - (F.col("_k") - 1) / 2.0).alias(name), F.col("_k").alias("ties"))
    return rows.join(ranked, F.col(value) == F.col("_ranked")).drop("_ranked")
