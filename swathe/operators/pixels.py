"""Spectral indices, masks and zonal statistics over a pixel table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def normalized(a: Column, b: Column, mask_negative: bool = True) -> Column:
    """Difference over sum; null where the sum is zero and, by option, where a band is negative."""
    ratio = F.try_divide(a - b, a + b)
    return F.when((a >= 0) & (b >= 0), ratio) if mask_negative else ratio


def savi(nir: Column, red: Column) -> Column:
    return F.try_divide(1.5 * (nir - red), nir + red + 0.5)


def bare_soil(swir: Column, red: Column, nir: Column, blue: Column) -> Column:
    return F.try_divide((swir + red) - (nir + blue), (swir + red) + (nir + blue))


def red_edge_position(red: Column, re1: Column, re2: Column, re3: Column) -> Column:
    return 705 + 35 * F.try_divide((red + re3) / 2 - re1, re2 - re1)


def clear(cs: Column, scl: Column) -> Column:
    """P14."""
    return (cs >= 0.6) & ~scl.isin(1, 2, 11)


def bits_clear(qa: Column, bits: list[int]) -> Column:
    """None of the bits is set."""
    return qa.bitwiseAND(sum(1 << b for b in bits)) == 0


def kelvin_to_celsius(raw: Column) -> Column:
    """P19."""
    return raw * 0.00341802 + 149 - 273.15


def wetness(upstream: Column, slope: Column) -> Column:
    """P23."""
    return F.log(F.greatest(upstream * 1e6 / 90, F.lit(1.0))) - F.log(F.greatest(F.tan(F.radians(slope)), F.lit(0.001)))


def near(cells: DataFrame, water: DataFrame, radius: int) -> DataFrame:
    """Cells not within ``radius`` of a water cell: each distinct water cell marks its circle, then one anti-join."""
    offsets = [(i, j) for i in range(-radius, radius + 1) for j in range(-radius, radius + 1) if i * i + j * j <= radius * radius]
    circle = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in offsets)))
    marked = water.select("px", "py").distinct().withColumn("o", circle).select((F.col("px") + F.col("o.i")).alias("px"), (F.col("py") + F.col("o.j")).alias("py")).distinct()
    return cells.join(marked, ["px", "py"], "left_anti")


def zonal(pixels: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean and count by zone, class and image, only where something was counted."""
    return pixels.groupBy(*keys).agg(F.avg(value).alias("mean"), F.count(value).alias("n")).where("n > 0")


#: Slope and intercept that bring each band of the older sensors to the newer one's.
OLDER = {"blue": (0.8474, 0.0003), "green": (0.8483, 0.0088), "red": (0.9047, 0.0061), "nir": (0.8462, 0.0412), "swir1": (0.8937, 0.0254), "swir2": (0.9071, 0.0172)}


def reflectance(raw: Column, band: str, older: Column) -> Column:
    """P20: scaled reflectance of a band; that of an older sensor is adjusted."""
    scaled = raw * 0.0000275 - 0.2
    slope, intercept = OLDER[band]
    return F.when(older, scaled * slope + intercept).otherwise(scaled)


def mosaic(pixels: DataFrame, cell: list[str], value: str, angle: str | None = None) -> DataFrame:
    """One value a pixel and pass, that of the last tile (of equals the largest); beside it the pass's distinct tiles and the mean angle of its images."""
    passes = pixels.groupBy("dt", "orbit").agg(F.array_join(F.array_sort(F.collect_set(F.col("tile").cast("string"))), ",").alias("tiles"))
    if angle:
        images = pixels.groupBy("dt", "orbit", "tile").agg(F.avg(angle).alias("_angle"))
        passes = passes.join(images.groupBy("dt", "orbit").agg(F.avg("_angle").alias(angle)), ["dt", "orbit"])
    last = pixels.groupBy(*cell, "dt", "orbit").agg(F.max(F.struct("tile", value)).alias("_l"))
    return last.withColumn(value, F.col(f"_l.{value}")).drop("_l").join(passes, ["dt", "orbit"])


def composite(pixels: DataFrame, cell: list[str], value: str) -> DataFrame:
    """Median, 90th percentile and count over time of each pixel."""
    return pixels.groupBy(*cell).agg(F.median(value).alias("median"), F.percentile(value, 0.9).alias("p90"), F.count(value).alias("clear"))


def zone_summary(cells: DataFrame, by: list[str], values: list[str]) -> DataFrame:
    """Mean, median, deviation, 10th and 90th percentile and count of each value over a zone's pixels."""
    found = [(f(v), f"{v}_{name}") for v in values for name, f in (("mean", F.avg), ("sd", F.stddev_pop), ("n", F.count), ("p10", lambda v: F.percentile(v, 0.1)), ("median", F.median), ("p90", lambda v: F.percentile(v, 0.9)))]
    return cells.groupBy(*by).agg(*(c.alias(n) for c, n in found))


def first_of(rows: DataFrame, keys: list[str], *order) -> DataFrame:
    return rows.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")
