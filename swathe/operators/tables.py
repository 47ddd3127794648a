"""Audits, comparisons and reconciliation of tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.files import written
from . import ranks


def profile(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Rows, blanks, repeated keys, separators and the value's range in one pass after one distinct count."""
    v, k = F.col(value), F.col(key)
    return rows.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(v.isNull()).alias("blanks"), F.round(F.try_divide(100 * F.count_if(v.isNull()), F.count(F.lit(1))), 6).alias("blank_pct"),
        (F.count(k) - F.countDistinct(k)).alias("duplicates"), F.count_if(k.contains(" ")).alias("spaces"), F.count_if(k.contains("_")).alias("underscores"),
        F.min(v).alias("least"), F.round(F.avg(v), 6).alias("mean"), F.max(v).alias("most"), F.max(F.length(F.regexp_extract(key, r"^(\d+)", 1))).cast("long").alias("longest_number"),
    )


def compare(old: DataFrame, new: DataFrame, key: str, a: str, b: str, tolerance: float) -> DataFrame:
    """Correlation, absolute differences and one-sided blanks of two tables joined on a key."""
    both = written(old.join(new, key).withColumn("_d", F.abs(F.col(a) - F.col(b))), "compared")
    sums = both.agg(
        F.count(F.lit(1)).alias("n_rows"), F.round(F.corr(a, b), 6).alias("r"), F.round(F.max("_d"), 6).alias("max_diff"),
        F.round(F.avg((F.col("_d") <= tolerance).cast("double")), 6).alias("within"), F.count_if(F.col(a).isNull() & F.col(b).isNotNull()).alias("only_new"), F.count_if(F.col(a).isNotNull() & F.col(b).isNull()).alias("only_old"),
    )
    points = ranks.quantiles(both, [], "_d", {"median_diff": 0.5, "p95_diff": 0.95})
    return sums.crossJoin(F.broadcast(points)).withColumns({c: F.round(c, 6) for c in ("median_diff", "p95_diff")})


def lineage(parts: DataFrame, combined: DataFrame, key: str, part: str, value: str) -> DataFrame:
    """Of each part and of all parts: rows, how many the combined table has, how many not, and the largest difference of the value."""
    there = combined.select(F.col(key).alias("_key"), F.col(value).alias("_value"))
    joined = parts.join(there, F.col(key) == F.col("_key"), "left").withColumn(part, F.explode(F.array(F.col(part), F.lit("all"))))
    return joined.groupBy(part).agg(F.count(F.lit(1)).alias("n_rows"), F.count("_key").alias("found"), F.count_if(F.col("_key").isNull()).alias("missing"), F.max(F.abs(F.col(value) - F.col("_value"))).alias("max_diff"))


def aligned(a: DataFrame, b: DataFrame, key: list[str], values: list[str], rtol: float = 1e-9, atol: float = 1e-12) -> DataFrame:
    """Rows of two tables side by side by key, ``_a`` and ``_b``, and whether they are ``_alike``; numbers are within a tolerance, and a missing row is like none."""
    left, right = a.select(*key, F.struct(*values).alias("_a")), b.select(*key, F.struct(*values).alias("_b"))

    def equal(c: str) -> Column:
        x, y = F.col(f"_a.{c}"), F.col(f"_b.{c}")
        if dict(a.dtypes)[c] in ("double", "float"):
            return x.eqNullSafe(y) | F.coalesce(F.abs(x - y) <= atol + rtol * F.abs(y), F.lit(False)) | F.coalesce(F.isnan(x) & F.isnan(y), F.lit(False))
        return x.eqNullSafe(y)

    alike = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    for c in values:
        alike = alike & equal(c)
    return left.join(right, key, "full").withColumn("_alike", alike)


def same_rows(a: DataFrame, b: DataFrame, key: list[str], values: list[str], rtol: float = 1e-9, atol: float = 1e-12) -> DataFrame:
    """Rows of either table without an equal row of the same key in the other; none when the tables agree."""
    return aligned(a, b, key, values, rtol, atol).where(~F.col("_alike")).drop("_alike")


def agreement(checked: str, a: DataFrame, b: DataFrame, key: list[str], values: list[str], rtol: float = 1e-9, atol: float = 1e-9) -> DataFrame:
    """V9: of an answer and the same by a second plan, how many items there are in either and how many agree."""
    return aligned(a, b, key, values, rtol, atol).agg(F.lit(checked).alias("checked"), F.count(F.lit(1)).alias("items"), F.count_if("_alike").alias("agree"))


def share_of_total(rows: DataFrame, by: list[str], amount: Column) -> DataFrame:
    """Sums with their percentage of all, null where all is 0; the grouped table is small, so its total is one row beside it."""
    sums = rows.groupBy(*by).agg(F.sum(amount).alias("amount"), F.count(F.lit(1)).alias("pieces"))
    total = sums.agg(F.sum("amount").alias("_a"), F.sum("pieces").alias("_p"))
    return sums.crossJoin(F.broadcast(total)).select(*by, "pieces", "amount", F.try_divide(100 * F.col("pieces"), F.col("_p")).alias("pieces_pct"), F.try_divide(100 * F.col("amount"), F.col("_a")).alias("amount_pct"))
