"""A linear model with heteroskedasticity-robust errors: sums on the executors, one small solve on the driver."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def robust_fit(rows: DataFrame, y: str, xs: list[str], least: int = 12) -> list[dict]:
    """Estimates, HC3 errors and 95% intervals, from cross-products in two passes; none for fewer than ``least`` rows."""
    terms = ["intercept", *xs]
    data = rows.select(F.col(y).cast("double").alias("_y"), F.lit(1.0).alias("x0"), *(F.col("`" + x.replace("`", "``") + "`").cast("double").alias(f"x{k + 1}") for k, x in enumerate(xs))).dropna()
    x = [F.col(f"x{k}") for k in range(len(terms))]
    pairs = [(i, j) for i in range(len(x)) for j in range(i, len(x))]
    sums = data.agg(F.count(F.lit(1)), *(F.sum(x[i] * x[j]) for i, j in pairs), *(F.sum(v * F.col("_y")) for v in x), F.sum("_y"), F.sum(F.col("_y") * F.col("_y"))).first()
    n = sums[0]
    if n < least:
        return []
    xx = _symmetric(pairs, sums[1 : 1 + len(pairs)], len(x))
    inverse = np.linalg.pinv(xx)
    beta = inverse @ np.array(sums[1 + len(pairs) : 1 + len(pairs) + len(x)])
    error = F.col("_y") - sum((F.lit(float(b)) * v for b, v in zip(beta, x, strict=True)), F.lit(0.0))
    leverage = sum((F.lit(float(inverse[i, j])) * x[i] * x[j] for i in range(len(x)) for j in range(len(x))), F.lit(0.0))
    scaled = error * error / ((1 - leverage) * (1 - leverage))
    second = data.agg(F.sum(error * error), *(F.sum(x[i] * x[j] * scaled) for i, j in pairs)).first()
    cov = inverse @ _symmetric(pairs, second[1:], len(x)) @ inverse
    spread = sums[-1] - sums[-2] ** 2 / n
    out = []
    for k, term in enumerate(terms):
        se = float(np.sqrt(cov[k, k]))
        out.append({"term": term, "estimate": float(beta[k]), "se": se, "lo95": float(beta[k]) - 1.959964 * se, "hi95": float(beta[k]) + 1.959964 * se, "p": math.erfc(abs(float(beta[k])) / se / math.sqrt(2)) if se else None, "n": n, "r2": 1 - second[0] / spread if spread else None})
    return out


#: Levels that a category may have in a model; the solve on the driver takes their square.
MOST_LEVELS = 200


def levels(rows: DataFrame, column: str) -> list[str]:
    """The values of a category, in order; the first is the reference.  More than ``MOST_LEVELS`` are an error."""
    found = [r[0] for r in rows.where(F.col(column).isNotNull()).select(F.col(column).cast("string")).distinct().limit(MOST_LEVELS + 1).collect()]
    if len(found) > MOST_LEVELS:
        raise ValueError(f"{column} has more than {MOST_LEVELS} values")
    return sorted(found)


def design(rows: DataFrame, y: str, terms: list[str], logs: dict[str, float] | None = None) -> tuple[DataFrame, list[str]]:
    """Columns of a model: numbers as they are, logarithms to base 10 of numbers of at least the given floor, flags as 0 and 1, categories as a
    column for each value but the first, and products of terms written ``a:b``.  Only rows that have all of them count, levels included.
    """
    logs = logs or {}
    simple = list(dict.fromkeys(part for t in terms for part in t.split(":")))
    rows = rows.withColumns({f"log_{c}": F.log10(F.greatest(F.col(c), F.lit(floor))) for c, floor in logs.items()})
    kinds = dict(rows.dtypes)
    known = rows.dropna(subset=[y, *simple])
    columns: dict[str, list[tuple[str, F.Column]]] = {}
    for c in simple:
        if kinds[c] == "string":
            columns[c] = [(f"{c}={k}", (F.col(c) == k).cast("double")) for k in levels(known, c)[1:]]
        elif kinds[c] == "boolean":
            columns[c] = [(c, F.col(c).cast("double"))]
        else:
            columns[c] = [(c, F.col(c).cast("double"))]
    made: dict[str, F.Column] = {}
    for t in terms:
        parts = [("", F.lit(1.0))]
        for c in t.split(":"):
            parts = [(f"{a}:{n}" if a else n, x * v) for a, x in parts for n, v in columns[c]]
        made |= dict(parts)
    return known.select(y, *(v.alias(n) for n, v in made.items())), list(made)


def _symmetric(pairs: list, values, k: int) -> np.ndarray:
    m = np.zeros((k, k))
    for (i, j), v in zip(pairs, values, strict=True):
        m[i, j] = m[j, i] = v
    return m
