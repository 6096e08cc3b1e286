"""Comparing distributions: Wasserstein-1, Kolmogorov-Smirnov, ECDF, quantiles, densities. All over DataFrame columns."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from domainscope.errors import DomainError
from domainscope.functions.scaling import number
from domainscope.plans.ordered import running_totals
from domainscope.plans.stable import kept


def _pooled(a: DataFrame, a_col: str, b: DataFrame, b_col: str, keep: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, int, int]:
    """v, next, fa, fb: both ECDFs at each distinct value of either, and the sample sizes."""
    one, two = (df.select(number(c).alias("v"), F.lit(float(w)).alias("na"), F.lit(float(1 - w)).alias("nb")).where("v is not null") for df, c, w in ((a, a_col, 1), (b, b_col, 0)))
    n, m = one.count(), two.count()
    if not n or not m:
        raise DomainError("a sample is empty")
    sums = running_totals(one.unionByName(two), "v", ["na", "nb"], keep)
    return sums.select("v", "next", (F.col("na") / n).alias("fa"), (F.col("nb") / m).alias("fb")), n, m


def wasserstein(a: DataFrame, a_col: str, b: DataFrame, b_col: str) -> float:
    """The integral of |F_a - F_b|; 0 for samples of one distribution."""
    with kept() as keep:
        steps, _, _ = _pooled(a, a_col, b, b_col, keep)
        return steps.where("next is not null").agg(F.sum(F.abs(F.col("fa") - F.col("fb")) * (F.col("next") - F.col("v")))).first()[0] or 0.0


def wasserstein_to(df: DataFrame, value: str, kind: str, target: str) -> dict[str, float]:
    """The distance of each kind's values to those of the target kind: all in one pass over the distinct values."""
    with kept() as keep:
        values = keep(df.select(number(value).alias("v"), F.col(kind).alias("kind")).where("v is not null").groupBy("v", "kind").agg(F.count("*").cast("double").alias("n")))
        sizes = {r["kind"]: r["n"] for r in values.groupBy("kind").agg(F.sum("n").alias("n")).collect()}
        if target not in sizes:
            raise DomainError("a sample is empty")
        names = sorted(sizes)
        counts = values.select("v", *(F.when(F.col("kind") == k, F.col("n")).otherwise(0.0).alias(f"n{i}") for i, k in enumerate(names)))
        steps = running_totals(counts, "v", [f"n{i}" for i in range(len(names))], keep).where("next is not null")
        share = lambda k: F.col(f"n{names.index(k)}") / sizes[k]
        others = [k for k in names if k != target]
        if not others:
            return {}
        found = steps.agg(*(F.sum(F.abs(share(k) - share(target)) * (F.col("next") - F.col("v"))) for k in others)).first()
        return {k: w or 0.0 for k, w in zip(others, found, strict=True)}


@dataclass(frozen=True)
class KsTest:
    statistic: float
    p_value: float
    exact: bool


def ks_greater(a: DataFrame, a_col: str, b: DataFrame, b_col: str, exact: bool | None = None) -> KsTest:
    """One-sided two-sample test against "the CDF of a lies above that of b": D+ = max(F_a - F_b)."""
    with kept() as keep:
        steps, n, m = _pooled(a, a_col, b, b_col, keep)
        d = max(0.0, steps.agg(F.max(F.col("fa") - F.col("fb"))).first()[0])
    return ks_p_value(d, n, m, exact)


def ks_p_value(d: float, n: int, m: int, exact: bool | None = None) -> KsTest:
    """Exact by counting lattice paths that stay under the line, or asymptotic; None: exact if n m < 10,000."""
    if not (n * m < 10_000 if exact is None else exact):
        return KsTest(d, min(1.0, math.exp(-2 * d * d * n * m / (n + m))), False)
    # share of paths from (0, 0) to (n, m) on which i / n - j / m never reaches d
    q = (0.5 + math.floor(d * n * m - 1e-7)) / (n * m)
    row = np.array([1.0 if -j / m < q else 0.0 for j in range(m + 1)])
    row = np.minimum.accumulate(row)
    for i in range(1, n + 1):
        w = i / (i + m)
        new = np.empty(m + 1)
        new[0] = 0.0 if i / n > q else w * row[0]
        for j in range(1, m + 1):
            new[j] = 0.0 if i / n - j / m > q else w * row[j] + new[j - 1]
        row = new
    return KsTest(d, float(min(1.0, max(0.0, 1 - row[m]))), True)


def w1(a: np.ndarray, b: np.ndarray) -> float:
    """Wasserstein-1 of two arrays, for searches on the driver or within one task."""
    a, b = np.sort(a), np.sort(b)
    v = np.concatenate([a, b])
    v.sort(kind="stable")
    fa, fb = np.searchsorted(a, v[:-1], "right") / len(a), np.searchsorted(b, v[:-1], "right") / len(b)
    return float(np.sum(np.abs(fa - fb) * np.diff(v)))


def ks_arrays(a: np.ndarray, b: np.ndarray) -> KsTest:
    a, b = np.sort(a), np.sort(b)
    v = np.concatenate([a, b])
    return ks_p_value(max(0.0, float(np.max(np.searchsorted(a, v, "right") / len(a) - np.searchsorted(b, v, "right") / len(b)))), len(a), len(b))


def ecdf(df: DataFrame, column: str) -> DataFrame:
    """v, f: the distinct values and the share of rows at or under each."""
    values = df.select(number(column).alias("v"), F.lit(1.0).alias("n")).where("v is not null")
    total = values.count()
    return running_totals(values, "v", ["n"]).select("v", (F.col("n") / max(1, total)).alias("f"))


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """bin (from 0), left, right, n, density over equal bins from the least to the greatest value, empty ones too."""
    values = df.select(number(column).alias("v")).where("v is not null")
    low, high, n = values.agg(F.min("v"), F.max("v"), F.count("*")).first()
    if not n:
        return df.sparkSession.createDataFrame([], "bin int, left double, right double, n long, density double")
    width = (high - low) / bins or 1.0
    place = F.least(F.floor((F.col("v") - low) / width).cast("int"), F.lit(bins - 1)).alias("bin")
    counts = values.select(place).groupBy("bin").agg(F.count("*").alias("n"))
    all_bins = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    count = F.coalesce("n", F.lit(0))
    return all_bins.join(counts, "bin", "left").select("bin", (F.lit(low) + F.col("bin") * width).alias("left"), (F.lit(low) + (F.col("bin") + 1) * width).alias("right"), count.alias("n"), (count / (n * width)).alias("density"))


def kernel_density(df: DataFrame, column: str, points: int = 512) -> DataFrame:
    """x, density: a Gaussian kernel estimate with bandwidth 0.9 min(sd, IQR / 1.34) n^-0.2, at equally spaced points three bandwidths beyond the data.

    Values are first binned on a grid of 16 cells a point, so that only counts meet the points."""
    values = df.select(number(column).alias("v")).where("v is not null")
    n, sd, q, low, high = values.agg(F.count("*"), F.stddev_samp("v"), F.percentile("v", F.array(F.lit(0.25), F.lit(0.75))), F.min("v"), F.max("v")).first()
    if not n:
        return df.sparkSession.createDataFrame([], "x double, density double")
    spread = min([x for x in (sd, (q[1] - q[0]) / 1.34) if x] or [abs(q[0]) or 1.0])
    h = 0.9 * spread * n**-0.2
    cells = 16 * points
    width = (high - low) / cells or 1.0
    counts = values.groupBy(F.least(F.floor((F.col("v") - low) / width), F.lit(cells - 1)).alias("c")).count().collect()  # at most `cells` rows
    at, weight = np.array([low + (r["c"] + 0.5) * width if high > low else low for r in counts]), np.array([r["count"] for r in counts], float)
    x = np.linspace(low - 3 * h, high + 3 * h, points)
    y = (np.exp(-0.5 * ((x[:, None] - at[None, :]) / h) ** 2) * weight).sum(axis=1) / (n * h * math.sqrt(2 * math.pi))
    return df.sparkSession.createDataFrame(list(zip(x.tolist(), y.tolist(), strict=True)), "x double, density double")


def upper_whisker(df: DataFrame, column: str) -> float | None:
    """min(Q75 + 1.5 IQR, max), with exact interpolated quantiles."""
    q, top = df.agg(F.percentile(column, F.array(F.lit(0.25), F.lit(0.75))), F.max(column)).first()
    return None if q is None else min(q[1] + 1.5 * (q[1] - q[0]), top)


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


__all__ = ["KsTest", "ecdf", "histogram", "kernel_density", "ks_arrays", "ks_greater", "ks_p_value", "union", "upper_whisker", "w1", "wasserstein", "wasserstein_to"]
