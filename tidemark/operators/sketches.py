"""Daily sketches as a table: quantiles and distinct counts of any range of days without reading its rows again.

A day's rows become one row a key: a quantile sketch of the values, a distinct-count sketch of the items, and exact count,
smallest and largest value. Days merge in any order, so a baseline of a year is a merge of 365 small rows a key, and new days are
appended.

Bounds: a rank from a quantile sketch is off by at most ``rank_error(k)`` with 99 % confidence, whatever the number of rows or merges;
distances between two sketches by twice that and the step of the grid they are compared on. A distinct count is within
``3 * 1.04 / sqrt(2 ** lg)`` of the truth with 99.7 % confidence. A sketch of fewer than ``k`` values is exact.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Size of a quantile sketch and base-2 logarithm of the buckets of a distinct-count sketch.
QUANTILE_K, DISTINCT_LG = 1600, 14
#: Quantiles of each side on which two sketches are compared.
GRID = 512


def rank_error(k: int = QUANTILE_K) -> float:
    """Largest error of a rank (as a share) with 99 % confidence."""
    return 2.296 / k ** 0.9021


def daily_sketches(df: DataFrame, day: Column, keys: Sequence[str], value: str, item: str | None = None, *,
                   k: int = QUANTILE_K, lg: int = DISTINCT_LG) -> DataFrame:
    """(day, keys, n, low, high, quantiles, distinct): one row a day and key; partial sketches are built before the shuffle.

    Null and not-a-number values are left out of ``n`` and the quantiles, null items out of the distinct count; a day without
    any value has ``n`` 0 and no quantiles.
    """
    v = F.col(value).cast("double")
    known = F.when(~F.isnan(v), v)
    items = F.hll_sketch_agg(F.col(item), F.lit(lg)) if item else F.lit(None).cast("binary")
    return df.groupBy(day.alias("day"), *keys).agg(
        F.count(known).alias("n"), F.min(known).alias("low"), F.max(known).alias("high"),
        F.kll_sketch_agg_double(known, k).alias("quantiles"), items.alias("distinct"))


def merged(sketches: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The days of a sketch table as one row a key."""
    held = sketches.filter("n > 0")
    return held.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), F.kll_merge_agg_double("quantiles").alias("quantiles"),
        F.hll_union_agg("distinct").alias("distinct"))


def quantiles(merge: DataFrame, keys: Sequence[str], shares: dict[str, float]) -> DataFrame:
    """Named quantiles of each key, and the distinct count where items were kept."""
    return merge.select(*keys, "n", "low", "high", *[
        F.kll_sketch_get_quantile_double("quantiles", F.lit(share)).alias(name) for name, share in shares.items()],
        F.hll_sketch_estimate("distinct").alias("distinct"))


def sketch_distances(baseline: DataFrame, current: DataFrame, keys: Sequence[str], *, grid: int = GRID) -> DataFrame:
    """(keys, n1, n2, ks, wasserstein) of two merges: largest and integrated gap of their rank curves.

    Each side is read at ``grid`` evenly spaced shares, so at most twice that many points a key meet, whatever the data. Keys on one side
    only do not appear.
    """
    shares = F.array(*[F.lit((i + 0.5) / grid) for i in range(grid)])
    points = [df.select(*keys, *[(F.col("n") if i == k else F.lit(0)).alias(f"n{i}") for i in (1, 2)],
                        *[F.lit(1.0 if i == k else 0.0).alias(f"w{i}") for i in (1, 2)],
                        F.explode(F.kll_sketch_get_quantile_double("quantiles", shares)).alias("x")) for k, df in ((1, baseline), (2, current))]
    at = points[0].unionByName(points[1]).groupBy(*keys, "x").agg(*[F.max(f"n{i}").alias(f"n{i}") for i in (1, 2)], *[F.sum(f"w{i}").alias(f"w{i}") for i in (1, 2)])
    by_value = Window.partitionBy(*keys).orderBy("x")  # at most 2 * grid rows a key
    gaps = at.select(*keys, "n1", "n2", F.abs(F.sum(F.col("w1") - F.col("w2")).over(by_value) / grid).alias("gap"),
                     F.coalesce(F.lead("x").over(by_value) - F.col("x"), F.lit(0.0)).alias("width"))
    both = gaps.groupBy(*keys).agg(F.max("n1").alias("n1"), F.max("n2").alias("n2"), F.max("gap").alias("ks"), F.sum(F.col("gap") * F.col("width")).alias("wasserstein"))
    return both.filter("n1 > 0 AND n2 > 0")
