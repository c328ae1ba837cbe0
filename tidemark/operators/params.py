"""Diversity of parameter sets held in map columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ranking import exact_percentiles, null_safe_join


def long_form(df: DataFrame, params: str) -> DataFrame:
    """``(name, value)`` rows of a parameter map, missing values left out."""
    return df.select(F.explode(params).alias("name", "value")).filter(F.col("value").isNotNull())


def param_diversity(df: DataFrame, params: str, ranges: dict[str, tuple[float, float]]) -> DataFrame:
    """Per parameter: spread, uniqueness, range use against ``ranges`` (1 where none is given), diversity score."""
    long = long_form(df, params)
    stats = long.groupBy("name").agg(
        F.count("*").alias("total_values"), F.countDistinct("value").alias("unique_values"),
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.min("value").alias("min"),
        F.max("value").alias("max"), (F.max("value") - F.min("value")).alias("range"))
    median = exact_percentiles(long, ["name"], "value", {"median": 0.5})
    used = F.lit(1.0)
    for name, (low, high) in ranges.items():
        used = F.when(F.col("name") == name, F.col("range") / F.lit(high - low) if high > low else F.lit(0.0)) \
                .otherwise(used)
    out = null_safe_join(stats, median, ["name"]).withColumns({
        "uniqueness_ratio": F.col("unique_values") / F.col("total_values"),
        "cv": F.when(F.col("mean") != 0, F.col("std") / F.col("mean")).otherwise(0.0), "range_utilization": used})
    return out.withColumn("diversity_score", (
        F.col("uniqueness_ratio") + F.col("range_utilization") + F.least(F.col("cv"), F.lit(1.0))) / 3.0)


def param_combinations(df: DataFrame, params: str, digits: int = 3) -> DataFrame:
    """Distinct parameter combinations (values rounded), duplicates and uniqueness rate."""
    entries = F.array_sort(F.map_entries(F.transform_values(params, lambda k, v: F.round(v, digits))))
    groups = df.groupBy(F.to_json(entries).alias("_sig")).agg(F.count("*").alias("n"))
    return groups.agg(
        F.sum("n").alias("total"), F.count("*").alias("unique_combinations"),
        (F.sum("n") - F.count("*")).alias("duplicates"),
        F.coalesce(F.try_divide(F.count("*"), F.sum("n")), F.lit(0.0)).alias("uniqueness_rate"))


def quality_bins(df: DataFrame, score: str) -> DataFrame:
    """Histogram at one decimal with the level read off the rounded bin and the share of all rows."""
    bins = df.groupBy(F.round(score, 1).alias("bin")).agg(F.count("*").alias("n"))
    total = bins.agg(F.sum("n")).scalar()
    level = F.when(F.col("bin") >= 0.8, "high").when(F.col("bin") >= 0.6, "medium").otherwise("low")
    return bins.withColumns({"level": level, "share": F.col("n") / total})
