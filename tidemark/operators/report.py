"""The whole report on a dataset of images: one row from one pass over the pixels.

Measures of every image are written once (a few numbers an image); summary, profiles, quality issues and score, drift against a
baseline, match with a synthetic set, health and recommendations all read that table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import drift as dr
from tidemark.operators import profiling as pr
from tidemark.operators import raster as ra
from tidemark.operators import rules
from tidemark.operators.joins import metric_rows, recommend
from tidemark.sources.tables import pin

#: Datasets that ``images.dataset`` may name: the one reported on, the one before it, and generated images.
CURRENT, BASELINE, SYNTHETIC = "current", "baseline", "synthetic"


def _measured(images: DataFrame) -> DataFrame:
    """Columns that the profiles read, of images that could be measured; the rest count as corrupted."""
    return ra.report_measures(images).withColumns({
        "width": F.col("w").cast("bigint"), "height": F.col("h").cast("bigint"), "is_corrupted": F.col("brightness").isNull(),
        "ocean_coverage": F.col("water_coverage"), "deviation": F.col("contrast"), "contrast": F.col("contrast") / 255.0})


def dataset_report(images: DataFrame, files: DataFrame, as_of: Column) -> DataFrame:
    """One row on the images of dataset ``current``: summary, profile, issues, score, drift, match, health, recommendations.

    ``images`` holds ``image_id, dataset, h, w, r, g, b`` (planes of levels 0-255; an image that cannot be measured counts as
    corrupted and enters no mean), ``files`` a listing as ``profiling.health_row`` takes it. Without rows of ``baseline`` the drift
    columns are null and nothing is said about drift; without rows of ``synthetic`` the match columns are. Lists are sorted.
    """
    measured = pin(_measured(images))
    named = pin(measured.filter(F.col("dataset") == CURRENT).drop("dataset"))
    profile = pin(pr.image_profile(named))
    long = dr.to_long(measured.filter("NOT is_corrupted").select("dataset", *[
        F.round("deviation" if c == "contrast" else c, 9).alias(c) for c in ra.FEATURES]), ra.FEATURES)
    ks = pin(dr.rank_distances(long.filter(F.col("feature").isin(dr.DRIFT_FEATURES)), BASELINE, CURRENT).select("feature", "ks"))
    match = dr.rank_distances(long, CURRENT, SYNTHETIC).agg(F.avg("ks").alias("ks"), F.avg("wasserstein").alias("wasserstein"))
    verdict = dr.report_of(ks)
    health = pin(pr.health_row(files, named, verdict, as_of))
    texts = recommend(
        metric_rows(pr.issue_counts(profile), ["critical_issues", "high_issues", "low_resolution_or_blur", "no_ocean_content", "corruption", "issues"])
        .unionByName(metric_rows(health.withColumn("alerts", F.size("alerts")), ["alerts", "quality_score", "freshness_hours", "duplicate_percentage"]))
        .unionByName(metric_rows(profile.select(F.col("n").alias("total_samples")), ["total_samples"])), rules.QUALITY + rules.HEALTH) \
        .unionByName(recommend(dr.drift_measures(ks).filter(ks.select(F.count("ks")).scalar() > 0), rules.DRIFT)).distinct()
    issues = pr.quality_issues(profile).select(F.concat("severity", F.lit(": "), "issue", F.lit(" ("), "affected", F.lit(")")).alias("text"))

    def listed(df: DataFrame) -> Column:
        return df.agg(F.array_sort(F.collect_list("text"))).scalar()
    summary = named.agg(
        F.count("*").alias("images"), F.count_if("is_corrupted").alias("corrupted"), F.avg("width").alias("mean_width"), F.avg("height").alias("mean_height"),
        F.avg("brightness").alias("mean_brightness"), F.avg("contrast").alias("mean_contrast"), F.avg("dynamic_range").alias("mean_dynamic_range"),
        F.avg("entropy").alias("mean_entropy"), F.avg("sharpness").alias("mean_sharpness"), F.avg("colour_balance").alias("mean_colour_balance"),
        F.avg("ocean_coverage").alias("mean_coverage"))
    one = F.lit(1).alias("_k")
    row = summary.select(one, "*").join(F.broadcast(health.select(
        one, F.col("total_samples").alias("files"), "quality_score", "drift_score", "anomaly_count", "missing_percentage",
        "duplicate_percentage", "format_consistency", "freshness_hours", "alerts")), "_k")
    found = match.select(one, F.col("ks").alias("match_ks"), F.when(F.col("ks").isNotNull(), F.greatest(F.lit(0.0), 1 - F.col("ks"))).alias("match_score"))
    return row.join(F.broadcast(found), "_k").drop("_k").withColumns({"issues": listed(issues), "recommendations": listed(texts)})
