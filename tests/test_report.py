"""The dataset report against NumPy on hand-made images, with sets and images missing."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import raster as ra
from tidemark.operators import report

SCHEMA = "image_id string, dataset string, h int, w int, r array<double>, g array<double>, b array<double>"


def image(ident, dataset, seed, low=0, high=256):
    planes = np.random.default_rng(seed).integers(low, high, (3, 12 * 10)).astype(float)
    return (ident, dataset, 12, 10, *[p.tolist() for p in planes])


@pytest.fixture(scope="module")
def files(spark):
    rows = [("a", "jpg", 10, "x", True, 3), ("b", "jpg", 10, "x", True, 4), ("c", "png", 12, "y", False, 5)]
    return spark.createDataFrame(rows, "path string, ext string, length int, content_hash string, valid boolean, _d int").withColumn(
        "modified", F.expr("TIMESTAMP_NTZ '2024-12-31 12:00:00' - make_dt_interval(0, _d, 0, 0)")).drop("_d")


def made(spark, files, rows):
    return report.dataset_report(spark.createDataFrame(rows, SCHEMA), files, F.lit("2025-01-01").cast("timestamp_ntz")).first()


def test_report_of_bright_images_after_dark_ones(spark, files):
    current = [image(f"c{i}", "current", i, 100) for i in range(9)]
    broken = [("gone", "current", 12, 10, None, None, None), ("short", "current", 12, 10, [1.0], [1.0], [1.0])]
    rows = current + broken + [image(f"b{i}", "baseline", 50 + i, 0, 90) for i in range(7)] + [image(f"s{i}", "synthetic", i, 100) for i in range(9)]
    got = made(spark, files, rows)
    levels = [np.floor(0.299 * np.array(c[4]) + 0.587 * np.array(c[5]) + 0.114 * np.array(c[6]) + 0.5) for c in current]
    assert (got["images"], got["corrupted"], got["mean_width"], got["mean_height"]) == (11, 2, 10, 12)
    assert got["mean_brightness"] == pytest.approx(np.mean([v.mean() for v in levels]))
    assert got["mean_contrast"] == pytest.approx(np.mean([v.std() for v in levels]) / 255)
    assert got["mean_dynamic_range"] == pytest.approx(np.mean([v.max() - v.min() for v in levels]) / 255)
    assert got["drift_score"] > 0.5 and "data drift detected" in got["alerts"] and "affected feature: brightness" in got["alerts"]
    assert got["match_ks"] == 0 and got["match_score"] == 1
    assert (got["files"], got["format_consistency"], got["freshness_hours"]) == (3, 0.5, 15.0)
    assert got["missing_percentage"] == pytest.approx(100 / 3) == got["duplicate_percentage"]
    assert "critical: corruption (2)" in got["issues"] and got["issues"] == sorted(got["issues"])
    assert "Significant data drift detected - investigate data collection pipeline" in got["recommendations"]


def test_report_without_other_sets_says_nothing_about_them(spark, files):
    got = made(spark, files, [image(f"c{i}", "current", i) for i in range(4)] + [image("other", None, 9)])
    assert got["images"] == 4 and got["corrupted"] == 0
    assert got["drift_score"] is None and got["match_ks"] is None and got["match_score"] is None
    assert not [t for t in got["recommendations"] if "drift" in t] and not [a for a in got["alerts"] if "drift" in a]


def test_report_of_no_images(spark, files):
    got = made(spark, files, [image("b", "baseline", 1)])
    assert got["images"] == 0 and got["mean_brightness"] is None and got["issues"] == []


def test_one_pass_over_the_pixels(spark):
    df = spark.createDataFrame([image("a", "current", 1)], SCHEMA)
    plan = ra.report_measures(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1
