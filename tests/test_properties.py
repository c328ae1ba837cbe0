"""Invariants on generated inputs."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.operators import bands, calibration, drift, evaluation, kernels, ranking

few = settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
heights = st.floats(0.1, 10, allow_nan=False)
grid = st.integers(0, 20).map(lambda i: i / 10)


@few
@given(st.lists(st.tuples(heights, heights), min_size=2, max_size=40))
def test_regression_bounds(spark, rows):
    got = evaluation.regression_metrics(spark.createDataFrame(rows, "h_true double, h_pred double")).first()
    assert 0 <= got["mae"] <= got["rmse"] + 1e-9 and 0 <= got["within_02_pct"] <= got["within_05_pct"] <= 100
    assert 0 <= got["median_abs_error"] <= got["p95_abs_error"] + 1e-12 and 0 <= got["extreme_detection_pct"] <= 100


@few
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 2)), min_size=1, max_size=60))
def test_confusion_diagonal_is_the_hits(spark, rows):
    df = spark.createDataFrame(rows, "t int, p int")
    cells = evaluation.confusion_matrix(df, [0, 1, 2], truth="t", pred="p").collect()
    scores = evaluation.classification_metrics(df, [0, 1, 2], truth="t", pred="p").collect()
    assert sum(r["n"] for r in cells) == len(rows)
    assert sum(r["n"] for r in cells if r["target"] == r["predicted"]) == sum(t == p for t, p in rows)
    assert all(0 <= r[c] <= 1 for r in scores for c in ("precision", "recall", "f1", "accuracy", "macro_f1"))


@few
@given(st.lists(st.tuples(st.floats(0, 1), st.integers(0, 1)), min_size=1, max_size=60))
def test_calibration_bounds(spark, rows):
    pairs = spark.createDataFrame([("h", c, float(y)) for c, y in rows], "task string, confidence double, correct double")
    got = calibration.calibration_errors(pairs, ["task"]).first()
    assert 0 <= got["ece"] <= got["mce"] + 1e-12 <= 1 + 1e-9 and got["ace"] <= got["mce"] + 1e-12 and got["n"] == len(rows)


@few
@given(st.lists(grid, min_size=2, max_size=40), st.lists(grid, min_size=2, max_size=40))
def test_distances_are_symmetric_and_bounded(spark, a, b):
    rows = [("a", x) for x in a] + [("b", x) for x in b]
    long = drift.to_long(spark.createDataFrame(rows, "dataset string, x double"), ["x"])
    one, two = (drift.rank_distances(long, *names).first() for names in (("a", "b"), ("b", "a")))
    assert 0 <= one["ks"] <= 1 and one["wasserstein"] >= 0
    assert one["ks"] == pytest.approx(two["ks"]) and one["wasserstein"] == pytest.approx(two["wasserstein"])
    assert one["mann_whitney_u"] + two["mann_whitney_u"] == pytest.approx(len(a) * len(b))
    assert drift.kl_divergence(long, "a", "b").first()["kl"] >= 0


@few
@given(st.lists(st.tuples(st.sampled_from("ab"), grid), min_size=1, max_size=60), st.floats(0, 1))
def test_percentiles_equal_numpy(spark, rows, p):
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r["k"]: r["x"] for r in ranking.exact_percentiles(df, ["k"], "v", {"x": p}, bounded_keys=True).collect()}
    for k, g in pd.DataFrame(rows, columns=["k", "v"]).groupby("k"):
        assert got[k] == pytest.approx(np.percentile(g["v"], 100 * p), abs=1e-9)


@few
@given(st.floats(0, 1), st.sampled_from(sorted(bands.RATINGS)))
def test_every_score_has_a_rating(spark, score, scheme):
    got = spark.range(1).select(bands.rate(F.lit(score), bands.RATINGS[scheme])).first()[0]
    assert got in [name for _, name in bands.RATINGS[scheme]]


@settings(max_examples=50, deadline=None)
@given(st.integers(3, 12), st.integers(3, 12), st.integers(0, 2 ** 32 - 1))
def test_kernels_ignore_constants_and_keep_means(h, w, seed):
    a = np.random.default_rng(seed).uniform(0, 1, (2, h, w))
    assert kernels.laplacian(a + 5) == pytest.approx(kernels.laplacian(a), abs=1e-9)
    assert kernels.sobel(a + 5) == pytest.approx(kernels.sobel(a), abs=1e-9)
    assert kernels.mean(kernels.box(a, 3, "reflect")) == pytest.approx(kernels.mean(a))
    assert kernels.mean(kernels.gaussian(a)) == pytest.approx(kernels.mean(a))
    assert (kernels.share_above(a, 85) <= 0.15 + 1 / (h * w)).all()
    assert kernels.counts(np.floor(a * 50), 50).sum() == a.size
