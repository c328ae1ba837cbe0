"""Raster kernels against loops over pixels, and raster features on known images."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import kernels as kn
from tidemark.operators import raster as ra


def index(k, n, border):
    if border == "mirror":
        return -k if k < 0 else 2 * n - 2 - k if k >= n else k
    k %= 2 * n
    return 2 * n - 1 - k if k >= n else k


def neighbour_sum(a, weights, border):
    h, w = a.shape
    return np.array([[sum(wt * a[index(y + dy, h, border), index(x + dx, w, border)] for (dy, dx), wt in weights.items())
                      for x in range(w)] for y in range(h)])


@pytest.fixture
def stack():
    return np.random.default_rng(0).uniform(0, 1, (3, 7, 9))


def test_laplacian_and_sobel(stack):
    lap = {(-1, 0): 1, (1, 0): 1, (0, -1): 1, (0, 1): 1, (0, 0): -4}
    gx = {(dy, dx): dx * (2 - abs(dy)) for dy in (-1, 0, 1) for dx in (-1, 0, 1)}
    gy = {(dx, dy): wt for (dy, dx), wt in gx.items()}
    for a, l, s in zip(stack, kn.laplacian(stack), kn.sobel(stack)):
        assert l == pytest.approx(neighbour_sum(a, lap, "mirror"))
        assert s == pytest.approx(np.hypot(neighbour_sum(a, gx, "mirror"), neighbour_sum(a, gy, "mirror")))


@pytest.mark.parametrize("border", ["mirror", "reflect"])
def test_box(stack, border):
    weights = {(dy, dx): 1 / 25 for dy in range(-2, 3) for dx in range(-2, 3)}
    assert kn.box(stack, 5, border)[1] == pytest.approx(neighbour_sum(stack[1], weights, border))


def test_gaussian_keeps_constants_and_reaches_past_small_images():
    assert kn.gaussian(np.full((1, 3, 3), 4.0)) == pytest.approx(np.full((1, 3, 3), 4.0))


def rows(spark, images, **extra):
    data = [(i, a.shape[0], a.shape[1], a.ravel().tolist()) for i, a in enumerate(images)]
    df = spark.createDataFrame(data, "vec_id long, h int, w int, px array<double>")
    return df.withColumns({k: F.lit(v) for k, v in extra.items()})


def test_mixed_sizes_keep_their_rows(spark):
    rng = np.random.default_rng(1)
    images = [rng.integers(0, 256, (4 + i % 3, 5 + i % 2)).astype(float) for i in range(40)]
    out = ra.neighbour_measures(rows(spark, images).repartition(3)).toPandas().set_index("vec_id")
    for i, a in enumerate(images):
        assert out.loc[i, "laplacian_variance"] == pytest.approx(kn.laplacian(a[None])[0].var())
        assert out.loc[i, "edge_mean"] == pytest.approx(kn.sobel(a[None])[0].mean())
        assert 0 <= out.loc[i, "noise_level"] <= 1
    assert "px" not in out.columns      # pixels stay in the task


def test_colour_and_level_measures(spark):
    rng = np.random.default_rng(2)
    r, g, b = rng.integers(0, 256, (3, 6, 4)).astype(float)
    df = spark.createDataFrame([(1, 6, 4, *[x.ravel().tolist() for x in (r, g, b)]), (2, 6, 4, None, [0.0] * 24, [0.0] * 24)],
                               "vec_id long, h int, w int, r array<double>, g array<double>, b array<double>")
    got = {x["vec_id"]: x for x in ra.colour_measures(df).collect()}
    level = np.floor(0.299 * r + 0.587 * g + 0.114 * b + 0.5)
    assert got[1]["r_mean"] == pytest.approx(r.mean()) and got[1]["b_range"] == b.max() - b.min() and got[2]["r_mean"] is None
    assert got[1]["blue_coverage"] == pytest.approx(((b > r) & (b > g))[2:].mean())
    assert got[1]["dark_coverage"] == pytest.approx((level[2:] < 128).mean()) and got[1]["grey_mean"] == pytest.approx(level.mean())
    low = ra.level_measures(rows(spark, [level])).first()
    assert low["brightness"] == pytest.approx(level.mean()) and low["laplacian_variance"] == pytest.approx(kn.laplacian(level[None])[0].var())


def test_wave_measures_of_a_sine(spark):
    x = np.arange(64)
    a = np.tile(0.5 + 0.4 * np.sin(2 * np.pi * x / 16), (32, 1))
    got = ra.wave_characteristics(rows(spark, [a])).first()
    assert got["wavelength"] == 16 and got["wave_count"] == 4 and 0 <= got["foam"] <= 0.15
    q1, q3 = np.percentile(a, [25, 75])
    kept = a[(a >= q1 - 1.5 * (q3 - q1)) & (a <= q3 + 1.5 * (q3 - q1))]
    assert got["iqr_range"] == pytest.approx(kept.max() - kept.min())


def test_rule_labels_stay_in_their_domains(spark):
    rng = np.random.default_rng(2)
    maps = [np.clip(rng.uniform(0, 1, (20, 20)), 0, 1), np.full((20, 20), 0.5), np.tile(np.linspace(0, 1, 20), (20, 1))]
    got = ra.rule_labels(ra.wave_characteristics(rows(spark, maps)), F.lit(0.2)).orderBy("vec_id").collect()
    assert [r["direction"] for r in got[1:]] == ["STRAIGHT", "RIGHT"]
    assert got[1]["height_meters"] == 0.5 and got[1]["breaking_type"] == "SURGING"
    assert all(0.5 <= r["height_meters"] <= 8 and 0 < r["height_confidence"] <= 1 for r in got)


def test_depth_quality_of_flat_and_varied_maps(spark):
    rng = np.random.default_rng(3)
    got = ra.depth_quality(rows(spark, [np.full((12, 12), 0.4), rng.uniform(0, 1, (12, 12))])).orderBy("vec_id").collect()
    assert got[0]["quality_score"] == pytest.approx(0, abs=1e-12) and got[0]["validity"] == 0.5 and got[1]["validity"] == 1.0
    assert got[1]["overall"] > got[0]["overall"] and all(0 <= r["overall"] <= 1 for r in got)


def test_normalise_and_corrupt(spark):
    df = spark.createDataFrame([([1.0, 3.0, 2.0],), ([2.0, 2.0],)], "px array<double>")
    assert [r[0] for r in df.select(ra.normalise(F.col("px"))).collect()] == [[0.0, 1.0, 0.5], [0.0, 0.0]]
    bad = spark.createDataFrame([([float("nan"), 0.0],), ([0.5, 1.05],), ([-0.2],), ([],), (None,), ([float("inf")],)], "px array<double>")
    assert [r[0] for r in bad.select(ra.is_corrupt(F.col("px"))).collect()] == [True, False, True, True, True, True]


def test_hsv_of_primary_colours():
    planes = [np.array([[x]], float) for x in ([255.0, 0.0, 0.0, 128.0], [0.0, 255.0, 0.0, 128.0], [0.0, 0.0, 255.0, 128.0])]
    h, s, v = ra.hsv(*planes)
    assert list(zip(h.ravel(), s.ravel(), v.ravel())) == [(0, 255, 255), (60, 255, 255), (120, 255, 255), (0, 0, 128)]


def test_equalise(spark):
    a = np.array([[0, 0, 50, 50], [100, 100, 200, 200]], float)
    got = ra.equalise(rows(spark, [a, np.full((2, 2), 7.0)])).orderBy("vec_id").collect()
    assert np.array(got[0]["px"]) * 255 == pytest.approx([0, 0, 85, 85, 170, 170, 255, 255])
    assert np.array(got[1]["px"]) * 255 == pytest.approx([7] * 4)


def test_variants_fall_back_to_the_original(spark):
    rng = np.random.default_rng(4)
    got = ra.augment_variants(rows(spark, [rng.uniform(0, 1, (8, 8))])).toPandas()
    assert set(got["variant"]) == {"fog", "glare", "lighting"}
    for _, r in got.iterrows():
        assert r["preserved"] or list(r["result"]) == list(r["px"])
        assert 0 <= min(r["result"]) and max(r["result"]) <= 1
