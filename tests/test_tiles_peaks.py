"""Tiles of large images against whole images; regions against a flood fill; stored sketches against exact curves."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import drift, peaks, sketches, tiles
from tidemark.operators import raster as ra


def grey(seed, h, w):
    return np.random.default_rng(seed).integers(0, 256, (h, w)).astype(np.uint8)


@pytest.mark.parametrize("side", [3, 7, 64])
def test_tiles_give_the_numbers_of_the_whole_image(spark, side):
    images = {"a": grey(1, 20, 31), "b": grey(2, 7, 7), "c": np.full((9, 4), 200, np.uint8), "d": grey(3, 2, 2)}
    rows = [(k, *v.shape, bytearray(v.tobytes())) for k, v in images.items()] + [("gone", 5, 5, None), ("short", 5, 5, bytearray(b"abc")), ("line", 1, 3, bytearray(b"abc"))]
    got = {r["id"]: r for r in tiles.tiled_measures(spark.createDataFrame(rows, "id string, h int, w int, data binary"), "id", side=side).collect()}
    whole = ra.level_measures(spark.createDataFrame([(k, *v.shape, v.astype(float).ravel().tolist()) for k, v in images.items()], "id string, h int, w int, px array<double>"))
    for r in whole.collect():
        found = got[r["id"]]
        h, w = images[r["id"]].shape
        assert found["tiles"] == -(-h // side) * -(-w // side)
        for name in ("brightness", "brightness_std", "laplacian_variance", "edge_mean", "edge_max", "noise_level", "laplacian_noise"):
            assert found[name] == pytest.approx(r[name], rel=1e-9, abs=1e-6), (r["id"], name)
    for broken in ("gone", "short", "line"):
        assert got[broken]["tiles"] == 0 and got[broken]["brightness"] is None and got[broken]["noise_level"] is None


def test_one_large_image_spreads_over_tasks(spark):
    image = grey(4, 4000, 5000)
    df = spark.createDataFrame([("big", 4000, 5000, bytearray(image.tobytes()))], "id string, h int, w int, data binary")
    dealt = tiles.cut_tiles(df, side=500).repartition(8, "id", "ty", "tx").groupBy(F.spark_partition_id()).count().collect()
    assert len(dealt) == 8 and max(r["count"] for r in dealt) <= 25
    row = tiles.tiled_measures(df, "id", side=500, spread=8).first()
    assert row["tiles"] == 80 and row["brightness"] == pytest.approx(image.mean()) and row["brightness_std"] == pytest.approx(image.std())


def flooded(mask):
    """(area, y, x) of each region, by a plain flood fill."""
    todo, found = {tuple(p) for p in np.argwhere(mask)}, []
    while todo:
        seen, open_ = [], [min(todo)]
        todo.discard(open_[0])
        while open_:
            y, x = open_.pop()
            seen.append((y, x))
            for q in [(y + a, x + b) for a in (-1, 0, 1) for b in (-1, 0, 1)]:
                if q in todo:
                    todo.discard(q)
                    open_.append(q)
        found.append((len(seen), *np.mean(seen, axis=0)))
    return found


def spiral(n):
    m, y, x, dy, dx = np.zeros((n, n), bool), 0, 0, 0, 1
    for length in [n - 1] + [k for k in range(n - 1, 0, -2) for _ in (0, 1)]:
        for _ in range(length):
            m[y, x] = True
            y, x = y + dy, x + dx
        dy, dx = dx, -dy
    return m


@pytest.mark.parametrize("share", [0.0, 0.1, 0.35, 0.6, 1.0])
def test_regions_are_those_of_a_flood_fill(share):
    masks = np.random.default_rng(7).random((6, 17, 23)) < share
    of, area, y, x = peaks.regions(masks)
    for i in range(6):
        want = flooded(masks[i])
        got = [t for t, k in zip(zip(area, y, x), of) if k == i]
        assert [g[0] for g in got] == [v[0] for v in want]
        assert np.allclose(np.array(got).reshape(-1, 3), np.array(want).reshape(-1, 3))


def test_a_spiral_is_one_region():
    m = spiral(41)
    assert peaks.regions(m[None])[1].tolist() == [m.sum()] == [flooded(m)[0][0]]


def test_top_hat_is_the_value_less_its_opening():
    a, r = grey(5, 12, 9).astype(float), 3
    element = [(dy, dx) for dy, half in zip(range(-r, r + 1), peaks.ellipse(7)) for dx in range(-half, half + 1)]

    def extreme(b, pick):
        return np.array([[pick(b[y + dy, x + dx] for dy, dx in element if 0 <= y + dy < 12 and 0 <= x + dx < 9) for x in range(9)] for y in range(12)])
    assert np.array_equal(peaks.top_hat(a[None], 7)[0], a - extreme(extreme(a, min), max))
    assert peaks.ellipse(3) == [0, 1, 0]


def test_planted_crests_are_found_at_their_places(spark):
    y, x = np.mgrid[:120, :160]
    a = sum(0.8 * np.exp(-((y - cy) ** 2 + (x - cx) ** 2) / 8.0) for cy, cx in ((30, 40), (30, 120), (90, 80)))
    rows = [("waves", 120, 160, a.ravel().tolist()), ("flat", 120, 160, [0.4] * 19200), ("broken", 120, 160, [0.1])]
    got = {r["id"]: r for r in peaks.wave_peaks(spark.createDataFrame(rows, "id string, h int, w int, px array<double>")).collect()}
    assert got["waves"]["peak_count"] == 3
    assert [(round(p["y"]), round(p["x"])) for p in got["waves"]["peaks"]] == [(30, 40), (30, 120), (90, 80)]
    assert all(p["area"] > peaks.LEAST_AREA for p in got["waves"]["peaks"])
    assert got["flat"]["peak_count"] == 0 and got["flat"]["peaks"] == [] and got["broken"]["peaks"] is None


def test_stored_sketches_keep_within_their_bound(spark):
    rows = spark.range(200_000).select(
        (F.col("id") % 20).alias("d"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 2)).alias("feature"),
        (F.xxhash64("id") % 10_000 / 100.0 + F.when(F.col("id") % 20 >= 10, F.col("id") % 7).otherwise(0)).alias("value"), (F.col("id") % 4321).alias("user"))
    table = sketches.daily_sketches(rows, F.col("d"), ["feature"], "value", "user")
    assert table.count() == 40  # a day's ids are all odd or all even
    sides = [sketches.merged(table.filter(c), ["feature"]) for c in ("day < 10", "day >= 10")]
    got = {r["feature"]: r for r in sketches.sketch_distances(*sides, ["feature"]).collect()}
    long = rows.select(F.when(F.col("d") < 10, "old").otherwise("new").alias("dataset"), "feature", "value")
    bound = 2 * sketches.rank_error() + 1 / sketches.GRID
    for r in drift.rank_distances(long, "old", "new").collect():
        assert (got[r["feature"]]["n1"], got[r["feature"]]["n2"]) == (r["n1"], r["n2"])
        assert abs(got[r["feature"]]["ks"] - r["ks"]) <= bound
        assert abs(got[r["feature"]]["wasserstein"] - r["wasserstein"]) <= bound * 206
    for r in sketches.quantiles(sides[0], ["feature"], {"q50": 0.5}).join(rows.filter("d < 10").groupBy("feature").agg(
            F.countDistinct("user").alias("users"), F.min("value").alias("least")), "feature").collect():
        assert abs(r["distinct"] - r["users"]) <= 3 * 1.04 / 2 ** (sketches.DISTINCT_LG / 2) * r["users"] and r["low"] == r["least"]


def test_sketches_leave_out_what_is_no_number(spark):
    rows = spark.createDataFrame([(1, "a", 1.0), (1, "a", None), (1, "a", float("nan")), (2, "a", 3.0), (2, "b", None)], "d int, feature string, value double")
    table = sketches.daily_sketches(rows, F.col("d"), ["feature"], "value")
    assert {(r["day"], r["feature"]): r["n"] for r in table.collect()} == {(1, "a"): 1, (2, "a"): 1, (2, "b"): 0}
    merged = sketches.merged(table, ["feature"])
    assert [(r["feature"], r["n"], r["low"], r["high"]) for r in merged.collect()] == [("a", 2, 1.0, 3.0)]
    assert sketches.merged(table.filter("false"), ["feature"]).count() == 0
