"""Calibration fits against plain versions, on one machine and without sums."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from tidemark.operators import calibrators as C


def pava(x, y, w):
    """(lower, upper, value, weight) of the pooled blocks."""
    blocks = []
    for a, t, n in sorted(zip(x, y, w)):
        blocks.append([a, a, t * n, n])
        while len(blocks) > 1 and blocks[-2][2] / blocks[-2][3] >= blocks[-1][2] / blocks[-1][3]:
            _, b, t, n = blocks.pop()
            blocks[-1] = [blocks[-1][0], b, blocks[-1][2] + t, blocks[-1][3] + n]
    return [(a, b, t / n, n) for a, b, t, n in blocks]


def frame(spark, groups):
    rows = [(g, float(c), float(y)) for g, (cs, ys) in groups.items() for c, y in zip(cs, ys)]
    return spark.createDataFrame(rows, "task string, confidence double, correct double")


def draws(seed, n, digits=None):
    rng = np.random.default_rng(seed)
    c = rng.uniform(0, 1, n)
    c = np.round(c, digits) if digits else c
    return c, (rng.uniform(size=n) < c ** 2).astype(float)


def same_blocks(got, want):
    assert len(got) == len(want)
    assert np.allclose(np.array(sorted(got)), np.array(sorted(want)))


def brute_blocks(cs, ys):
    p = pd.DataFrame({"c": cs, "y": ys}).groupby("c")["y"].agg(["mean", "count"])
    return pava(p.index, p["mean"], p["count"])


@pytest.mark.parametrize("chunk", [5, 64, 1 << 16])
def test_isotonic_blocks_do_not_depend_on_chunks(spark, chunk):
    groups = {"a": draws(1, 400), "b": draws(2, 300, 2), None: draws(3, 50),
              "falling": (np.arange(60) / 60, 1 - np.arange(60) / 60), "rising": (np.arange(60) / 60, np.arange(60) / 60), "flat": ([0.5] * 9, [1] * 9)}
    got = C.fit_isotonic(frame(spark, groups), ["task"], chunk_rows=chunk).collect()
    for g, (cs, ys) in groups.items():
        same_blocks([(r.lower, r.upper, r.value, r.weight) for r in got if r.task == g], brute_blocks(cs, ys))


def test_isotonic_of_a_million_points_in_one_group(spark):
    x = F.col("id") / 1_000_000
    rows = spark.range(1_000_000).select(F.lit("hot").alias("task"), x.alias("confidence"),
                                         (F.pmod(F.xxhash64("id"), F.lit(1000)) < 1000 * x).cast("double").alias("correct"))
    got = [tuple(r) for r in C.fit_isotonic(rows, ["task"]).select("lower", "upper", "value", "weight").collect()]
    data = rows.toPandas()
    same_blocks(got, pava(data["confidence"], data["correct"], np.ones(len(data))))


def test_values_between_blocks_lie_on_lines(spark):
    groups = {"a": draws(4, 500), "b": draws(5, 20)}
    blocks = C.fit_isotonic(frame(spark, groups), ["task"])
    asked = frame(spark, {g: (np.linspace(-0.2, 1.2, 97), np.zeros(97)) for g in ("a", "b", "unknown")})
    got = C.isotonic(asked.unionByName(asked.limit(5)), blocks, ["task"])
    assert got.count() == 3 * 97 + 5
    for g, (cs, ys) in groups.items():
        want = brute_blocks(cs, ys)
        knots = [k for b in want for k in ((b[0], b[2]), (b[1], b[2]))]
        for r in got.filter(F.col("task") == g).collect():
            assert r.calibrated == pytest.approx(np.interp(r.confidence, *zip(*knots)))
    assert got.filter("task = 'unknown' and calibrated != confidence").count() == 0


def test_isotonic_without_groups_and_with_missing_confidences(spark):
    rows = spark.createDataFrame([(0.1, 0.0), (0.5, 1.0), (None, 1.0), (0.9, None)], "confidence double, correct double")
    blocks = C.fit_isotonic(rows, [])
    assert [(r.confidence, r.calibrated) for r in C.isotonic(rows, blocks, []).orderBy("confidence").collect()] == [(None, None), (0.1, 0.0), (0.5, 1.0), (0.9, 1.0)]


@pytest.mark.parametrize("seed", range(3))
def test_logistic_fit_is_the_minimum(spark, seed):
    groups = {"a": draws(seed, 300), "b": (np.full(40, 0.8), np.r_[np.ones(30), np.zeros(10)]), None: draws(seed + 9, 60)}
    got = {r.task: (r.slope, r.intercept) for r in C.fit_logistic(frame(spark, groups), ["task"]).collect()}

    def loss(w, cs, ys):
        z = w[0] * np.asarray(cs) + w[1]
        return 0.5 * w[0] ** 2 + (np.logaddexp(0, z) - np.asarray(ys) * z).sum()

    for g, (cs, ys) in groups.items():
        here = loss(got[g], cs, ys)
        for step in ((1e-3, 0), (-1e-3, 0), (0, 1e-3), (0, -1e-3), (1e-3, -1e-3)):
            assert loss(np.add(got[g], step), cs, ys) > here


def test_logistic_fit_of_one_outcome_ends(spark):
    rows = C.fit_logistic(frame(spark, {"a": ([0.2, 0.7, 0.9], [1, 1, 1])}), ["task"]).collect()
    assert len(rows) == 1 and 1 / (1 + np.exp(-rows[0].intercept)) > 0.999


@pytest.mark.parametrize("truth", [0.4, 1.0, 3.0])
def test_temperature_is_the_minimum(spark, truth):
    rng = np.random.default_rng(int(truth * 10))
    z = rng.normal(size=(1500, 4)) * 2
    p = np.exp(z / truth)
    y = (p.cumsum(1) / p.sum(1, keepdims=True) > rng.uniform(size=(1500, 1))).argmax(1)
    rows = spark.createDataFrame([(i % 2, a.tolist(), int(b)) for i, (a, b) in enumerate(zip(z, y))], "g int, z array<double>, y int")

    def loss(t, keep):
        s = z[keep] / t
        return (np.log(np.exp(s).sum(1)) - s[np.arange(len(s)), y[keep]]).mean()

    for r in C.fit_temperature(rows, "z", "y", ["g"]).collect():
        keep = np.arange(1500) % 2 == r.g
        assert r.temperature == pytest.approx(truth, rel=0.2)
        assert loss(r.temperature, keep) < min(loss(r.temperature * 1.001, keep), loss(r.temperature * 0.999, keep))
    assert C.fit_temperature(rows, "z", "y").count() == 1


def test_temperature_stays_in_its_bounds(spark):
    sure = spark.createDataFrame([([1.0, 0.0], 0)] * 3, "z array<double>, y int")
    wrong = spark.createDataFrame([([1.0, 0.0], 1)] * 3, "z array<double>, y int")
    assert C.fit_temperature(sure, "z", "y").first()[0] == pytest.approx(C.COLDEST, rel=1e-3)
    assert C.fit_temperature(wrong, "z", "y").first()[0] == pytest.approx(C.HOTTEST, rel=1e-3)


@pytest.mark.parametrize("method", ["platt", "isotonic"])
def test_stages_are_saved_and_read_again(spark, tmp_path, method):
    data = frame(spark, {"a": draws(6, 200, 2), "b": draws(7, 200, 2), "few": draws(8, 10, 2)}).withColumnRenamed("confidence", "conf").withColumnRenamed("task", "model")
    stage = C.Calibrator(method=method, groupCols=["model"], confidenceCol="conf", outputCol="sure")
    Pipeline(stages=[stage]).save(str(tmp_path / "plan"))
    fitted = Pipeline.load(str(tmp_path / "plan")).fit(data)
    fitted.save(str(tmp_path / "fitted"))
    read = PipelineModel.load(str(tmp_path / "fitted"))
    first, second = (sorted(map(tuple, m.transform(data).collect()), key=str) for m in (fitted, read))
    assert first == second and len(first) == 410
    out = read.transform(data)
    assert out.columns == [*data.columns, "sure"]
    assert out.filter("model = 'few' and sure != conf").count() == 0 and out.filter("model = 'a' and sure != conf").count() > 100


def test_unknown_methods_are_refused():
    with pytest.raises(ValueError):
        C.Calibrator(method="guess")
