"""Isolation forests against a walk of one tree after the other, and on planted rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import forest as I


def walk(forest, row):
    total = 0.0
    for node in forest.roots:
        while forest.feature[node] >= 0:
            node = forest.left[node] + int(row[forest.feature[node]] > forest.cut[node])
        total += forest.length[node]
    return 2.0 ** (-total / len(forest.roots) / I.unsuccessful(forest.sample))


def test_scores_equal_a_plain_walk():
    rows = np.random.default_rng(1).normal(size=(900, 3))
    grown = I.grow(rows, trees=20, sample=64)
    assert np.allclose(grown.scores(rows[:200]), [walk(grown, r) for r in rows[:200]])
    assert (grown.scores(rows) > 0).all() and (grown.scores(rows) < 1).all()


def test_trees_hold_their_sample():
    """Every leaf is a part of its parent, and the far row is alone after few cuts."""
    rows = np.r_[np.random.default_rng(2).uniform(size=(255, 2)), [[50.0, 50.0]]]
    grown = I.grow(rows, trees=10, sample=256)
    assert grown.depths(rows[-1:])[0] < 3 < grown.depths(rows[:1])[0]


def test_small_and_constant_samples():
    for rows in (np.zeros((0, 2)), np.zeros((1, 2)), np.ones((50, 2))):
        scores = I.grow(rows, trees=3).scores(np.ones((4, 2)))
        assert len(scores) == 4 and np.isfinite(scores).all()


def frame(spark, n=4000):
    h = F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000
    g = F.pmod(F.xxhash64("id", F.lit(7)), F.lit(1000)) / 1000
    odd = F.col("id") % 500 == 0
    return spark.range(n).select("id", F.when(odd, 9.0).otherwise(1 + h).alias("height"), F.when(odd, 0.01).otherwise(0.6 + 0.4 * g).alias("conf"),
                                 (0.5 + 0.1 * h).alias("calm"))


def test_planted_rows_stand_out_in_their_group(spark):
    out = I.anomalies(frame(spark), {"a": ["height", "conf"], "b": ["calm"]}, contamination=0.05).toPandas()
    top = set(out.nlargest(8, "a_anomaly")["id"])
    assert top == set(range(0, 4000, 500))
    assert (out["a_anomaly"] > 0).mean() == pytest.approx(0.05, abs=0.02)
    assert set(out.nlargest(8, "b_anomaly")["id"]) != top


def test_scores_do_not_depend_on_the_partitioning(spark):
    rows = frame(spark, 1500)
    first, second = ([tuple(r) for r in I.with_scores(x, {"a": ["height", "conf"]}).orderBy("id").collect()] for x in (rows, rows.repartition(7)))
    assert first == second
    assert I.with_scores(rows.limit(0), {"a": ["height"]}).count() == 0
    missing = rows.withColumn("height", F.lit(None).cast("double"))
    assert I.with_scores(missing, {"a": ["height"]}).filter("a_score is null or isnan(a_score)").count() == 0


def test_rows_go_down_filled_trees_as_they_walk():
    """Filled trees give the walk's scores bit by bit, also for values without order, on cuts, and beyond all of them."""
    rows = np.random.default_rng(5).normal(size=(700, 3))
    grown = I.grow(rows, trees=15, sample=128)
    features, numbers, lengths = grown.filled[1:]
    assert features.shape == numbers.shape == lengths.shape and lengths.shape[1] <= 256
    asked = np.r_[rows[:60], [[np.nan, 0.0, 0.0], [np.inf, -np.inf, np.nan], [0.0, np.nan, np.inf]], np.repeat(grown.cut[grown.feature >= 0][:40, None], 3, axis=1)]
    plain = []
    for row in asked:
        total = 0.0
        for node in grown.roots:
            while grown.feature[node] >= 0:
                node = grown.left[node] + int(row[grown.feature[node]] > grown.cut[node])
            total += grown.length[node]
        plain.append(total / len(grown.roots))
    assert grown.depths(asked).tolist() == plain


def test_only_the_named_columns_pass_through(spark):
    rows = frame(spark, 600)
    groups = {"a": ["height", "conf"]}
    whole = I.anomalies(rows, groups)
    some = I.anomalies(rows, groups, keep=["id"])
    assert some.columns == ["id", "a_anomaly", "overall_anomaly", "is_anomalous"]
    assert sorted(map(tuple, some.collect())) == sorted(map(tuple, whole.select(some.columns).collect()))


@pytest.mark.parametrize("width, sample", [(1, 256), (2, 64), (3, 256), (4, 5), (2, 1024)])
def test_tables_and_walk_give_the_same_depths(monkeypatch, width, sample):
    rows = np.round(np.random.default_rng(width).normal(size=(1200, width)), 1)
    asked = np.r_[rows[:300], np.full((1, width), np.nan), np.full((1, width), np.inf)]
    with_tables = I.grow(rows, trees=6, sample=sample)
    assert (with_tables.tables is None) == (sample > 256)
    monkeypatch.setattr(I, "_CELLS", 0)
    walked = I.grow(rows, trees=6, sample=sample)
    assert walked.tables is None and with_tables.depths(asked).tolist() == walked.depths(asked).tolist()
