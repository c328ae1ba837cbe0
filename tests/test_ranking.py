"""Chunked ranking against brute force, with a key that holds most rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import ranking as rk


def skewed(spark, n=3000, seed=1):
    """80 % of the rows in key ``a``, a null key, many equal values."""
    rng = np.random.default_rng(seed)
    keys = rng.choice(["a", "b", "c", None], n, p=[0.8, 0.1, 0.05, 0.05])
    pdf = pd.DataFrame({"k": keys, "at": rng.integers(0, 400, n).astype(float), "id": np.arange(n),
                        "v": np.round(rng.normal(size=n), 1)})
    return pdf, spark.createDataFrame(pdf, "k string, at double, id bigint, v double")


def groups(pdf):
    return {("none" if k is np.nan or k is None or k != k else k): g for k, g in pdf.groupby("k", dropna=False)}


def test_hot_keys_are_cut_and_cold_ones_are_not(spark):
    _, df = skewed(spark)
    chunks = {r["k"]: r["n"] for r in rk.with_chunks(df, ["k"], "at").groupBy("k")
              .agg(F.countDistinct(rk.CHUNK).alias("n")).collect()}
    assert chunks["a"] > 4
    few = spark.range(1000).select(F.col("id").alias("k"), F.rand(1).alias("at"))
    assert rk._single(rk.with_chunks(few, ["k"], "at"))


@pytest.mark.parametrize("bounded", [True, False])
def test_percentiles(spark, bounded):
    pdf, df = skewed(spark)
    points = {"p0": 0.0, "p25": 0.25, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    got = {r["k"] or "none": r for r in rk.exact_percentiles(df, ["k"], "v", points, bounded_keys=bounded).collect()}
    assert set(got) == set(groups(pdf))
    for k, g in groups(pdf).items():
        for name, p in points.items():
            assert got[k][name] == pytest.approx(np.percentile(g["v"], 100 * p), abs=1e-12)


def test_percentile_without_keys_and_with_one_value(spark):
    pdf, df = skewed(spark)
    assert rk.exact_percentiles(df, [], "v", {"m": 0.5}).first()["m"] == pytest.approx(pdf["v"].median())
    same = spark.range(50).select(F.lit(2.5).alias("v"))
    assert rk.exact_percentiles(same, [], "v", {"m": 0.95}).first()["m"] == 2.5


def test_order_statistic(spark):
    pdf, df = skewed(spark)
    got = {r["k"] or "none": r["x"] for r in rk.order_statistic(df, ["k"], "v", lambda n: F.floor(n * 0.95), "x").collect()}
    for k, g in groups(pdf).items():
        assert got[k] == sorted(g["v"])[int(len(g) * 0.95)]


@pytest.mark.parametrize("hot", [True, False])
def test_running_and_rolling(spark, hot):
    pdf, df = skewed(spark)
    if not hot:     # spread over many keys, so that no key is cut
        pdf["k"] = (pdf["id"] % 500).astype(str)
        df = spark.createDataFrame(pdf, "k string, at double, id bigint, v double")
    order = ["at", "id"]
    run = rk.running(df.withColumn("one", F.lit(1)), ["k"], order, sums={"pos": "one"}, mins={"lo": "v"}, maxs={"hi": "v"},
                     next_of={"nxt": "at"}).toPandas().set_index("id")
    excl = rk.running(df, ["k"], order, mins={"before": "v"}, exclusive=True).toPandas().set_index("id")
    roll = rk.rolling(df, ["k"], order, 9, {"m": lambda w: F.avg("v").over(w.rowsBetween(-9, 0)),
                                             "prev": lambda w: F.lag("at").over(w)}).toPandas().set_index("id")
    assert len(run) == len(roll) == len(pdf)
    for _, g in pdf.groupby("k", dropna=False):
        g = g.sort_values(order).set_index("id")
        ids = g.index
        assert run.loc[ids, "pos"].tolist() == list(range(1, len(g) + 1))
        assert (run.loc[ids, "pos_total"] == len(g)).all()
        assert run.loc[ids, "lo"].tolist() == g["v"].cummin().tolist()
        assert run.loc[ids, "hi"].tolist() == g["v"].cummax().tolist()
        assert run.loc[ids, "nxt"].tolist()[:-1] == g["at"].tolist()[1:] and np.isnan(run.loc[ids, "nxt"].iloc[-1])
        assert np.array_equal(excl.loc[ids, "before"].to_numpy(float), g["v"].cummin().shift().to_numpy(), equal_nan=True)
        assert roll.loc[ids, "m"].to_numpy() == pytest.approx(g["v"].rolling(10, min_periods=1).mean().to_numpy(), abs=1e-9)
        assert np.array_equal(roll.loc[ids, "prev"].to_numpy(float), g["at"].shift().to_numpy(), equal_nan=True)


def test_one_value_filling_most_of_a_hot_key_is_cut_along_the_second_column(spark):
    rng = np.random.default_rng(5)
    at = np.where(rng.uniform(size=4000) < 0.7, 100.0, rng.integers(0, 200, 4000).astype(float))
    pdf = pd.DataFrame({"k": "a", "at": at, "id": rng.permutation(4000)})
    df = spark.createDataFrame(pdf).withColumn("one", F.lit(1))
    sizes = rk.with_chunks(df, ["k"], "at", then="id").filter("at = 100").groupBy(rk.CHUNK).count().toPandas()["count"]
    assert sizes.max() < 0.3 * sizes.sum()
    got = rk.running(df, ["k"], ["at", "id"], sums={"pos": "one"}).toPandas().sort_values(["at", "id"])
    assert got["pos"].tolist() == list(range(1, 4001))
    back = rk.rolling(df, ["k"], ["at", "id"], 3, {"prev": lambda w: F.lag("id", 3).over(w)}).toPandas().sort_values(["at", "id"])
    assert back["prev"].tolist()[3:] == back["id"].tolist()[:-3]


def test_asof_join(spark):
    left, ldf = skewed(spark, 600, 2)
    right, rdf = skewed(spark, 200, 3)
    got = rk.asof_join(ldf, rdf, "k", "at", ["id"], tie="id").toPandas().set_index("id")
    for _, row in left.iterrows():
        same = right[(right["k"] == row["k"]) | (right["k"].isna() & (row["k"] is None))]
        same = same[same["at"] <= row["at"]].sort_values(["at", "id"])
        hit = got.loc[row["id"], "matched_id"]
        assert (np.isnan(hit) and same.empty) or hit == same["id"].iloc[-1]


def test_small_results_are_pinned_in_the_named_folder(spark):
    import os

    from tidemark.sources.tables import pin, shared_dir
    folder = shared_dir(spark)
    assert folder == spark.conf.get("spark.checkpoint.dir")
    before = sum(len(f) for _, _, f in os.walk(folder))
    assert pin(spark.range(3)).count() == 3
    assert sum(len(f) for _, _, f in os.walk(folder)) > before


def test_first_per_key_cuts_before_the_shuffle(spark):
    _, df = skewed(spark)
    plan = rk.first_per_key(df, ["k"], [F.col("at"), F.col("id")], 3)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_chunks_stay_near_the_partition_count(spark):
    """300 warm keys do not multiply the chunks; one hot key gets its share of them."""
    df = spark.range(60_000).select((F.col("id") % 300).alias("k"), F.col("id").alias("v"))
    chunks = rk.with_chunks(df, ["k"], "v", chunks=16, bounded_keys=True).select("k", "_chunk").distinct().count()
    assert chunks <= 2 * 300
    hot = spark.range(60_000).select(F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id")).alias("k"), F.col("id").alias("v"))
    per = rk.with_chunks(hot, ["k"], "v", chunks=64).filter("k = 0").groupBy("_chunk").count().collect()
    assert 20 <= len(per) <= 64 and max(r["count"] for r in per) < 3_000


def test_results_do_not_hang_on_exchange_reuse(spark):
    df = spark.range(20_000).select((F.col("id") % 2).alias("k"), F.xxhash64("id").alias("v"))
    points = {"q": 0.37}
    with_reuse = rk.exact_percentiles(df, ["k"], "v", points, bounded_keys=True).orderBy("k").collect()
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        assert rk.exact_percentiles(df, ["k"], "v", points, bounded_keys=True).orderBy("k").collect() == with_reuse
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")


def test_a_long_list_of_keys_is_refused(spark, monkeypatch):
    monkeypatch.setattr(rk, "MOST_KEYS", 5)
    with pytest.raises(ValueError, match="more than 5 keys"):
        rk.with_chunks(spark.range(100).select("id", F.col("id").alias("v")), ["id"], "v", bounded_keys=True)
