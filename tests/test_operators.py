"""Operators against hand-computed values and brute force."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import scalars as sc
from tidemark.operators import bands, calibration, drift, evaluation, gates, joins, labels, lineage, predictions, profiling, rules
from tidemark.operators import telemetry as tm
from tidemark.operators.ranking import hot_groups
from tidemark.sources.tables import literal_table


def one(df):
    return df.first().asDict()


# --- evaluation ------------------------------------------------------------------------------------
@pytest.mark.parametrize("seed", range(3))
def test_regression_invariants(spark, seed):
    rng = np.random.default_rng(seed)
    t, p = rng.uniform(0.1, 10, 80), rng.uniform(0.1, 10, 80)
    got = one(evaluation.regression_metrics(spark.createDataFrame(pd.DataFrame({"h_true": t, "h_pred": p}))))
    e = np.abs(t - p)
    assert got["mae"] == pytest.approx(e.mean()) and got["rmse"] == pytest.approx(math.sqrt((e ** 2).mean()))
    assert got["r2"] == pytest.approx(1 - (e ** 2).sum() / ((t - t.mean()) ** 2).sum())
    assert got["median_abs_error"] == pytest.approx(np.median(e)) and got["p95_abs_error"] == pytest.approx(np.percentile(e, 95))
    assert got["rmse"] >= got["mae"] >= 0 and got["within_05_pct"] >= got["within_02_pct"]


def test_extreme_detection_is_100_without_extremes(spark):
    df = spark.createDataFrame([(1.0, 1.1), (2.0, 2.5)], "h_true double, h_pred double")
    assert one(evaluation.regression_metrics(df))["extreme_detection_pct"] == 100.0


def test_absent_class_has_zero_scores(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1)], "t int, p int")
    rows = {r["class"]: r for r in evaluation.classification_metrics(df, [0, 1, 2], truth="t", pred="p").collect()}
    assert (rows[2]["precision"], rows[2]["recall"], rows[2]["f1"], rows[2]["support"]) == (0, 0, 0, 0)
    assert rows[0]["recall"] == 0.5 and rows[0]["precision"] == 1.0
    assert rows[0]["macro_f1"] == pytest.approx((2 / 3 + 2 / 3 + 0) / 3)
    cells = {(r["target"], r["predicted"]): r["n"] for r in evaluation.confusion_matrix(df, [0, 1, 2], truth="t", pred="p").collect()}
    assert len(cells) == 9 and cells[(2, 2)] == 0 and cells[(0, 1)] == 1


def test_ensemble_breaks_ties_to_the_smaller_label(spark):
    df = spark.createDataFrame([(1, 2, 1.0), (1, 0, 2.0), (2, 1, 3.0), (2, 1, 5.0), (2, 0, 4.0)], "item int, d int, h double")
    got = {r["item"]: r for r in evaluation.ensemble(df, "item", ["d"], {"height": "h"}).collect()}
    assert got[1]["d"] == 0 and got[2]["d"] == 1 and got[2]["height"] == 4.0 and got[2]["num_models"] == 3


# --- calibration -----------------------------------------------------------------------------------
def test_bin_edges_are_right_closed(spark):
    values = [0.0, 0.05, 0.1, 0.1000001, 0.3, 0.3 + 1e-9, 1.0, 1.2]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "c double")
           .select(calibration.bin_number(F.col("c"))).collect()]
    edges = np.linspace(0, 1, 11)
    want = [next((i + 1 for i in range(10) if edges[i] < v <= edges[i + 1]), None) for v in values]
    assert got == want


@pytest.mark.parametrize("seed", range(3))
def test_calibration_errors_against_numpy(spark, seed):
    rng = np.random.default_rng(seed)
    c, y = np.round(rng.uniform(0, 1, 90), 2), rng.integers(0, 2, 90).astype(float)
    pairs = spark.createDataFrame(pd.DataFrame({"task": "height", "confidence": c, "correct": y}))
    edges = np.linspace(0, 1, 11)
    gaps = [(abs(c[m].mean() - y[m].mean()), m.mean()) for m in ((c > a) & (c <= b) for a, b in zip(edges[:-1], edges[1:])) if m.any()]
    got = one(calibration.calibration_errors(pairs, ["task"]))
    assert got["ece"] == pytest.approx(sum(g * w for g, w in gaps)) and got["mce"] == pytest.approx(max(g for g, _ in gaps))
    assert got["ace"] == pytest.approx(sum(g for g, _ in gaps) / 10) and got["mce"] >= got["ece"]


def test_calibrators_improve_and_stay_in_range(spark):
    rng = np.random.default_rng(0)
    c = rng.uniform(0.05, 0.95, 2000)
    y = (rng.uniform(size=2000) < c ** 2).astype(float)
    pairs = spark.createDataFrame(pd.DataFrame({"task": "height", "confidence": c, "correct": y})).cache()
    for method in ("platt", "isotonic"):
        got = one(calibration.calibrator_report(pairs, method))
        assert got["ece_after"] < got["ece_before"]
    out = calibration.apply_platt(calibration.fit_platt(pairs, 2000), pairs).agg(F.min("calibrated"), F.max("calibrated")).first()
    assert 0 <= out[0] <= out[1] <= 1
    with pytest.raises(ValueError):
        calibration.calibrator_report(pairs.limit(20), "platt")
    few = pairs.limit(20).withColumn("task", F.lit("direction"))
    both = calibration.Calibrators("isotonic").fit(pairs.unionByName(few))
    out = both.transform(pairs.unionByName(few))
    assert list(both.models) == ["height"] and out.count() == 2020
    assert out.filter("task = 'direction' and calibrated != confidence").count() == 0


# --- two-sample ------------------------------------------------------------------------------------
def two_samples(spark, a, b):
    pdf = pd.DataFrame({"dataset": ["a"] * len(a) + ["b"] * len(b), "x": list(a) + list(b)})
    return drift.to_long(spark.createDataFrame(pdf), ["x"])


def brute(a, b):
    values = np.unique(np.concatenate([a, b]))
    f1, f2 = (np.searchsorted(np.sort(s), values, side="right") / len(s) for s in (a, b))
    u = sum((x > b).sum() + 0.5 * (x == b).sum() for x in a)
    return np.abs(f1 - f2).max(), float((np.abs(f1 - f2)[:-1] * np.diff(values)).sum()), float(u)


@pytest.mark.parametrize("seed", range(3))
def test_rank_distances_with_ties(spark, seed):
    rng = np.random.default_rng(seed)
    a, b = np.round(rng.normal(0, 1, 120), 1), np.round(rng.normal(0.3, 1.5, 80), 1)
    got = one(drift.rank_distances(two_samples(spark, a, b), "a", "b"))
    ks, w, u = brute(a, b)
    assert got["ks"] == pytest.approx(ks) and got["wasserstein"] == pytest.approx(w) and got["mann_whitney_u"] == pytest.approx(u)
    assert 0 <= got["ks_p"] <= 1 and 0 <= got["mann_whitney_p"] <= 1


def test_identical_samples_match(spark):
    a = np.arange(200) / 10
    long = two_samples(spark, a, a)
    got = one(drift.rank_distances(long, "a", "b"))
    assert got["ks"] == 0 and got["wasserstein"] == 0 and got["ks_p"] == 1
    assert one(drift.kl_divergence(long, "a", "b"))["kl"] == pytest.approx(0, abs=1e-9)
    report = one(drift.drift_report(long, "a", "b"))
    assert not report["drift_detected"] and report["affected"] == []


@pytest.mark.parametrize("seed", range(3))
def test_kl_against_numpy(spark, seed):
    rng = np.random.default_rng(seed)
    a, b = np.round(rng.uniform(0, 0.1, 300), 2), np.round(rng.uniform(-0.02, 0.12, 200), 2)
    h1, edges = np.histogram(a, bins=50, density=True)
    h2, _ = np.histogram(b, bins=edges, density=True)
    p, q = h1 + 1e-10, h2 + 1e-10
    p, q = p / p.sum(), q / q.sum()
    assert one(drift.kl_divergence(two_samples(spark, a, b), "a", "b"))["kl"] == pytest.approx((p * np.log(p / q)).sum(), rel=1e-9)


def test_kl_of_a_constant_sample(spark):
    long = two_samples(spark, np.full(10, 3.0), np.full(5, 3.0))
    assert one(drift.kl_divergence(long, "a", "b"))["kl"] == pytest.approx(0, abs=1e-9)


# --- gates, bands, labels --------------------------------------------------------------------------
def test_first_failing_file_check_wins(spark):
    df = spark.createDataFrame([(10, "GIF", 100, 100), (5000, "GIF", 100, 100), (5000, "PNG", 100, 300), (5000, "PNG", 300, 300)],
                               "file_bytes long, ext string, width long, height long")
    assert [r["issue"] for r in gates.file_gate(df).collect()] == ["file too small", "unsupported format", "resolution too low", None]


def test_file_kinds(spark):
    df = spark.createDataFrame([("a/x.jpg",), ("a/x_depth.npy",), ("a/x.npy",), ("a/x_labels.npy",), ("a/x.json",)], "p string")
    assert [r[0] for r in df.select(gates.file_kind(F.col("p"))).collect()] == ["raw", "depth", "synthetic", None, None]
    got = {r["kind"]: (r["n"], r["enough"]) for r in gates.availability(df.select(gates.file_kind(F.col("p")).alias("kind")), "kind").collect()}
    assert got == {"raw": (1, False), "depth": (1, False), "synthetic": (1, False)}


def test_bands(spark):
    df = spark.createDataFrame([(0.0,), (0.3,), (0.5,), (1.5,), (2.4,), (8.0,)], "v double")
    rows = bands.surfability(df.select("v", bands.cut(F.col("v"), *bands.QUALITY_CUT).alias("cut"),
                                       bands.height_band(F.col("v")).alias("band")), "v").collect()
    assert [r["cut"] for r in rows] == [None, "Low", "Medium", None, None, None]
    assert [r["band"] for r in rows] == [None, None, "0.5-1.5m", "1.5-3.0m", "1.5-3.0m", None]
    assert [r["surfability"] for r in rows] == [None, "Flat", "Flat", "Medium", "Very Large", "Very Large"]


def test_label_rules(spark):
    rows = [(2.0, 2.0 * 3.28084, 0.9, 0.9, 0.9, "LEFT", "SPILLING", False, 0.5, 0.1),
            (9.0, 9.0 * 3.28084, 0.9, 0.9, 0.9, "UP", "SURGING", False, 0.8, 0.2)]
    df = spark.createDataFrame(rows, "height_meters double, height_feet double, height_confidence double, direction_confidence double, "
                               "breaking_confidence double, direction string, breaking_type string, extreme_conditions boolean, "
                               "wind_strength double, wave_steepness double")
    good, bad = gates.validate_labels(df).collect()
    assert good["is_valid"] and good["confidence_score"] == pytest.approx(0.9)
    assert len(bad["errors"]) == 2 and len(bad["warnings"]) == 3 and bad["confidence_score"] == pytest.approx(0.9 - 0.4 - 0.15)


def test_alias_columns_and_zero_columns(spark):
    df = spark.createDataFrame([(None, 1.5, 0, 2), ("x", None, 0, 3)], "inputs string, height_meters double, z int, k int")
    out = gates.normalise_columns(df)
    assert set(out.columns) == {"z", "k", "image", "wave_height"}
    assert set(gates.drop_all_zero(df.select("z", "k")).columns) == {"k"}
    labelled = spark.createDataFrame([("LEFT",)], "direction_label string")
    assert gates.normalise_columns(labelled).columns == ["wave_direction"]


def test_ensemble_votes_on_text_labels(spark):
    rows = [(1, "LEFT", 1.0, 2), (1, "RIGHT", 3.0, 2), (1, "RIGHT", None, 1), (2, "RIGHT", 2.0, 5), (2, "LEFT", 4.0, None), (3, None, None, None)]
    df = spark.createDataFrame(rows, "item int, d string, h double, b int")
    got = {r["item"]: (r["mean"], r["num_models"], r["d"], r["b"]) for r in evaluation.ensemble(df, "item", ["d", "b"], {"mean": "h"}).collect()}
    assert got == {1: (2.0, 3, "RIGHT", 2), 2: (3.0, 2, "LEFT", 5), 3: (None, 1, None, None)}


def test_unknown_condition_is_no_category(spark):
    df = spark.createDataFrame([(77, 1.0, "LEFT", "SPILLING")], "weather_id bigint, height_meters double, direction string, breaking_type string")
    assert "" not in {r["category"] for r in labels.balance(df).collect()}


def test_balance_scores(spark):
    counts = literal_table(spark, "dimension string, category string, n bigint",
                           [("d", "a", 10), ("d", "b", 10), ("e", "a", 20), ("e", "b", 0)])
    got = {r["dimension"]: r["balance_score"] for r in labels.balance_score(counts).collect()}
    assert got["d"] == pytest.approx(1.0) and got["e"] == pytest.approx(math.exp(-1))
    issues = {(r["dimension"], r["category"], r["issue"]) for r in labels.balance_issues(
        counts.replace({"d": "direction", "e": "height"}, subset=["dimension"])).collect()}
    assert issues == {("height", "*", "uneven"), ("height", "b", "rare")}


def test_split_sizes_and_repeatability(spark):
    df = spark.range(1003)
    a = labels.split_ordered(df, "id", 1)
    assert a.filter("split = 'train'").count() == int(1003 * 0.8)
    assert a.exceptAll(labels.split_ordered(df, "id", 1)).count() == 0


# --- joins -----------------------------------------------------------------------------------------
@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_skew_join_equals_plain_join(spark, how):
    left = spark.range(4000).select(F.when(F.col("id") % 3 > 0, 7).when(F.col("id") % 50 == 0, None).otherwise(F.col("id") % 400)
                                    .cast("long").alias("k"), F.col("id").alias("l"))
    right = spark.range(300).select(F.col("id").alias("k"), (F.col("id") * 2).alias("r"))
    a, b = joins.skew_join(left, right, "k", how), left.join(right, "k", how)
    assert a.columns == b.columns and a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    assert "_salt" in joins.skew_join(left, right, "k", how)._jdf.queryExecution().analyzed().toString()


def test_reuse_needs_a_fresh_result(spark):
    requests = spark.createDataFrame([("h", 100.0, 1), ("h", 399.0, 2), ("h", 400.0, 3), ("g", 100.0, 4)], "k string, at double, id long")
    results = spark.createDataFrame([("h", 100.0, 10)], "k string, at double, id long")
    got = {r["id"]: r["reuse_of"] for r in joins.recent_duplicate(requests, results, "k", "at", "id", 300).collect()}
    assert got == {1: 10, 2: 10, 3: None, 4: None}


def test_salts_follow_the_share_of_a_key(spark):
    left = spark.range(4000).select(F.when(F.col("id") % 4 > 0, 7).otherwise(F.col("id")).alias("k"), "id")
    hot = hot_groups(left, ["k"])
    assert len(hot) == 1 and hot.total == 4000
    for partitions in (8, 100, 10_000):
        wanted = left.select(hot.pieces(F.xxhash64("k"), partitions).alias("n"), "k").distinct().collect()
        assert {r["n"] for r in wanted if r["k"] == 7} == {-(-3 * partitions // 4)} and {r["n"] for r in wanted if r["k"] != 7} == {1}


# --- telemetry -------------------------------------------------------------------------------------
@pytest.mark.parametrize("n", [20, 21])
def test_positional_p95(spark, n):
    df = spark.range(n).select(F.lit("x").alias("k"), F.col("id").cast("double").alias("duration_ms"))
    want = sorted(range(n))[int(n * 0.95)] if n > 20 else n - 1
    assert one(tm.positional_p95(df, ["k"]))["p95_ms"] == want


def test_cool_down_counts_from_the_last_emitted_alert(spark):
    minutes = [0, 14, 15, 29, 30, 31, 60]
    fired = spark.createDataFrame([("cpu", 60.0 * m) for m in minutes] + [("cpu", 1.0)], "rule_id string, at double")
    got = sorted(r["at"] / 60 for r in tm.cooled_down(fired, ["rule_id"]).collect())
    assert got == [0, 15, 30, 60]


def test_degradation(spark):
    rng = np.random.default_rng(0)
    normal = [("c", float(i), i, 100 + rng.uniform(-10, 10), 500.0, False) for i in range(15)]
    worse = [("c", 15.0 + i, 15 + i, 300 + rng.uniform(-20, 20), 1200.0, i % 5 == 0) for i in range(10)]
    few = [("d", float(i), 100 + i, 100.0, 1.0, False) for i in range(5)]
    df = spark.createDataFrame(normal + worse + few, "component string, at double, event_id long, duration_ms double, memory_mb double, error_occurred boolean")
    got = {r["component"]: r for r in tm.degradation(df, ["component"]).collect()}
    assert got["c"]["is_degraded"] and set(got["c"]["reasons"]) == {"processing time increased", "high memory usage", "high error rate"}
    assert not got["d"]["is_degraded"] and got["d"]["reasons"] == ["insufficient data"]


# --- scalars, predictions, lineage -------------------------------------------------------------------
def test_scalars(spark):
    df = spark.createDataFrame([("a/b.c/Photo.old.JPG", 3, {"x": "1.5", "y": "abc"})], "p string, n int, m map<string,string>")
    got = one(df.select(
        sc.extension(F.col("p")).alias("e"), sc.stem(F.col("p")).alias("s"), sc.parent(F.col("p")).alias("d"),
        sc.backoff_delay(F.col("n")).alias("b"), sc.backoff_delay(F.lit(30)).alias("top"),
        sc.backoff_delay(F.col("n"), jitter_key=[F.col("p")]).alias("j"), sc.only_numeric(F.col("m")).alias("m")))
    assert (got["e"], got["s"], got["d"], got["b"], got["top"]) == ("jpg", "Photo.old", "a/b.c", 4.0, 60.0)
    assert 3.0 <= got["j"] <= 5.0 and got["m"] == {"x": 1.5}


def test_softmax_and_entropy(spark):
    df = spark.createDataFrame([([1.0, 1.0, 1.0],), ([1000.0, 0.0, 0.0],)], "l array<double>")
    flat, sharp = df.select(pd_softmax := predictions.softmax(F.col("l")), predictions.entropy(pd_softmax)).collect()
    assert flat[1] == pytest.approx(math.log(3)) and sharp[0] == [1.0, 0.0, 0.0] and abs(sharp[1]) < 1e-5


def test_robust_anomalies_flag_the_tail(spark):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"a": np.append(rng.normal(2, 0.5, 99), 50.0), "b": np.append(rng.uniform(0.6, 1, 99), 0.01)})
    out = predictions.anomaly_robust(spark.createDataFrame(pdf), ["a", "b"]).toPandas()
    assert out["is_outlier"].sum() == 10 and out.loc[out["a"] == 50.0, "is_outlier"].all()


def test_checksum_ignores_order_and_sees_changes(spark):
    df = spark.createDataFrame([("s", "a.jpg", 1), ("s", "b.jpg", 2)], "k string, path string, length long")
    again = df.orderBy(F.desc("path")).repartition(5)
    other = df.withColumn("length", F.col("length") + 1)
    a, b, c = (one(profiling.dataset_checksum(x, ["k"]))["checksum"] for x in (df, again, other))
    assert a == b != c


def test_versions_compare_as_numbers(spark):
    have = spark.createDataFrame([("x", "1.0.9"), ("x", "1.0.10"), ("y", "2.1.0")], "dataset_id string, version string")
    names = spark.createDataFrame([("x",), ("y",), ("z",)], "dataset_id string")
    got = {r["dataset_id"]: r["next_version"] for r in lineage.next_version(names, have, "dataset_id").collect()}
    assert got == {"x": "1.0.11", "y": "2.1.1", "z": "1.0.0"}


def test_lineage_steps_with_one_busy_dataset(spark):
    heads = spark.createDataFrame([(i, f"s{i}") for i in range(5)], "ds long, source string")
    steps = spark.range(2000).select(F.when(F.col("id") < 1900, 1).otherwise(F.col("id") % 4).cast("long").alias("ds"),
                                     (F.col("id") % 700).cast("double").alias("ts"), F.col("id").alias("sid"))
    got = lineage.lineage_steps(heads, steps, "ds", ["ts", "sid"]).toPandas()
    want = steps.toPandas().sort_values(["ts", "sid"])
    want["position"] = want.groupby("ds").cumcount() + 1
    merged = got.dropna(subset=["sid"]).merge(want, on=["ds", "sid"], suffixes=("", "_w"))
    assert len(merged) == 2000 and (merged["position"] == merged["position_w"]).all()
    assert got[got["sid"].isna()]["ds"].tolist() == [4]


def test_one_feature_drifts_and_the_mean_does_not(spark):
    ks = spark.createDataFrame([("brightness", 0.3)] + [(f, 0.0) for f in drift.DRIFT_FEATURES[1:]], "feature string, ks double")
    said = {r["text"] for r in joins.recommend(drift.drift_measures(ks), rules.DRIFT).collect()}
    assert said == {"No significant data drift detected - dataset is stable"}
    worse = spark.createDataFrame([("brightness", 0.9), ("contrast", 0.2)] + [(f, 0.0) for f in drift.DRIFT_FEATURES[2:]], "feature string, ks double")
    said = {r["text"] for r in joins.recommend(drift.drift_measures(worse), rules.DRIFT).collect()}
    assert len(said) == 5 and any("Brightness" in t for t in said) and any("Contrast" in t for t in said)


def test_alerts_carry_message_actions_metrics_and_id(spark):
    metrics = spark.createDataFrame([(100.0, "c1", 97.25, 0.0)], "at double, component string, memory_usage_percent double, error_rate double") \
        .withColumns({c: F.lit(0.0) for c in ("cpu_usage_percent", "avg_duration_ms", "gpu_memory_used_mb", "gpu_memory_total_mb")}) \
        .withColumn("gpu_available", F.lit(False))
    got = {r["rule_id"]: r for r in tm.alerts(metrics, tm.ALERT_RULES, ["at", "component"]).collect()}
    assert set(got) == {"memory_high", "memory_critical"}
    row = got["memory_critical"]
    assert row["message"] == "Memory usage is 97.3%, system may become unstable" and len(row["actions"]) == 4
    assert row["alert_id"] == "resource_exhaustion_critical_100" and row["metrics"]["memory_usage_percent"] == 97.25


def test_missing_labels_are_errors(spark):
    row = {"height_meters": 1.0, "height_feet": 3.28084, "height_confidence": 0.9, "direction_confidence": 0.9, "breaking_confidence": 0.9,
           "direction": None, "breaking_type": None, "extreme_conditions": False, "wind_strength": 0.1, "wave_steepness": 0.1}
    df = spark.createDataFrame([row], ", ".join(f"{k} {'boolean' if isinstance(v, bool) else 'string' if v is None else 'double'}" for k, v in row.items()))
    got = gates.validate_labels(df).first()
    assert got["errors"] == ["unknown direction", "unknown breaking type"] and not got["is_valid"]


def test_confidence_trend_is_a_reason(spark):
    rows = [("c", float(i), i, 100.0, 10.0, False, 10.0 - i) for i in range(30)]
    df = spark.createDataFrame(rows, "component string, at double, event_id long, duration_ms double, memory_mb double, error_occurred boolean, confidence double")
    got = tm.degradation(df, ["component"], confidence="confidence").first()
    assert got["confidence_trend"] == pytest.approx(-1.0) and got["reasons"] == ["confidence declining"] and got["is_degraded"]
