"""Streams against their table counterparts."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import telemetry as tm
from tidemark.streaming import monitor

SCHEMA = "at double, event_id long, component string, duration_ms double, memory_mb double, error_occurred boolean, accuracy double"


def rows(n, start=0):
    return [(60.0 * (start + i), start + i, f"c{(start + i) % 2}", 100.0 + (start + i), 500.0, i % 7 == 0, 0.9 - 0.001 * i)
            for i in range(n)]


def stream_of(spark, path, per_trigger=1):
    df = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", per_trigger).parquet(str(path))
    return df.withColumn("ts", F.timestamp_seconds("at"))


def write(spark, data, path):
    spark.createDataFrame(data, SCHEMA).coalesce(1).write.mode("append").parquet(str(path))


def test_windows_equal_the_table(spark, tmp_path):
    write(spark, rows(120), tmp_path / "in")
    out = monitor.run_available(monitor.summary_stream(stream_of(spark, tmp_path / "in"), ["component"], "10 minutes"), "w")
    table = tm.window_summary(spark.read.parquet(str(tmp_path / "in")).withColumn("ts", F.timestamp_seconds("at")), ["component"], "10 minutes")
    closed = table.filter(F.col("window.end") <= F.timestamp_seconds(F.lit(119 * 60 - 600)))
    assert out.count() == closed.count() > 10 and out.exceptAll(closed).count() == 0


def test_degradation_over_batches_equals_the_table(spark, tmp_path):
    for part in range(4):
        write(spark, rows(90, part * 90), tmp_path / "in")
    mon = monitor.DegradationMonitor(spark, root=str(tmp_path / "state"))
    got = mon.run(stream_of(spark, tmp_path / "in").drop("ts"))
    assert mon.last == 3
    want = tm.degradation(spark.read.parquet(str(tmp_path / "in")), ["component"], accuracy="accuracy")
    pd.testing.assert_frame_equal(got.orderBy("component").toPandas(), want.orderBy("component").toPandas())
    # a batch that is run again leaves the same state
    batch = spark.createDataFrame(rows(90, 270), SCHEMA)
    before = spark.read.parquet(mon._state(3)).count()
    mon.step(batch, 3)
    assert spark.read.parquet(mon._state(3)).count() == before == 2 * 110


def test_cool_down_state_survives_batches(spark, tmp_path):
    for minutes in ([0, 14], [15, 29], [30, 60]):
        spark.createDataFrame([("cpu", 60.0 * m) for m in minutes], "rule_id string, at double").coalesce(1) \
            .write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("rule_id string, at double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = monitor.run_available(monitor.cooled_down_stream(stream, ["rule_id"]), "cool")
    assert sorted(r["at"] / 60 for r in out.collect()) == [0, 15, 30, 60]


@pytest.mark.parametrize("parts", [[[0, 4, 6, 11]], [[0, 4], [6], [11]], [[0], [4, 6, 11]]])
def test_results_are_reused_for_five_minutes_after_they_were_computed(spark, tmp_path, parts):
    for minutes in parts:
        write(spark, [(6e4 + 60 * m, m, "a", 1.0, 1.0, False, 0.0) for m in minutes] + [(6e4 + 60 * m, 100 + m, "b", 1.0, 1.0, False, 0.0) for m in minutes if m], tmp_path / "in")
    out = monitor.run_available(monitor.reused_stream(stream_of(spark, tmp_path / "in"), "component", "event_id"), "reuse")
    got = {r["ident"]: r["reuse_of"] for r in out.collect()}
    assert got == {0: None, 4: 0, 6: None, 11: None, 104: None, 106: 104, 111: None}


def test_degradation_goes_on_from_an_earlier_run(spark, tmp_path):
    write(spark, rows(90), tmp_path / "in")
    for _ in range(2):      # the second run finds no new data
        got = monitor.DegradationMonitor(spark, root=str(tmp_path / "state")).run(stream_of(spark, tmp_path / "in").drop("ts"))
        assert got.count() == 2


def test_late_rows_are_counted(spark, tmp_path):
    path = tmp_path / "in"
    write(spark, rows(60, 60), path)
    summary = monitor.summary_stream(stream_of(spark, path), ["component"], "10 minutes")

    def once():
        q = (summary.writeStream.format("parquet").option("path", str(tmp_path / "out"))
             .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start())
        return monitor.late_rows(q)
    assert once() == 0
    write(spark, rows(4, 0), path)      # an hour behind the watermark
    assert once() > 0


def test_scoring_failures_become_null_rows(spark, tmp_path):
    def predict(frame):
        if (frame["event_id"] == 3).any():
            raise ValueError("bad frame")
        return pd.DataFrame({"event_id": frame["event_id"], "height": frame["duration_ms"] / 100})
    write(spark, rows(6), tmp_path / "in")
    for source in (spark.read.parquet(str(tmp_path / "in")), stream_of(spark, tmp_path / "in")):
        scored = monitor.score(source, predict, "event_id long, height double")
        out = monitor.run_available(scored, "score") if scored.isStreaming else scored
        got = {r["event_id"]: r for r in out.collect()}
        assert len(got) == 6 and got[3]["height"] is None and "bad frame" in got[3]["error"]
        assert got[2]["height"] == pytest.approx(1.02) and got[2]["error"] is None


def test_alert_rules_and_speed_flags(spark):
    metrics = spark.createDataFrame([(1.0, 90.0, 96.0, 0.2, 20000.0, 95.0, 100.0, True), (2.0, 10.0, 10.0, 0.0, 1.0, 0.0, 0.0, True),
                                     (3.0, 10.0, 10.0, 0.0, 1.0, 95.0, 100.0, False)],
                                    "at double, cpu_usage_percent double, memory_usage_percent double, error_rate double, "
                                    "avg_duration_ms double, gpu_memory_used_mb double, gpu_memory_total_mb double, gpu_available boolean")
    got = tm.alerts(metrics, tm.ALERT_RULES, ["at"]).collect()
    assert {r["rule_id"] for r in got} == {r.rule_id for r in tm.ALERT_RULES} and {r["at"] for r in got} == {1.0}
    flags = tm.speed_flags(spark.createDataFrame([(150.0,), (6000.0,), (20000.0,)], "duration_ms double")).collect()
    assert [(r["over_target"], r["slow"], r["very_slow"]) for r in flags] == [(False,) * 3, (True, True, False), (True,) * 3]
