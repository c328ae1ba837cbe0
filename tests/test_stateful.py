"""State that goes on from its checkpoint, and reports over the whole life of a query."""

import random

import pytest
from pyspark.sql import functions as F

from tests.test_chains import walk
from tidemark.streaming import monitor, stateful

SCHEMA = "rule_id string, at double, message string, actions array<string>, metrics map<string,double>"


def add(spark, path, minutes, rule="cpu"):
    rows = [(rule, 60.0 * m, f"m{m}", ["look", "wait"], {"error_rate": m / 100}) for m in minutes]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(path))


def run(spark, tmp_path, gap=900.0, per_trigger=1):
    stateful.use_rocksdb(spark)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", per_trigger).parquet(str(tmp_path / "in"))
    query = (stateful.cooled_down(stream, ["rule_id"], gap).writeStream.format("parquet").option("path", str(tmp_path / "out"))
             .option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.schema(SCHEMA).parquet(str(tmp_path / "out"))


@pytest.fixture(autouse=True)
def provider(spark):
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_state_and_payload_go_on_from_the_checkpoint(spark, tmp_path):
    add(spark, tmp_path / "in", [0, 14])
    add(spark, tmp_path / "in", [15, 29])
    run(spark, tmp_path)
    add(spark, tmp_path / "in", [60, 30, 44])
    add(spark, tmp_path / "in", [5], rule="gpu")
    out = run(spark, tmp_path)
    got = {(r.rule_id, r.message): (r.actions, r.metrics) for r in out.collect()}
    assert set(got) == {("cpu", f"m{m}") for m in (0, 15, 30, 60)} | {("gpu", "m5")}
    assert got["cpu", "m30"] == (["look", "wait"], {"error_rate": 0.3})
    state = spark.read.format("statestore").option("stateVarName", "last").load(str(tmp_path / "checkpoint"))
    assert {(r.key.rule_id, r.value.at / 60) for r in state.collect()} == {("cpu", 60.0), ("gpu", 5.0)}  # one number a key
    waiting = spark.read.format("statestore").option("stateVarName", "waiting").load(str(tmp_path / "checkpoint"))
    assert waiting.count() == 0


def test_many_alerts_of_one_key_in_small_frames(spark, tmp_path):
    draw = random.Random(3)
    minutes = [draw.randrange(5000) for _ in range(3000)]
    add(spark, tmp_path / "in", minutes)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        out = run(spark, tmp_path)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(r.at for r in out.collect()) == walk([60.0 * m for m in minutes], 900.0)


def test_reports_cover_the_whole_life_of_a_query(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", "4")
    for k in range(12):  # more batches than a query then keeps reports of
        start = 6e5 + 3600 * k if k % 4 else 0  # every fourth file is far behind
        spark.createDataFrame([(float(start + i), "c") for i in range(3)], "at double, component string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = (spark.readStream.schema("at double, component string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
              .withColumn("ts", F.timestamp_seconds("at")).withWatermark("ts", "10 minutes"))
    log = stateful.watched(spark)
    query = (stream.groupBy(F.window("ts", "10 minutes")).count().writeStream.format("noop").outputMode("append")
             .option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start())
    log.settled(query)
    try:
        table = log.table(spark).filter(F.col("run_id") == str(query.runId))
        assert table.agg(F.sum("input_rows")).first()[0] == 36
        assert table.filter("input_rows > 0").count() == 12 > len(query.recentProgress)
        assert 0 < log.late_rows(query) == table.agg(F.sum("late_rows")).first()[0]
    finally:
        spark.conf.unset("spark.sql.streaming.numRecentProgressUpdates")
        spark.streams.removeListener(log)
