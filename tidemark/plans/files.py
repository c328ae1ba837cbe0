"""Queries that write what a table holds to the shared folder and read it again through the file sources, and stream checks."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.rounding import rounded
from tidemark.operators import gates
from tidemark.plans import views
from tidemark.plans.registry import query
from tidemark.plans.streams import event_stream
from tidemark.plans.views_sql import PRED, TEL, with_views
from tidemark.sources import files
from tidemark.sources.tables import pin, shared_dir, table
from tidemark.streaming import monitor, stateful


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("scanned_files", "SELECT event_type AS kind, 1::BIGINT AS files, 'json' AS ext, true AS filled FROM events GROUP BY event_type")
def scanned_files(spark: SparkSession, d: str) -> DataFrame:
    """Listing of a folder with one file of events a kind; markers and other extensions are left out."""
    root = _folder(spark, "scan")
    events = table(spark, d, "events").withColumn("kind", F.col("event_type"))
    events.repartition("kind").write.partitionBy("kind").json(root)
    kind = F.regexp_extract("path", "kind=([^/]+)/", 1)
    found = pin(files.scan_files(spark, root, ["json"]).groupBy(kind.alias("kind"), "ext").agg(
        F.count("*").alias("files"), (F.min("length") > 0).alias("filled")))
    files.drop_path(spark, root)
    return found


@query("stage_documents", """SELECT event_type AS stage_name, count(*) AS processed_items, round(avg(value), 6) AS quality,
  count(*) % 2 = 0 AS is_valid FROM events GROUP BY event_type""")
def stage_documents(spark: SparkSession, d: str) -> DataFrame:
    """One JSON document a kind of event, written, read with its schema and checked: only completed stages are valid."""
    root = _folder(spark, "documents")
    each = table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.avg("value").alias("quality"))
    made = each.select("event_type", F.to_json(F.struct(
        F.col("event_type").alias("stage_name"), F.lit("2024-01-31T00:00:00").alias("timestamp"),
        F.when(F.col("n") % 2 == 0, "completed").otherwise("failed").alias("status"),
        F.struct(F.col("n").alias("processed_items"), F.array("quality").alias("quality_scores"), F.array(F.lit("out")).alias("output_paths")).alias("data"))).alias("value"))
    made.repartition("event_type").write.partitionBy("event_type").text(root)
    read = files.valid_stage_docs(files.read_documents(spark, root, files.STAGE_SCHEMA), F.col("event_type"))
    out = pin(read.select("stage_name", F.col("data.processed_items").alias("processed_items"), F.col("data.quality_scores")[0].alias("quality"), "is_valid"))
    files.drop_path(spark, root)
    return rounded(out)


@query("telemetry_log", with_views(TEL) + """SELECT component, operation, count(*) AS n, round(avg(duration_ms), 6) AS avg_ms, count_if(error_occurred)::BIGINT AS errors,
  round(max(memory_mb), 6) AS max_mb FROM v_tel GROUP BY 1, 2""")
def telemetry_log(spark: SparkSession, d: str) -> DataFrame:
    """Telemetry written as a report of JSON lines and read again as a log."""
    root = _folder(spark, "log")
    files.write_report(views.telemetry(spark, d).select("ts", "component", "operation", "duration_ms", "memory_mb", "error_occurred"), root, "json")
    out = pin(files.read_log(spark, root).groupBy("component", "operation").agg(
        F.count("*").alias("n"), F.avg("duration_ms").alias("avg_ms"), F.count_if("error_occurred").alias("errors"), F.max("memory_mb").alias("max_mb")))
    files.drop_path(spark, root)
    return rounded(out)


@query("stage_outputs", """SELECT 'clicks' AS stage, count(*) AS n FROM events WHERE event_type = 'click'
  UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'pages', count(*) FROM pages""")
def stage_outputs(spark: SparkSession, d: str) -> DataFrame:
    """Stages whose output is complete, with its rows; a stage that began and left no marker is not among them."""
    root = _folder(spark, "stages")
    stages = {"clicks": table(spark, d, "events").filter("event_type = 'click'").select("event_id"),
              "orders": table(spark, d, "orders").select("o_orderkey"), "pages": table(spark, d, "pages").select("page_id")}
    for name, rows in stages.items():
        files.save_stage(rows, root, name)
    files.save_stage(stages["pages"], root, "begun")
    files.drop_path(spark, f"{root}/begun/_SUCCESS")
    done = {r.stage for r in files.completed_stages(spark, root).collect()}
    counts = [spark.read.parquet(f"{root}/{name}").agg(F.lit(name).alias("stage"), F.count("*").alias("n")) for name in sorted(done)]
    out = counts[0]
    for more in counts[1:]:
        out = out.unionByName(more)
    out = pin(out)
    files.drop_path(spark, root)
    return out


@query("normalised_columns", with_views(PRED) + """SELECT model, count(*) AS n, round(avg(coalesce(CASE WHEN d_true = 0 THEN h_true END, h_pred)), 6) AS wave_height,
  sum(d_true)::BIGINT AS wave_direction, sum(b_true)::BIGINT AS breaking_type FROM v_pred GROUP BY model""")
def normalised_columns(spark: SparkSession, d: str) -> DataFrame:
    """Columns under other accepted names; of two spellings the first that has a value counts."""
    df = views.predictions(spark, d).select("model", F.when(F.col("d_true") == 0, F.col("h_true")).alias("height"), F.col("h_pred").alias("height_meters"),
                                            F.col("d_true").alias("direction_label"), F.col("b_true").alias("breaking"))
    return rounded(gates.normalise_columns(df).groupBy("model").agg(
        F.count("*").alias("n"), F.avg("wave_height").alias("wave_height"), F.sum("wave_direction").alias("wave_direction"), F.sum("breaking_type").alias("breaking_type")))


@query("nonzero_columns", """SELECT 'l_quantity' AS name, round(sum(l_quantity), 2) AS total FROM lineitem
  UNION ALL SELECT 'l_tax', round(sum(l_tax), 2) FROM lineitem UNION ALL SELECT 'l_linenumber', sum(l_linenumber)::DOUBLE FROM lineitem""")
def nonzero_columns(spark: SparkSession, d: str) -> DataFrame:
    """Columns that are left when those with zeros alone are dropped, and their sums."""
    df = table(spark, d, "lineitem").select("l_quantity", "l_tax", "l_linenumber", (F.col("l_discount") * 0).alias("nothing"), (F.col("l_linenumber") * 0).alias("none"))
    kept = gates.drop_all_zero(df)
    sums = kept.agg(*[F.sum(c).cast("double").alias(c) for c in kept.columns])
    return sums.select(F.inline(F.array(*[F.struct(F.lit(c).alias("name"), F.round(c, 2).alias("total")) for c in kept.columns])))


@query("scored_stream", """SELECT event_id, CASE WHEN event_id % 1000 <> 7 THEN round(value * 2 + 1, 6) END AS height, event_id % 1000 = 7 AS failed FROM events""")
def scored_stream(spark: SparkSession, d: str) -> DataFrame:
    """A model over the event stream that fails on some rows: those come out without a result and with the reason."""
    def predict(frame: pd.DataFrame) -> pd.DataFrame:
        if (frame["event_id"] % 1000 == 7).any():
            raise ValueError("unusable row")
        return pd.DataFrame({"event_id": frame["event_id"], "height": frame["duration_ms"] * 2 + 1})

    scored = monitor.score(event_stream(spark, d).select("event_id", "duration_ms"), predict, "event_id bigint, height double")
    return rounded(monitor.run_available(scored, "scored").select("event_id", "height", F.col("error").isNotNull().alias("failed")))


@query("late_events", """SELECT count(*) AS rows_read, count_if(ts < TIMESTAMP '2024-01-15')::BIGINT AS late_rows FROM events""")
def late_events(spark: SparkSession, d: str) -> DataFrame:
    """Rows that come behind the watermark when the second half of the events arrives before the first, by the log of the stream.

    Spark takes rows for late by the watermark of the batch before the last, so the second half comes in two batches.
    """
    root = _folder(spark, "late")
    events = table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    cut = F.lit("2024-01-15").cast("timestamp")
    new, odd = F.col("ts") >= cut, F.col("event_id") % 2 == 1
    for part in (new & ~odd, new & odd, ~new):
        events.filter(part).coalesce(1).write.mode("append").parquet(f"{root}/in")
    stream = (spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
              .withWatermark("ts", "10 minutes").dropDuplicates(["event_id", "ts"]))
    log = stateful.watched(spark)
    try:
        query = (stream.writeStream.format("noop").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start())
        log.settled(query)
        report = log.table(spark).filter(F.col("run_id") == str(query.runId))
        out = pin(report.agg(F.sum("input_rows").alias("rows_read"), F.sum("late_rows").alias("late_rows")))
    finally:
        spark.streams.removeListener(log)
    files.drop_path(spark, root)
    return out
