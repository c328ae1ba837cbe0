"""Streaming queries: each reads the event table as a file stream and processes all of it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.rounding import as_text, rounded
from tidemark.operators import chains, telemetry as tm
from tidemark.plans import telemetry as batch
from tidemark.plans import views
from tidemark.plans.registry import query
from tidemark.plans.views_sql import TEL, with_views
from tidemark.sources.tables import table
from tidemark.streaming import monitor


def event_stream(spark: SparkSession, d: str) -> DataFrame:
    """The event table as a telemetry stream."""
    schema = table(spark, d, "events").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    return views.telemetry_columns(raw).withColumn("ts", F.col("ts").cast("timestamp"))


# a window is out once the newest event is ten minutes past its end
CLOSED = "v_now AS (SELECT max(secs) - 600 AS mark FROM v_tel)"


@query("stream_tumbling", with_views(TEL, CLOSED) + f"""SELECT (floor(secs / 3600) * 3600)::BIGINT AS window_start, component, {batch.WINDOW_COLS}
  FROM v_tel WHERE floor(secs / 3600) * 3600 + 3600 <= (SELECT mark FROM v_now) GROUP BY 1, 2""")
def stream_tumbling(spark: SparkSession, d: str) -> DataFrame:
    out = monitor.run_available(monitor.summary_stream(event_stream(spark, d), ["component"], "1 hour"), "tumbling")
    return rounded(out.select(batch.start_seconds(), *[c for c in out.columns if c != "window"]))


@query("stream_sliding", with_views(TEL, CLOSED) + f""", w AS (SELECT *, (floor(secs / 60) * 60 - 60 * k)::BIGINT AS window_start
  FROM v_tel, unnest(range(0, 10)) AS t(k)) SELECT window_start, component, {batch.WINDOW_COLS} FROM w
  WHERE window_start + 600 <= (SELECT mark FROM v_now) GROUP BY 1, 2""")
def stream_sliding(spark: SparkSession, d: str) -> DataFrame:
    stream = monitor.summary_stream(event_stream(spark, d), ["component"], "10 minutes", "1 minute")
    out = monitor.run_available(stream, "sliding")
    return rounded(out.select(batch.start_seconds(), *[c for c in out.columns if c != "window"]))


@query("stream_slow_ops", with_views(TEL) + """SELECT event_id, duration_ms > 200 AS over_target, duration_ms > 5000 AS slow,
  duration_ms > 10000 AS very_slow FROM v_tel""")
def stream_slow_ops(spark: SparkSession, d: str) -> DataFrame:
    out = tm.speed_flags(event_stream(spark, d)).select("event_id", "over_target", "slow", "very_slow")
    return monitor.run_available(out, "flags")


HOURLY = """v_met AS (SELECT (floor(secs / 3600) * 3600)::BIGINT AS secs, component, avg(memory_mb) * 1.4::DOUBLE AS memory_usage_percent,
  count_if(error_occurred) / count(*)::DOUBLE AS error_rate, avg(duration_ms) * 100 AS avg_duration_ms,
  max(duration_ms) / 5 AS cpu_usage_percent, max(duration_ms) AS gpu_memory_used_mb, 500::DOUBLE AS gpu_memory_total_mb FROM v_tel
  WHERE floor(secs / 3600) * 3600 + 3600 <= (SELECT mark FROM v_now) GROUP BY 1, 2)"""
CHAIN = """j AS (SELECT component, rule_id, secs, min(secs) OVER (PARTITION BY component, rule_id ORDER BY secs RANGE BETWEEN 14400 FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt FROM v_fired),
chain AS (SELECT component, rule_id, min(secs) AS secs FROM v_fired GROUP BY 1, 2 UNION ALL SELECT c.component, c.rule_id, j.nxt FROM chain c
  JOIN j ON j.component = c.component AND j.rule_id = c.rule_id AND j.secs = c.secs WHERE j.nxt IS NOT NULL)"""


@query("stream_alerts", with_views(TEL, CLOSED, HOURLY, batch.FIRED, CHAIN).replace("WITH ", "WITH RECURSIVE ", 1)
       + """SELECT component, rule_id, secs, severity, title, message, actions, alert_id, round(error_rate, 6) AS error_rate
  FROM chain JOIN v_fired USING (component, rule_id, secs) JOIN v_met USING (component, secs)""")
def stream_alerts(spark: SparkSession, d: str) -> DataFrame:
    hourly = monitor.summary_stream(event_stream(spark, d), ["component"], "1 hour").select(
        F.unix_seconds("window.start").alias("at"), "component", (F.col("avg_mb") * 1.4).alias("memory_usage_percent"),
        (F.col("errors") / F.col("n")).alias("error_rate"), (F.col("avg_duration_ms") * 100).alias("avg_duration_ms"),
        (F.col("max_ms") / 5).alias("cpu_usage_percent"), F.lit(True).alias("gpu_available"), F.col("max_ms").alias("gpu_memory_used_mb"),
        F.lit(500.0).alias("gpu_memory_total_mb"))
    fired = tm.alerts(monitor.staged(hourly, "hourly"), tm.ALERT_RULES, ["at", "component"])
    out = monitor.cooled_down_stream(fired, ["component", "rule_id"], minutes=240)
    return monitor.run_available(out, "alerts").select(
        "component", "rule_id", F.col("at").alias("secs"), "severity", "title", "message", as_text("actions").alias("actions"), "alert_id",
        F.round(F.element_at("metrics", "error_rate"), 6).alias("error_rate"))


@query("stream_degradation", with_views(TEL) + batch.DEGRADED + """ SELECT component, round(ms, 6) AS avg_ms, round(base, 6) AS baseline_ms, round(mb, 6) AS avg_mb,
  round(er, 6) AS error_rate, round(tr, 6) AS accuracy_trend, round(ct, 6) AS confidence_trend, array_to_string(rs, '; ') AS reasons, len(rs) > 0 AS is_degraded FROM f""")
def stream_degradation(spark: SparkSession, d: str) -> DataFrame:
    stream = event_stream(spark, d).withColumns({"memory_mb": F.col("memory_mb") * 20, "accuracy": F.col("duration_ms")})
    out = monitor.DegradationMonitor(spark, f"degradation-{uuid.uuid4().hex}", confidence="memory_mb").run(stream)
    return rounded(out.withColumn("reasons", as_text("reasons")))


@query("stream_sessions", with_views(TEL, CLOSED) + """, g AS (SELECT component, secs, duration_ms,
    CASE WHEN secs - lag(secs) OVER (PARTITION BY component ORDER BY secs) <= 1800 THEN 0 ELSE 1 END AS new FROM v_tel),
  s AS (SELECT *, sum(new) OVER (PARTITION BY component ORDER BY secs ROWS UNBOUNDED PRECEDING) AS session FROM g)
  SELECT component, floor(min(secs))::BIGINT AS session_start, count(*) AS n, round(avg(duration_ms), 6) AS avg_ms FROM s
  GROUP BY component, session HAVING max(secs) + 1800 <= (SELECT mark FROM v_now)""")
def stream_sessions(spark: SparkSession, d: str) -> DataFrame:
    out = monitor.run_available(monitor.session_stream(event_stream(spark, d), "component", "30 minutes"), "sessions")
    return rounded(out.select("component", F.unix_seconds("session.start").alias("session_start"), "n", "avg_ms"))


REUSE = """v_h AS (SELECT event_id, secs, md5(component || '-' || operation) AS hash FROM v_tel),
j AS (SELECT hash, secs, min(secs) OVER (PARTITION BY hash ORDER BY secs RANGE BETWEEN 300 FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt
  FROM (SELECT DISTINCT hash, secs FROM v_h)),
chain AS (SELECT hash, min(secs) AS secs FROM v_h GROUP BY hash UNION ALL SELECT c.hash, j.nxt FROM chain c
  JOIN j ON j.hash = c.hash AND j.secs = c.secs WHERE j.nxt IS NOT NULL),
done AS (SELECT hash, secs, min(event_id) AS id FROM chain JOIN v_h USING (hash, secs) GROUP BY hash, secs)"""


REUSED = """ SELECT event_id, h.hash,
  CASE WHEN done.id <> event_id THEN done.id END AS reuse_of FROM v_h h ASOF JOIN done ON h.hash = done.hash AND h.secs >= done.secs"""


@query("reuse_chain", with_views(TEL, REUSE).replace("WITH ", "WITH RECURSIVE ", 1) + REUSED)
def reuse_chain(spark: SparkSession, d: str) -> DataFrame:
    """The same on the table, by pointer doubling."""
    requests = views.telemetry(spark, d).select("event_id", "at", F.md5(F.concat_ws("-", "component", "operation").cast("binary")).alias("hash"))
    return chains.reused(requests, "hash", "at", "event_id", 300.0).select("event_id", "hash", "reuse_of")


@query("stream_reuse", with_views(TEL, REUSE).replace("WITH ", "WITH RECURSIVE ", 1) + REUSED)
def stream_reuse(spark: SparkSession, d: str) -> DataFrame:
    requests = event_stream(spark, d).select("event_id", "ts", F.md5(F.concat_ws("-", "component", "operation").cast("binary")).alias("hash"))
    out = monitor.run_available(monitor.reused_stream(requests, "hash", "event_id"), "reuse")
    return out.select(F.col("ident").alias("event_id"), "hash", "reuse_of")
