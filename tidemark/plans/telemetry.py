"""Queries over operation telemetry: summaries, rolling checks, windows, alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.rounding import as_text, rounded
from tidemark.operators import joins
from tidemark.operators import telemetry as tm
from tidemark.plans import views
from tidemark.plans.registry import query
from tidemark.plans.views_sql import TEL, with_views

KEYS = ["component"]


def start_seconds() -> Column:
    """Start of the window as whole seconds."""
    return F.unix_seconds(F.col("window.start").cast("timestamp")).alias("window_start")


@query("recent_ops", with_views(TEL) + """SELECT event_id, component, operation, duration_ms FROM v_tel
  WHERE ts >= TIMESTAMP '2024-01-20 12:00:00' - INTERVAL 600 MINUTE AND ts <= TIMESTAMP '2024-01-20 12:00:00' AND operation = 'view'""")
def recent_ops(spark: SparkSession, d: str) -> DataFrame:
    as_of = F.lit("2024-01-20 12:00:00").cast("timestamp_ntz")
    return tm.recent(views.telemetry(spark, d), as_of, 600, operation="view") \
        .select("event_id", "component", "operation", "duration_ms")


@query("latency_stats", with_views(TEL) + """SELECT operation, count(*) AS n, round(avg(duration_ms), 6) AS avg_ms, min(duration_ms) AS min_ms,
  max(duration_ms) AS max_ms, round(stddev_pop(duration_ms), 6) AS std_ms,
  round(100 * count_if(duration_ms <= 200) / count(*)::DOUBLE, 6) AS within_target_pct FROM v_tel GROUP BY operation""")
def latency_stats(spark: SparkSession, d: str) -> DataFrame:
    return rounded(tm.latency_stats(views.telemetry(spark, d), ["operation"]))


P95 = """v_pos AS (SELECT component, operation, duration_ms, row_number() OVER (PARTITION BY component, operation ORDER BY duration_ms) - 1 AS pos,
  count(*) OVER (PARTITION BY component, operation) AS n FROM v_tel),
v_p95 AS (SELECT component, operation, duration_ms AS p95_ms FROM v_pos
  WHERE pos = CASE WHEN n > 20 THEN floor(n * 0.95::DOUBLE) ELSE n - 1 END)"""


@query("p95_positional", with_views(TEL, P95) + "SELECT component, operation, p95_ms FROM v_p95")
def p95_positional(spark: SparkSession, d: str) -> DataFrame:
    return tm.positional_p95(views.telemetry(spark, d), ["component", "operation"])


@query("perf_summary", with_views(TEL, P95) + """, s AS (SELECT component, operation, count(*) AS n, count_if(error_occurred)::BIGINT AS errors,
    round(count_if(error_occurred) / count(*)::DOUBLE, 6) AS error_rate, min(duration_ms) AS min_ms, max(duration_ms) AS max_ms,
    round(avg(duration_ms), 6) AS avg_ms, min(memory_mb) AS min_mb, max(memory_mb) AS max_mb, round(avg(memory_mb), 6) AS avg_mb,
    round(min(secs), 6) AS first_at, round(max(secs), 6) AS last_at FROM v_tel GROUP BY 1, 2)
  SELECT s.*, p95_ms FROM s JOIN v_p95 USING (component, operation)""")
def perf_summary(spark: SparkSession, d: str) -> DataFrame:
    return rounded(tm.perf_summary(views.telemetry(spark, d), ["component", "operation"]))


@query("health_summary", with_views(TEL) + """SELECT component, count(*) AS n, min(duration_ms) AS duration_ms_min, max(duration_ms) AS duration_ms_max,
  round(avg(duration_ms), 6) AS duration_ms_avg, min(memory_mb) AS memory_mb_min, max(memory_mb) AS memory_mb_max,
  round(avg(memory_mb), 6) AS memory_mb_avg, arg_max(error_occurred, secs) AS last_flag FROM v_tel GROUP BY component""")
def health_summary(spark: SparkSession, d: str) -> DataFrame:
    return rounded(tm.health_summary(views.telemetry(spark, d), KEYS, ["duration_ms", "memory_mb"],
                                     {"last_flag": "error_occurred"}))


@query("error_summary", with_views(TEL) + """, e AS (SELECT component AS category, CASE WHEN duration_ms > 100 THEN 'high' ELSE 'low' END AS severity
    FROM v_tel WHERE error_occurred ORDER BY secs DESC, event_id DESC LIMIT 10)
  SELECT CASE WHEN grouping(category) = 1 THEN 'ALL' ELSE category END AS category,
    CASE WHEN grouping(severity) = 1 THEN 'ALL' ELSE severity END AS severity, count(*) AS n,
    (SELECT count_if(error_occurred)::BIGINT FROM v_tel) AS total_errors, (SELECT arg_max(event_id, (secs, event_id)) FROM v_tel WHERE error_occurred) AS most_recent
  FROM e GROUP BY ROLLUP (category, severity)""")
def error_summary(spark: SparkSession, d: str) -> DataFrame:
    errors = views.telemetry(spark, d).filter("error_occurred").select(
        "at", "event_id", F.col("component").alias("category"),
        F.when(F.col("duration_ms") > 100, "high").otherwise("low").alias("severity"))
    return tm.error_summary(errors)


@query("stage_report", with_views(TEL) + """, g AS (SELECT component, operation, CASE WHEN sum(duration_ms) > 4000 THEN 'completed' ELSE 'running' END AS status,
    count(*) AS items, count_if(error_occurred)::BIGINT AS errors, sum(duration_ms) / 1000 AS seconds FROM v_tel GROUP BY 1, 2)
  SELECT component, count(*) AS stages, round(sum(seconds), 6) AS total_seconds, sum(items)::BIGINT AS total_items,
    sum(errors)::BIGINT AS total_errors, round(sum(items) / greatest(sum(items) + sum(errors), 1)::DOUBLE, 6) AS success_rate,
    round(sum(items) / greatest(sum(seconds), 0.001::DOUBLE), 6) AS items_per_second,
    round(100 * count_if(status = 'completed') / count(*)::DOUBLE, 6) AS completion_pct FROM g GROUP BY component""")
def stage_report(spark: SparkSession, d: str) -> DataFrame:
    stages = views.telemetry(spark, d).groupBy("component", "operation").agg(
        F.count("*").alias("items"), F.count_if("error_occurred").alias("errors"),
        (F.sum("duration_ms") / 1000).alias("seconds"),
        F.when(F.sum("duration_ms") > 4000, "completed").otherwise("running").alias("status"))
    return rounded(tm.stage_report(stages, ["component"]))


@query("system_status", with_views(TEL) + """, c AS (SELECT component, count_if(event_id % 997 = 0)::BIGINT AS critical,
    count_if(event_id % 997 <> 0 AND event_id % 211 = 0)::BIGINT AS error, count_if(event_id % 997 <> 0 AND event_id % 211 <> 0)::BIGINT AS warning,
    0::BIGINT AS info, avg(CASE WHEN error_occurred THEN 1 ELSE 0 END) AS error_rate, max(duration_ms > 1) AS initialised,
    avg(duration_ms) AS avg_ms, max(duration_ms > 489) AS recent_error FROM v_tel GROUP BY component),
  s AS (SELECT *, CASE WHEN critical > 0 THEN 'critical' WHEN error > 0 THEN 'degraded' WHEN warning > 0 THEN 'warning' ELSE 'healthy' END AS overall_health,
    CASE WHEN NOT initialised THEN 0.5::DOUBLE ELSE 1 END * CASE WHEN error_rate > 0.1::DOUBLE THEN 0.8::DOUBLE ELSE 1 END
    * CASE WHEN avg_ms > 200 THEN 0.9::DOUBLE ELSE 1 END * CASE WHEN recent_error THEN 0.7::DOUBLE ELSE 1 END AS hs FROM c)
  SELECT component, critical, error, warning, info, overall_health, round(hs, 6) AS health_score,
    CASE WHEN hs > 0.8::DOUBLE THEN 'HEALTHY' WHEN hs > 0.5::DOUBLE THEN 'DEGRADED' ELSE 'UNHEALTHY' END AS health_status FROM s""")
def system_status(spark: SparkSession, d: str) -> DataFrame:
    df = views.telemetry(spark, d).withColumns({
        "severity": F.when(F.col("event_id") % 997 == 0, "critical").when(F.col("event_id") % 211 == 0, "error")
        .otherwise("warning"), "initialised": F.col("duration_ms") > 1, "recent_error": F.col("duration_ms") > 489})
    return rounded(tm.system_status(df, KEYS).select(
        "component", "critical", "error", "warning", "info", "overall_health", "health_score", "health_status"))


@query("failures_cube", with_views(TEL) + """SELECT CASE WHEN grouping(component) = 1 THEN 'ALL' ELSE component END AS component,
  CASE WHEN grouping(operation) = 1 THEN 'ALL' ELSE operation END AS operation, count(*) AS n, count_if(duration_ms > 150)::BIGINT AS failures
  FROM v_tel GROUP BY CUBE (component, operation)""")
def failures_cube(spark: SparkSession, d: str) -> DataFrame:
    df = views.telemetry(spark, d).select("component", "operation", (F.col("duration_ms") > 150).alias("failed"))
    return tm.failures_cube(df, ["component", "operation"])


# --- order-dependent ------------------------------------------------------------------------------
W = "OVER (PARTITION BY component ORDER BY secs, event_id{frame})"


@query("rolling10", with_views(TEL) + f"""SELECT component, event_id, round(avg(duration_ms) {W.format(frame=' ROWS 9 PRECEDING')}, 6) AS avg_ms,
  round(avg(memory_mb) {W.format(frame=' ROWS 9 PRECEDING')}, 6) AS avg_mb,
  round(avg(CASE WHEN error_occurred THEN 1 ELSE 0 END) {W.format(frame=' ROWS 9 PRECEDING')}, 6) AS error_rate FROM v_tel""")
def rolling10(spark: SparkSession, d: str) -> DataFrame:
    df = views.telemetry(spark, d).withColumn("error", F.when(F.col("error_occurred"), 1.0).otherwise(0.0))
    out = tm.rolling_means(df, KEYS, {"avg_ms": "duration_ms", "avg_mb": "memory_mb", "error_rate": "error"})
    return rounded(out.select("component", "event_id", "avg_ms", "avg_mb", "error_rate"))


@query("baseline10", with_views(TEL) + f""", r AS (SELECT *, row_number() {W.format(frame='')} AS r FROM v_tel)
  SELECT component, round(avg(duration_ms), 6) AS baseline_ms, round(avg(memory_mb), 6) AS baseline_mb FROM r WHERE r <= 10
  GROUP BY component HAVING count(*) >= 10""")
def baseline10(spark: SparkSession, d: str) -> DataFrame:
    return rounded(tm.baseline(views.telemetry(spark, d), KEYS, {"baseline_ms": "duration_ms", "baseline_mb": "memory_mb"}))


@query("last_n", with_views(TEL) + """, r AS (SELECT *, row_number() OVER (PARTITION BY component ORDER BY secs DESC, event_id DESC) AS age FROM v_tel)
  SELECT component, event_id, duration_ms, age FROM r WHERE age <= 100""")
def last_n(spark: SparkSession, d: str) -> DataFrame:
    return tm.last_rows(views.telemetry(spark, d), KEYS, 100).select(
        "component", "event_id", "duration_ms", F.col("age").cast("bigint").alias("age"))


@query("trend_slope", with_views(TEL) + """, r AS (SELECT *, row_number() OVER (PARTITION BY component ORDER BY secs DESC, event_id DESC) AS age FROM v_tel)
  SELECT component, round(CASE WHEN count(*) >= 5 THEN regr_slope(duration_ms, -age) ELSE 0 END, 6) AS slope FROM r WHERE age <= 100 GROUP BY component""")
def trend_slope(spark: SparkSession, d: str) -> DataFrame:
    late = tm.last_rows(views.telemetry(spark, d), KEYS, 100)
    return rounded(late.groupBy("component").agg(tm.trend(F.col("duration_ms"), F.col("age")).alias("slope")))


DEGRADED = """, a AS (SELECT *, memory_mb * 20 AS mb, row_number() OVER (PARTITION BY component ORDER BY secs, event_id) AS r,
    row_number() OVER (PARTITION BY component ORDER BY secs DESC, event_id DESC) AS age FROM v_tel),
  g AS (SELECT component, count(*) AS n, avg(CASE WHEN r <= 10 THEN duration_ms END) AS base, avg(CASE WHEN age <= 10 THEN duration_ms END) AS ms,
    avg(CASE WHEN age <= 10 THEN mb END) AS mb, avg(CASE WHEN age <= 10 THEN CASE WHEN error_occurred THEN 1 ELSE 0 END END) AS er,
    regr_slope(CASE WHEN age <= 100 THEN duration_ms END, -age) AS tr, regr_slope(CASE WHEN age <= 100 THEN mb END, -age) AS ct FROM a GROUP BY component),
  f AS (SELECT *, list_filter([CASE WHEN ms > 1.5::DOUBLE * base THEN 'processing time increased' END, CASE WHEN mb > 1000 THEN 'high memory usage' END,
    CASE WHEN tr < -0.1::DOUBLE THEN 'accuracy declining' END, CASE WHEN ct < -0.1::DOUBLE THEN 'confidence declining' END, CASE WHEN er > 0.1::DOUBLE THEN 'high error rate' END], lambda x: x IS NOT NULL) AS rs FROM g)"""


@query("degradation", with_views(TEL) + DEGRADED + """ SELECT component, round(ms, 6) AS avg_ms, round(base, 6) AS baseline_ms, round(mb, 6) AS avg_mb,
  round(er, 6) AS error_rate, round(tr, 6) AS accuracy_trend, round(ct, 6) AS confidence_trend, array_to_string(rs, '; ') AS reasons, len(rs) > 0 AS is_degraded FROM f""")
def degradation(spark: SparkSession, d: str) -> DataFrame:
    df = views.telemetry(spark, d).withColumn("memory_mb", F.col("memory_mb") * 20)
    out = tm.degradation(df, KEYS, accuracy="duration_ms", confidence="memory_mb")
    return rounded(out.withColumn("reasons", as_text("reasons")))


@query("recent_error", with_views(TEL) + """, e AS (SELECT event_id, component, secs, secs - lag(secs) OVER (PARTITION BY component ORDER BY secs, event_id) AS s
    FROM v_tel WHERE error_occurred) SELECT event_id, component, round(s, 6) AS since_previous, coalesce(s < 300, FALSE) AS recent_error FROM e""")
def recent_error(spark: SparkSession, d: str) -> DataFrame:
    errors = views.telemetry(spark, d).filter("error_occurred").select("event_id", "component", "at")
    out = tm.previous_event(errors, KEYS)
    return rounded(out.select("event_id", "component", "since_previous", F.coalesce(
        F.col("since_previous") < tm.RECENT_ERROR_SECONDS, F.lit(False)).alias("recent_error")))


@query("slow_ops", with_views(TEL) + """SELECT event_id, duration_ms * 40 > 8000 AS over_target, duration_ms * 40 > 5000 AS slow,
  duration_ms * 40 > 10000 AS very_slow FROM v_tel""")
def slow_ops(spark: SparkSession, d: str) -> DataFrame:
    df = tm.speed_flags(views.telemetry(spark, d).withColumn("duration_ms", F.col("duration_ms") * 40), 8000.0)
    return df.select("event_id", "over_target", "slow", "very_slow")


# --- windows --------------------------------------------------------------------------------------
WINDOW_COLS = """count(*) AS n, count_if(error_occurred)::BIGINT AS errors, round(avg(duration_ms), 6) AS avg_duration_ms,
  max(duration_ms) AS max_ms, round(avg(memory_mb), 6) AS avg_mb"""


@query("tumbling_summary", with_views(TEL) + f"""SELECT (floor(secs / 3600) * 3600)::BIGINT AS window_start, component, {WINDOW_COLS}
  FROM v_tel GROUP BY 1, 2""")
def tumbling_summary(spark: SparkSession, d: str) -> DataFrame:
    out = tm.window_summary(views.telemetry(spark, d), KEYS, "1 hour")
    return rounded(out.select(start_seconds(), *[c for c in out.columns if c != "window"]))


@query("sliding_summary", with_views(TEL) + f"""SELECT (floor(secs / 60) * 60 - 60 * k)::BIGINT AS window_start, component, {WINDOW_COLS}
  FROM v_tel, unnest(range(0, 10)) AS t(k) GROUP BY 1, 2""")
def sliding_summary(spark: SparkSession, d: str) -> DataFrame:
    out = tm.sliding_summary(views.telemetry(spark, d), KEYS, "10 minutes", "1 minute")
    return rounded(out.select(start_seconds(), *[c for c in out.columns if c != "window"]))


@query("session_summary", with_views(TEL) + """, m AS (SELECT *, CASE WHEN secs - lag(secs) OVER (PARTITION BY component ORDER BY secs, event_id) < 1800 THEN 0 ELSE 1 END AS s
    FROM v_tel), n AS (SELECT *, sum(s) OVER (PARTITION BY component ORDER BY secs, event_id ROWS UNBOUNDED PRECEDING) AS session FROM m)
  SELECT component, session::BIGINT AS session, count(*) AS n, round(min(secs), 6) AS first_at, round(max(secs), 6) AS last_at,
    count_if(error_occurred)::BIGINT AS errors, round(avg(duration_ms), 6) AS avg_ms FROM n GROUP BY 1, 2""")
def session_summary(spark: SparkSession, d: str) -> DataFrame:
    return rounded(tm.sessions(views.telemetry(spark, d), "component", 1800.0))


# --- alerts ---------------------------------------------------------------------------------------
METRICS = """v_met AS (SELECT (floor(secs / 3600) * 3600)::BIGINT AS secs, component, max(memory_mb) AS cpu_usage_percent,
  avg(memory_mb) * 1.4::DOUBLE AS memory_usage_percent, count_if(error_occurred) / count(*)::DOUBLE AS error_rate,
  avg(duration_ms) * 100 AS avg_duration_ms, max(memory_mb) AS gpu_memory_used_mb, 100::DOUBLE AS gpu_memory_total_mb FROM v_tel GROUP BY 1, 2)"""
_TEXTS = ", ".join("('{}', '{}', '{}', '{}')".format(r.rule_id, r.title, r.alert_type, "; ".join(r.actions)) for r in tm.ALERT_RULES)
FIRED = f"""v_text AS (SELECT * FROM (VALUES {_TEXTS}) AS t(rule_id, title, alert_type, actions)),
v_fired AS (SELECT m.secs, m.component, r.rule_id, r.severity, r.message, title, alert_type, actions,
    alert_type || '_' || r.severity || '_' || m.secs::VARCHAR AS alert_id FROM v_met m, LATERAL (VALUES
  ('cpu_high', 'warning', cpu_usage_percent > 85, printf('CPU usage is %.1f%%, exceeding 85%% threshold', round(round(cpu_usage_percent, 6), 1))),
  ('memory_high', 'warning', memory_usage_percent > 85, printf('Memory usage is %.1f%%, exceeding 85%% threshold', round(round(memory_usage_percent, 6), 1))),
  ('memory_critical', 'critical', memory_usage_percent > 95, printf('Memory usage is %.1f%%, system may become unstable', round(round(memory_usage_percent, 6), 1))),
  ('error_rate_high', 'error', error_rate > 0.1::DOUBLE, printf('Error rate is %.1f%%, exceeding 10%% threshold', round(round(error_rate * 100, 6), 1))),
  ('slow', 'warning', avg_duration_ms > 10000, printf('Average operation time is %.0fms, exceeding 10s threshold', round(round(avg_duration_ms, 6), 0))),
  ('gpu_memory', 'error', gpu_memory_used_mb / gpu_memory_total_mb > 0.9::DOUBLE,
   printf('GPU memory usage is %.1f%%, exceeding 90%% threshold', round(round(100 * gpu_memory_used_mb / gpu_memory_total_mb, 6), 1))))
  AS r(rule_id, severity, hit, message) JOIN v_text USING (rule_id) WHERE r.hit)"""


def metrics(spark: SparkSession, d: str) -> DataFrame:
    """Hourly metrics row per component, as the alert rules read it."""
    df = views.telemetry(spark, d)
    return df.groupBy((F.floor(F.col("at") / 3600) * 3600).alias("at"), "component").agg(
        F.max("memory_mb").alias("cpu_usage_percent"), (F.avg("memory_mb") * 1.4).alias("memory_usage_percent"),
        (F.count_if("error_occurred") / F.count("*")).alias("error_rate"),
        (F.avg("duration_ms") * 100).alias("avg_duration_ms"), F.max("memory_mb").alias("gpu_memory_used_mb"),
        F.lit(100.0).alias("gpu_memory_total_mb"), F.lit(True).alias("gpu_available"))


@query("alert_rules", with_views(TEL, METRICS, FIRED) + """SELECT secs, component, rule_id, alert_type, severity, title, message, actions, alert_id,
  round(v_met.error_rate, 6) AS error_rate FROM v_fired JOIN v_met USING (secs, component)""")
def alert_rules(spark: SparkSession, d: str) -> DataFrame:
    return tm.alerts(metrics(spark, d), tm.ALERT_RULES, ["at", "component"]) \
        .select(F.col("at").alias("secs"), "component", "rule_id", "alert_type", "severity", "title", "message",
                as_text("actions").alias("actions"), "alert_id", F.round(F.element_at("metrics", "error_rate"), 6).alias("error_rate"))


_ISSUES, _ADVICE = (", ".join(f"CASE WHEN {sql} THEN '{rule[k]}' END" for sql, rule in zip(
    ("NOT initialised", "error_rate > 0.1::DOUBLE", "avg_ms > 200", "recent_error"), tm.HEALTH_ISSUES)) for k in (2, 3))


@query("system_health", with_views(TEL, METRICS, FIRED) + f""", c AS (SELECT component, max(duration_ms > 1) AS initialised, avg(duration_ms) AS avg_ms,
    avg(CASE WHEN error_occurred THEN 1 ELSE 0 END) AS error_rate,
    max(error_occurred AND secs >= (SELECT max(secs) - 300 FROM v_tel)) AS recent_error FROM v_tel GROUP BY component),
  f AS (SELECT component, count_if(severity = 'critical') AS critical, count_if(severity = 'error') AS error, count_if(severity = 'warning') AS warning,
    count_if(severity = 'info') AS info FROM v_fired GROUP BY component),
  s AS (SELECT c.*, coalesce(critical, 0)::BIGINT AS critical, coalesce(error, 0)::BIGINT AS error, coalesce(warning, 0)::BIGINT AS warning, coalesce(info, 0)::BIGINT AS info,
    CASE WHEN NOT initialised THEN 0.5::DOUBLE ELSE 1 END * CASE WHEN error_rate > 0.1::DOUBLE THEN 0.8::DOUBLE ELSE 1 END
    * CASE WHEN avg_ms > 200 THEN 0.9::DOUBLE ELSE 1 END * CASE WHEN recent_error THEN 0.7::DOUBLE ELSE 1 END AS hs FROM c LEFT JOIN f USING (component))
  SELECT component, critical, error, warning, info, CASE WHEN critical > 0 THEN 'critical' WHEN error > 0 THEN 'degraded' WHEN warning > 0 THEN 'warning'
    ELSE 'healthy' END AS overall_health, round(hs, 6) AS health_score, CASE WHEN hs > 0.8::DOUBLE THEN 'HEALTHY' WHEN hs > 0.5::DOUBLE THEN 'DEGRADED' ELSE 'UNHEALTHY' END AS health_status,
    array_to_string(list_filter([{_ISSUES}], lambda x: x IS NOT NULL), '; ') AS issues,
    array_to_string(list_filter([{_ADVICE}], lambda x: x IS NOT NULL), '; ') AS recommendations FROM s""")
def system_health(spark: SparkSession, d: str) -> DataFrame:
    """Health of each component from its own alerts; an error is recent in the last five minutes of all telemetry."""
    df = views.telemetry(spark, d)
    latest = df.agg(F.max("at")).first()[0]
    stats = df.groupBy("component").agg(
        F.max(F.col("duration_ms") > 1).alias("initialised"), F.avg("duration_ms").alias("avg_ms"),
        F.avg(F.when(F.col("error_occurred"), 1.0).otherwise(0.0)).alias("error_rate"),
        F.max(F.col("error_occurred") & (F.col("at") >= F.lit(latest) - tm.RECENT_ERROR_SECONDS)).alias("recent_error"))
    out = tm.system_health(stats, tm.alerts(metrics(spark, d), tm.ALERT_RULES, ["at", "component"]), KEYS)
    return rounded(out.select("component", "critical", "error", "warning", "info", "overall_health", "health_score", "health_status",
                              as_text("issues").alias("issues"), as_text("recommendations").alias("recommendations")))


@query("alert_cooldown", with_views(TEL, METRICS, FIRED).replace("WITH ", "WITH RECURSIVE ", 1) + """, t AS (SELECT rule_id, secs, count(*) AS alerts, min(component) AS component, arg_min(message, component) AS message,
    min(severity) AS severity, min(alert_id) AS alert_id FROM v_fired GROUP BY 1, 2),
  j AS (SELECT rule_id, secs, min(secs) OVER (PARTITION BY rule_id ORDER BY secs RANGE BETWEEN 7200 FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt FROM t),
  chain AS (SELECT rule_id, min(secs) AS secs FROM t GROUP BY rule_id UNION ALL
    SELECT c.rule_id, j.nxt FROM chain c JOIN j ON j.rule_id = c.rule_id AND j.secs = c.secs WHERE j.nxt IS NOT NULL)
  SELECT rule_id, secs, alerts, component, message, severity, alert_id FROM chain JOIN t USING (rule_id, secs)""")
def alert_cooldown(spark: SparkSession, d: str) -> DataFrame:
    fired = tm.alerts(metrics(spark, d), tm.ALERT_RULES, ["at", "component"])
    return tm.cooled_down(fired, ["rule_id"], minutes=120).select(
        "rule_id", F.col("at").alias("secs"), "alerts", "component", "message", "severity", "alert_id")


@query("active_alerts", with_views(TEL, METRICS, FIRED) + """SELECT component, rule_id, count(*) AS n FROM v_fired v
  WHERE NOT EXISTS (SELECT 1 FROM events e WHERE e.event_type = 'purchase' AND floor(epoch_us(e.ts) / 1000000 / 3600) * 3600 = v.secs) GROUP BY 1, 2""")
def active_alerts(spark: SparkSession, d: str) -> DataFrame:
    history = tm.alerts(metrics(spark, d), tm.ALERT_RULES, ["at", "component"]).withColumnRenamed("at", "alert_id")
    seen = views.telemetry(spark, d).filter(F.col("operation") == "purchase") \
        .select((F.floor(F.col("at") / 3600) * 3600).alias("alert_id"))
    return tm.active_alerts(history, seen).groupBy("component", "rule_id").agg(F.count("*").alias("n"))


@query("recent_duplicate", with_views(TEL) + """, q AS (SELECT event_id, component, secs FROM v_tel WHERE operation <> 'purchase'),
  c AS (SELECT event_id, component, secs FROM v_tel WHERE operation = 'purchase'),
  j AS (SELECT q.event_id, q.component, q.secs, c.event_id AS hit, c.secs AS hit_at FROM q ASOF LEFT JOIN c ON q.component = c.component AND q.secs >= c.secs)
  SELECT event_id, component, CASE WHEN secs - hit_at < 3600 THEN hit END AS reuse_of FROM j""")
def recent_duplicate(spark: SparkSession, d: str) -> DataFrame:
    df = views.telemetry(spark, d).select("event_id", "component", "at", "operation")
    results = df.filter(F.col("operation") == "purchase").drop("operation")
    requests = df.filter(F.col("operation") != "purchase").drop("operation")
    return joins.recent_duplicate(requests, results, "component", "at", "event_id", 3600.0) \
        .select("event_id", "component", "reuse_of")


# --- rule texts -----------------------------------------------------------------------------------
RULES = [("error_rate", ">", 0.15, "check input data quality and resources"), ("avg_ms", ">", 75.0, "consider faster hardware"),
         ("avg_ms", "<", 10.0, "latency is excellent"), ("n", "<", 1500.0, "collect more telemetry"),
         ("error_rate", "<=", 0.25, "error level acceptable"), ("n", ">=", 100.0, "enough data for trends")]


@query("recommend", with_views(TEL) + """, m AS (SELECT t.metric, t.value FROM (SELECT operation, count(*)::DOUBLE AS n, avg(duration_ms) AS avg_ms,
    avg(CASE WHEN error_occurred THEN 1 ELSE 0 END) AS error_rate FROM v_tel GROUP BY operation), LATERAL (VALUES ('n', n), ('avg_ms', avg_ms),
    ('error_rate', error_rate)) AS t(metric, value)),
  r AS (SELECT * FROM (VALUES """ + ", ".join(f"('{m}', '{o}', {t}::DOUBLE, '{x}')" for m, o, t, x in RULES) + """) AS r(metric, op, threshold, text))
  SELECT DISTINCT text FROM m JOIN r USING (metric) WHERE CASE op WHEN '<' THEN value < threshold WHEN '>' THEN value > threshold
    WHEN '<=' THEN value <= threshold WHEN '>=' THEN value >= threshold END""")
def recommend(spark: SparkSession, d: str) -> DataFrame:
    per = views.telemetry(spark, d).groupBy("operation").agg(
        F.count("*").cast("double").alias("n"), F.avg("duration_ms").alias("avg_ms"),
        F.avg(F.when(F.col("error_occurred"), 1.0).otherwise(0.0)).alias("error_rate"))
    long = per.select(F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value"))
                                         for m in ("n", "avg_ms", "error_rate")])))
    return joins.recommend(long, RULES)
