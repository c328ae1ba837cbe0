"""Operation telemetry: summaries, rolling checks, degradation, alerts with cool-down."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.chains import keep_chosen
from tidemark.operators.evaluation import ratio
from tidemark.operators.ranking import first_per_key, null_safe_join, order_statistic, rolling, running, with_chunks
from tidemark.sources.tables import pin

# Fixed values of the monitoring rules.
WARN_MS, ALERT_MS, TARGET_MS = 5_000.0, 10_000.0, 200.0
BASELINE_ROWS, ROLLING_ROWS, TREND_ROWS, MIN_TREND_ROWS = 10, 10, 100, 5
SLOWDOWN, MEMORY_LIMIT_MB, TREND_LIMIT, ERROR_LIMIT = 1.5, 1000.0, -0.1, 0.1
P95_MIN_ROWS = 20
RECENT_ERROR_SECONDS = 300
COOLDOWN_MINUTES, TICK_SECONDS = 15, 60


@dataclass(frozen=True)
class AlertRule:
    """A rule is a SQL predicate over a metrics row, with the alert's kind and wording.

    ``message`` is a format with one place, filled by the SQL expression ``shown``; numbers are rounded to six digits
    first, so that noise in the last bits does not decide a tie.
    """
    rule_id: str
    alert_type: str
    severity: str
    condition: str
    title: str
    message: str = ""
    shown: str = "''"
    actions: tuple[str, ...] = ()


# The six standard alert rules.
ALERT_RULES = [
    AlertRule("cpu_high", "resource_exhaustion", "warning", "cpu_usage_percent > 85", "High CPU Usage Detected",
              "CPU usage is %.1f%%, exceeding 85%% threshold", "round(round(cpu_usage_percent, 6), 1)",
              ("Check for runaway processes", "Consider scaling up compute resources",
               "Review recent code changes for performance issues")),
    AlertRule("memory_high", "resource_exhaustion", "warning", "memory_usage_percent > 85", "High Memory Usage Detected",
              "Memory usage is %.1f%%, exceeding 85%% threshold", "round(round(memory_usage_percent, 6), 1)",
              ("Check for memory leaks", "Clear GPU cache if using CUDA", "Restart the application",
               "Consider increasing available memory")),
    AlertRule("memory_critical", "resource_exhaustion", "critical", "memory_usage_percent > 95", "Critical Memory Usage",
              "Memory usage is %.1f%%, system may become unstable", "round(round(memory_usage_percent, 6), 1)",
              ("Immediately restart the application", "Kill non-essential processes", "Check for memory leaks",
               "Scale up memory resources")),
    AlertRule("error_rate_high", "error_rate_high", "error", "error_rate > 0.1D", "High Error Rate Detected",
              "Error rate is %.1f%%, exceeding 10%% threshold", "round(round(error_rate * 100, 6), 1)",
              ("Check application logs for error patterns", "Verify input data quality",
               "Check model loading and initialization", "Review recent deployments")),
    AlertRule("slow", "performance_degradation", "warning", "avg_duration_ms > 10000", "Performance Degradation Detected",
              "Average operation time is %.0fms, exceeding 10s threshold", "round(round(avg_duration_ms, 6), 0)",
              ("Check system resource usage", "Review recent code changes", "Consider optimizing model inference",
               "Check for network latency issues")),
    AlertRule("gpu_memory", "resource_exhaustion", "error",
              "gpu_available AND gpu_memory_used_mb / greatest(gpu_memory_total_mb, 1) > 0.9D", "GPU Memory Exhaustion",
              "GPU memory usage is %.1f%%, exceeding 90%% threshold", "round(round(100 * gpu_memory_used_mb / greatest(gpu_memory_total_mb, 1), 6), 1)",
              ("Clear GPU cache with torch.cuda.empty_cache()", "Reduce batch size or model size",
               "Switch to CPU processing temporarily", "Restart the application")),
]


def recent(df: DataFrame, as_of: Column, minutes: int, component: str | None = None, operation: str | None = None,
           ts: str = "ts") -> DataFrame:
    """Rows of the last minutes before ``as_of``, optionally of one component or operation (pushed to the scan)."""
    out = df.filter((F.col(ts) >= as_of - F.expr(f"INTERVAL '{int(minutes)}' MINUTE")) & (F.col(ts) <= as_of))
    if component is not None:
        out = out.filter(F.col("component") == component)
    return out if operation is None else out.filter(F.col("operation") == operation)


def latency_stats(df: DataFrame, by: Sequence[str], target_ms: float = TARGET_MS) -> DataFrame:
    """Latency statistics and the share within the target."""
    t = F.col("duration_ms")
    return df.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg(t).alias("avg_ms"), F.min(t).alias("min_ms"), F.max(t).alias("max_ms"),
        F.stddev_pop(t).alias("std_ms"), (100 * ratio(F.count_if(t <= target_ms), F.count("*"))).alias("within_target_pct"))


def positional_p95(df: DataFrame, by: Sequence[str], value: str = "duration_ms", name: str = "p95_ms") -> DataFrame:
    """``sorted[int(0.95 n)]`` when a group has more than 20 rows, else its maximum."""
    def position(n: Column) -> Column:
        return F.when(n > P95_MIN_ROWS, F.floor(n * F.lit(0.95))).otherwise(n - 1)
    return order_statistic(df, by, value, position, name)


def perf_summary(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Operation counts, error rate, duration and memory statistics, positional p95 and time range."""
    t, m = F.col("duration_ms"), F.col("memory_mb")
    main = df.groupBy(*by).agg(
        F.count("*").alias("n"), F.count_if("error_occurred").alias("errors"),
        ratio(F.count_if("error_occurred"), F.count("*")).alias("error_rate"), F.min(t).alias("min_ms"),
        F.max(t).alias("max_ms"), F.avg(t).alias("avg_ms"), F.min(m).alias("min_mb"), F.max(m).alias("max_mb"),
        F.avg(m).alias("avg_mb"), F.min("at").alias("first_at"), F.max("at").alias("last_at"))
    return null_safe_join(main, positional_p95(df, by), list(by))


def health_summary(df: DataFrame, by: Sequence[str], gauges: Sequence[str], last: dict[str, str]) -> DataFrame:
    """Min, max and mean of each gauge and the latest value of the columns in ``last`` (by ``at``, then id)."""
    return df.groupBy(*by).agg(
        F.count("*").alias("n"),
        *[x for g in gauges for x in (F.min(g).alias(f"{g}_min"), F.max(g).alias(f"{g}_max"), F.avg(g).alias(f"{g}_avg"))],
        *[F.max_by(c, F.struct("at", "event_id")).alias(o) for o, c in last.items()])


def error_summary(df: DataFrame, last_n: int = 10) -> DataFrame:
    """Counts by category and severity over the latest errors, with subtotals (``ALL``); the total of all errors and the latest one."""
    latest = df.orderBy(F.desc("at"), F.desc("event_id")).limit(last_n)
    whole = df.agg(F.count("*").alias("total_errors"), F.max_by("event_id", F.struct("at", "event_id")).alias("most_recent"))
    one = F.lit(1).alias("_k")      # one row beside the few subtotals
    return _latest_counts(latest).withColumn("_k", one).join(F.broadcast(whole.withColumn("_k", one)), "_k").drop("_k")


def _latest_counts(latest: DataFrame) -> DataFrame:
    return latest.rollup("category", "severity").agg(F.count("*").alias("n"), F.grouping_id().alias("_g")).select(
        F.when(F.col("_g") < 3, F.col("category")).otherwise("ALL").alias("category"),
        F.when(F.col("_g") < 1, F.col("severity")).otherwise("ALL").alias("severity"), "n")


def stage_report(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Stages, duration, items, errors, success and processing rate with guarded divisions."""
    items, errors, seconds = F.sum("items"), F.sum("errors"), F.sum("seconds")
    return df.groupBy(*by).agg(
        F.count("*").alias("stages"), seconds.alias("total_seconds"), items.alias("total_items"),
        errors.alias("total_errors"), (items / F.greatest(items + errors, F.lit(1))).alias("success_rate"),
        (items / F.greatest(seconds, F.lit(0.001))).alias("items_per_second"),
        (100 * ratio(F.count_if(F.col("status") == "completed"), F.count("*"))).alias("completion_pct"))


def system_status(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Alert counts by severity, the resulting state, and the multiplicative health score."""
    counts = df.groupBy(*by).agg(
        *[F.count_if(F.col("severity") == s).alias(s) for s in ("critical", "error", "warning", "info")],
        F.avg(F.when(F.col("error_occurred"), 1.0).otherwise(0.0)).alias("error_rate"),
        F.max("initialised").alias("initialised"), F.avg("duration_ms").alias("avg_ms"),
        F.max("recent_error").alias("recent_error"))

    def factor(cond: Column, f: float) -> Column:
        return F.when(cond, f).otherwise(1.0)
    state = (F.when(F.col("critical") > 0, "critical").when(F.col("error") > 0, "degraded")
             .when(F.col("warning") > 0, "warning").otherwise("healthy"))
    score = factor(~F.col("initialised"), 0.5) * factor(F.col("error_rate") > 0.1, 0.8) \
        * factor(F.col("avg_ms") > TARGET_MS, 0.9) * factor(F.col("recent_error"), 0.7)
    return counts.withColumns({"overall_health": state, "health_score": score}).withColumn(
        "health_status", F.when(F.col("health_score") > 0.8, "HEALTHY").when(F.col("health_score") > 0.5, "DEGRADED")
        .otherwise("UNHEALTHY"))


# What lowers the health score, by how much, and the texts for it.
HEALTH_ISSUES = (
    ("not initialised", 0.5, "Not all components initialized", "Restart pipeline or check component initialization"),
    ("error_rate > 0.1D", 0.8, "High error rate detected", "Check input data quality and system resources"),
    (f"avg_ms > {TARGET_MS}D", 0.9, "Not meeting real-time performance requirements", "Consider optimizing configuration or upgrading hardware"),
    ("recent_error", 0.7, "Recent errors detected", "Monitor error logs and check system stability"))


def system_health(stats: DataFrame, fired: DataFrame, by: Sequence[str]) -> DataFrame:
    """Health of each ``by`` from its numbers and its alerts: counts by severity, state, score, issues and recommendations.

    ``stats`` has one row per ``by`` with initialised, error_rate, avg_ms and recent_error; ``fired`` has a severity per alert.
    Without alerts a row counts none.
    """
    severities = ("critical", "error", "warning", "info")
    counts = fired.groupBy(*by).agg(*[F.count_if(F.col("severity") == s).alias(s) for s in severities])
    joined = null_safe_join(stats, counts, by, "left").withColumns({s: F.coalesce(s, F.lit(0)) for s in severities})
    state = (F.when(F.col("critical") > 0, "critical").when(F.col("error") > 0, "degraded").when(F.col("warning") > 0, "warning").otherwise("healthy"))
    score = F.lit(1.0)
    for condition, factor, _, _ in HEALTH_ISSUES:
        score = score * F.when(F.expr(condition), factor).otherwise(1.0)
    texts = [F.array_compact(F.array(*[F.when(F.expr(rule[0]), F.lit(rule[k])) for rule in HEALTH_ISSUES])) for k in (2, 3)]
    status = F.when(F.col("health_score") > 0.8, "HEALTHY").when(F.col("health_score") > 0.5, "DEGRADED").otherwise("UNHEALTHY")
    return joined.withColumns({"overall_health": state, "health_score": score, "issues": texts[0], "recommendations": texts[1]}).withColumn("health_status", status)


def failures_cube(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Failures by every combination of the attributes, ``ALL`` for totals."""
    cube = df.cube(*columns).agg(F.count("*").alias("n"), F.count_if("failed").alias("failures"),
                                 *[F.grouping(c).alias(f"_g{i}") for i, c in enumerate(columns)])
    return cube.select(*[F.when(F.col(f"_g{i}") == 1, "ALL").otherwise(F.col(c)).alias(c) for i, c in enumerate(columns)],
                       "n", "failures")


def rolling_means(df: DataFrame, keys: Sequence[str], columns: dict[str, str], rows: int = ROLLING_ROWS) -> DataFrame:
    """Mean of the last rows (the current one included) per key in time order."""
    def mean(c: str):
        return lambda w: F.avg(c).over(w.rowsBetween(-(rows - 1), 0))
    return rolling(df, keys, ["at", "event_id"], rows - 1, {o: mean(c) for o, c in columns.items()})


def previous_event(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Seconds since the previous event of the key."""
    return rolling(df, keys, ["at", "event_id"], 1, {"since_previous": lambda w: F.col("at") - F.lag("at").over(w)})


def baseline(df: DataFrame, keys: Sequence[str], columns: dict[str, str], rows: int = BASELINE_ROWS) -> DataFrame:
    """Mean of the first rows of each key (only keys that have that many)."""
    first = first_per_key(df, keys, [F.col("at"), F.col("event_id")], rows)
    return first.groupBy(*keys).agg(F.count("*").alias("_n"), *[F.avg(c).alias(o) for o, c in columns.items()]) \
        .filter(F.col("_n") >= rows).drop("_n")


def last_rows(df: DataFrame, keys: Sequence[str], rows: int, rank: str = "age") -> DataFrame:
    """The latest rows of each key; ``age`` 1 is the newest."""
    return first_per_key(df, keys, [F.desc("at"), F.desc("event_id")], rows, rank=rank)


def trend(value: Column, age: Column) -> Column:
    """Least-squares slope of a value over its position in time (newest has age 1); 0 below five values."""
    return F.when(F.count(value) >= MIN_TREND_ROWS, F.coalesce(F.regr_slope(value, -age), F.lit(0.0))).otherwise(0.0)


def degradation(df: DataFrame, keys: Sequence[str], *, accuracy: str | None = None, confidence: str | None = None) -> DataFrame:
    """Is a component getting worse: recent means against the baseline and fixed limits, with reasons.

    Only the first 10 and the last 100 rows of a key matter; both are cut down
    before the shuffle, so a busy component costs no more than a quiet one.
    """
    late = last_rows(df, keys, TREND_ROWS)
    now = F.col("age") <= ROLLING_ROWS
    acc, conf = (F.col(c) if c else F.lit(None).cast("double") for c in (accuracy, confidence))
    recent_means = late.groupBy(*keys).agg(
        F.count("*").alias("_rows"), F.avg(F.when(now, F.col("duration_ms"))).alias("avg_ms"),
        F.avg(F.when(now, F.col("memory_mb"))).alias("avg_mb"),
        F.avg(F.when(now, F.when(F.col("error_occurred"), 1.0).otherwise(0.0))).alias("error_rate"),
        trend(acc, F.col("age")).alias("accuracy_trend"), trend(conf, F.col("age")).alias("confidence_trend"))
    early = baseline(df, keys, {"baseline_ms": "duration_ms"})
    both = null_safe_join(recent_means, early, list(keys), "left")
    reasons = F.array_compact(F.array(
        F.when(F.col("avg_ms") > SLOWDOWN * F.col("baseline_ms"), F.lit("processing time increased")),
        F.when(F.col("avg_mb") > MEMORY_LIMIT_MB, F.lit("high memory usage")),
        F.when(F.col("accuracy_trend") < TREND_LIMIT, F.lit("accuracy declining")),
        F.when(F.col("confidence_trend") < TREND_LIMIT, F.lit("confidence declining")),
        F.when(F.col("error_rate") > ERROR_LIMIT, F.lit("high error rate"))))
    enough = F.col("_rows") >= BASELINE_ROWS
    return both.select(
        *keys, "avg_ms", "baseline_ms", "avg_mb", "error_rate", "accuracy_trend", "confidence_trend",
        F.when(enough, reasons).otherwise(F.array(F.lit("insufficient data"))).alias("reasons")) \
        .withColumn("is_degraded", (F.size("reasons") > 0) & ~F.array_contains("reasons", "insufficient data"))


def speed_flags(df: DataFrame, target_ms: float = TARGET_MS) -> DataFrame:
    """Over target, slow (warning) and very slow (alert) flags per event; the same on a stream."""
    t = F.col("duration_ms")
    return df.withColumns({"over_target": t > target_ms, "slow": t > WARN_MS, "very_slow": t > ALERT_MS})


def window_summary(df: DataFrame, by: Sequence[str], size: str, ts: str = "ts") -> DataFrame:
    """Tumbling event-time window summary; batch and stream alike."""
    return _summarise(df.groupBy(F.window(ts, size).alias("window"), *by))


def _summarise(grouped) -> DataFrame:
    return grouped.agg(
        F.count("*").alias("n"), F.count_if("error_occurred").alias("errors"),
        F.avg("duration_ms").alias("avg_duration_ms"), F.max("duration_ms").alias("max_ms"),
        F.avg("memory_mb").alias("avg_mb"))


def sliding_summary(df: DataFrame, by: Sequence[str], size: str, slide: str, ts: str = "ts") -> DataFrame:
    """Sliding event-time window summary.

    On a stream Spark keeps the overlapping windows.  On a table the rows are
    first summed into panes of one slide; only panes, not rows, are then copied
    into the ``size / slide`` windows they belong to (size is a multiple of slide).
    """
    if df.isStreaming:
        return _summarise(df.groupBy(F.window(ts, size, slide).alias("window"), *by))
    panes = df.groupBy(F.window(ts, slide)["start"].alias("_pane"), *by).agg(
        F.count("*").alias("n"), F.count_if("error_occurred").alias("errors"), F.sum("duration_ms").alias("_t"),
        F.count("duration_ms").alias("_tn"), F.max("duration_ms").alias("max_ms"), F.sum("memory_mb").alias("_m"),
        F.count("memory_mb").alias("_mn"))
    return panes.groupBy(F.window("_pane", size, slide).alias("window"), *by).agg(
        F.sum("n").alias("n"), F.sum("errors").alias("errors"),
        F.try_divide(F.sum("_t"), F.sum("_tn")).alias("avg_duration_ms"), F.max("max_ms").alias("max_ms"),
        F.try_divide(F.sum("_m"), F.sum("_mn")).alias("avg_mb"))


def sessions(df: DataFrame, key: str, gap_seconds: float) -> DataFrame:
    """Session summary per key: a new session starts after a silence of at least the gap.

    Session numbers come from chunked windows, so one busy key is not one task.
    """
    order = ["at", "event_id"]
    marked = rolling(with_chunks(df, [key], "at", then="event_id"), [key], order, 1, {
        "_new": lambda w: F.when(F.col("at") - F.lag("at").over(w) < gap_seconds, 0).otherwise(1)})
    numbered = running(marked, [key], order, sums={"session": "_new"}, totals=False)
    return numbered.groupBy(key, "session").agg(
        F.count("*").alias("n"), F.min("at").alias("first_at"), F.max("at").alias("last_at"),
        F.count_if("error_occurred").alias("errors"), F.avg("duration_ms").alias("avg_ms"))


def alerts(metrics: DataFrame, rules: Sequence[AlertRule], carry: Sequence[str], at: str = "at") -> DataFrame:
    """One row per metrics row and rule that fires; rules stay SQL predicates in the plan.

    Each carries its message, suggested actions, id (kind, severity and second of ``at``) and the numeric metrics it was
    raised on.
    """
    numbers = [f.name for f in metrics.schema.fields if f.name not in carry and f.dataType.typeName() in ("double", "float", "long", "integer")]
    seen = F.map_from_arrays(F.array(*[F.lit(n) for n in numbers]), F.array(*[F.col(n).cast("double") for n in numbers])) \
        if numbers else F.create_map().cast("map<string,double>")
    fired = F.array_compact(F.array(*[F.when(F.expr(r.condition), F.struct(
        F.lit(r.rule_id).alias("rule_id"), F.lit(r.alert_type).alias("alert_type"), F.lit(r.severity).alias("severity"),
        F.lit(r.title).alias("title"), F.format_string(r.message, F.expr(r.shown)).alias("message"),
        F.array(*[F.lit(a) for a in r.actions]).cast("array<string>").alias("actions"),
        F.concat(F.lit(f"{r.alert_type}_{r.severity}_"), F.col(at).cast("bigint").cast("string")).alias("alert_id"))) for r in rules]))
    return metrics.select(*carry, seen.alias("metrics"), F.inline(fired))


def cooled_down(fired: DataFrame, keys: Sequence[str], *, at: str = "at", minutes: float = COOLDOWN_MINUTES,
                tick_seconds: int = TICK_SECONDS) -> DataFrame:
    """Alerts that are emitted: the first of a key, then the first one at least ``minutes`` after the last emitted.

    Rules are evaluated once per tick, so alerts first collapse to distinct ticks
    (map-side, with the payload of the first), which bounds a key by the time covered, not by the traffic.  Which ticks
    emit is found by pointer doubling over their successors, so that one key with all rows spreads like any other.
    """
    payload = [c for c in fired.columns if c not in (*keys, at)]
    order = F.struct(*[F.col(c) for c in (at, "alert_id", "component") if c in fired.columns])
    ticks = fired.groupBy(*keys, (F.floor(F.col(at) / tick_seconds) * tick_seconds).alias("at")) \
        .agg(F.count("*").alias("alerts"), *[F.min_by(c, order).alias(c) for c in payload])
    return keep_chosen(pin(ticks), keys, "at", minutes * 60.0)


def active_alerts(history: DataFrame, acknowledged: DataFrame, key: str = "alert_id") -> DataFrame:
    """History minus acknowledged alerts."""
    return history.join(acknowledged.select(key).distinct(), key, "left_anti")
