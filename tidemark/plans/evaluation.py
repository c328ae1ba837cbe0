"""Queries over saved predictions: scores, calibration, model comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.rounding import as_text, rounded
from tidemark.operators import calibration as cal
from tidemark.operators import evaluation as ev
from tidemark.operators import rules
from tidemark.operators.joins import metric_rows, recommend
from tidemark.operators.ranking import running, with_chunks
from tidemark.plans import views
from tidemark.plans.profiling import FIRES, rules_sql
from tidemark.plans.registry import query
from tidemark.plans.views_sql import PRED, with_views
from tidemark.sources.tables import table

CLASSES = [0, 1, 2]

REGRESSION = """SELECT {key} count(*) AS n, round(avg(e), 6) AS mae, round(avg(e * e), 6) AS mse,
  round(sqrt(avg(e * e)), 6) AS rmse, round(1 - sum(e * e) / (count(*) * var_pop(h_true)), 6) AS r2,
  round(100 * count_if(e <= 0.2::DOUBLE) / count(*)::DOUBLE, 6) AS within_02_pct,
  round(100 * count_if(e <= 0.5::DOUBLE) / count(*)::DOUBLE, 6) AS within_05_pct,
  round(CASE WHEN count_if(h_true < 0.5::DOUBLE OR h_true > 8) = 0 THEN 100 ELSE 100 *
    count_if((h_true < 0.5::DOUBLE OR h_true > 8) AND (h_pred < 0.5::DOUBLE OR h_pred > 8))
    / count_if(h_true < 0.5::DOUBLE OR h_true > 8)::DOUBLE END, 6) AS extreme_detection_pct,
  round(quantile_cont(e, 0.5), 6) AS median_abs_error, round(quantile_cont(e, 0.95), 6) AS p95_abs_error
  FROM (SELECT *, abs(h_pred - h_true) AS e FROM v_pred) {group}"""


@query("regression_metrics", with_views(PRED) + REGRESSION.format(key="model,", group="GROUP BY model"))
def regression_metrics(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ev.regression_metrics(views.predictions(spark, d), ["model"], bounded_keys=True))


@query("regression_metrics_all", with_views(PRED) + REGRESSION.format(key="", group=""))
def regression_metrics_all(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ev.regression_metrics(views.predictions(spark, d)))


def class_sql(truth: str, pred: str) -> str:
    return with_views(PRED, f"""cls AS (SELECT unnest([0, 1, 2])::BIGINT AS class),
c AS (SELECT model, class, count(*) AS n, count_if({truth} = {pred}) AS hits,
  count_if({truth} = class AND {pred} = class) AS tp, count_if({pred} = class) AS pp, count_if({truth} = class) AS ap
  FROM v_pred, cls GROUP BY model, class),
f AS (SELECT model, class, hits / n::DOUBLE AS accuracy, coalesce(tp / nullif(pp, 0)::DOUBLE, 0) AS precision,
  coalesce(tp / nullif(ap, 0)::DOUBLE, 0) AS recall, coalesce(2 * tp / nullif(pp + ap, 0)::DOUBLE, 0) AS f1,
  ap::BIGINT AS support FROM c)""") + """SELECT model, class, round(accuracy, 6) AS accuracy,
  round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support,
  round(sum(f1) OVER (PARTITION BY model) / 3, 6) AS macro_f1 FROM f"""


@query("classification_metrics", class_sql("d_true", "d_pred"))
def classification_metrics(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ev.classification_metrics(views.predictions(spark, d), CLASSES, truth="d_true", pred="d_pred",
                                             by=["model"]))


@query("classification_breaking", class_sql("b_true", "b_pred"))
def classification_breaking(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ev.classification_metrics(views.predictions(spark, d), CLASSES, truth="b_true", pred="b_pred",
                                             by=["model"]))


@query("confusion_matrix", with_views(PRED) + """, dom AS (SELECT m.model, t.c AS target, p.c AS predicted
  FROM (SELECT DISTINCT model FROM v_pred) m, (SELECT unnest([0, 1, 2])::BIGINT AS c) t,
  (SELECT unnest([0, 1, 2])::BIGINT AS c) p)
  SELECT dom.model, dom.target, dom.predicted, count(v.sample_id) AS n FROM dom LEFT JOIN v_pred v
  ON v.model = dom.model AND v.d_true = dom.target AND v.d_pred = dom.predicted GROUP BY ALL""")
def confusion_matrix(spark: SparkSession, d: str) -> DataFrame:
    return ev.confusion_matrix(views.predictions(spark, d), CLASSES, truth="d_true", pred="d_pred", by=["model"])


SUMMARY = """s AS (SELECT model, count(*) AS n, avg(abs(h_pred - h_true)) AS mae,
  100 * count_if(abs(h_pred - h_true) <= 0.2::DOUBLE) / count(*)::DOUBLE AS within_02_pct,
  count_if(d_pred = d_true) / count(*)::DOUBLE AS direction_acc,
  count_if(b_pred = b_true) / count(*)::DOUBLE AS breaking_acc FROM v_pred GROUP BY model),
o AS (SELECT *, 0.4::DOUBLE * within_02_pct + 0.3::DOUBLE * direction_acc + 0.3::DOUBLE * breaking_acc AS as_published,
  0.5::DOUBLE * (within_02_pct / 100) + 0.25::DOUBLE * direction_acc + 0.25::DOUBLE * breaking_acc AS ratio FROM s)"""


@query("overall_score", with_views(PRED, SUMMARY) + """SELECT model, n, round(mae, 6) AS mae,
  round(within_02_pct, 6) AS within_02_pct, round(direction_acc, 6) AS direction_acc,
  round(breaking_acc, 6) AS breaking_acc, round(as_published, 6) AS as_published, round(ratio, 6) AS ratio FROM o""")
def overall_score(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ev.overall_score(ev.accuracy_summary(views.predictions(spark, d), ["model"])))


@query("evaluation_recommendations", with_views(PRED, SUMMARY, rules_sql(rules.EVALUATION)) + """,
  p AS (SELECT model, avg(image_id % 2200) AS inference_ms, avg(sample_id % 4096) AS memory_mb, 1000 / avg(image_id % 2200) AS images_per_second FROM v_pred GROUP BY model),
  m AS (SELECT model, t.metric, t.value FROM o JOIN p USING (model), LATERAL (VALUES ('mae', mae), ('within_02_pct', within_02_pct),
      ('direction_acc', direction_acc), ('breaking_acc', breaking_acc), ('as_published', as_published), ('inference_ms', inference_ms),
      ('memory_mb', memory_mb), ('images_per_second', images_per_second)) AS t(metric, value))
  SELECT DISTINCT model, text FROM m JOIN v_rule USING (metric) WHERE """ + FIRES)
def evaluation_recommendations(spark: SparkSession, d: str) -> DataFrame:
    """Texts on accuracy, and on speed and memory as stand-in columns have them."""
    df = views.predictions(spark, d)
    scores = ev.overall_score(ev.accuracy_summary(df, ["model"]))
    measured = metric_rows(scores, ["mae", "within_02_pct", "direction_acc", "breaking_acc", "as_published"], ["model"])
    speed = F.avg(F.col("image_id") % 2200)
    cost = df.groupBy("model").agg(speed.alias("inference_ms"), F.avg(F.col("sample_id") % 4096).alias("memory_mb"), (1000 / speed).alias("images_per_second"))
    measured = measured.unionByName(metric_rows(cost, ["inference_ms", "memory_mb", "images_per_second"], ["model"]))
    return recommend(measured, rules.EVALUATION, ["model"])


# --- calibration -----------------------------------------------------------------------------------
PAIRS = """v_pairs AS (SELECT model, task, confidence, correct FROM v_pred, LATERAL (VALUES
  ('height', conf_h, CASE WHEN abs(h_pred - h_true) <= 0.2::DOUBLE THEN 1::DOUBLE ELSE 0 END),
  ('direction', conf_d, CASE WHEN d_pred = d_true THEN 1::DOUBLE ELSE 0 END),
  ('breaking', conf_b, CASE WHEN b_pred = b_true THEN 1::DOUBLE ELSE 0 END)) AS t(task, confidence, correct))"""
EDGES = "[" + ", ".join(f"'{e!r}'::DOUBLE" for e in cal.BIN_EDGES[:-1]) + "]"
BINS = f"""v_bin AS (SELECT model, task, CASE WHEN confidence > 0 AND confidence <= 1 THEN
  len(list_filter({EDGES}, lambda e: confidence > e))::BIGINT END AS bin, confidence, correct FROM v_pairs),
v_rel AS (SELECT model, task, bin, count(*) AS n, avg(confidence) AS mean_confidence, avg(correct) AS accuracy
  FROM v_bin GROUP BY ALL)"""
ERRORS = """v_err AS (SELECT model, task, sum(n)::BIGINT AS n,
  coalesce(sum(CASE WHEN bin IS NOT NULL THEN abs(mean_confidence - accuracy) * n END) / sum(n), 0) AS ece,
  coalesce(max(CASE WHEN bin IS NOT NULL THEN abs(mean_confidence - accuracy) END), 0) AS mce,
  coalesce(sum(CASE WHEN bin IS NOT NULL THEN abs(mean_confidence - accuracy) END), 0) / 10 AS ace
  FROM v_rel GROUP BY model, task)"""


@query("stack_tasks", with_views(PRED, PAIRS) + """SELECT model, task, count(*) AS n,
  round(avg(confidence), 6) AS confidence, round(avg(correct), 6) AS correct FROM v_pairs GROUP BY model, task""")
def stack_tasks(spark: SparkSession, d: str) -> DataFrame:
    pairs = cal.calibration_pairs(views.predictions(spark, d), ["model"])
    return rounded(pairs.groupBy("model", "task").agg(
        F.count("*").alias("n"), F.avg("confidence").alias("confidence"), F.avg("correct").alias("correct")))


@query("reliability_bins", with_views(PRED, PAIRS, BINS) + """SELECT model, task, bin, n,
  round(mean_confidence, 6) AS mean_confidence, round(accuracy, 6) AS accuracy FROM v_rel""")
def reliability_bins(spark: SparkSession, d: str) -> DataFrame:
    return rounded(cal.reliability_bins(cal.calibration_pairs(views.predictions(spark, d), ["model"]),
                                        ["model", "task"]))


@query("calibration", with_views(PRED, PAIRS, BINS, ERRORS) + """SELECT model, task, n, round(ece, 6) AS ece,
  round(mce, 6) AS mce, round(ace, 6) AS ace FROM v_err""")
def calibration(spark: SparkSession, d: str) -> DataFrame:
    return rounded(cal.calibration_errors(cal.calibration_pairs(views.predictions(spark, d), ["model"]),
                                          ["model", "task"]))


@query("calibration_summary", with_views(PRED, PAIRS, BINS, ERRORS).replace("l_returnflag AS model", "'all' AS model")
       + """SELECT task, n AS data_points, n >= 50 AS can_fit, round(CASE WHEN n >= 10 THEN ece END, 6) AS ece,
  round(CASE WHEN n >= 10 THEN mce END, 6) AS mce, CASE WHEN n >= 10 THEN ece < 0.1::DOUBLE END AS is_well_calibrated
  FROM v_err""")
def calibration_summary(spark: SparkSession, d: str) -> DataFrame:
    return rounded(cal.calibration_summary(cal.calibration_pairs(views.predictions(spark, d))))


# points of each task, and calibration errors of values (task, confidence, n, hits, calibrated)
POINTS = """v_pt AS (SELECT task, confidence AS c, count(*) AS n, sum(correct) AS hits FROM v_pairs GROUP BY 1, 2)"""


def _errors_sql(view: str, value: str, name: str) -> str:
    return f"""{name}_bin AS (SELECT task, CASE WHEN {value} > 0 AND {value} <= 1 THEN len(list_filter({EDGES}, lambda e: {value} > e)) END AS bin,
  sum(n) AS n, sum({value} * n) / sum(n) AS mean_confidence, sum(hits) / sum(n) AS accuracy FROM {view} GROUP BY 1, 2),
{name} AS (SELECT task, sum(n)::BIGINT AS n, coalesce(sum(CASE WHEN bin IS NOT NULL THEN abs(mean_confidence - accuracy) * n END) / sum(n), 0) AS ece
  FROM {name}_bin GROUP BY task)"""


REPORT = """SELECT b.task, b.n, round(b.ece, 6) AS ece_before, round(a.ece, 6) AS ece_after FROM v_before b JOIN v_after a USING (task)"""
NEWTON = """v_fit(task, step, a, b) AS (SELECT DISTINCT task, 0, 0::DOUBLE, 0::DOUBLE FROM v_pt
  UNION ALL SELECT task, step + 1, a + (hab * gb - hbb * ga) / (haa * hbb - hab * hab), b + (hab * ga - haa * gb) / (haa * hbb - hab * hab)
  FROM (SELECT task, step, a, b, a + sum((n * p - hits) * c) AS ga, sum(n * p - hits) AS gb, 1 + sum(n * p * (1 - p) * c * c) AS haa,
      sum(n * p * (1 - p) * c) AS hab, sum(n * p * (1 - p)) AS hbb
    FROM (SELECT f.task, step, a, b, c, n, hits, 1 / (1 + exp(-(a * c + b))) AS p FROM v_fit f JOIN v_pt t ON t.task = f.task WHERE step < 25)
    GROUP BY task, step, a, b)),
v_cal AS (SELECT t.*, 1 / (1 + exp(-(a * c + b))) AS calibrated FROM v_pt t JOIN v_fit f ON f.task = t.task AND step = 25)"""


@query("platt_scaling", with_views(PRED, PAIRS, POINTS, NEWTON, _errors_sql("v_pt", "c", "v_before"), _errors_sql("v_cal", "calibrated", "v_after"))
       .replace("WITH ", "WITH RECURSIVE ", 1) + REPORT)
def platt_scaling(spark: SparkSession, d: str) -> DataFrame:
    return rounded(cal.calibrator_report(cal.calibration_pairs(views.predictions(spark, d)), "platt"))


# the isotonic value of a point: over all starts at or before it, the largest of the least means up to any end at or after it
MAXMIN = """v_cum AS (SELECT *, sum(n) OVER w AS cn, sum(hits) OVER w AS ch FROM v_pt WINDOW w AS (PARTITION BY task ORDER BY c)),
v_low AS (SELECT p.task, p.c, s.c AS start, min((e.ch - s.ch + s.hits) / (e.cn - s.cn + s.n)) AS least FROM v_pt p
  JOIN v_cum s ON s.task = p.task AND s.c <= p.c JOIN v_cum e ON e.task = p.task AND e.c >= p.c GROUP BY 1, 2, 3),
v_cal AS (SELECT t.*, m.calibrated FROM v_pt t JOIN (SELECT task, c, max(least) AS calibrated FROM v_low GROUP BY 1, 2) m USING (task, c))"""


@query("isotonic_scaling", with_views(PRED, PAIRS, POINTS, MAXMIN, _errors_sql("v_pt", "c", "v_before"), _errors_sql("v_cal", "calibrated", "v_after")) + REPORT)
def isotonic_scaling(spark: SparkSession, d: str) -> DataFrame:
    return rounded(cal.calibrator_report(cal.calibration_pairs(views.predictions(spark, d)), "isotonic"))


@query("isotonic_blocks", with_views(PRED, PAIRS, POINTS, MAXMIN) + """SELECT task, round(min(c), 6) AS lower, round(max(c), 6) AS upper,
  round(calibrated, 6) AS value, sum(n)::DOUBLE AS weight FROM v_cal GROUP BY task, calibrated""")
def isotonic_blocks(spark: SparkSession, d: str) -> DataFrame:
    """The fitted steps themselves."""
    return rounded(cal.isotonic_blocks(cal.calibration_pairs(views.predictions(spark, d)), ["task"]))


# logits: product of the whole vector with the mean vector of each of three classes
CENTROIDS = """v_u AS (SELECT vec_id, label % 3 AS y, i, embedding[i]::DOUBLE AS v FROM embeddings, unnest(range(1, 65)) AS t(i)),
v_c AS (SELECT y AS k, i, avg(v) AS m FROM v_u GROUP BY 1, 2),
v_z AS (SELECT vec_id, y, k, sum(v * m) AS z FROM v_u JOIN v_c USING (i) GROUP BY 1, 2, 3)"""


def class_logits(spark: SparkSession, d: str) -> DataFrame:
    """(vec_id, target, logits) by the products of each whole vector with three class means, 64 numbers each."""
    rows = table(spark, d, "embeddings").select("vec_id", (F.col("label") % 3).alias("target"), F.col("embedding").cast("array<double>").alias("v"))
    means = rows.groupBy("target").agg(F.array(*[F.avg(F.get("v", F.lit(i))) for i in range(64)]).alias("mean"))
    classes = means.agg(*[F.max(F.when(F.col("target") == k, F.col("mean"))).alias(f"mean{k}") for k in range(3)])
    dot = [F.aggregate(F.zip_with("v", f"mean{k}", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x) for k in range(3)]
    return rows.crossJoin(F.broadcast(classes)).select("vec_id", "target", F.array(*dot).alias("logits"))  # one row of three means


@query("temperature_fit", with_views(CENTROIDS).replace("WITH ", "WITH RECURSIVE ", 1) + """, f(step, beta) AS (SELECT 0, 1::DOUBLE UNION ALL
  SELECT step + 1, beta - avg(m1 - zy) / avg(m2 - m1 * m1) FROM (SELECT step, beta, vec_id, sum(e * z) / sum(e) AS m1, sum(e * z * z) / sum(e) AS m2,
      max(CASE WHEN k = y THEN z END) AS zy FROM (SELECT *, exp(beta * z) AS e FROM f, v_z WHERE step < 40) GROUP BY 1, 2, 3) GROUP BY step, beta)
  SELECT round(1 / beta, 6) AS temperature FROM f WHERE step = 40""")
def temperature_fit(spark: SparkSession, d: str) -> DataFrame:
    return rounded(cal.fit_temperature(class_logits(spark, d), "logits", "target"))


GRID = [0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0, 4.0]


@query("temperature_grid", """WITH g AS (SELECT vec_id, label % 3 AS target, list_transform([1, 2, 3], lambda k: list_sum(list_transform(
    list_filter(range(1, 65), lambda i: i % 3 = k % 3), lambda i: embedding[i]::DOUBLE))) AS l FROM embeddings),
  z AS (SELECT target, t.temperature, list_transform(l, lambda v: v / t.temperature) AS z FROM g,
  (SELECT unnest([0.25, 0.5, 0.75, 1, 1.5, 2, 3, 4])::DOUBLE AS temperature) t),
  l AS (SELECT temperature, avg(list_max(z) + ln(exp(z[1] - list_max(z)) + exp(z[2] - list_max(z))
    + exp(z[3] - list_max(z))) - z[target + 1]) AS nll FROM z GROUP BY temperature)
  SELECT temperature, round(nll, 6) AS nll, nll = (SELECT min(nll) FROM l) AS best FROM l""")
def temperature_grid(spark: SparkSession, d: str) -> DataFrame:
    """Logits are the sums over every third component, so that the whole vector counts."""
    def third(k: int) -> Column:
        return F.aggregate(F.filter("embedding", lambda v, i: i % 3 == k), F.lit(0.0), lambda a, v: a + v)

    df = table(spark, d, "embeddings").select((F.col("label") % 3).alias("target"), F.array(*map(third, range(3))).alias("logits"))
    losses = cal.temperature_scaling(df, "logits", "target", GRID)
    best = cal.best_temperature(losses).select("temperature").scalar()
    return rounded(losses.withColumn("best", F.col("temperature") == best))


# --- comparison, failures, ensembles ---------------------------------------------------------------
# metric, its expression in SQL, and whether higher is better
COMPARED = (("overall_score", "0.5::DOUBLE * count_if(abs(h_pred - h_true) <= 0.2::DOUBLE) / count(*) + 0.25::DOUBLE * count_if(d_pred = d_true) / count(*)"
             " + 0.25::DOUBLE * count_if(b_pred = b_true) / count(*)", True),
            ("mae", "avg(abs(h_pred - h_true))", False), ("direction_acc", "count_if(d_pred = d_true) / count(*)::DOUBLE", True),
            ("breaking_acc", "count_if(b_pred = b_true) / count(*)::DOUBLE", True), ("inference_ms", "avg(image_id % 2200)", False),
            ("memory_mb", "avg(sample_id % 4096)", False), ("images_per_second", "1000 / avg(image_id % 2200)", True))


@query("compare_models", with_views(PRED) + ", s AS (SELECT model, year(ts) AS ts, " + ", ".join(f"{x} AS {m}" for m, x, _ in COMPARED) + """ FROM v_pred GROUP BY 1, 2),
  r AS (SELECT model, ts, m.metric, round(m.value, 9) AS value, round(m.value, 9) * m.sgn AS signed FROM s, LATERAL (VALUES """
       + ", ".join(f"('{m}', {m}, {-1 if up else 1})" for m, _, up in COMPARED) + """) AS m(metric, value, sgn)),
  k AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY signed, model) AS r_best,
    row_number() OVER (PARTITION BY metric ORDER BY ts, model) AS r_first,
    row_number() OVER (PARTITION BY metric ORDER BY ts DESC, model DESC) AS r_last FROM r)
  SELECT metric, max(CASE WHEN r_best = 1 THEN model END) AS best_model,
    round(max(CASE WHEN r_best = 1 THEN value END), 6) AS best_value,
    round(max(CASE WHEN r_last = 1 THEN value END) - max(CASE WHEN r_first = 1 THEN value END), 6) AS change
  FROM k GROUP BY metric""")
def compare_models(spark: SparkSession, d: str) -> DataFrame:
    """All seven metrics; times and memory come from stand-in columns."""
    df = views.predictions(spark, d).withColumn("year", F.year("ts"))
    within = F.count_if(F.abs(F.col("h_pred") - F.col("h_true")) <= ev.TIGHT_M) / F.count("*")
    acc, speed = ev.accuracies(), F.avg(F.col("image_id") % 2200)
    per = df.groupBy("model", "year").agg(
        (0.5 * within + 0.25 * acc["direction_acc"] + 0.25 * acc["breaking_acc"]).alias("overall_score"),
        F.avg(F.abs(F.col("h_pred") - F.col("h_true"))).alias("mae"), *[c.alias(name) for name, c in acc.items()],
        speed.alias("inference_ms"), F.avg(F.col("sample_id") % 4096).alias("memory_mb"), (1000 / speed).alias("images_per_second"))
    long = F.array(*[F.struct(F.lit(m).alias("metric"), F.round(m, 9).alias("value"), F.lit(up).alias("higher_is_better")) for m, _, up in COMPARED])
    reports = per.select("model", F.col("year").alias("ts"), F.explode(long).alias("_m")).select("model", "ts", "_m.*")
    return rounded(ev.compare_models(reports))


@query("failure_rows", with_views(PRED) + """SELECT sample_id, 'low_confidence' AS reason, round(conf_d - 0.3::DOUBLE, 6) AS conf_d, round(conf_b - 0.3::DOUBLE, 6) AS conf_b,
  round(h_pred, 6) AS h_pred, 'low' AS prediction_quality FROM v_pred WHERE least(conf_d - 0.3::DOUBLE, conf_b - 0.3::DOUBLE) < 0.5::DOUBLE""")
def failure_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows whose lesser confidence, lowered by 0.3 so that some fail, is under the bound."""
    df = views.predictions(spark, d).withColumns({"conf_d": F.col("conf_d") - 0.3, "conf_b": F.col("conf_b") - 0.3})
    return rounded(ev.failure_rows(df, "sample_id"))


@query("failure_cases", with_views(PRED) + """SELECT model, count(*) AS n,
  count_if(least(conf_d, conf_b) < 0.5::DOUBLE)::BIGINT AS failures,
  round(count_if(conf_d > 0.8::DOUBLE AND conf_b > 0.8::DOUBLE) / count(*)::DOUBLE, 6) AS high_quality_share,
  round(avg(conf_d), 6) AS mean_conf_d, round(avg(conf_b), 6) AS mean_conf_b FROM v_pred GROUP BY model""")
def failure_cases(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ev.failure_cases(views.predictions(spark, d), ["model"]))


@query("brier", with_views(PRED) + """SELECT model,
  round(avg(pow(conf_d - CASE WHEN d_pred = d_true THEN 1 ELSE 0 END, 2)), 6) AS brier_direction,
  round(avg(pow(conf_b - CASE WHEN b_pred = b_true THEN 1 ELSE 0 END, 2)), 6) AS brier_breaking
  FROM v_pred GROUP BY model""")
def brier(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ev.brier(views.predictions(spark, d), {
        "direction": ("d_true", "d_pred", "conf_d"), "breaking": ("b_true", "b_pred", "conf_b")}, ["model"]))


@query("ensemble_vote", with_views(PRED) + """, c AS (SELECT image_id, t.task, t.label, count(*) AS n FROM v_pred,
  LATERAL (VALUES ('d_pred', d_pred), ('b_pred', b_pred)) AS t(task, label) GROUP BY ALL),
  r AS (SELECT *, row_number() OVER (PARTITION BY image_id, task ORDER BY n DESC, label) AS k FROM c),
  a AS (SELECT image_id, avg(h_pred) AS height_meters, avg(conf_d) AS confidence, count(*) AS num_models
    FROM v_pred GROUP BY image_id)
  SELECT image_id, round(height_meters, 6) AS height_meters, round(confidence, 6) AS confidence, num_models,
    max(CASE WHEN task = 'd_pred' THEN label END) AS d_pred,
    max(CASE WHEN task = 'b_pred' THEN label END) AS b_pred
  FROM a JOIN r USING (image_id) WHERE k = 1 GROUP BY ALL""")
def ensemble_vote(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ev.ensemble(views.predictions(spark, d), "image_id", ["d_pred", "b_pred"],
                               {"height_meters": "h_pred", "confidence": "conf_d"}))


@query("readiness", with_views(PRED, SUMMARY) + """, r AS (SELECT model, 1 - sum(pow(h_pred - h_true, 2))
  / (count(*) * var_pop(h_true)) AS r2, avg(l) AS latency_ms FROM (SELECT *, image_id % 2200 AS l FROM v_pred)
  GROUP BY model),
  i AS (SELECT model, list_filter([CASE WHEN r2 < 0.7::DOUBLE THEN 'height r2 below 0.7' END,
    CASE WHEN direction_acc < 0.8::DOUBLE THEN 'direction accuracy below 0.8' END,
    CASE WHEN breaking_acc < 0.8::DOUBLE THEN 'breaking accuracy below 0.8' END,
    CASE WHEN latency_ms > 1000 THEN 'latency above 1 s' END], lambda x: x IS NOT NULL) AS issues FROM s JOIN r USING (model))
  SELECT model, array_to_string(issues, '; ') AS issues, len(issues) = 0 AS ready FROM i""")
def readiness(spark: SparkSession, d: str) -> DataFrame:
    df = views.predictions(spark, d)
    gap = F.col("h_pred") - F.col("h_true")
    n = F.count("*")
    report = df.groupBy("model").agg(
        (1 - F.sum(gap * gap) / (n * F.var_pop("h_true"))).alias("r2"),
        *[c.alias(name) for name, c in ev.accuracies().items()],
        F.avg(F.col("image_id") % 2200).alias("latency_ms"))
    return ev.readiness(report).select("model", as_text("issues"), "ready")


@query("batch_stats", """SELECT event_type AS operation, count(*) AS n, count_if(value < 200)::BIGINT AS ok,
  count_if(value >= 200)::BIGINT AS failed, round(count_if(value < 200) / count(*)::DOUBLE, 6) AS success_rate,
  round(avg(CASE WHEN value < 200 THEN value END), 6) AS mean_ms, min(CASE WHEN value < 200 THEN value END) AS min_ms,
  max(CASE WHEN value < 200 THEN value END) AS max_ms,
  round(stddev_pop(CASE WHEN value < 200 THEN value END), 6) AS std_ms,
  round(avg(CASE WHEN value < 200 THEN json_extract_string(props, '$.k')::DOUBLE END), 6) AS mean_confidence,
  round(count(*) * 1000 / sum(value), 6) AS per_second FROM events GROUP BY event_type""")
def batch_stats(spark: SparkSession, d: str) -> DataFrame:
    df = views.telemetry(spark, d)
    return rounded(ev.batch_stats(df, ["operation"], ok=F.col("duration_ms") < 200, millis="duration_ms",
                                  confidence="memory_mb"))


@query("labelled_pairs", """WITH t AS (SELECT d.doc_id, l.quality, l.toxic, d.n_chars FROM documents d
  LEFT JOIN labels l USING (doc_id))
  SELECT 'quality' AS task, count(*) AS n, avg(n_chars) AS mean_size FROM t WHERE quality IS NOT NULL
  UNION ALL SELECT 'toxic', count(*), avg(n_chars) FROM t WHERE toxic IS NOT NULL""")
def labelled_pairs(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "documents").select("doc_id", "n_chars").join(table(spark, d, "labels"), "doc_id", "left")
    long = F.array(*[F.struct(F.lit(t).alias("task"), F.col(t).alias("label")) for t in ("quality", "toxic")])
    return df.select("n_chars", F.explode(long).alias("_l")).filter(F.col("_l.label").isNotNull()) \
        .groupBy("_l.task").agg(F.count("*").alias("n"), F.avg("n_chars").alias("mean_size"))


# --- training history ------------------------------------------------------------------------------
@query("best_so_far", """WITH e AS (SELECT o_orderpriority AS run, o_orderkey AS epoch, o_totalprice AS loss,
  min(o_totalprice) OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best_before,
  row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS position FROM orders),
  i AS (SELECT *, best_before IS NULL OR loss < best_before AS improved FROM e)
  SELECT run, epoch, loss, best_before, improved, position - max(CASE WHEN improved THEN position END)
    OVER (PARTITION BY run ORDER BY epoch) AS patience FROM i""")
def best_so_far(spark: SparkSession, d: str) -> DataFrame:
    epochs = table(spark, d, "orders").select(
        F.col("o_orderpriority").alias("run"), F.col("o_orderkey").alias("epoch"), F.col("o_totalprice").alias("loss"))
    return best_so_far_history(epochs)


def best_so_far_history(epochs: DataFrame) -> DataFrame:
    """Best earlier loss, improvement flag and epochs since the last improvement, per run."""
    keys, order = ["run"], ["epoch"]
    step = with_chunks(epochs.withColumn("_one", F.lit(1)), keys, "epoch")
    step = running(step, keys, order, mins={"best_before": "loss"}, exclusive=True)
    step = step.withColumn("improved", F.col("best_before").isNull() | (F.col("loss") < F.col("best_before")))
    step = running(step, keys, order, sums={"position": "_one"}, totals=False)
    step = step.withColumn("_at", F.when(F.col("improved"), -F.col("position")))
    step = running(step, keys, order, mins={"_latest": "_at"})
    return step.select("run", "epoch", "loss", "best_before", "improved",
                       (F.col("position") + F.col("_latest")).alias("patience"))


# --- flagship --------------------------------------------------------------------------------------
@query("evaluation_by_model", with_views(PRED, PAIRS, BINS, ERRORS, SUMMARY) + """, r AS (""" +
       REGRESSION.format(key="model,", group="GROUP BY model") + """)
  SELECT r.*, round(o.direction_acc, 6) AS direction_acc, round(o.breaking_acc, 6) AS breaking_acc,
    round(o.as_published, 6) AS as_published, round(o.ratio, 6) AS ratio,
    round(max(CASE WHEN task = 'height' THEN ece END), 6) AS ece_height,
    round(max(CASE WHEN task = 'direction' THEN ece END), 6) AS ece_direction,
    round(max(CASE WHEN task = 'breaking' THEN ece END), 6) AS ece_breaking
  FROM r JOIN o ON r.model = o.model JOIN v_err e ON e.model = r.model GROUP BY ALL""")
def evaluation_by_model(spark: SparkSession, d: str) -> DataFrame:
    df = views.predictions(spark, d)
    scores = ev.overall_score(ev.regression_metrics(df, ["model"], extra=ev.accuracies(), bounded_keys=True))
    errors = cal.calibration_errors(cal.calibration_pairs(df, ["model"]), ["model", "task"])
    wide = errors.groupBy("model").agg(*[F.max(F.when(F.col("task") == t, F.col("ece"))).alias(f"ece_{t}")
                                         for t in ("height", "direction", "breaking")])
    return rounded(scores.join(wide, "model"))
