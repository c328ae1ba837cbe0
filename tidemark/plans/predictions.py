"""Queries that post-process raw model outputs and check predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.rounding import as_text, rounded
from tidemark.operators import forest, predictions as pd
from tidemark.plans import views
from tidemark.plans.registry import query
from tidemark.plans.views_sql import PRED, with_views
from tidemark.sources.tables import table

OUT = """v_out AS (SELECT l_orderkey AS sample_id, l_discount * 10 AS height_raw, 1 - l_tax * 5 AS height_base_conf,
  l_quantity / 50 AS dominance, l_linenumber * 2.0::DOUBLE - 3 AS wave_count_raw, l_discount * 9 AS mixed_score,
  l_quantity / 50 AS direction_strength, l_linenumber::DOUBLE AS wave_trains_raw, l_quantity / 50 AS intensity,
  1 - l_tax * 10 AS clarity, l_tax * 12 AS mixed_breaking, l_discount * 10 AS no_breaking,
  [l_quantity / 10, l_discount * 30, l_tax * 40] AS logits FROM lineitem),
v_w AS (SELECT *, list_transform(logits, lambda x: exp(x - list_max(logits))) AS w FROM v_out),
v_probs AS (SELECT *, list_transform(w, lambda x: x / (w[1] + w[2] + w[3])) AS probs FROM v_w)"""


def raw_outputs(spark: SparkSession, d: str) -> DataFrame:
    """Raw network outputs per sample, made from line items."""
    q, disc, tax = F.col("l_quantity"), F.col("l_discount"), F.col("l_tax")
    probs = pd.softmax(F.col("logits"))
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("sample_id"), (disc * 10).alias("height_raw"), (1 - tax * 5).alias("height_base_conf"),
        (q / 50).alias("dominance"), (F.col("l_linenumber") * 2.0 - 3).alias("wave_count_raw"),
        (disc * 9).alias("mixed_score"), (q / 50).alias("direction_strength"),
        F.col("l_linenumber").cast("double").alias("wave_trains_raw"), (q / 50).alias("intensity"),
        (1 - tax * 10).alias("clarity"), (tax * 12).alias("mixed_breaking"), (disc * 10).alias("no_breaking"),
        F.array(q / 10, disc * 30, tax * 40).alias("logits")) \
        .withColumn("direction_probs", probs).withColumn("breaking_probs", F.col("direction_probs"))


CLASS = "list_position(probs, list_max(probs)) - 1"
HEIGHT = """v_h AS (SELECT *, 0.5::DOUBLE + height_raw * 7.5::DOUBLE AS height_meters,
  greatest(0, least(10, wave_count_raw)) AS wave_count FROM v_probs),
v_h2 AS (SELECT *, height_base_conf * dominance * greatest(0.5::DOUBLE, least(1, 1 - (wave_count - 1) * 0.1::DOUBLE))
  AS height_confidence FROM v_h)"""
DIRECTION = f"""v_d AS (SELECT *, ({CLASS})::BIGINT AS direction_class, greatest(0.1::DOUBLE, least(1, list_max(probs)
    * (1 - 0.3::DOUBLE * mixed_score) * (1 + 0.2::DOUBLE * direction_strength))) AS direction_confidence,
  greatest(1, least(5, wave_trains_raw)) AS wave_trains,
  mixed_score > 0.6::DOUBLE OR direction_strength < 0.3::DOUBLE AS is_mixed FROM v_h2)"""
BREAKING = f"""v_b AS (SELECT *, no_breaking > 0.6::DOUBLE AND intensity < 0.3::DOUBLE AS nb FROM v_d),
v_b2 AS (SELECT *, (CASE WHEN nb THEN 3 ELSE {CLASS} END)::BIGINT AS breaking_class,
  CASE WHEN nb THEN 0.9::DOUBLE * no_breaking ELSE greatest(0.1::DOUBLE, least(1, list_max(probs) * intensity * clarity
    * (1 - 0.2::DOUBLE * mixed_breaking))) END AS breaking_confidence,
  mixed_breaking > 0.5::DOUBLE OR clarity < 0.4::DOUBLE AS is_mixed_breaking FROM v_b)"""
HEADS = with_views(OUT, HEIGHT, DIRECTION, BREAKING)


@query("height_post", HEADS + """ SELECT sample_id, round(height_meters, 9) AS height_meters, wave_count,
  round(height_confidence, 9) AS height_confidence, height_meters < 0.5::DOUBLE OR height_meters > 8 AS is_extreme FROM v_b2""")
def height_post(spark: SparkSession, d: str) -> DataFrame:
    return rounded(pd.height_output(raw_outputs(spark, d)).select(
        "sample_id", "height_meters", "wave_count", "height_confidence", "is_extreme"), 9)


@query("direction_post", HEADS + """ SELECT sample_id, direction_class, round(direction_confidence, 9) AS direction_confidence,
  wave_trains, is_mixed FROM v_b2""")
def direction_post(spark: SparkSession, d: str) -> DataFrame:
    return rounded(pd.direction_output(raw_outputs(spark, d)).select(
        "sample_id", "direction_class", "direction_confidence", "wave_trains", "is_mixed"), 9)


@query("breaking_post", HEADS + """ SELECT sample_id, breaking_class, round(breaking_confidence, 9) AS breaking_confidence,
  is_mixed_breaking FROM v_b2""")
def breaking_post(spark: SparkSession, d: str) -> DataFrame:
    return rounded(pd.breaking_output(raw_outputs(spark, d)).select(
        "sample_id", "breaking_class", "breaking_confidence", "is_mixed_breaking"), 9)


@query("confidence_penalties", HEADS + """, p AS (SELECT sample_id,
  height_confidence * CASE WHEN wave_count > 2 THEN 0.95::DOUBLE ELSE 1 END * CASE WHEN dominance < 0.7::DOUBLE THEN 0.9::DOUBLE ELSE 1 END AS h,
  direction_confidence * CASE WHEN is_mixed THEN 0.85::DOUBLE ELSE 1 END * CASE WHEN wave_trains > 2 THEN 0.9::DOUBLE ELSE 1 END AS d,
  breaking_confidence * CASE WHEN is_mixed_breaking THEN 0.85::DOUBLE ELSE 1 END * CASE WHEN clarity < 0.5::DOUBLE THEN 0.9::DOUBLE ELSE 1 END AS b,
  breaking_class = 3 AND no_breaking > 0.7::DOUBLE AS sure FROM v_b2),
  q AS (SELECT sample_id, h, d, CASE WHEN sure THEN greatest(b, 0.8::DOUBLE) ELSE b END AS b FROM p)
  SELECT sample_id, round(h, 9) AS final_height_conf, round(d, 9) AS final_direction_conf, round(b, 9) AS final_breaking_conf,
    round((h + d + b) / 3, 9) AS overall_confidence FROM q""")
def confidence_penalties(spark: SparkSession, d: str) -> DataFrame:
    df = pd.breaking_output(pd.direction_output(pd.height_output(raw_outputs(spark, d))))
    return rounded(pd.confidence_penalties(df).select(
        "sample_id", "final_height_conf", "final_direction_conf", "final_breaking_conf", "overall_confidence"), 9)


@query("softmax", with_views(OUT) + f"""SELECT sample_id, round(probs[1], 9) AS p1, round(probs[2], 9) AS p2, round(probs[3], 9) AS p3,
  ({CLASS})::BIGINT AS predicted, round(list_max(probs), 9) AS confidence FROM v_probs""")
def softmax(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("direction_probs")
    return rounded(raw_outputs(spark, d).select(
        "sample_id", *[p[i].alias(f"p{i + 1}") for i in range(3)], pd.argmax(p).alias("predicted"),
        F.array_max(p).alias("confidence")), 9)


ENTROPY = "list_sum(list_transform(probs, lambda p: -greatest(0.00000001::DOUBLE, least(1, p)) * ln(greatest(0.00000001::DOUBLE, least(1, p)))))"
BINARY = "(-c * ln(c + 0.00000001::DOUBLE) - (1 - c) * ln(1 - c + 0.00000001::DOUBLE))"


@query("entropy", with_views(OUT) + f"""SELECT sample_id, round({ENTROPY}, 9) AS entropy, round({ENTROPY} / ln(3), 9) AS normalised,
  round({BINARY.replace('c *', 'height_base_conf *').replace('(c ', '(height_base_conf ').replace('- c', '- height_base_conf')}, 9) AS binary_entropy
  FROM v_probs""")
def entropy(spark: SparkSession, d: str) -> DataFrame:
    h = pd.entropy(F.col("direction_probs"))
    return rounded(raw_outputs(spark, d).select(
        "sample_id", h.alias("entropy"), (h / F.log(F.lit(3.0))).alias("normalised"),
        pd.binary_entropy(F.col("height_base_conf")).alias("binary_entropy")), 9)


@query("uncertainty", with_views(PRED) + """, u AS (SELECT sample_id, h_pred, (1 - conf_d) * 0.5::DOUBLE AS a, (1 - conf_d) * 0.3::DOUBLE AS e FROM v_pred)
  SELECT sample_id, round(a, 9) AS aleatoric, round(e, 9) AS epistemic, round(sqrt(a * a + e * e), 9) AS total,
    round(a * a + e * e, 9) AS variance, round(h_pred - 1.96::DOUBLE * sqrt(a * a + e * e), 9) AS lower,
    round(h_pred + 1.96::DOUBLE * sqrt(a * a + e * e), 9) AS upper FROM u""")
def uncertainty(spark: SparkSession, d: str) -> DataFrame:
    cols = pd.uncertainty_columns(F.col("h_pred"), F.col("conf_d"))
    return rounded(views.predictions(spark, d).select("sample_id", *[c.alias(n) for n, c in cols.items()]), 9)


RELIABILITY = """greatest(0, least(1, 1 - (abs({raw} - {cal}) + {unc} + greatest(0, abs({raw} - 0.5::DOUBLE) - 0.4::DOUBLE) * 2) / 3))"""


@query("reliability", with_views(PRED) + "SELECT sample_id, round(" + RELIABILITY.format(raw="conf_d", cal="conf_b", unc="(1 - conf_h)")
       + ", 9) AS reliability FROM v_pred")
def reliability(spark: SparkSession, d: str) -> DataFrame:
    return rounded(views.predictions(spark, d).select("sample_id", pd.reliability(
        F.col("conf_d"), F.col("conf_b"), 1 - F.col("conf_h")).alias("reliability")), 9)


@query("breakdown", with_views(OUT) + """SELECT sample_id, """ + ", ".join(
    f"round(100 * probs[{i}] / (probs[1] + probs[2] + probs[3] + 0.00000001::DOUBLE), 7) AS pct{i}" for i in (1, 2, 3)) + " FROM v_probs")
def breakdown(spark: SparkSession, d: str) -> DataFrame:
    b = pd.breakdown(F.col("breaking_probs"))
    return rounded(raw_outputs(spark, d).select("sample_id", *[b[i].alias(f"pct{i + 1}") for i in range(3)]), 7)


@query("confidence_bundle", with_views(OUT) + f""", u AS (SELECT sample_id, list_max(probs) AS raw, height_base_conf AS cal,
    {ENTROPY} AS h FROM v_probs), m AS (SELECT *, h / ln(3) AS unc, 1.96::DOUBLE * sqrt(greatest(h / ln(3), 0)) AS margin FROM u)
  SELECT sample_id, round(h, 9) AS entropy, round(unc, 9) AS uncertainty, round(greatest(0, cal - margin), 9) AS lower,
    round(least(1, cal + margin), 9) AS upper, round({RELIABILITY.format(raw='raw', cal='cal', unc='unc')}, 9) AS reliability FROM m""")
def confidence_bundle(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("direction_probs")
    cols = pd.confidence_bundle(F.array_max(p), F.col("height_base_conf"), p)
    return rounded(raw_outputs(spark, d).select("sample_id", *[c.alias(n) for n, c in cols.items()]), 9)


@query("anomaly_rules", with_views(PRED) + """, a AS (SELECT sample_id, h_pred * 1.4::DOUBLE AS h, conf_d - 0.65::DOUBLE AS c,
    conf_b - 0.5::DOUBLE AS b FROM v_pred),
  s AS (SELECT sample_id, greatest(0, CASE WHEN h > 10 THEN 0.8::DOUBLE ELSE 0 END, CASE WHEN c < 0.1::DOUBLE THEN 0.6::DOUBLE ELSE 0 END,
      CASE WHEN c < 0.2::DOUBLE AND b < 0.2::DOUBLE THEN 0.7::DOUBLE ELSE 0 END) AS anomaly_score,
    list_filter([CASE WHEN h > 10 THEN 'extremely high wave' END, CASE WHEN c < 0.1::DOUBLE THEN 'extremely low height confidence' END,
      CASE WHEN c < 0.2::DOUBLE AND b < 0.2::DOUBLE THEN 'all confidences extremely low' END], lambda x: x IS NOT NULL) AS r FROM a)
  SELECT sample_id, anomaly_score, array_to_string(r, '; ') AS reasons, anomaly_score > 0.5::DOUBLE OR len(r) > 0 AS is_anomalous FROM s""")
def anomaly_rules(spark: SparkSession, d: str) -> DataFrame:
    conf = F.col("conf_d") - 0.65
    cols = pd.anomaly_rules(F.col("h_pred") * 1.4, conf, conf, F.col("conf_b") - 0.5)
    out = views.predictions(spark, d).select("sample_id", *[c.alias(n) for n, c in cols.items()])
    return out.withColumn("reasons", as_text("reasons"))


# features of the four groups that are judged apart: height, direction, breaking and the confidences together
GROUPS = {"height": ["h_pred", "conf_h", "is_extreme"], "direction": ["conf_d", "gap"], "breaking": ["conf_b", "intensity", "clarity"],
          "confidence": ["conf_h", "conf_d", "conf_b", "overall"]}
GROUPED = """v_an AS (SELECT *, CASE WHEN h_pred > 6 THEN 1 ELSE 0 END::DOUBLE AS is_extreme, abs(h_pred - h_true) AS gap,
  b_pred / 2 AS intensity, conf_b * conf_d AS clarity, (conf_h + conf_d + conf_b) / 3 AS overall FROM v_pred)"""


def grouped(spark: SparkSession, d: str) -> DataFrame:
    return views.predictions(spark, d).withColumns({
        "is_extreme": F.when(F.col("h_pred") > 6, 1.0).otherwise(0.0), "gap": F.abs(F.col("h_pred") - F.col("h_true")), "intensity": F.col("b_pred") / 2,
        "clarity": F.col("conf_b") * F.col("conf_d"), "overall": (F.col("conf_h") + F.col("conf_d") + F.col("conf_b")) / 3})


ROBUST = list(dict.fromkeys(f for group in GROUPS.values() for f in group))


@query("anomaly_robust", with_views(PRED, GROUPED) + ", m AS (SELECT " + ", ".join(f"quantile_cont({f}, 0.5) AS m_{f}" for f in ROBUST)
       + " FROM v_an), d AS (SELECT " + ", ".join(f"quantile_cont(abs({f} - m_{f}), 0.5) AS d_{f}" for f in ROBUST)
       + " FROM v_an, m), s AS (SELECT model, " + ", ".join("round((" + " + ".join(
           f"abs({f} - m_{f}) / CASE WHEN d_{f} > 0 THEN 1.4826::DOUBLE * d_{f} ELSE 1 END" for f in group) + f") / {len(group)}, 9) AS {name}"
           for name, group in GROUPS.items())
       + " FROM v_an, m, d), c AS (SELECT " + ", ".join(f"quantile_cont({name}, 0.9) AS c_{name}" for name in GROUPS)
       + " FROM s) SELECT model, count(*) AS n, " + ", ".join(
           f"round(avg({name}), 6) AS mean_{name}, round(max({name}), 6) AS max_{name}, count_if({name} > c_{name})::BIGINT AS outliers_{name}" for name in GROUPS)
       + " FROM s, c GROUP BY model")
def anomaly_robust(spark: SparkSession, d: str) -> DataFrame:
    """Scores and outliers of each group of features, per model."""
    out = pd.anomaly_robust(grouped(spark, d), GROUPS)
    return rounded(out.groupBy("model").agg(F.count("*").alias("n"), *[x for g in GROUPS for x in (
        F.avg(f"{g}_score").alias(f"mean_{g}"), F.max(f"{g}_score").alias(f"max_{g}"), F.count_if(f"{g}_outlier").alias(f"outliers_{g}"))]))


@query("anomaly_forest")
def anomaly_forest(spark: SparkSession, d: str) -> DataFrame:
    """Isolation forests of the four groups: anomaly of every row in each, lifted by the fixed rules."""
    judged = ["h_pred", "conf_h", "conf_d", "conf_b"]
    rules = {"anomaly_score": pd.anomaly_rules(*map(F.col, judged))["anomaly_score"]}
    return forest.anomalies(grouped(spark, d), GROUPS, rules=rules, keep=["sample_id", "model", *judged]).select(
        "sample_id", "model", *[f"{g}_anomaly" for g in GROUPS], "overall_anomaly", "is_anomalous")
