"""Queries over training labels: validation, balance, splits, conditions, parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.rounding import as_text, rounded
from tidemark.operators import gates
from tidemark.operators import labels as lb
from tidemark.operators import params as pa
from tidemark.operators import rules
from tidemark.operators.joins import metric_rows, recommend
from tidemark.plans import views
from tidemark.plans.profiling import FIRES, HEIGHT_CASE, rules_sql
from tidemark.plans.registry import query
from tidemark.plans.views_sql import LAB, with_views
from tidemark.sources.tables import table

COND = "v_cond AS (SELECT * FROM (VALUES " + ", ".join(
    f"({i}, '{a}', '{b}', {w}::DOUBLE, {f}::DOUBLE)" for i, (a, b, w, f) in enumerate(lb.CONDITIONS)) + \
    ") AS c(weather_id, lighting, weather, wind, foam))"

VALID = """e AS (SELECT *, list_filter([
    CASE WHEN NOT (height_meters >= 0.5::DOUBLE AND height_meters <= 8) THEN 'height out of range' END,
    CASE WHEN abs(height_feet - height_meters * 3.28084::DOUBLE) > 0.01::DOUBLE THEN 'feet do not match metres' END,
    CASE WHEN direction NOT IN ('LEFT', 'RIGHT', 'STRAIGHT') THEN 'unknown direction' END,
    CASE WHEN breaking_type NOT IN ('SPILLING', 'PLUNGING', 'SURGING') THEN 'unknown breaking type' END,
    CASE WHEN NOT (height_confidence >= 0 AND height_confidence <= 1) THEN 'height_confidence out of range' END,
    CASE WHEN NOT (direction_confidence >= 0 AND direction_confidence <= 1) THEN 'direction_confidence out of range' END,
    CASE WHEN NOT (breaking_confidence >= 0 AND breaking_confidence <= 1) THEN 'breaking_confidence out of range' END],
    lambda x: x IS NOT NULL) AS errors, list_filter([
    CASE WHEN wind_strength > 0.7::DOUBLE AND breaking_type <> 'SPILLING' THEN 'high wind without spilling' END,
    CASE WHEN height_meters > 5 AND NOT extreme_conditions THEN 'large wave not marked extreme' END,
    CASE WHEN wave_steepness > 0.15::DOUBLE AND breaking_type = 'SURGING' THEN 'steep wave marked surging' END],
    lambda x: x IS NOT NULL) AS warnings FROM v_lab),
c AS (SELECT *, greatest(0, (height_confidence + direction_confidence + breaking_confidence) / 3
    - 0.2::DOUBLE * len(errors) - 0.05::DOUBLE * len(warnings)) AS confidence_score FROM e)"""


@query("validate_labels", with_views(LAB, VALID) + """SELECT array_to_string(errors, '; ') AS errors,
  array_to_string(warnings, '; ') AS warnings, len(errors) = 0 AS is_valid, count(*) AS n,
  round(avg(confidence_score), 6) AS mean_score, round(min(confidence_score), 6) AS min_score FROM c GROUP BY 1, 2, 3""")
def validate_labels(spark: SparkSession, d: str) -> DataFrame:
    checked = gates.validate_labels(views.labels(spark, d))
    return rounded(checked.groupBy(as_text("errors"), as_text("warnings"), "is_valid").agg(
        F.count("*").alias("n"), F.avg("confidence_score").alias("mean_score"),
        F.min("confidence_score").alias("min_score")))


@query("encode_labels", with_views(LAB) + """SELECT direction, breaking_type,
  CASE direction WHEN 'LEFT' THEN 0 WHEN 'RIGHT' THEN 1 WHEN 'STRAIGHT' THEN 2 ELSE 2 END::BIGINT AS direction_code,
  CASE breaking_type WHEN 'SPILLING' THEN 0 WHEN 'PLUNGING' THEN 1 WHEN 'SURGING' THEN 2 ELSE 0 END::BIGINT AS breaking_code,
  count(*) AS n FROM v_lab GROUP BY 1, 2""")
def encode_labels(spark: SparkSession, d: str) -> DataFrame:
    df = views.labels(spark, d)
    return df.groupBy("direction", "breaking_type").agg(F.count("*").alias("n")).select(
        "direction", "breaking_type",
        gates.encode(F.col("direction"), gates.DIRECTION_CODES, gates.DIRECTION_DEFAULT).alias("direction_code"),
        gates.encode(F.col("breaking_type"), gates.BREAKING_CODES, gates.BREAKING_DEFAULT).alias("breaking_code"), "n")


@query("label_stats", with_views(LAB) + "SELECT count(*) AS n, round(avg(height_meters), 9) AS height_mean, "
       "round(stddev_pop(height_meters), 9) AS height_std, round(min(height_meters), 9) AS height_min, "
       "round(max(height_meters), 9) AS height_max, round(quantile_cont(height_meters, 0.5), 9) AS height_median, "
       + ", ".join(f"round(avg({c}_confidence), 9) AS {c}_conf_mean, round(stddev_pop({c}_confidence), 9) AS {c}_conf_std, "
                   f"round(min({c}_confidence), 9) AS {c}_conf_min" for c in ("height", "direction", "breaking"))
       + """, count_if(extreme_conditions)::BIGINT AS extreme_count, count(DISTINCT seed) AS distinct_seeds,
  round(min(wind_strength), 9) AS wind_min, round(max(wind_strength), 9) AS wind_max FROM v_lab""")
def label_stats(spark: SparkSession, d: str) -> DataFrame:
    return rounded(lb.label_stats(views.labels(spark, d)), 9)


BALANCE = f"""v_dim AS (SELECT 'height' AS dimension, {HEIGHT_CASE} AS category FROM v_lab
  UNION ALL SELECT 'direction', direction FROM v_lab UNION ALL SELECT 'breaking_type', breaking_type FROM v_lab
  UNION ALL SELECT 'weather', lighting || '_' || weather FROM v_lab JOIN v_cond USING (weather_id)),
v_dom AS (SELECT DISTINCT dimension, category FROM v_dim WHERE category IS NOT NULL
  UNION SELECT * FROM (VALUES ('height', '0.5-1.5m'), ('height', '1.5-3.0m'), ('height', '3.0-5.0m'), ('height', '5.0-8.0m'),
  ('direction', 'LEFT'), ('direction', 'RIGHT'), ('direction', 'STRAIGHT'), ('breaking_type', 'SPILLING'),
  ('breaking_type', 'PLUNGING'), ('breaking_type', 'SURGING'))
  UNION SELECT 'weather', lighting || '_' || weather FROM v_cond),
v_bal AS (SELECT o.dimension, o.category, count(v.category) AS n FROM v_dom o LEFT JOIN v_dim v
  ON v.dimension = o.dimension AND v.category = o.category GROUP BY 1, 2)"""


@query("balance_grouping_sets", with_views(LAB, COND, BALANCE) + "SELECT dimension, category, n FROM v_bal")
def balance_grouping_sets(spark: SparkSession, d: str) -> DataFrame:
    return lb.balance(views.labels(spark, d))


@query("balance_counts", with_views(LAB) + """SELECT c.direction, count(v.sample_id) AS n FROM (VALUES ('LEFT'), ('RIGHT'),
  ('STRAIGHT'), ('NONE')) AS c(direction) LEFT JOIN v_lab v USING (direction) GROUP BY c.direction""")
def balance_counts(spark: SparkSession, d: str) -> DataFrame:
    from tidemark.operators.joins import domain_counts
    return domain_counts(views.labels(spark, d), "direction", ["LEFT", "RIGHT", "STRAIGHT", "NONE"])


@query("balance_score", with_views(LAB, COND, BALANCE) + """, e AS (SELECT dimension, n, avg(n) OVER (PARTITION BY dimension)
  AS e FROM v_bal) SELECT dimension, sum(n)::BIGINT AS n, round(exp(-sum(pow(n - e, 2) / e) / sum(n)), 6) AS balance_score
  FROM e GROUP BY dimension""")
def balance_score(spark: SparkSession, d: str) -> DataFrame:
    return rounded(lb.balance_score(lb.balance(views.labels(spark, d))))


@query("balance_issues", with_views(LAB, COND, BALANCE) + """, s AS (SELECT dimension, stddev_pop(n) / avg(n) AS cv, sum(n) AS t
  FROM v_bal GROUP BY dimension)
  SELECT dimension, '*' AS category, 'uneven' AS issue, round(cv, 6) AS value FROM s WHERE cv > CASE dimension
    WHEN 'height' THEN 0.3::DOUBLE WHEN 'direction' THEN 0.2::DOUBLE WHEN 'breaking_type' THEN 0.2::DOUBLE END
  UNION ALL SELECT dimension, category, 'rare', n::DOUBLE FROM v_bal WHERE n < (SELECT max(t) FROM s) // 20""")
def balance_issues(spark: SparkSession, d: str) -> DataFrame:
    return rounded(lb.balance_issues(lb.balance(views.labels(spark, d))))


@query("share_diff", with_views(LAB) + " UNION ALL ".join(
    f"SELECT '{c}' AS dimension, '{k}' AS category, {v}::DOUBLE AS expected, round(count_if({c} = '{k}') / count(*)::DOUBLE, 6)"
    f" AS share, round(abs(count_if({c} = '{k}') / count(*)::DOUBLE - {v}::DOUBLE), 6) AS difference FROM v_lab"
    for c, t in lb.EXPECTED_SHARES.items() for k, v in t.items()))
def share_diff(spark: SparkSession, d: str) -> DataFrame:
    return rounded(lb.share_diff(views.labels(spark, d), ["direction", "breaking_type"]))


@query("class_weights", with_views(LAB) + """, c AS (SELECT direction, count(*) AS n FROM v_lab GROUP BY 1)
  SELECT direction, n, round((SELECT sum(n) / count(*)::DOUBLE FROM c) / n, 6) AS weight FROM c""")
def class_weights(spark: SparkSession, d: str) -> DataFrame:
    return rounded(lb.class_weights(views.labels(spark, d), "direction"))


@query("weighted_resample", """WITH c AS (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1),
  w AS (SELECT o_orderkey, o_orderpriority, 1.37::DOUBLE * (SELECT sum(n) / count(*)::DOUBLE FROM c) / n AS weight,
    ('0x' || substr(md5('7-' || o_orderkey::VARCHAR), 1, 8))::BIGINT / 4294967296::DOUBLE AS u
    FROM orders JOIN c USING (o_orderpriority)),
  k AS (SELECT o_orderpriority, floor(weight) + CASE WHEN u < weight - floor(weight) THEN 1 ELSE 0 END AS copies FROM w)
  SELECT o_orderpriority AS label, sum(copies)::BIGINT AS n FROM k GROUP BY 1""")
def weighted_resample(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select("o_orderkey", F.col("o_orderpriority").alias("label"))
    weights = lb.class_weights(orders, "label").select("label", (F.lit(1.37) * F.col("weight")).alias("weight"))
    weighted = orders.join(weights, "label")
    out = lb.weighted_resample(weighted, "o_orderkey", "weight", seed=7)
    return out.groupBy("label").agg(F.count("*").alias("n"))


@query("split_ordered", """WITH h AS (SELECT o_orderkey, row_number() OVER (ORDER BY
    ('0x' || substr(md5('42-' || o_orderkey::VARCHAR), 1, 12))::BIGINT) AS r, count(*) OVER () AS n FROM orders)
  SELECT o_orderkey, CASE WHEN r <= floor(n * 0.8::DOUBLE) THEN 'train' ELSE 'validation' END AS split FROM h""")
def split_ordered(spark: SparkSession, d: str) -> DataFrame:
    return lb.split_ordered(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", seed=42)


@query("round_robin", with_views(COND) + """SELECT lighting, weather, wind, count(*) AS n FROM part
  JOIN v_cond ON weather_id = p_partkey % 10 GROUP BY ALL""")
def round_robin(spark: SparkSession, d: str) -> DataFrame:
    return lb.round_robin(table(spark, d, "part"), "p_partkey").groupBy("lighting", "weather", "wind") \
        .agg(F.count("*").alias("n"))


def case_sql(col: str, words: dict, other: str) -> str:
    return f"CASE {col} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in words.items()) + f" ELSE '{other}' END"


@query("prompt_text", with_views(COND) + f"""SELECT p_partkey, concat_ws(', ', p_name,
  {case_sql('lighting', lb.LIGHTING_TEXT, lb.LIGHTING_OTHER)}, {case_sql('weather', lb.WEATHER_TEXT, lb.WEATHER_OTHER)},
  CASE WHEN wind > 0.7::DOUBLE THEN '{lb.STRONG_WIND_TEXT}' WHEN wind > 0.3::DOUBLE THEN '{lb.WIND_TEXT}' END,
  CASE WHEN foam > 0.5::DOUBLE THEN '{lb.FOAM_TEXT}' END) AS prompt FROM part JOIN v_cond ON weather_id = p_partkey % 10""")
def prompt_text(spark: SparkSession, d: str) -> DataFrame:
    df = lb.round_robin(table(spark, d, "part"), "p_partkey")
    return df.select("p_partkey", lb.prompt_text(F.col("p_name")).alias("prompt"))


# --- parameter sets --------------------------------------------------------------------------------
PARAM = """v_param AS (SELECT p_brand AS grp, t.name, t.value FROM part, LATERAL (VALUES ('p_size', p_size::DOUBLE),
  ('p_retailprice', p_retailprice), ('wind', (p_partkey % 7) / 10::DOUBLE)) AS t(name, value))"""


def _params(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(
        "p_partkey", F.col("p_brand").alias("grp"),
        F.create_map(F.lit("p_size"), F.col("p_size").cast("double"), F.lit("p_retailprice"), F.col("p_retailprice"),
                     F.lit("wind"), (F.col("p_partkey") % 7) / 10.0).alias("params"),
        (F.col("p_size") / 50.0).alias("quality_score"))


RANGES = {"p_size": (0.0, 60.0), "wind": (0.0, 1.0)}


@query("param_diversity", with_views(PARAM) + """, s AS (SELECT name, count(*) AS total_values,
    count(DISTINCT value) AS unique_values, avg(value) AS mean, stddev_pop(value) AS std, min(value) AS min,
    max(value) AS max, quantile_cont(value, 0.5) AS median, max(value) - min(value) AS range FROM v_param GROUP BY name),
  u AS (SELECT *, unique_values / total_values::DOUBLE AS uniqueness_ratio,
    CASE WHEN mean <> 0 THEN std / mean ELSE 0 END AS cv,
    CASE name WHEN 'p_size' THEN range / 60 WHEN 'wind' THEN range / 1 ELSE 1 END AS range_utilization FROM s)
  SELECT name, total_values, unique_values, round(mean, 6) AS mean, round(std, 6) AS std, min, max,
    round(median, 6) AS median, round(range, 6) AS range, round(uniqueness_ratio, 6) AS uniqueness_ratio,
    round(cv, 6) AS cv, round(range_utilization, 6) AS range_utilization,
    round((uniqueness_ratio + range_utilization + least(cv, 1)) / 3, 6) AS diversity_score FROM u""")
def param_diversity(spark: SparkSession, d: str) -> DataFrame:
    return rounded(pa.param_diversity(_params(spark, d), "params", RANGES))


@query("param_combos", """WITH c AS (SELECT DISTINCT p_size, round(p_retailprice, 3), p_partkey % 7 FROM part)
  SELECT (SELECT count(*) FROM part) AS total, count(*) AS unique_combinations,
    (SELECT count(*) FROM part) - count(*) AS duplicates,
    round(count(*) / (SELECT count(*) FROM part)::DOUBLE, 6) AS uniqueness_rate FROM c""")
def param_combos(spark: SparkSession, d: str) -> DataFrame:
    return rounded(pa.param_combinations(_params(spark, d), "params"))


@query("quality_bins", """WITH b AS (SELECT round(p_size / 50::DOUBLE, 1) AS bin FROM part)
  SELECT bin, count(*) AS n, CASE WHEN bin >= 0.8::DOUBLE THEN 'high' WHEN bin >= 0.6::DOUBLE THEN 'medium' ELSE 'low' END
    AS level, round(count(*) / (SELECT count(*) FROM part)::DOUBLE, 6) AS share FROM b GROUP BY bin""")
def quality_bins(spark: SparkSession, d: str) -> DataFrame:
    return rounded(pa.quality_bins(_params(spark, d), "quality_score"))


@query("diversity_recommendations", with_views(PARAM) + """, p AS (SELECT * FROM part), v AS (SELECT name, (count(DISTINCT value) / count(*)::DOUBLE
      + CASE name WHEN 'p_size' THEN (max(value) - min(value)) / 60 WHEN 'wind' THEN max(value) - min(value) ELSE 1 END
      + least(CASE WHEN avg(value) <> 0 THEN stddev_pop(value) / avg(value) ELSE 0 END, 1)) / 3 AS diversity_score FROM v_param GROUP BY name), c AS (SELECT DISTINCT p_size, round(p_retailprice, 3), p_partkey % 7 FROM part),
  m AS (SELECT 'uniqueness_rate' AS metric, (SELECT count(*) FROM c) / count(*)::DOUBLE AS value FROM p
    UNION ALL SELECT 'high_quality_ratio', count(CASE WHEN round(p_size / 50::DOUBLE, 1) >= 0.8::DOUBLE THEN 1 END) / count(*)::DOUBLE FROM p
    UNION ALL SELECT 'low_diversity_params', count_if(diversity_score < 0.5::DOUBLE)::DOUBLE FROM v),
  """ + rules_sql(rules.DIVERSITY) + """ SELECT DISTINCT text FROM m JOIN v_rule USING (metric) WHERE """ + FIRES)
def diversity_recommendations(spark: SparkSession, d: str) -> DataFrame:
    df = _params(spark, d)
    combos = pa.param_combinations(df, "params")
    shares = pa.quality_bins(df, "quality_score").agg(
        F.sum(F.when(F.col("level") == "high", F.col("share")).otherwise(0.0)).alias("high_quality_ratio"))
    low = pa.param_diversity(df, "params", RANGES).agg(F.count_if(F.col("diversity_score") < 0.5).alias("low_diversity_params"))
    measured = metric_rows(combos, ["uniqueness_rate"]).unionByName(metric_rows(shares, ["high_quality_ratio"])) \
        .unionByName(metric_rows(low, ["low_diversity_params"]))
    return recommend(measured, rules.DIVERSITY)


LIMITS = [gates.Limit("p_size", (1.0, 45.0), (5.0, 40.0)), gates.Limit("p_retailprice", (905.0, 1e9), (910.0, 1e9)),
          gates.Limit("wind", (0.0, 1.0), (0.2, 0.5))]


@query("validate_params", """WITH v AS (SELECT p_partkey, p_size, p_retailprice, (p_partkey % 7) / 10::DOUBLE AS wind FROM part),
  s AS (SELECT p_partkey,
    CASE WHEN NOT p_size BETWEEN 1 AND 45 THEN 0 WHEN NOT p_size BETWEEN 5 AND 40 THEN 0.7::DOUBLE ELSE 1 END AS a,
    CASE WHEN p_retailprice < 905 THEN 0 WHEN p_retailprice < 910 THEN 0.7::DOUBLE ELSE 1 END AS b,
    CASE WHEN wind < 0.2::DOUBLE OR wind > 0.5::DOUBLE THEN 0.7::DOUBLE ELSE 1 END AS c FROM v)
  SELECT p_partkey, concat_ws(',', CASE WHEN a = 0 THEN 'p_size' END, CASE WHEN b = 0 THEN 'p_retailprice' END) AS invalid,
    concat_ws(',', CASE WHEN a = 0.7::DOUBLE THEN 'p_size' END, CASE WHEN b = 0.7::DOUBLE THEN 'p_retailprice' END,
      CASE WHEN c = 0.7::DOUBLE THEN 'wind' END) AS warned, round((a + b + c) / 3, 6) AS score,
    a > 0 AND b > 0 AS is_valid FROM s""")
def validate_params(spark: SparkSession, d: str) -> DataFrame:
    out = gates.validate_params(_params(spark, d), "params", LIMITS)
    return rounded(out.select("p_partkey", as_text("invalid", ","), as_text("warned", ","), "score", "is_valid"))
