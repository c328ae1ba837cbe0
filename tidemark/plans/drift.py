"""Queries comparing a current dataset with its baseline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.rounding import as_text, rounded
from tidemark.operators import drift as dr
from tidemark.operators import labels as lb
from tidemark.operators import profiling as pr
from tidemark.operators import raster as ra
from tidemark.operators import report, rules, sketches
from tidemark.operators.joins import recommend
from tidemark.plans import raster, views
from tidemark.plans.profiling import FIRES, PROFILE, rules_sql
from tidemark.plans.registry import query
from tidemark.plans.views_sql import FEAT, FILE, IMG, LAB, PIX, RGB, with_views
from tidemark.sources.tables import pin, table

CURVE = """v_cnt AS (SELECT feature, value, count_if(dataset = 'baseline')::BIGINT AS n1,
  count_if(dataset = 'current')::BIGINT AS n2, count(*) AS n FROM v_feat GROUP BY 1, 2),
v_cum AS (SELECT *, sum(n1) OVER w AS c1, sum(n2) OVER w AS c2, sum(n) OVER w AS c,
  sum(n1) OVER f AS t1, sum(n2) OVER f AS t2, lead(value) OVER w AS nxt FROM v_cnt
  WINDOW w AS (PARTITION BY feature ORDER BY value), f AS (PARTITION BY feature)),
v_dist AS (SELECT feature, max(t1)::BIGINT AS n1, max(t2)::BIGINT AS n2,
  max(abs(c1 / t1::DOUBLE - c2 / t2::DOUBLE)) AS ks,
  coalesce(sum(abs(c1 / t1::DOUBLE - c2 / t2::DOUBLE) * (nxt - value)), 0) AS wasserstein,
  sum(n1 * (c - (n - 1) / 2::DOUBLE)) - max(t1)::DOUBLE * (max(t1) + 1) / 2 AS u FROM v_cum GROUP BY feature)"""


def _long(spark: SparkSession, d: str) -> DataFrame:
    return dr.to_long(views.features_wide(spark, d), views.FEATURES)


def _distances(spark: SparkSession, d: str) -> DataFrame:
    return dr.rank_distances(_long(spark, d), "baseline", "current")


@query("ks_stat", with_views(FEAT, CURVE) + "SELECT feature, n1, n2, round(ks, 9) AS ks FROM v_dist")
def ks_stat(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_distances(spark, d).select("feature", "n1", "n2", "ks"), 9)


@query("wasserstein", with_views(FEAT, CURVE) + "SELECT feature, round(wasserstein, 6) AS wasserstein FROM v_dist")
def wasserstein(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_distances(spark, d).select("feature", "wasserstein"))


@query("mann_whitney", with_views(FEAT, CURVE) + "SELECT feature, round(u, 1) AS mann_whitney_u FROM v_dist")
def mann_whitney(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_distances(spark, d).select("feature", "mann_whitney_u"), 1)


@query("rank_test_p_values", with_views(FEAT, CURVE) + """, v_t AS (SELECT feature,
    sum(n::DOUBLE * n * n - n) AS ties FROM v_cnt GROUP BY feature),
  z AS (SELECT feature, ks, sqrt(n1::DOUBLE * n2 / (n1 + n2)) * ks AS lam, greatest(0, abs(u - n1::DOUBLE * n2 / 2) - 0.5::DOUBLE)
    / sqrt(n1::DOUBLE * n2 / 12 * ((n1 + n2 + 1) - ties / ((n1 + n2)::DOUBLE * (n1 + n2 - 1)))) / sqrt(2::DOUBLE) AS x
    FROM v_dist JOIN v_t USING (feature)),
  t AS (SELECT *, 1 / (1 + 0.3275911::DOUBLE * x) AS t FROM z)
  SELECT feature, round(CASE WHEN lam < 0.2::DOUBLE THEN 1 ELSE greatest(0, least(1, (SELECT sum(CASE WHEN k % 2 = 1 THEN 2 ELSE -2 END
      * exp(-2 * k * k * lam * lam)) FROM unnest(range(1, 21)) AS s(k)))) END, 6) AS ks_p,
    round(least(1, t * (0.254829592::DOUBLE + t * (-0.284496736::DOUBLE + t * (1.421413741::DOUBLE
      + t * (-1.453152027::DOUBLE + t * 1.061405429::DOUBLE)))) * exp(-x * x)), 6) AS mann_whitney_p FROM t""")
def rank_test_p_values(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_distances(spark, d).select("feature", "ks_p", "mann_whitney_p"))


@query("t_stat", with_views(FEAT) + """, m AS (SELECT feature, count(CASE WHEN dataset = 'baseline' THEN value END) AS n1,
    avg(CASE WHEN dataset = 'baseline' THEN value END) AS m1, var_samp(CASE WHEN dataset = 'baseline' THEN value END) AS v1,
    count(CASE WHEN dataset = 'current' THEN value END) AS n2, avg(CASE WHEN dataset = 'current' THEN value END) AS m2,
    var_samp(CASE WHEN dataset = 'current' THEN value END) AS v2 FROM v_feat GROUP BY feature)
  SELECT feature, n1, n2, round(abs((m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)
    * (1 / n1::DOUBLE + 1 / n2::DOUBLE))), 6) AS t FROM m""")
def t_stat(spark: SparkSession, d: str) -> DataFrame:
    return rounded(dr.t_statistic(_long(spark, d), "baseline", "current"))


KL = """v_span0 AS (SELECT feature, min(value) AS lo, max(value) AS hi FROM v_feat WHERE dataset = 'baseline' GROUP BY 1),
v_span AS (SELECT feature, CASE WHEN lo = hi THEN lo - 0.5::DOUBLE ELSE lo END AS lo, CASE WHEN lo = hi THEN hi + 0.5::DOUBLE ELSE hi END AS hi FROM v_span0),
v_b AS (SELECT feature, dataset, (hi - lo) / 50 AS step, len(list_filter(range(1, 50), lambda k: value >= k * ((hi - lo) / 50) + lo))::BIGINT AS bin
  FROM v_feat JOIN v_span USING (feature) WHERE value BETWEEN lo AND hi),
v_n AS (SELECT feature, max(step) AS step, count_if(dataset = 'baseline') AS n1, count_if(dataset = 'current') AS n2
  FROM v_b GROUP BY feature),
v_d AS (SELECT n.feature, i AS bin, count_if(dataset = 'baseline') / max(n1)::DOUBLE / max(n.step) + 0.0000000001::DOUBLE AS p,
  count_if(dataset = 'current') / max(n2)::DOUBLE / max(n.step) + 0.0000000001::DOUBLE AS q
  FROM (SELECT v_n.*, i FROM v_n, unnest(range(0, 50)) AS t(i)) n LEFT JOIN v_b b ON b.feature = n.feature AND b.bin = n.i
  GROUP BY 1, 2),
v_pq AS (SELECT feature, p / sum(p) OVER f AS p, q / sum(q) OVER f AS q FROM v_d WINDOW f AS (PARTITION BY feature)),
v_kl AS (SELECT feature, greatest(0, sum(p * ln(p / q))) AS kl FROM v_pq GROUP BY feature)"""


@query("kl_divergence", with_views(FEAT, KL) + "SELECT feature, round(kl, 6) AS kl FROM v_kl")
def kl_divergence(spark: SparkSession, d: str) -> DataFrame:
    return rounded(dr.kl_divergence(_long(spark, d), "baseline", "current"))


@query("drift_report", with_views(FEAT, CURVE) + """SELECT round(avg(ks), 9) AS drift_score, avg(ks) > 0.005::DOUBLE AS drift_detected,
  coalesce(string_agg(CASE WHEN ks > 0.005::DOUBLE THEN feature END, ',' ORDER BY feature), '') AS affected FROM v_dist""")
def drift_report(spark: SparkSession, d: str) -> DataFrame:
    out = dr.drift_report(_long(spark, d), "baseline", "current", threshold=0.005)
    return rounded(out.withColumn("affected", as_text("affected", ",")), 9)


COSINE = """v_p AS (SELECT label < 5 AS first, i, embedding[i]::DOUBLE AS x FROM embeddings, unnest(range(1, 65)) AS t(i)),
v_m AS (SELECT i, avg(CASE WHEN first THEN x END) AS a, avg(CASE WHEN NOT first THEN x END) AS b FROM v_p GROUP BY i),
v_cos AS (SELECT sum(a * b) / (sqrt(sum(a * a)) * sqrt(sum(b * b))) AS cosine FROM v_m)"""


@query("embedding_cosine", with_views(COSINE) + "SELECT round(cosine, 6) AS cosine, round(1 - cosine, 6) AS distance FROM v_cos")
def embedding_cosine(spark: SparkSession, d: str) -> DataFrame:
    return rounded(dr.embedding_cosine(_vectors(spark, d), "embedding", F.col("label") < 5))


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("label", F.col("embedding").cast("array<double>").alias("embedding"))


@query("match_score", with_views(FEAT, CURVE, KL, COSINE) + """SELECT round(0.3::DOUBLE * greatest(0, 1 - least((SELECT avg(kl) FROM v_kl) / 2, 1))
  + 0.3::DOUBLE * greatest(0, 1 - least((SELECT avg(wasserstein) FROM v_dist) / 100, 1)) + 0.3::DOUBLE * (SELECT cosine FROM v_cos)
  + 0.1::DOUBLE * greatest(0, 1 - least((SELECT avg(ks) FROM v_dist), 1)), 6) AS match_score""")
def match_score(spark: SparkSession, d: str) -> DataFrame:
    long = _long(spark, d)
    visual = dr.embedding_cosine(_vectors(spark, d), "embedding", F.col("label") < 5).select("cosine").scalar()
    ranks = dr.rank_distances(long, "baseline", "current").select("feature", "ks", "wasserstein")
    both = ranks.join(dr.kl_divergence(long, "baseline", "current"), "feature").agg(
        F.avg("ks").alias("ks"), F.avg("wasserstein").alias("wasserstein"), F.avg("kl").alias("kl"))
    return rounded(both.select(dr.match_score(F.col("kl"), F.col("wasserstein"), visual, F.col("ks")).alias("match_score")))


IMAGES = f"""v_e AS (SELECT vec_id, {raster.FEATURE_COLUMNS} FROM v_fv),
v_feat AS (SELECT CASE WHEN label < 5 THEN 'baseline' ELSE 'current' END AS dataset, f.feature, f.value FROM v_e JOIN embeddings USING (vec_id),
  LATERAL (VALUES {', '.join(f"('{c}', {c})" for c in ra.FEATURES)}) AS f(feature, value))"""


@query("dataset_comparison", with_views(RGB, raster.FEATURE_SQL, IMAGES, CURVE, KL, COSINE) + """, v_tt AS (SELECT feature,
    count(CASE WHEN dataset = 'baseline' THEN 1 END) AS n1, count(CASE WHEN dataset = 'current' THEN 1 END) AS n2,
    avg(CASE WHEN dataset = 'baseline' THEN value END) AS m1, var_samp(CASE WHEN dataset = 'baseline' THEN value END) AS s1,
    avg(CASE WHEN dataset = 'current' THEN value END) AS m2, var_samp(CASE WHEN dataset = 'current' THEN value END) AS s2 FROM v_feat GROUP BY feature),
  t AS (SELECT abs((m1 - m2) / sqrt(((n1 - 1) * s1 + (n2 - 1) * s2) / (n1 + n2 - 2) * (1 / n1::DOUBLE + 1 / n2::DOUBLE))) AS t FROM v_tt WHERE s1 + s2 > 0),
  r AS (SELECT (SELECT avg(kl) FROM v_kl) AS kl, (SELECT avg(wasserstein) FROM v_dist) AS w, (SELECT avg(ks) FROM v_dist) AS ks,
    (SELECT avg(u) FROM v_dist) AS u, (SELECT avg(t) FROM t) AS t, (SELECT cosine FROM v_cos) AS c)
  SELECT round(kl, 6) AS kl_divergence, round(w, 6) AS wasserstein_distance, round(ks, 6) AS ks_statistic, round(u, 6) AS mann_whitney_u,
    round(t, 6) AS t_statistic, round(c, 6) AS visual_similarity, round(1 - c, 6) AS perceptual_distance,
    round(0.3::DOUBLE * greatest(0, 1 - least(kl / 2, 1)) + 0.3::DOUBLE * greatest(0, 1 - least(w / 100, 1)) + 0.3::DOUBLE * c
      + 0.1::DOUBLE * greatest(0, 1 - least(ks, 1)), 6) AS match_score FROM r""")
def dataset_comparison(spark: SparkSession, d: str) -> DataFrame:
    visual = dr.embedding_cosine(_vectors(spark, d), "embedding", F.col("label") < 5).select("cosine").scalar()
    return rounded(dr.compare_datasets(_image_features(spark, d), "baseline", "current", visual))


def _image_features(spark: SparkSession, d: str) -> DataFrame:
    """The eleven image features in long form, labels 0-4 as baseline and 5-9 as current."""
    part = table(spark, d, "embeddings").select("vec_id", F.when(F.col("label") < 5, "baseline").otherwise("current").alias("dataset"))
    wide = ra.feature_vector(views.rgb_images(spark, d)).join(part, "vec_id")
    return dr.to_long(wide.select("dataset", *[F.round(c, 9).alias(c) for c in ra.FEATURES]), ra.FEATURES)


NAMED = "v_named AS (SELECT * FROM v_dist WHERE feature IN (" + ", ".join(f"'{c}'" for c in dr.DRIFT_FEATURES) + "))"


def _named(spark: SparkSession, d: str) -> DataFrame:
    """KS rows of the features that make the drift verdict."""
    part = table(spark, d, "embeddings").select("vec_id", F.when(F.col("label") < 5, "baseline").otherwise("current").alias("dataset"))
    wide = ra.feature_vector(views.rgb_images(spark, d)).join(part, "vec_id")
    return dr.rank_distances(dr.to_long(wide.select("dataset", *[F.round(c, 9).alias(c) for c in dr.DRIFT_FEATURES]), dr.DRIFT_FEATURES),
                             "baseline", "current")


@query("drift_recommendations", with_views(RGB, raster.FEATURE_SQL, IMAGES, CURVE, NAMED, rules_sql(rules.DRIFT)) + """,
  o AS (SELECT avg(ks) > 0.1::DOUBLE AS detected FROM v_named),
  m AS (SELECT feature AS metric, ks AS value FROM v_named, o WHERE detected
    UNION ALL SELECT 'drift_detected', CASE WHEN detected THEN 1 ELSE 0 END FROM o)
  SELECT DISTINCT text FROM m JOIN v_rule USING (metric) WHERE """ + FIRES)
def drift_recommendations(spark: SparkSession, d: str) -> DataFrame:
    return recommend(dr.drift_measures(_named(spark, d)), rules.DRIFT)


@query("health_row", with_views(IMG, PROFILE, FILE, RGB, raster.FEATURE_SQL, IMAGES, CURVE, NAMED) + """, f AS (SELECT count(*) AS total_samples,
    count_if(NOT valid) AS missing, count(DISTINCT ext) AS formats, count(*) - count(DISTINCT content_hash) AS copies,
    (epoch(TIMESTAMP '2025-01-01') - epoch(max(modified))) / 3600 AS age FROM v_file),
  dr AS (SELECT avg(ks) AS drift_score, coalesce(list(feature ORDER BY feature) FILTER (WHERE ks > 0.1::DOUBLE), []) AS affected FROM v_named),
  r AS (SELECT total_samples, quality_score, anomaly_count, 100 * missing / total_samples::DOUBLE AS missing_percentage,
    100 * copies / total_samples::DOUBLE AS duplicate_percentage, 1 / formats::DOUBLE AS format_consistency,
    drift_score, affected, age AS freshness_hours FROM f, q, dr)
  SELECT total_samples, round(quality_score, 6) AS quality_score, round(drift_score, 6) AS drift_score, anomaly_count,
    round(missing_percentage, 6) AS missing_percentage, round(duplicate_percentage, 6) AS duplicate_percentage,
    round(format_consistency, 6) AS format_consistency, round(freshness_hours, 6) AS freshness_hours,
    array_to_string(list_concat(list_filter([CASE WHEN quality_score < 0.7::DOUBLE THEN 'quality below threshold' END,
      CASE WHEN drift_score > 0.1::DOUBLE THEN 'data drift detected' END], lambda x: x IS NOT NULL),
      list_concat(CASE WHEN drift_score > 0.1::DOUBLE THEN list_transform(affected, lambda x: 'affected feature: ' || x) ELSE [] END,
      list_filter([CASE WHEN freshness_hours > 24 THEN 'data is stale' END], lambda x: x IS NOT NULL))), '; ') AS alerts FROM r""")
def health_row(spark: SparkSession, d: str) -> DataFrame:
    drift = dr.report_of(_named(spark, d))
    row = pr.health_row(views.files(spark, d), views.images(spark, d), drift, F.lit("2025-01-01").cast("timestamp_ntz"))
    return rounded(row.withColumn("alerts", as_text("alerts")))


@query("compare_moments", with_views(LAB) + " UNION ALL ".join(
    f"""SELECT '{c}' AS metric, round(m, 9) AS mean, round(s, 9) AS std, round(abs(m - {mean}::DOUBLE) / {mean}::DOUBLE, 9) AS mean_diff,
  round(abs(s - {std}::DOUBLE) / {std}::DOUBLE, 9) AS std_diff,
  round((1 - least(1, abs(m - {mean}::DOUBLE) / {mean}::DOUBLE) + 1 - least(1, abs(s - {std}::DOUBLE) / {std}::DOUBLE)) / 2, 9) AS similarity,
  abs(m - {mean}::DOUBLE) / {mean}::DOUBLE <= 0.2::DOUBLE AND abs(s - {std}::DOUBLE) / {std}::DOUBLE <= 0.3::DOUBLE AS similar
  FROM (SELECT avg({c}) AS m, stddev_pop({c}) AS s FROM v_lab)""" for c, (mean, std) in lb.EXPECTED_MOMENTS.items())
    + """ UNION ALL SELECT 'extreme_ratio', round(m, 9), NULL, round(abs(m - 0.12::DOUBLE), 9), NULL, NULL,
  abs(m - 0.12::DOUBLE) <= 0.05::DOUBLE FROM (SELECT avg(CASE WHEN extreme_conditions THEN 1 ELSE 0 END) AS m FROM v_lab)""")
def compare_moments(spark: SparkSession, d: str) -> DataFrame:
    return rounded(dr.compare_moments(views.labels(spark, d), lb.EXPECTED_MOMENTS, F.col("extreme_conditions"),
                                      lb.EXPECTED_EXTREME_RATIO), 9)


def _levels(spark: SparkSession, d: str) -> DataFrame:
    source = table(spark, d, "embeddings").select("vec_id", F.when(F.col("label") < 5, "real").otherwise("synthetic")
                                                  .alias("dataset"))
    grey = views.rasters(spark, d).select("vec_id", "h", "w", F.transform("px", lambda v: v * 255).alias("px"))
    return grey.join(source, "vec_id")


POOL = """v_grey AS (SELECT CASE WHEN label < 5 THEN 'real' ELSE 'synthetic' END AS dataset, v * 255 AS v
  FROM v_pix JOIN embeddings USING (vec_id)),
v_pool AS (SELECT dataset, count(*) AS pixels, avg(v) AS mean, stddev_pop(v) AS std, min(v) AS min, max(v) AS max,
  max(v) - min(v) AS range FROM v_grey GROUP BY dataset)"""


@query("pooled_stats", with_views(PIX, POOL) + """SELECT dataset, pixels, round(mean, 6) AS mean, round(std, 6) AS std,
  round(min, 6) AS min, round(max, 6) AS max, round(range, 6) AS range FROM v_pool""")
def pooled_stats(spark: SparkSession, d: str) -> DataFrame:
    return rounded(dr.pooled_stats(_levels(spark, d), ["dataset"]))


@query("pooled_similarity", with_views(PIX, POOL) + """, g AS (SELECT abs(max(CASE WHEN dataset = 'real' THEN mean END)
    - max(CASE WHEN dataset = 'synthetic' THEN mean END)) AS m, abs(max(CASE WHEN dataset = 'real' THEN std END)
    - max(CASE WHEN dataset = 'synthetic' THEN std END)) AS s, abs(max(CASE WHEN dataset = 'real' THEN range END)
    - max(CASE WHEN dataset = 'synthetic' THEN range END)) AS r FROM v_pool),
  n AS (SELECT m, s, greatest(0, 1 - m / 255) AS a, greatest(0, 1 - s / 255) AS b, greatest(0, 1 - r / 255) AS c FROM g),
  q AS (SELECT a, b, c, (a + b + c) / 3 AS score, list_filter([CASE WHEN (a + b + c) / 3 < 0.5::DOUBLE THEN 'low similarity' END,
    CASE WHEN m > 50 THEN 'brightness differs' END, CASE WHEN s > 30 THEN 'contrast differs' END], lambda x: x IS NOT NULL) AS i FROM n)
  SELECT round(a, 6) AS mean_similarity, round(b, 6) AS std_similarity, round(c, 6) AS range_similarity,
    round(score, 6) AS similarity, array_to_string(i, '; ') AS issues, score >= 0.6::DOUBLE AND len(i) = 0 AS valid FROM q""")
def pooled_similarity(spark: SparkSession, d: str) -> DataFrame:
    out = dr.pooled_similarity(dr.pooled_stats(_levels(spark, d), ["dataset"]), "real", "synthetic")
    return rounded(out.withColumn("issues", as_text("issues")))


@query("feature_compare", with_views(FEAT) + """, s AS (SELECT feature, """ + ", ".join(
    f"{fn}(CASE WHEN dataset = '{ds}' THEN value END) AS {name}{n}" for n, ds in ((1, "baseline"), (2, "current"))
    for fn, name in (("avg", "mean"), ("stddev_pop", "std"), ("min", "min"), ("max", "max"))) + """ FROM v_feat GROUP BY feature)
  SELECT feature, """ + ", ".join(f"round({c}{n}, 4) AS {c}{n}" for n in (1, 2) for c in ("mean", "std", "min", "max")) + """,
    round(1 - least(1, abs(mean1 - mean2) / greatest(mean1, mean2, 0.001::DOUBLE)), 6) AS similarity FROM s""")
def feature_compare(spark: SparkSession, d: str) -> DataFrame:
    out = dr.feature_compare(_long(spark, d), "baseline", "current")
    return out.select("feature", *[F.round(f"{c}{n}", 4).alias(f"{c}{n}") for n in (1, 2)
                                   for c in ("mean", "std", "min", "max")], F.round("similarity", 6).alias("similarity"))


@query("feature_report", with_views(FEAT, CURVE) + """, m AS (SELECT feature, avg(CASE WHEN dataset = 'baseline' THEN value END) AS mean1,
    avg(CASE WHEN dataset = 'current' THEN value END) AS mean2, quantile_cont(CASE WHEN dataset = 'baseline' THEN value END, 0.5) AS median1,
    quantile_cont(CASE WHEN dataset = 'current' THEN value END, 0.5) AS median2 FROM v_feat GROUP BY feature),
  s AS (SELECT *, 1 - least(1, abs(mean1 - mean2) / greatest(mean1, mean2, 0.001::DOUBLE)) AS similarity FROM m),
  o AS (SELECT avg(similarity) AS overall FROM s)
  SELECT feature, round(median1, 6) AS median1, round(median2, 6) AS median2, round(ks, 6) AS ks, round(u, 1) AS mann_whitney_u, round(similarity, 6) AS similarity,
    round(overall, 6) AS overall_similarity, CASE WHEN overall >= 0.9::DOUBLE THEN 'excellent' WHEN overall >= 0.7::DOUBLE THEN 'good'
      WHEN overall >= 0.5::DOUBLE THEN 'acceptable' ELSE 'poor' END AS assessment FROM s JOIN v_dist USING (feature), o""")
def feature_report(spark: SparkSession, d: str) -> DataFrame:
    out = dr.feature_report(_long(spark, d), "baseline", "current")
    return rounded(out.select("feature", "median1", "median2", "ks", F.round("mann_whitney_u", 1).alias("mann_whitney_u"), "similarity", "overall_similarity", "assessment"))


@query("sketch_days", """SELECT strftime(date_trunc('day', l_shipdate), '%Y-%m-%d') AS day, f.feature, count(f.value) AS n, min(f.value) AS low, max(f.value) AS high
  FROM lineitem, LATERAL (VALUES ('l_quantity', l_quantity), ('l_extendedprice', l_extendedprice), ('l_discount', l_discount), ('l_tax', l_tax)) AS f(feature, value)
  GROUP BY 1, 2""")
def sketch_days(spark: SparkSession, d: str) -> DataFrame:
    """The exact part of the table of daily sketches."""
    return _daily(spark, d).select("day", "feature", "n", "low", "high")


def _daily(spark: SparkSession, d: str) -> DataFrame:
    """Quantile and distinct sketches of every feature and ship day."""
    rows = table(spark, d, "lineitem").select(
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("at"), F.col("l_partkey").alias("item"),
        F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("value")) for c in views.FEATURES])))
    return sketches.daily_sketches(rows, F.col("at"), ["feature"], "value", "item")


@query("sketch_drift")
def sketch_drift(spark: SparkSession, d: str) -> DataFrame:
    """Drift of the days from the cut on against the days before, from the stored sketches alone (the rows are read once, to build them).

    Within the stated bounds of ``ks_stat`` and ``wasserstein``; sketches draw, so no SQL gives the same digits.
    """
    daily = pin(_daily(spark, d))
    sides = [sketches.merged(daily.filter(c), ["feature"]) for c in (F.col("day") < views.DRIFT_CUT, F.col("day") >= views.DRIFT_CUT)]
    users = [sketches.quantiles(s, ["feature"], {f"median{i}": 0.5}).select("feature", f"median{i}", F.col("distinct").alias(f"distinct{i}")) for i, s in enumerate(sides, 1)]
    return sketches.sketch_distances(*sides, ["feature"]).join(users[0], "feature").join(users[1], "feature")


REPORT = RGB + ",\n" + raster.FEATURE_SQL + ",\n" + raster.HSV + """,
v_water AS (SELECT vec_id, count_if(h BETWEEN 90 AND 130 AND s >= 50 AND vv >= 50) / count(*)::DOUBLE AS water FROM v_hsv GROUP BY 1),
v_bal AS (SELECT vec_id, 1 - stddev_pop(t.m) / avg(t.m) AS balance FROM (SELECT vec_id, avg(r) AS r, avg(g) AS g, avg(b) AS b FROM v_rgb GROUP BY 1),
  LATERAL (VALUES (r), (g), (b)) AS t(m) GROUP BY 1),
v_ent AS (SELECT vec_id, -sum(p * log2(p + 0.0000000001::DOUBLE)) AS entropy FROM (SELECT vec_id, v, count(*) / 64::DOUBLE AS p FROM v_gr GROUP BY 1, 2) GROUP BY 1),
v_dyn AS (SELECT vec_id, (max(v) - min(v)) / 255 AS dyn FROM v_gr GROUP BY 1),
v_set AS (SELECT vec_id, CASE WHEN label < 4 THEN 'baseline' WHEN label < 8 THEN 'current' ELSE 'synthetic' END AS dataset FROM embeddings),
v_img AS (SELECT f.vec_id, 8 AS width, 8 AS height, brightness, contrast / 255 AS contrast, sharpness, water AS ocean_coverage, false AS is_corrupted,
  entropy, dyn, balance FROM v_fv f JOIN v_water USING (vec_id) JOIN v_bal USING (vec_id) JOIN v_ent USING (vec_id) JOIN v_dyn USING (vec_id)
  JOIN v_set USING (vec_id) WHERE dataset = 'current')"""


def report_ks(first: str, second: str, name: str) -> str:
    """CTE: KS of every feature between two of the three sets."""
    return f"""{name} AS (SELECT feature, max(abs(c1 / t1::DOUBLE - c2 / t2::DOUBLE)) AS ks FROM (SELECT feature, sum(n1) OVER w AS c1, sum(n2) OVER w AS c2,
  sum(n1) OVER f AS t1, sum(n2) OVER f AS t2 FROM (SELECT feature, value, count_if(dataset = '{first}') AS n1, count_if(dataset = '{second}') AS n2
  FROM v_rf GROUP BY 1, 2) WINDOW w AS (PARTITION BY feature ORDER BY value), f AS (PARTITION BY feature)) GROUP BY feature)"""


REPORT_FEATURES = f"""v_e AS (SELECT vec_id, {raster.FEATURE_COLUMNS} FROM v_fv), v_rf AS (SELECT dataset, f.feature, f.value FROM v_e JOIN v_set USING (vec_id),
  LATERAL (VALUES {', '.join(f"('{c}', {c})" for c in ra.FEATURES)}) AS f(feature, value))"""


@query("dataset_report", with_views(REPORT, PROFILE, FILE, REPORT_FEATURES, report_ks("baseline", "current", "v_all"), report_ks("current", "synthetic", "v_match"),
       "v_named AS (SELECT * FROM v_all WHERE feature IN (" + ", ".join(f"'{c}'" for c in dr.DRIFT_FEATURES) + "))",
       rules_sql(rules.QUALITY + rules.HEALTH + rules.DRIFT)) + """,
  d AS (SELECT avg(ks) AS drift, avg(ks) > 0.1::DOUBLE AS detected, coalesce(list(feature ORDER BY feature) FILTER (WHERE ks > 0.1::DOUBLE), []) AS affected FROM v_named),
  f AS (SELECT count(*) AS files, 100 * count_if(NOT valid) / count(*)::DOUBLE AS missing, 100 * (count(*) - count(DISTINCT content_hash)) / count(*)::DOUBLE AS dup,
    1 / count(DISTINCT ext)::DOUBLE AS formats, (epoch(TIMESTAMP '2025-01-01') - epoch(max(modified))) / 3600 AS age FROM v_file),
  a AS (SELECT list_concat(list_filter([CASE WHEN quality_score < 0.7::DOUBLE THEN 'quality below threshold' END, CASE WHEN detected THEN 'data drift detected' END], lambda x: x IS NOT NULL),
    list_concat(CASE WHEN detected THEN list_transform(affected, lambda x: 'affected feature: ' || x) ELSE [] END,
      list_filter([CASE WHEN age > 24 THEN 'data is stale' END], lambda x: x IS NOT NULL))) AS alerts FROM q, d, f),
  m AS (SELECT 'critical_issues' AS metric, count(CASE WHEN severity = 'critical' THEN 1 END)::DOUBLE AS value FROM i
    UNION ALL SELECT 'high_issues', count(CASE WHEN severity = 'high' THEN 1 END) FROM i
    UNION ALL SELECT 'low_resolution_or_blur', count(CASE WHEN issue IN ('low_resolution', 'blur') THEN 1 END) FROM i
    UNION ALL SELECT 'no_ocean_content', count(CASE WHEN issue = 'no_ocean_content' THEN 1 END) FROM i
    UNION ALL SELECT 'corruption', count(CASE WHEN issue = 'corruption' THEN 1 END) FROM i UNION ALL SELECT 'issues', count(*) FROM i
    UNION ALL SELECT 'quality_score', quality_score FROM q UNION ALL SELECT 'freshness_hours', age FROM f UNION ALL SELECT 'duplicate_percentage', dup FROM f
    UNION ALL SELECT 'total_samples', n FROM p UNION ALL SELECT 'alerts', len(alerts) FROM a
    UNION ALL SELECT 'drift_detected', CASE WHEN detected THEN 1 ELSE 0 END FROM d UNION ALL SELECT feature, ks FROM v_named, d WHERE detected),
  t AS (SELECT string_agg(text, '; ' ORDER BY text) AS recommendations FROM (SELECT DISTINCT text FROM m JOIN v_rule USING (metric) WHERE """ + FIRES + """)),
  s AS (SELECT count(*) AS images, count_if(is_corrupted)::BIGINT AS corrupted, avg(width) AS mean_width, avg(height) AS mean_height, avg(brightness) AS mean_brightness,
    avg(contrast) AS mean_contrast, avg(dyn) AS mean_dynamic_range, avg(entropy) AS mean_entropy, avg(sharpness) AS mean_sharpness, avg(balance) AS mean_colour_balance,
    avg(ocean_coverage) AS mean_coverage FROM v_img),
  k AS (SELECT avg(ks) AS ks FROM v_match)
  SELECT images, corrupted, """ + ", ".join(f"round({c}, 6) AS {c}" for c in (
      "mean_width", "mean_height", "mean_brightness", "mean_contrast", "mean_dynamic_range", "mean_entropy", "mean_sharpness", "mean_colour_balance", "mean_coverage"))
    + """, files, round(quality_score, 6) AS quality_score, round(drift, 6) AS drift_score, anomaly_count, round(missing, 6) AS missing_percentage,
    round(dup, 6) AS duplicate_percentage, round(formats, 6) AS format_consistency, round(age, 6) AS freshness_hours, array_to_string(alerts, '; ') AS alerts,
    round(ks, 6) AS match_ks, CASE WHEN ks IS NOT NULL THEN round(greatest(0, 1 - ks), 6) END AS match_score,
    (SELECT coalesce(string_agg(severity || ': ' || issue || ' (' || affected || ')', '; ' ORDER BY severity || ': ' || issue || ' (' || affected || ')'), '') FROM i) AS issues, recommendations
  FROM s, q, d, f, a, k, t""")
def dataset_report(spark: SparkSession, d: str) -> DataFrame:
    """Report on the images of labels 4-7, with 0-3 as baseline and 8-9 as synthetic set."""
    label = F.col("label")
    sets = table(spark, d, "embeddings").select("vec_id", F.when(label < 4, report.BASELINE).when(label < 8, report.CURRENT).otherwise(report.SYNTHETIC).alias("dataset"))
    images = views.rgb_images(spark, d).join(sets, "vec_id").withColumnRenamed("vec_id", "image_id")
    row = report.dataset_report(images, views.files(spark, d), F.lit("2025-01-01").cast("timestamp_ntz"))
    return rounded(row.withColumns({c: F.array_join(c, "; ") for c in ("alerts", "issues", "recommendations")}))
