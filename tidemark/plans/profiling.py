"""Queries that profile files and images and gate them row by row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.rounding import as_text, rounded
from tidemark.operators import bands, gates
from tidemark.operators import drift as dr
from tidemark.operators import profiling as pr
from tidemark.operators import rules
from tidemark.operators.joins import metric_rows, recommend, skew_join
from tidemark.plans import views
from tidemark.plans.registry import query
from tidemark.plans.views_sql import FEAT, FILE, IMG, LAB, PRED, with_views
from tidemark.sources.tables import table


# --- profiles --------------------------------------------------------------------------------------
@query("resolution_profile", with_views(IMG) + """, a AS (SELECT *, width * height AS area,
  width::VARCHAR || 'x' || height::VARCHAR AS size FROM v_img)
  SELECT camera, count(*) AS n, round(avg(width), 6) AS mean_width, round(stddev_pop(width), 6) AS std_width,
    round(avg(height), 6) AS mean_height, round(stddev_pop(height), 6) AS std_height,
    arg_min(size, area * 100000 + width) AS smallest, arg_max(size, area * 100000 + width) AS largest,
    count_if(area < 307200)::BIGINT AS below_480p, count_if(area > 8294400)::BIGINT AS above_4k FROM a GROUP BY camera""")
def resolution_profile(spark: SparkSession, d: str) -> DataFrame:
    return rounded(pr.resolution_profile(views.images(spark, d), ["camera"]))


def _raster_measures(spark: SparkSession, d: str) -> DataFrame:
    from tidemark.operators import raster as ra
    r = views.rasters(spark, d)
    grey = r.withColumn("px", F.transform("px", lambda v: F.floor(v * 255).cast("double")))
    return ra.image_measures(grey)


RASTER_MEASURES = """m AS (SELECT vec_id, stddev_pop(v) / avg(v) AS contrast, (max(v) - min(v)) / 255 AS dynamic_range
  FROM v_grey GROUP BY vec_id),
h AS (SELECT vec_id, -sum(p * log2(p + 0.0000000001::DOUBLE)) AS entropy FROM (SELECT vec_id, v, count(*) / 64::DOUBLE AS p
  FROM v_grey GROUP BY vec_id, v) GROUP BY vec_id)"""


@query("contrast_profile", with_views("""v_raw AS (SELECT vec_id, embedding[i]::DOUBLE AS raw FROM embeddings,
  unnest(range(1, 65)) AS t(i)),
v_ext AS (SELECT vec_id, min(raw) AS lo, max(raw) AS hi FROM v_raw GROUP BY vec_id),
v_grey AS (SELECT vec_id, floor((raw - lo) / (hi - lo) * 255) AS v FROM v_raw JOIN v_ext USING (vec_id))""",
       RASTER_MEASURES) + """SELECT round(avg(contrast), 6) AS mean_contrast,
  round(stddev_pop(contrast), 6) AS std_contrast, round(avg(dynamic_range), 6) AS mean_dynamic_range,
  round(stddev_pop(dynamic_range), 6) AS std_dynamic_range,
  count_if(contrast < 0.1::DOUBLE)::BIGINT AS low_contrast, count_if(contrast > 0.5::DOUBLE)::BIGINT AS high_contrast,
  round(avg(entropy), 6) AS mean_entropy FROM m JOIN h USING (vec_id)""")
def contrast_profile(spark: SparkSession, d: str) -> DataFrame:
    return rounded(pr.contrast_profile(_raster_measures(spark, d)))


@query("clarity_profile", with_views(IMG) + """SELECT camera, round(avg(sharpness), 6) AS mean_sharpness,
  round(stddev_pop(sharpness), 6) AS std_sharpness, round(avg(1 / (1 + sharpness)), 6) AS mean_blur,
  round(stddev_pop(1 / (1 + sharpness)), 6) AS std_blur, count_if(sharpness < 100)::BIGINT AS blurry,
  count_if(sharpness > 500)::BIGINT AS sharp FROM v_img GROUP BY camera""")
def clarity_profile(spark: SparkSession, d: str) -> DataFrame:
    df = views.images(spark, d).withColumn("blur", 1 / (1 + F.col("sharpness")))
    return rounded(pr.clarity_profile(df, ["camera"]))


@query("coverage_profile", with_views(IMG) + """SELECT camera, round(avg(ocean_coverage), 6) AS mean_coverage,
  round(stddev_pop(ocean_coverage), 6) AS std_coverage, round(min(ocean_coverage), 6) AS min_coverage,
  round(max(ocean_coverage), 6) AS max_coverage, count_if(ocean_coverage < 0.3::DOUBLE)::BIGINT AS low_coverage,
  count_if(ocean_coverage < 0.1::DOUBLE)::BIGINT AS no_ocean FROM v_img GROUP BY camera""")
def coverage_profile(spark: SparkSession, d: str) -> DataFrame:
    return rounded(pr.coverage_profile(views.images(spark, d), ["camera"]))


@query("file_profile", with_views(FILE) + """SELECT folder, count(*) AS n, round(sum(length) / 1048576::DOUBLE, 6) AS total_mb,
  round(avg(length) / 1024, 6) AS mean_kb, strftime(min(modified), '%Y-%m-%d %H:%M:%S') AS first_modified,
  strftime(max(modified), '%Y-%m-%d %H:%M:%S') AS last_modified, count_if(NOT valid)::BIGINT AS corrupted
  FROM v_file GROUP BY folder""")
def file_profile(spark: SparkSession, d: str) -> DataFrame:
    out = rounded(pr.file_profile(views.files(spark, d), ["folder"]))
    return out.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("first_modified", "last_modified")})


@query("distribution", with_views(FILE) + """SELECT ext, count(*) AS n,
  round(100 * count(*) / (sum(count(*)) OVER ())::DOUBLE, 6) AS percentage FROM v_file GROUP BY ext""")
def distribution(spark: SparkSession, d: str) -> DataFrame:
    return rounded(pr.distribution(views.listing(spark, d), "ext"))


DUP = """SELECT (sum(n) - count(*))::BIGINT AS duplicates, count_if(n > 1)::BIGINT AS repeated_keys
  FROM (SELECT count(*) AS n FROM v_file GROUP BY {key})"""


@query("dup_by_length", with_views(FILE) + DUP.format(key="length"))
def dup_by_length(spark: SparkSession, d: str) -> DataFrame:
    return pr.duplicate_count(views.listing(spark, d), "length")


@query("dup_by_hash", with_views(FILE) + DUP.format(key="content_hash"))
def dup_by_hash(spark: SparkSession, d: str) -> DataFrame:
    return pr.duplicate_count(views.listing(spark, d), "content_hash")


@query("dir_structure", with_views(FILE) + """SELECT regexp_extract(path, '^(.*)/', 1) AS directory, count(*) AS files
  FROM v_file GROUP BY 1""")
def dir_structure(spark: SparkSession, d: str) -> DataFrame:
    return pr.dir_structure(views.listing(spark, d))


PROFILE = """p AS (SELECT count(*) AS n, count_if(width * height < 307200) AS low_resolution,
  count_if(contrast < 0.1::DOUBLE) AS low_contrast, count_if(sharpness < 100) AS blur,
  count_if(ocean_coverage < 0.1::DOUBLE) AS no_ocean_content, count_if(is_corrupted) AS corruption,
  avg(contrast) AS mc, avg(sharpness) AS ms, avg(ocean_coverage) AS mo FROM v_img),
i AS (SELECT r.issue, r.severity, r.affected::BIGINT AS affected, 100 * r.affected / n::DOUBLE AS percentage, r.w
  FROM p, LATERAL (VALUES
  ('low_resolution', 'high', low_resolution, 0, 0.2), ('low_contrast', 'medium', low_contrast, 0.1, 0.1),
  ('blur', 'high', blur, 0.15, 0.2), ('no_ocean_content', 'critical', no_ocean_content, 0, 0.3),
  ('corruption', 'critical', corruption, 0, 0.3)) AS r(issue, severity, affected, share, w) WHERE r.affected > n * r.share::DOUBLE),
q AS (SELECT (SELECT count(*) FROM i WHERE severity IN ('high', 'critical')) AS anomaly_count,
  greatest(0, least(1, 1 - coalesce((SELECT sum(w::DOUBLE * percentage / 100) FROM i), 0)
  + CASE WHEN mc > 0.2::DOUBLE THEN 0.05::DOUBLE ELSE 0 END + CASE WHEN ms > 200 THEN 0.05::DOUBLE ELSE 0 END
  + CASE WHEN mo > 0.5::DOUBLE THEN 0.05::DOUBLE ELSE 0 END)) AS quality_score FROM p)"""


@query("quality_issues", with_views(IMG, PROFILE) + """SELECT issue, severity, affected,
  round(percentage, 6) AS percentage FROM i""")
def quality_issues(spark: SparkSession, d: str) -> DataFrame:
    return rounded(pr.quality_issues(pr.image_profile(views.images(spark, d))))


@query("quality_score", with_views(IMG, PROFILE) +
       "SELECT anomaly_count, round(quality_score, 6) AS quality_score FROM q")
def quality_score(spark: SparkSession, d: str) -> DataFrame:
    return rounded(pr.quality_score(pr.image_profile(views.images(spark, d))))


@query("dataset_checksum", with_views(FILE) + """, h AS (SELECT folder, md5(path || ':' || length::VARCHAR) AS m FROM v_file)
  SELECT folder, count(*) AS files, md5(count(*)::VARCHAR
    || '|' || sum(('0x' || substr(m, 1, 7))::BIGINT)::VARCHAR || '|' || sum(('0x' || substr(m, 8, 7))::BIGINT)::VARCHAR
    || '|' || sum(('0x' || substr(m, 15, 7))::BIGINT)::VARCHAR || '|' || sum(('0x' || substr(m, 22, 7))::BIGINT)::VARCHAR)
    AS checksum FROM h GROUP BY folder""")
def dataset_checksum(spark: SparkSession, d: str) -> DataFrame:
    return pr.dataset_checksum(views.listing(spark, d), ["folder"])


@query("dataset_fingerprint", with_views(FILE).replace("WITH ", "WITH RECURSIVE ", 1) + f""", r AS (SELECT folder, row_number() OVER (PARTITION BY folder ORDER BY path, length) - 1 AS pos,
    sha256(coalesce(strlen(path) || ':' || path, '-') || coalesce(strlen(length::VARCHAR) || ':' || length, '-')) AS digest, count(*) OVER (PARTITION BY folder) AS n FROM v_file),
  t(folder, level, pos, digest, n) AS (SELECT folder, 0, pos, digest, n FROM r
    UNION ALL SELECT folder, level + 1, pos // {pr.FINGERPRINT_FANOUT}, sha256(string_agg(digest, '' ORDER BY pos)), (n + {pr.FINGERPRINT_FANOUT - 1}) // {pr.FINGERPRINT_FANOUT}
    FROM t WHERE n > 1 OR level = 0 GROUP BY folder, level, pos // {pr.FINGERPRINT_FANOUT}, n)
  SELECT folder, count(*) AS files, (SELECT arg_max(digest, level) FROM t WHERE t.folder IS NOT DISTINCT FROM r.folder) AS fingerprint FROM r GROUP BY folder""")
def dataset_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    """Order-true fingerprint of each folder's listing."""
    return pr.ordered_checksum(views.listing(spark, d), ["folder"], ["path", "length"]).select("folder", "files", "fingerprint")


def rules_sql(rules: list) -> str:
    return "v_rule AS (SELECT * FROM (VALUES " + ", ".join(
        f"('{m}', '{o}', {t}::DOUBLE, '{x}')" for m, o, t, x in rules) + ") AS r(metric, op, threshold, text))"


FIRES = """CASE op WHEN '<' THEN value < threshold WHEN '>' THEN value > threshold WHEN '<=' THEN value <= threshold
  WHEN '>=' THEN value >= threshold ELSE value = threshold END"""


KS = """v_kc AS (SELECT feature, value, count_if(dataset = 'baseline') AS n1, count_if(dataset = 'current') AS n2 FROM v_feat GROUP BY 1, 2),
v_ks AS (SELECT feature, max(abs(c1 / t1::DOUBLE - c2 / t2::DOUBLE)) AS ks FROM (SELECT feature, sum(n1) OVER w AS c1, sum(n2) OVER w AS c2,
  sum(n1) OVER f AS t1, sum(n2) OVER f AS t2 FROM v_kc WINDOW w AS (PARTITION BY feature ORDER BY value), f AS (PARTITION BY feature)) GROUP BY feature)"""


@query("dataset_recommendations", with_views(IMG, PROFILE, FILE, FEAT, KS, rules_sql(rules.QUALITY + rules.HEALTH)) + """,
  f AS (SELECT count(*)::DOUBLE AS total_samples, 100 * (count(*) - count(DISTINCT content_hash)) / count(*)::DOUBLE AS dup,
    (epoch(TIMESTAMP '2025-01-01') - epoch(max(modified))) / 3600 AS age FROM v_file),
  m AS (SELECT 'critical_issues' AS metric, count(CASE WHEN severity = 'critical' THEN 1 END)::DOUBLE AS value FROM i
    UNION ALL SELECT 'high_issues', count(CASE WHEN severity = 'high' THEN 1 END) FROM i
    UNION ALL SELECT 'low_resolution_or_blur', count(CASE WHEN issue IN ('low_resolution', 'blur') THEN 1 END) FROM i
    UNION ALL SELECT 'no_ocean_content', count(CASE WHEN issue = 'no_ocean_content' THEN 1 END) FROM i
    UNION ALL SELECT 'corruption', count(CASE WHEN issue = 'corruption' THEN 1 END) FROM i UNION ALL SELECT 'issues', count(*) FROM i
    UNION ALL SELECT 'quality_score', quality_score FROM q UNION ALL SELECT 'freshness_hours', age FROM f
    UNION ALL SELECT 'total_samples', total_samples FROM f UNION ALL SELECT 'duplicate_percentage', dup FROM f
    UNION ALL SELECT 'alerts', CASE WHEN quality_score < 0.7::DOUBLE THEN 1 ELSE 0 END + CASE WHEN age > 24 THEN 1 ELSE 0 END
      + (SELECT CASE WHEN avg(ks) > 0.1::DOUBLE THEN 1 + count_if(ks > 0.1::DOUBLE) ELSE 0 END FROM v_ks) FROM q, f)
  SELECT DISTINCT text FROM m JOIN v_rule USING (metric) WHERE """ + FIRES)
def dataset_recommendations(spark: SparkSession, d: str) -> DataFrame:
    images = views.images(spark, d)
    wide = views.features_wide(spark, d)
    drift = dr.drift_report(dr.to_long(wide, views.FEATURES), "baseline", "current")
    health = pr.health_row(views.files(spark, d), images, drift, F.lit("2025-01-01").cast("timestamp_ntz"))
    health = health.withColumn("alerts", F.size("alerts"))
    measured = metric_rows(pr.issue_counts(pr.image_profile(images)), [
        "critical_issues", "high_issues", "low_resolution_or_blur", "no_ocean_content", "corruption", "issues"])
    measured = measured.unionByName(metric_rows(health, [
        "alerts", "quality_score", "freshness_hours", "total_samples", "duplicate_percentage"]))
    return recommend(measured, rules.QUALITY + rules.HEALTH)


@query("describe", """WITH v AS (SELECT f.feature, f.value FROM lineitem, LATERAL (VALUES ('l_quantity', l_quantity),
  ('l_extendedprice', l_extendedprice), ('l_discount', l_discount), ('l_tax', l_tax)) AS f(feature, value))
  SELECT feature, count(value) AS count, round(avg(value), 4) AS mean, round(stddev_samp(value), 4) AS std,
    min(value) AS min, max(value) AS max, round(quantile_cont(value, 0.25), 4) AS q25,
    round(quantile_cont(value, 0.5), 4) AS q50, round(quantile_cont(value, 0.75), 4) AS q75 FROM v GROUP BY feature""")
def describe(spark: SparkSession, d: str) -> DataFrame:
    return rounded(pr.describe(table(spark, d, "lineitem").select(*views.FEATURES), views.FEATURES), 4)


def corr_sql(source: str, columns: list[str]) -> str:
    return " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r FROM {source}"
                              for i, a in enumerate(columns) for b in columns[i + 1:])


MEASURES = ["width", "height", "contrast", "sharpness", "file_bytes", "quality_score"]


@query("correlation", f"SELECT a, b, round(r, 6) AS r FROM ({corr_sql('lineitem', views.FEATURES)})")
def correlation(spark: SparkSession, d: str) -> DataFrame:
    return rounded(pr.correlation(table(spark, d, "lineitem"), views.FEATURES))


@query("top_correlations", with_views(IMG) + f"""SELECT a, b, round(r, 6) AS r FROM ({corr_sql('v_img', MEASURES)}) WHERE abs(r) > 0.02::DOUBLE
  ORDER BY round(abs(r), 9) DESC, a, b LIMIT 5""")
def top_correlations(spark: SparkSession, d: str) -> DataFrame:
    return rounded(pr.top_correlations(views.images(spark, d), MEASURES, at_least=0.02))


@query("overview", """WITH q AS (SELECT d.*, l.quality FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) l USING (doc_id)),
  k AS (SELECT 'documents' AS kind, count(*) AS n, sum(n_chars)::DOUBLE AS size, count(DISTINCT source) AS sources, avg(quality)::DOUBLE AS mean_quality,
      count_if(quality > 0.8::DOUBLE)::BIGINT AS high_quality FROM q
    UNION ALL SELECT 'depth_maps', count(*), sum(len(embedding))::DOUBLE, count(DISTINCT label), NULL, 0 FROM embeddings
    UNION ALL SELECT 'synthetic', count(*), sum(p_size)::DOUBLE, count(DISTINCT p_brand), avg((p_partkey % 89) / 89::DOUBLE),
      count_if((p_partkey % 89) / 89::DOUBLE > 0.8::DOUBLE)::BIGINT FROM part)
  SELECT kind, n, size, sources, round(mean_quality, 6) AS mean_quality, high_quality, round(n / greatest(sources, 1)::DOUBLE, 6) AS per_source,
    round((SELECT n FROM k WHERE kind = 'synthetic') / (SELECT sum(n) FROM k WHERE kind <> 'depth_maps')::DOUBLE, 6) AS synthetic_ratio FROM k""")
def overview(spark: SparkSession, d: str) -> DataFrame:
    """Counts, sizes, quality and sources of each kind of data; the synthetic share is of documents and synthetic rows."""
    labels = table(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    documents = table(spark, d, "documents").select("doc_id", "n_chars", "source").join(labels, "doc_id", "left")
    parts = table(spark, d, "part").withColumn("quality", (F.col("p_partkey") % 89) / 89)

    def one(kind: str, df: DataFrame, size, source: str, quality: Column) -> DataFrame:
        return df.agg(F.lit(kind).alias("kind"), F.count("*").alias("n"), F.sum(size).cast("double").alias("size"),
                      F.countDistinct(source).alias("sources"), F.avg(quality).cast("double").alias("mean_quality"),
                      F.count_if(quality > 0.8).alias("high_quality"))
    none = F.lit(None).cast("double")
    kinds = one("documents", documents, F.col("n_chars"), "source", F.col("quality")) \
        .unionByName(one("depth_maps", table(spark, d, "embeddings"), F.size("embedding"), "label", none)) \
        .unionByName(one("synthetic", parts, F.col("p_size"), "p_brand", F.col("quality")))
    whole = Window.partitionBy()  # three rows
    n = F.col("n")
    synthetic = F.sum(F.when(F.col("kind") == "synthetic", n)).over(whole) / F.sum(F.when(F.col("kind") != "depth_maps", n)).over(whole)
    return rounded(kinds.withColumns({"per_source": n / F.greatest("sources", F.lit(1)), "synthetic_ratio": synthetic}))


@query("distinct_sources", """SELECT event_type, count(DISTINCT user_id) AS users, count(*) AS n FROM events
  GROUP BY event_type""")
def distinct_sources(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("event_type").agg(
        F.countDistinct("user_id").alias("users"), F.count("*").alias("n"))


# --- top-k, samples, sets --------------------------------------------------------------------------
@query("topk_values", """SELECT p_name, count(*) AS n FROM part GROUP BY p_name ORDER BY n DESC, p_name LIMIT 10""")
def topk_values(spark: SparkSession, d: str) -> DataFrame:
    return pr.topk_values(table(spark, d, "part"), "p_name", 10)


@query("extremes", with_views(IMG) + " UNION ALL ".join(f"""
  SELECT '{m}' AS metric, (SELECT image_id FROM v_img ORDER BY {m}, image_id LIMIT 1) AS lowest,
    (SELECT min({m})::DOUBLE FROM v_img) AS low, (SELECT image_id FROM v_img ORDER BY {m} DESC, image_id LIMIT 1) AS highest,
    (SELECT max({m})::DOUBLE FROM v_img) AS high""" for m in ("contrast", "sharpness", "file_bytes", "brightness_std")))
def extremes(spark: SparkSession, d: str) -> DataFrame:
    return pr.extremes(views.images(spark, d), "image_id", ["contrast", "sharpness", "file_bytes", "brightness_std"])


@query("sample_hash", """SELECT doc_id, n_chars FROM documents ORDER BY md5('42-' || doc_id::VARCHAR), doc_id LIMIT 100""")
def sample_hash(spark: SparkSession, d: str) -> DataFrame:
    return pr.sample_hash(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id", 100, 42)


@query("first_failures", with_views(FILE) + "SELECT path, length FROM v_file WHERE NOT valid ORDER BY path LIMIT 10")
def first_failures(spark: SparkSession, d: str) -> DataFrame:
    return views.files(spark, d).filter(~F.col("valid")).select("path", "length").orderBy("path").limit(10)


@query("union_distinct", """SELECT source AS name FROM documents UNION SELECT p_brand FROM part
  UNION SELECT event_type FROM events""")
def union_distinct(spark: SparkSession, d: str) -> DataFrame:
    parts = [table(spark, d, t).select(F.col(c).alias("name")).distinct()
             for t, c in (("documents", "source"), ("part", "p_brand"), ("events", "event_type"))]
    return parts[0].union(parts[1]).union(parts[2]).distinct()


@query("except_missing", "SELECT doc_id AS id FROM documents EXCEPT SELECT doc_id FROM labels")
def except_missing(spark: SparkSession, d: str) -> DataFrame:
    required = table(spark, d, "documents").select(F.col("doc_id").alias("id"))
    return required.subtract(table(spark, d, "labels").select(F.col("doc_id").alias("id")))


@query("intersect_features", """SELECT c_nationkey AS feature FROM customer INTERSECT SELECT s_nationkey FROM supplier""")
def intersect_features(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("feature")) \
        .intersect(table(spark, d, "supplier").select(F.col("s_nationkey").alias("feature")))


# --- gates -----------------------------------------------------------------------------------------
@query("image_gate", with_views(IMG) + """SELECT image_id, width BETWEEN 640 AND 3840 AND height BETWEEN 480 AND 2160
  AND channels = 3 AND format IN ('JPEG', 'PNG', 'WEBP') AS accepted FROM v_img""")
def image_gate(spark: SparkSession, d: str) -> DataFrame:
    return views.images(spark, d).select("image_id", gates.image_gate().alias("accepted"))


@query("file_gate", with_views(IMG) + """SELECT image_id, CASE WHEN file_bytes < 1024 THEN 'file too small'
  WHEN file_bytes > 52428800 THEN 'file too large' WHEN lower(format) NOT IN ('jpg', 'jpeg', 'png', 'bmp', 'tiff', 'tif') THEN 'unsupported format'
  WHEN width < 224 OR height < 224 THEN 'resolution too low'
  WHEN width > 4096 OR height > 4096 THEN 'resolution too high' END AS issue, issue IS NULL AS valid FROM v_img""")
def file_gate(spark: SparkSession, d: str) -> DataFrame:
    df = views.images(spark, d).withColumnRenamed("format", "ext")
    return gates.file_gate(df).select("image_id", "issue", "valid")


@query("image_issues", with_views(IMG) + """, i AS (SELECT image_id, quality_score, list_filter([
  CASE WHEN brightness_std < 10 THEN 'very low brightness variation' END,
  CASE WHEN contrast < 0.1::DOUBLE THEN 'very low contrast' END,
  CASE WHEN sharpness < 0.1::DOUBLE THEN 'very low sharpness' END], lambda x: x IS NOT NULL) AS issues FROM v_img)
  SELECT image_id, array_to_string(issues, '; ') AS issues,
    quality_score >= 0.7::DOUBLE AND len(issues) = 0 AS valid FROM i""")
def image_issues(spark: SparkSession, d: str) -> DataFrame:
    return gates.image_issues(views.images(spark, d)).select("image_id", as_text("issues"), "valid")


@query("image_valid", with_views(IMG) + """SELECT image_id, NOT is_corrupted AND width >= 480 AND height >= 480
  AND contrast >= 0.1::DOUBLE AND ocean_coverage >= 0.3::DOUBLE AND quality_score >= 0.5::DOUBLE AS valid FROM v_img""")
def image_valid(spark: SparkSession, d: str) -> DataFrame:
    return views.images(spark, d).select("image_id", gates.image_valid().alias("valid"))


@query("depth_valid", with_views(IMG) + """SELECT image_id, edge_preservation >= 0.3::DOUBLE AND contrast >= 0.1::DOUBLE
    AND quality_score >= 0.5::DOUBLE AS valid_edges,
  contrast * 2 >= 0.01::DOUBLE AND contrast >= 0.01::DOUBLE AND quality_score >= 0.7::DOUBLE AS valid_range FROM v_img""")
def depth_valid(spark: SparkSession, d: str) -> DataFrame:
    df = views.images(spark, d).withColumns({"depth_range": F.col("contrast") * 2, "depth_std": F.col("contrast")})
    return df.select("image_id", gates.depth_valid().alias("valid_edges"), gates.depth_valid("range").alias("valid_range"))


@query("extreme_flag", with_views(PRED) + """SELECT model,
  count_if(h_true < 0.8::DOUBLE OR h_true > 6)::BIGINT AS label_extreme,
  count_if(h_pred < 0.5::DOUBLE OR h_pred > 8)::BIGINT AS prediction_extreme FROM v_pred GROUP BY model""")
def extreme_flag(spark: SparkSession, d: str) -> DataFrame:
    from tidemark.operators.evaluation import extreme
    return views.predictions(spark, d).groupBy("model").agg(
        F.count_if(extreme(F.col("h_true"), 0.8, 6.0)).alias("label_extreme"),
        F.count_if(extreme(F.col("h_pred"))).alias("prediction_extreme"))


@query("default_rows", with_views(PRED, IMG) + """, v AS (SELECT p.*, coalesce(i.quality_score >= 0.5::DOUBLE, FALSE) AS ok
    FROM v_pred p LEFT JOIN v_img i USING (image_id))
  SELECT model, count(*) AS n, round(sum(CASE WHEN ok THEN h_pred ELSE 0 END), 4) AS sum_height,
    count(CASE WHEN NOT ok THEN 1 END) AS defaults, round(avg(CASE WHEN ok THEN conf_h ELSE 0 END), 6) AS confidence
  FROM v GROUP BY model""")
def default_rows(spark: SparkSession, d: str) -> DataFrame:
    quality = views.images(spark, d).select("image_id", "quality_score")
    df = skew_join(views.predictions(spark, d), quality, "image_id", "left").select(
        "model", "quality_score", F.col("h_pred").alias("height_meters"), F.lit("LEFT").alias("direction"),
        F.lit("SPILLING").alias("breaking_type"), F.col("conf_h").alias("confidence"))
    out = gates.default_rows(df, F.col("quality_score") >= 0.5)
    return out.groupBy("model").agg(
        F.count("*").alias("n"), F.round(F.sum("height_meters"), 4).alias("sum_height"),
        F.count_if(F.col("breaking_type") == "NO_BREAKING").alias("defaults"),
        F.round(F.avg("confidence"), 6).alias("confidence"))


@query("sample_frames", """SELECT conv_id AS video, turn AS frame, turn / 30::DOUBLE AS timestamp FROM conversations
  WHERE turn % 2 = 0""")
def sample_frames(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "conversations").select(F.col("conv_id").alias("video"), F.col("turn").alias("frame"))
    return gates.sample_frames(df, 2, 30.0)


@query("availability", """SELECT k.kind, count(d.doc_id) AS n, k.required::BIGINT AS required,
  count(d.doc_id) >= k.required AS enough FROM (VALUES ('de', 100), ('en', 100), ('fr', 500)) AS k(kind, required)
  LEFT JOIN documents d ON d.lang = k.kind GROUP BY k.kind, k.required""")
def availability(spark: SparkSession, d: str) -> DataFrame:
    return gates.availability(table(spark, d, "documents"), "lang", {"de": 100, "en": 100, "fr": 500})


@query("ready_batch", with_views(FILE) + "SELECT path FROM v_file WHERE valid")
def ready_batch(spark: SparkSession, d: str) -> DataFrame:
    return views.files(spark, d).filter("valid").select("path")


# --- bands -----------------------------------------------------------------------------------------
def ladder(col: str, bands_: list) -> str:
    whens = " ".join(f"WHEN {col} >= {low}::DOUBLE THEN '{name}'" for low, name in bands_ if low is not None)
    return f"CASE {whens} ELSE '{bands_[-1][1]}' END"


@query("rate_bands", with_views(IMG) + f"""SELECT image_id, {ladder('quality_score', bands.RATINGS['dataset'])} AS dataset,
  {ladder('quality_score', bands.RATINGS['stage'])} AS stage,
  {ladder('quality_score', bands.RATINGS['similarity'])} AS similarity,
  {ladder('quality_score', bands.RATINGS['diversity'])} AS diversity,
  CASE WHEN quality_score > 0.8::DOUBLE THEN 'HEALTHY' WHEN quality_score > 0.5::DOUBLE THEN 'DEGRADED'
    ELSE 'UNHEALTHY' END AS health FROM v_img""")
def rate_bands(spark: SparkSession, d: str) -> DataFrame:
    score = F.col("quality_score")
    return views.images(spark, d).select(
        "image_id", *[bands.rate(score, b).alias(name) for name, b in bands.RATINGS.items()],
        bands.health_rating(score).alias("health"))


@query("quality_cut", with_views(IMG) + """SELECT CASE WHEN quality_score > 0 AND quality_score <= 0.3::DOUBLE THEN 'Low'
  WHEN quality_score > 0.3::DOUBLE AND quality_score <= 0.7::DOUBLE THEN 'Medium'
  WHEN quality_score > 0.7::DOUBLE AND quality_score <= 1 THEN 'High' END AS band, count(*) AS n FROM v_img GROUP BY 1""")
def quality_cut(spark: SparkSession, d: str) -> DataFrame:
    return views.images(spark, d).groupBy(bands.cut(F.col("quality_score"), *bands.QUALITY_CUT).alias("band")) \
        .agg(F.count("*").alias("n"))


HEIGHT_CASE = """CASE WHEN height_meters >= 0.5::DOUBLE AND height_meters < 1.5::DOUBLE THEN '0.5-1.5m'
  WHEN height_meters >= 1.5::DOUBLE AND height_meters < 3 THEN '1.5-3.0m'
  WHEN height_meters >= 3 AND height_meters < 5 THEN '3.0-5.0m'
  WHEN height_meters >= 5 AND height_meters < 8 THEN '5.0-8.0m' END"""


@query("height_band", with_views(LAB) + f"SELECT {HEIGHT_CASE} AS band, count(*) AS n FROM v_lab GROUP BY 1")
def height_band(spark: SparkSession, d: str) -> DataFrame:
    return views.labels(spark, d).groupBy(bands.height_band(F.col("height_meters")).alias("band")) \
        .agg(F.count("*").alias("n"))


GUIDE = """guide AS (SELECT * FROM (VALUES (0.3::DOUBLE, 0.6::DOUBLE, 'Flat', 'Beginner practice'),
  (0.6, 1.2, 'Small', 'Beginner'), (1.2, 1.8, 'Medium', 'Intermediate'), (1.8, 2.4, 'Large', 'Advanced'),
  (2.4, NULL, 'Very Large', 'Expert')) AS g(low, high, surfability, skill))"""


@query("surfability", with_views(LAB, GUIDE) + """SELECT surfability, skill, count(*) AS n FROM v_lab LEFT JOIN guide
  ON height_meters >= low AND (high IS NULL OR height_meters < high) GROUP BY 1, 2""")
def surfability(spark: SparkSession, d: str) -> DataFrame:
    return bands.surfability(views.labels(spark, d), "height_meters").groupBy("surfability", "skill") \
        .agg(F.count("*").alias("n"))


@query("band_join", with_views(LAB, GUIDE) + """SELECT surfability, skill, low, count(*) AS n,
  round(avg(height_meters), 6) AS mean_height FROM v_lab JOIN guide
  ON height_meters >= low AND (high IS NULL OR height_meters < high) GROUP BY 1, 2, 3""")
def band_join(spark: SparkSession, d: str) -> DataFrame:
    df = bands.band_join(views.labels(spark, d), "height_meters", bands.SURF_GUIDE,
                         "low double, high double, surfability string, skill string")
    return rounded(df.groupBy("surfability", "skill", "low").agg(
        F.count("*").alias("n"), F.avg("height_meters").alias("mean_height")))
