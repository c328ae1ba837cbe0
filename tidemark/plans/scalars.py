"""One query per family of column functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import scalars as sc
from tidemark.functions.rounding import rounded
from tidemark.plans import views
from tidemark.plans.registry import query
from tidemark.plans.views_sql import FILE, LAB, with_views
from tidemark.sources.tables import table


@query("path_parts", with_views(FILE) + r"""SELECT path, lower(regexp_extract(path, '\.([^./]+)$', 1)) AS extension,
  doc_id::VARCHAR AS stem, folder AS parent, width::VARCHAR || 'x' || height::VARCHAR AS size_key,
  round(width / height::DOUBLE, 3) AS aspect_ratio FROM v_file""")
def path_parts(spark: SparkSession, d: str) -> DataFrame:
    p, w, h = F.col("path"), F.col("width"), F.col("height")
    return views.listing(spark, d).select(
        "path", sc.extension(p).alias("extension"), sc.stem(p).alias("stem"), sc.parent(p).alias("parent"),
        sc.size_key(w, h).alias("size_key"), sc.aspect_ratio(w, h).alias("aspect_ratio"))


@query("unit_conv", with_views(LAB, FILE) + """SELECT 'height' AS kind, count(*) AS n, round(avg(height_meters * 3.28084::DOUBLE), 9) AS a,
    round(max(height_meters * 3.28084::DOUBLE), 9) AS b FROM v_lab
  UNION ALL SELECT 'size', count(*), round(avg(length / 1024::DOUBLE), 9), round(max(length / 1048576::DOUBLE), 9) FROM v_file""")
def unit_conv(spark: SparkSession, d: str) -> DataFrame:
    ft = sc.feet(F.col("height_meters"))
    heights = views.labels(spark, d).agg(F.lit("height").alias("kind"), F.count("*").alias("n"),
                                         F.avg(ft).alias("a"), F.max(ft).alias("b"))
    sizes = views.listing(spark, d).agg(
        F.lit("size").alias("kind"), F.count("*").alias("n"), F.avg(sc.kilobytes(F.col("length"))).alias("a"),
        F.max(sc.megabytes(F.col("length"))).alias("b"))
    return rounded(heights.unionByName(sizes), 9)


@query("age_hours", with_views(FILE) + """SELECT doc_id, round((epoch_us(TIMESTAMP '2025-01-01') - epoch_us(modified)) / 3600000000::DOUBLE, 6) AS age_hours,
  strftime(modified, '%Y%m%d_%H%M%S') AS run_id FROM v_file""")
def age_hours(spark: SparkSession, d: str) -> DataFrame:
    return rounded(views.listing(spark, d).select(
        "doc_id", sc.age_hours(F.col("modified"), F.lit("2025-01-01").cast("timestamp_ntz")).alias("age_hours"),
        F.date_format("modified", "yyyyMMdd_HHmmss").alias("run_id")))


@query("md5_id", """SELECT doc_id, substr(md5(source || '_' || lang || '_' || doc_id::VARCHAR), 1, 16) AS dataset_id,
  md5(text) AS content_hash FROM documents""")
def md5_id(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(
        "doc_id", sc.short_id(F.col("source"), F.col("lang"), F.col("doc_id").cast("string")).alias("dataset_id"),
        F.md5(F.col("text").cast("binary")).alias("content_hash"))


@query("json_fields", """SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k,
  '{"id":' || event_id::VARCHAR || ',"type":"' || event_type || '"}' AS encoded FROM events""")
def json_fields(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(
        "event_id", F.from_json("props", "k bigint")["k"].alias("k"),
        F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("type"))).alias("encoded"))


@query("map_lookup", """SELECT p_partkey, CASE WHEN p_size > 25 THEN p_size::DOUBLE ELSE 1.5::DOUBLE END AS size,
  CASE WHEN p_size > 25 THEN 2 ELSE 1 END::BIGINT AS numeric_entries FROM part""")
def map_lookup(spark: SparkSession, d: str) -> DataFrame:
    raw = F.create_map(F.lit("size"), F.when(F.col("p_size") > 25, F.col("p_size").cast("string")).otherwise("n/a"),
                       F.lit("price"), F.col("p_retailprice").cast("string"), F.lit("name"), F.col("p_name"))
    numbers = sc.only_numeric(raw)
    return table(spark, d, "part").select(
        "p_partkey", sc.lookup(numbers, "size", 1.5).alias("size"), F.size(numbers).cast("bigint").alias("numeric_entries"))


@query("message_text", """SELECT event_type, printf('%s: %d operations, error share %.1f%%', event_type, count(*),
  100.0::DOUBLE * count_if(value > 100) / count(*)) AS message FROM events GROUP BY event_type""")
def message_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("event_type").agg(F.format_string(
        "%s: %d operations, error share %.1f%%", F.col("event_type"), F.count("*"),
        100.0 * F.count_if(F.col("value") > 100) / F.count("*")).alias("message"))


@query("backoff", """SELECT event_id, (event_id % 9 + 1)::BIGINT AS attempt,
  least(1 * pow(2, event_id % 9), 60)::DOUBLE AS delay FROM events WHERE event_type = 'error'""")
def backoff(spark: SparkSession, d: str) -> DataFrame:
    failed = table(spark, d, "events").filter(F.col("event_type") == "error")
    attempt = F.col("event_id") % 9 + 1
    return failed.select("event_id", attempt.alias("attempt"), sc.backoff_delay(attempt).alias("delay"))


NAMES = ["ValueError", "TypeError", "FileNotFoundError", "PermissionError", "ConnectionError", "TimeoutError",
         "OutOfMemoryError", "RuntimeError", "KeyError"]


@query("error_class", "WITH e AS (SELECT " + str(NAMES) + """[event_id % 9 + 1] AS name, CASE WHEN event_id % 2 = 0 THEN 'CUDA failure' ELSE 'other' END
    AS message FROM events)
  SELECT name, CASE WHEN name IN ('ValueError', 'TypeError') THEN 'input_validation' WHEN name IN ('FileNotFoundError', 'PermissionError') THEN 'file_io'
      WHEN name IN ('ConnectionError', 'TimeoutError') THEN 'network' WHEN name = 'OutOfMemoryError' THEN 'memory'
      WHEN name = 'RuntimeError' AND message LIKE '%CUDA%' THEN 'hardware' ELSE 'processing' END AS category,
    CASE WHEN name IN ('ValueError', 'TypeError') THEN 'low' WHEN name IN ('PermissionError', 'OutOfMemoryError') THEN 'high'
      WHEN name = 'RuntimeError' AND message LIKE '%CUDA%' THEN 'high' ELSE 'medium' END AS severity, count(*) AS n FROM e GROUP BY ALL""")
def error_class(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "events").select(
        F.get(F.array(*[F.lit(n) for n in NAMES]), (F.col("event_id") % 9).cast("int")).alias("name"),
        F.when(F.col("event_id") % 2 == 0, "CUDA failure").otherwise("other").alias("message"))
    kind = sc.error_class(F.col("name"), F.col("message"))
    return df.select("name", kind.alias("k")).groupBy("name", "k.category", "k.severity").agg(F.count("*").alias("n"))
