"""Standard input views: how the sample tables stand in for prediction, telemetry, file and raster tables.

Each function has a twin in ``views_sql`` (plain SQL) so that queries and their
SQL counterparts start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.tables import table

MODELS = ["A", "N", "R"]
FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
DRIFT_CUT = "1998-06-01"


def flag(cond: Column) -> Column:
    """1 where ``cond`` holds, else 0."""
    return F.when(cond, F.lit(1)).otherwise(F.lit(0))


def predictions(spark: SparkSession, directory: str) -> DataFrame:
    """Saved model predictions, one row per line item."""
    df = table(spark, directory, "lineitem")
    return df.select(
        F.col("l_orderkey").alias("sample_id"), F.col("l_partkey").alias("image_id"),
        F.col("l_returnflag").alias("model"), F.col("l_linestatus").alias("site"), F.col("l_shipdate").alias("ts"),
        (F.col("l_quantity") / 6.25).alias("h_true"),
        (F.col("l_quantity") / 6.25 + (F.col("l_tax") - 0.04) * 10).alias("h_pred"),
        (F.col("l_linenumber") % 3).cast("bigint").alias("d_true"),
        ((F.col("l_linenumber") + flag(F.col("l_discount") > 0.08)) % 3).cast("bigint").alias("d_pred"),
        (F.col("l_suppkey") % 3).alias("b_true"),
        ((F.col("l_suppkey") + flag(F.col("l_tax") > 0.06)) % 3).alias("b_pred"),
        F.lit(0.8).alias("conf_h"),
        (1 - F.col("l_discount") * 3).alias("conf_d"),
        (1 - F.col("l_tax") * 5).alias("conf_b"))


def labels(spark: SparkSession, directory: str) -> DataFrame:
    """Training labels with categories as text and the conditions they were made under."""
    df = table(spark, directory, "lineitem")
    direction = F.element_at(F.array(F.lit("LEFT"), F.lit("RIGHT"), F.lit("STRAIGHT")), F.col("l_linenumber") % 3 + 1)
    breaking = F.element_at(F.array(F.lit("SPILLING"), F.lit("PLUNGING"), F.lit("SURGING")),
                            (F.col("l_suppkey") % 3 + 1).cast("int"))
    height = F.col("l_quantity") / 6.25
    return df.select(
        F.col("l_orderkey").alias("sample_id"), F.col("l_partkey").alias("seed"),
        height.alias("height_meters"),
        (height * 3.28084 + flag(F.col("l_tax") > 0.07) * 0.5).alias("height_feet"),
        (1 - F.col("l_discount")).alias("height_confidence"),
        (1 - F.col("l_discount") * 3).alias("direction_confidence"),
        (1.1 - F.col("l_tax") * 5).alias("breaking_confidence"),
        F.when(F.col("l_discount") >= 0.1, F.lit("UNKNOWN")).otherwise(direction).alias("direction"),
        breaking.alias("breaking_type"),
        (F.col("l_quantity") > 40).alias("extreme_conditions"),
        (F.col("l_discount") * 10).alias("wind_strength"),
        (F.col("l_tax") * 2.5).alias("wave_steepness"),
        (F.col("l_partkey") % 10).alias("weather_id"))


def telemetry(spark: SparkSession, directory: str) -> DataFrame:
    """Operation telemetry, one row per event."""
    return telemetry_columns(table(spark, directory, "events"))


def telemetry_columns(df: DataFrame) -> DataFrame:
    """The telemetry columns of an event table or stream."""
    return df.select(
        "event_id", "ts", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"),
        F.concat(F.lit("c"), (F.col("user_id") % 10).cast("string")).alias("component"),
        F.col("event_type").alias("operation"), F.col("value").alias("duration_ms"),
        (F.col("event_type") == "error").alias("error_occurred"),
        F.get_json_object("props", "$.k").cast("double").alias("memory_mb"))


def features_wide(spark: SparkSession, directory: str) -> DataFrame:
    """One feature vector per image, tagged ``baseline`` or ``current``."""
    df = table(spark, directory, "lineitem")
    dataset = F.when(F.col("l_shipdate") < F.lit(DRIFT_CUT).cast("timestamp_ntz"), "baseline").otherwise("current")
    return df.select(dataset.alias("dataset"), *FEATURES)


def files(spark: SparkSession, directory: str) -> DataFrame:
    """File listing with a readable flag, which lives in another table."""
    quality = table(spark, directory, "labels").select("doc_id", "quality")
    joined = listing(spark, directory).join(quality, "doc_id", "left")
    return joined.withColumn("valid", F.coalesce(F.col("quality"), F.lit(0)) == 1).drop("quality")


def listing(spark: SparkSession, directory: str) -> DataFrame:
    """File listing with size, content hash and time, straight from the scan."""
    docs = table(spark, directory, "documents")
    return docs.select(
        "doc_id",
        F.concat_ws("", F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit("."), F.col("lang"))
         .alias("path"),
        F.col("source").alias("folder"), F.col("lang").alias("ext"), F.col("n_chars").alias("length"),
        F.md5(F.col("text").cast("binary")).alias("content_hash"),
        (F.col("n_chars") % 900 + 200).alias("width"), (F.col("n_chars") % 700 + 150).alias("height"),
        F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(0, CAST(doc_id % 5000 AS INT), 0, 0)")
         .alias("modified"))


def images(spark: SparkSession, directory: str) -> DataFrame:
    """Per-image quality measures derived from the part table."""
    df = table(spark, directory, "part")
    return df.select(
        F.col("p_partkey").alias("image_id"), F.col("p_brand").alias("camera"),
        F.element_at(F.array(*[F.lit(x) for x in ("JPEG", "PNG", "WEBP", "GIF", "BMP")]),
                     (F.col("p_partkey") % 5 + 1).cast("int")).alias("format"),
        (F.col("p_size") * 90).cast("bigint").alias("width"), (F.col("p_size") * 60 + 100).cast("bigint").alias("height"),
        (F.col("p_partkey") % 4 + 1).alias("channels"),
        ((F.col("p_partkey") * 7919) % 60_000_000).alias("file_bytes"),
        (F.col("p_size") / 100.0).alias("contrast"),
        (F.col("p_size") * 5.0).alias("brightness_std"),
        ((F.col("p_partkey") % 1000) * 1.0).alias("sharpness"),
        ((F.col("p_partkey") % 97) / 97.0).alias("ocean_coverage"),
        ((F.col("p_partkey") % 89) / 89.0).alias("quality_score"),
        ((F.col("p_partkey") % 53) / 53.0).alias("edge_preservation"),
        (F.col("p_partkey") % 100 == 0).alias("is_corrupted"))


def rasters(spark: SparkSession, directory: str) -> DataFrame:
    """Depth maps: the 64-number vector as an 8x8 raster scaled to [0, 1]."""
    df = table(spark, directory, "embeddings")
    px = F.transform("embedding", lambda v: v.cast("double"))
    df = df.select("vec_id", px.alias("px"), F.lit(8).alias("h"), F.lit(8).alias("w"))
    low, high = F.array_min("px"), F.array_max("px")
    scaled = F.when(high > low, F.transform("px", lambda v: (v - low) / (high - low))) \
              .otherwise(F.transform("px", lambda v: F.lit(0.0)))
    return df.select("vec_id", "h", "w", scaled.alias("px"))


def rgb_images(spark: SparkSession, directory: str) -> DataFrame:
    """Colour images: three 8x8 planes of whole numbers 0-255, the whole vector turned by 0, 16 and 32 places."""
    r = rasters(spark, directory)
    level = F.transform("px", lambda v: F.floor(v * 255).cast("double"))
    turned = {name: F.concat(F.slice("all", 1 + n, 64), F.slice("all", 1, n)) if n else F.col("all") for name, n in (("r", 0), ("g", 16), ("b", 32))}
    return r.select("vec_id", "h", "w", level.alias("all")).select("vec_id", "h", "w", *[c.alias(n) for n, c in turned.items()])
