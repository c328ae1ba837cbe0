"""Dataset profiles: files, resolution, contrast, clarity, coverage, duplicates, health."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.evaluation import ratio
from tidemark.operators.ranking import exact_percentiles, null_safe_join, numbered
from tidemark.sources.tables import pin

# Fixed values of the profile thresholds.
LOW_AREA, HIGH_AREA = 640 * 480, 3840 * 2160
LOW_CONTRAST, HIGH_CONTRAST = 0.1, 0.5
BLURRY, SHARP = 100.0, 500.0
LOW_COVERAGE, NO_COVERAGE = 0.3, 0.1
SEVERITY_WEIGHT = {"critical": 0.3, "high": 0.2, "medium": 0.1, "low": 0.05}
# Fixed values: (issue, severity, share of images that has to be exceeded).
ISSUE_RULES = [("low_resolution", "high", 0.0), ("low_contrast", "medium", 0.1), ("blur", "high", 0.15),
               ("no_ocean_content", "critical", 0.0), ("corruption", "critical", 0.0)]


def resolution_profile(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean and spread of both sides, the smallest and largest image by area, small and very large counts."""
    area = F.col("width") * F.col("height")
    size = F.concat_ws("x", F.col("width").cast("string"), F.col("height").cast("string"))
    tie = F.struct(area, F.col("width"))
    return df.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg("width").alias("mean_width"), F.stddev_pop("width").alias("std_width"),
        F.avg("height").alias("mean_height"), F.stddev_pop("height").alias("std_height"),
        F.min_by(size, tie).alias("smallest"), F.max_by(size, tie).alias("largest"),
        F.count_if(area < LOW_AREA).alias("below_480p"), F.count_if(area > HIGH_AREA).alias("above_4k"))


def contrast_profile(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Contrast and dynamic range statistics with low and high counts and mean entropy."""
    return df.groupBy(*by).agg(
        F.avg("contrast").alias("mean_contrast"), F.stddev_pop("contrast").alias("std_contrast"),
        F.avg("dynamic_range").alias("mean_dynamic_range"), F.stddev_pop("dynamic_range").alias("std_dynamic_range"),
        F.count_if(F.col("contrast") < LOW_CONTRAST).alias("low_contrast"),
        F.count_if(F.col("contrast") > HIGH_CONTRAST).alias("high_contrast"), F.avg("entropy").alias("mean_entropy"))


def clarity_profile(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Sharpness and blur statistics with blurry and sharp counts."""
    return df.groupBy(*by).agg(
        F.avg("sharpness").alias("mean_sharpness"), F.stddev_pop("sharpness").alias("std_sharpness"),
        F.avg("blur").alias("mean_blur"), F.stddev_pop("blur").alias("std_blur"),
        F.count_if(F.col("sharpness") < BLURRY).alias("blurry"),
        F.count_if(F.col("sharpness") > SHARP).alias("sharp"))


def coverage_profile(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Ocean coverage statistics; an image without ocean counts as low as well."""
    c = F.col("ocean_coverage")
    return df.groupBy(*by).agg(
        F.avg(c).alias("mean_coverage"), F.stddev_pop(c).alias("std_coverage"), F.min(c).alias("min_coverage"),
        F.max(c).alias("max_coverage"), F.count_if(c < LOW_COVERAGE).alias("low_coverage"),
        F.count_if(c < NO_COVERAGE).alias("no_ocean"))


def file_profile(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """File counts, sizes, date range and unreadable files."""
    return df.groupBy(*by).agg(
        F.count("*").alias("n"), (F.sum("length") / 1048576.0).alias("total_mb"),
        (F.avg("length") / 1024.0).alias("mean_kb"), F.min("modified").alias("first_modified"),
        F.max("modified").alias("last_modified"), F.count_if(~F.col("valid")).alias("corrupted"))


def distribution(df: DataFrame, column: str) -> DataFrame:
    """Counts per category with their share of all rows."""
    counts = df.groupBy(column).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    return counts.withColumn("percentage", 100.0 * F.col("n") / total)


def duplicate_count(df: DataFrame, key: str) -> DataFrame:
    """Surplus copies, sum of (n - 1) over equal keys, and the number of repeated keys."""
    groups = df.groupBy(key).agg(F.count("*").alias("n"))
    return groups.agg((F.sum("n") - F.count("*")).alias("duplicates"),
                      F.count_if(F.col("n") > 1).alias("repeated_keys"))


def dir_structure(df: DataFrame, path: str = "path") -> DataFrame:
    """Files per directory."""
    return df.groupBy(F.regexp_extract(path, "^(.*)/", 1).alias("directory")).agg(F.count("*").alias("files"))


def image_profile(df: DataFrame) -> DataFrame:
    """The one-row profile the issue rules and the quality score read."""
    area = F.col("width") * F.col("height")
    return df.agg(
        F.count("*").alias("n"), F.count_if(area < LOW_AREA).alias("low_resolution"),
        F.count_if(F.col("contrast") < LOW_CONTRAST).alias("low_contrast"),
        F.count_if(F.col("sharpness") < BLURRY).alias("blur"),
        F.count_if(F.col("ocean_coverage") < NO_COVERAGE).alias("no_ocean_content"),
        F.count_if(F.col("is_corrupted")).alias("corruption"), F.avg("contrast").alias("mean_contrast"),
        F.avg("sharpness").alias("mean_sharpness"), F.avg("ocean_coverage").alias("mean_coverage"))


def _issues(n: Column) -> Column:
    rows = [F.when(F.col(kind) > n * share, F.struct(
        F.lit(kind).alias("issue"), F.lit(severity).alias("severity"), F.col(kind).alias("affected"),
        (100.0 * F.col(kind) / n).alias("percentage"))) for kind, severity, share in ISSUE_RULES]
    return F.array_compact(F.array(*rows))


def quality_issues(profile: DataFrame) -> DataFrame:
    """Issues of a profile row: kind, severity, affected images and percentage."""
    return profile.select(F.inline(_issues(F.col("n"))))


def issue_counts(profile: DataFrame) -> DataFrame:
    """The issue counts that the quality recommendations read, one row."""
    found = _issues(F.col("n"))

    def of(*kinds: str) -> Column:
        return F.size(F.filter(found, lambda i: i["issue"].isin(*kinds)))

    def severe(level: str) -> Column:
        return F.size(F.filter(found, lambda i: i["severity"] == level))
    return profile.select(
        severe("critical").alias("critical_issues"), severe("high").alias("high_issues"),
        of("low_resolution", "blur").alias("low_resolution_or_blur"), of("no_ocean_content").alias("no_ocean_content"),
        of("corruption").alias("corruption"), F.size(found).alias("issues"))


def quality_score(profile: DataFrame) -> DataFrame:
    """Overall score: 1 minus severity-weighted shares plus bonuses, clamped to [0, 1]."""
    def weighted(i: Column) -> Column:
        w = F.lit(0.0)
        for severity, weight in SEVERITY_WEIGHT.items():
            w = F.when(i["severity"] == severity, F.lit(weight)).otherwise(w)
        return w * (i["percentage"] / 100.0)
    penalty = F.aggregate(_issues(F.col("n")), F.lit(0.0), lambda acc, i: acc + weighted(i))
    bonus = sum((F.when(c, 0.05).otherwise(0.0) for c in (
        F.col("mean_sharpness") > 200, F.col("mean_coverage") > 0.5)),
        F.when(F.col("mean_contrast") > 0.2, 0.05).otherwise(0.0))
    return profile.select(
        F.size(F.filter(_issues(F.col("n")), lambda i: i["severity"].isin("high", "critical"))).cast("bigint")
         .alias("anomaly_count"),
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(1.0) - penalty + bonus)).alias("quality_score"))


def dataset_checksum(df: DataFrame, by: Sequence[str], path: str = "path", length: str = "length") -> DataFrame:
    """Order-free fingerprint of a file listing.

    Four 28-bit slices of md5(``name:size``) are summed, so the listing is never
    sorted or gathered; the fingerprint is the md5 of count and sums.
    """
    digest = F.md5(F.concat_ws(":", F.col(path), F.col(length).cast("string")).cast("binary"))
    parts = [F.sum(F.conv(F.substring(digest, 1 + 7 * i, 7), 16, 10).cast("bigint")).cast("string") for i in range(4)]
    return df.groupBy(*by).agg(
        F.count("*").alias("files"), F.md5(F.concat_ws("|", F.count("*").cast("string"), *parts).cast("binary"))
        .alias("checksum"))


#: Digests that one digest of the level above covers.
FINGERPRINT_FANOUT = 1024


def ordered_checksum(df: DataFrame, keys: Sequence[str], columns: Sequence[str], fanout: int = FINGERPRINT_FANOUT) -> DataFrame:
    """Fingerprint of each key's listing in the order of ``columns``: a hash tree over the sorted rows.

    Any change of a value, a missing row or one more changes it; the order in which rows are stored does not. Each level hashes
    runs of ``fanout`` digests, so no task sees more than that, and there are as many levels as the logarithm of the rows.
    """
    parts = [F.coalesce(F.concat(F.octet_length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-")) for c in columns]
    rows = df.select(*keys, *columns, F.sha2(F.concat(*parts), 256).alias("digest"))
    sizes = df.groupBy(*keys).agg(F.count("*").alias("files"))
    placed = numbered(rows, keys, [*columns, "digest"], "at").select(*keys, "at", "digest")
    level, done = null_safe_join(placed, sizes.withColumnRenamed("files", "nodes"), keys), None
    while True:
        runs = level.groupBy(*keys, "nodes", F.floor(F.col("at") / fanout).alias("run")).agg(F.sort_array(F.collect_list(F.struct("at", "digest"))).alias("held"))
        hashed = runs.select(*keys, F.ceil(F.col("nodes") / fanout).alias("nodes"), F.col("run").alias("at"), F.sha2(F.array_join("held.digest", ""), 256).alias("digest"))
        level = pin(hashed if done is None else done.unionByName(hashed))
        done, level = level.filter("nodes = 1"), level.filter("nodes > 1")
        if level.isEmpty():
            return null_safe_join(done.select(*keys, F.col("digest").alias("fingerprint")), sizes, keys)


def health_row(files: DataFrame, images: DataFrame, drift: DataFrame, as_of: Column, *,
               quality_threshold: float = 0.7, freshness_hours: float = 24.0) -> DataFrame:
    """One health row: quality, drift, anomalies, missing and duplicate shares, format consistency, age, alerts.

    ``drift`` is the one row of ``drift_report`` against the baseline.
    """
    score = quality_score(image_profile(images)).withColumn("_k", F.lit(1))
    formats = files.groupBy("ext").agg(F.count("*").alias("n")).agg(F.count("*").alias("formats"))
    copies = duplicate_count(files, "content_hash").select("duplicates")
    listing = files.agg(
        F.count("*").alias("total_samples"), F.count_if(~F.col("valid")).alias("_missing"),
        F.max("modified").alias("_last")).withColumn("_k", F.lit(1))
    age = (F.unix_seconds(as_of.cast("timestamp")) - F.unix_seconds(F.col("_last").cast("timestamp"))) / 3600.0
    drifted = drift.select(F.lit(1).alias("_k"), "drift_score", "drift_detected", "affected")
    row = listing.join(F.broadcast(score), "_k").join(F.broadcast(drifted), "_k").select(
        "total_samples", "quality_score", "drift_score", "drift_detected", "affected", "anomaly_count",
        (100 * ratio(F.col("_missing"), F.col("total_samples"))).alias("missing_percentage"),
        (100 * ratio(copies.scalar(), F.col("total_samples"))).alias("duplicate_percentage"),
        (1.0 / formats.scalar()).alias("format_consistency"), age.alias("freshness_hours"))
    found = F.coalesce("drift_detected", F.lit(False))
    features = F.transform("affected", lambda f: F.concat(F.lit("affected feature: "), f))
    alerts = F.concat(
        F.array_compact(F.array(F.when(F.col("quality_score") < quality_threshold, F.lit("quality below threshold")),
                                F.when(found, F.lit("data drift detected")))),
        F.when(found, features).otherwise(F.array().cast("array<string>")),
        F.array_compact(F.array(F.when(F.col("freshness_hours") > freshness_hours, F.lit("data is stale")))))
    return row.withColumn("alerts", alerts).drop("drift_detected", "affected")


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, mean, sample deviation, min, quartiles and max, one row per column."""
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns])).alias("_f")) \
        .select("_f.*").filter(F.col("value").isNotNull())
    basic = long.groupBy("feature").agg(
        F.count("value").alias("count"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"))
    quart = exact_percentiles(long, ["feature"], "value", {"q25": 0.25, "q50": 0.5, "q75": 0.75}, bounded_keys=True)
    return null_safe_join(basic, quart, ["feature"])


def correlation(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson correlation of every pair of the named columns, all in one aggregate."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1:]]
    one = df.agg(*[F.corr(a, b).alias(f"_{i}") for i, (a, b) in enumerate(pairs)])
    return one.select(F.inline(F.array(*[
        F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"_{i}").alias("r"))
        for i, (a, b) in enumerate(pairs)])))


def top_correlations(df: DataFrame, columns: Sequence[str], at_least: float = 0.3, k: int = 5) -> DataFrame:
    """Strongest pairs with ``abs(r)`` above the bound."""
    pairs = correlation(df, columns).filter(F.abs("r") > at_least)
    return pairs.orderBy(F.round(F.abs("r"), 9).desc(), "a", "b").limit(k)


def topk_values(df: DataFrame, column: str, k: int) -> DataFrame:
    """The k most common values (ties: the smaller value)."""
    return df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(k)


def extremes(df: DataFrame, key: str, metrics: Sequence[str]) -> DataFrame:
    """Rows with the lowest and highest value of each metric (ties: the smaller key)."""
    one = df.agg(*[x for m in metrics for x in (
        F.min_by(key, F.struct(F.col(m), F.col(key))).alias(f"_lo_{m}"), F.min(m).alias(f"_lov_{m}"),
        F.min_by(key, F.struct(-F.col(m), F.col(key))).alias(f"_hi_{m}"), F.max(m).alias(f"_hiv_{m}"))])
    return one.select(F.inline(F.array(*[F.struct(
        F.lit(m).alias("metric"), F.col(f"_lo_{m}").alias("lowest"), F.col(f"_lov_{m}").cast("double").alias("low"),
        F.col(f"_hi_{m}").alias("highest"), F.col(f"_hiv_{m}").cast("double").alias("high")) for m in metrics])))


def sample_hash(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """Random sample of n rows without replacement, repeatable: the n smallest seeded hashes."""
    order = F.md5(F.concat_ws("-", F.lit(str(seed)), F.col(key).cast("string")).cast("binary"))
    return df.withColumn("_o", order).orderBy("_o", key).limit(n).drop("_o")
