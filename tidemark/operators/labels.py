"""Label statistics, class balance, weighting and dataset splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.bands import HEIGHT_BANDS, height_band
from tidemark.operators.evaluation import ratio
from tidemark.operators.gates import BREAKING_TYPES, DIRECTIONS
from tidemark.operators.ranking import exact_percentiles, order_statistic
from tidemark.sources.tables import literal_table

# Fixed values: (lighting, weather, wind strength, foam) of the ten standard conditions.
CONDITIONS = [
    ("sunny", "clear", 0.2, 0.3), ("sunny", "clear", 0.5, 0.6), ("sunny", "glare", 0.3, 0.4),
    ("overcast", "clear", 0.4, 0.5), ("overcast", "fog", 0.2, 0.2), ("overcast", "rain", 0.6, 0.7),
    ("golden_hour", "clear", 0.3, 0.4), ("golden_hour", "clear", 0.1, 0.2),
    ("stormy", "rain", 0.8, 0.9), ("stormy", "clear", 0.7, 0.8),
]
# Prompt wording per condition.
LIGHTING_TEXT = {
    "sunny": "bright sunny day, clear blue sky", "overcast": "overcast sky, soft diffused lighting",
    "golden_hour": "golden hour lighting, warm sunset glow", "stormy": "dramatic stormy sky, dark clouds",
}
WEATHER_TEXT = {
    "clear": "clear weather", "rain": "light rain, wet surfaces", "fog": "misty fog, reduced visibility",
    "glare": "bright sun glare, high contrast",
}
LIGHTING_OTHER, WEATHER_OTHER = "natural lighting", "clear conditions"
STRONG_WIND_TEXT, WIND_TEXT, FOAM_TEXT = "strong winds, choppy water", "moderate breeze", "white foam, breaking waves"
# Largest coefficient of variation per balanced dimension; smallest share is 1/20.
MAX_CV = {"height": 0.3, "direction": 0.2, "breaking_type": 0.2}
MIN_SHARE_DIVISOR = 20
# Expected real-world statistics.
EXPECTED_MOMENTS = {"height_meters": (2.5, 1.2), "height_confidence": (0.85, 0.12),
                    "direction_confidence": (0.82, 0.15), "breaking_confidence": (0.80, 0.18)}
EXPECTED_EXTREME_RATIO = 0.12
EXPECTED_SHARES = {"direction": {"LEFT": 0.35, "RIGHT": 0.35, "STRAIGHT": 0.30},
                   "breaking_type": {"SPILLING": 0.45, "PLUNGING": 0.35, "SURGING": 0.20}}


def conditions(df: DataFrame) -> DataFrame:
    """The ten standard conditions as a table keyed by ``weather_id``."""
    return literal_table(df.sparkSession, "weather_id bigint, lighting string, weather string, wind double, foam double",
                         [(i, *c) for i, c in enumerate(CONDITIONS)])


def round_robin(df: DataFrame, number: str) -> DataFrame:
    """Pair item n with condition ``n mod 10`` (hash join against ten rows)."""
    keyed = df.withColumn("weather_id", F.pmod(F.col(number), F.lit(len(CONDITIONS))))
    return keyed.join(F.broadcast(conditions(df)), "weather_id")


def prompt_text(base: Column) -> Column:
    """Prompt wording from the condition columns ``lighting, weather, wind, foam``."""
    def words(table: dict[str, str], key: str, other: str) -> Column:
        m = F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.lit(v))])
        return F.coalesce(F.try_element_at(m, F.col(key)), F.lit(other))
    return F.concat_ws(
        ", ", base, words(LIGHTING_TEXT, "lighting", LIGHTING_OTHER), words(WEATHER_TEXT, "weather", WEATHER_OTHER),
        F.when(F.col("wind") > 0.7, STRONG_WIND_TEXT).when(F.col("wind") > 0.3, WIND_TEXT),
        F.when(F.col("foam") > 0.5, FOAM_TEXT))


def label_stats(df: DataFrame) -> DataFrame:
    """One row: height and confidence statistics, extreme count, distinct seeds, parameter range."""
    h = F.col("height_meters")
    base = df.agg(
        F.count("*").alias("n"), F.avg(h).alias("height_mean"), F.stddev_pop(h).alias("height_std"),
        F.min(h).alias("height_min"), F.max(h).alias("height_max"),
        *[x for c in ("height", "direction", "breaking") for x in (
            F.avg(f"{c}_confidence").alias(f"{c}_conf_mean"), F.stddev_pop(f"{c}_confidence").alias(f"{c}_conf_std"),
            F.min(f"{c}_confidence").alias(f"{c}_conf_min"))],
        F.count_if("extreme_conditions").alias("extreme_count"), F.countDistinct("seed").alias("distinct_seeds"),
        F.min("wind_strength").alias("wind_min"), F.max("wind_strength").alias("wind_max"))
    median = exact_percentiles(df.select("height_meters"), [], "height_meters", {"m": 0.5})
    return base.withColumn("height_median", median.scalar())


DIMENSIONS = ["height", "direction", "breaking_type", "weather"]


def balance(df: DataFrame) -> DataFrame:
    """Counts ``(dimension, category, n)`` of the four dimensions in one grouping-sets pass.

    Categories of the domain nobody has count 0; labels outside it keep their own row.
    """
    with_condition = df.join(F.broadcast(conditions(df)), "weather_id", "left").select(
        height_band(F.col("height_meters")).alias("height"), "direction", "breaking_type",
        F.concat(F.col("lighting"), F.lit("_"), F.col("weather")).alias("weather"))  # null for an unknown condition
    sets = with_condition.groupingSets([[d] for d in DIMENSIONS], *DIMENSIONS).agg(
        F.count("*").alias("n"), F.grouping_id().alias("_g"))
    # grouping_id has a 0 bit for the one column that is grouped
    which = F.create_map(*[x for i, d in enumerate(DIMENSIONS) for x in (F.lit(15 - (8 >> i)), F.lit(d))])
    counts = sets.select(F.element_at(which, F.col("_g").cast("int")).alias("dimension"),
                         F.coalesce(*DIMENSIONS).alias("category"), "n").filter(F.col("category").isNotNull())
    domain = [("height", b[2]) for b in HEIGHT_BANDS] + [("direction", c) for c in DIRECTIONS] \
        + [("breaking_type", c) for c in BREAKING_TYPES] \
        + [("weather", c) for c in sorted({f"{a}_{b}" for a, b, *_ in CONDITIONS})]
    zeros = literal_table(df.sparkSession, "dimension string, category string, n bigint", [(*x, 0) for x in domain])
    return counts.unionByName(zeros).groupBy("dimension", "category").agg(F.sum("n").alias("n"))


def balance_score(counts: DataFrame) -> DataFrame:
    """``exp(-chi2 / n)`` against equal counts, per dimension."""
    # chi2 = sum((n - e)^2) / e with e = N / k, expanded so that one aggregate is enough
    total, k = F.sum("n").cast("double"), F.count("*")
    squares = F.sum((F.col("n") * F.col("n")).cast("double"))
    expected = total / k
    chi2 = (squares - 2 * expected * total + k * expected * expected) / expected
    return counts.groupBy("dimension").agg(
        total.cast("bigint").alias("n"), F.when(total > 0, F.exp(-chi2 / total)).otherwise(0.0).alias("balance_score"))


def balance_issues(counts: DataFrame) -> DataFrame:
    """Dimensions whose counts vary too much and categories below a twentieth of the rows."""
    limit = F.create_map(*[x for d, v in MAX_CV.items() for x in (F.lit(d), F.lit(v))])
    spread = counts.groupBy("dimension").agg(
        ratio(F.stddev_pop("n"), F.avg("n"), float("inf")).alias("value"), F.sum("n").alias("_total"))
    uneven = spread.filter(F.col("value") > F.try_element_at(limit, F.col("dimension"))) \
        .select("dimension", F.lit("*").alias("category"), F.lit("uneven").alias("issue"), "value")
    total = spread.agg(F.max("_total")).scalar()
    rare = counts.filter(F.col("n") < F.floor(total / MIN_SHARE_DIVISOR)) \
        .select("dimension", "category", F.lit("rare").alias("issue"), F.col("n").cast("double").alias("value"))
    return uneven.unionByName(rare)


def share_diff(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Observed share of each category against the expected share."""
    rows = [(c, k, v) for c in columns for k, v in EXPECTED_SHARES[c].items()]
    one = df.agg(F.count("*").alias("_n"), *[F.count_if(F.col(c) == k).alias(f"_{i}")
                                             for i, (c, k, _) in enumerate(rows)])
    return one.select(F.inline(F.array(*[F.struct(
        F.lit(c).alias("dimension"), F.lit(k).alias("category"), F.lit(e).alias("expected"),
        ratio(F.col(f"_{i}"), F.col("_n")).alias("share"),
        F.abs(ratio(F.col(f"_{i}"), F.col("_n")) - e).alias("difference")) for i, (c, k, e) in enumerate(rows)])))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Inverse-frequency weight ``n / (k * count)`` per class."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    totals = counts.agg((F.sum("n") / F.count("*")).alias("t")).scalar()
    return counts.withColumn("weight", totals / F.col("n"))


def uniform(key: Column, seed: int) -> Column:
    """Repeatable number in [0, 1) from a key (32 bits of a seeded md5)."""
    digest = F.md5(F.concat_ws("-", F.lit(str(seed)), key.cast("string")).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / 4294967296.0


def weighted_resample(df: DataFrame, key: str, weight: str, seed: int) -> DataFrame:
    """Balanced resample: each row appears ``floor(w)`` times plus once more with the leftover chance."""
    extra = F.when(uniform(F.col(key), seed) < F.col(weight) - F.floor(weight), 1).otherwise(0)
    copies = (F.floor(weight) + extra).cast("int")
    return df.filter(copies > 0).withColumn("copy", F.explode(F.sequence(F.lit(1), copies)))


def split_ordered(df: DataFrame, key: str, seed: int, train_share: float = 0.8) -> DataFrame:
    """Shuffled split at position ``int(n * share)``: the cut is one order statistic, rows are then only filtered."""
    digest = F.md5(F.concat_ws("-", F.lit(str(seed)), F.col(key).cast("string")).cast("binary"))
    hashed = df.withColumn("_h", F.conv(F.substring(digest, 1, 12), 16, 10).cast("bigint"))
    cut = order_statistic(hashed.select("_h"), [], "_h", lambda n: F.floor(n * F.lit(train_share)), "cut").scalar()
    return hashed.withColumn("split", F.when(F.col("_h") < cut, "train").otherwise("validation")).drop("_h")
