"""Two-sample comparison: rank and distribution distances per feature, drift report, moment checks.

All rank-based distances come from one table: value counts per feature, ranked
in parallel chunks.  Repeated values collapse before the shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import kernels as kn
from tidemark.operators.ranking import exact_percentiles, few_or_chunked, running

# Fixed values of the comparison.
DRIFT_THRESHOLD = 0.1
KL_BINS, KL_EPSILON = 50, 1e-10
MATCH_WEIGHTS = {"kl": 0.3, "wasserstein": 0.3, "visual": 0.3, "ks": 0.1}
MEAN_TOLERANCE, STD_TOLERANCE, EXTREME_TOLERANCE = 0.2, 0.3, 0.05


def to_long(df: DataFrame, features: Sequence[str], dataset: str = "dataset") -> DataFrame:
    """Wide feature vectors as ``(dataset, feature, value)``; missing values are left out."""
    items = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features])
    return df.select(F.col(dataset).alias("dataset"), F.inline(items)).filter(F.col("value").isNotNull())


def paired_counts(long: DataFrame, first: str, second: str) -> DataFrame:
    """``(feature, value, n1, n2)``: how often each value occurs in either sample."""
    return long.filter(F.col("dataset").isin(first, second)).groupBy("feature", "value").agg(
        F.count_if(F.col("dataset") == first).alias("n1"), F.count_if(F.col("dataset") == second).alias("n2"))


def _two_sided_normal(z: Column) -> Column:
    """Two-sided tail of the standard normal by the Abramowitz-Stegun 7.1.26 formula (error below 1.5e-7)."""
    x = F.abs(z) / math.sqrt(2.0)
    t = 1.0 / (1.0 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return F.least(F.lit(1.0), poly * F.exp(-x * x))


def _kolmogorov_tail(lam: Column) -> Column:
    """Asymptotic two-sample KS p-value, the alternating exponential series."""
    terms = [(2.0 if k % 2 else -2.0) * F.exp(-2.0 * k * k * lam * lam) for k in range(1, 21)]
    return F.when(lam < 0.2, 1.0).otherwise(
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), sum(terms[1:], terms[0]))))


def rank_distances(long: DataFrame, first: str, second: str) -> DataFrame:
    """KS statistic and p-value, Wasserstein-1 and Mann-Whitney U with normal p-value, one row per feature."""
    counts = few_or_chunked(paired_counts(long, first, second), ["feature"], "value")
    ranked = running(counts, ["feature"], ["value"], sums={"c1": "n1", "c2": "n2"}, next_of={"next_value": "value"})
    gap = F.abs(F.try_divide("c1", "c1_total") - F.try_divide("c2", "c2_total"))
    ties = (F.col("n1") + F.col("n2")).cast("double")
    average_rank = F.col("c1") + F.col("c2") - (ties - 1) / 2.0
    out = ranked.groupBy("feature").agg(
        F.max("c1_total").alias("n1"), F.max("c2_total").alias("n2"), F.max(gap).alias("ks"),
        F.sum(gap * (F.col("next_value") - F.col("value"))).alias("wasserstein"),
        F.sum(F.col("n1") * average_rank).alias("_rank_sum"), F.sum(ties * ties * ties - ties).alias("_ties"))
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    n = n1 + n2
    u = F.col("_rank_sum") - n1 * (n1 + 1) / 2.0
    sigma = F.sqrt(n1 * n2 / 12.0 * F.greatest(F.lit(0.0), (n + 1) - F.try_divide(F.col("_ties"), n * (n - 1))))
    effective = F.sqrt(n1 * n2 / n)
    # identical values throughout leave nothing to rank: no evidence of a difference
    z = F.coalesce(F.try_divide(F.greatest(F.lit(0.0), F.abs(u - n1 * n2 / 2.0) - 0.5), sigma), F.lit(0.0))
    return out.select(
        "feature", "n1", "n2", "ks", _kolmogorov_tail(effective * F.col("ks")).alias("ks_p"),
        # a single common value has no following value to sum over; a missing sample has no distance
        F.when(F.col("ks").isNotNull(), F.coalesce("wasserstein", F.lit(0.0))).alias("wasserstein"),
        u.alias("mann_whitney_u"),
        _two_sided_normal(z).alias("mann_whitney_p"))


def t_statistic(long: DataFrame, first: str, second: str) -> DataFrame:
    """Absolute pooled-variance t statistic per feature, from conditional moments in one pass.

    Null where neither sample varies or one has no rows.
    """
    a, b = F.when(F.col("dataset") == first, F.col("value")), F.when(F.col("dataset") == second, F.col("value"))
    m = long.groupBy("feature").agg(
        F.count(a).alias("n1"), F.avg(a).alias("m1"), F.var_samp(a).alias("v1"),
        F.count(b).alias("n2"), F.avg(b).alias("m2"), F.var_samp(b).alias("v2"))
    squares = (F.col("n1") - 1) * F.col("v1") + (F.col("n2") - 1) * F.col("v2")
    pooled = F.try_divide(squares, F.col("n1") + F.col("n2") - 2)
    error = F.sqrt(pooled * (F.try_divide(F.lit(1.0), F.col("n1")) + F.try_divide(F.lit(1.0), F.col("n2"))))
    return m.select("feature", "n1", "n2", F.abs(F.try_divide(F.col("m1") - F.col("m2"), error)).alias("t"))


def kl_divergence(long: DataFrame, first: str, second: str, bins: int = KL_BINS) -> DataFrame:
    """KL divergence over equal bins on the first sample's range; second-sample values outside are left out.

    Bins are ``[low, high)`` with the last one closed.  A single-valued first sample gets half a unit
    on each side.  The range table has one row per named feature.
    """
    span = long.filter(F.col("dataset") == first).groupBy("feature").agg(
        F.min("value").alias("_lo"), F.max("value").alias("_hi"))
    flat = F.col("_lo") == F.col("_hi")
    span = span.select("feature", F.when(flat, F.col("_lo") - 0.5).otherwise(F.col("_lo")).alias("_lo"),
                       F.when(flat, F.col("_hi") + 0.5).otherwise(F.col("_hi")).alias("_hi"))
    inside = long.join(F.broadcast(span), "feature").filter(F.col("value").between(F.col("_lo"), F.col("_hi")))
    step = (F.col("_hi") - F.col("_lo")) / bins
    # the division may land one bin off at an edge; the edge values ``lo + i * step`` decide
    guess = F.least(F.floor((F.col("value") - F.col("_lo")) / step), F.lit(bins - 1))
    number = (F.when(F.col("value") < guess * step + F.col("_lo"), guess - 1)
              .when((guess < bins - 1) & (F.col("value") >= (guess + 1) * step + F.col("_lo")), guess + 1)
              .otherwise(guess))
    counts = inside.groupBy("feature", number.alias("bin")).agg(
        F.count_if(F.col("dataset") == first).alias("k1"), F.count_if(F.col("dataset") == second).alias("k2"),
        F.max(step).alias("_step"))
    # at most `bins` rows per feature from here on; empty bins are restored by the explode
    per = counts.groupBy("feature").agg(
        F.map_from_entries(F.collect_list(F.struct("bin", F.struct("k1", "k2")))).alias("_m"),
        F.sum("k1").alias("_n1"), F.sum("k2").alias("_n2"), F.max("_step").alias("_step"))
    every = per.select("feature", "_n1", "_n2", "_step", F.explode(F.transform(
        F.sequence(F.lit(0), F.lit(bins - 1)), lambda i: F.try_element_at("_m", i.cast("bigint")))).alias("_k"))

    def density(k: str, n: str) -> Column:
        share = F.coalesce(F.try_divide(F.coalesce(F.col(f"_k.{k}"), F.lit(0)).cast("double"), F.col(n)), F.lit(0.0))
        return share / F.col("_step") + KL_EPSILON
    dense = every.select("feature", density("k1", "_n1").alias("p"), density("k2", "_n2").alias("q"))
    # sum(p/P * ln((p/P)/(q/Q))) = sum(p ln(p/q)) / P + ln(Q / P)
    out = dense.groupBy("feature").agg(
        (F.sum(F.col("p") * F.log(F.col("p") / F.col("q"))) / F.sum("p") + F.log(F.sum("q") / F.sum("p"))).alias("kl"))
    return out.withColumn("kl", F.when((F.col("kl") >= 0) & ~F.isnan("kl"), F.col("kl")).otherwise(0.0))


def drift_report(long: DataFrame, first: str, second: str, threshold: float = DRIFT_THRESHOLD) -> DataFrame:
    """Mean KS over the features, whether it exceeds the threshold and which features do."""
    return report_of(rank_distances(long, first, second), threshold)


def report_of(ks: DataFrame, threshold: float = DRIFT_THRESHOLD) -> DataFrame:
    """The same from one KS row per feature."""
    return ks.agg(
        F.avg("ks").alias("drift_score"), (F.avg("ks") > threshold).alias("drift_detected"),
        F.array_sort(F.collect_list(F.when(F.col("ks") > threshold, F.col("feature")))).alias("affected"))


# The image features that a drift verdict is made of.
DRIFT_FEATURES = ["brightness", "contrast", "saturation", "sharpness", "texture"]


def drift_measures(ks: DataFrame, threshold: float = DRIFT_THRESHOLD) -> DataFrame:
    """``(metric, value)`` rows for the drift texts: the verdict, and the features' KS only where there is drift.

    ``ks`` has one row per feature. Without drift of the mean nothing is said about single features.
    """
    verdict = ks.agg(F.coalesce(F.avg("ks") > threshold, F.lit(False)).alias("detected"))
    rows = F.array(F.struct(F.lit("drift_detected").alias("metric"), F.when(F.col("detected"), 1.0).otherwise(0.0).alias("value")))
    single = ks.join(F.broadcast(verdict), F.col("detected"))  # one row against a row per feature
    return verdict.select(F.inline(rows)).unionByName(single.select(F.col("feature").alias("metric"), F.col("ks").alias("value")))


def compare_datasets(long: DataFrame, first: str, second: str, visual: Column) -> DataFrame:
    """One row comparing two datasets: distances and test statistics averaged over the features, and the match score.

    ``visual`` is the similarity of the datasets' mean embeddings.
    """
    ranks = rank_distances(long, first, second).select("feature", "ks", "wasserstein", "mann_whitney_u")
    per = ranks.join(kl_divergence(long, first, second), "feature") \
               .join(t_statistic(long, first, second).select("feature", "t"), "feature")
    row = per.agg(F.avg("kl").alias("kl_divergence"), F.avg("wasserstein").alias("wasserstein_distance"),
                  F.avg("ks").alias("ks_statistic"), F.avg("mann_whitney_u").alias("mann_whitney_u"),
                  F.avg("t").alias("t_statistic"))
    return row.withColumns({
        "visual_similarity": visual, "perceptual_distance": 1 - visual,
        "match_score": match_score(F.col("kl_divergence"), F.col("wasserstein_distance"), visual, F.col("ks_statistic"))})


def match_score(kl: Column, wasserstein: Column, visual: Column, ks: Column) -> Column:
    """Weighted closeness of two datasets in [0, 1]."""
    def keep(x: Column) -> Column:
        return F.greatest(F.lit(0.0), 1 - F.least(x, F.lit(1.0)))
    w = MATCH_WEIGHTS
    return w["kl"] * keep(kl / 2.0) + w["wasserstein"] * keep(wasserstein / 100.0) + w["visual"] * visual \
        + w["ks"] * keep(ks)


def embedding_cosine(df: DataFrame, vector: str, first: Column) -> DataFrame:
    """Cosine similarity of the mean vectors of two groups of rows (``first`` true / false), and its complement.

    The means are vector aggregates, so wide embeddings travel as one partial sum per task and group.
    """
    means = df.groupBy(first.alias("_first")).agg(Summarizer.mean(array_to_vector(vector)).alias("_m")) \
        .select("_first", vector_to_array("_m").alias("_m"))
    both = means.agg(F.max_by("_m", "_first").alias("a"), F.min_by("_m", "_first").alias("b"))

    def dot(x: str, y: str) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda u, v: u * v), F.lit(0.0), lambda s, v: s + v)
    cosine = dot("a", "b") / (F.sqrt(dot("a", "a")) * F.sqrt(dot("b", "b")))
    return both.select(cosine.alias("cosine"), (1 - cosine).alias("distance"))


def compare_moments(df: DataFrame, expected: dict[str, tuple[float, float]], extreme: Column,
                    expected_extreme: float) -> DataFrame:
    """Mean and spread of each column against expected moments, with similarity and verdict.

    The share of extreme rows is added as the line ``extreme_ratio`` (its similarity is null).
    """
    one = df.agg(
        *[x for c in expected for x in (F.avg(c).alias(f"_m_{c}"), F.stddev_pop(c).alias(f"_s_{c}"))],
        F.avg(F.when(extreme, 1.0).otherwise(0.0)).alias("_extreme"))
    rows = []
    for c, (mean, std) in expected.items():
        dm, ds = F.abs(F.col(f"_m_{c}") - mean) / mean, F.abs(F.col(f"_s_{c}") - std) / std
        near = (1 - F.least(F.lit(1.0), dm) + 1 - F.least(F.lit(1.0), ds)) / 2.0
        rows.append(F.struct(F.lit(c).alias("metric"), F.col(f"_m_{c}").alias("mean"), F.col(f"_s_{c}").alias("std"),
                             dm.alias("mean_diff"), ds.alias("std_diff"), near.alias("similarity"),
                             ((dm <= MEAN_TOLERANCE) & (ds <= STD_TOLERANCE)).alias("similar")))
    gap = F.abs(F.col("_extreme") - expected_extreme)
    nothing = F.lit(None).cast("double")
    rows.append(F.struct(F.lit("extreme_ratio").alias("metric"), F.col("_extreme").alias("mean"), nothing.alias("std"),
                         gap.alias("mean_diff"), nothing.alias("std_diff"), nothing.alias("similarity"),
                         (gap <= EXTREME_TOLERANCE).alias("similar")))
    return one.select(F.inline(F.array(*rows)))


def _sums(a: np.ndarray) -> dict[str, np.ndarray]:
    x = kn.flat(a)
    return {"_n": np.full(len(x), x.shape[1]), "_s": x.sum(axis=1), "_q": (x * x).sum(axis=1), "_lo": x.min(axis=1), "_hi": x.max(axis=1)}


def pooled_stats(df: DataFrame, by: Sequence[str], px: str = "px") -> DataFrame:
    """Statistics over all pixels of a dataset, combined from per-image sums (pixels are never exploded); ``h`` and ``w`` give the sizes."""
    sums = kn.apply_kernel(df, _sums, "_n bigint, _s double, _q double, _lo double, _hi double", arrays=(px,))
    per = sums.select(*by, "_n", "_s", "_q", "_lo", "_hi")
    n = F.sum("_n")
    mean, mean_square = F.try_divide(F.sum("_s"), n), F.try_divide(F.sum("_q"), n)
    return per.groupBy(*by).agg(
        n.alias("pixels"), mean.alias("mean"), F.sqrt(F.greatest(F.lit(0.0), mean_square - mean * mean)).alias("std"),
        F.min("_lo").alias("min"), F.max("_hi").alias("max"), (F.max("_hi") - F.min("_lo")).alias("range"))


def pooled_similarity(stats: DataFrame, first: str, second: str, dataset: str = "dataset") -> DataFrame:
    """Closeness of pooled mean, spread and range on the 0-255 scale, with the issues found."""
    def pick(which: str, c: str) -> Column:
        return F.max(F.when(F.col(dataset) == which, F.col(c)))
    one = stats.agg(*[F.abs(pick(first, c) - pick(second, c)).alias(f"_d_{c}") for c in ("mean", "std", "range")])
    near = {c: F.greatest(F.lit(0.0), 1 - F.col(f"_d_{c}") / 255.0) for c in ("mean", "std", "range")}
    score = (near["mean"] + near["std"] + near["range"]) / 3.0
    issues = F.array_compact(F.array(
        F.when(score < 0.5, F.lit("low similarity")), F.when(F.col("_d_mean") > 50, F.lit("brightness differs")),
        F.when(F.col("_d_std") > 30, F.lit("contrast differs"))))
    return one.select(*[e.alias(f"{c}_similarity") for c, e in near.items()], score.alias("similarity"),
                      issues.alias("issues")).withColumn(
        "valid", (F.col("similarity") >= 0.6) & (F.size("issues") == 0))


def feature_compare(long: DataFrame, first: str, second: str) -> DataFrame:
    """Both samples' statistics side by side and the similarity of the means, per feature."""
    def side(which: str, n: int) -> list[Column]:
        v = F.when(F.col("dataset") == which, F.col("value"))
        return [F.avg(v).alias(f"mean{n}"), F.stddev_pop(v).alias(f"std{n}"), F.min(v).alias(f"min{n}"),
                F.max(v).alias(f"max{n}")]
    both = long.groupBy("feature").agg(*side(first, 1), *side(second, 2))
    gap = F.abs(F.col("mean1") - F.col("mean2"))
    return both.withColumn("similarity", 1 - F.least(
        F.lit(1.0), gap / F.greatest(F.col("mean1"), F.col("mean2"), F.lit(0.001))))


# Levels of the mean similarity.
LEVELS = ((0.9, "excellent"), (0.7, "good"), (0.5, "acceptable"))


def feature_report(long: DataFrame, first: str, second: str) -> DataFrame:
    """``feature_compare`` with medians, KS and Mann-Whitney of each feature, and the mean similarity with its level on every row."""
    both = feature_compare(long, first, second)
    middle = exact_percentiles(long.filter(F.col("dataset").isin(first, second)), ["feature", "dataset"], "value", {"median": 0.5}, bounded_keys=True)
    medians = middle.groupBy("feature").agg(*[F.max(F.when(F.col("dataset") == which, F.col("median"))).alias(f"median{n}") for n, which in ((1, first), (2, second))])
    ranks = rank_distances(long, first, second).select("feature", "ks", "ks_p", "mann_whitney_u", "mann_whitney_p")
    joined = both.join(medians, "feature").join(ranks, "feature")
    overall = F.avg("similarity").over(Window.partitionBy())  # one row a feature
    level = F.lit("poor")
    for bound, name in reversed(LEVELS):
        level = F.when(F.col("overall_similarity") >= bound, name).otherwise(level)
    return joined.withColumn("overall_similarity", overall).withColumn("assessment", level)
