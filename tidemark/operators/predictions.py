"""Rules applied to raw model outputs: confidence adjustments, anomaly checks, uncertainty."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import let
from tidemark.operators.evaluation import extreme
from tidemark.operators.ranking import exact_percentiles

# Fixed values of the output rules.
HEIGHT_OFFSET, HEIGHT_SPAN = 0.5, 7.5
DIRECTION_NAMES = ["LEFT", "RIGHT", "STRAIGHT"]
BREAKING_NAMES = ["SPILLING", "PLUNGING", "SURGING", "NO_BREAKING"]
NO_BREAKING_CLASS = 3


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def softmax(logits: Column) -> Column:
    """Class probabilities from logits, shifted by the largest one."""
    # each part is bound once: the largest logit, the weights, their sum
    return let(F.array_max(logits), lambda top: let(
        F.transform(logits, lambda v: F.exp(v - top)), lambda weights: let(
            F.aggregate(weights, F.lit(0.0), lambda a, b: a + b), lambda total: F.transform(weights, lambda w: w / total))))


def argmax(values: Column) -> Column:
    """0-based position of the first largest element."""
    return F.array_position(values, F.array_max(values)) - 1


def entropy(probabilities: Column) -> Column:
    """Natural-log entropy with probabilities clipped to [1e-8, 1]."""
    return F.aggregate(probabilities, F.lit(0.0),
                       lambda a, p: a - clamp(p, 1e-8, 1.0) * F.log(clamp(p, 1e-8, 1.0)))


def binary_entropy(c: Column) -> Column:
    """Entropy of a single confidence, for regression outputs."""
    return -c * F.log(c + 1e-8) - (1 - c) * F.log(1 - c + 1e-8)


def reliability(raw: Column, calibrated: Column, uncertainty: Column) -> Column:
    """How far a confidence can be trusted: penalties for miscalibration, uncertainty and extreme values."""
    overconfident = F.greatest(F.lit(0.0), F.abs(raw - 0.5) - 0.4) * 2
    return clamp(1 - (F.abs(raw - calibrated) + uncertainty + overconfident) / 3.0, 0.0, 1.0)


def uncertainty_columns(value: Column, confidence: Column) -> dict[str, Column]:
    """Data and model uncertainty of a prediction, their total and the 95 % interval."""
    aleatoric, epistemic = (1 - confidence) * 0.5, (1 - confidence) * 0.3
    total = F.sqrt(aleatoric * aleatoric + epistemic * epistemic)
    return {"aleatoric": aleatoric, "epistemic": epistemic, "total": total, "variance": total * total,
            "lower": value - 1.96 * total, "upper": value + 1.96 * total}


def breakdown(probabilities: Column, classes: int = 3) -> Column:
    """Percent shares of the first classes among themselves."""
    head = F.slice(probabilities, 1, classes)
    total = F.aggregate(head, F.lit(0.0), lambda a, p: a + p) + 1e-8
    return F.transform(head, lambda p: 100.0 * p / total)


def confidence_bundle(raw: Column, calibrated: Column, probabilities: Column | None, classes: int = 3) -> dict[str, Column]:
    """Entropy, uncertainty, clipped interval and reliability of one confidence."""
    h = binary_entropy(raw) if probabilities is None else entropy(probabilities)
    u = h / F.log(F.lit(2.0 if probabilities is None else float(classes)))
    margin = 1.96 * F.sqrt(F.greatest(u, F.lit(0.0)))
    return {"entropy": h, "uncertainty": u, "lower": F.greatest(F.lit(0.0), calibrated - margin),
            "upper": F.least(F.lit(1.0), calibrated + margin), "reliability": reliability(raw, calibrated, u)}


def height_output(df: DataFrame) -> DataFrame:
    """Scale the raw height and adjust its confidence by dominance and wave count."""
    waves = clamp(F.col("wave_count_raw"), 0.0, 10.0)
    height = HEIGHT_OFFSET + F.col("height_raw") * HEIGHT_SPAN
    crowding = clamp(1 - (waves - 1) * 0.1, 0.5, 1.0)
    return df.withColumns({
        "height_meters": height, "wave_count": waves,
        "height_confidence": F.col("height_base_conf") * F.col("dominance") * crowding,
        "is_extreme": extreme(height)})


def direction_output(df: DataFrame) -> DataFrame:
    """Adjust the direction confidence for mixed conditions and strength, and flag mixed conditions."""
    top = F.array_max("direction_probs")
    adjusted = top * (1 - 0.3 * F.col("mixed_score")) * (1 + 0.2 * F.col("direction_strength"))
    return df.withColumns({
        "direction_class": argmax(F.col("direction_probs")), "direction_confidence": clamp(adjusted, 0.1, 1.0),
        "wave_trains": clamp(F.col("wave_trains_raw"), 1.0, 5.0),
        "is_mixed": (F.col("mixed_score") > 0.6) | (F.col("direction_strength") < 0.3)})


def breaking_output(df: DataFrame) -> DataFrame:
    """Adjust the breaking confidence, override clear no-breaking cases and flag mixed breaking."""
    none = (F.col("no_breaking") > 0.6) & (F.col("intensity") < 0.3)
    adjusted = F.array_max("breaking_probs") * F.col("intensity") * F.col("clarity") * (1 - 0.2 * F.col("mixed_breaking"))
    return df.withColumns({
        "breaking_class": F.when(none, F.lit(NO_BREAKING_CLASS)).otherwise(argmax(F.col("breaking_probs"))).cast("bigint"),
        "breaking_confidence": F.when(none, 0.9 * F.col("no_breaking")).otherwise(clamp(adjusted, 0.1, 1.0)),
        "is_mixed_breaking": (F.col("mixed_breaking") > 0.5) | (F.col("clarity") < 0.4)})


def confidence_penalties(df: DataFrame) -> DataFrame:
    """Final confidences of a record after the record-level penalties, and their mean."""
    def factor(cond: Column, f: float) -> Column:
        return F.when(cond, f).otherwise(1.0)
    height = F.col("height_confidence") * factor(F.col("wave_count") > 2, 0.95) * factor(F.col("dominance") < 0.7, 0.9)
    direction = F.col("direction_confidence") * factor(F.col("is_mixed"), 0.85) * factor(F.col("wave_trains") > 2, 0.9)
    breaking = F.col("breaking_confidence") * factor(F.col("is_mixed_breaking"), 0.85) * factor(F.col("clarity") < 0.5, 0.9)
    sure = (F.col("breaking_class") == NO_BREAKING_CLASS) & (F.col("no_breaking") > 0.7)
    breaking = F.when(sure, F.greatest(breaking, F.lit(0.8))).otherwise(breaking)
    return df.withColumns({"final_height_conf": height, "final_direction_conf": direction,
                           "final_breaking_conf": breaking}) \
             .withColumn("overall_confidence", (F.col("final_height_conf") + F.col("final_direction_conf")
                                                + F.col("final_breaking_conf")) / 3.0)


def anomaly_rules(height: Column, conf_h: Column, conf_d: Column, conf_b: Column, base: Column | None = None
                  ) -> dict[str, Column]:
    """Rule-based anomaly score and reasons on top of an optional base score."""
    rules = [(height > 10, 0.8, "extremely high wave"), (conf_h < 0.1, 0.6, "extremely low height confidence"),
             ((conf_h < 0.2) & (conf_d < 0.2) & (conf_b < 0.2), 0.7, "all confidences extremely low")]
    start = F.lit(0.0) if base is None else base
    score = reduce(lambda s, r: F.greatest(s, F.when(r[0], r[1]).otherwise(0.0)), rules, start)
    reasons = F.array_compact(F.array(*[F.when(c, F.lit(text)) for c, _, text in rules]))
    return {"anomaly_score": score, "reasons": reasons, "is_anomalous": (score > 0.5) | (F.size(reasons) > 0)}


def anomaly_robust(df: DataFrame, features: Sequence[str] | dict[str, Sequence[str]], contamination: float = 0.1) -> DataFrame:
    """Robust anomaly score: mean ``abs(x - median) / (1.4826 MAD)`` of the features, flagged above a percentile.

    ``features`` is a list, which adds ``robust_score`` and ``is_outlier``, or lists by group name, which add ``<group>_score`` and
    ``<group>_outlier`` each.  Medians and deviations are exact percentiles, one row per listed feature; the rows themselves are only
    projected, never shuffled.  A feature with zero MAD is measured in its own units. Scores are rounded to nine
    digits, so that equal rows stay equal.
    """
    groups = features if isinstance(features, dict) else {"robust": features}
    names = list(dict.fromkeys(f for group in groups.values() for f in group))
    long = df.select(F.inline(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in names])))
    med = {r["feature"]: r["median"] for r in exact_percentiles(long, ["feature"], "value", {"median": 0.5}, bounded_keys=True).collect()}
    away = df.select(F.inline(F.array(*[F.struct(F.lit(f).alias("feature"), F.abs(F.col(f).cast("double") - med.get(f)).alias("dev")) for f in names])))
    mad = {r["feature"]: r["mad"] for r in exact_percentiles(away, ["feature"], "dev", {"mad": 0.5}, bounded_keys=True).collect()}

    def z(f: str) -> Column:
        return F.abs(F.col(f).cast("double") - med.get(f)) / (1.4826 * mad[f] if mad.get(f) else 1.0)

    scored = df.withColumns({f"{name}_score": F.round(sum((z(f) for f in group[1:]), z(group[0])) / float(len(group)), 9) for name, group in groups.items()})
    scores = scored.select(F.inline(F.array(*[F.struct(F.lit(name).alias("name"), F.col(f"{name}_score").alias("score")) for name in groups])))
    cuts = {r["name"]: r["cut"] for r in exact_percentiles(scores, ["name"], "score", {"cut": 1 - contamination}, bounded_keys=True).collect()}
    flag = {"robust": "is_outlier"} if not isinstance(features, dict) else {name: f"{name}_outlier" for name in groups}
    return scored.withColumns({flag[name]: F.col(f"{name}_score") > cuts.get(name) for name in groups})
