"""Raster features of dense array columns ``px`` (row-major) with ``h`` and ``w``.

Two forms, both without a shuffle: features of single pixels are Spark
expressions over the row's array; features that look at neighbours or sort the
pixels are NumPy kernels on Arrow batches (``kernels``), because expressions over
arrays are interpreted element by element.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from tidemark.functions.scalars import let
from tidemark.operators import kernels as kn

# Fixed values of the image scores.
LEVELS = 256
WATER_HUE, WATER_MIN_SATURATION, WATER_MIN_VALUE = (90, 130), 50, 50


def moments(values: Column) -> Column:
    """``struct(mean, var, std)`` of an array (population variance), in one fold."""
    zero = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0.0).alias("s"), F.lit(0.0).alias("q"))
    return F.aggregate(
        values, zero,
        lambda a, v: F.struct((a["n"] + 1).alias("n"), (a["s"] + v).alias("s"), (a["q"] + v * v).alias("q")),
        lambda a: F.struct(F.try_divide(a["s"], a["n"]).alias("mean"), _variance(a).alias("var"),
                           F.sqrt(_variance(a)).alias("std")))


def _variance(a: Column) -> Column:
    m = F.try_divide(a["s"], a["n"])
    return F.greatest(F.lit(0.0), F.try_divide(a["q"], a["n"]) - m * m)


def mean(values: Column) -> Column:
    return moments(values)["mean"]


def std(values: Column) -> Column:
    return moments(values)["std"]


def variance(values: Column) -> Column:
    return moments(values)["var"]


def value_range(values: Column) -> Column:
    return F.array_max(values) - F.array_min(values)


def normalise(px: Column) -> Column:
    """Min-max scaling to [0, 1]; a constant raster becomes zeros."""
    return let(F.struct(F.array_min(px).alias("lo"), F.array_max(px).alias("hi")), lambda e: F.transform(
        px, lambda v: F.when(e["hi"] > e["lo"], (v - e["lo"]) / (e["hi"] - e["lo"])).otherwise(0.0)))


def _half_up(x: np.ndarray) -> np.ndarray:
    """Round to the nearest whole level."""
    return np.floor(x + 0.5)


def _grey(r: np.ndarray, g: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whole grey levels."""
    return _half_up(0.299 * r + 0.587 * g + 0.114 * b)


def hsv(r: np.ndarray, g: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hue 0-179, saturation and value 0-255, all whole numbers."""
    v = np.maximum(np.maximum(r, g), b)
    diff = v - np.minimum(np.minimum(r, g), b)
    turn = np.where(v == r, g - b, np.where(v == g, b - r + 2 * diff, r - g + 4 * diff))
    hue = _half_up(np.divide(turn * 30.0, diff, out=np.zeros_like(v), where=diff > 0))
    sat = _half_up(np.divide(diff * 255.0, v, out=np.zeros_like(v), where=v > 0))
    return np.where(hue < 0, hue + 180, hue), sat, v


def _lower(a: np.ndarray) -> np.ndarray:
    """Rows of the lower two thirds."""
    return a[:, a.shape[1] // 3:]


def _colour_kernel(r: np.ndarray, g: np.ndarray, b: np.ndarray) -> dict[str, np.ndarray]:
    out = {}
    for name, plane in (("r", r), ("g", g), ("b", b)):
        out |= {f"{name}_mean": kn.mean(plane), f"{name}_std": kn.std(plane), f"{name}_range": kn.spread(plane)}
    means = np.stack([out["r_mean"], out["g_mean"], out["b_mean"]], axis=1)
    middle = means.mean(axis=1)
    balance = 1 - np.divide(means.std(axis=1), middle, out=np.ones_like(middle), where=middle > 0)
    hue, sat, value = hsv(r, g, b)
    low, high = WATER_HUE
    water = (hue >= low) & (hue <= high) & (sat >= WATER_MIN_SATURATION) & (value >= WATER_MIN_VALUE)
    level = _grey(r, g, b)
    return out | {
        "colour_balance": balance, "grey_mean": kn.mean(level), "saturation": kn.mean(sat) / 255.0,
        "hue_variance": kn.flat(hue).var(axis=1) / 32400.0, "water_coverage": kn.mean(water.astype(np.float64)),
        "blue_coverage": kn.mean(((_lower(b) > _lower(r)) & (_lower(b) > _lower(g))).astype(np.float64)),
        "dark_coverage": kn.mean((_lower(level) < 128).astype(np.float64))}


def colour_measures(df: DataFrame) -> DataFrame:
    """Colour, water and darkness measures of planes ``r, g, b`` of levels 0-255, in one pass.

    Mean, deviation and range per channel; the colour balance ``1 - std / mean`` of the channel means; saturation and hue
    statistics; the shares of water-coloured pixels, and of blue-dominant and of dark ones in the lower two thirds.
    """
    names = [f"{c}_{k}" for c in "rgb" for k in ("mean", "std", "range")] + [
        "colour_balance", "grey_mean", "saturation", "hue_variance", "water_coverage", "blue_coverage", "dark_coverage"]
    return kn.apply_kernel(df, _colour_kernel, ", ".join(f"{n} double" for n in names), arrays=("r", "g", "b"))


def _grey_kernel(a: np.ndarray) -> dict[str, np.ndarray]:
    m, deviation = kn.mean(a), kn.std(a)
    low, high = kn.flat(a).min(axis=1), kn.flat(a).max(axis=1)
    return {"brightness": m, "brightness_std": deviation, "rms_ratio": np.divide(deviation, m, out=np.zeros_like(m), where=m > 0),
            "rms_contrast": deviation / 255.0, "michelson": (high - low) / (high + low + 1e-8), "dynamic_range": (high - low) / 255.0,
            "dark_coverage": kn.mean((_lower(a) < 128).astype(np.float64))}


_GREY = ["brightness", "brightness_std", "rms_ratio", "rms_contrast", "michelson", "dynamic_range", "dark_coverage"]


def grey_measures(df: DataFrame) -> DataFrame:
    """Brightness, both RMS contrasts, Michelson contrast, dynamic range, and the dark share of the lower two thirds of levels 0-255."""
    return kn.apply_kernel(df, _grey_kernel, ", ".join(f"{n} double" for n in _GREY))


def level_measures(df: DataFrame) -> DataFrame:
    """``grey_measures`` and ``neighbour_measures`` in one pass."""
    return kn.apply_kernel(df, lambda a: _grey_kernel(a) | _neighbour_kernel(a), ", ".join(f"{n} double" for n in _GREY + _NEIGHBOUR))


def pixel_rows(df: DataFrame, px: str = "px") -> DataFrame:
    """One row ``(y, x, v)`` per pixel beside the other columns, for joins on pixels; nothing is shuffled.

    A missing raster has no rows. Measures of whole rasters need no such rows: use the kernels.
    """
    others = [c for c in df.columns if c not in (px, "h", "w")]
    rows = df.select(*others, "w", F.posexplode(px).alias("_i", "v"))
    return rows.select(*others, F.floor(F.col("_i") / F.col("w")).alias("y"), (F.col("_i") % F.col("w")).cast("bigint").alias("x"), "v")


def _neighbour_kernel(a: np.ndarray) -> dict[str, np.ndarray]:
    lap, edges = kn.laplacian(a), kn.sobel(a)
    high_pass = np.clip(9 * a - 9 * kn.box(a, 3), 0, 255)
    q = kn.flat(lap)
    variance = (q * q).mean(axis=1) - q.mean(axis=1) ** 2
    return {"laplacian_variance": variance, "edge_mean": kn.mean(edges), "edge_max": kn.flat(edges).max(axis=1),
            "noise_level": np.minimum(1.0, kn.std(high_pass) / 255.0), "laplacian_noise": variance / 65025.0}


_NEIGHBOUR = ["laplacian_variance", "edge_mean", "edge_max", "noise_level", "laplacian_noise"]


def neighbour_measures(df: DataFrame) -> DataFrame:
    """Laplacian variance, Sobel statistics and both noise estimates of grey levels 0-255."""
    return kn.apply_kernel(df, _neighbour_kernel, ", ".join(f"{n} double" for n in _NEIGHBOUR))


def image_scores(contrast: Column, sharpness: Column, ocean: Column, noise: Column, dynamic_range: Column,
                 brightness: Column) -> dict[str, Column]:
    """The three composite image scores."""
    def unit(x: Column) -> Column:
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    sharp_1k = F.least(F.lit(1.0), sharpness / 1000.0)
    light = F.greatest(F.lit(0.0), 1 - F.abs(brightness - 127.5) / 127.5)
    flags = [((brightness / 255.0).between(0.1, 0.9), 0.5), (contrast > 0.1, 0.5), (sharpness > 100, 0.5)]
    parts = [F.when(ok, 1.0).otherwise(low) for ok, low in flags]
    return {
        "strict_score": unit(0.3 * contrast + 0.3 * sharp_1k + 0.3 * ocean + 0.1 * (1 - noise)),
        "validator_score": unit(0.3 * F.least(contrast * 2, F.lit(1.0)) + 0.3 * F.least(F.lit(1.0), sharpness / 10000.0)
                                + 0.2 * dynamic_range + 0.2 * light),
        "flag_score": (parts[0] + parts[1] + parts[2]) / 3.0}


def is_corrupt(px: Column, kind: str = "float") -> Column:
    """Empty, NaN or infinite values, or outside the range (floats may stray by 0.1)."""
    low, high = (-0.1, 1.1) if kind == "float" else (0.0, 255.0)
    bad = F.exists(px, lambda v: F.isnan(v) | (F.abs(v) == float("inf")) | (v < low) | (v > high))
    return F.coalesce((F.size(px) == 0) | bad, F.lit(True))


def depth_quality(df: DataFrame) -> DataFrame:
    """Quality columns of a depth map in [0, 1]."""
    def kernel(a: np.ndarray) -> dict[str, np.ndarray]:
        h = a.shape[1]
        texture = sum(kn.mean(np.abs(a - kn.box(a, k))) for k in (3, 5, 7)) / 3
        local = np.sqrt(np.maximum(0.0, kn.box(a * a, 5) - kn.box(a, 5) ** 2))
        # most common depth: the fullest of 50 bins, the lower one on ties
        common = kn.counts(np.minimum(np.floor(a * 50), 49), 50).argmax(axis=1)
        centre = (common / 50 + (common + 1) / 50) / 2
        away = np.abs(a - centre[:, None, None])
        return {"depth_std": kn.std(a), "depth_mean": kn.mean(a), "depth_range": kn.spread(a),
                "texture_capture": np.minimum(1.0, texture * 10), "local_texture": np.minimum(1.0, kn.mean(local)),
                "wave_contrast": np.minimum(1.0, 4 * kn.std(away)), "edge_strength": kn.mean(kn.sobel(a)),
                "consistency": 1 - kn.share_above(kn.gradient_magnitude(a), 95),
                "_far": kn.std(a[:, :h // 3]), "_near": kn.std(a[:, 2 * h // 3:])}
    names = ["depth_std", "depth_mean", "depth_range", "texture_capture", "local_texture", "wave_contrast",
             "edge_strength", "consistency", "_far", "_near"]
    measured = kn.apply_kernel(df, kernel, ", ".join(f"{n} double" for n in names))
    one, far, near, sd = F.lit(1.0), F.col("_far"), F.col("_near"), F.col("depth_std")
    scored = measured.withColumns({
        "quality_score": F.least(one, (sd * 2 + F.col("depth_range")) / 2.0),
        "far_field": F.least(one, 2 * F.when(near > 0, far / near).otherwise(far)),
        "far_std": F.least(one, 2 * far),
        "validity": F.when(~F.col("depth_mean").between(0.0, 1.0), 0.0)
                     .when((sd < 0.01) | (sd > 0.5), 0.5).otherwise(1.0)})
    total = (0.25 * F.least(one, F.col("edge_strength")) + 0.20 * F.col("local_texture") + 0.15 * F.col("far_std")
             + 0.15 * sd + 0.15 * F.col("consistency") + 0.10 * F.col("validity"))
    return scored.withColumn("overall", F.greatest(F.lit(0.0), F.least(one, total))).drop("_far", "_near")


def edge_correlation(df: DataFrame, image: str, depth: str) -> DataFrame:
    """Correlation of the two Sobel maps (at least 0) and of the values themselves (absolute)."""
    def kernel(a: np.ndarray, b: np.ndarray) -> dict[str, np.ndarray]:
        edges = np.nan_to_num(kn.correlation(kn.sobel(a), kn.sobel(b)))
        return {"edge_preservation": np.maximum(0.0, edges),
                "brightness_depth": np.abs(np.nan_to_num(kn.correlation(a, b)))}
    return kn.apply_kernel(df, kernel, "edge_preservation double, brightness_depth double", arrays=(image, depth))


def wave_characteristics(df: DataFrame) -> DataFrame:
    """Wave measures of a depth map.

    Wave count and wavelength come from the smoothed centre row (local maxima; strongest frequency),
    steepness, gradient strength, foam share and roughness from the smoothed map, ``direction_gradient``
    is the mean horizontal gradient of the 5x5-smoothed map without the outer tenth of the columns,
    ``iqr_range`` the range within 1.5 interquartile ranges of the quartiles.
    """
    def kernel(a: np.ndarray) -> dict[str, np.ndarray]:
        n, h, w = a.shape
        smooth = kn.gaussian(a)
        magnitude, row = kn.gradient_magnitude(smooth), smooth[:, h // 2]
        power = np.abs(np.fft.fft(row, axis=1)[:, 1:w // 2])
        wavelength = w / (power.argmax(axis=1) + 1.0) if power.shape[1] else np.full(n, w / 2.0)
        inner = row[:, 1:-1]
        waves = ((inner > row[:, :-2]) & (inner > row[:, 2:])).sum(axis=1)
        margin = int(w * 0.1)
        inside = kn.box(a[:, :, margin:w - margin], 5, "reflect")
        x = kn.flat(a)
        q1, q3 = np.percentile(x, [25, 75], axis=1)
        reach = 1.5 * (q3 - q1)
        ordinary = (x >= (q1 - reach)[:, None]) & (x <= (q3 + reach)[:, None])
        return {"wave_count": waves, "wavelength": wavelength, "steepness": kn.spread(smooth) / wavelength,
                "gradient_mean": kn.mean(magnitude), "roughness": kn.std(magnitude),
                "foam": kn.share_above(magnitude, 85),
                "direction_gradient": kn.mean(np.gradient(inside, axis=2)),
                "plain_gradient": kn.mean(np.gradient(a, axis=2)), "full_range": kn.spread(a),
                "iqr_range": np.where(ordinary, x, -np.inf).max(axis=1) - np.where(ordinary, x, np.inf).min(axis=1)}
    doubles = ["wavelength", "steepness", "gradient_mean", "roughness", "foam", "direction_gradient", "plain_gradient",
               "full_range", "iqr_range"]
    return kn.apply_kernel(df, kernel, "wave_count bigint, " + ", ".join(f"{n} double" for n in doubles))


# Fixed values of the rule labeller.
HEIGHT_SCALE, HEIGHT_BASE, MIN_HEIGHT, MAX_HEIGHT = 8.5, 0.1, 0.5, 8.0
DIRECTION_LIMIT, WIND_LIMIT, STEEP_LIMIT, FLAT_LIMIT = 0.008, 0.6, 0.12, 0.05
FALLBACK_SCALE, FALLBACK_DIRECTION_LIMIT = 8.0, 0.01


def rule_labels(df: DataFrame, wind: Column) -> DataFrame:
    """Height, direction and breaking labels with confidences, and the simple fallback labels.

    ``df`` is the result of ``wave_characteristics``; ``wind`` the wind strength.
    """
    n, steep, g = F.col("wave_count"), F.col("steepness"), F.col("direction_gradient")

    def height(metres: Column) -> Column:
        return F.greatest(F.lit(MIN_HEIGHT), F.least(F.lit(MAX_HEIGHT), metres))

    def side(gradient: Column, limit: float) -> Column:
        return F.when(gradient > limit, "RIGHT").when(gradient < -limit, "LEFT").otherwise("STRAIGHT")
    straight = F.abs(g) <= DIRECTION_LIMIT
    windy, steepy, level = wind > WIND_LIMIT, steep > STEEP_LIMIT, F.col("gradient_mean") < FLAT_LIMIT
    base = F.when(windy, 0.9).when(steepy, 0.88).when(level, 0.85).otherwise(0.82)
    foamy = F.when(windy, F.least(F.lit(0.95), base + 0.05)).otherwise(base * 0.95)
    return df.withColumns({
        "height_meters": height(F.col("iqr_range") * HEIGHT_SCALE + HEIGHT_BASE),
        "height_confidence": 0.95 * F.when(n < 2, 0.9).when(n > 10, 0.85).otherwise(1.0)
        * F.when(steep > 0.2, 0.9).otherwise(1.0),
        "direction": side(g, DIRECTION_LIMIT),
        "direction_confidence": F.when(straight, 0.85).otherwise(F.least(F.lit(0.95), 0.7 + F.abs(g) * 20))
        * F.when(n > 5, 0.9).otherwise(1.0),
        "breaking_type": F.when(windy, "SPILLING").when(steepy, "PLUNGING").when(level, "SURGING").otherwise("PLUNGING"),
        "breaking_confidence": F.when(F.col("foam") > 0.3, foamy).otherwise(base),
        "fallback_height": height(F.col("full_range") * FALLBACK_SCALE),
        "fallback_direction": side(F.col("plain_gradient"), FALLBACK_DIRECTION_LIMIT),
        "fallback_breaking": F.when(windy, "SPILLING").when(F.col("full_range") > STEEP_LIMIT, "PLUNGING")
        .otherwise("SURGING")})


def clip01(px: Column) -> Column:
    return F.transform(px, lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v)))


def fog(px: Column, h: Column, w: Column, intensity: float, colour: float = 0.9) -> Column:
    """Blend towards the fog colour, strongest at the top, falling to 30 % at the bottom."""
    def pixel(v: Column, i: Column) -> Column:
        y = F.floor(i / w)
        m = intensity + (0.3 * intensity - intensity) * y / (h - 1)
        return v * (1 - m) + colour * m
    return clip01(F.transform(px, pixel))


def glare(px: Column, h: Column, w: Column, intensity: float, cx: Column, cy: Column, colour: float = 1.0) -> Column:
    """Add light falling off exponentially from the glare centre."""
    def pixel(v: Column, i: Column) -> Column:
        dx, dy = i % w - cx, F.floor(i / w) - cy
        reach = F.sqrt((h * h + w * w).cast("double")) / 2.0
        return v + F.exp(-3 * F.sqrt((dx * dx + dy * dy).cast("double")) / reach) * intensity * colour
    return clip01(F.transform(px, pixel))


def lighting(px: Column, brightness: float, contrast: float) -> Column:
    """Scale brightness, then contrast about the mean."""
    lit = F.transform(px, lambda v: v * brightness)
    return clip01(let(mean(lit), lambda m: F.transform(lit, lambda v: (v - m) * contrast + m)))


def augment_variants(df: DataFrame, *, edge_threshold: float = 0.5) -> DataFrame:
    """Three variants per raster (fog, glare, lighting); a variant that loses structure is replaced by the original.

    Structure holds when at least 80 % of the edge pixels (Sobel above the
    threshold) remain and the correlation with the original is at least 0.95.
    """
    px, h, w = F.col("px"), F.col("h"), F.col("w")
    made = F.array(
        F.struct(F.lit("fog").alias("variant"), fog(px, h, w, 0.3).alias("new")),
        F.struct(F.lit("glare").alias("variant"), glare(px, h, w, 0.4, F.floor(w / 2), F.floor(h / 4)).alias("new")),
        F.struct(F.lit("lighting").alias("variant"), lighting(px, 1.1, 0.9).alias("new")))
    rows = df.withColumn("_v", F.explode(made)).select(*df.columns, "_v.*")

    def kernel(a: np.ndarray, b: np.ndarray) -> dict[str, np.ndarray]:
        def edges(x: np.ndarray) -> np.ndarray:
            return (kn.flat(kn.sobel(x)) > edge_threshold).sum(axis=1)
        return {"_e0": edges(a), "_e1": edges(b), "correlation": kn.correlation(a, b)}
    rows = kn.apply_kernel(rows, kernel, "_e0 bigint, _e1 bigint, correlation double", arrays=("px", "new"),
                           keep_arrays=True)
    alike = ~F.isnan("correlation") & (F.col("correlation") >= 0.95)
    kept = (F.col("_e0") == 0) | ((F.col("_e1") >= 0.8 * F.col("_e0")) & alike)
    return rows.withColumn("preserved", kept) \
        .withColumn("result", F.when(kept, F.col("new")).otherwise(F.col("px"))).drop("_e0", "_e1", "new")


def image_measures(df: DataFrame) -> DataFrame:
    """Contrast, dynamic range, entropy, dominant level and 32-bin histogram statistics of grey levels."""
    def kernel(a: np.ndarray) -> dict[str, np.ndarray]:
        n = a.shape[1] * a.shape[2]
        levels = kn.counts(a, LEVELS)
        p, wide = levels / n, levels.reshape(len(a), 32, -1).sum(axis=2)
        brightness = kn.mean(a)
        contrast = np.divide(kn.std(a), brightness, out=np.zeros(len(a)), where=brightness > 0)
        return {"brightness": brightness, "contrast": contrast, "dynamic_range": kn.spread(a) / 255.0,
                "entropy": -(p * np.log2(p + 1e-10)).sum(axis=1), "dominant_level": levels.argmax(axis=1),
                "hist_mean": wide.mean(axis=1), "hist_std": wide.std(axis=1)}
    return kn.apply_kernel(df, kernel, ", ".join(f"{c} double" for c in (
        "brightness", "contrast", "dynamic_range", "entropy", "dominant_level", "hist_mean", "hist_std")))


FEATURES = ["brightness", "contrast", "saturation", "sharpness", "texture",
            "hist_b_mean", "hist_b_std", "hist_g_mean", "hist_g_std", "hist_r_mean", "hist_r_std"]


def _feature_kernel(r: np.ndarray, g: np.ndarray, b: np.ndarray) -> dict[str, np.ndarray]:
    """The eleven features of stacks of colour planes with levels 0-255."""
    level = _grey(r, g, b)
    top = np.maximum(np.maximum(r, g), b)
    reach = top - np.minimum(np.minimum(r, g), b)
    saturation = np.floor(np.divide(reach * 255.0, top, out=np.zeros_like(top), where=top > 0) + 0.5)
    out = {"brightness": kn.mean(level), "contrast": kn.std(level), "saturation": kn.mean(saturation),
           "sharpness": kn.flat(kn.laplacian(level)).var(axis=1), "texture": kn.mean(kn.sobel(level))}
    for name, plane in (("b", b), ("g", g), ("r", r)):
        bins = kn.counts(np.floor(plane / 8), 32)
        out |= {f"hist_{name}_mean": bins.mean(axis=1), f"hist_{name}_std": bins.std(axis=1)}
    return out


def feature_vector(df: DataFrame) -> DataFrame:
    """The eleven features that datasets are compared on, from colour planes ``r, g, b`` of levels 0-255.

    Brightness and contrast are mean and deviation of the grey levels, sharpness the Laplacian variance,
    texture the mean Sobel magnitude; each channel adds mean and deviation of its 32-bin histogram.
    """
    return kn.apply_kernel(df, _feature_kernel, ", ".join(f"{c} double" for c in FEATURES), arrays=("r", "g", "b"))


REPORT_MEASURES = [*FEATURES, "dynamic_range", "entropy", "colour_balance", "water_coverage"]


def report_measures(df: DataFrame) -> DataFrame:
    """What a dataset report needs of each image, in one pass over its colour planes: the eleven features, the dynamic range and entropy
    of the grey levels, the colour balance and the share of water-coloured pixels."""
    def kernel(r: np.ndarray, g: np.ndarray, b: np.ndarray) -> dict[str, np.ndarray]:
        level, colour = _grey(r, g, b), _colour_kernel(r, g, b)
        p = kn.counts(level, LEVELS) / (level.shape[1] * level.shape[2])
        return _feature_kernel(r, g, b) | {
            "dynamic_range": kn.spread(level) / 255.0, "entropy": -(p * np.log2(p + 1e-10)).sum(axis=1),
            "colour_balance": colour["colour_balance"], "water_coverage": colour["water_coverage"]}
    return kn.apply_kernel(df, kernel, ", ".join(f"{c} double" for c in REPORT_MEASURES), arrays=("r", "g", "b"))


def image_features(images: DataFrame) -> DataFrame:
    """The same features straight from decoded image bytes (``h, w, channels, data``, as ``scan_images`` gives them).

    One pass, one image at a time, bytes in and numbers out: no pixel array leaves the task.  ``reason`` says why a row
    has none: ``unreadable``, ``too small``, or ``wrong length``.
    """
    keep = [f for f in images.schema.fields if f.name != "data" and f.name not in (*FEATURES, "reason")]
    schema = StructType([*keep, *[StructField(c, DoubleType()) for c in FEATURES], StructField("reason", StringType())])
    arrow = to_arrow_schema(schema)

    def one(h: int | None, w: int | None, channels: int | None, data: bytes | None) -> dict[str, object]:
        if not h or not w or not channels or min(h, w, channels) <= 0 or data is None:
            return {"reason": "unreadable"}
        if min(h, w) < kn.LEAST_SIDE:
            return {"reason": "too small"}
        if len(data) != h * w * channels:
            return {"reason": "wrong length"}
        pixels = np.frombuffer(data, np.uint8).reshape(1, h, w, channels)
        planes = [pixels[..., k if channels >= 3 else 0].astype(np.float64) for k in (2, 1, 0)]  # decoded bytes are blue first
        return {name: float(value[0]) for name, value in _feature_kernel(*planes).items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [one(*(x.as_py() for x in row)) for row in zip(*(batch.column(c) for c in ("h", "w", "channels", "data")))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(f.name) for f in keep] + [pa.array([x.get(n) for x in found], arrow.field(n).type) for n in (*FEATURES, "reason")],
                schema=arrow)
    return images.mapInArrow(run, schema)


def equalise(df: DataFrame, factor: float = 1.5) -> DataFrame:
    """Histogram-equalised raster in [0, 1] (``px``), its median, and the contrast-enhanced raster ``enhanced``.

    Enhancement stretches values about the median and clips.
    """
    def kernel(a: np.ndarray) -> dict[str, np.ndarray]:
        levels = kn.counts(a, LEVELS)
        total = levels.cumsum(axis=1)
        lowest = levels[np.arange(len(a)), (levels > 0).argmax(axis=1)][:, None]
        room = total[:, -1:] - lowest
        mapped = np.rint((total - lowest) * 255.0 / np.maximum(room, 1))
        mapped = np.where(room == 0, np.arange(LEVELS), mapped)
        new = np.take_along_axis(mapped, kn.flat(a).astype(np.int64), axis=1) / 255.0
        median = np.percentile(new, 50, axis=1)[:, None]
        enhanced = np.clip(median + (new - median) * factor, 0, 1)
        return {"px": new.reshape(a.shape), "median": median[:, 0], "enhanced": enhanced.reshape(a.shape)}
    return kn.apply_kernel(df, kernel, "px array<double>, median double, enhanced array<double>")
