"""Row rules: quality gates, label checks and parameter limits, as plain columns."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the gates.
MIN_BYTES, MAX_BYTES = 1024, 50 * 1024 * 1024
MIN_SIDE, MAX_SIDE = 224, 4096
FILE_EXTENSIONS = ["jpg", "jpeg", "png", "bmp", "tiff", "tif"]
GATE_MIN, GATE_MAX, GATE_FORMATS = (640, 480), (3840, 2160), ["JPEG", "PNG", "WEBP"]
REQUIRED_FILES = {"raw": 100, "depth": 100, "synthetic": 500}
GATE_THRESHOLD = 0.7
HEIGHT_RANGE = (0.5, 8.0)
FEET_PER_METRE = 3.28084
DIRECTIONS = ["LEFT", "RIGHT", "STRAIGHT"]
BREAKING_TYPES = ["SPILLING", "PLUNGING", "SURGING"]


def found(*messages: Column) -> Column:
    """The non-null messages as a list."""
    return F.array_compact(F.array(*messages))


def image_gate(min_size: tuple[int, int] = GATE_MIN, max_size: tuple[int, int] = GATE_MAX,
               formats: Sequence[str] = GATE_FORMATS) -> Column:
    """Width and height within bounds, three channels, allowed format."""
    return (F.col("width").between(min_size[0], max_size[0]) & F.col("height").between(min_size[1], max_size[1])
            & (F.col("channels") == 3) & F.col("format").isin(list(formats)))


def file_gate(df: DataFrame) -> DataFrame:
    """Add ``issue`` (the first failing check) and ``valid``."""
    issue = (F.when(F.col("file_bytes") < MIN_BYTES, "file too small")
             .when(F.col("file_bytes") > MAX_BYTES, "file too large")
             .when(~F.lower("ext").isin(FILE_EXTENSIONS), "unsupported format")
             .when((F.col("width") < MIN_SIDE) | (F.col("height") < MIN_SIDE), "resolution too low")
             .when((F.col("width") > MAX_SIDE) | (F.col("height") > MAX_SIDE), "resolution too high"))
    return df.withColumn("issue", issue).withColumn("valid", F.col("issue").isNull())


def image_issues(df: DataFrame) -> DataFrame:
    """Add the list of soft ``issues`` and ``valid`` = good score and no issue."""
    issues = found(F.when(F.col("brightness_std") < 10, F.lit("very low brightness variation")),
                   F.when(F.col("contrast") < 0.1, F.lit("very low contrast")),
                   F.when(F.col("sharpness") < 0.1, F.lit("very low sharpness")))
    return df.withColumn("issues", issues) \
             .withColumn("valid", (F.col("quality_score") >= GATE_THRESHOLD) & (F.size("issues") == 0))


def image_valid() -> Column:
    """Strict image gate."""
    return (~F.col("is_corrupted") & (F.col("width") >= 480) & (F.col("height") >= 480) & (F.col("contrast") >= 0.1)
            & (F.col("ocean_coverage") >= 0.3) & (F.col("quality_score") >= 0.5))


def depth_valid(variant: str = "edges") -> Column:
    """Depth map gate: on edges and contrast, or (``range``) on spread of the values."""
    if variant == "edges":
        return (F.col("edge_preservation") >= 0.3) & (F.col("contrast") >= 0.1) & (F.col("quality_score") >= 0.5)
    return (F.col("depth_range") >= 0.01) & (F.col("depth_std") >= 0.01) & (F.col("quality_score") >= GATE_THRESHOLD)


def known(label: Column, domain: Sequence[str]) -> Column:
    """Whether a label is in its domain; a missing one is not."""
    return F.coalesce(label.isin(list(domain)), F.lit(False))


def validate_labels(df: DataFrame) -> DataFrame:
    """Check label rows: hard errors, consistency warnings and the confidence left after penalties."""
    confidences = ["height_confidence", "direction_confidence", "breaking_confidence"]
    low, high = HEIGHT_RANGE
    errors = found(
        F.when(~F.col("height_meters").between(low, high), F.lit("height out of range")),
        F.when(F.abs(F.col("height_feet") - F.col("height_meters") * FEET_PER_METRE) > 0.01,
               F.lit("feet do not match metres")),
        F.when(~known(F.col("direction"), DIRECTIONS), F.lit("unknown direction")),
        F.when(~known(F.col("breaking_type"), BREAKING_TYPES), F.lit("unknown breaking type")),
        *[F.when(~F.col(c).between(0.0, 1.0), F.lit(f"{c} out of range")) for c in confidences])
    warnings = found(
        F.when((F.col("wind_strength") > 0.7) & (F.col("breaking_type") != "SPILLING"),
               F.lit("high wind without spilling")),
        F.when((F.col("height_meters") > 5.0) & ~F.col("extreme_conditions"), F.lit("large wave not marked extreme")),
        F.when((F.col("wave_steepness") > 0.15) & (F.col("breaking_type") == "SURGING"),
               F.lit("steep wave marked surging")))
    mean = sum((F.col(c) for c in confidences[1:]), F.col(confidences[0])) / 3.0
    return df.withColumns({"errors": errors, "warnings": warnings}).withColumns({
        "is_valid": F.size("errors") == 0,
        "confidence_score": F.greatest(F.lit(0.0), mean - 0.2 * F.size("errors") - 0.05 * F.size("warnings"))})


@dataclass(frozen=True)
class Limit:
    """Hard limits make a parameter invalid (score 0), recommended limits only lower its score."""
    name: str
    hard: tuple[float, float]
    recommended: tuple[float, float]


def validate_params(df: DataFrame, params: str, limits: Sequence[Limit]) -> DataFrame:
    """Score a map of parameters against limits: 0 outside hard, 0.7 outside recommended, else 1; row mean.

    Parameters absent from the map are not scored.  Everything stays in the row, no shuffle.
    """
    scores, invalid, warned = [], [], []
    for limit in limits:
        v = F.col(params)[limit.name]
        bad = ~v.between(*limit.hard)
        odd = ~v.between(*limit.recommended)
        scores.append(F.when(v.isNull(), None).when(bad, 0.0).when(odd, 0.7).otherwise(1.0))
        invalid.append(F.when(bad, F.lit(limit.name)))
        warned.append(F.when(~bad & odd, F.lit(limit.name)))
    present = found(*scores)
    mean = F.when(F.size(present) > 0, F.aggregate(present, F.lit(0.0), lambda a, s: a + s) / F.size(present))
    return df.withColumns({"invalid": found(*invalid), "warned": found(*warned), "score": mean}) \
             .withColumn("is_valid", F.size("invalid") == 0)


# Class codes, with the code used for anything else.
DIRECTION_CODES, DIRECTION_DEFAULT = {"LEFT": 0, "RIGHT": 1, "STRAIGHT": 2}, 2
BREAKING_CODES, BREAKING_DEFAULT = {"SPILLING": 0, "PLUNGING": 1, "SURGING": 2}, 0


def encode(label: Column, codes: dict[str, int], default: int) -> Column:
    """Class code of a label, ``default`` for unknown or missing labels."""
    table = F.create_map(*[x for k, v in codes.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.try_element_at(table, label), F.lit(default)).cast("bigint")


def sample_frames(df: DataFrame, every: int, fps: float, frame: str = "frame") -> DataFrame:
    """Every n-th frame of each video with its time offset in seconds."""
    return df.filter(F.col(frame) % every == 0).withColumn("timestamp", F.col(frame) / F.lit(fps))


# Accepted spellings of each column.
ALIASES = {
    "image": ["image", "input", "inputs", "pixel_values", "rgb"],
    "wave_height": ["wave_height", "height", "height_meters"],
    "wave_direction": ["wave_direction", "direction", "direction_label"],
    "breaking_type": ["breaking_type", "breaking"],
}


def normalise_columns(df: DataFrame) -> DataFrame:
    """Rename accepted spellings to the standard name; where several exist the first non-null wins."""
    used, out = set(), []
    for name, spellings in ALIASES.items():
        present = [c for c in spellings if c in df.columns]
        if present:
            used.update(present)
            out.append(F.coalesce(*[F.col(c) for c in present]).alias(name))
    return df.select(*[c for c in df.columns if c not in used], *out)


def drop_all_zero(df: DataFrame) -> DataFrame:
    """Drop numeric columns that hold nothing but zeros (one aggregate; one row comes to the driver)."""
    numeric = [f.name for f in df.schema.fields if f.dataType.typeName() in
               {"byte", "short", "integer", "long", "float", "double"} or f.dataType.typeName().startswith("decimal")]
    if not numeric:
        return df
    peak = df.agg(*[F.max(F.abs(F.col(c))).alias(c) for c in numeric]).first()
    return df.drop(*[c for c in numeric if peak[c] is not None and peak[c] == 0])


def file_kind(path: Column) -> Column:
    """``depth``, ``synthetic`` or ``raw`` by file name, null for anything else (label sidecars, other formats)."""
    name = F.regexp_extract(path, "([^/]+)$", 1)
    return (F.when(name.endswith("_depth.npy"), "depth")
            .when(name.endswith(".npy") & ~name.contains("_labels"), "synthetic")
            .when(name.rlike(r"\.(jpg|png)$"), "raw"))


def availability(df: DataFrame, kind: str, required: dict[str, int] = REQUIRED_FILES) -> DataFrame:
    """Are there enough files of each kind: ``(kind, n, required, enough)``."""
    one = df.agg(*[F.count_if(F.col(kind) == k).alias(f"_{i}") for i, k in enumerate(required)])
    rows = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"_{i}").alias("n"),
                              F.lit(need).cast("bigint").alias("required"))
                     for i, (k, need) in enumerate(required.items())])
    return one.select(F.inline(rows)).withColumn("enough", F.col("n") >= F.col("required"))


def default_rows(df: DataFrame, valid: Column) -> DataFrame:
    """Predictions of rejected inputs become the neutral row, with the reason in ``warnings``."""
    neutral = {"height_meters": 0.0, "direction": "STRAIGHT", "breaking_type": "NO_BREAKING", "confidence": 0.0}
    ok = F.coalesce(valid, F.lit(False))
    return df.withColumns({c: F.when(ok, F.col(c)).otherwise(F.lit(v)) for c, v in neutral.items()} | {
        "warnings": found(F.when(~ok, F.lit("input rejected by quality gate")))})
