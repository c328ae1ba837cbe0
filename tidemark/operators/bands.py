"""Values to named bands: rating ladders, cuts and attribute lookup by range."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.sources.tables import literal_table

# Rating schemes as (lowest score, label), best first.
RATINGS = {
    "dataset": [(0.9, "Excellent"), (0.8, "Good"), (0.7, "Acceptable"), (0.5, "Poor"), (None, "Very Poor")],
    "stage": [(0.8, "excellent"), (0.6, "good"), (0.4, "acceptable"), (None, "poor")],
    "similarity": [(0.9, "excellent"), (0.7, "good"), (0.5, "acceptable"), (None, "poor")],
    "diversity": [(0.9, "Exceptional"), (0.8, "Excellent"), (0.7, "Very Good"), (0.6, "Good"), (0.5, "Moderate"),
                  (None, "Poor")],
}
# Right-closed quality cut, left-closed height bands, surf guide.
QUALITY_CUT = ([0.0, 0.3, 0.7, 1.0], ["Low", "Medium", "High"])
HEIGHT_BANDS = [(0.5, 1.5, "0.5-1.5m"), (1.5, 3.0, "1.5-3.0m"), (3.0, 5.0, "3.0-5.0m"), (5.0, 8.0, "5.0-8.0m")]
SURF_GUIDE = [(0.3, 0.6, "Flat", "Beginner practice"), (0.6, 1.2, "Small", "Beginner"),
              (1.2, 1.8, "Medium", "Intermediate"), (1.8, 2.4, "Large", "Advanced"),
              (2.4, None, "Very Large", "Expert")]


def rate(score: Column, bands: Sequence[tuple[float | None, str]]) -> Column:
    """First band whose lower bound the score reaches; the band without bound catches the rest."""
    out = F.lit(next(label for low, label in bands if low is None))
    for low, label in sorted([b for b in bands if b[0] is not None]):
        out = F.when(score >= low, F.lit(label)).otherwise(out)
    return F.when(score.isNotNull(), out)


def health_rating(score: Column) -> Column:
    """HEALTHY above 0.8, DEGRADED above 0.5, else UNHEALTHY (strict bounds)."""
    return F.when(score > 0.8, "HEALTHY").when(score > 0.5, "DEGRADED").otherwise("UNHEALTHY")


def cut(value: Column, edges: Sequence[float], names: Sequence[str]) -> Column:
    """Right-closed bins ``(edge, next]``; the lowest edge itself and outside values give null."""
    out = F.lit(None).cast("string")
    for low, high, name in reversed(list(zip(edges[:-1], edges[1:], names))):
        out = F.when((value > low) & (value <= high), F.lit(name)).otherwise(out)
    return out


def band_number(value: Column, bands: Sequence[tuple]) -> Column:
    """Index of the left-closed band ``[low, high)`` holding the value, or null."""
    out = F.lit(None).cast("int")
    for i, (low, high, *_) in enumerate(bands):
        inside = value >= low if high is None else (value >= low) & (value < high)
        out = F.when(inside, F.lit(i)).otherwise(out)
    return out


def height_band(value: Column) -> Column:
    """Name of the left-closed height band, null outside."""
    names = F.array(*[F.lit(name) for _, _, name in HEIGHT_BANDS])
    return F.get(names, band_number(value, HEIGHT_BANDS))


def surfability(df: DataFrame, height: str) -> DataFrame:
    """Add ``surfability`` and ``skill`` from the height guide."""
    at = band_number(F.col(height), SURF_GUIDE)
    return df.withColumns({
        "surfability": F.get(F.array(*[F.lit(b[2]) for b in SURF_GUIDE]), at),
        "skill": F.get(F.array(*[F.lit(b[3]) for b in SURF_GUIDE]), at)})


def band_join(df: DataFrame, value: str, bands: Sequence[tuple], columns: str) -> DataFrame:
    """Join each row to the attributes of its band.

    The band number is computed from the literal bounds, so the range lookup is
    an ordinary hash join against a table of ``len(bands)`` rows.
    """
    rows = [(i, *band) for i, band in enumerate(bands)]
    table = literal_table(df.sparkSession, f"_band int, {columns}", rows)
    tagged = df.withColumn("_band", band_number(F.col(value), bands))
    return tagged.join(F.broadcast(table), "_band", "inner").drop("_band")
