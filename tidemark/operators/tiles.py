"""Measures of very large images by tiles, so that one image spreads over many tasks.

A table function cuts an image's bytes into tiles that carry a halo of their neighbours' pixels; each tile gives sums over its own
pixels, and the sums of an image add up to the numbers of the whole image. Nothing but the tiles and one row of sums a tile moves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tidemark.operators import kernels as kn

#: Side of a tile, and the pixels around it that the neighbourhood measures need.
TILE, HALO = 1024, 1


class _Tiles:
    """Tiles of one image of one-byte levels: place, size of the inner part, sides with a halo, and bytes; an image that cannot be cut gives
    one row of nulls."""

    def eval(self, data, h, w, side):
        if data is None or not h or not w or min(h, w) < kn.LEAST_SIDE or len(data) != h * w:
            yield (None,) * 9
            return
        a = np.frombuffer(data, np.uint8).reshape(h, w)
        for y in range(0, h, side):
            for x in range(0, w, side):
                y1, x1 = min(y + side, h), min(x + side, w)
                top, left = min(HALO, y), min(HALO, x)
                cut = a[y - top:y1 + HALO, x - left:x1 + HALO]
                yield y, x, y1 - y, x1 - x, top, left, cut.shape[0], cut.shape[1], cut.tobytes()


tiles_of = F.udtf(_Tiles, returnType="ty int, tx int, th int, tw int, top int, left int, h int, w int, data binary")


def cut_tiles(df: DataFrame, *, side: int = TILE) -> DataFrame:
    """The other columns and one row a tile of each image (``h, w, data``: one byte a pixel, row by row).

    An image that is missing, below two pixels on a side or of the wrong length has one row without a tile.
    """
    kept = [c for c in df.columns if c not in ("data", "h", "w")]
    image = df.select(*kept, F.col("data").alias("_data"), F.col("h").alias("_h"), F.col("w").alias("_w"))
    cut = image.lateralJoin(tiles_of(F.col("_data").outer(), F.col("_h").outer(), F.col("_w").outer(), F.lit(side)))
    return cut.drop("_data", "_h", "_w")


_SUMS = ["pixels", "level_sum", "level_squares", "lap_sum", "lap_squares", "edge_sum", "edge_max", "noise_sum", "noise_squares"]


def _tile_sums(data: bytes, h: int, w: int, top: int, left: int, th: int, tw: int) -> list[float]:
    a = np.frombuffer(data, np.uint8).reshape(1, h, w).astype(np.float64)

    def inner(x: np.ndarray) -> np.ndarray:
        return x[0, top:top + th, left:left + tw]
    level, lap, edge = inner(a), inner(kn.laplacian(a)), inner(kn.sobel(a))
    noise = inner(np.clip(9 * a - 9 * kn.box(a, 3), 0, 255))
    return [float(level.size), level.sum(), (level * level).sum(), lap.sum(), (lap * lap).sum(), edge.sum(), edge.max(), noise.sum(), (noise * noise).sum()]


def tiled_measures(df: DataFrame, key: str, *, side: int = TILE, spread: int | None = None) -> DataFrame:
    """Brightness, deviation, Laplacian variance, Sobel mean and maximum and both noise estimates of whole images, by tiles.

    ``df`` holds a unique ``key`` and ``h, w, data``. The numbers are those of ``raster.level_measures`` up to the order of
    additions. Tiles are dealt over ``spread`` partitions (the session's shuffle partitions by default), so the tiles of one image go
    to different tasks. Images that cannot be cut have nulls and no tiles.
    """
    by = [key, "ty", "tx"]
    cut = cut_tiles(df.select(key, "h", "w", "data"), side=side)
    dealt = cut.repartition(spread, *by) if spread else cut.repartition(*by)
    schema = StructType([df.schema[key], *StructType.fromDDL(", ".join(f"{n} double" for n in _SUMS))])
    arrow = to_arrow_schema(schema)
    places = ("h", "w", "top", "left", "th", "tw")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = [pc.fill_null(batch.column(c), 0).to_pylist() for c in places]
            rows = [_tile_sums(d.as_py(), *p) if d.is_valid else [None] * len(_SUMS) for d, *p in zip(batch.column("data"), *numbers)]
            columns = list(zip(*rows)) if rows else [[]] * len(_SUMS)
            yield pa.RecordBatch.from_arrays([batch.column(key), *[pa.array(c, pa.float64()) for c in columns]], schema=arrow)
    sums = dealt.mapInArrow(run, schema).groupBy(key).agg(
        F.count("pixels").alias("tiles"), *[(F.max if n == "edge_max" else F.sum)(n).alias(n) for n in _SUMS])
    n = F.col("pixels")

    def variance(name: str) -> Column:
        return F.greatest(F.lit(0.0), F.col(f"{name}_squares") / n - (F.col(f"{name}_sum") / n) ** 2)
    lap = F.when(n.isNotNull(), variance("lap"))
    return sums.select(
        key, "tiles", (F.col("level_sum") / n).alias("brightness"), F.when(n.isNotNull(), F.sqrt(variance("level"))).alias("brightness_std"),
        lap.alias("laplacian_variance"), (F.col("edge_sum") / n).alias("edge_mean"), "edge_max",
        F.when(n.isNotNull(), F.least(F.lit(1.0), F.sqrt(variance("noise")) / 255.0)).alias("noise_level"), (lap / 65025.0).alias("laplacian_noise"))
