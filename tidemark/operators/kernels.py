"""NumPy neighbourhood kernels on stacks of equally sized rasters, applied to Arrow batches.

Spark partitions the images; a kernel sees one batch's rasters of one size as an
array ``(n, h, w)`` and answers for all of them at once.  Nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

Kernel = Callable[..., dict[str, np.ndarray]]
LEAST_SIDE = 2              # smaller rasters have no neighbourhood
STACK_PIXELS = 1 << 22      # pixels worked on at once, so the working arrays stay small for large photos


def apply_kernel(df: DataFrame, kernel: Kernel, outputs: str, arrays: Sequence[str] = ("px",),
                 keep_arrays: bool = False) -> DataFrame:
    """Add the columns ``outputs`` (DDL) that ``kernel(*arrays)`` computes from the raster columns ``arrays``.

    Rasters are dropped from the result unless ``keep_arrays``.  A kernel output is
    ``(n,)`` for a number or ``(n, h, w)`` for a raster.  A raster that is missing, below ``LEAST_SIDE`` pixels on a
    side, or not ``h * w`` long (an unreadable file, a broken row) gives nulls in all of them.
    """
    added = StructType.fromDDL(outputs)
    kept = [f for f in df.schema.fields if keep_arrays or f.name not in arrays]
    schema = StructType([f for f in kept if f.name not in added.names] + added.fields)
    arrow = to_arrow_schema(schema)
    names = [f.name for f in kept if f.name not in added.names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, w = (pc.fill_null(batch.column(c), -1).to_numpy(zero_copy_only=False) for c in ("h", "w"))
            results = {f.name: [None] * batch.num_rows for f in added.fields}
            whole = _whole(batch, arrays)
            for size in sorted({(int(a), int(b)) for a, b in zip(h[whole], w[whole])}):
                same = np.flatnonzero(whole & (h == size[0]) & (w == size[1]))
                step = max(1, STACK_PIXELS // max(1, size[0] * size[1]))
                for rows in (same[i:i + step] for i in range(0, len(same), step)):
                    picked = batch.take(pa.array(rows))
                    stacks = [picked.column(a).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                              .reshape(len(rows), *size) for a in arrays]
                    for name, values in kernel(*stacks).items():
                        found = values.reshape(len(rows), -1) if values.ndim == 3 else values.tolist()
                        for row, value in zip(rows, found):
                            results[name][row] = value
            yield pa.RecordBatch.from_arrays(
                [batch.column(n) for n in names] +
                [pa.array(results[f.name], arrow.field(f.name).type) for f in added.fields], schema=arrow)
    return df.mapInArrow(run, schema)


def _whole(batch: pa.RecordBatch, arrays: Sequence[str]) -> np.ndarray:
    """Rows whose rasters can be worked on."""
    h, w = (pc.fill_null(batch.column(c), -1).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("h", "w"))
    ok = (h >= LEAST_SIDE) & (w >= LEAST_SIDE)
    for name in arrays:
        column = batch.column(name)
        length = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
        ok &= length == h * w
        if column.flatten().null_count:
            ok &= np.array([x.is_valid and x.values.null_count == 0 for x in column], bool)
    return ok


def _pad(a: np.ndarray, r: int, border: str) -> np.ndarray:
    """Border pixels: ``mirror`` repeats no edge pixel, ``reflect`` repeats it."""
    return np.pad(a, ((0, 0), (r, r), (r, r)), mode={"mirror": "reflect", "reflect": "symmetric"}[border])


def laplacian(a: np.ndarray) -> np.ndarray:
    p = _pad(a, 1, "mirror")
    return p[:, :-2, 1:-1] + p[:, 2:, 1:-1] + p[:, 1:-1, :-2] + p[:, 1:-1, 2:] - 4 * a


def sobel(a: np.ndarray) -> np.ndarray:
    """Gradient magnitude."""
    p = _pad(a, 1, "mirror")
    across = p[:, :, 2:] - p[:, :, :-2]
    down = p[:, 2:, :] - p[:, :-2, :]
    gx = across[:, :-2] + 2 * across[:, 1:-1] + across[:, 2:]
    gy = down[:, :, :-2] + 2 * down[:, :, 1:-1] + down[:, :, 2:]
    return np.sqrt(gx * gx + gy * gy)


def separable(a: np.ndarray, weights: Sequence[float], border: str) -> np.ndarray:
    """One kernel along rows, then along columns."""
    r = len(weights) // 2
    p = _pad(a, r, border)
    h, w = a.shape[1:]
    rows = sum(wt * p[:, :, i:i + w] for i, wt in enumerate(weights))
    return sum(wt * rows[:, i:i + h, :] for i, wt in enumerate(weights))


def box(a: np.ndarray, size: int, border: str = "mirror") -> np.ndarray:
    return separable(a, [1.0 / size] * size, border)


def gaussian(a: np.ndarray, sigma: float = 1.0) -> np.ndarray:
    r = int(4 * sigma + 0.5)
    weights = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    return separable(a, (weights / weights.sum()).tolist(), "reflect")


def gradient_magnitude(a: np.ndarray) -> np.ndarray:
    gy, gx = np.gradient(a, axis=(1, 2))
    return np.sqrt(gx * gx + gy * gy)


def flat(a: np.ndarray) -> np.ndarray:
    return a.reshape(len(a), -1)


def mean(a: np.ndarray) -> np.ndarray:
    return flat(a).mean(axis=1)


def std(a: np.ndarray) -> np.ndarray:
    return flat(a).std(axis=1)


def spread(a: np.ndarray) -> np.ndarray:
    return flat(a).max(axis=1) - flat(a).min(axis=1)


def correlation(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Pearson correlation per raster, NaN when one is constant."""
    x, y = flat(a), flat(b)
    x, y = x - x.mean(axis=1, keepdims=True), y - y.mean(axis=1, keepdims=True)
    with np.errstate(invalid="ignore", divide="ignore"):
        return (x * y).sum(axis=1) / np.sqrt((x * x).sum(axis=1) * (y * y).sum(axis=1))


def counts(values: np.ndarray, bins: int) -> np.ndarray:
    """Histogram per raster of whole numbers below ``bins``."""
    numbers = flat(values).astype(np.int64)
    n = len(numbers)
    return np.bincount((numbers + bins * np.arange(n)[:, None]).ravel(), minlength=n * bins).reshape(n, bins)


def share_above(a: np.ndarray, percentile: float) -> np.ndarray:
    """Share of pixels above their own raster's percentile."""
    x = flat(a)
    return (x > np.percentile(x, percentile, axis=1)[:, None]).mean(axis=1)
