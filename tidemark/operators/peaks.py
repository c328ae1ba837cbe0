"""Wave peaks in two dimensions: bright structures of a depth map as connected regions with area and centre.

The smoothed map is cut to whole levels, a morphological opening takes away what is narrower than an elliptic element, and what
the opening took away (the top-hat) falls into regions of touching pixels, corners included. All maps of a batch are worked on at
once: regions are runs of pixels joined by union-find on arrays, with no loop over pixels.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame

from tidemark.operators import kernels as kn

# Side of the elliptic element, and the area a region has to exceed.
ELEMENT, LEAST_AREA = 15, 50


def ellipse(size: int) -> list[int]:
    """Half width of each row of an elliptic element of odd side ``size``."""
    r = size // 2
    return [math.floor(math.sqrt(r * r - dy * dy) + 0.5) for dy in range(-r, r + 1)]


def erode(a: np.ndarray, size: int) -> np.ndarray:
    """Smallest value under the element; outside the map there is nothing."""
    r, (h, w) = size // 2, a.shape[1:]
    p = np.pad(a, ((0, 0), (r, r), (r, r)), constant_values=np.inf)
    wide = {0: p[:, :, r:r + w].copy()}
    for dx in range(1, r + 1):
        wide[dx] = np.minimum(wide[dx - 1], np.minimum(p[:, :, r - dx:r - dx + w], p[:, :, r + dx:r + dx + w]))
    out = wide[r][:, r:r + h].copy()
    for i, half in enumerate(ellipse(size)):
        np.minimum(out, wide[half][:, i:i + h], out=out)
    return out


def top_hat(a: np.ndarray, size: int = ELEMENT) -> np.ndarray:
    """What an opening by the element takes away."""
    return a + erode(-erode(a, size), size)


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest member of each of ``n`` nodes' set, after joining ``a[i]`` with ``b[i]``."""
    parent = np.arange(n)
    while True:
        x, y = parent[a], parent[b]
        apart = x != y
        if not apart.any():
            return parent
        np.minimum.at(parent, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while (parent[parent] != parent).any():
            parent = parent[parent]


def regions(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(raster, area, y, x) of every region of touching true pixels of ``(n, h, w)``, by raster and first pixel."""
    n, h, w = mask.shape
    edge = np.diff(np.pad(mask, ((0, 0), (0, 0), (1, 1))).astype(np.int8).reshape(n * h, w + 2), axis=1)
    row, start = np.nonzero(edge == 1)
    end = np.nonzero(edge == -1)[1]
    if not len(row):
        none = np.zeros(0)
        return none.astype(np.int64), none.astype(np.int64), none, none
    # runs of a row touch those of the row above that start no later than one behind their end and end no earlier than their start
    span, above = w + 2, np.where(row % h > 0, row - 1, -2)
    first = np.searchsorted(row * span + end, above * span + start)
    last = np.searchsorted(row * span + start, above * span + end, side="right")
    touching = np.maximum(last - first, 0)
    lower = np.repeat(np.arange(len(row)), touching)
    upper = np.arange(touching.sum()) - np.repeat(touching.cumsum() - touching, touching) + np.repeat(first, touching)
    first_run, of = np.unique(_roots(len(row), lower, upper), return_inverse=True)
    length = end - start
    area = np.bincount(of, length)
    y = np.bincount(of, length * (row % h)) / area
    x = np.bincount(of, length * (start + end - 1) / 2) / area
    return row[first_run] // h, area.astype(np.int64), y, x


def wave_peaks(df: DataFrame, *, element: int = ELEMENT, least_area: int = LEAST_AREA, above: float = 0.0) -> DataFrame:
    """``peaks`` (centre x and y, area in pixels) and ``peak_count`` of each depth map in [0, 1]; unreadable maps have nulls.

    A region counts when more than ``least_area`` pixels of the top-hat of the smoothed map lie over ``above`` levels. Peaks come
    in the order of their first pixel.
    """
    def kernel(a: np.ndarray) -> dict[str, np.ndarray]:
        levels = np.floor(np.clip(kn.gaussian(a), 0.0, 1.0) * 255)
        of, area, y, x = regions(top_hat(levels, element) > above)
        kept = area > least_area
        found = np.empty(len(a), object)
        found[:] = [[] for _ in range(len(a))]
        for i, n, cy, cx in zip(*(v[kept].tolist() for v in (of, area, y, x))):
            found[i].append({"x": cx, "y": cy, "area": n})
        return {"peaks": found, "peak_count": np.bincount(of[kept], minlength=len(a))}
    return kn.apply_kernel(df, kernel, "peaks array<struct<x: double, y: double, area: bigint>>, peak_count bigint")
