"""Isolation forests: rows that random cuts set apart early are anomalies.

A forest is fitted on a bounded sample (``TREES`` trees of ``SAMPLE`` rows each, drawn by a hash of the row and so the same for any
partitioning) and kept as flat arrays, one entry a node. Every row is scored in Arrow batches: trees are filled up to one depth, so that
the children of a node follow from its place and all rows go down a tree in step, or, in trees of usual depth, over four levels at a time by
tables of the cells between their cuts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tidemark.operators.ranking import exact_percentiles
from tidemark.sources.tables import pin

TREES, SAMPLE = 100, 256
SEED = 42
#: Rows that go down a tree at once.
_ROWS = 16_384
#: Levels of a tree that one table spans, and the most cells of all tables of a forest.
_SPAN, _CELLS = 4, 1 << 22
_NEVER = np.iinfo(np.int32).max


def unsuccessful(n: float) -> float:
    """Mean path length of a search that fails in a binary tree of n rows, by which paths are scaled."""
    return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (math.log(n - 1) + np.euler_gamma) - 2 * (n - 1) / n


@dataclass(frozen=True)
class Forest:
    """Nodes of all trees: feature (-1 in a leaf), cut, place of the left child (the right one follows), and path length of a leaf."""

    roots: np.ndarray
    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    length: np.ndarray
    sample: int

    @cached_property
    def filled(self) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
        """Sorted cuts of each feature; features and numbers of cuts (trees, places) of all trees at one depth, and path lengths at its bottom.

        Place k has its children at 2 k and 2 k + 1, from 1 on. Below a leaf stand cuts that no value is above, so its rows keep left.
        """
        inner = self.feature >= 0
        cuts = [np.unique(self.cut[self.feature == f]) for f in range(self.feature.max(initial=-1) + 1)]
        number = np.full(len(self.feature), np.iinfo(np.int64).max >> 1)
        for f, known in enumerate(cuts):
            number[self.feature == f] = np.searchsorted(known, self.cut[self.feature == f])
        node = self.roots[:, None]
        features, numbers = [np.zeros_like(node)], [np.zeros_like(node)]
        while inner[node].any():
            features.append(np.maximum(self.feature[node], 0))
            numbers.append(number[node])
            left = np.where(inner[node], self.left[node], node)
            node = np.stack([left, left + inner[node]], axis=2).reshape(len(node), -1)
        return cuts, np.concatenate(features, axis=1), np.concatenate(numbers, axis=1), self.length[node]

    @cached_property
    def tables(self) -> list[tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray, np.ndarray]] | None:
        """For each tree: what to look up for the upper and the lower half of its levels; None if it has too many levels or cells.

        The first tables lead from the number of a feature's cuts below a value to that of the tree's own cuts, ``near`` from there to a
        share of the cell, ``jump`` from the cell to the subtree's part of ``far``, which gives shares of the cell in it, and lengths follow.
        """
        cuts, *trees = self.filled
        depth = trees[2].shape[1].bit_length() - 1
        upper = min(_SPAN, depth)
        if not cuts or depth > 2 * _SPAN:
            return None
        out, cells = [], 0
        for feature, number, length in zip(*trees):
            own = [np.unique(number[1:][(feature[1:] == f) & (number[1:] < _NEVER)]) for f in range(len(cuts))]
            starts = np.cumsum([0, *(len(k) + 1 for k in own)])
            ranks = [start + np.searchsorted(k, np.arange(len(c) + 1)) for start, k, c in zip(starts, own, cuts)]
            blocks = [_block(feature, number, own, 1, upper)]
            blocks += [_block(feature, number, own, place, depth - upper) for place in range(1 << upper, 2 << upper)]
            cells += sum(len(at) for _, at in blocks)
            if cells > _CELLS:
                return None
            (near, at), rest = blocks[0], blocks[1:]
            before = np.cumsum([0, *(len(at) for _, at in rest)])
            far = np.stack([steps for steps, _ in rest])
            far[:, :starts[1]] += before[:-1, None]
            out.append((ranks, near, (at - (1 << upper)) * far.shape[1], far.ravel(), length[np.concatenate([at for _, at in rest]) - len(length)]))
        return out

    def depths(self, rows: np.ndarray) -> np.ndarray:
        """Mean path length of each row over the trees."""
        n, cuts = len(rows), self.filled[0]
        # cuts below each value; a value that is no number is above none
        below = [np.where(np.isnan(v), 0, np.searchsorted(c, v)) for c, v in zip(cuts, rows.T)] or [np.zeros(n, np.int64)]
        return (self._walked(np.concatenate(below), n) if self.tables is None else self._looked_up(below, n)) / len(self.roots)

    def _looked_up(self, below: list[np.ndarray], n: int) -> np.ndarray:
        total, length = np.zeros(n), np.empty(n)
        own, (at, cell, share) = np.empty((len(below), n), np.int64), np.empty((3, n), np.int64)
        for ranks, near, jump, far, lengths in self.tables:
            for k, (rank, number) in enumerate(zip(ranks, below)):
                rank.take(number, out=own[k], mode="clip")
            near.take(own[0], out=cell, mode="clip")
            for mine in own[1:]:
                np.add(cell, near.take(mine, out=share, mode="clip"), out=cell)
            jump.take(cell, out=at, mode="clip")
            far.take(np.add(at, own[0], out=share), out=cell, mode="clip")
            for mine in own[1:]:
                np.add(mine, at, out=mine)
                np.add(cell, far.take(mine, out=share, mode="clip"), out=cell)
            total += lengths.take(cell, out=length, mode="clip")
        return total

    def _walked(self, values: np.ndarray, n: int) -> np.ndarray:
        trees, total = self.filled[1:], np.zeros(n)
        each, place, cell, value, cut = np.arange(n), *np.empty((4, n), np.int64)
        length = np.empty(n)
        for features, numbers, lengths in zip(*trees):
            first = features * n  # where the values of each place's feature begin
            place[:] = 1
            for _ in range(len(lengths).bit_length() - 1):
                first.take(place, out=cell, mode="clip")
                np.add(cell, each, out=cell)
                values.take(cell, out=value, mode="clip")
                numbers.take(place, out=cut, mode="clip")
                np.subtract(cut, value, out=cut)
                np.right_shift(cut, 63, out=cut)  # -1 where the value is above the cut
                np.add(place, place, out=place)
                np.subtract(place, cut, out=place)
            np.subtract(place, len(lengths), out=place)
            lengths.take(place, out=length, mode="clip")
            total += length
        return total

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """Anomaly score in 0 to 1; about 0.5 where nothing stands out."""
        parts = [self.depths(rows[i:i + _ROWS]) for i in range(0, len(rows), _ROWS)]
        scale = unsuccessful(self.sample) or 1.0
        return 2.0 ** (-np.concatenate(parts) / scale) if parts else np.zeros(0)


def _block(feature: np.ndarray, number: np.ndarray, own: list[np.ndarray], root: int, levels: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``levels`` below a place of a filled tree: the share of a cell's number for each of the tree's ``own`` cuts below a value,
    one feature after the other, and the place that each cell leads to."""
    places = np.concatenate([np.zeros(0, np.int64), *[(root << k) + np.arange(1 << k) for k in range(levels)]])
    places = places[number[places] < _NEVER]
    mine = [np.unique(number[places[feature[places] == f]]) for f in range(len(own))]
    shape = [len(cuts) + 1 for cuts in mine]
    digits = np.indices(shape).reshape(len(own), -1)
    turn = np.full(len(number), _NEVER)
    for f, cuts in enumerate(mine):
        turn[places[feature[places] == f]] = np.searchsorted(cuts, number[places[feature[places] == f]])
    at, each = np.full(digits.shape[1], root), np.arange(digits.shape[1])
    for _ in range(levels):
        at = 2 * at + (digits[feature[at], each] > turn[at])
    strides = [math.prod(shape[f + 1:]) for f in range(len(own))]
    shares = [np.r_[0, np.searchsorted(cuts, every, "right")] * stride for cuts, every, stride in zip(mine, own, strides)]
    return np.concatenate(shares), at


def grow(rows: np.ndarray, trees: int = TREES, sample: int = SAMPLE, seed: int = SEED) -> Forest:
    """A forest of ``rows``, given in a random order; each tree gets its own ``sample`` of them, as far as they last."""
    draw = np.random.default_rng(seed)
    size = min(sample, len(rows))
    deepest = math.ceil(math.log2(max(size, 2)))
    feature: list[int] = []
    cut: list[float] = []
    left: list[int] = []
    length: list[float] = []

    def new() -> int:
        feature.append(-1)
        cut.append(0.0)
        left.append(0)
        length.append(0.0)
        return len(feature) - 1

    roots = []
    for k in range(trees):
        start = k * size % max(len(rows) - size + 1, 1)
        roots.append(new())
        open_ = [(roots[-1], rows[start:start + size], 0)]
        while open_:
            node, mine, depth = open_.pop()
            low, high = (mine.min(axis=0), mine.max(axis=0)) if len(mine) else (np.zeros(0), np.zeros(0))
            varied = np.flatnonzero(high > low)
            if depth >= deepest or len(mine) < 2 or not len(varied):
                length[node] = depth + unsuccessful(len(mine))
                continue
            f = int(draw.choice(varied))
            at = float(draw.uniform(low[f], high[f]))
            feature[node], cut[node] = f, at
            left[node] = new()
            new()
            goes = mine[:, f] > at
            open_ += [(left[node], mine[~goes], depth + 1), (left[node] + 1, mine[goes], depth + 1)]
    return Forest(np.array(roots), np.array(feature), np.array(cut), np.array(left), np.array(length), size)


def drawn(df: DataFrame, columns: Sequence[str], most: int, seed: int = SEED) -> np.ndarray:
    """About ``most`` rows of numeric ``columns`` by a hash of the whole row, in the order of the hash.

    Hashes spread evenly, so a bound on them keeps the wanted share without sorting the rest; rows that are equal in every
    column are drawn or left together, and no more than twice ``most`` are ever taken.
    """
    whole = [f.name for f in df.schema.fields if "map<" not in f.dataType.simpleString()]
    share = min(1.0, most / max(df.count(), 1))
    order = F.xxhash64(F.lit(seed), *whole)
    taken = df.withColumn("_order", order).filter(F.pmod("_order", F.lit(1 << 40)) < int(share * (1 << 40)))
    found = taken.orderBy("_order").limit(2 * most).select(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in columns]).toPandas()
    return found.to_numpy(float).reshape(-1, len(columns))


def with_scores(df: DataFrame, groups: dict[str, Sequence[str]], trees: int = TREES, sample: int = SAMPLE, seed: int = SEED,
                keep: Sequence[str] | None = None) -> DataFrame:
    """``df`` with ``<group>_score`` for each group of columns, each by a forest of its own; nulls count as 0.

    Only the columns ``keep`` of ``df`` pass through Python, if they are named.
    """
    columns = list(dict.fromkeys(c for group in groups.values() for c in group))
    rows = drawn(df, columns, trees * sample, seed)
    places = {name: [columns.index(c) for c in group] for name, group in groups.items()}
    forests = {name: grow(rows[:, at], trees, sample, seed) for name, at in places.items()}
    sent = df.sparkSession.sparkContext.broadcast(forests)
    kept = df if keep is None else df.select(*keep)
    schema = StructType([*kept.schema.fields, *[StructField(f"{name}_score", DoubleType()) for name in groups]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.num_columns - len(columns)
            values = np.column_stack([batch.column(own + k).to_numpy(zero_copy_only=False) for k in range(len(columns))])
            scores = [pa.array(sent.value[name].scores(values[:, at])) for name, at in places.items()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:own], *scores], schema.names)

    inputs = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"_in{k}") for k, c in enumerate(columns)]
    return df.select(*kept.columns, *inputs).mapInArrow(run, schema)


def anomalies(df: DataFrame, groups: dict[str, Sequence[str]], contamination: float = 0.1, rules: dict[str, Column] | None = None,
              trees: int = TREES, sample: int = SAMPLE, keep: Sequence[str] | None = None) -> DataFrame:
    """``df``, or its columns ``keep``, with ``<group>_anomaly`` (how far a row's score is above the share ``contamination`` of all rows, else 0), their mean
    ``overall_anomaly``, and ``is_anomalous`` above 0.5.

    ``rules`` may name further scores that lift the mean, as ``predictions.anomaly_rules`` gives them.
    """
    scored = pin(with_scores(df, groups, trees, sample, keep=keep))
    long = scored.select(F.inline(F.array(*[F.struct(F.lit(g).alias("name"), F.col(f"{g}_score").alias("score")) for g in groups])))
    cuts = {r["name"]: r["cut"] for r in exact_percentiles(long, ["name"], "score", {"cut": 1 - contamination}, bounded_keys=True).collect()}
    each = {f"{g}_anomaly": F.greatest(F.lit(0.0), F.col(f"{g}_score") - cuts.get(g, 0.0)) for g in groups}
    mean = sum((F.col(c) for c in list(each)[1:]), F.col(next(iter(each)))) / float(len(each))
    lifted = F.greatest(mean, *rules.values()) if rules else mean
    out = scored.withColumns(each).withColumn("overall_anomaly", lifted)
    return out.withColumn("is_anomalous", F.col("overall_anomaly") > 0.5).drop(*[f"{g}_score" for g in groups])
