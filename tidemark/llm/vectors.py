"""Exact top-k by inner product with a pivot-distance index.

Vectors become integers and get one more coordinate that brings all to the same length; then the larger the inner
product with a query, the smaller the Euclidean distance to it, and the triangle inequality holds. Every vector is keyed
by its nearest pivot and its distance to it; distances are cut into annuli, so a key is a cell (pivot, annulus). A
query first searches the annulus nearest to it, which gives a score that its best ``k`` reach at least. Then the
annuli are taken in order of the least distance they allow, |d(query, pivot) - d(vector, pivot)|, and the
search stops at the first that cannot reach that score. What it scans, it scans exactly: ties count, nothing is approximate.

Cells are split into blocks of about ``BLOCK`` vectors by a hash, and queries into blocks of their home cell, so neither a
hot cell nor a vector with many copies lands in one task; a pair of blocks is one matrix product. Pivots come
from a bounded sample of ``SAMPLE`` vectors. The table of cells (at most ``PIVOTS * ANNULI`` rows) is sent to the tasks.

Defined cases: vectors that are null or hold null or non-finite components take no part; shorter vectors count as
filled up with zeros; repeated ids are different rows, each a query and a candidate of its own; a null id is a
candidate, placed behind equal scores, and no query; with ``k`` candidates or fewer all are returned.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.registry import query
from tidemark.sources.tables import pin, table

SCALE = 64
TOP = 20
EVERY = 20
PIVOTS, ANNULI = 16, 16
SAMPLE = 4_000
BLOCK, QUERIES = 4_096, 1_024


@dataclass(frozen=True)
class Index:
    """Pivots in the lengthened space, and for each cell its least and largest distance."""

    dim: int
    wide: bool            # whether components need 64 bits
    radius2: float        # largest squared length
    pivots: np.ndarray
    cells: np.ndarray     # cell numbers
    low: np.ndarray
    high: np.ndarray

    @property
    def kind(self):
        return np.int64 if self.wide else np.int32

    def matrix(self, packed: pa.Array) -> np.ndarray:
        """Packed vectors as rows, filled up with zeros."""
        rows = packed.to_pylist()
        width = self.dim * np.dtype(self.kind).itemsize
        return np.frombuffer(b"".join(r.ljust(width, b"\0") for r in rows), self.kind).reshape(len(rows), self.dim)

    def lengthened(self, m: np.ndarray) -> np.ndarray:
        m = m.astype(np.float64)
        return np.c_[m, np.sqrt(np.maximum(self.radius2 - (m * m).sum(axis=1), 0))]

    def distances(self, points: np.ndarray) -> np.ndarray:
        """(points, pivots) Euclidean distances."""
        d2 = (points ** 2).sum(axis=1)[:, None] + (self.pivots ** 2).sum(axis=1) - 2 * points @ self.pivots.T
        return np.sqrt(np.maximum(d2, 0))

    def least_distance(self, queries: np.ndarray) -> np.ndarray:
        """(queries, cells): no vector of the cell is nearer than this, by the triangle inequality."""
        points = np.c_[queries.astype(np.float64), np.zeros(len(queries))]
        d = self.distances(points)[:, self.cells // ANNULI]
        return np.maximum(np.maximum(d - self.high, self.low - d), 0)

    def most_score(self, queries: np.ndarray) -> np.ndarray:
        """(queries, cells): no vector of the cell scores more than this; rounding is on the safe side."""
        q2 = (queries.astype(np.float64) ** 2).sum(axis=1)[:, None]
        bound = (q2 + self.radius2 - self.least_distance(queries) ** 2) / 2
        return bound + 1e-6 * (q2 + self.radius2) + 1


def _integers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(uid, vec_id, embedding) rows to (uid, vec_id, values), without the vectors that take no part."""
    for batch in batches:
        uid, ids, values = [], [], []
        for u, i, v in zip(batch.column("uid").to_pylist(), batch.column("vec_id").to_pylist(), batch.column("embedding")):
            if not v.is_valid or v.values.null_count:
                continue
            x = np.floor(SCALE * np.asarray(v.values).astype(np.float64))
            if np.isfinite(x).all():
                uid.append(u)
                ids.append(i)
                values.append(x.astype(np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(uid, pa.int64()), pa.array(ids, pa.int64()), pa.array(values, pa.list_(pa.int64()))],
                                         names=["uid", "vec_id", "values"])


def _far_apart(points: np.ndarray, n: int) -> np.ndarray:
    """Start from the point nearest the mean, then always take the farthest; a few rounds of means spread them."""
    chosen = [int(((points - points.mean(axis=0)) ** 2).sum(axis=1).argmin())]
    nearest = ((points - points[chosen[0]]) ** 2).sum(axis=1)
    while len(chosen) < min(n, len(points)) and nearest.max() > 0:
        chosen.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, ((points - points[chosen[-1]]) ** 2).sum(axis=1))
    pivots = points[chosen].copy()
    for _ in range(5):
        d = (points ** 2).sum(axis=1)[:, None] + (pivots ** 2).sum(axis=1) - 2 * points @ pivots.T
        of = d.argmin(axis=1)
        for k in range(len(pivots)):
            if (of == k).any():
                pivots[k] = points[of == k].mean(axis=0)
    return pivots


def _pack(rows: DataFrame, wide: bool) -> DataFrame:
    kind = np.int64 if wide else np.int32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _integers(batches):
            packed = [np.array(v, kind).tobytes() for v in batch.column("values").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("uid"), batch.column("vec_id"), pa.array(packed, pa.binary())],
                                             names=["uid", "vec_id", "packed"])

    return rows.mapInArrow(run, "uid bigint, vec_id bigint, packed binary")


def build(embeddings: DataFrame) -> tuple[Index, DataFrame] | None:
    """The index, and all vectors (uid, vec_id, packed, cell, far) with their cell; nothing if no vector takes part."""
    rows = embeddings.select(F.monotonically_increasing_id().alias("uid"), F.col("vec_id").cast("bigint").alias("vec_id"), "embedding")

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _integers(batches):
            vs = [np.array(v, np.float64) for v in batch.column("values").to_pylist()]
            out = [(len(v), float(np.abs(v).max(initial=0)), float(v @ v)) for v in vs] or [(0, 0.0, 0.0)][:0]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int64(), pa.float64(), pa.float64()))],
                                             names=["dim", "most", "length2"])

    dim, most, radius2 = rows.mapInArrow(sizes, "dim bigint, most double, length2 double").agg(F.max("dim"), F.max("most"), F.max("length2")).first()
    if dim is None:
        return None
    wide = most >= 2 ** 31
    packed = _pack(rows, wide)
    sample = packed.orderBy(F.xxhash64("uid"), "uid").limit(SAMPLE).select("packed").toArrow().column(0).combine_chunks()
    index = Index(dim, wide, radius2, np.zeros((0, dim + 1)), np.zeros(0, np.int64), np.zeros(0), np.zeros(0))
    index = Index(dim, wide, radius2, _far_apart(index.lengthened(index.matrix(sample)), PIVOTS), index.cells, index.low, index.high)
    sent = embeddings.sparkSession.sparkContext.broadcast(index)
    width = 2 * np.sqrt(max(radius2, 1)) / ANNULI * (1 + 1e-9)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        i = sent.value
        for batch in batches:
            d = i.distances(i.lengthened(i.matrix(batch.column("packed"))))
            pivot = d.argmin(axis=1) if batch.num_rows else np.zeros(0, np.int64)
            far = d[np.arange(len(d)), pivot]
            cell = pivot * ANNULI + np.minimum(far / width, ANNULI - 1).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(far)], names=[*batch.schema.names, "cell", "far"])

    placed = pin(packed.mapInArrow(place, "uid bigint, vec_id bigint, packed binary, cell bigint, far double"))
    cells = placed.groupBy("cell").agg(F.min("far"), F.max("far")).orderBy("cell").collect()
    slack = 1e-6 * np.sqrt(max(radius2, 1))
    return Index(dim, wide, radius2, index.pivots, np.array([c[0] for c in cells]),
                 np.array([c[1] for c in cells]) - slack, np.array([c[2] for c in cells]) + slack), placed


def _blocks(rows: DataFrame, key: str, size: int) -> DataFrame:
    """(key, block, members): the rows of each key in blocks of about ``size``, dealt by a hash."""
    many = rows.groupBy(key).agg(F.ceil(F.count("*") / size).alias("blocks"))  # a row per cell: few
    dealt = rows.join(F.broadcast(many), key).withColumn("block", F.pmod(F.xxhash64("uid"), F.col("blocks")))
    return dealt.groupBy(key, "block").agg(F.collect_list(F.struct("uid", "vec_id", "packed")).alias("members"))


def _scores(index: Index, queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Inner products, exact: as doubles where they fit 53 bits, else as integers."""
    if index.radius2 < 2 ** 52:
        return (queries.astype(np.float64) @ vectors.T.astype(np.float64)).astype(np.int64)
    return queries.astype(np.int64) @ vectors.T.astype(np.int64)


def _members(batch: pa.RecordBatch, name: str, row: int, index: Index) -> tuple[np.ndarray, list, np.ndarray]:
    inner = batch.column(name)[row].values
    if inner is None:
        return np.zeros(0, np.int64), [], np.zeros((0, index.dim), index.kind)
    return np.asarray(inner.field("uid")), inner.field("vec_id").to_pylist(), index.matrix(inner.field("packed"))


def nearest(embeddings: DataFrame, k: int = TOP, every: int = EVERY) -> DataFrame:
    """(query_uid, query_id, rank, vec_id, score): the ``k`` best rows for each row whose id is divisible by ``every``."""
    schema = "query_uid bigint, query_id bigint, rank int, vec_id bigint, score bigint"
    built = build(embeddings)
    if built is None:
        return embeddings.sparkSession.createDataFrame([], schema)
    index, placed = built
    sent = embeddings.sparkSession.sparkContext.broadcast(index)

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        i = sent.value
        for batch in batches:
            cell = i.cells[i.least_distance(i.matrix(batch.column("packed"))).argmin(axis=1)] if batch.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int64())], names=[*batch.schema.names, "home"])

    asked = placed.filter(F.col("vec_id") % every == 0).select("uid", "vec_id", "packed")
    asked = pin(asked.mapInArrow(home, "uid bigint, vec_id bigint, packed binary, home bigint"))
    member = "array<struct<uid:bigint,vec_id:bigint,packed:binary>>"
    queries = _blocks(asked, "home", QUERIES).withColumnsRenamed({"members": "asked", "block": "asked_block"})
    vectors = pin(_blocks(placed, "cell", BLOCK))

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Scores that the best ``k`` reach at least, from the home annulus; and the annuli that may hold better ones."""
        i = sent.value
        for batch in batches:
            floors, reach = [], []
            for row in range(batch.num_rows):
                uid, _, q = _members(batch, "asked", row, i)
                theirs, _, v = _members(batch, "members", row, i)
                s = _scores(i, q, v)
                s[uid[:, None] == theirs[None, :]] = np.iinfo(np.int64).min
                floor = np.sort(s, axis=1)[:, -k] if s.shape[1] >= k else np.full(len(q), np.iinfo(np.int64).min)
                floors.append(floor)
                reach.append(i.cells[(i.most_score(q) >= floor[:, None].astype(np.float64)).any(axis=0)])
            yield pa.RecordBatch.from_arrays([batch.column("asked"), pa.array(floors, pa.list_(pa.int64())), pa.array(reach, pa.list_(pa.int64()))],
                                             names=["asked", "floors", "reach"])

    started = queries.join(vectors.filter("block = 0").withColumnRenamed("cell", "home"), "home", "left").select("asked", "members")
    expanded = started.mapInArrow(expand, f"asked {member}, floors array<bigint>, reach array<bigint>")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        i = sent.value
        for batch in batches:
            for row in range(batch.num_rows):
                uid, ids, q = _members(batch, "asked", row, i)
                theirs, their_ids, v = _members(batch, "members", row, i)
                floor = np.asarray(batch.column("floors")[row].values)
                s = _scores(i, q, v)
                good = (s >= floor[:, None]) & (uid[:, None] != theirs[None, :])
                order = np.array([np.iinfo(np.int64).max if x is None else x for x in their_ids])
                a, b = np.nonzero(good)
                best = np.lexsort((order[b], -s[a, b], a))
                a, b = a[best], b[best]
                place = np.arange(len(a)) - np.searchsorted(a, a)
                a, b = a[place < k], b[place < k]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(uid[a]), pa.array([ids[x] for x in a.tolist()], pa.int64()),
                     pa.array([their_ids[x] for x in b.tolist()], pa.int64()), pa.array(s[a, b])],
                    names=["query_uid", "query_id", "vec_id", "score"])

    pairs = expanded.select("asked", "floors", F.explode("reach").alias("cell")).join(vectors, "cell").select("asked", "floors", "members")
    found = pairs.mapInArrow(scan, "query_uid bigint, query_id bigint, vec_id bigint, score bigint")
    rank = F.row_number().over(Window.partitionBy("query_uid").orderBy(F.desc("score"), F.asc_nulls_last("vec_id")))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_uid", "query_id", "rank", "vec_id", "score")


_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND NOT list_contains(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x)), true)),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20
"""


@query("op6_vectors", _SQL)
def vectors(spark: SparkSession, directory: str) -> DataFrame:
    """The 20 best rows by inner product for every twentieth vector."""
    return nearest(table(spark, directory, "embeddings")).select("query_id", "rank", "vec_id", "score")
