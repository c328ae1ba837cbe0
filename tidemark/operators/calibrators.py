"""Fitted confidence calibrations: logistic, isotonic and temperature, for all groups of a table at once.

Fits work on sums. The logistic fit needs only the rows and hits of each distinct confidence, the isotonic fit the same
points in order, the temperature two sums over all rows for each step. What a step adds up comes to the driver as one row a
group; more than ``MOST_GROUPS`` groups raise.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import (
    DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter)
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tidemark.operators.joins import skew_join
from tidemark.operators.ranking import MOST_KEYS as MOST_GROUPS
from tidemark.operators.ranking import null_safe_join, rolling, running, with_chunks
from tidemark.sources.tables import pin

#: Rows of one task of the isotonic fit.
CHUNK_ROWS = 1 << 16
PENALTY = 1.0
_ENOUGH = 1e-10
_STEPS = 100
#: Temperatures searched.
COLDEST, HOTTEST = 1e-3, 1e3


def points(pairs: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, confidence, n, hits) of (by, confidence, correct) rows: all that a logistic or isotonic fit has to know of them."""
    known = pairs.filter(F.col("confidence").isNotNull() & F.col("correct").isNotNull())
    return known.groupBy(*by, "confidence").agg(F.count("*").alias("n"), F.sum("correct").alias("hits"))


def _groups(sums: DataFrame, by: Sequence[str]) -> dict[tuple, dict[str, float]]:
    rows = sums.limit(MOST_GROUPS + 1).collect()
    if len(rows) > MOST_GROUPS:
        raise ValueError(f"more than {MOST_GROUPS} groups")
    return {tuple(r[b] for b in by): r.asDict() for r in rows}


def _table(like: DataFrame, by: Sequence[str], values: dict[tuple, dict[str, float]], names: Sequence[str]) -> DataFrame:
    """One row a group with its current numbers."""
    schema = StructType([*like.select(*by).schema.fields, *[StructField(n, DoubleType()) for n in names]])
    return like.sparkSession.createDataFrame([(*k, *[float(v[n]) for n in names]) for k, v in values.items()], schema)


def _beside(rows: DataFrame, current: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows with the current numbers of their group; groups that are finished have none and drop out."""
    if by:
        return null_safe_join(rows, F.broadcast(current), by)
    only = current.first()
    return rows.withColumns({c: F.lit(only[c]) for c in current.columns})


def _keys(rows: DataFrame, by: Sequence[str]) -> list[tuple]:
    return list(_groups(rows.select(*by).distinct(), by)) if by else [()] * (not rows.isEmpty())


# --- logistic ---------------------------------------------------------------------------------------------
@dataclass
class _Descent:
    """Newton steps of one group, halved where the loss would grow."""

    slope: float = 0.0
    intercept: float = 0.0
    loss: float = math.inf
    step: tuple[float, float] = (0.0, 0.0)
    share: float = 1.0
    done: bool = False

    @property
    def at(self) -> dict[str, float]:
        return {"slope": self.slope + self.share * self.step[0], "intercept": self.intercept + self.share * self.step[1]}

    def take(self, sums: dict[str, float]) -> None:
        here = self.at
        if sums["loss"] > self.loss + 1e-12 * abs(self.loss) and self.share > 1e-6:
            self.share /= 2
            return
        self.slope, self.intercept, self.loss, self.share = here["slope"], here["intercept"], sums["loss"], 1.0
        cross, det = sums["h_ab"], sums["h_aa"] * sums["h_bb"] - sums["h_ab"] ** 2
        if det <= 0:
            self.step, self.done = (0.0, 0.0), True
            return
        self.step = ((cross * sums["g_b"] - sums["h_bb"] * sums["g_a"]) / det, (cross * sums["g_a"] - sums["h_aa"] * sums["g_b"]) / det)
        self.done = max(map(abs, self.step)) < _ENOUGH


def fit_logistic(pairs: DataFrame, by: Sequence[str], penalty: float = PENALTY) -> DataFrame:
    """(by, slope, intercept) of ``1 / (1 + exp(-(slope * confidence + intercept)))``, with a squared penalty on the slope.

    Newton's method: gradient and curvature of all groups are sums over the points, in one aggregate a step. A group whose
    outcomes are all equal has no finite intercept; it stops where the curvature vanishes.
    """
    counted = pin(points(pairs, by))
    state = {k: _Descent() for k in _keys(counted, by)}
    x, n = F.col("confidence"), F.col("n")
    for _ in range(_STEPS):
        if all(s.done for s in state.values()):
            break
        current = _table(counted, by, {k: s.at for k, s in state.items() if not s.done}, ["slope", "intercept"])
        z = F.col("slope") * x + F.col("intercept")
        p = 1 / (1 + F.exp(-z))
        # log(1 + e^z) without overflow
        loss = n * (F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z)))) - F.col("hits") * z
        w, r = n * p * (1 - p), n * p - F.col("hits")
        sums = _beside(counted, current, by).groupBy(*by).agg(
            F.sum(loss).alias("loss"), F.sum(r * x).alias("g_a"), F.sum(r).alias("g_b"), F.sum(w * x * x).alias("h_aa"),
            F.sum(w * x).alias("h_ab"), F.sum(w).alias("h_bb"))
        for key, found in _groups(sums, by).items():
            slope = state[key].at["slope"]
            found["loss"] += penalty / 2 * slope ** 2
            found["g_a"] += penalty * slope
            found["h_aa"] += penalty
            state[key].take(found)
    return _table(counted, by, {k: {"slope": s.slope, "intercept": s.intercept} for k, s in state.items()}, ["slope", "intercept"])


def logistic(confidence: Column, slope: Column, intercept: Column) -> Column:
    return 1 / (1 + F.exp(-(slope * confidence + intercept)))


# --- isotonic ---------------------------------------------------------------------------------------------
def _pool(table: pa.Table) -> pa.Table:
    """Pool adjacent blocks of one chunk until their values rise."""
    table = table.sort_by("lower")
    lower, upper, total, weight = (table.column(c).to_numpy() for c in ("lower", "upper", "total", "weight"))
    first: list[int] = []
    last: list[int] = []
    sums: list[float] = []
    weights: list[float] = []
    for i, (t, w) in enumerate(zip(total.tolist(), weight.tolist())):
        start = i
        while sums and sums[-1] * w >= t * weights[-1]:
            t, w = t + sums.pop(), w + weights.pop()
            start = first.pop()
            last.pop()
        first.append(start)
        last.append(i)
        sums.append(t)
        weights.append(w)
    keep = table.take(pa.array(first, pa.int64()))
    values = {"lower": pa.array(lower[first]), "upper": pa.array(upper[last]), "total": pa.array(np.array(sums, float)), "weight": pa.array(np.array(weights, float))}
    for name, column in values.items():
        keep = keep.set_column(keep.schema.get_field_index(name), name, column)
    return keep


def fit_isotonic(pairs: DataFrame, by: Sequence[str], chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """(by, lower, upper, value, weight): blocks of the rising step function nearest to the outcomes.

    Points stand in order and are cut into chunks of ``chunk_rows``; each chunk pools its adjacent violators. Pooling can be done
    in any order, so what is left are violations between chunks: the blocks are cut again, half a chunk further, until none
    is left. Only blocks are moved after the first round, and no task holds more than a chunk.
    """
    blocks = points(pairs, by).select(
        *by, F.col("confidence").cast("double").alias("lower"), F.col("confidence").cast("double").alias("upper"),
        F.col("hits").cast("double").alias("total"), F.col("n").cast("double").alias("weight"))
    schema = StructType([*blocks.schema.fields, StructField("chunk", blocks.select(F.lit(0).cast("bigint").alias("c")).schema[0].dataType)])
    half = 0
    while True:
        placed = running(blocks.withColumn("one", F.lit(1)), by, ["lower"], sums={"place": "one"}, totals=False)
        cut = placed.withColumn("chunk", F.floor((F.col("place") - 1 + half) / chunk_rows).cast("bigint")).select(*schema.names)
        pooled = pin(cut.groupBy(*by, "chunk").applyInArrow(_pool, schema).drop("chunk"))
        value = F.col("total") / F.col("weight")
        beside = rolling(with_chunks(pooled.withColumn("value", value), by, "lower"), by, ["lower"], 1, {"before": lambda w: F.lag("value").over(w)})
        if beside.filter(F.col("before") >= F.col("value")).isEmpty():
            return pooled.select(*by, "lower", "upper", value.alias("value"), "weight")
        blocks, half = pooled, chunk_rows // 2 - half


def isotonic(values: DataFrame, blocks: DataFrame, by: Sequence[str]) -> DataFrame:
    """``values`` (by, confidence) with ``calibrated``: a block's value inside it, between blocks on the line that joins them.

    Values outside all blocks get the nearest block's value, those of a group without blocks themselves. Values and blocks are put in
    one order and the last block is carried forward, in chunks where a group is hot; equal values count once.
    """
    if not by:
        one = F.lit(0).alias("_all")
        return isotonic(values.select("*", one), blocks.select("*", one), ["_all"]).drop("_all")
    key = F.struct(*by).alias("key")
    ahead = running(blocks.withColumn("minus", -F.col("lower")), by, ["lower"], next_of={"next_lower": "lower"})
    # The value of the following block, by its lower end.
    following = blocks.select(*by, F.col("lower").alias("next_lower"), F.col("value").alias("next_value"))
    knots = _left_null_safe(ahead.drop("minus"), following, [*by, "next_lower"])
    wanted = values.select(*by, F.col("confidence").cast("double").alias("confidence")).filter("confidence is not null").distinct()
    none = F.lit(None).cast("struct<lower:double,upper:double,value:double,next_lower:double,next_value:double>")
    stacked = wanted.select(key, F.col("confidence").alias("at"), F.lit(1).alias("side"), none.alias("knot")).unionByName(
        knots.select(key, F.col("lower").alias("at"), F.lit(0).alias("side"), F.struct("lower", "upper", "value", "next_lower", "next_value").alias("knot")))
    carried = running(stacked, ["key"], ["at", "side"], maxs={"block": "knot"}).filter("side = 1")
    least = blocks.groupBy(*by).agg(F.min("value").alias("least"))
    x, b = F.col("at"), F.col("block")
    line = b["value"] + (b["next_value"] - b["value"]) * (x - b["upper"]) / (b["next_lower"] - b["upper"])
    inside = F.when(b.isNull(), F.col("least")).when((x <= b["upper"]) | b["next_lower"].isNull(), b["value"]).otherwise(line)
    found = _left_null_safe(carried.select("key.*", "at", "block"), F.broadcast(least), list(by))
    table = found.select(*by, F.col("at").alias("confidence"), F.coalesce(inside, x).alias("calibrated"))
    joint = F.struct(*by, F.col("confidence").cast("double").alias("confidence"))
    return skew_join(values.withColumn("_at", joint), table.select(joint.alias("_at"), "calibrated"), "_at", "left").select(*values.columns, "calibrated")


def _left_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    return null_safe_join(left, right, keys, "left")


# --- temperature ------------------------------------------------------------------------------------------
@dataclass
class _Root:
    """Search of the inverse temperature where the loss has no slope, between two that enclose it."""

    low: float = 1 / HOTTEST
    high: float = 1 / COLDEST
    at: float = 1.0
    done: bool = False

    def take(self, slope: float, curve: float) -> None:
        if slope > 0:
            self.high = self.at
        else:
            self.low = self.at
        step = self.at - slope / curve if curve > 0 else math.nan
        if not self.low < step < self.high:
            step = math.sqrt(self.low * self.high)
        self.done = abs(step - self.at) <= _ENOUGH * self.at or self.high <= self.low * (1 + _ENOUGH)
        self.at = step


def fit_temperature(df: DataFrame, logits: str, target: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, temperature) that makes the mean cross entropy of ``logits / temperature`` least, between ``COLDEST`` and ``HOTTEST``.

    The loss is convex in the inverse temperature. Its slope and curvature are means over the rows (expectation and
    variance of the logits under the scaled probabilities), so that a step is one aggregate over all groups; steps that leave
    the enclosing interval are replaced by its geometric middle.
    """
    rows = pin(df.select(*by, F.transform(logits, lambda v: v.cast("double")).alias("z"), F.col(target).cast("int").alias("y"))
               .filter(F.get("z", F.col("y")).isNotNull()))
    state = {k: _Root() for k in _keys(rows, by)}
    for _ in range(_STEPS):
        if all(s.done for s in state.values()):
            break
        current = _table(rows, by, {k: {"beta": s.at} for k, s in state.items() if not s.done}, ["beta"])
        top = F.array_max("z")
        weighted = _beside(rows, current, by).withColumn("e", F.transform("z", lambda v: F.exp(F.col("beta") * (v - top))))
        total = F.aggregate("e", F.lit(0.0), lambda a, v: a + v)
        mean = F.aggregate(F.zip_with("e", "z", lambda e, v: e * v), F.lit(0.0), lambda a, v: a + v) / total
        square = F.aggregate(F.zip_with("e", "z", lambda e, v: e * v * v), F.lit(0.0), lambda a, v: a + v) / total
        each = weighted.select(*by, (mean - F.get("z", F.col("y"))).alias("slope"), (square - mean * mean).alias("curve"))
        for key, s in _groups(each.groupBy(*by).agg(F.avg("slope").alias("slope"), F.avg("curve").alias("curve")), by).items():
            state[key].take(s["slope"], s["curve"])
    return _table(rows, by, {k: {"temperature": 1 / s.at} for k, s in state.items()}, ["temperature"])


# --- pipeline stages --------------------------------------------------------------------------------------
class _Columns(Params):
    """Columns and method of a calibrator."""

    method = Param(Params._dummy(), "method", "platt or isotonic", TypeConverters.toString)
    groupCols = Param(Params._dummy(), "groupCols", "columns that tell the groups apart", TypeConverters.toListString)
    confidenceCol = Param(Params._dummy(), "confidenceCol", "confidence in 0 to 1", TypeConverters.toString)
    correctCol = Param(Params._dummy(), "correctCol", "1 where the prediction was right, else 0", TypeConverters.toString)
    outputCol = Param(Params._dummy(), "outputCol", "calibrated confidence", TypeConverters.toString)
    minRows = Param(Params._dummy(), "minRows", "groups with fewer rows keep their confidences", TypeConverters.toInt)

    def __init__(self) -> None:
        super().__init__()
        self._setDefault(method="isotonic", groupCols=["task"], confidenceCol="confidence", correctCol="correct", outputCol="calibrated", minRows=50)

    def value(self, name: str):
        return self.getOrDefault(self.getParam(name))


class Calibrator(Estimator, _Columns, DefaultParamsReadable, DefaultParamsWritable):
    """Fits one calibration a group; a stage for ``pyspark.ml.Pipeline``."""

    @keyword_only
    def __init__(self, *, method: str = "isotonic", groupCols: list[str] | None = None, confidenceCol: str = "confidence",
                 correctCol: str = "correct", outputCol: str = "calibrated", minRows: int = 50):
        super().__init__()
        given = {k: v for k, v in self._input_kwargs.items() if v is not None}
        self._set(**given)
        if self.value("method") not in ("platt", "isotonic"):
            raise ValueError(f"unknown calibration method {self.value('method')!r}")

    def _fit(self, dataset: DataFrame) -> CalibratorModel:
        by = self.value("groupCols")
        pairs = dataset.select(*by, F.col(self.value("confidenceCol")).alias("confidence"), F.col(self.value("correctCol")).cast("double").alias("correct"))
        sizes = pairs.groupBy(*by).agg(F.count("*").alias("_n")).filter(F.col("_n") >= self.value("minRows"))
        enough = null_safe_join(pairs, F.broadcast(_bounded(sizes)), by).drop("_n")
        table = fit_logistic(enough, by) if self.value("method") == "platt" else fit_isotonic(enough, by)
        return self._copyValues(CalibratorModel(table))


def _bounded(groups: DataFrame) -> DataFrame:
    kept = pin(groups)
    if kept.count() > MOST_GROUPS:
        raise ValueError(f"more than {MOST_GROUPS} groups")
    return kept


class CalibratorModel(Model, _Columns, MLReadable, MLWritable):
    """Fitted calibrations as a table: slope and intercept, or blocks, of each group."""

    def __init__(self, table: DataFrame | None = None):
        super().__init__()
        self.table = table

    def _transform(self, dataset: DataFrame) -> DataFrame:
        by, confidence, out = self.value("groupCols"), self.value("confidenceCol"), self.value("outputCol")
        if self.value("method") == "platt":
            known = self.table.select(*by, F.struct("slope", "intercept").alias("_fit"))
            joined = null_safe_join(dataset, F.broadcast(known), by, "left")
            fitted = logistic(F.col(confidence), F.col("_fit.slope"), F.col("_fit.intercept"))
            return joined.withColumn("_fitted", F.coalesce(fitted, F.col(confidence))).select(*dataset.columns, F.col("_fitted").alias(out))
        values = dataset.select(*dataset.columns, *([F.col(confidence).alias("confidence")] if confidence != "confidence" else []))
        return isotonic(values, self.table, by).select(*dataset.columns, F.col("calibrated").alias(out))

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader(cls)


class _Writer(MLWriter):
    def __init__(self, model: CalibratorModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession)
        self.model.table.write.parquet(f"{path}/table")


class _Reader(MLReader):
    def __init__(self, kind: type[CalibratorModel]):
        super().__init__()
        self.kind = kind

    def load(self, path: str) -> CalibratorModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = self.kind(self.sparkSession.read.parquet(f"{path}/table"))
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model
