"""Toxicity by non-negative learning from positive and unlabelled texts.

Known: some texts confirmed as toxic, and texts that nobody has judged. A linear model over hashed words and
character n-grams is trained with NumPy on a risk that needs no clean examples: with the share p of toxic texts
among all, the loss on clean texts is what unlabelled texts show minus p times what toxic texts show, and this difference,
which cannot be negative in truth, is kept from becoming so: when it does, the step goes the other way.
The share p comes from the labelled rows of the training fold.

Training uses bounded samples of the training fold (``POSITIVES`` and ``UNLABELLED`` rows). Features are counted on
both sides by Spark, and all that lean clearly to the toxic side are kept; the model adds the weights of those
present, each once, so that length alone does not raise a score.

Defined cases: null and empty texts have no features and get the score of the bias; without any toxic example every score
is 0; repeated rows get equal scores; very long texts are read whole, a chunk at a time; an empty table gives an empty result; other
columns of the input do not matter, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.features import Chosen, presence
from tidemark.llm.registry import query
from tidemark.llm.sampling import in_fold, per_class
from tidemark.llm.text import Words, chunks
from tidemark.sources.tables import pin, table

GRAMS = (4, 5)
#: Bounds of the sample that the model is fitted on.
POSITIVES = 3_000
UNLABELLED = 6_000
#: A feature is used if toxic texts hold it so many standard errors more often, and so many of them hold it.
LEAST_LEAN = 4.0
LEAST_TEXTS = 4
#: And if at least this share of all texts with it would be toxic, by the class prior.
LEAST_SHARE = 0.4
EPOCHS = 300
RATE = 0.05
DECAY = 1e-4
THRESHOLD = 0.3
FOLDS, HELD_OUT = 4, 2


@dataclass(frozen=True)
class ToxicityModel:
    features: Chosen
    weights: np.ndarray
    bias: float


def _feature_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(positive, text) rows to (key, positives, others): texts of a chunk that hold a feature."""
    for batch in batches:
        side = batch.column("positive").to_numpy(zero_copy_only=False)
        for first, data, offsets in chunks(batch.column("text")):
            row, hashes = presence(Words(data, offsets), GRAMS)
            keys, inverse = np.unique(hashes, return_inverse=True)
            toxic = side[first + row].astype(bool)
            counts = [np.bincount(inverse[toxic == kind], minlength=len(keys)) for kind in (True, False)]
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), *map(pa.array, counts)], names=["key", "positives", "others"])


def _held(sample: DataFrame, features: Chosen) -> dict[bool, tuple[np.ndarray, np.ndarray, int]]:
    """For both sides of a bounded sample: (row, feature) pairs and the number of rows."""
    sent = sample.sparkSession.sparkContext.broadcast(features)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, offsets in chunks(batch.column("text")):
                row, feature = sent.value.present(Words(data, offsets))
                cuts = np.searchsorted(row, np.arange(len(offsets)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("positive").slice(first, len(offsets) - 1),
                     pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(feature.astype(np.int32)))],
                    names=["positive", "held"])

    got = sample.mapInArrow(run, "positive boolean, held array<int>").toArrow()
    out = {}
    for kind in (True, False):
        lists = got.filter(pc.equal(got["positive"], kind))["held"].combine_chunks()
        many = np.asarray(pc.list_value_length(lists)).astype(np.int64)
        out[kind] = np.repeat(np.arange(len(lists)), many), np.asarray(lists.flatten()).astype(np.int64), len(lists)
    return out


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return np.where(np.isneginf(z), 0.0, 1 / (1 + np.exp(-np.clip(z, -30, 30))))


def fit(positive: tuple[np.ndarray, np.ndarray, int], unlabelled: tuple[np.ndarray, np.ndarray, int], prior: float,
        size: int) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative risk with the logistic loss; a side is (row, feature, rows)."""
    sides = positive, unlabelled
    w, b = np.zeros(size), -2.0
    moment, spread = np.zeros(size + 1), np.zeros(size + 1)
    for step in range(1, EPOCHS + 1):
        z = [np.bincount(row, weights=w[at], minlength=n) + b for row, at, n in sides]
        p, u = _sigmoid(z[0]), _sigmoid(z[1])
        # Logistic losses: log(1 + e^-z) as toxic, log(1 + e^z) as clean.
        clean_risk = np.logaddexp(0, z[1]).mean() - prior * np.logaddexp(0, z[0]).mean()
        if clean_risk >= 0:
            pull = [-prior / sides[0][2] * np.ones(len(p)), u / sides[1][2]]  # p - 1 as toxic, less p as clean
        else:
            pull = [prior * p / sides[0][2], -u / sides[1][2]]
        gradient = np.r_[DECAY * w, 0.0]
        for (row, at, _), g in zip(sides, pull):
            gradient[:-1] += np.bincount(at, weights=g[row], minlength=size)
            gradient[-1] += g.sum()
        moment = 0.9 * moment + 0.1 * gradient
        spread = 0.999 * spread + 0.001 * gradient ** 2
        change = RATE * (moment / (1 - 0.9 ** step)) / (np.sqrt(spread / (1 - 0.999 ** step)) + 1e-8)
        w, b = w - change[:-1], b - change[-1]
    return w, float(b)


def choose(counts: DataFrame, positives: int, others: int, prior: float) -> np.ndarray:
    """Sorted keys of the features that lean clearly to the toxic side; no more than the sample's toxic texts hold."""
    p, u = F.col("positives") / positives, F.col("others") / others
    both = (F.col("positives") + F.col("others")) / (positives + others)
    lean = (p - u) / F.sqrt(both * (1 - both) * (1 / positives + 1 / others) + 1e-12)
    best = (counts.filter(F.col("positives") >= LEAST_TEXTS).withColumn("lean", lean).filter(F.col("lean") >= LEAST_LEAN)
            .filter(prior * p >= LEAST_SHARE * u).select("key").toArrow())
    return np.sort(best["key"].to_numpy().astype(np.int64).view(np.uint64))


def train(docs: DataFrame, labels: DataFrame) -> ToxicityModel:
    """Model from documents (doc_id, text) and labels (doc_id, toxic 0/1) of the training fold."""
    judged = labels.filter("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    prior = judged.agg(F.avg("toxic")).first()[0]
    rows = docs.filter("text is not null").select("doc_id", "text")
    # About POSITIVES rows whatever the input: sent to the texts, which stay where they are.
    known = rows.join(F.broadcast(per_class(judged.filter("toxic = 1"), "toxic", POSITIVES, "doc_id")), "doc_id")
    others = per_class(rows.withColumn("side", F.lit(0)), "side", UNLABELLED, "doc_id")
    sample = pin(known.select(F.lit(True).alias("positive"), "text").union(others.select(F.lit(False), "text")))
    size = {r.positive: r["count"] for r in sample.groupBy("positive").count().collect()}
    if True not in size or not prior:
        return ToxicityModel(Chosen(np.zeros(0, np.uint64), GRAMS), np.zeros(0), -np.inf)
    counts = (sample.mapInArrow(_feature_counts, "key bigint, positives bigint, others bigint")
              .groupBy("key").agg(F.sum("positives").alias("positives"), F.sum("others").alias("others")))
    features = Chosen(choose(counts, size[True], size[False], float(prior)), GRAMS)
    held = _held(sample, features)
    weights, bias = fit(held[True], held[False], float(prior), len(features.keys))
    return ToxicityModel(features, weights, bias)


def score(column: pa.Array, model: ToxicityModel) -> np.ndarray:
    """Score of each text, 0 to 1."""
    out = np.zeros(len(column))
    for first, data, offsets in chunks(column):
        row, feature = model.features.present(Words(data, offsets))
        n = len(offsets) - 1
        out[first:first + n] = _sigmoid(np.bincount(row, weights=model.weights[feature], minlength=n) + model.bias)
    return out


def with_toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """(doc_id, score, predicted) of documents (doc_id, text)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = score(batch.column("text"), sent.value)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores), pa.array((scores >= THRESHOLD).astype(np.int32))],
                                             names=["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, score double, predicted int")


@query("op5_toxicity")
def toxicity(spark: SparkSession, directory: str) -> DataFrame:
    """Toxicity of every document."""
    docs = table(spark, directory, "documents")
    learned = ~in_fold("doc_id", FOLDS, HELD_OUT)
    model = train(docs.filter(learned), table(spark, directory, "labels").filter(learned))
    return with_toxicity(docs, model).withColumn("held_out", in_fold("doc_id", FOLDS, HELD_OUT))
