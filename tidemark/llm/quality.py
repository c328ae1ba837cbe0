"""Text quality by compression with two dictionaries.

zstandard dictionaries are built from texts labelled good and from texts labelled bad. A text is compressed with each of
them, in pieces short enough that the dictionary and not the text's own start decides; the better it fits one side, the
smaller that size. The difference of the two sizes over the text's length is the only evidence; a logistic curve over it, fitted
on labelled texts that the dictionaries have not seen, makes it a probability.

Fitting reads a bounded sample (about ``PER_CLASS`` labelled rows of each class, and at most ``TEXT_BYTES`` of each, in evenly spaced
pieces). It is cut into ``PARTS`` parts: the curve is fitted on each part's differences under dictionaries of the other
parts, the dictionaries in use are built from all. Equal texts count once and pieces come in the order of their ids, so that the
model does not depend on how the tables are stored. Every text is scored whole, very long ones piece by piece.

Defined cases: null and empty texts get the share of good labels; without labels every score is 0.5; with labels of one
class only every score is that class; repeated rows get equal scores; an empty table gives an empty result; other columns of
the input do not matter, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.registry import query
from tidemark.llm.sampling import in_fold, per_class
from tidemark.sources.tables import pin, table

#: Bounds of the fit.
PER_CLASS = 2_000
TEXT_BYTES = 1 << 16
PARTS = 5
PIECE = 96
DICTIONARY = 256 << 10
LEVEL = 3
FOLDS, HELD_OUT = 3, 1


@dataclass(frozen=True)
class QualityModel:
    good: bytes
    bad: bytes
    weights: np.ndarray  # constant and slope of the curve over the difference
    share: float         # of good labels


def pieces(text: str, most: int | None = None) -> list[bytes]:
    """A text in pieces of ``PIECE`` bytes; evenly spaced ones if all would be more than ``most`` bytes."""
    raw = text.encode("utf-8")
    cuts = range(0, len(raw), PIECE)
    if most is not None and len(raw) > most:
        cuts = cuts[::-(-len(raw) // most)]
    return [raw[at:at + PIECE] for at in cuts]


def _dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary, or the samples themselves where they are too few to train one."""
    try:
        return zstandard.train_dictionary(DICTIONARY, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICTIONARY:]


class Difference:
    """Compressed size under the bad dictionary less that under the good one, over the length."""

    def __init__(self, good: bytes, bad: bytes):
        self.compressors = [zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(d) if d else None,
                                                     write_checksum=False, write_content_size=False, write_dict_id=False) for d in (good, bad)]

    def of(self, text: str) -> float:
        good, bad = (c.compress for c in self.compressors)
        parts = pieces(text)
        return sum(len(bad(p)) - len(good(p)) for p in parts) / max(sum(map(len, parts)), 1)


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = 1e-3, rounds: int = 50) -> np.ndarray:
    """Constant and slope of a weighted logistic curve, by Newton steps."""
    scale = float(np.abs(x).max()) or 1.0
    rows = np.c_[np.ones(len(x)), x / scale]
    w = np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(rows @ w, -30, 30)))
        step = np.linalg.solve((rows * (weight * p * (1 - p))[:, None]).T @ rows + penalty * np.eye(2), rows.T @ (weight * (p - y)) + penalty * w)
        w = w - np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return w / np.array([1.0, scale])


def _sample(docs: DataFrame, judged: DataFrame) -> DataFrame:
    """(doc_id, text, quality, part): about PER_CLASS rows a class, of equal texts the one with the smallest id."""
    # The chosen labels are a bounded set: sent to the texts, which then stay where they are.
    chosen = F.broadcast(per_class(judged, "quality", PER_CLASS, "doc_id"))
    rows = docs.filter("length(text) > 0").select("doc_id", "text").join(chosen, "doc_id")
    once = rows.groupBy("text").agg(F.min("doc_id").alias("doc_id"), F.max("quality").alias("quality"))
    return once.select("doc_id", "text", "quality", F.pmod(F.xxhash64("doc_id"), F.lit(PARTS)).cast("int").alias("part"))


def _differences(sample: DataFrame, pairs: list[tuple[bytes, bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Difference and label of each row of the sample, under the pair of its part."""
    sent = sample.sparkSession.sparkContext.broadcast(pairs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = [Difference(*pair) for pair in sent.value]
        for batch in batches:
            got = [each[part].of(text) for part, text in zip(batch.column("part").to_pylist(), batch.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality"), pa.array(got, pa.float64())], names=["doc_id", "quality", "x"])

    got = sample.select("doc_id", "quality", "part", "text").mapInArrow(run, "doc_id bigint, quality int, x double").toPandas()
    got = got.sort_values("doc_id", kind="stable")
    return got["x"].to_numpy(), got["quality"].to_numpy(float)


def train(docs: DataFrame, labels: DataFrame) -> QualityModel:
    """Model from documents (doc_id, text) and labels (doc_id, quality 0/1) of the training fold."""
    judged = labels.filter("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    size = {r.quality: r["count"] for r in judged.groupBy("quality").count().collect()}
    share = size.get(1, 0) / sum(size.values()) if size else 0.5
    nothing = QualityModel(b"", b"", np.zeros(2), share)
    if share in (0.0, 1.0) or not size:
        return nothing
    sample = pin(_sample(docs, judged.select(F.col("doc_id").cast("bigint").alias("doc_id"), "quality")))
    held: dict[tuple[int, int], list[list[bytes]]] = {}
    for row in sample.orderBy("doc_id").toLocalIterator():
        held.setdefault((row.quality, row.part), []).append(pieces(row.text, TEXT_BYTES))
    if {q for q, _ in held} != {0, 1}:
        return nothing

    def pair(without: int | None) -> tuple[bytes, bytes]:
        sides = [[p for (q, part), texts in sorted(held.items()) if q == kind and part != without for text in texts for p in text] for kind in (1, 0)]
        return tuple(_dictionary(s) if s else b"" for s in sides)

    x, y = _differences(sample, [pair(part) for part in range(PARTS)])
    # The sample holds the classes evenly; weights bring back their true share.
    weights = _logistic(x, y, np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean())))
    return QualityModel(*pair(None), weights, share)


def score(texts: list[str | None], model: QualityModel, difference: Difference) -> np.ndarray:
    """Probability of a good label for each text."""
    out = np.full(len(texts), model.share)
    full = [i for i, t in enumerate(texts) if t]
    if full and model.weights.any():
        x = np.array([difference.of(texts[i]) for i in full])
        out[full] = 1 / (1 + np.exp(-np.clip(model.weights[0] + model.weights[1] * x, -30, 30)))
    return out


def with_quality(docs: DataFrame, model: QualityModel) -> DataFrame:
    """(doc_id, score, predicted) of documents (doc_id, text)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        difference = Difference(sent.value.good, sent.value.bad)
        for batch in batches:
            scores = score(batch.column("text").to_pylist(), sent.value, difference)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))],
                                             names=["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, score double, predicted int")


@query("op2_quality")
def quality(spark: SparkSession, directory: str) -> DataFrame:
    """Quality of every document."""
    docs = table(spark, directory, "documents")
    learned = ~in_fold("doc_id", FOLDS, HELD_OUT)
    model = train(docs.filter(learned), table(spark, directory, "labels").filter(learned))
    return with_quality(docs, model).withColumn("held_out", in_fold("doc_id", FOLDS, HELD_OUT))
