"""Scores of the trained operators against plain versions, and their independence of how the tables are stored."""

import math

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from tidemark.llm import language, quality, toxicity
from tidemark.llm.text import Words
from tests.llm.frames import awkward

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")


def layouts(docs, labels):
    return [(docs.repartition(n), labels.repartition(8 - n)) for n in (3, 7)]


def test_quality_is_the_size_difference(spark, tables):
    model = quality.train(*tables)

    def plain(text):
        if not text:
            return model.share
        raw = text.encode()
        size = []
        for d in (model.good, model.bad):
            c = zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=zstandard.ZstdCompressionDict(d), write_checksum=False,
                                         write_content_size=False, write_dict_id=False)
            size.append(sum(len(c.compress(raw[i:i + quality.PIECE])) for i in range(0, len(raw), quality.PIECE)))
        return 1 / (1 + math.exp(-min(30, max(-30, model.weights[0] + model.weights[1] * (size[1] - size[0]) / len(raw)))))

    docs = tables[0].limit(50).select("doc_id", "text").union(awkward(spark).select(F.col("doc_id") + 10**6, "text"))
    texts = {r.doc_id: r.text for r in docs.filter("doc_id is not null").collect()}
    got = {r.doc_id: r.score for r in quality.with_quality(docs, model).filter("doc_id is not null").collect()}
    assert {k: pytest.approx(plain(t)) for k, t in texts.items()} == got
    assert model.weights[1] > 0 and len(model.weights) == 2


def test_quality_model_does_not_depend_on_the_layout(spark, tables):
    first, second = (quality.train(*t) for t in layouts(*tables))
    assert first.good == second.good and first.bad == second.bad and first.share == second.share
    assert np.allclose(first.weights, second.weights, rtol=1e-12)


def test_language_scores(spark, tables):
    """Word by word: a known word's own scores, else the longest known n-gram at each character."""
    model = language.train(tables[0])

    def gram(word, i, n):
        key = int(Words(np.frombuffer(word[i:i + n].encode(), np.uint8), np.array([0, len(word[i:i + n].encode())]), np.ones(256, np.uint8)).hashes[0])
        return key ^ (0xA5A5A5A5A5A5A5A5 if i == 0 else 0) ^ (0x3C3C3C3C3C3C3C3C if i + n == len(word) else 0)

    def found(n, key):
        at = int(np.searchsorted(model.keys[n], np.uint64(key)))
        return model.scores[n][at] if at < len(model.keys[n]) and int(model.keys[n][at]) == key else None

    def score(word):
        raw = word.encode()
        whole = found(0, int(Words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), np.ones(256, np.uint8)).hashes[0]))
        if whole is not None:
            return whole
        total = np.zeros(len(model.languages))
        for i in range(len(word)):
            for n in range(min(language.LONGEST, len(word) - i), 0, -1):
                hit = found(n, gram(word, i, n))
                if hit is not None:
                    total += hit - language.STEP_DOWN * (language.LONGEST - n)
                    break
        return total / language.LONGEST

    import pyarrow as pa
    for text in ("the unhappyish weather", "zzkeitschung und", "élévationnelle", "qqq the", "ciónmentell ñandú"):
        total = sum(score(w) for w in text.split())
        z = np.exp((total - total.max()) * min(1, language.EVIDENCE / len(text.split())))
        labels, scores = language.predict(pa.array([text]), model)
        assert labels == [model.languages[int(total.argmax())]] and scores[0] == pytest.approx(z.max() / z.sum())


def test_models_do_not_depend_on_the_layout(spark, tables):
    one, two = (language.train(d) for d, _ in layouts(*tables))
    assert all((one.keys[n] == two.keys[n]).all() and np.allclose(one.scores[n], two.scores[n]) for n in one.keys)
    first, second = (toxicity.train(*t) for t in layouts(*tables))
    assert (first.features.keys == second.features.keys).all() and np.allclose(first.weights, second.weights)


def test_toxicity_scores(spark, tables):
    """The sum of the weights of a text's distinct features, through the logistic curve."""
    from tidemark.llm.features import presence
    model = toxicity.train(*tables)
    docs = tables[0].limit(40).select("doc_id", "text").union(awkward(spark).select(F.col("doc_id") + 10**6, "text"))
    got = {r.doc_id: r.score for r in toxicity.with_toxicity(docs, model).filter("doc_id is not null").collect()}
    weight = dict(zip(model.features.keys.tolist(), model.weights.tolist()))
    for r in docs.filter("doc_id is not null").collect():
        raw = (r.text or "").encode()
        _, hashes = presence(Words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)])), toxicity.GRAMS)
        z = model.bias + sum(weight.get(h, 0.0) for h in set(hashes.tolist()))
        assert got[r.doc_id] == pytest.approx(1 / (1 + math.exp(-min(30, max(-30, z)))))


def test_repeated_rows_get_equal_scores(spark, tables):
    for scored in (quality.with_quality(awkward(spark), quality.train(*tables)), toxicity.with_toxicity(awkward(spark), toxicity.train(*tables))):
        assert scored.filter("doc_id in (4, 5)").agg(F.count_distinct("score")).first()[0] == 1
