"""Held-out accuracy of the trained operators, and their defined answers to awkward rows."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import language, quality, toxicity
from tidemark.llm.sampling import in_fold
from tests.llm.frames import awkward, documents, empty

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")


def test_folds_follow_crc32(spark):
    rows = spark.range(200).withColumnRenamed("id", "doc_id").withColumn("held", in_fold("doc_id", 4, 2)).collect()
    assert all(r.held == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)


def test_language_held_out(spark, tables):
    got = language.language(spark, DATA).join(tables[0].select("doc_id", "lang"), "doc_id").filter("held_out")
    right, n, low, high = got.agg(F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*"), F.min("score"), F.max("score")).first()
    assert right / n > 0.97 and 0 <= low <= high <= 1


def test_language_backs_off_to_parts_of_words(spark, tables):
    model = language.train(tables[0])
    import pyarrow as pa
    labels, _ = language.predict(pa.array(["ciónasdoueqz ciónmentellñz", "keitschungzzq heitschlichq"]), model)
    assert labels == ["es", "de"]


def test_language_awkward(spark, tables):
    model = language.train(tables[0])
    got = {(r.doc_id, r.lang_pred) for r in language.with_language(awkward(spark), model).collect()}
    assert {(1, "und"), (2, "und"), (6, "und")} <= got and (7, "und") not in got
    assert language.with_language(empty(spark), model).count() == 0
    nothing = language.train(empty(spark))
    assert {r.lang_pred for r in language.with_language(awkward(spark), nothing).collect()} == {"und"}
    kept = language.keep_known(tables[0])
    assert kept.columns == tables[0].columns and kept.count() > 0.98 * tables[0].count()


def test_quality_held_out(spark, tables):
    got = quality.quality(spark, DATA).join(tables[1], "doc_id").filter("held_out")
    right, n = got.agg(F.sum((F.col("quality") == F.col("predicted")).cast("int")), F.count("*")).first()
    assert right / n > 0.93


def test_quality_awkward(spark, tables):
    docs, labels = tables
    model = quality.train(docs, labels)
    got = quality.with_quality(awkward(spark), model).collect()
    assert len(got) == 11 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert {r.score for r in got if r.doc_id in (1, 2)} == {model.share}
    assert quality.with_quality(empty(spark), model).count() == 0
    assert {r.score for r in quality.with_quality(awkward(spark), quality.train(docs, labels.limit(0))).collect()} == {0.5}
    one = quality.train(docs, labels.withColumn("quality", F.lit(1)))
    assert {r.score for r in quality.with_quality(awkward(spark), one).collect()} == {1.0}


def test_toxicity_finds_planted_words(spark):
    draw = random.Random(4)
    word = lambda: "".join(draw.choice("aeioulmnrst") for _ in range(5))
    bad = ["grobnak", "vexuli", "morpton"]
    text = lambda toxic: " ".join(draw.choice(bad) if toxic and draw.random() < 0.1 else word() for _ in range(60))
    toxic = {i: draw.random() < 0.15 for i in range(1500)}
    docs = documents(spark, [(i, text(t)) for i, t in toxic.items()])
    labels = spark.createDataFrame([(i, int(t)) for i, t in toxic.items() if i % 2], "doc_id bigint, toxic int")
    model = toxicity.train(docs.filter("doc_id < 1000"), labels.filter("doc_id < 1000"))
    got = toxicity.with_toxicity(docs.filter("doc_id >= 1000"), model).collect()
    assert np.mean([r.predicted for r in got if toxic[r.doc_id]]) > 0.9
    assert np.mean([r.predicted for r in got if not toxic[r.doc_id]]) < 0.1


def test_toxicity_awkward(spark, tables):
    model = toxicity.train(*tables)
    got = toxicity.with_toxicity(awkward(spark), model).collect()
    assert len(got) == 11 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert toxicity.with_toxicity(empty(spark), model).count() == 0
    nothing = toxicity.train(tables[0], tables[1].withColumn("toxic", F.lit(0)))
    assert {r.score for r in toxicity.with_toxicity(awkward(spark), nothing).collect()} == {0.0}


def test_the_risk_on_clean_texts_stays_non_negative():
    draw = np.random.default_rng(0)
    side = lambda n, p: (np.flatnonzero(draw.random(n) < p), np.zeros(0, int), n)
    rows, _, n = side(200, 0.9)
    others, _, m = side(400, 0.1)
    w, b = toxicity.fit((rows, np.zeros(len(rows), int), n), (others, np.zeros(len(others), int), m), 0.1, 1)
    assert w[0] > 1 and 1 / (1 + np.exp(-b)) < 0.3 < 1 / (1 + np.exp(-(w[0] + b)))
