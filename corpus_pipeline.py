"""A corpus from raw documents to token ids: five stages, each written and read again before the next.

* language: documents without a recognised language go;
* near-duplicates: of each component of near-copies, the document with the smallest id stays;
* decontamination: documents that hold a benchmark window go;
* secrets: secrets are masked in the text (and n_chars follows);
* sentencepiece: ids and decoded text, as digests per document.

All stages but the last return the columns of ``documents``. Null and empty texts have no language, so the first stage drops
them; an empty table stays empty.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import decontamination, language, secrets, sentencepieces, simhash
from tidemark.llm.text import small_batches
from tidemark.sources.tables import shared_dir, table


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return language.keep_known(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return simhash.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return secrets.redact(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return sentencepieces.digests(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [("language", keep_languages), ("near_duplicates", drop_near_copies), ("decontamination", drop_contaminated),
          ("secrets", mask_secrets), ("sentencepiece", encode)]

#: Trained models decide in two stages, which SQL cannot express; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what they hand on is kept as Parquet in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/corpus-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}.parquet"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
