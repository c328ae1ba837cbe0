"""Language identification with whole words first and shorter and shorter character n-grams behind them.

Training counts, per language, the words of the training texts and the character n-grams of all of them
(borders marked); those seen often enough are kept with their log frequencies, however many there are. A word that the model knows adds its log
frequency in each language. A word that it does not know is read through its n-grams: at each character the
longest known n-gram from ``LONGEST`` characters down to one counts, each step down at a penalty. The language with
the largest mean is predicted.

Defined cases: a null text or one without a letter is ``und`` with score 0; with nothing to learn from every text is
``und``; ties go to the first language in alphabetical order; repeated rows get equal answers; very long texts are read whole, a
chunk at a time; an empty table gives an empty result; other columns of the input do not matter, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.registry import query
from tidemark.llm.sampling import in_fold, per_class
from tidemark.llm.text import Words, chunks, slices
from tidemark.sources.tables import pin, table

UNKNOWN = "und"
#: Bound of the fit: labelled rows used per language.
TRAIN_ROWS = 4_000
#: Words and n-grams seen less often in a language tell nothing about it.
LEAST_WORD = 3
LEAST_GRAM = 5
LONGEST = 5
#: Log penalty for each character that an n-gram is shorter.
STEP_DOWN = 1.0
#: Words whose evidence counts in the score; more words do not make it surer.
EVIDENCE = 20
#: A text whose best language is hardly likelier than the others is not kept.
LEAST_SCORE = 0.3
FOLDS, HELD_OUT = 4, 2
_LETTERS = np.zeros(256, np.uint8)
_LETTERS[97:123] = _LETTERS[128:] = 1  # words here: ASCII letters and every character beyond ASCII


@dataclass(frozen=True)
class LanguageModel:
    """Sorted hashes and their log frequency per language; entry 0 holds words, entry n the n-grams."""

    languages: list[str]
    keys: dict[int, np.ndarray]
    scores: dict[int, np.ndarray]


def _grams(words: Words, at: np.ndarray, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For n from ``longest`` to 1: (n, owner, place, hash, fits) of the n-grams that start at each character of words ``at``."""
    starts, ends = words.starts[at], words.ends[at]
    if not len(at):
        return
    size = ends - starts
    owner = np.repeat(np.arange(len(at)), size)
    offset = np.cumsum(size) - size
    byte = np.arange(size.sum()) - offset[owner] + starts[owner]
    lead = (words.data[byte] & 0xC0) != 0x80
    owner, byte = owner[lead], byte[lead]  # one entry per character
    stop = np.r_[byte[1:], 0]
    last = np.r_[owner[1:] != owner[:-1], True]
    stop[last] = ends[owner[last]]
    left = np.bincount(owner, minlength=len(at))
    place = np.arange(len(owner)) - (np.cumsum(left) - left)[owner]
    for n in range(longest, 0, -1):
        fits = place + n <= left[owner]
        end = stop[np.minimum(np.arange(len(stop)) + n - 1, len(stop) - 1)]
        hashes = np.zeros(len(byte), np.uint64)
        hashes[fits] = words.span_hashes(byte[fits], end[fits])
        # The border before a word and behind it belong to the n-gram.
        hashes[fits & (place == 0)] ^= np.uint64(0xA5A5A5A5A5A5A5A5)
        hashes[fits & (place + n == left[owner])] ^= np.uint64(0x3C3C3C3C3C3C3C3C)
        yield n, owner, place, hashes, fits


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) rows to counts (lang, n, key, times): n = 0 for words, else the n-grams of all words."""
    for batch in batches:
        langs = np.array(batch.column("lang").to_pylist(), object)
        for first, data, offsets in chunks(batch.column("text")):
            words = Words(data, offsets, _LETTERS)
            if not len(words):
                continue
            of = langs[first:first + len(offsets) - 1][words.rows()]
            hashes = words.hashes
            for lang in sorted(set(of)):
                mine = np.flatnonzero(of == lang)
                key, at, times = np.unique(hashes[mine], return_index=True, return_counts=True)
                out = [(0, key, times)]
                for n, owner, _, grams, fits in _grams(words, mine[at], LONGEST):
                    distinct, which = np.unique(grams[fits], return_inverse=True)
                    out.append((n, distinct, np.bincount(which, weights=times[owner[fits]], minlength=len(distinct))))
                for n, key, times in out:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(key), pa.string()), pa.array(np.full(len(key), n, np.int32)),
                         pa.array(key.view(np.int64)), pa.array(times.astype(np.int64))], names=["lang", "n", "key", "times"])


def train(labelled: DataFrame) -> LanguageModel:
    """Model from (doc_id, text, lang) rows; a bounded sample per language is read."""
    rows = labelled.filter("lang is not null and text is not null").select("doc_id", "text", "lang")
    sample = per_class(rows, "lang", TRAIN_ROWS, "doc_id")
    counted = pin(sample.select("lang", "text").mapInArrow(_counts, "lang string, n int, key bigint, times bigint")
                  .groupBy("lang", "n", "key").agg(F.sum("times").alias("times")))
    totals = counted.groupBy("lang", "n").agg(F.sum("times").alias("total")).collect()
    enough = F.col("times") >= F.when(F.col("n") == 0, LEAST_WORD).otherwise(LEAST_GRAM)
    top = counted.filter(enough).select("lang", "n", "key", "times").toArrow().to_pandas()
    languages = sorted({r.lang for r in totals})
    size = {(r.lang, r.n): r.total for r in totals}
    keys: dict[int, np.ndarray] = {}
    scores: dict[int, np.ndarray] = {}
    for n in range(LONGEST + 1):
        rows_n = top[top["n"] == n]
        keys[n], at = np.unique(rows_n["key"].to_numpy(np.int64).view(np.uint64), return_inverse=True)
        # What a language has not shown counts half an occurrence.
        table_n = np.full((len(keys[n]), len(languages)), 0.5)
        table_n[at, [languages.index(x) for x in rows_n["lang"]]] = rows_n["times"]
        scores[n] = np.log(table_n) - np.log([size.get((lang, n), 1) + 1.0 for lang in languages])
    return LanguageModel(languages, keys, scores)


def _lookup(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each wanted hash among the sorted keys, and whether it is there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def _unseen(model: LanguageModel, words: Words, at: np.ndarray) -> np.ndarray:
    """Scores of words that the model does not know, from their longest known n-grams."""
    out = np.zeros((len(at), len(model.languages)))
    open_places = None
    for n, owner, _, hashes, fits in _grams(words, at, LONGEST):
        if open_places is None:
            open_places = np.ones(len(owner), bool)
        ask = np.flatnonzero(open_places & fits)
        where, found = _lookup(model.keys[n], hashes[ask])
        hit = ask[found]
        worth = model.scores[n][where[found]] - STEP_DOWN * (LONGEST - n)
        for k in range(out.shape[1]):
            out[:, k] += np.bincount(owner[hit], weights=worth[:, k], minlength=len(at))
        open_places[hit] = False
    return out / LONGEST  # each character stands in as many n-grams


def _scores(model: LanguageModel, words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Sum of word scores per text and language, and words per text."""
    n = len(words.bounds) - 1
    total = np.zeros((n, len(model.languages)))
    if len(words):
        keys, first, inverse = np.unique(words.hashes, return_index=True, return_inverse=True)
        where, known = _lookup(model.keys[0], keys)
        each = np.empty((len(keys), len(model.languages)))
        each[known] = model.scores[0][where[known]]
        each[~known] = _unseen(model, words, first[~known])
        rows = words.rows()
        for k in range(total.shape[1]):
            total[:, k] = np.bincount(rows, weights=each[inverse, k], minlength=n)
    return total, words.counts


def predict(column: pa.Array, model: LanguageModel) -> tuple[list[str], list[float]]:
    """Language and score of each text."""
    labels, scores = [], []
    for first, data, offsets in chunks(column):
        words = Words(data, offsets, _LETTERS)
        ascii_letters = np.r_[0, np.cumsum((words.data >= 97) & (words.data <= 122))]
        letters = np.diff(ascii_letters[offsets]) > 0
        for i in np.flatnonzero(~letters & (np.diff(offsets) > 0)):
            letters[i] = any(map(str.isalpha, data[offsets[i]:offsets[i + 1]].tobytes().decode("utf-8", "replace")))
        if not model.languages:
            labels += [UNKNOWN] * len(letters)
            scores += [0.0] * len(letters)
            continue
        total, count = _scores(model, words)
        weight = np.minimum(count, EVIDENCE) / np.maximum(count, 1)
        z = total * weight[:, None]
        z = np.exp(z - z.max(axis=1, keepdims=True))
        share = z.max(axis=1) / z.sum(axis=1)
        best = total.argmax(axis=1)
        labels += [model.languages[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), letters.tolist())]
        scores += np.where(letters, share, 0.0).tolist()
    return labels, scores


def with_language(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """(doc_id, lang_pred, score) of documents (doc_id, text)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels, scores = predict(batch.column("text"), sent.value)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(labels, pa.string()), pa.array(scores, pa.float64())],
                                             names=["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id bigint, lang_pred string, score double")


def keep_known(docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` (doc_id, text, lang, ...) in a recognised language; learned from the labels of the same rows."""
    sent = docs.sparkSession.sparkContext.broadcast(train(docs.filter(~in_fold("doc_id", FOLDS, HELD_OUT))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole)):
            labels, scores = predict(batch.column("text"), sent.value)
            yield batch.filter(pa.array([x != UNKNOWN and s >= LEAST_SCORE for x, s in zip(labels, scores)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


@query("op4_language")
def language(spark: SparkSession, directory: str) -> DataFrame:
    """Predicted language of every document."""
    docs = table(spark, directory, "documents")
    model = train(docs.filter(~in_fold("doc_id", FOLDS, HELD_OUT)))
    return with_language(docs, model).withColumn("held_out", in_fold("doc_id", FOLDS, HELD_OUT))
