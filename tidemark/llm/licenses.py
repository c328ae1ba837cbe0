"""License scans by an exact set-similarity join.

Templates are short license texts, and phrases whose every word must be there. A text is cut into blocks of ``BLOCK``
words that start every ``STEP`` words, so that whatever spans up to ``STEP`` words lies whole in a block. A block matches a
template if it holds at least the template's share of its distinct words. All such pairs are found:

* words are ordered by how often the whole corpus has them, the rarest first;
* prefix filter: a template that needs m of its n words must share one of its n - m + 1 rarest, so only those are indexed,
  and only blocks with one of them are looked at;
* length filter: a block with fewer than m template words cannot match;
* positional filter: from the first common word on, what is left in either order must still reach m;
* the pairs left are verified by their whole intersection, phrases also by the places where their words stand in a row.

Templates are a list given by the caller (of at most ``STEP`` words each), so their index is a literal table. Counts
cover all texts.

Defined cases: a null or empty text has no words and no labels; several places of one phrase in overlapping blocks count
once each; repeated rows give equal rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.registry import query
from tidemark.llm.text import Words, chunks
from tidemark.sources.tables import literal_table, table

BLOCK, STEP = 128, 64
SHARE = 0.8

# Phrases, and opening or key sentences of well-known licenses.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
TEXTS = (
    ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
     "files, to deal in the software without restriction", "mit"),
    ("Licensed under the Apache License, Version 2.0", "apache"),
    ("This work is licensed under the GNU General Public License, version 3", "gpl"),
    ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License "
     "as published by the Free Software Foundation", "gpl"),
    ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
     "following conditions are met", "bsd"),
    ("This Source Code Form is subject to the terms of the Mozilla Public License", "mpl"),
    ("This work is licensed under a Creative Commons Attribution 4.0 International License", "cc-by"),
)


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[str, ...]
    share: float
    phrase: bool

    @property
    def tokens(self) -> frozenset[str]:
        return frozenset(self.words)

    @property
    def need(self) -> int:
        return math.ceil(self.share * len(self.tokens) - 1e-9)


def words_of(text: str) -> tuple[str, ...]:
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    return tuple(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low))


def templates(phrases: Sequence[tuple[str, str]] = PHRASES, texts: Sequence[tuple[str, str]] = TEXTS, share: float = SHARE) -> list[Template]:
    out = [Template(label, words_of(t), 1.0, True) for t, label in phrases]
    out += [Template(label, words_of(t), share, False) for t, label in texts]
    if any(not t.words or len(t.words) > STEP for t in out):
        raise ValueError(f"templates have 1 to {STEP} words")
    return out


def _hashes(vocabulary: Sequence[str]) -> np.ndarray:
    """Hash of each word, as ``Words`` gives it."""
    joined = " ".join(vocabulary).encode()
    return Words(np.frombuffer(joined, np.uint8), np.array([0, len(joined)])).hashes


class _Vocabulary:
    """Finds the template words in the words of a chunk."""

    def __init__(self, vocabulary: Sequence[str]):
        hashes = _hashes(vocabulary)
        self.order = np.argsort(hashes)
        self.keys = hashes[self.order]
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[(self.keys & np.uint64(0xFFFF)).astype(np.int64)] = True

    def find(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """(word, place in the vocabulary) of every template word."""
        if not len(words):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        hashes = words.hashes
        ask = np.flatnonzero(self.maybe[(hashes & np.uint64(0xFFFF)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.keys, hashes[ask]), len(self.keys) - 1)
        hit = self.keys[at] == hashes[ask]
        return ask[hit], self.order[at[hit]]


def corpus_counts(docs: DataFrame, vocabulary: Sequence[str]) -> list[int]:
    """How often all texts have each of the words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Vocabulary(vocabulary)
        total = np.zeros(len(vocabulary), np.int64)
        for batch in batches:
            for _, data, offsets in chunks(batch.column("text")):
                total += np.bincount(known.find(Words(data, offsets))[1], minlength=len(vocabulary))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(vocabulary))), pa.array(total)], names=["token", "times"])

    counted = docs.select("text").mapInArrow(run, "token bigint, times bigint").groupBy("token").agg(F.sum("times").alias("times"))
    times = {r.token: r.times for r in counted.collect()}  # one row per template word
    return [times.get(i, 0) for i in range(len(vocabulary))]


_BLOCKS = "array<struct<block:bigint,tokens:array<int>,at:array<bigint>,token:array<int>>>"
_BLOCK_TYPE = pa.list_(pa.struct([("block", pa.int64()), ("tokens", pa.list_(pa.int32())), ("at", pa.list_(pa.int64())), ("token", pa.list_(pa.int32()))]))


def _blocks_of(docs: DataFrame, ordered: Sequence[str], prefixes: frozenset[int]) -> DataFrame:
    """(uid, doc_id, n_words, blocks): blocks with an indexed word, their distinct template words in order, and all places."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Vocabulary(ordered)
        indexed = np.zeros(len(ordered), bool)
        indexed[list(prefixes)] = True
        for batch in batches:
            counts, out = [], []
            for _, data, offsets in chunks(batch.column("text")):
                words = Words(data, offsets)
                counts += words.counts.tolist()
                base = len(out)
                out += [[] for _ in words.counts]
                word, token = known.find(words)
                if not len(word):
                    continue
                rows = words.rows()[word]
                place = word - words.bounds[rows]
                mine = indexed[token]
                block = np.concatenate([place[mine] // STEP, place[mine] // STEP - 1])
                pairs = np.unique(np.c_[np.concatenate([rows[mine], rows[mine]]), block][block >= 0], axis=0)
                for row, b in pairs.tolist():
                    low = int(words.bounds[row]) + b * STEP
                    high = min(low + BLOCK, int(words.bounds[row + 1]))
                    i, j = np.searchsorted(word, [low, high])
                    out[base + row].append({"block": b, "tokens": np.unique(token[i:j]).tolist(), "at": place[i:j].tolist(), "token": token[i:j].tolist()})
            yield pa.RecordBatch.from_arrays([batch.column("uid"), batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(out, _BLOCK_TYPE)],
                                             names=["uid", "doc_id", "n_words", "blocks"])

    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return rows.mapInArrow(run, f"uid bigint, doc_id bigint, n_words bigint, blocks {_BLOCKS}")


def matches(docs: DataFrame, wanted: Sequence[Template]) -> DataFrame:
    """Pairs of blocks and templates at or above the template's share, and one empty row for each document.

    (uid, doc_id, n_words, block, template, share, starts): ``starts`` are the places of a phrase.
    """
    vocabulary = sorted(set().union(*(t.tokens for t in wanted)))
    counts = corpus_counts(docs, vocabulary)
    ordered = [w for _, w in sorted(zip(counts, vocabulary))]
    rank = {w: i for i, w in enumerate(ordered)}
    sets = [sorted(rank[w] for w in t.tokens) for t in wanted]
    index = [(token, i, j, len(s), t.need) for i, (t, s) in enumerate(zip(wanted, sets))
             for j, token in enumerate(s[:len(s) - t.need + 1])]
    blocks = _blocks_of(docs, ordered, frozenset(x[0] for x in index))
    prefixes = literal_table(docs.sparkSession, "prefix int, template int, j int, size int, need int", index)
    tokens = (blocks.select("uid", "doc_id", "n_words", F.explode_outer("blocks").alias("b"))
              .select("uid", "doc_id", "n_words", "b", F.posexplode_outer("b.tokens").alias("i", "word")))
    # The index is a literal of a few rows per template: its size does not follow the data.
    met = tokens.join(F.broadcast(prefixes), F.col("word") == F.col("prefix"), "left")
    held = F.size("b.tokens")
    possible = (held >= F.col("need")) & (F.least(F.col("size") - F.col("j"), held - F.col("i")) >= F.col("need"))
    candidates = met.select("uid", "doc_id", "n_words", "i", F.col("b.block").alias("block"), "b.tokens", "b.at", "b.token",
                            F.when(possible, F.col("template")).alias("template"))
    candidates = candidates.filter("template is not null or coalesce(i, 0) = 0").drop("i")  # one row of each block stays
    orders = [[rank[w] for w in t.words] for t in wanted]

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, share, starts = [], [], []
            for template, have, at, token in zip(*(batch.column(c).to_pylist() for c in ("template", "tokens", "at", "token"))):
                ok, common, places = False, 0, []
                if template is not None:
                    common = len(set(have).intersection(sets[template]))
                    ok = common >= wanted[template].need
                    if ok and wanted[template].phrase:
                        stands = dict(zip(at, token))
                        places = [p for p in at if all(stands.get(p + k) == w for k, w in enumerate(orders[template]))]
                        ok = bool(places)
                found.append(template if ok else None)
                share.append(common / len(sets[template]) if ok else None)
                starts.append(places if ok else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in ("uid", "doc_id", "n_words", "block")]
                + [pa.array(found, pa.int32()), pa.array(share, pa.float64()), pa.array(starts, pa.list_(pa.int64()))],
                names=["uid", "doc_id", "n_words", "block", "template", "share", "starts"])

    return candidates.mapInArrow(verify, "uid bigint, doc_id bigint, n_words bigint, block bigint, template int, share double, starts array<bigint>")


def scan(docs: DataFrame, wanted: Sequence[Template] | None = None) -> DataFrame:
    """Per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score (the best share found)."""
    wanted = templates() if wanted is None else list(wanted)
    label = F.element_at(F.array(*[F.lit(t.label) for t in wanted]), F.col("template") + 1)
    phrase = F.coalesce(F.element_at(F.array(*[F.lit(t.phrase) for t in wanted]), F.col("template") + 1), F.lit(False))
    rows = matches(docs, wanted).withColumns({"label": F.when(F.col("template").isNotNull(), label), "base": phrase})
    # A phrase's places in one block come as one list; lists of overlapping blocks are merged per document.
    grouped = rows.groupBy("uid").agg(
        F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"),
        F.array_distinct(F.flatten(F.collect_set(F.when(F.col("base"), F.transform(
            "starts", lambda s: F.struct(s.alias("start"), F.col("template").alias("template"))))))).alias("places"),
        F.collect_set(F.when(F.col("base"), F.col("label"))).alias("base_labels"), F.collect_set("label").alias("labels"),
        F.coalesce(F.max("share"), F.lit(0.0)).alias("score"))
    starts = F.transform("places", lambda p: p["start"])
    return grouped.select(
        "doc_id", "n_words", F.size("places").cast("bigint").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        F.concat_ws(",", F.array_sort("base_labels")).alias("base_labels"), F.concat_ws(",", F.array_sort("labels")).alias("labels"), "score")


def _values(rows: Sequence[Template]) -> str:
    return ", ".join("({}, '{}', {}, {}, [{}])".format(i, t.label, t.need, "true" if t.phrase else "false", ", ".join(f"'{w}'" for w in t.words))
                     for i, t in enumerate(rows))


_SQL = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
t(id, label, need, phrase, words) AS (VALUES {_values(templates())}),
b AS (SELECT doc_id, list_distinct(list_slice(w, s + 1, s + {BLOCK})) AS have
      FROM (SELECT doc_id, w, unnest(range(0, len(w), {STEP})) AS s FROM d)),
texts AS (
  SELECT doc_id, label, max(len(list_intersect(have, words)) / len(list_distinct(words))) AS share
  FROM b, t WHERE NOT phrase AND len(list_intersect(have, words)) >= need GROUP BY doc_id, id, label),
places AS (
  SELECT doc_id, id, label, s FROM (SELECT doc_id, w, unnest(range(0, len(w))) AS s FROM d), t
  WHERE phrase AND list_slice(w, s + 1, s + len(words)) = words),
base AS (SELECT doc_id, count(*) AS n, min(s) AS a, max(s) AS z, string_agg(DISTINCT label, ',' ORDER BY label) AS l FROM places GROUP BY doc_id),
every AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS l, max(share) AS score
          FROM (SELECT doc_id, label, share FROM texts UNION ALL SELECT doc_id, label, 1.0 FROM places) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(base.n, 0) AS n_base, base.a AS first_word, base.z AS last_word,
       coalesce(base.l, '') AS base_labels, coalesce(every.l, '') AS labels, CAST(coalesce(every.score, 0) AS DOUBLE) AS score
FROM d LEFT JOIN base USING (doc_id) LEFT JOIN every USING (doc_id)
"""


@query("op3_licenses", _SQL)
def licenses(spark: SparkSession, directory: str) -> DataFrame:
    """Licenses named or quoted in every document."""
    return scan(table(spark, directory, "documents"))
