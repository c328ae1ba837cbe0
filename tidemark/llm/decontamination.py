"""Benchmark decontamination by winnowing.

A window is ``length`` consecutive words of a benchmark item; an item of fewer words is one window. Each
window holds ``length - k + 1`` overlapping k-grams, and the smallest hash among them is kept as its
fingerprint, on both sides. Equal windows have equal smallest hashes, so a document that holds a window
shares a fingerprint with the item: no window can be missed. Fingerprints of documents pass a bit filter
of fixed size before they are shuffled (it lets through a few strangers and stops none of ours), are joined
to those of the items by hash, and each meeting is extended word by word in both directions, which proves or
refutes it.

Defined cases: a null or empty text has no words and no hits; repeated documents give one row each; items
with the same id count once; an item without id marks words but is not counted; no items, no hits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.registry import query
from tidemark.llm.rows import without
from tidemark.llm.text import MULTIPLIER, Words, chunks, mix
from tidemark.sources.tables import table

WINDOW = 10
GRAM = 5
#: Size of the bit filter: 2 MB, whatever the benchmark holds. A fuller filter only lets more rows pass.
FILTER_BITS = 1 << 24

_FOUND = "array<struct<key:bigint,length:int,at:bigint,first:bigint,words:string>>"
_FOUND_TYPE = pa.list_(pa.struct([("key", pa.int64()), ("length", pa.int32()), ("at", pa.int64()),
                                  ("first", pa.int64()), ("words", pa.string())]))


def winnow(hashes: np.ndarray, remaining: np.ndarray, length: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the k-grams that are smallest in some window of ``length`` words.

    ``remaining`` counts the words from each position to the end of its text, itself included.
    """
    n = len(hashes)
    gram = np.zeros(n, np.uint64)
    for j in range(min(k, n)):
        gram[:n - j] = gram[:n - j] * np.uint64(MULTIPLIER) + hashes[j:]
    gram = mix(gram + np.uint64(length))
    window = length - k + 1
    smallest = gram.copy()
    for j in range(1, min(window, n)):
        np.minimum(smallest[:n - j], gram[j:], out=smallest[:n - j])
    valid = remaining >= length
    kept = np.zeros(n, bool)
    for j in range(min(window, n)):
        kept[j:] |= valid[:n - j] & (gram[j:] == smallest[:n - j])
    at = np.flatnonzero(kept)
    return at, gram[at]


def _fingerprints(column: pa.Array, lengths: list[int], bits: np.ndarray | None) -> tuple[list[int], list[list[dict]]]:
    """Word count of each text, and its fingerprints with the words around them."""
    totals: list[int] = []
    found: list[list[dict]] = []
    for _, data, offsets in chunks(column):
        words = Words(data, offsets)
        counts, ends = words.counts, words.bounds[1:]
        totals += counts.tolist()
        base = len(found)
        found += [[] for _ in counts]
        if not len(words):
            continue
        hashes, rows = words.hashes, words.rows()
        remaining = ends[rows] - np.arange(len(words))
        for length in lengths:
            k = min(GRAM, length)
            at, gram = winnow(hashes, remaining, length, k)
            if bits is not None:
                slot = gram & np.uint64(64 * len(bits) - 1)
                at_bits = bits[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))
                passed = (at_bits & np.uint64(1)).astype(bool)
                at, gram = at[passed], gram[passed]
            for i, g in zip(at.tolist(), gram.view(np.int64).tolist()):
                row = int(rows[i])
                low = int(words.bounds[row])
                first, stop = max(low, i - (length - k)), min(int(ends[row]), i + length)
                found[base + row].append({"key": g, "length": length, "at": i - low, "first": first - low,
                                          "words": words.phrase(first, stop)})
    return totals, found


def _with_fingerprints(df: DataFrame, lengths: list[int], bits=None) -> DataFrame:
    """Rows (uid, id, text) to (uid, id, n_words, found)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            totals, found = _fingerprints(batch.column("text"), lengths, bits.value if bits is not None else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("uid"), batch.column("id"), pa.array(totals, pa.int64()), pa.array(found, _FOUND_TYPE)],
                names=["uid", "id", "n_words", "found"])
    return df.mapInArrow(run, f"uid bigint, id bigint, n_words bigint, found {_FOUND}")


def _extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keep the words that a document and an item share around a common fingerprint, if they fill a window."""
    for batch in batches:
        spans = []
        for mine, theirs, length, at, first, their_at, their_first in zip(
                *(batch.column(c).to_pylist() for c in ("words", "item_words", "length", "at", "first", "item_at", "item_first"))):
            if theirs is None:
                spans.append(None)
                continue
            a, b = mine.split(" "), theirs.split(" ")
            i, j = at - first, their_at - their_first
            left = 0
            while left < min(i, j) and a[i - left - 1] == b[j - left - 1]:
                left += 1
            right = 0
            while right < min(len(a) - i, len(b) - j) and a[i + right] == b[j + right]:
                right += 1
            spans.append({"start": at - left, "stop": at + right} if left + right >= length else None)
        kept = pa.array(spans, pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("uid", "doc_id", "n_words", "items")] + [kept],
                                         names=["uid", "doc_id", "n_words", "items", "span"])


def _bit_filter(spark: SparkSession, keys: DataFrame):
    """Bits of all fingerprints, gathered as at most ``FILTER_BITS / 64`` words."""
    slot = F.col("key").bitwiseAND(F.lit(FILTER_BITS - 1))
    words = (keys.select(F.shiftright(slot, 6).alias("word"),
                         F.expr("shiftleft(1L, cast(key & 63 as int))").alias("bit"))
             .groupBy("word").agg(F.bit_or("bit").alias("bits")).collect())
    bits = np.zeros(FILTER_BITS // 64, np.uint64)
    for word, value in words:
        bits[word] = value & 0xFFFFFFFFFFFFFFFF
    return spark.sparkContext.broadcast(bits)


def contamination(docs: DataFrame, benchmark: DataFrame, length: int = WINDOW) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and the hit word spans.

    ``docs`` has doc_id and text, ``benchmark`` item_id and text; other columns are ignored.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.lit(0).cast("bigint").alias("uid"), F.col("item_id").cast("bigint").alias("id"), "text")
    counted = _with_fingerprints(items, []).select(F.least("n_words", F.lit(length)).alias("l")).distinct()
    lengths = sorted(r.l for r in counted.collect() if r.l)  # 1 to ``length`` at most
    marks = (_with_fingerprints(items, lengths).select("id", F.least("n_words", F.lit(length)).alias("own"), F.inline("found"))
             .filter("length = own"))
    marks = (marks.groupBy("key", "length", "words", (F.col("at") - F.col("first")).alias("item_at"))
             .agg(F.collect_set("id").alias("items"))
             .select(F.col("key").alias("item_key"), F.col("length").alias("item_length"), F.col("words").alias("item_words"),
                     "item_at", F.lit(0).cast("bigint").alias("item_first"), "items"))
    bits = _bit_filter(spark, marks.select(F.col("item_key").alias("key")).distinct())
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("bigint").alias("id"), "text")
    # A document without fingerprints keeps one row, spread by its own number: no hot null key.
    met = (_with_fingerprints(rows, lengths, bits).select("uid", F.col("id").alias("doc_id"), "n_words", F.inline_outer("found"))
           .withColumn("join_key", F.coalesce("key", F.xxhash64("uid")))
           .join(marks, (F.col("join_key") == F.col("item_key")) & (F.col("length") == F.col("item_length")), "left"))
    # The few rows are dealt anew: with a broadcast join, both functions would else run at once, in two Python workers a task.
    spans = met.repartition("uid").mapInArrow(_extend, "uid bigint, doc_id bigint, n_words bigint, items array<bigint>, "
                                                       "span struct<start:bigint,stop:bigint>")
    grouped = (spans.groupBy("uid")
               .agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"),
                    F.array_sort(F.collect_set("span")).alias("spans"),
                    F.array_distinct(F.flatten(F.collect_set(F.when(F.col("span").isNotNull(), F.col("items"))))).alias("items")))
    covered = F.expr("aggregate(spans, named_struct('n', 0L, 'end', 0L), (s, x) -> named_struct("
                     "'n', s.n + greatest(0L, x.stop - greatest(x.start, s.end)), 'end', greatest(s.end, x.stop))).n")
    return grouped.select(
        "doc_id", "n_words", covered.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort(F.col("items").cast("array<string>"))), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"), "spans", "uid")


def clean(docs: DataFrame, benchmark: DataFrame, length: int = WINDOW) -> DataFrame:
    """``docs`` without the documents that hold a benchmark window."""
    return without(docs, contamination(docs, benchmark, length).filter("contaminated"))


_SQL = r"""
WITH low AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
it AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, len, array_to_string(list_slice(w, s, s + len - 1), ' ') AS g
  FROM (SELECT item_id, w, least(len(w), 10) AS len, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS s
        FROM it WHERE len(w) > 0)),
lens AS (SELECT DISTINCT len FROM win),
dw AS (
  SELECT doc_id, len, s, array_to_string(list_slice(w, s, s + len - 1), ' ') AS g
  FROM (SELECT doc_id, w, len, unnest(range(1, len(w) - len + 2)) AS s FROM low, lens WHERE len(w) >= len)),
hit AS (SELECT doc_id, item_id, dw.len, s FROM dw JOIN win ON dw.g = win.g AND dw.len = win.len),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + len)) AS p FROM hit) GROUP BY doc_id),
ids AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
        FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hit) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM low LEFT JOIN n USING (doc_id) LEFT JOIN ids USING (doc_id)
"""


@query("op1_decontamination", _SQL)
def decontamination(spark: SparkSession, directory: str) -> DataFrame:
    """Benchmark windows found in every document."""
    found = contamination(table(spark, directory, "documents"), table(spark, directory, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
