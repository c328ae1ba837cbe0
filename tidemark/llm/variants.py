"""Spelling variants of words by permuterm rotations.

A word is marked with a terminator and rotated: ``house$`` gives ``ouse$h``, ``use$ho`` and so on. The rotation that ends in the
character at place i starts with all others in a fixed order, so words that differ there alone have rotations with one common
prefix, and a word with one character less has that prefix itself as a rotation. Replacements, insertions and deletions thus
become prefix ranges that skip the edited character. Rotations are sorted by prefix and each range is scanned once:
its members differ in one character, so that there are no more of them than the alphabet has, and every word in it emits its
neighbours. A character may be taken from a run of equal ones at any place; only the first counts, so no pair comes twice.

Rotations take as much room as the square of a word's length. Words longer than ``LONG`` are therefore compared through fingerprints of
their prefixes, made from rolling sums, and their pairs are verified on the words.

Defined cases: null and empty texts have no words; a null id counts as an empty one in the hash; very long texts are read whole; a
word without neighbours has no form, 0 neighbours and is its own root; of neighbours with the same count the first in code-point
order is the form; an empty table gives an empty result; other columns of the input do not matter, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from string import ascii_lowercase, ascii_uppercase

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.registry import query
from tidemark.sources.tables import pin, table

LETTERS = "A-Za-zÀ-ÿ"
LEAST_LENGTH, LEAST_COUNT = 7, 2
#: A form is at least so many times as frequent.
RATIO = 10
#: One of so many runs loses a character.
DAMAGE = 31
END = "$"
#: Longer words, in code points, are compared through fingerprints.
LONG = 64
_PRIME = (1 << 61) - 1
_BASES = 0x1F3D5B79A2C4E687 % _PRIME, 0x0B8E3A6D914F27C5 % _PRIME


def runs(docs: DataFrame, least: int = LEAST_LENGTH) -> DataFrame:
    """(doc_id, run) of the letter runs of at least ``least`` code points, with A-Z lower-cased."""
    found = F.regexp_extract_all("text", F.lit(f"([{LETTERS}]{{{least},}})"), F.lit(1))
    run = docs.select("doc_id", F.explode(found).alias("run"))
    plain = F.length("run") == F.octet_length("run")
    lower = F.when(plain, F.lower("run")).otherwise(F.translate(F.col("run"), ascii_uppercase, ascii_lowercase))
    return run.select("doc_id", lower.alias("run"))


def damaged(run: Column, doc_id: Column, one_of: int = DAMAGE) -> Column:
    """The run, or the run without the character its hash names, if ``one_of`` divides that hash."""
    name = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run)
    h = F.crc32(name.cast("binary"))
    at = (h % F.length(run)).cast("int")
    shorter = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))
    return F.when(h % one_of == 0, shorter).otherwise(run)


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, n) of the damaged runs of all documents that are long and frequent enough."""
    word = runs(docs).select(damaged(F.col("run"), F.col("doc_id")).alias("word"))
    return word.filter(F.length("word") >= LEAST_LENGTH).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= LEAST_COUNT)


def _rotations(words: DataFrame) -> DataFrame:
    """(prefix, edit, first, word, n): a row for each character of a word that a prefix skips, and one for each whole rotation.

    ``edit`` is the skipped character, empty for a whole rotation; ``first`` tells the first of a run of equal characters.
    """
    spread = words.select("word", "n", F.explode(F.sequence(F.lit(0), F.length("word") * 2)).alias("turn"))
    skip, at = F.col("turn") % 2, F.floor(F.col("turn") / 2).cast("int")
    word = F.col("word")
    # Even turns are the whole rotations 0 .. length, odd ones skip the characters 0 .. length - 1.
    prefix = F.concat(F.substring(word, at + 1 + skip, F.length(word)), F.lit(END), F.substring(word, F.lit(1), at))
    edit = F.substring(word, at + 1, skip)
    before = F.when(at > 0, F.substring(word, at, F.lit(1))).otherwise(F.lit(""))
    return spread.select(prefix.alias("prefix"), edit.alias("edit"), (edit != before).alias("first"), "word", "n")


def _neighbours(rotations: DataFrame) -> DataFrame:
    """(word, near): for each member of a prefix range its neighbours there, an array of (order, word), the most frequent first."""
    ranges = Window.partitionBy("prefix")
    member = F.struct((-F.col("n")).alias("order"), "word", "edit", "first")
    sorted_ = rotations.withColumn("range", F.collect_list(member).over(ranges)).filter(F.size("range") > 1)
    one = F.col("edit") != ""

    def beside(m: Column) -> Column:
        other = m["edit"] != ""
        return (m["word"] != F.col("word")) & F.when(one & other, True).when(one, F.col("first")).otherwise(m["first"])

    near = F.transform(F.filter(F.sort_array("range"), beside), lambda m: F.struct(m["order"].alias("order"), m["word"].alias("word")))
    return sorted_.select("word", near.alias("near")).filter(F.size("near") > 0)


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Long words (tag, word) to (prefix, edit, first, tag); a prefix is the fingerprint of the characters behind and before the place."""
    for batch in batches:
        for tag, word in zip(batch.column("tag").to_pylist(), batch.column("word").to_pylist()):
            n = len(word)
            codes = [ord(c) for c in word] + [ord(END)]
            behind: list[list[int]] = []
            powers: list[list[int]] = []
            for base in _BASES:
                sums, power = [0], [1]
                for c in codes:
                    sums.append((sums[-1] * base + c) % _PRIME)
                    power.append(power[-1] * base % _PRIME)
                behind.append(sums)
                powers.append(power)

            def of(start: int, before: int) -> bytes:
                """Fingerprint of word[start:] + END + word[:before]."""
                out = []
                for sums, power in zip(behind, powers):
                    tail = (sums[n + 1] - sums[start] * power[n + 1 - start]) % _PRIME
                    out.append((tail * power[before] + sums[before]) % _PRIME)
                return np.array([n + 1 - start + before, *out], "<u8").tobytes()

            for low in range(0, n + 1, 10_000):
                places = range(low, min(low + 10_000, n + 1))
                skips = [i for i in places if i < n]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([of(i, i) for i in places] + [of(i + 1, i) for i in skips], pa.binary()),
                     pa.array([""] * len(places) + [word[i] for i in skips], pa.string()),
                     pa.array([False] * len(places) + [i == 0 or word[i] != word[i - 1] for i in skips], pa.bool_()),
                     pa.array([tag] * (len(places) + len(skips)), pa.int64())], names=["prefix", "edit", "first", "tag"])


def _long_neighbours(words: DataFrame) -> DataFrame:
    """(word, near) as of ``_neighbours``, of pairs with a word longer than ``LONG``."""
    tagged = pin(words.filter(F.length("word") >= LONG)).withColumn("tag", F.monotonically_increasing_id())
    turned = tagged.select("tag", "word").mapInArrow(_fingerprints, "prefix binary, edit string, first boolean, tag bigint")
    members = F.collect_list(F.struct("tag", "edit", "first")).over(Window.partitionBy("prefix"))
    pairs = (turned.withColumn("range", members).filter(F.size("range") > 1)
             .select("tag", "edit", "first", F.explode("range").alias("m")).filter("tag != m.tag and (edit != '' or m.edit != '')")
             .filter("if(edit != '' and m.edit != '', true, if(edit != '', first, m.first))").select("tag", F.col("m.tag").alias("other")))
    other = tagged.select(F.col("tag").alias("other"), F.col("word").alias("near_word"), (-F.col("n")).alias("order"))
    both = pairs.join(tagged.select("tag", "word"), "tag").join(other, "other")
    sure = both.filter((F.greatest(F.length("word"), F.length("near_word")) > LONG) & (F.levenshtein("word", "near_word", 1) == 1))
    return sure.select("word", F.array(F.struct("order", F.col("near_word").alias("word"))).alias("near"))


def neighbours(words: DataFrame) -> DataFrame:
    """(word, near) of words (word, n): arrays of (order, word), each neighbour in one of a word's arrays; order is minus its n."""
    short = words.filter(F.length("word") <= LONG)
    return _neighbours(_rotations(short)).unionByName(_long_neighbours(words))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of words that have a form: the last of the chain of forms. Each round halves what is left of the chains."""
    jumps = pin(forms.select("word", F.col("form").alias("root")))
    while True:
        onward = jumps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        joined = pin(jumps.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        jumps = joined.drop("moved")
        if joined.filter("moved").isEmpty():
            return jumps


def variants(words: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of distinct words with their counts n."""
    words = pin(words.select("word", "n"))
    near = (neighbours(words).groupBy("word").agg(F.sum(F.size("near")).alias("n_near"), F.min(F.col("near")[0]).alias("best")))
    joined = words.join(near, "word", "left")
    enough = -F.col("best.order") >= RATIO * F.col("n")
    formed = pin(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(enough, F.col("best.word")).alias("form"),
                               F.when(enough, -F.col("best.order")).alias("form_n")))
    last = roots(formed.filter("form is not null"))
    return formed.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


_SQL = f"""
WITH RECURSIVE
tab AS (SELECT list(v ORDER BY i) AS t FROM (
  SELECT i, list_reduce([i::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0], lambda x, b: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) AS v
  FROM range(256) AS r(i))),
found AS (SELECT doc_id, translate(run, '{ascii_uppercase}', '{ascii_lowercase}') AS run
          FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[{LETTERS}]+')) AS run FROM documents)),
runs AS (SELECT doc_id, run, count(*) AS n, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS name
         FROM found WHERE length(run) >= {LEAST_LENGTH} GROUP BY doc_id, run),
hashed AS (
  SELECT run, n, xor(list_reduce([4294967295::BIGINT] || list_transform(range(length(name) // 2), lambda k: ('0x' || substr(name, 2 * k + 1, 2))::BIGINT),
                                 lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h
  FROM runs, tab),
words AS (
  SELECT word, sum(n)::BIGINT AS n
  FROM (SELECT n, CASE WHEN h % {DAMAGE} = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM hashed)
  WHERE length(word) >= {LEAST_LENGTH} GROUP BY word HAVING sum(n) >= {LEAST_COUNT}),
cut AS (SELECT word, i, left(word, i) || substr(word, i + 2) AS rest FROM (SELECT word, unnest(range(length(word))) AS i FROM words)),
near AS (
  SELECT a.word, b.word AS other FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT c.word, w.word FROM cut c JOIN words w ON w.word = c.rest
  UNION SELECT w.word, c.word FROM cut c JOIN words w ON w.word = c.rest),
best AS (
  SELECT x.word, count(*) AS n_near, first(o.word ORDER BY o.n DESC, encode(o.word)) AS other, max(o.n) AS other_n
  FROM near x JOIN words o ON o.word = x.other GROUP BY x.word),
formed AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= {RATIO} * w.n THEN other END AS form,
         CASE WHEN other_n >= {RATIO} * w.n THEN other_n END AS form_n
  FROM words w LEFT JOIN best USING (word)),
chain(word, pos, step) AS (
  SELECT word, word, 0 FROM formed
  UNION ALL SELECT c.word, f.form, step + 1 FROM chain c JOIN formed f ON f.word = c.pos WHERE f.form IS NOT NULL)
SELECT f.word, f.form, r.root, f.n, f.n_near, f.form_n FROM formed f JOIN (SELECT word, arg_max(pos, step) AS root FROM chain GROUP BY word) r USING (word)
"""


@query("op13_variants", _SQL)
def spelling(spark: SparkSession, directory: str) -> DataFrame:
    """Forms and roots of the words of all documents."""
    return variants(vocabulary(table(spark, directory, "documents")))
