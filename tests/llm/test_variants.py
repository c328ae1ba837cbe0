import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidemark.llm import variants as V
from tests.llm.frames import awkward, documents, empty, lower


def brute_words(rows):
    count = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            count[run] += 1
    return {w: n for w, n in count.items() if len(w) >= 7 and n >= 2}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(words):
    form, out = {}, {}
    for w, n in words.items():
        beside = [v for v in words if v != w and near(w, v)]
        best = min(beside, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= 10 * n else None
        out[w] = (n, len(beside))
    for w, (n, k) in out.items():
        root = w
        while form[root]:
            root = form[root]
        yield w, form[w], root, n, k, words.get(form[w])


def got(frame):
    return sorted(map(tuple, frame.select("word", "form", "root", "n", "n_near", "form_n").collect()), key=str)


def vocabulary(spark, words):
    return spark.createDataFrame(list(words.items()), "word string, n bigint")


@pytest.mark.parametrize("long", [64, 9])
def test_random_words_match_brute_force(spark, monkeypatch, long):
    """Words around the border of the long ones included: both ways give the same pairs."""
    monkeypatch.setattr(V, "LONG", long)
    draw = random.Random(8)
    seeds = ["aaaaaaa", "abababab", "aabbaabbaa", "letters", "éàüßñéàü", "mississippi"]
    words = {}
    for _ in range(400):
        w = draw.choice(seeds)
        for _ in range(draw.randint(0, 2)):
            i = draw.randrange(len(w) + 1)
            w = draw.choice((w[:i] + draw.choice("abé") + w[i:], w[:i] + w[i + 1:], w[:i] + draw.choice("abé") + w[i + 1:]))
        if len(w) >= 7:
            words[w] = draw.choice((2, 3, 20, 20, 200, 2000, 30_000))
    assert got(V.variants(vocabulary(spark, words))) == sorted(brute(words), key=str)


def test_very_long_words(spark):
    base = "".join(random.Random(1).choice("abcdefgh") for _ in range(30_000))
    words = {base: 500, base[:9_000] + base[9_001:]: 30, base[:70] + "z" + base[71:]: 2, base[::-1]: 4, "a" * 65: 10, "a" * 64: 100, "a" * 63: 1000, "a" * 66: 2}
    assert got(V.variants(vocabulary(spark, words))) == sorted(brute(words), key=str)


def test_whole_documents(spark):
    draw = random.Random(2)
    stock = ["Straße", "wonderful", "WONDERFULLY", "documents", "document", "élévation", "Élévation", "analysis×", "runningé", "short"]
    docs = [(i if i % 9 else None, " ".join(draw.choice(stock) for _ in range(200)) + "-3.") for i in range(40)]
    frame = documents(spark, docs)
    words = brute_words(docs)
    assert {r.word: r.n for r in V.vocabulary(frame).collect()} == words
    result = V.variants(V.vocabulary(frame))
    assert got(result) == sorted(brute(words), key=str)
    assert result.filter(F.col("form").isNotNull()).count() > 3


def test_awkward_rows(spark):
    rows = [(r.doc_id, r.text) for r in awkward(spark).collect()] + [(50, "e" * 200_000 + " " + "e" * 200_000), (51, "e" * 200_000)]
    frame = documents(spark, rows)
    words = brute_words(rows)
    assert got(V.variants(V.vocabulary(frame))) == sorted(brute(words), key=str)
    assert V.variants(V.vocabulary(empty(spark))).count() == 0


def test_ranges_stay_small(spark):
    """A frequent pattern: no prefix range holds more words than the alphabet has characters, and the whole word."""
    words = {f"patter{c}{d}": 5 for c in "abcdefghijklmnopqrstuvwxyz" for d in ["", *"abcdefghijklmnopqrstuvwxyz"]}
    rows = V._neighbours(V._rotations(vocabulary(spark, words)))
    assert rows.agg(F.max(F.size("near"))).first()[0] <= 26
    assert got(V.variants(vocabulary(spark, words))) == sorted(brute(words), key=str)
