import hashlib
import random
import re

import pytest

from tidemark.llm import decontamination as D
from tests.llm.frames import awkward, documents, empty, lower


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text or ""))


def brute(docs, items):
    windows = {}
    for item, text in items:
        w = words(text)
        n = min(len(w), 10)
        for s in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[s:s + n]), set()).add(item)
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(g) for g in windows}:
            for s in range(len(w) - n + 1):
                if tuple(w[s:s + n]) in windows:
                    hit.update(range(s, s + n))
                    found |= {str(x) for x in windows[tuple(w[s:s + n])] if x is not None}
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def got(frame):
    return sorted((tuple(r) for r in frame.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()), key=str)


def benchmark(spark, items):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in items], "item_id bigint, text string, key string, length int")


def test_random_texts_match_brute_force(spark):
    draw = random.Random(3)
    pick = lambda n: " ".join(draw.choice("ab c dé e f g") for _ in range(n))  # few words: many repeated k-grams
    items = [(i, pick(draw.randint(8, 40))) for i in range(12)] + [(20, "short item"), (21, "x"), (22, ""), (23, None), (3, "again, Another short-item text")]
    docs = [(i, pick(draw.randint(0, 60))) for i in range(60)]
    docs += [(100 + i, pick(5) + " " + (t or "") + " " + pick(9)) for i, t in items] + [(200, "a SHORT, item")]
    assert got(D.contamination(documents(spark, docs), benchmark(spark, items))) == brute(docs, items)


def test_awkward_rows_keep_one_row_each(spark):
    rows = [(r.doc_id, r.text) for r in awkward(spark).collect()]
    items = [(1, "same text twice here"), (None, "日本語")]
    assert got(D.contamination(awkward(spark), benchmark(spark, items))) == brute(rows, items)


def test_empty_sides(spark):
    assert D.contamination(empty(spark), benchmark(spark, [(1, "a b")])).count() == 0
    assert all(r.n_hit == 0 for r in D.contamination(awkward(spark), benchmark(spark, [])).collect())


def test_full_filter_changes_nothing(spark, monkeypatch):
    monkeypatch.setattr(D, "FILTER_BITS", 64)  # one word of bits: everything passes
    items, docs = [(1, " ".join("abcdefghijkl"))], [(1, "z " + " ".join("abcdefghijkl")), (2, "q r s")]
    assert got(D.contamination(documents(spark, docs), benchmark(spark, items))) == brute(docs, items)


def test_clean_keeps_columns_and_clean_rows(spark):
    docs = documents(spark, [(1, "one two three four"), (2, "other words"), (3, None)])
    kept = D.clean(docs, benchmark(spark, [(1, "one two three four")]))
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3]


@pytest.mark.parametrize("length", [1, 4, 5, 10])
def test_winnowing_marks_every_window(length):
    import numpy as np
    values = np.random.default_rng(length).integers(0, 5, 200).astype(np.uint64)
    at, _ = D.winnow(values, np.arange(200, 0, -1), length, min(5, length))
    k = min(5, length)
    for s in range(200 - length + 1):
        assert ((at >= s) & (at <= s + length - k)).any()
