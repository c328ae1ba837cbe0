"""Small frames with the awkward cases that every operator must bear."""

from __future__ import annotations

EXTRA = "lang string, source string, n_chars bigint, uid bigint, key string, score string, fp string, span int, _place0 int, label string"
_REST = ("en", "src0", 1, 7, "k", "s", "f", 1, 2, "l")


def documents(spark, rows, lang=None):
    """(doc_id, text) pairs with columns whose names clash with those that operators use."""
    data = [(i, t, lang(t) if lang else _REST[0], *_REST[1:]) for i, t in rows]
    return spark.createDataFrame(data, f"doc_id bigint, text string, {EXTRA}")


def awkward(spark):
    """Null ids and texts, empty and very long texts, repeated rows, ties, no words, characters beyond ASCII."""
    long = " ".join(f"word{i % 977} and of the" for i in range(30_000))
    return documents(spark, [(1, None), (2, ""), (None, "an text without id"), (3, long), (4, "same text twice here"), (4, "same text twice here"),
                             (5, "same text twice here"), (6, "!!! ... ---"), (7, "Ünïcödé 日本語 🙂 text\n\t  x"), (8, "a"), (None, None)])


def empty(spark):
    return documents(spark, [])


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
