import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from tidemark.llm import merkle as M
from tests.llm.frames import awkward, documents, empty, lower


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row, text):
    values = [row.doc_id, row.source, row.lang, row.n_chars, text]
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def brute(rows, fanout):
    """(doc_id, leaf, subroot, root, proof digest, folded root) by the rule, one tree after the other."""
    def tree(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([sha("".join(levels[-1][i:i + fanout])) for i in range(0, len(levels[-1]), fanout)])
        return levels

    def way(levels, at):
        for level in levels[:-1]:
            start = at // fanout * fanout
            yield "".join(level[start:at]), "".join(level[at + 1:start + fanout])
            at //= fanout

    made = {}
    for r in rows:
        changed = r.text is not None and r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0
        leaf = leaf_of(r, r.text)
        made.setdefault(r.source, []).append((r.doc_id is not None, r.doc_id or 0, leaf, leaf_of(r, lower(r.text)) if changed else leaf))
    names = sorted(made, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([x[2] for x in sorted(made[s])]) for s in names}
    top = tree([trees[s][-1][0] for s in names])
    out = []
    for i, s in enumerate(names):
        for at, (known, doc, leaf, other) in enumerate(sorted(made[s])):
            steps = [*way(trees[s], at), *way(top, i)]
            node = other
            for left, right in steps:
                node = sha(left + node + right)
            out.append((doc if known else None, leaf, trees[s][-1][0], top[-1][0], sha("".join(a + b for a, b in steps)), node))
    return sorted(out, key=str)


def got(docs):
    rows = M.manifest(M.leaves(docs, M.lower_cased()))
    return sorted((tuple(r) for r in rows.select("id", "leaf", "subroot", "root", M.proof_digest(F.col("proof")), "folded").collect()), key=str)


def corpus(spark, sizes):
    rows = [(10 * i + 7 * (i % 3), f"Text {i} of A {s}", "en", s, i, "k") for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, root string").repartition(5)


@pytest.mark.parametrize("fanout, levels, sizes", [
    (2, 1, {"b": 37, None: 5, "a": 1, "é": 2, "Z": 9}),
    (2, 2, {f"s{i}": i % 4 + 1 for i in range(19)} | {"hot": 70}),
    (3, 1, {"x": 28, "y": 27, "z": 1}),
    (16, 3, {"hot": 300, "small": 17, "": 1, None: 2}),
    (16, 1, {"hot": 700} | {f"s{i}": 1 for i in range(20)}),
    (4, 2, {"only": 65}),
    (4, 2, {"only": 1}),
])
def test_equals_the_plain_tree(spark, monkeypatch, fanout, levels, sizes):
    monkeypatch.setattr(M, "FANOUT", fanout)
    monkeypatch.setattr(M, "LEVELS", levels)
    docs = corpus(spark, sizes)
    assert got(docs) == brute(docs.collect(), fanout)


def test_exchange_groups_stay_small(spark, monkeypatch):
    """One source with nearly all rows: no group of a round gathers more than FANOUT roots, and units neither vanish nor double."""
    monkeypatch.setattr(M, "FANOUT", 4)
    n = {"big": 301, "mid": 7, "one": 1, "two": 2, "three": 3, "four": 4}
    units = spark.createDataFrame([(i, b, k, len(n), f"{i}-{b}") for i, k in enumerate(n.values()) for b in range(k)],
                                  "index bigint, block bigint, blocks bigint, count bigint, root string")
    out = M.exchange(units)
    assert out.count() == sum(n.values()) and out.select("root").distinct().count() == 1
    assert out.select("index", "subroot").distinct().count() == len(n)
    kin = out.select(F.explode("path").alias("s")).select((F.length("s.left") + F.length("s.right")).alias("n"))
    assert kin.agg(F.max("n")).first()[0] <= 3 * 64


def test_awkward_rows(spark):
    docs = awkward(spark)
    assert got(docs) == brute(docs.collect(), M.FANOUT)
    assert got(empty(spark)) == []
    assert got(documents(spark, [(3, None)]).withColumn("source", F.lit(None).cast("string")))[0][0] == 3


def test_only_changed_texts_fail(spark):
    docs = documents(spark, [(i, "UPPER" if i % 2 else "lower") for i in range(60)])
    rows = M.manifest(M.leaves(docs, M.lower_cased())).collect()
    failed = {r.id for r in rows if r.folded != r.root}
    assert failed == {i for i in range(60) if i % 2 and zlib.crc32(str(i).encode()) % 5 == 0}
