import re
from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import simhash as S
from tidemark.llm.components import components
from tests.llm.frames import awkward, documents, empty, lower


def fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text or ""))
    grams = [" ".join(w[i:i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def brute(rows):
    """(doc_id, fingerprint, component) of every row, by all pairs."""
    prints = [fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))
    find = lambda i: i if root[i] == i else find(root[i])
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[find(i)] = min((x for x in (least.get(find(i)), doc) if x is not None), default=None)
    return Counter((doc, f"{prints[i]:016x}", least[find(i)]) for i, (doc, _) in enumerate(rows))


def got(frame):
    return Counter((r.doc_id, r.fingerprint, r.component_id) for r in frame.collect())


def test_near_copies_match_brute_force(spark):
    draw = np.random.default_rng(1)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for base in range(6):
        words = [vocabulary[i] for i in draw.integers(0, 400, 300)]
        for copy in range(8):
            changed = list(words)
            for at in draw.integers(0, 300, copy // 2):
                changed[at] = vocabulary[draw.integers(0, 400)]
            rows.append((1000 - len(rows), " ".join(changed)))
    rows += [(5000 + i, f"alone {i} x {i * i}") for i in range(20)]
    assert got(S.near_duplicates(documents(spark, rows))) == brute(rows)


def test_awkward_rows(spark):
    rows = [(r.doc_id, r.text) for r in awkward(spark).collect()]
    assert got(S.near_duplicates(awkward(spark))) == brute(rows)
    assert S.near_duplicates(empty(spark)).count() == 0


def test_quadruples_avoid_any_three_bytes():
    sets = [set(q) for q in S.quadruples()]
    assert len(sets) == 14
    for a in range(8):
        for b in range(8):
            for c in range(8):
                assert any(not {a, b, c} & s for s in sets)


def test_midpoints_give_the_components_of_all_pairs():
    draw = np.random.default_rng(2)
    for spread in (8, 14):
        values = np.unique(np.uint64(0xABCD << 40) ^ draw.integers(0, 1 << spread, 300).astype(np.uint64))
        assert (S._roots(S._pairs(values), len(values)) == S._roots(S._midpoints(values), len(values))).all()


def test_long_lists_take_the_other_way_with_the_same_result(spark):
    rows = [(i, f"shared shared shared {'x ' * (i % 5)}") for i in range(40)]
    whole = got(S.near_duplicates(documents(spark, rows)))
    assert got(S.near_duplicates(documents(spark, rows), pairwise=2)) == whole


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(7, x) for x in range(8, 60)] + [(59, 58), (500, 501), (3, 3)]
    found = {r.node: r.root for r in components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert found == {**{i: 100 for i in range(100, 141)}, **{i: 7 for i in range(7, 60)}, 500: 500, 501: 500}
    assert components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def test_keep_one_keeps_smallest_id(spark, tmp_path):
    path = str(tmp_path / "docs.parquet")
    documents(spark, [(9, "a b c d e"), (2, "a b c d e"), (5, "other words stand here"), (5, "other words stand here"), (None, "a b c d e")]
              ).repartition(3).write.parquet(path)
    docs = spark.read.parquet(path)
    kept = S.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [2, 5]


def test_members_of_very_long_lists_are_dealt_out_with_the_same_result(spark):
    draw = np.random.default_rng(5)
    near = np.unique(np.uint64(0xABCD << 40) ^ draw.integers(0, 1 << 10, 150).astype(np.uint64))
    far = draw.integers(0, 1 << 63, 60).astype(np.uint64)
    values = np.unique(np.r_[near, far])
    prints = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "fp bigint").repartition(5)
    root = S._roots(S._pairs(values), len(values))
    groups = {}
    for i, r in enumerate(root):
        groups.setdefault(r, set()).add(int(values[i].view(np.int64)))
    want = sorted(map(sorted, (g for g in groups.values() if len(g) > 1)))
    for batch, bounds in (("97", ((16, 40), (2, 2))), ("10000", ((16, 1 << 14), (16, 40)))):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        for pairwise, in_task in bounds:
            links = S.linked(prints, pairwise, in_task).collect()
            found = {}
            for r in components(spark.createDataFrame(links, "u bigint, v bigint")).collect():
                found.setdefault(r.root, set()).add(r.node)
            assert sorted(map(sorted, found.values())) == want
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")


def test_a_hub_is_dealt_over_tasks(spark):
    from tidemark.llm import components as C
    edges = spark.range(1, 20_001).selectExpr("0 AS u", "id AS v")
    sizes = [r["count"] for r in C._with_least(edges).groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 20_000
    assert {(r.root, r.n) for r in components(edges).groupBy("root").agg(F.count("*").alias("n")).collect()} == {(0, 20_001)}
    before = spark.conf.get("spark.sql.adaptive.enabled"), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    dealt = [r["count"] for r in C._with_least(edges).groupBy(F.spark_partition_id()).count().collect()]
    for name, value in zip(("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold"), before):
        spark.conf.set(name, value)
    assert len(dealt) == 8 and max(dealt) < 20_000 * 0.3
