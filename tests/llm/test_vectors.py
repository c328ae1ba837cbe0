import math

import numpy as np

from tidemark.llm import vectors as V


def brute(rows, k=20, every=20):
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (q, x) in enumerate(kept):
        if q is None or q % every:
            continue
        scored = [(-sum(p * r for p, r in zip(x, y)), i is None, i or 0, i) for b, (i, y) in enumerate(kept) if b != a]
        out += [(q, n, i, -s) for n, (s, _, _, i) in enumerate(sorted(scored, key=lambda t: t[:3])[:k], 1)]
    return sorted(out, key=str)


def got(spark, rows, **kw):
    frame = spark.createDataFrame([(i, v, 1, "c", 2) for i, v in rows], "vec_id bigint, embedding array<float>, label int, cell string, uid int").repartition(3)
    return sorted((tuple(r) for r in V.nearest(frame, **kw).select("query_id", "rank", "vec_id", "score").collect()), key=str)


def single(rows):
    return [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]


def test_random_vectors_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(V, "BLOCK", 50)  # several blocks of a cell
    monkeypatch.setattr(V, "QUERIES", 4)
    draw = np.random.default_rng(4)
    rows = single([(i, (draw.normal(0, 1 + i % 3, 12)).tolist()) for i in range(600)])
    assert got(spark, rows) == brute(rows)


def test_ties_copies_and_odd_vectors(spark):
    rows = [(i, [1.0, 0.5, -0.25]) for i in range(60)] + [(100, None), (120, [1.0, None, 2.0]), (140, [float("nan"), 1.0, 1.0]),
            (160, [float("inf"), 1.0, 1.0]), (20, [1.0, 0.5, -0.25]), (None, [1.0, 0.5, -0.25]), (180, []), (200, [0.5]), (220, [-0.001, 3.0, 1.0])]
    assert [r for r in got(spark, rows) if r[0] != 20] == [r for r in brute(rows) if r[0] != 20]
    twice = [r for r in got(spark, rows) if r[0] == 20]  # a repeated id is two queries
    assert len(twice) == 40


def test_large_values_stay_exact(spark):
    rows = single([(i, [1e6 + i, -3e5 * i]) for i in range(40)])
    assert got(spark, rows) == brute(rows)


def test_few_or_no_rows(spark):
    assert got(spark, [(0, [1.0])]) == []
    assert got(spark, []) == []
    assert got(spark, [(0, [1.0]), (1, [2.0])]) == brute([(0, [1.0]), (1, [2.0])])


def test_bounds_never_cut_a_better_vector():
    draw = np.random.default_rng(1)
    vectors = draw.integers(-100, 100, (500, 6))
    index = V.Index(6, False, float((vectors ** 2).sum(axis=1).max()), np.zeros((0, 7)), np.zeros(0, int), np.zeros(0), np.zeros(0))
    points = index.lengthened(vectors)
    pivots = V._far_apart(points, 8)
    far = np.sqrt(((points[:, None] - pivots[None]) ** 2).sum(axis=2))
    of = far.argmin(axis=1)
    low = np.array([far[of == p, p].min() if (of == p).any() else 0 for p in range(len(pivots))])
    high = np.array([far[of == p, p].max() if (of == p).any() else 0 for p in range(len(pivots))])
    index = V.Index(6, False, index.radius2, pivots, np.arange(len(pivots)) * V.ANNULI, low, high)
    queries = draw.integers(-100, 100, (40, 6))
    bound = index.most_score(queries)
    for p in range(len(pivots)):
        if (of == p).any():
            assert ((queries @ vectors[of == p].T).max(axis=1) <= bound[:, p]).all()
