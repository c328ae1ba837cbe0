"""Chosen rows and reused results against a walk through the rows in order."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import chains, telemetry as tm


def walk(times, gap):
    last, out = None, []
    for t in sorted(set(times)):
        if last is None or last + gap <= t:
            last = t
            out.append(t)
    return out


@pytest.mark.parametrize("seed, span", [(1, 40), (2, 400), (3, 20_000)])
def test_chosen_times_equal_a_walk(spark, seed, span):
    draw = random.Random(seed)
    rows = [(k, draw.choice("xy"), float(draw.randrange(span))) for k in ("a", "b", None) for _ in range(150)] + [("one", "x", 5.0)] * 3
    frame = spark.createDataFrame(rows, "k string, j string, at double")
    got = sorted(map(tuple, chains.chosen(frame, ["k", "j"], "at", 15.0).collect()), key=str)
    keys = {r[:2] for r in rows}
    assert got == sorted(((*k, t) for k in keys for t in walk([r[2] for r in rows if r[:2] == k], 15.0)), key=str)


def test_one_key_with_all_rows_spreads(spark):
    frame = spark.range(60_000).select(F.lit("hot").alias("k"), F.col("id").cast("double").alias("at"))
    found = chains.successors(frame, ["k"], "at", 10.0)
    assert found.filter("next != at + 10").count() == 0
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else so few rows go to one task anyway
    try:
        rows = chains.successors(frame, ["k"], "at", 10.0).groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert max(r["count"] for r in rows) < 30_000
    assert chains.chosen(frame, ["k"], "at", 10.0).count() == 6_000


def test_cool_down_stays_in_the_engine(spark):
    fired = spark.createDataFrame([("cpu", 60.0 * m, f"m{m}") for m in range(0, 200, 7)] + [(None, 0.0, "n")], "rule_id string, at double, message string")
    out = tm.cooled_down(fired, ["rule_id"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
    assert [r.message for r in out.filter("rule_id = 'cpu'").orderBy("at").collect()] == [f"m{int(t)}" for t in walk(range(0, 200, 7), 15)]
    assert out.filter("rule_id is null").count() == 1
    assert tm.cooled_down(fired.limit(0), ["rule_id"]).count() == 0


def test_reused_results(spark):
    draw = random.Random(4)
    rows = [(i, draw.choice(["a", "b", None]), float(draw.randrange(900))) for i in range(300)]
    frame = spark.createDataFrame(rows, "ident bigint, hash string, at double")
    got = {r.ident: r.reuse_of for r in chains.reused(frame, "hash", "at", "ident", 50.0).collect()}
    want = {}
    for k in ("a", "b", None):
        holder = last = None
        for i, _, t in sorted((r for r in rows if r[1] == k), key=lambda r: (r[2], r[0])):
            if last is None or last + 50.0 <= t:
                holder, last = i, t
            want[i] = None if holder == i else holder
    assert got == want


def test_levels_of_a_dense_chain_shrink(spark, monkeypatch):
    """Rows that share a successor run together, so later levels read ever fewer rows, not all of them in each round."""
    draw = random.Random(6)
    rows = [("hot", float(t)) for t in sorted(draw.sample(range(200_000), 4_000))]
    sizes, pin = [], chains.pin

    def counted(df):
        out = pin(df)
        if "next" in out.columns:
            sizes.append(out.count())
        return out

    monkeypatch.setattr(chains, "pin", counted)
    got = sorted(r["at"] for r in chains.chosen(spark.createDataFrame(rows, "k string, at double"), ["k"], "at", 1_000.0).collect())
    assert got == walk([t for _, t in rows], 1_000.0)
    assert sum(sizes) < 6 * len(rows)
