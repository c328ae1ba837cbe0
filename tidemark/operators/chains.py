"""Chains through time: rows that are chosen because the last chosen one is old enough.

Alerts with a cool-down and results that are reused for a while depend on the last row that was *chosen*, not on the last row. Each row
has one successor, the first row at least the gap later, so the chosen rows are those that successors reach from a first row.
They are found by pointer doubling on ever fewer rows: two steps of a chain become one, and only the first rows and those that two steps reach
are needed for it. Rows that share a successor run together, so the next level has about half as many rows, and all levels of a dense
chain cost a few joins of the first one. On the way back every level adds the rows that one step of it reaches. No key is
ever gathered in one place.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ranking import asof_join, null_safe_join, rolling, with_chunks
from tidemark.sources.tables import pin

KEY = "_key"


def successors(rows: DataFrame, keys: Sequence[str], at: str, gap: float) -> DataFrame:
    """(_key, at, next, head) of distinct (keys, at): the first time at least ``gap`` later, and whether the time before is so far off.

    A row behind such a silence, or the first of its key, is chosen whatever came before it.
    """
    nodes = pin(rows.select(F.struct(*keys).alias(KEY), F.col(at).cast("double").alias("at")).distinct())
    ahead = nodes.select(KEY, "at", (-(F.col("at") + gap)).alias("minus"))
    found = asof_join(ahead, nodes.select(KEY, (-F.col("at")).alias("minus")), KEY, "minus", [], tie="minus")
    before = rolling(with_chunks(nodes, [KEY], "at"), [KEY], ["at"], 1, {
        "head": lambda w: F.lag("at").over(w).isNull() | (F.lag("at").over(w) + gap <= F.col("at"))})
    return found.select(KEY, "at", (-F.col("matched_minus")).alias("next")).join(before.select(KEY, "at", "head"), [KEY, "at"])


def chosen(rows: DataFrame, keys: Sequence[str], at: str, gap: float) -> DataFrame:
    """(keys, at) of the chosen rows: the first of a key, then always the first at least ``gap`` after the last chosen one."""
    found = pin(successors(rows, keys, at, gap))
    heads = found.filter("head").select(KEY, "at")
    # a head is chosen anyway, so no chain is followed into one
    steps = found.filter("next is not null").select(KEY, "at", "next", "head")
    steps = pin(steps.join(heads.select(KEY, F.col("at").alias("next")), [KEY, "next"], "left_anti").select(KEY, "at", "next", "head"))
    levels = []
    while not steps.isEmpty():
        levels.append(steps)
        onward = steps.select(KEY, F.col("at").alias("next"), F.col("next").alias("after"))
        pairs = pin(steps.join(onward, [KEY, "next"]).select(KEY, "at", F.col("after").alias("next"), "head"))
        met = pairs.select(KEY, F.col("next").alias("at")).distinct()
        steps = pin(pairs.filter("head").union(pairs.filter("not head").join(met, [KEY, "at"], "left_semi")))
    marked = heads
    for steps in reversed(levels):
        marked = pin(marked.union(marked.join(steps, [KEY, "at"]).select(KEY, F.col("next").alias("at"))).distinct())
    return marked.select(F.col(f"{KEY}.*"), F.col("at").alias(at))


def keep_chosen(rows: DataFrame, keys: Sequence[str], at: str, gap: float) -> DataFrame:
    """``rows`` at the chosen times."""
    times = chosen(rows, keys, at, gap)
    return null_safe_join(rows.withColumn("_at", F.col(at).cast("double")), times.withColumnRenamed(at, "_at"), [*keys, "_at"]).drop("_at")


def reused(requests: DataFrame, key: str, at: str, ident: str, ttl: float) -> DataFrame:
    """``requests`` with ``reuse_of``: the earlier request of the same content whose computed result answers it, null if it is computed.

    A result answers for ``ttl`` after it was computed; answers from it do not prolong its life. Of requests at one time the
    smallest ``ident`` is computed and the others reuse its result.
    """
    times = chosen(requests, [key], at, ttl).select(key, F.col(at).alias("_at"))
    holders = null_safe_join(requests.select(key, F.col(at).cast("double").alias("_at"), F.col(ident).alias("holder")), times, [key, "_at"])
    results = holders.groupBy(key, "_at").agg(F.min("holder").alias("holder"))
    matched = asof_join(requests.withColumn("_at", F.col(at).cast("double")), results.withColumn(ident, F.col("holder")), key, "_at", ["holder"], tie=ident)
    holder = F.col("matched_holder")
    return matched.select(*requests.columns, F.when(holder != F.col(ident), holder).alias("reuse_of"))
