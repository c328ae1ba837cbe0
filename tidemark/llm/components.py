"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.sources.tables import pin


#: Parts that a hub's rows are dealt into, by their other end.
PARTS = 64


def _with_least(edges: DataFrame) -> DataFrame:
    """(u, v, m): each edge with the smallest v of its u. A hub's edges lie in ``PARTS`` parts; only the parts' minima meet."""
    dealt = edges.select("u", "v", F.pmod(F.xxhash64("v"), F.lit(PARTS)).cast("int").alias("part"))
    parts = dealt.groupBy("u", "part").agg(F.min("v").alias("m"))
    least = parts.groupBy("u").agg(F.min("m").alias("m"), F.collect_set("part").alias("parts"))  # at most PARTS numbers a node
    return dealt.join(least.select("u", "m", F.explode("parts").alias("part")), ["u", "part"]).select("u", "v", "m")


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the smallest node around it."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_least(both).filter("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).filter("u != v")


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    near = _with_least(down)
    return near.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").union(near.select("u", F.col("m").alias("v")))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of an edge; root is the smallest node reachable.

    ``edges`` has two comparable columns u and v; loops and repeated edges do no harm. Each round is
    written to the checkpoint folder, so a lost executor costs one round. No step gathers a component:
    minima combine before the shuffle, and a hub's rows meet its minimum in ``PARTS`` parts.
    """
    current, before = pin(edges.filter("u != v").distinct()), None
    while True:
        state = current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            return current.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
                current.select(F.col("v"), F.col("v")).distinct())
        before = state
        current = pin(_small_star(_large_star(current)).distinct())
