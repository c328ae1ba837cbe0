"""Merkle manifest of a dataset, with proofs by a butterfly exchange.

Every row is a leaf. Leaves of one group (source) stand in the order of their ids, and every ``FANOUT`` consecutive nodes become
one, level by level, until one node, the group's subroot, is left; subroots in the order of their groups become the root in the
same way. The proof of a leaf is the siblings on its way to the root.

Leaves get their places from one sort over range partitions and the sizes of their segments (a row for each range partition and
group). They are dealt to aligned blocks of ``FANOUT ** LEVELS`` leaves, the partitions of the exchange; a block hashes its own
subtree. Then, round by round, blocks whose numbers differ in one digit of base ``FANOUT`` alone swap their subtree roots in groups
of at most ``FANOUT``, and each hashes the same parent again, so that after the last round every block holds the subroot and all
upper siblings, and nothing is sent down the tree again. Rounds over the groups' numbers go on in the same way; block k of
each group takes part in lane k, and a group of few blocks serves several lanes. No exchange group has more than ``FANOUT`` members,
whatever share of the rows one source holds, and every round is written to the checkpoint folder.

Defined cases: null values are ``-`` in a leaf; a null group is a group of its own and comes first; null ids come first in their
group; rows with the same id are ordered by their leaf, so that repeated rows give equal leaves side by side, with a proof each; a
long text is hashed where it is read and goes no further; an empty table has no rows; columns beside the five hashed ones are not
read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.registry import query
from tidemark.sources.tables import pin, table

FANOUT = 16
#: Levels of the tree inside a block: blocks of 4,096 leaves.
LEVELS = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(parts: Column) -> Column:
    """Hash of an array of strings, concatenated."""
    return F.sha2(F.array_join(parts, ""), 256)


def leaf(values: dict[str, Column]) -> Column:
    """Hash of named values, each with its length in front."""
    def framed(value: Column) -> Column:
        text = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return digest(F.array(*[framed(v) for v in values.values()]))


def leaves(docs: DataFrame, tampered: Column | None = None, fields: Sequence[str] = FIELDS) -> DataFrame:
    """(id, source, leaf, tampered) of documents; ``tampered`` is the leaf of a row that was changed afterwards, null where it was not."""
    values = {c: F.col(c) for c in fields}
    other = F.lit(None).cast("string") if tampered is None else tampered
    return docs.select(F.col("doc_id").cast("bigint").alias("id"), F.col("source").cast("string").alias("source"),
                       leaf(values).alias("leaf"), other.alias("tampered"))


def lower_cased(every: int = 5, fields: Sequence[str] = FIELDS) -> Column:
    """Leaf after A-Z of the text were lower-cased, for rows whose id has a crc32 that ``every`` divides."""
    values = {c: F.col(c) for c in fields} | {"text": F.translate(F.col("text"), ascii_uppercase, ascii_lowercase)}
    return F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % every == 0, leaf(values))


def _segments(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows in order with their range partition (part) and running number (at); and per (part, source): first and rows."""
    order = ["source", "id", "leaf", "tie"]
    numbered = pin(rows).withColumn("tie", F.monotonically_increasing_id())
    ordered = pin(numbered.repartitionByRange(*order).sortWithinPartitions(*order)
                  .select("id", "source", "leaf", "tampered", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")))
    return ordered, pin(ordered.groupBy("part", "source").agg(F.min("at").alias("first"), F.count("*").alias("rows")))


def _sources(segments: DataFrame) -> DataFrame:
    """(source, index, leaves, count): place of each source in their order, leaves it has, and sources there are."""
    each = segments.groupBy("source").agg(F.sum("rows").alias("leaves"))
    ordered = pin(each.repartitionByRange("source").sortWithinPartitions("source")
                  .select("source", "leaves", F.spark_partition_id().alias("range"), F.monotonically_increasing_id().alias("place")))
    parts = ordered.groupBy("range").agg(F.min("place").alias("start"), F.count("*").alias("held"))
    # One row for each range partition: their number is set by the cluster, not by the data.
    before = F.coalesce(F.sum("held").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("held").over(Window.partitionBy())
    starts = parts.select("range", "start", before.alias("before"), total.alias("count"))
    return ordered.join(starts, "range").select("source", (F.col("place") - F.col("start") + F.col("before")).alias("index"), "leaves", "count")


def _up(nodes: Column) -> Column:
    """The level above: one digest for every ``FANOUT`` nodes."""
    runs = F.sequence(F.lit(1), F.size(nodes), F.lit(FANOUT))
    return F.transform(runs, lambda start: digest(F.slice(nodes, start, FANOUT)))


def blocks(rows: DataFrame) -> DataFrame:
    """Aligned blocks: (index, block, leaves, blocks, count, held, levels, root).

    ``index`` numbers the source, ``block`` the block in it; ``held`` has (at, id, leaf, tampered) in order; ``levels`` the nodes of
    each level under the block's root, as far as the source's tree has several there.
    """
    ordered, segments = _segments(rows)
    sources = _sources(segments)
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = segments.select("part", "source", "first", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("offset"))
    same = offsets["source"].eqNullSafe(sources["source"])
    placed = offsets.join(sources, same).select("part", offsets["source"].alias("of"), "first", "offset", "index", "leaves", "count")
    at = (F.col("at") - F.col("first") + F.col("offset")).alias("at")
    whole = FANOUT ** LEVELS
    dealt = (ordered.join(placed.withColumnRenamed("part", "in"), (F.col("part") == F.col("in")) & F.col("source").eqNullSafe(F.col("of")))
             .select("index", "leaves", "count", at, "id", "leaf", "tampered").withColumn("block", F.floor(F.col("at") / whole)))
    held = F.sort_array(F.collect_list(F.struct("at", "id", "leaf", "tampered")))
    out = (dealt.groupBy("index", "block", "leaves", "count").agg(held.alias("held"))
           .withColumn("blocks", F.ceil(F.col("leaves") / whole)).withColumn("level0", F.col("held.leaf")))
    for k in range(LEVELS):
        here = F.col(f"level{k}")
        out = out.withColumn(f"level{k + 1}", F.when(F.col("leaves") > FANOUT ** k, _up(here)).otherwise(here))
    levels = F.array(*[F.when(F.col("leaves") > FANOUT ** k, F.col(f"level{k}")) for k in range(LEVELS)])
    root = F.col(f"level{LEVELS}")[0]
    return out.select("index", "block", "leaves", "blocks", "count", "held", F.filter(levels, F.isnotnull).alias("levels"), root.alias("root"))


def _swap(units: DataFrame, tree: list[str], place: str, size: str, span: int, lanes: DataFrame | None) -> DataFrame:
    """One round: units whose ``place`` differs in one digit swap roots, hash their parent and lengthen their paths.

    Trees are told apart by ``tree``; ``size`` is the tree's number of places and ``span`` what the digit counts. A subtree at
    the end that is not full has too few places to meet all others, so its units stand in for the missing ones. ``lanes``
    has the lanes of each (high, to) where places have several units, told apart by ``block``.
    """
    step = F.lit(span).cast("bigint")
    high, low = F.floor(F.col(place) / (span * FANOUT)), F.col(place) % span
    digit = F.floor(F.col(place) / span) % FANOUT
    short = F.least(step, F.col(size) - (high * FANOUT + digit) * span)
    to = F.when((digit > 0) & (short < span), F.sequence(low, step - 1, short)).otherwise(F.array(low))
    sent = (units.withColumns({"high": high, "low": low, "digit": digit.cast("int")}).withColumn("to", F.explode(to)))
    if lanes is None:
        sent = sent.withColumn("lane", F.lit(0).cast("bigint"))
        own = F.col("to") == F.col("low")
    else:
        reach = F.when(F.col("block") < F.col("width"), F.sequence(F.col("block"), F.col("width") - 1, F.col("blocks"))).otherwise(F.array().cast("array<bigint>"))
        sent = sent.join(lanes, ["high", "to"]).withColumn("lane", F.explode(reach)).drop("width")
        own = (F.col("to") == F.col("low")) & (F.col("lane") == F.col("block"))
    state = F.when(own, F.struct(*units.columns))
    met = (sent.groupBy(*tree, "high", "to", "lane")
           .agg(F.sort_array(F.collect_list(F.struct("digit", "root", state.alias("unit")))).alias("met"))
           .select(F.col("met.root").alias("roots"), F.explode("met").alias("one")).filter("one.unit is not null"))
    left = F.array_join(F.slice("roots", 1, F.col("one.digit")), "")
    right = F.array_join(F.slice("roots", F.col("one.digit") + 2, FANOUT), "")
    kept = [F.col(f"one.unit.{c}").alias(c) for c in units.columns if c not in ("root", "path")]
    path = F.concat(F.col("one.unit.path"), F.array(F.struct(left.alias("left"), right.alias("right"))))
    return met.select(*kept, digest(F.col("roots")).alias("root"), path.alias("path"))


def exchange(units: DataFrame) -> DataFrame:
    """(index, block, subroot, root, path) of blocks (index, block, blocks, count, root).

    ``path`` has the siblings (left, right) of each level from the block's root to the root of all.
    """
    start = F.array().cast("array<struct<left:string,right:string>>")
    units = pin(units.select("index", "block", "blocks", "count", "root", start.alias("path")))
    most = units.agg(F.max("blocks").alias("blocks"), F.max("count").alias("sources")).first()
    span = 1
    while span < (most["blocks"] or 0):
        done, open_ = units.filter(F.col("blocks") <= span), units.filter(F.col("blocks") > span)
        units = pin(done.unionByName(_swap(open_, ["index"], "block", "blocks", span, None)))
        span *= FANOUT
    units = units.withColumn("subroot", F.col("root"))
    span = 1
    while span < (most["sources"] or 0):
        width = F.max("blocks").alias("width")
        high, to = F.floor(F.col("index") / (span * FANOUT)).alias("high"), (F.col("index") % span).alias("to")
        lanes = units.filter("block = 0").groupBy(high, to).agg(width)
        units = pin(_swap(units, [], "index", "count", span, lanes))
        span *= FANOUT
    return units.select("index", "block", "subroot", "root", "path")


def manifest(rows: DataFrame) -> DataFrame:
    """Of leaves (id, source, leaf, tampered): (id, leaf, subroot, root, proof array<(left, right)>, folded).

    ``proof`` has the siblings left and right of each level up to the root. ``folded`` is the root that the proof gives for the
    tampered leaf, or for the leaf itself where that is null.
    """
    own = pin(blocks(rows))
    upper = exchange(own).withColumnsRenamed({"root": "top"})
    joined = own.drop("root", "leaves", "blocks", "count").join(upper, ["index", "block"])

    def siblings(level: Column, at: Column) -> Column:
        start = F.floor(at / FANOUT) * FANOUT
        here = (at - start).cast("int")
        return F.struct(F.array_join(F.slice(level, (start + 1).cast("int"), here), "").alias("left"),
                        F.array_join(F.slice(level, (at + 2).cast("int"), F.lit(FANOUT - 1) - here), "").alias("right"))

    def inside(at: Column) -> Column:
        return F.transform("levels", lambda level, k: siblings(level, F.floor(at / F.pow(F.lit(FANOUT), k))))

    proven = F.transform("held", lambda x, at: F.struct(
        x["id"].alias("id"), x["leaf"].alias("leaf"), x["tampered"].alias("tampered"), F.concat(inside(at), F.col("path")).alias("proof")))
    out = joined.select("subroot", F.col("top").alias("root"), F.inline(proven))
    fold = F.aggregate("proof", F.coalesce("tampered", "leaf"), lambda node, s: F.sha2(F.concat(s["left"], node, s["right"]), 256))
    return out.select("id", "leaf", "subroot", "root", "proof", fold.alias("folded"))


def proof_digest(proof: Column) -> Column:
    """Hash of all siblings, level by level, left to right."""
    return digest(F.transform(proof, lambda s: F.concat(s["left"], s["right"])))


_SQL = f"""
WITH RECURSIVE
tab AS (SELECT list(v ORDER BY i) AS t FROM (
  SELECT i, list_reduce([i::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0], lambda x, b: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) AS v
  FROM range(256) AS r(i))),
docs AS (
  SELECT *, CASE WHEN xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ord(c)::BIGINT),
                                      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 5 = 0
            THEN translate(text, '{ascii_uppercase}', '{ascii_lowercase}') ELSE text END AS altered
  FROM documents, tab),
leaves AS (
  SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
         sha256(head || coalesce(strlen(altered) || ':' || altered, '-')) AS other
  FROM (SELECT *, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
               || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head FROM docs)),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n,
         dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree
  FROM leaves),
low(tree, level, pos, h, n) AS (
  SELECT tree, 0, pos, leaf, n FROM placed
  UNION ALL
  SELECT tree, level + 1, pos // {FANOUT}, sha256(string_agg(h, '' ORDER BY pos)), (n + {FANOUT - 1}) // {FANOUT}
  FROM low WHERE n > 1 GROUP BY tree, level, pos // {FANOUT}, n),
subroots AS (SELECT tree, h AS subroot, count(*) OVER () AS n FROM low WHERE n = 1),
top(level, pos, h, n) AS (
  SELECT 0, tree, subroot, n FROM subroots
  UNION ALL
  SELECT level + 1, pos // {FANOUT}, sha256(string_agg(h, '' ORDER BY pos)), (n + {FANOUT - 1}) // {FANOUT}
  FROM top WHERE n > 1 GROUP BY level, pos // {FANOUT}, n),
low_kin AS (
  SELECT tree, level, pos, coalesce(string_agg(h, '') OVER (b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
         coalesce(string_agg(h, '') OVER (b ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
  FROM low WHERE n > 1 WINDOW b AS (PARTITION BY tree, level, pos // {FANOUT} ORDER BY pos)),
top_kin AS (
  SELECT level, pos, coalesce(string_agg(h, '') OVER (b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
         coalesce(string_agg(h, '') OVER (b ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
  FROM top WHERE n > 1 WINDOW b AS (PARTITION BY level, pos // {FANOUT} ORDER BY pos)),
low_way(tree, leaf_pos, level, pos, node, proof) AS (
  SELECT tree, pos, 0, pos, other, '' FROM placed
  UNION ALL
  SELECT w.tree, leaf_pos, w.level + 1, w.pos // {FANOUT}, sha256(l || node || r), proof || l || r FROM low_way w JOIN low_kin k USING (tree, level, pos)),
top_way(tree, leaf_pos, level, pos, node, proof) AS (
  SELECT tree, leaf_pos, 0, tree, arg_max(node, level), arg_max(proof, level) FROM low_way GROUP BY tree, leaf_pos
  UNION ALL
  SELECT w.tree, leaf_pos, w.level + 1, w.pos // {FANOUT}, sha256(l || node || r), proof || l || r FROM top_way w JOIN top_kin k USING (level, pos)),
way AS (SELECT tree, leaf_pos, arg_max(node, level) AS node, arg_max(proof, level) AS proof FROM top_way GROUP BY tree, leaf_pos)
SELECT p.doc_id, p.leaf, s.subroot, t.h AS root, sha256(w.proof) AS proof_sha256, w.node AS folded_root, w.node = t.h AS verified
FROM placed p JOIN way w ON w.tree = p.tree AND w.leaf_pos = p.pos JOIN subroots s ON s.tree = p.tree JOIN top t ON t.n = 1
"""


@query("op11_merkle", _SQL)
def merkle(spark: SparkSession, directory: str) -> DataFrame:
    """Leaf, roots and proof of every document, and whether it still verifies after tampering."""
    docs = table(spark, directory, "documents")
    rows = manifest(leaves(docs, lower_cased()))
    return rows.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"),
                       F.col("folded").alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"))
