"""Exact ranks, running totals and rolling windows that survive a hot key.

A plain ``Window.partitionBy(key).orderBy(v)`` sends every row of a key to one
task.  The functions here find the hot keys, cut those into order-preserving
*chunks* at approximate quantiles, run the window inside ``(key, chunk)`` and add
what the earlier chunks contribute from a tiny per-chunk table, so the result is
exact and a key holding a third of the data is spread over many tasks.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.tables import pin

CHUNK = "_chunk"
HALO = "_halo"
#: Keys that a caller may declare to be a fixed list.
MOST_KEYS = 10_000
GROUP = "_group"
#: Rows of all keys together that plain windows may rank.
FEW_ROWS = 1_000_000


def _chunk_count(df: DataFrame, chunks: int | None) -> int:
    """Chunks that all rows together are cut into: one per shuffle partition."""
    return max(4, chunks or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


class Hot(dict):
    """Hot keys: hash of the key to its rows (an upper estimate); ``total`` counts all rows."""

    def __init__(self, counts: dict[int, int], total: int):
        super().__init__(counts)
        self.total = total

    def pieces(self, hashed: Column, partitions: int) -> Column:
        """Partitions' worth of rows that a key holds, 1 for keys that are not hot."""
        if not self:
            return F.lit(1)
        wanted = F.create_map(*[F.lit(x) for h, n in sorted(self.items()) for x in (h, -(-n * partitions // max(self.total, 1)))])
        return F.coalesce(F.try_element_at(wanted, hashed), F.lit(1))


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` where NULL keys match each other; keeps left's keys."""
    renamed = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys],
                           *[c for c in right.columns if c not in keys])
    cond = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys])
    return left.join(renamed, cond, how).drop(*[f"_r_{k}" for k in keys])


def hot_groups(df: DataFrame, keys: Sequence[str]) -> Hot:
    """Hashes of the keys that hold more than a fair task's share of the rows, with their counts.

    One aggregate over a fixed-size frequency sketch.  At most ``1 / share``
    keys can be that frequent, so the list that comes to the driver is bounded
    by twice the partition count whatever the data.
    """
    fair = _chunk_count(df, None)
    hashed = df.select(_hash(keys).alias("_keyhash"))
    row = hashed.agg(F.expr(f"approx_top_k(_keyhash, {2 * fair}, {max(20 * fair, 10_000)})").alias("top"),
                     F.count("*").alias("n")).first()
    return Hot({t["item"]: t["count"] for t in row["top"] or [] if t["count"] * fair > row["n"]}, row["n"])


def with_chunks(df: DataFrame, keys: Sequence[str], by: str, *, chunks: int | None = None,
                bounded_keys: bool = False, hot: Hot | None = None, then: str | None = None) -> DataFrame:
    """Add ``_chunk``: rows with a larger ``by`` never sit in a smaller chunk of their key.

    A key is cut into as many chunks as it holds partitions' worth of rows, so there are about as many chunks
    as partitions in all.  Which keys are cut: all of them if ``bounded_keys`` states that they come
    from a fixed list (features, tasks, models named by the caller; more than ``MOST_KEYS`` raise), otherwise
    only the hot ones, found first; every other key is one chunk.  Either way
    the split table has a bounded size and is broadcast, and it is written out once, so that all parts
    of a plan, and tasks run again after a loss, see the same cuts.

    ``hot`` passes in the hot keys where they are known already.  ``then`` is the numeric column that orders equal
    ``by``: a value filling whole chunks by itself is cut further along it.
    """
    n = _chunk_count(df, chunks)
    cuts = [i / n for i in range(1, n)]
    value = F.col(by).cast("double")
    hashed = df.withColumn("_keyhash", _hash(keys))
    cut = hashed
    if not bounded_keys and keys:
        hot = hot_groups(df, keys) if hot is None else hot
        if not hot:     # noted in the column's metadata: plain windows are enough
            return df.select("*", F.lit(0).alias(CHUNK, metadata={"single": True}))
        cut = hashed.filter(F.col("_keyhash").isin(list(hot)))
    found = cut.groupBy("_keyhash").agg(F.percentile_approx(value, cuts, 20 * n).alias("_all"), F.count("*").alias("_rows"))
    splits = pin(_thinned(found, n, hot.total if hot else None))
    if bounded_keys and splits.count() > MOST_KEYS:
        raise ValueError(f"more than {MOST_KEYS} keys; leave bounded_keys out")
    tagged = hashed.join(F.broadcast(splits), "_keyhash", "left")
    # two short scans instead of one long one: the coarse cuts, then those between two of them
    tagged = tagged.withColumn("_coarse", F.size(F.filter("_coarse_splits", lambda s: s <= value)))
    fine = F.size(F.filter(F.slice("_splits", F.col("_coarse") * F.col("_stride") + 1, F.col("_stride")), lambda s: s <= value))
    number = F.when(F.col("_splits").isNotNull(), F.greatest(F.lit(0), F.col("_coarse") * F.col("_stride") + fine))
    tagged = tagged.withColumn(CHUNK, F.coalesce(number, F.lit(0)).cast("bigint"))
    if then is not None and not (bounded_keys or not keys):
        tagged = _cut_ties(tagged, splits, value, F.col(then).cast("double"), cuts)
    return tagged.select(*df.columns, CHUNK)


def _thinned(found: DataFrame, n: int, total: int | None) -> DataFrame:
    """As many of a key's ``n - 1`` cuts as its share of the rows asks for, with every ``_stride``-th kept apart."""
    rows = F.lit(total) if total else F.sum("_rows").over(Window.partitionBy())  # one row per listed key
    pieces = F.greatest(F.lit(2), F.least(F.lit(n), F.ceil(F.col("_rows") * n / rows))).cast("int")
    step = F.greatest(F.lit(1), F.floor(F.lit(n) / pieces)).cast("int")
    out = found.withColumn("_step", step).withColumn("_splits", F.filter("_all", lambda s, i: (i + 1) % F.col("_step") == 0))
    out = out.withColumn("_stride", F.greatest(F.lit(1), F.ceil(F.sqrt(F.size("_splits")))).cast("int"))
    coarse = F.filter("_splits", lambda s, i: i % F.col("_stride") == F.col("_stride") - 1)
    return out.select("_keyhash", "_splits", coarse.alias("_coarse_splits"), "_stride")


def _cut_ties(tagged: DataFrame, splits: DataFrame, value: Column, then: Column, cuts: list[float]) -> DataFrame:
    """Cut chunks that start with one value filling at least a whole chunk.

    Such a value shows as a repeated split.  Its rows are cut along ``then``; larger
    values of the same chunk follow behind them.  At most half as many values
    per key as there are cuts can repeat, so the second table is bounded too.
    """
    repeated = F.exists(F.sequence(F.lit(1), F.size("_splits") - 1),
                        lambda i: F.get("_splits", i) == F.get("_splits", i - 1))
    if splits.filter(repeated).isEmpty():
        return tagged
    at = F.col(CHUNK).cast("int")
    low = F.when(F.get("_splits", at - 1) == F.get("_splits", at - 2), F.get("_splits", at - 1))
    tagged = tagged.withColumn("_low", F.when(at >= 2, low))
    tie = (F.col("_low") == value).eqNullSafe(F.lit(True))
    subs = pin(tagged.filter(tie).groupBy("_keyhash", "_low").agg(
        F.percentile_approx(then, cuts, 20 * len(cuts)).alias("_subs")))
    out = tagged.join(F.broadcast(subs), ["_keyhash", "_low"], "left")
    inside = F.greatest(F.lit(0), F.size(F.filter("_subs", lambda s: s <= then)))
    sub = F.when(F.col("_low").isNull(), 0).when(tie, inside).otherwise(len(cuts) + 1)
    return out.withColumn(CHUNK, F.col(CHUNK) * (len(cuts) + 2) + F.coalesce(sub, F.lit(0)))


def _second(df: DataFrame, order: Sequence[str]) -> str | None:
    """The second order column if it is a number."""
    numeric = {"byte", "short", "integer", "long", "float", "double"}
    return order[1] if len(order) > 1 and df.schema[order[1]].dataType.typeName() in numeric else None


def _single(df: DataFrame) -> bool:
    return bool(df.schema[CHUNK].metadata.get("single"))


def _hash(keys: Sequence[str]) -> Column:
    """Hash of the key; two keys sharing a hash merely share their cuts."""
    return F.xxhash64(*keys) if keys else F.lit(0).cast("bigint")


def _group(keys: Sequence[str]) -> Column:
    """The key as one struct: never null itself, so rows with NULL keys join and rank like any other."""
    return F.struct(*[F.col(k) for k in keys]) if keys else F.struct(F.lit(0).alias("all"))


def running(df: DataFrame, keys: Sequence[str], order: Sequence[str], *,
            sums: dict[str, str] | None = None, mins: dict[str, str] | None = None,
            maxs: dict[str, str] | None = None, next_of: dict[str, str] | None = None, totals: bool = True, exclusive: bool = False,
            chunks: int | None = None, bounded_keys: bool = False) -> DataFrame:
    """Running ``sum``/``min``/``max`` per key in ``order`` (unique within a key), in parallel chunks.

    ``sums={"cum_n": "n"}`` adds ``cum_n`` (inclusive unless ``exclusive``; summed
    columns are counts, 0 or more) and, with ``totals``, ``cum_n_total``.
    ``next_of={"nxt": "v"}`` adds the value of ``v`` (the leading order column) in
    the following row.  Rows already carrying a chunk number (from
    ``with_chunks``) keep it, so several runs share one layout.
    """
    sums, mins, maxs, next_of = sums or {}, mins or {}, maxs or {}, next_of or {}
    tagged = df if CHUNK in df.columns else with_chunks(
        df, keys, order[0], chunks=chunks, bounded_keys=bounded_keys, then=_second(df, order))
    if _single(tagged):
        whole = Window.partitionBy(*keys).orderBy(*order)
        upto = whole.rowsBetween(Window.unboundedPreceding, -1 if exclusive else 0)
        return tagged.select(
            *df.columns,
            *[F.coalesce(F.sum(c).over(upto), F.lit(0)).alias(o) for o, c in sums.items()],
            *[F.sum(c).over(Window.partitionBy(*keys)).alias(f"{o}_total") for o, c in sums.items() if totals],
            *[F.min(c).over(upto).alias(o) for o, c in mins.items()],
            *[F.max(c).over(upto).alias(o) for o, c in maxs.items()],
            *[F.lead(c).over(whole).alias(o) for o, c in next_of.items()])
    tagged = tagged.withColumn(GROUP, _group(keys))
    part = [GROUP, CHUNK]
    per_chunk = tagged.groupBy(*part).agg(
        F.count("*").alias("_rows"),
        *[F.sum(c).alias(f"_s_{o}") for o, c in sums.items()],
        *[F.min(c).alias(f"_m_{o}") for o, c in mins.items()],
        *[F.max(c).alias(f"_m_{o}") for o, c in maxs.items()],
        *[F.min(c).alias(f"_n_{o}") for o, c in next_of.items()])
    over_chunks = Window.partitionBy(GROUP).orderBy(CHUNK)
    before = over_chunks.rowsBetween(Window.unboundedPreceding, -1)
    carried = per_chunk.select(
        *part,
        *[F.coalesce(F.sum(f"_s_{o}").over(before), F.lit(0)).alias(f"_b_{o}") for o in sums],
        *[F.sum(f"_s_{o}").over(Window.partitionBy(GROUP)).alias(f"{o}_total") for o in sums if totals],
        *[F.min(f"_m_{o}").over(before).alias(f"_b_{o}") for o in mins],
        *[F.max(f"_m_{o}").over(before).alias(f"_b_{o}") for o in maxs],
        *[F.lead(f"_n_{o}").over(over_chunks).alias(f"_f_{o}") for o in next_of])
    joined = tagged.join(carried, part)
    inside = Window.partitionBy(*part).orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, -1 if exclusive else 0)
    return joined.select(
        *df.columns,
        *[(F.col(f"_b_{o}") + F.coalesce(F.sum(c).over(upto), F.lit(0))).alias(o) for o, c in sums.items()],
        *[F.col(f"{o}_total") for o in sums if totals],
        *[F.least(F.col(f"_b_{o}"), F.min(c).over(upto)).alias(o) for o, c in mins.items()],
        *[F.greatest(F.col(f"_b_{o}"), F.max(c).over(upto)).alias(o) for o, c in maxs.items()],
        *[F.coalesce(F.lead(c).over(inside), F.col(f"_f_{o}")).alias(o) for o, c in next_of.items()])


def rolling(df: DataFrame, keys: Sequence[str], order: Sequence[str], preceding: int,
            columns: dict[str, Callable[[Window], Column]], *, chunks: int | None = None,
            bounded_keys: bool = False) -> DataFrame:
    """Window over the previous ``preceding`` rows (plus the current one) of each key.

    ``columns`` maps an output name to ``window -> Column``.  Each chunk receives
    copies of the last ``preceding`` rows in front of it, so every window is whole.
    Rows already carrying a chunk number keep it.
    """
    tagged = df if CHUNK in df.columns else with_chunks(
        df, keys, order[0], chunks=chunks, bounded_keys=bounded_keys, then=_second(df, order))
    if _single(tagged):
        window = Window.partitionBy(*keys).orderBy(*order)
        return tagged.select(*df.columns, *[f(window).alias(n) for n, f in columns.items()])
    tagged = tagged.withColumn(GROUP, _group(keys))
    part, plain = [GROUP, CHUNK], [c for c in df.columns if c != CHUNK]
    by_chunk = Window.partitionBy(GROUP).orderBy(CHUNK)
    sizes = tagged.groupBy(*part).agg(F.count("*").alias("_rows")) \
        .withColumn("_upto", F.sum("_rows").over(by_chunk))
    # the chunks behind this one with the row number at which each starts; every chunk has a row,
    # so no more than `preceding` of them can need rows from here
    following = F.collect_list(F.struct(F.col(CHUNK).alias("to"), (F.col("_upto") - F.col("_rows")).alias("start")))
    sizes = sizes.select(*part, "_upto", following.over(by_chunk.rowsBetween(1, preceding)).alias("_ahead"))
    backwards = Window.partitionBy(*part).orderBy(*[F.desc(c) for c in order])
    tails = tagged.withColumn("_r", F.row_number().over(backwards)).filter(F.col("_r") <= preceding)
    copies = tails.join(sizes, part).withColumn("_to", F.explode("_ahead")) \
        .filter(F.col("_r") - 1 + F.col("_to.start") - F.col("_upto") < preceding) \
        .select(*plain, GROUP, F.col("_to.to").alias(CHUNK), F.lit(True).alias(HALO))
    whole = tagged.select(*plain, GROUP, CHUNK, F.lit(False).alias(HALO)).unionByName(copies)
    window = Window.partitionBy(*part).orderBy(*order)
    out = whole.select(*df.columns, HALO, *[f(window).alias(n) for n, f in columns.items()])
    return out.filter(~F.col(HALO)).drop(HALO)


def asof_join(left: DataFrame, right: DataFrame, key: str, at: str, payload: Sequence[str],
              tie: str) -> DataFrame:
    """For each left row the latest right row of the same key with ``right.at <= left.at``.

    Both sides are stacked and the latest right row is carried forward with a
    running maximum, so no pairs are formed.  ``tie`` (unique per side) orders
    equal times.  Adds ``matched_<at>`` and ``matched_<payload>``, null without a match.
    """
    carried = F.struct(F.col(at), F.col(tie).alias("_tie"), *[F.col(c) for c in payload])
    side_l = left.withColumns({"_right": F.lit(None).cast(
        right.select(carried.alias("_s")).schema["_s"].dataType), "_side": F.lit(1), "_tie": F.col(tie)})
    side_r = right.select(*[F.col(c) if c in right.columns else F.lit(None).cast(t).alias(c) for c, t in left.dtypes],
                          carried.alias("_right"), F.lit(0).alias("_side"), F.col(tie).alias("_tie"))
    both = side_l.unionByName(side_r)
    seen = running(both, [key], [at, "_side", "_tie"], maxs={"_hit": "_right"})
    return seen.filter(F.col("_side") == 1).select(
        *left.columns, F.col(f"_hit.{at}").alias(f"matched_{at}"),
        *[F.col(f"_hit.{c}").alias(f"matched_{c}") for c in payload])


def value_counts(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """``(keys, value, n)``: rows collapse map-side, so a repeated value costs one row per task."""
    return df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))


def few_or_chunked(counts: DataFrame, keys: Sequence[str], by: str) -> DataFrame:
    """Counts of a fixed list of keys, written once, with their chunks: one a key if there are at most ``FEW_ROWS`` in all.

    Counting what has been written costs next to nothing, while cuts cost a sketch and a second exchange.
    """
    known = pin(counts)
    if known.count() <= FEW_ROWS:
        return known.select("*", F.lit(0).alias(CHUNK, metadata={"single": True}))
    return with_chunks(known, keys, by, bounded_keys=True)


def positions(df: DataFrame, keys: Sequence[str], value: str, *, bounded_keys: bool = False) -> DataFrame:
    """Distinct values with the 0-based sorted positions ``[first, last]`` they occupy and ``total``."""
    counts = value_counts(df, keys, value)
    if bounded_keys or not keys:
        counts = few_or_chunked(counts, keys, value)
    ranked = running(counts, keys, [value], sums={"cum": "n"})
    return ranked.select(*keys, value, (F.col("cum") - F.col("n")).alias("first"),
                         (F.col("cum") - 1).alias("last"), F.col("cum_total").alias("total"))


def exact_percentiles(df: DataFrame, keys: Sequence[str], value: str, points: dict[str, float], *,
                      bounded_keys: bool = False) -> DataFrame:
    """Linear-interpolation percentiles per key, exact, without a per-key value map in one task."""
    at = positions(df, keys, value, bounded_keys=bounded_keys)

    def pick(where: Column) -> Column:
        return F.max(F.when((F.col("first") <= where) & (where <= F.col("last")), F.col(value).cast("double")))

    picks = []
    for name, p in points.items():
        target = (F.col("total") - 1) * F.lit(float(p))
        picks += [pick(F.floor(target)).alias(f"_lo_{name}"), pick(F.ceil(target)).alias(f"_hi_{name}")]
    found = at.groupBy(*keys).agg(F.max("total").alias("_n"), *picks)
    cols = []
    for name, p in points.items():
        target = (F.col("_n") - 1) * F.lit(float(p))
        cols.append((F.col(f"_lo_{name}") + (F.col(f"_hi_{name}") - F.col(f"_lo_{name}"))
                     * (target - F.floor(target))).alias(name))
    return found.select(*keys, *cols)


def order_statistic(df: DataFrame, keys: Sequence[str], value: str, position: Callable[[Column], Column],
                    name: str, *, bounded_keys: bool = False) -> DataFrame:
    """Value at the 0-based sorted position ``position(total)`` of each key."""
    at = positions(df, keys, value, bounded_keys=bounded_keys)
    where = position(F.col("total"))
    return at.filter((F.col("first") <= where) & (where <= F.col("last"))) \
             .select(*keys, F.col(value).alias(name))


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int = 1,
                  rank: str | None = None) -> DataFrame:
    """First ``n`` rows of each key.

    Written as ``row_number() <= n`` so that Spark cuts every task's output to
    ``n`` rows per key *before* the shuffle (window group limit); a hot key
    therefore ships ``n`` rows per task, not all of them.
    """
    out = df.withColumn(rank or "_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    out = out.filter(F.col(rank or "_rn") <= n)
    return out if rank else out.drop("_rn")


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """Rows with their place in their key, from 0, in an ``order`` of any types.

    One sort over range partitions; a place is counted from the sizes of the partitions' segments, a row for each
    partition and key, so a key that fills many partitions is numbered by as many tasks.
    """
    columns = [*keys, *order]
    ordered = pin(df.repartitionByRange(*columns).sortWithinPartitions(*columns).withColumns({
        "_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    segments = ordered.groupBy(*keys, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_rows")) \
        .withColumn("_before", F.coalesce(F.sum("_rows").over(before), F.lit(0))).drop("_rows")
    return null_safe_join(ordered, segments, [*keys, "_part"]).select(*df.columns, (F.col("_at") - F.col("_first") + F.col("_before")).alias(name))
