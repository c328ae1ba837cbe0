"""Joins: sidecars, truth, domains, dependencies, reuse of recent results, hot-key protection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ranking import Hot, asof_join, hot_groups
from tidemark.sources.tables import literal_table

def skew_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner", *, hot: Hot | None = None) -> DataFrame:
    """Equi-join (``inner``, ``left``, ``left_semi``, ``left_anti``) that spreads the hot keys of ``left``.

    Rows of a hot key get a salt from the row itself and the matching rows of
    ``right`` (few per key) are copied once per salt; a key has as many salts as it holds partitions'
    worth of rows.  All other keys are joined
    as usual in the same shuffle.  No row is dropped and none is doubled.
    ``hot`` passes in hot keys that are known already.
    """
    hot = hot_groups(left.filter(F.col(key).isNotNull()), [key]) if hot is None else hot
    if not hot:
        return left.join(right, key, how)
    salts = hot.pieces(F.xxhash64(key), int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))).cast("int")
    # from the row's own values, so that a task that is run again gives the same salts
    values = [f.name for f in left.schema.fields if "map<" not in f.dataType.simpleString()]
    salted_left = left.withColumn("_salt", F.pmod(F.xxhash64(*values), salts).cast("int"))
    salted_right = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    return salted_left.join(salted_right, [key, "_salt"], how).drop("_salt")


def domain_counts(df: DataFrame, column: str, domain: Sequence[str]) -> DataFrame:
    """Counts over a fixed domain, 0 for categories nobody has (domain table left-joined to the counts)."""
    counts = df.groupBy(column).agg(F.count("*").alias("n"))
    categories = literal_table(df.sparkSession, f"{column} string", [(c,) for c in domain])
    return categories.join(counts, column, "left").select(column, F.coalesce("n", F.lit(0)).alias("n"))


def recent_duplicate(requests: DataFrame, results: DataFrame, key: str, at: str, ident: str,
                     ttl_seconds: float) -> DataFrame:
    """Reuse of a stored result: ``reuse_of`` is the latest result of the same content not older than the limit.

    ``at`` is a time in seconds.  Requests without such a result have to be computed (null).
    """
    matched = asof_join(requests, results, key, at, [ident], tie=ident)
    fresh = F.col(at) - F.col(f"matched_{at}") < ttl_seconds
    return matched.select(*requests.columns, F.when(fresh, F.col(f"matched_{ident}")).alias("reuse_of"))


def metric_rows(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Wide metric columns as ``(by, metric, value)`` rows."""
    return df.select(*by, F.inline(F.array(*[
        F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in columns])))


def recommend(metrics: DataFrame, rules: Sequence[tuple[str, str, float, str]], by: Sequence[str] = ()) -> DataFrame:
    """Texts whose rule fires: ``metrics(by, metric, value)`` joined to ``(metric, op, threshold, text)`` rules."""
    table = literal_table(metrics.sparkSession, "metric string, op string, threshold double, text string", rules)
    joined = metrics.join(F.broadcast(table), "metric")
    v, t = F.col("value"), F.col("threshold")
    fires: Column = (F.when(F.col("op") == "<", v < t).when(F.col("op") == ">", v > t)
                     .when(F.col("op") == "<=", v <= t).when(F.col("op") == ">=", v >= t).otherwise(v == t))
    return joined.filter(fires).select(*by, "text").distinct()
