"""Rows told apart by their place in a stored table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def without(docs: DataFrame, uids: DataFrame) -> DataFrame:
    """``docs`` without the rows whose place (``monotonically_increasing_id``) is in ``uids`` (column uid).

    ``docs`` must be read the same way both times, as a stored table is. The ids are the small side, so
    they are hashed and the texts need no sorting.
    """
    place = next(f"_place{i}" for i in range(len(docs.columns) + 1) if f"_place{i}" not in docs.columns)
    out = uids.select(F.col("uid").alias("_out")).hint("shuffle_hash")
    rows = docs.withColumn(place, F.monotonically_increasing_id())
    return rows.join(out, F.col(place) == F.col("_out"), "left_anti").drop(place)
