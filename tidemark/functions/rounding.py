"""Presentation helpers for result tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column, so results do not depend on the order of additions."""
    return df.select(*[F.round(F.col(f"`{n}`"), digits).alias(n) if t == "double" else F.col(f"`{n}`")
                       for n, t in df.dtypes])


def as_text(name: str, sep: str = "; ") -> Column:
    """A list of messages as one text column of the same name."""
    return F.array_join(name, sep).alias(name)
