"""Folds and bounded samples of labelled rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def in_fold(doc_id: str, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text leaves ``fold``; a null id is in no fold."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds == fold, F.lit(False))


def per_class(rows: DataFrame, label: str, most: int, *ids: str) -> DataFrame:
    """About ``most`` rows of each class; which ones follows from a hash of ``ids`` alone.

    Classes are counted first; hashes are uniform, so a bound on the hash keeps the wanted share of each
    class without sorting or gathering any. Rows with the same ``ids`` are taken or left together.
    """
    spread = F.xxhash64(F.lit(label), *ids).bitwiseAND(F.lit((1 << 62) - 1))
    total = {r[0]: r[1] for r in rows.groupBy(label).count().collect() if r[0] is not None}
    if not total:
        return rows.filter(F.lit(False))
    bounds = F.create_map(*[F.lit(x) for k, n in total.items() for x in (k, int((1 << 62) * min(1.0, most / n)))])
    return rows.filter(spread <= bounds[F.col(label)])
