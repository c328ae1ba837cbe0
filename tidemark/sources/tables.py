"""Parquet tables, pinning of small intermediate results, and size-checked broadcasts."""

from __future__ import annotations

import tempfile
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """One Parquet table of a dataset directory."""
    return spark.read.parquet(f"{directory}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, as named in ``spark.checkpoint.dir``.

    Only a single-machine session may leave it unset; it then gets a fresh local folder.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if context.getCheckpointDir() is None:
        if not folder and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="tidemark-"))
    return folder or context.getCheckpointDir()


def pin(df: DataFrame) -> DataFrame:
    """Write a result once and read it back, so that a retried task sees the same rows."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def literal_table(spark: SparkSession, columns: str, rows: Sequence[tuple]) -> DataFrame:
    """A small table written out in the plan itself (no Python worker, no job); ``columns`` is a DDL string."""
    names = [part.split()[0] for part in columns.split(",")]
    values = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, row)]) for row in rows])
    return spark.range(0, 1, 1, 1).select(F.inline(values.cast(f"array<struct<{_typed(columns)}>>")))


def _typed(columns: str) -> str:
    return ",".join(f"{n}:{t}" for n, t in (part.split() for part in columns.split(",")))
