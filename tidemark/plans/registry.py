"""Catalogue of named queries, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Runner = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    run: Runner
    sql: str | None


CATALOGUE: dict[str, Query] = {}


def query(name: str, sql: str | None = None) -> Callable[[Runner], Runner]:
    """Register a query under ``name``; ``sql`` is its DuckDB counterpart on the same tables."""
    def register(run: Runner) -> Runner:
        if name in CATALOGUE:
            raise ValueError(f"query {name!r} registered twice")

        def prepared(spark: SparkSession, directory: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return run(spark, directory)

        CATALOGUE[name] = Query(name, prepared, sql)
        return run
    return register
