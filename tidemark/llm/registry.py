"""Catalogue of the queries of this subpackage, apart from the main one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.text import small_batches

Runner = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Runner] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Runner], Runner]:
    """Register a query under ``name``; ``sql`` is its DuckDB counterpart on the same tables."""
    def register(run: Runner) -> Runner:
        if name in QUERIES:
            raise ValueError(f"query {name!r} registered twice")

        def prepared(spark: SparkSession, directory: str) -> DataFrame:
            small_batches(spark)
            return run(spark, directory)

        QUERIES[name] = prepared
        if sql:
            SQL[name] = sql
        return run
    return register
