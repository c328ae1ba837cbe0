"""Dataset lineage, versions and stage dependencies as append-only tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.joins import skew_join
from tidemark.operators.ranking import hot_groups, running, with_chunks

LINEAGE_SCHEMA = ("dataset_id string, source_path string, created timestamp, parent_datasets array<string>, "
                  "metadata map<string,string>, checksum string, version string")
STEP_SCHEMA = "step_id string, dataset_id string, step_name string, step_config string, ts timestamp"
VERSION_SCHEMA = ("dataset_id string, version string, created timestamp, description string, changes array<string>, "
                  "metrics map<string,double>, checksum string")


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Latest row per key: replaces an upsert, resolved at read time with a map-side-combined maximum."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")) \
        .select(*keys, "_row.*").select(*df.columns)


def step_positions(steps: DataFrame, key: str, order: Sequence[str], hot: list[int] | None = None) -> DataFrame:
    """Steps with their 1-based position within the dataset, one row per step.

    Rows instead of one list per dataset: a dataset with very many steps is
    never gathered.  ``order`` starts with two numeric columns (or has one).
    """
    numbered = with_chunks(steps.withColumn("_one", F.lit(1)), [key], order[0], hot=hot,
                           then=order[1] if len(order) > 1 else None)
    return running(numbered, [key], order, sums={"position": "_one"}, totals=False).drop("_one", "_chunk")


def lineage_steps(headers: DataFrame, steps: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Headers joined to their steps in order; headers without steps keep one row with null step columns.

    The step side may hold one very busy dataset, so it is the protected side of the join.
    """
    hot = hot_groups(steps, [key])
    placed = step_positions(steps, key, order, hot)
    with_steps = skew_join(placed, headers, key, "inner", hot=hot)
    alone = headers.join(steps.select(key).distinct(), key, "left_anti")
    return with_steps.unionByName(alone, allowMissingColumns=True)


def parents(df: DataFrame, key: str, parent_list: str, columns: Sequence[str]) -> DataFrame:
    """Each dataset with the existing parents it names; a parent that very many name is spread."""
    wanted = df.select(key, F.explode(parent_list).alias("parent"))
    known = df.select(F.col(key).alias("parent"), *[F.col(c).alias(f"parent_{c}") for c in columns])
    return skew_join(wanted, known, "parent")


def patch_number(version: Column) -> Column:
    """Third part of ``major.minor.patch``."""
    return F.try_element_at(F.split(version, r"\."), F.lit(3)).try_cast("bigint")


def next_version(datasets: DataFrame, versions: DataFrame, key: str) -> DataFrame:
    """Next version per dataset: ``1.0.0`` for the first, else the latest with the patch raised by one.

    Versions compare by their numbers, so 1.0.10 follows 1.0.9.
    """
    parts = F.split("version", r"\.")
    number = F.struct(*[parts[i].cast("bigint").alias(f"p{i}") for i in range(3)])
    top = versions.groupBy(key).agg(F.max(number).alias("_v"))
    raised = F.concat_ws(".", F.col("_v.p0").cast("string"), F.col("_v.p1").cast("string"),
                         (F.col("_v.p2") + 1).cast("string"))
    return datasets.join(top, key, "left").select(
        *datasets.columns, F.when(F.col("_v").isNull(), "1.0.0").otherwise(raised).alias("next_version"))


def missing_dependencies(required: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Required stages without a completed counterpart."""
    return required.join(done.select(*keys), list(keys), "left_anti")


def satisfied_dependencies(required: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Required stages that are completed."""
    return required.join(done.select(*keys), list(keys), "left_semi")


def register_dataset(row: DataFrame, path: str) -> None:
    """Append lineage header rows (latest per ``dataset_id`` wins when read)."""
    row.select(*[c.split()[0] for c in _names(LINEAGE_SCHEMA)]).write.mode("append").parquet(path)


def add_steps(rows: DataFrame, path: str) -> None:
    """Append processing steps."""
    rows.select(*[c.split()[0] for c in _names(STEP_SCHEMA)]).write.mode("append").parquet(path)


def create_versions(datasets: DataFrame, path: str) -> None:
    """Append the next version of each dataset in ``datasets`` (columns of the version table but ``version``)."""
    spark = datasets.sparkSession
    known = spark.read.schema(VERSION_SCHEMA).parquet(path) if _exists(spark, path) \
        else spark.createDataFrame([], VERSION_SCHEMA)
    ready = next_version(datasets, known.select("dataset_id", "version"), "dataset_id") \
        .withColumnRenamed("next_version", "version")
    ready.select(*[c.split()[0] for c in _names(VERSION_SCHEMA)]).write.mode("append").parquet(path)


def _names(ddl: str) -> list[str]:
    return [part.strip() for part in ddl.replace("map<string,string>", "map").replace("map<string,double>", "map").split(",")]


def _exists(spark, path: str) -> bool:
    from tidemark.sources.files import path_exists
    return path_exists(spark, path)
