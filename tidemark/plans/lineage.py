"""Queries over lineage tables and the reference-data joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.rounding import rounded
from tidemark.operators import joins
from tidemark.operators import lineage as ln
from tidemark.plans import views
from tidemark.plans.registry import query
from tidemark.sources.tables import table


@query("lineage_latest", """SELECT o_custkey AS dataset_id, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS step_id,
  arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS status, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS size
  FROM orders GROUP BY o_custkey""")
def lineage_latest(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "orders").select(
        F.col("o_custkey").alias("dataset_id"), F.col("o_orderdate").alias("created"), F.col("o_orderkey").alias("step_id"),
        F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("size"))
    return ln.latest(df, ["dataset_id"], ["created", "step_id"]).drop("created")


STEP_ORDER = ["secs", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


@query("lineage_steps", """WITH s AS (SELECT l_orderkey, epoch(l_shipdate)::BIGINT AS secs, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS position FROM lineitem)
  SELECT o_orderkey AS dataset_id, o_orderpriority AS source, position, l_partkey AS step_id, secs FROM orders LEFT JOIN s ON l_orderkey = o_orderkey""")
def lineage_steps(spark: SparkSession, d: str) -> DataFrame:
    headers = table(spark, d, "orders").select(F.col("o_orderkey").alias("dataset_id"), F.col("o_orderpriority").alias("source"))
    steps = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("dataset_id"), F.unix_seconds(F.col("l_shipdate").cast("timestamp")).alias("secs"),
        "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return ln.lineage_steps(headers, steps, "dataset_id", STEP_ORDER).select(
        "dataset_id", "source", "position", F.col("l_partkey").alias("step_id"), "secs")


@query("lineage_parents", """SELECT o.o_orderkey AS dataset_id, p.o_orderkey AS parent, p.o_totalprice AS parent_size FROM orders o
  JOIN orders p ON p.o_orderkey = o.o_orderkey - 1 OR p.o_orderkey = o.o_orderkey // 2 AND o.o_orderkey > 2 WHERE o.o_orderkey > 0""")
def lineage_parents(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    named = F.array_compact(F.array(F.when(k > 0, k - 1), F.when(k > 2, F.floor(k / 2))))
    df = table(spark, d, "orders").select(k.alias("dataset_id"), F.col("o_totalprice").alias("size"), named.alias("parents"))
    return ln.parents(df, "dataset_id", "parents", ["size"])


@query("next_version", """WITH v AS (SELECT o_custkey, max(o_orderkey % 12) AS patch FROM orders GROUP BY 1)
  SELECT c_custkey AS dataset_id, CASE WHEN patch IS NULL THEN '1.0.0' ELSE '1.0.' || (patch + 1)::VARCHAR END AS next_version
  FROM customer LEFT JOIN v ON o_custkey = c_custkey""")
def next_version(spark: SparkSession, d: str) -> DataFrame:
    datasets = table(spark, d, "customer").select(F.col("c_custkey").alias("dataset_id"))
    versions = table(spark, d, "orders").select(
        F.col("o_custkey").alias("dataset_id"), F.concat(F.lit("1.0."), (F.col("o_orderkey") % 12).cast("string")).alias("version"))
    return ln.next_version(datasets, versions, "dataset_id")


STAGES = ["view", "signup", "purchase", "error", "click", "deploy"]


def _stages(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    tel = views.telemetry(spark, d)
    required = tel.select("component").distinct().withColumn("stage", F.explode(F.array(*[F.lit(s) for s in STAGES])))
    done = tel.filter(F.col("duration_ms") > 300).select("component", F.col("operation").alias("stage")).distinct()
    return required, done


DEPS = """WITH t AS (SELECT DISTINCT 'c' || (user_id % 10)::VARCHAR AS component FROM events),
  r AS (SELECT component, s.stage FROM t, (SELECT unnest(['view', 'signup', 'purchase', 'error', 'click', 'deploy']) AS stage) s),
  d AS (SELECT DISTINCT 'c' || (user_id % 10)::VARCHAR AS component, event_type AS stage FROM events WHERE value > 300)
  SELECT component, stage FROM r WHERE {no} EXISTS (SELECT 1 FROM d WHERE d.component = r.component AND d.stage = r.stage)"""


@query("missing_deps", DEPS.format(no="NOT"))
def missing_deps(spark: SparkSession, d: str) -> DataFrame:
    required, done = _stages(spark, d)
    return ln.missing_dependencies(required, done, ["component", "stage"])


@query("satisfied_deps", DEPS.format(no=""))
def satisfied_deps(spark: SparkSession, d: str) -> DataFrame:
    required, done = _stages(spark, d)
    return ln.satisfied_dependencies(required, done, ["component", "stage"])


@query("join_sidecar", """SELECT source, count(*) AS n, sum(quality)::BIGINT AS good, round(avg(n_chars), 6) AS mean_size
  FROM documents JOIN labels USING (doc_id) GROUP BY source""")
def join_sidecar(spark: SparkSession, d: str) -> DataFrame:
    images = table(spark, d, "documents").select("doc_id", "source", "n_chars")
    sidecar = table(spark, d, "labels").select("doc_id", "quality")
    return rounded(images.join(sidecar, "doc_id").groupBy("source").agg(
        F.count("*").alias("n"), F.sum("quality").alias("good"), F.avg("n_chars").alias("mean_size")))


@query("join_truth", """SELECT l_returnflag AS model, count(*) AS n, count(CASE WHEN o_totalprice > 50000 THEN 1 END) AS matched,
  round(avg(CASE WHEN o_totalprice > 50000 THEN abs(l_extendedprice - o_totalprice / 4) END), 4) AS mae
  FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey AND o_totalprice > 50000 GROUP BY 1""")
def join_truth(spark: SparkSession, d: str) -> DataFrame:
    preds = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_returnflag").alias("model"),
                                               F.col("l_extendedprice").alias("pred"))
    truth = table(spark, d, "orders").filter(F.col("o_totalprice") > 50000) \
        .select(F.col("o_orderkey").alias("id"), (F.col("o_totalprice") / 4).alias("truth"))
    both = joins.skew_join(preds, truth, "id", "left")
    return both.groupBy("model").agg(F.count("*").alias("n"), F.count("truth").alias("matched"),
                                     F.round(F.avg(F.abs(F.col("pred") - F.col("truth"))), 4).alias("mae"))


@query("compare_stats", """WITH s AS (SELECT avg(CASE WHEN b THEN l_quantity END) AS m1, stddev_pop(CASE WHEN b THEN l_quantity END) AS s1,
    avg(CASE WHEN NOT b THEN l_quantity END) AS m2, stddev_pop(CASE WHEN NOT b THEN l_quantity END) AS s2,
    count(CASE WHEN b THEN 1 END) AS n1, count(CASE WHEN NOT b THEN 1 END) AS n2
    FROM (SELECT l_quantity, l_shipdate < TIMESTAMP '1998-06-01' AS b FROM lineitem))
  SELECT n1, n2, round(m1, 6) AS mean1, round(m2, 6) AS mean2, round(abs(m1 - m2) / m1, 6) AS mean_diff, round(abs(s1 - s2) / s1, 6) AS std_diff FROM s""")
def compare_stats(spark: SparkSession, d: str) -> DataFrame:
    base = F.col("dataset") == "baseline"
    q1, q2 = F.when(base, F.col("l_quantity")), F.when(~base, F.col("l_quantity"))
    one = views.features_wide(spark, d).agg(
        F.count(q1).alias("n1"), F.count(q2).alias("n2"), F.avg(q1).alias("mean1"), F.avg(q2).alias("mean2"),
        F.stddev_pop(q1).alias("_s1"), F.stddev_pop(q2).alias("_s2"))
    return rounded(one.select(
        "n1", "n2", "mean1", "mean2", (F.abs(F.col("mean1") - F.col("mean2")) / F.col("mean1")).alias("mean_diff"),
        (F.abs(F.col("_s1") - F.col("_s2")) / F.col("_s1")).alias("std_diff")))
