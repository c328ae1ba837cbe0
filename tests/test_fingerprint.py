"""Order-true fingerprints and numbers of rows against a plain version."""

import hashlib

import pytest
from pyspark.sql import functions as F

from tidemark.operators import profiling, ranking


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute(rows, fanout):
    nodes = [sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in r)) for r in sorted(rows, key=lambda r: tuple((v is not None, v) for v in r))]
    while True:
        nodes = [sha("".join(nodes[i:i + fanout])) for i in range(0, len(nodes), fanout)]
        if len(nodes) == 1:
            return nodes[0]


def listing(spark, n=150):
    rows = [("hot", f"p{i:04d}é", i) for i in range(n)] + [(None, "x", None), (None, "x", None), ("one", None, 3)]
    return spark.createDataFrame(rows, "folder string, path string, length bigint"), rows


@pytest.mark.parametrize("fanout", [2, 7, 1024])
def test_fingerprint_equals_a_plain_tree(spark, fanout):
    df, rows = listing(spark)
    got = {r.folder: (r.fingerprint, r.files) for r in profiling.ordered_checksum(df, ["folder"], ["path", "length"], fanout).collect()}
    for folder in ("hot", "one", None):
        mine = [r[1:] for r in rows if r[0] == folder]
        assert got[folder] == (brute(mine, fanout), len(mine))


def test_fingerprint_sees_one_name_and_no_layout(spark):
    df, _ = listing(spark)
    changed = df.withColumn("path", F.when(F.col("length") == 77, "p0077").otherwise(F.col("path")))
    prints = [{r.folder: r.fingerprint for r in profiling.ordered_checksum(x, ["folder"], ["path", "length"], 8).collect()} for x in (df, df.repartition(9), changed)]
    assert prints[0] == prints[1] and prints[0]["hot"] != prints[2]["hot"] and prints[0][None] == prints[2][None]
    assert profiling.ordered_checksum(df.limit(0), ["folder"], ["path"]).count() == 0


def test_rows_are_numbered_in_order(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 3 > 0, "hot").when(F.col("id") % 2 == 0, "cold").alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("v"))
    got = ranking.numbered(df, ["k"], ["v"], "at").collect()
    for k in ("hot", "cold", None):
        assert [r.v for r in sorted((r for r in got if r.k == k), key=lambda r: r["at"])] == sorted(r.v for r in got if r.k == k)
        assert sorted(r["at"] for r in got if r.k == k) == list(range(sum(r.k == k for r in got)))
