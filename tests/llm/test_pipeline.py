"""The pipeline against a plain version of its stages, and the catalogue of the subpackage."""

import hashlib
import os
import re
import struct

import public_tokenizers
import pytest
import sentencepiece

import corpus_pipeline
from tidemark.llm import components, decontamination, language, secrets, simhash
from tidemark.llm.catalogue import QUERIES, SQL
from tests.llm import test_decontamination, test_simhash
from tests.llm.frames import empty

DATA = "/root/testdata/sf0.001"


def test_names():
    assert [n.split("_")[0] for n in sorted(QUERIES, key=lambda n: int(n[2:].split("_")[0]))] == [f"op{i}" for i in range(1, 14)]
    assert set(SQL) <= set(QUERIES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "decontamination", "secrets", "sentencepiece"]


def test_pipeline_matches_a_plain_version(spark):
    import pyarrow as pa
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    model = language.train(docs.filter(~language.in_fold("doc_id", language.FOLDS, language.HELD_OUT)))
    labels, scores = language.predict(pa.array([t for _, t in rows]), model)
    rows = [r for r, x, s in zip(rows, labels, scores) if x != "und" and s >= language.LEAST_SCORE]
    keep = {c for _, _, c in test_simhash.brute(rows)}
    rows = [r for r in rows if r[0] in keep]
    bad = {r[0] for r in test_decontamination.brute(rows, items) if r[5]}
    rows = [r for r in rows if r[0] not in bad]
    net = secrets.train(spark.createDataFrame(rows, "doc_id bigint, text string"))
    rows = [(i, secrets.masked(t, s)) for (i, t), s in zip(rows, secrets.spans_of(pa.array([t for _, t in rows]), net))]
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = []
    for i, text in rows:
        ids = library.encode(text, add_bos=True, add_eos=True)
        want.append((i, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    assert sorted(map(tuple, corpus_pipeline.run(spark, DATA).collect())) == sorted(want)
    assert 0 < len(want) < docs.count() and bad


def test_stages_bear_an_empty_table(spark, tmp_path):
    path = str(tmp_path / "documents.parquet")
    empty(spark).write.parquet(path)
    docs = spark.read.parquet(path)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, DATA)
        assert out.count() == 0, name
        if name != "sentencepiece":
            assert out.columns == docs.columns


def chained(df):
    """Python operators of an executed plan that feed another one without an exchange between them: two workers a task."""
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    above, found = [], []
    for line in plan.splitlines():
        mark = re.match(r"[ :]*(?:[+:]- )?(?:\*\(\d+\) )?", line).end()
        depth = len(re.match(r"[ :]*", line)[0])
        above = [(d, name) for d, name in above if d < depth]
        name = line[mark:].split(" ")[0]
        python = re.search("InArrow|InPandas|EvalPython", name)
        for _, over in reversed(above):
            if "Exchange" in over or "QueryStage" in over:
                break
            if python and re.search("InArrow|InPandas|EvalPython", over):
                found.append(f"{over} over {name}")
        above.append((depth, name))
    return found


@pytest.mark.parametrize("threshold", ["10m", "-1"])
def test_no_stage_runs_two_python_workers_a_task(spark, monkeypatch, tmp_path, threshold):
    """Else an executor keeps twice as many workers, each with the models and words of every step."""
    pinned = []
    for module in (components, language, secrets, simhash):
        monkeypatch.setattr(module, "pin", lambda df, pin=module.pin: (pin(df), pinned.append(df))[0])
    monkeypatch.setattr(decontamination, "_bit_filter", lambda s, keys, made=decontamination._bit_filter: (made(s, keys), pinned.append(keys))[0])
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        docs, data = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), "/root/testdata/sf0.01"
        for name, stage in corpus_pipeline.STAGES:
            pinned.clear()
            out = stage(spark, docs, data)
            assert out.collect() is not None
            assert [chained(df) for df in [*pinned, out] if chained(df)] == [], name
            if name != "sentencepiece":
                out.write.parquet(str(tmp_path / name))
                docs = spark.read.parquet(str(tmp_path / name))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_every_query_runs_twice_alike(spark, name):
    first = sorted(map(str, QUERIES[name](spark, DATA).collect()))
    assert first and first == sorted(map(str, QUERIES[name](spark, DATA).collect()))


def test_entry_without_the_subpackage(tmp_path):
    """The entry point and the other queries live without these files."""
    import shutil
    import subprocess
    import sys
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    copy = tmp_path / "copy"
    shutil.copytree(root, copy, ignore=shutil.ignore_patterns("llm", "corpus_pipeline.py", ".git", "__pycache__"))
    code = "import __spark_entry__ as e; assert e.queries() and not any(n.startswith('op1_') or n == 'pipeline' for n in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=copy, check=True, env={**os.environ, "PYTHONPATH": str(copy)})
