import hashlib
import random
import re

import numpy as np

from tidemark.llm import secrets as S
from tests.llm.frames import awkward, documents, empty

ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base(text):
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found)


def check(frame, rows):
    got = sorted(map(tuple, frame.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256").collect()), key=str)
    want = [(i, *(sum(k == kind for _, k, _ in base(t)) for kind in range(3)), hashlib.sha256(S.listing(base(t)).encode()).hexdigest()) for i, t in rows]
    assert got == sorted(want, key=str)


NOTHING = S.Network(np.zeros((S.KERNEL * S.SYMBOLS, S.FILTERS), np.float32), np.zeros(S.FILTERS, np.float32), np.zeros(2 * S.FILTERS, np.float32), 0.0)


def test_rules_match_brute_force(spark):
    draw = random.Random(2)
    parts = ["password", "Token", "api_key", "APIKEY", "secret", "passwd", "=", ":", " ", "  ", '"', "'", "abc", "AKIA", "AKIAAKIA", "0123456789abcdef", "deadbeef",
             "ABCDEFGHIJKLMNOP", "é", "日", "\n", ".", "ſecret", "toKen", "x"]
    rows = [(i, "".join(draw.choice(parts) for _ in range(draw.randint(0, 40)))) for i in range(400)]
    check(S.with_secrets(documents(spark, rows), NOTHING), rows)


def test_awkward_rows(spark):
    rows = [(r.doc_id, r.text) for r in awkward(spark).collect()]
    check(S.with_secrets(awkward(spark), S.train(awkward(spark))), rows)
    assert S.with_secrets(empty(spark), S.train(empty(spark))).count() == 0


def corpus(spark, n=600):
    draw = random.Random(8)
    hexa = lambda k: "".join(draw.choice("0123456789abcdef") for _ in range(k))
    word = lambda: "".join(draw.choice(["tion", "er", "an", "the", "ing", "ou"]) for _ in range(draw.randint(1, 6)))
    rows = []
    for i in range(n):
        text = [word() for _ in range(40)]
        if i % 4 == 0:
            text.insert(draw.randrange(40), f"password={hexa(20)}" if i % 8 else hexa(40))
        rows.append((i, " ".join(text)))
    return rows, hexa


def test_network_finds_what_no_rule_names_and_leaves_words_alone(spark):
    rows, hexa = corpus(spark)
    net = S.train(documents(spark, rows))
    new = [(i, f"some words before vault {hexa(20)} and more words behind") for i in range(50)]
    found = S.with_secrets(documents(spark, new), net).collect()
    assert sum("network:24:44" in r.spans for r in found) >= 40
    clean = [(i, "erantheou thetionertheouingan " * 5) for i in range(20)]
    assert all(r.spans == "" for r in S.with_secrets(documents(spark, clean), net).collect())


def test_redaction_masks_and_counts_anew(spark):
    docs = documents(spark, [(1, "é password=abcdef123456 end"), (2, "clean text"), (3, None)])
    out = {r.doc_id: r for r in S.redact(docs).collect()}
    assert out[1].text == f"é {S.MASK} end" and out[1].n_chars == len(out[1].text)
    assert out[2].text == "clean text" and out[2].n_chars == 1 and out[3].text is None
    assert S.redact(docs).columns == docs.columns


def test_recall_is_kept_where_secrets_are_hardly_likelier_than_others(spark):
    draw = random.Random(5)
    code = lambda: "".join(draw.choice("ghjkmnpqrstvwxyz23456789") for _ in range(20))
    rows = [(i, f"some words {'password=' if i % 3 == 0 else ''}{code()} and {i} more") for i in range(1200)]
    net = S.train(documents(spark, rows))
    new = [(i, f"other words {code()} behind") for i in range(200)]
    found = S.with_secrets(documents(spark, new), net).collect()
    assert sum("network:12:32" in r.spans for r in found) >= 170
    assert net.recall >= S.RECALL and net.false_alarms > 0.5


def test_secrets_deep_in_a_long_candidate(spark):
    rows, hexa = corpus(spark)
    net = S.train(documents(spark, rows))
    path = "/".join(["theing", "oution", "anther"] * 5)
    new = [(i, f"words {path}/{hexa(20)} behind") for i in range(50)] + [(100, f"words {path}/theingou behind")]
    found = {r.doc_id: r.spans for r in S.with_secrets(documents(spark, new), net).collect()}
    assert sum(found[i] == f"network:6:{6 + len(path) + 21}" for i in range(50)) >= 40 and found[100] == ""


def test_what_a_rule_leaves_of_a_run_is_a_candidate():
    import pyarrow as pa
    text = "x ZYXWVUTSRQPONMLK_" + "0123456789abcdef" * 2 + "-short AND QWERTZUIOPASDFGHJK/L"
    for _, data, offsets in S.chunks(pa.array([text])):
        spans, found = S.findings(data, offsets)
    assert spans == {0: [(19, 2, 51)]}
    assert [text[a:b] for a, b in zip(found[1], found[2])] == ["QWERTZUIOPASDFGHJK/L", "ZYXWVUTSRQPONMLK_"]


def test_rare_findings_of_a_large_table_train_the_network(spark):
    from pyspark.sql import functions as F
    _, hexa = corpus(spark, 4)
    value = F.substring(F.md5(F.col("doc_id").cast("string")), 1, 20)
    other = F.translate(value, "0123456789", "ghijklmnop")
    text = F.when(F.col("doc_id") % 6000 == 0, F.concat(F.lit("words password="), value, F.lit(" behind"))).otherwise(F.concat(F.lit("words vault "), other, F.lit(" behind")))
    net = S.train(spark.range(200_000).withColumnRenamed("id", "doc_id").withColumn("text", text))
    assert net.threshold <= 1 and net.recall >= S.RECALL and net.false_alarms < 0.05
    new = [(i, f"words vault {hexa(20)} behind") for i in range(50)]
    assert sum("network:12:32" in r.spans for r in S.with_secrets(documents(spark, new), net).collect()) >= 40


def test_labelled_candidates_do_not_follow_from_the_parts_of_the_table(spark, monkeypatch):
    import pyarrow as pa
    monkeypatch.setattr(S, "PER_SIDE", 20)
    rows, _ = corpus(spark)
    texts = [pa.RecordBatch.from_arrays([pa.array([t for _, t in rows[i::4]])], names=["text"]) for i in range(4)]
    kept = lambda parts: {tuple(r.values()) for part in parts for out in S._labelled(iter(part)) for r in out.to_pylist()}
    first = lambda found, kind: sorted(r[1:] for r in found if r[0] == kind)[:20]
    whole, split = kept([texts]), kept([[t] for t in texts])
    assert len(whole) == 40 and all(first(whole, kind) == first(split, kind) for kind in (True, False))


def test_every_labelled_candidate_is_read_whole(spark):
    import pyarrow as pa
    names = [f"{a}{b}" for a in ("theingouander", "erantionouing", "ouingtheander") for b in ("alpha", "betaz", "gamma")]
    long = "/".join(names * 40)
    texts = [f"x {names[0]}, {names[1]}; {names[2]} password={'0af' * 9}", long, None]
    parts = list(S._candidates(iter([pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"])])))
    rows = [r for part in parts for r in part.to_pylist()]
    values = [(r["secret"], r["raw"][r["front"]:r["front"] + r["size"]].decode()) for r in rows]
    assert sorted(values) == sorted([(False, n) for n in names[:3]] + [(True, "0af" * 9)] * 2 + [(False, long)])  # a finding of two rules
    placed = [pa.RecordBatch.from_pylist([{**r, "place": i, "edge": None} for i, r in enumerate(rows)])]
    (_, data, offsets, start, end), = S._stored(iter(placed))
    net = S.Network(*(np.random.default_rng(3).normal(size=shape).astype(np.float32) for shape in S.SHAPES[:3]), 0.0)
    found = np.full(len(rows), -np.inf)
    for owner, seen in S.piece_windows(data, offsets, np.arange(len(rows)), start, end):
        np.maximum.at(found, owner, S.logits(seen, net))
    assert [r["z"] for part in S._judged(net)(iter(placed)) for r in part.to_pylist()] == found.tolist()


def test_training_uses_all_candidates_in_buckets_of_any_table_layout(spark, monkeypatch):
    monkeypatch.setattr(S, "PER_SIDE", 40)
    monkeypatch.setattr(S, "LEAST_SIDE", 30)
    monkeypatch.setattr(S, "MOST_STATES", 3)
    rows, _ = corpus(spark)
    docs, learnt = documents(spark, rows), []
    trained = S._trained

    def noted(learn, sizes):
        learnt.append(({r[0]: r[1] for r in learn.groupBy("secret").count().collect()}, sizes))
        return trained(learn, sizes)

    monkeypatch.setattr(S, "_trained", noted)
    nets = [S.train(d) for d in (docs, docs.repartition(7))]
    different = docs.select("text").mapInArrow(S._candidates, S.CANDIDATE).select("secret", "key").distinct().groupBy("secret").count().collect()
    sizes = {r[0]: r[1] - -(-r[1] // S.HELD) for r in different}
    assert learnt == [(sizes, sizes)] * 2 and min(sizes.values()) > 2 * S.PER_SIDE
    assert all(np.array_equal(getattr(nets[0], k), getattr(nets[1], k)) for k in ("filters", "offsets", "output"))
    assert np.allclose([nets[0].threshold, nets[0].recall, nets[0].false_alarms], [nets[1].threshold, nets[1].recall, nets[1].false_alarms])
    assert nets[0].recall >= S.RECALL and nets[0].false_alarms < 0.1
