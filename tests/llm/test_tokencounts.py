import random

import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
import tokenizers

from tidemark.llm import tokencounts as T
from tests.llm.frames import awkward, documents, empty

MODEL = public_tokenizers.path("piece_bpe_32k.model")
JSON = ["byte_bpe_50k.json", "word_bpe_49k.json"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def encoder(path):
    with open(path, "rb") as f:
        return T.encoder_of("." + path.rsplit(".", 1)[1], f.read())


def texts(seed, n=300):
    draw = random.Random(seed)
    pools = ["abcdefgh ", "  \n\t.▁", "éàüßñ ²³½.,", "日本語テスト🙂 漢字", "the of and ing tion ", "aaaabb", "0123456789 .-+", "<s>|endoftext '\" ", "\x00\x7f​﻿́e "]
    words = "the cat's house Don't 3rd naïve über <|endoftext|> x1 -- 日本語".split()
    for k in range(n):
        if k % 2:
            yield " ".join(draw.choice(words) for _ in range(draw.randint(0, 60)))
        else:
            yield "".join(draw.choice(draw.choice(pools)) for _ in range(draw.randint(0, 200)))


@pytest.mark.parametrize("part", [1, 3, 17])
def test_cut_texts_count_like_whole_ones(library, monkeypatch, part):
    monkeypatch.setattr(T, "PART_CHARS", part)
    monkeypatch.setattr(T, "BATCH_BYTES", 64)
    rows = list(texts(part))
    assert T.count(pa.array(rows), encoder(MODEL)).tolist() == [len(library.encode(t)) for t in rows]
    pieces = [list(T.parts(t, encoder(MODEL))) for t in rows]
    assert max(map(len, pieces)) > 5  # they are cut


@pytest.mark.parametrize("name", JSON)
@pytest.mark.parametrize("part", [1, 40])
def test_json_vocabularies(monkeypatch, name, part):
    monkeypatch.setattr(T, "PART_CHARS", part)
    plain = tokenizers.Tokenizer.from_file(public_tokenizers.path(name))
    rows = list(texts(part + 5))
    assert T.count(pa.array(rows), encoder(public_tokenizers.path(name))).tolist() == [len(plain.encode(t, add_special_tokens=False)) for t in rows]


def test_a_text_without_a_safe_place_stays_whole(library):
    text = "ab" * T.PART_CHARS + "一" * 10
    assert T.count(pa.array([text]), encoder(MODEL)).tolist() == [len(library.encode(text))]


def test_awkward_rows(spark, library):
    rows = [(r.doc_id, r.text or "") for r in awkward(spark).collect()]
    want = [(i, len(t.encode()), len(library.encode(t)), len(library.encode(t)) > T.LIMIT) for i, t in rows]
    got = T.with_counts(awkward(spark), MODEL, carry=["doc_id"])
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert T.with_counts(empty(spark), MODEL, carry=["doc_id"]).count() == 0


def test_columns_are_carried_whatever_their_names(spark, library):
    docs = documents(spark, [(1, "two words"), (2, None)]).withColumnRenamed("key", "n_chars2")
    got = T.with_counts(docs, MODEL, limit=1, carry=["doc_id", "text", "score"])
    assert sorted((r.doc_id, r.text, r.score, r.n_tokens, r.over_limit) for r in got.collect())[0] == (1, "two words", "s", 2, True)


def test_unknown_files_are_refused(spark):
    with pytest.raises(ValueError):
        T.with_counts(empty(spark), "words.txt")
