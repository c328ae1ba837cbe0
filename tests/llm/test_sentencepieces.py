import hashlib
import random
import struct

import public_tokenizers
import pytest
import sentencepiece

from tidemark.llm import sentencepieces as S
from tests.llm.frames import awkward, empty

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def model():
    with open(PATH, "rb") as f:
        return S.Model(f.read())


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def test_same_ids_and_texts_as_the_library(model, library):
    draw = random.Random(5)
    pools = ["abcdefgh ", "  \n\t.▁", "éàüßñ ²³½.,", "日本語テスト🙂 漢字", "the of and ing tion ", "aaaaabbbb", "0123456789 .-+", "<s>_#%&*()[]{};'\" ", "\x00\x7f\u200b\ufeff\u0301e "]
    for k in range(4000):
        text = "".join(draw.choice(draw.choice(pools)) for _ in range(draw.randint(0, 50)))
        if k % 3 == 0:
            text = "".join(model.pieces[draw.randrange(259, 32000)].replace("▁", " ") for _ in range(6))
        ids = model.encode(text)
        assert ids == library.encode(text, add_bos=True, add_eos=True), text
        assert model.decode(ids) == library.decode(ids), text


def test_decodes_any_ids_like_the_library(model, library):
    draw = random.Random(6)
    for _ in range(3000):
        ids = [draw.choice((draw.randrange(0, 300), draw.randrange(32000))) for _ in range(draw.randint(0, 10))]
        assert model.decode(ids) == library.decode(ids), ids


def test_full_memory_changes_nothing(model, library, monkeypatch):
    monkeypatch.setattr(S, "KEPT", 3)
    text = "over and over the same few words, over and over again"
    assert model.encode(text) == library.encode(text, add_bos=True, add_eos=True)


def test_awkward_rows(spark, library):
    rows = [(r.doc_id, r.text or "") for r in awkward(spark).collect()]
    want = []
    for doc, text in rows:
        ids = library.encode(text, add_bos=True, add_eos=True)
        want.append((doc, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    assert sorted(map(tuple, S.digests(awkward(spark), PATH).collect()), key=str) == sorted(want, key=str)
    assert S.digests(empty(spark), PATH).count() == 0
    decoded = S.encoded(awkward(spark), PATH, ["doc_id"]).collect()
    assert sorted((r.doc_id, r.decoded) for r in decoded if r.doc_id) == sorted((i, t) for i, t in rows if i)
