"""Token counts of whole texts: only lengths leave the Arrow function, never ids.

A vocabulary file names its library: ``.model`` is read by sentencepiece, ``.json`` by tokenizers. The file is read once on
the driver (its size is that of a vocabulary) and sent to the tasks, each of which builds one encoder. A task encodes its rows in
batches of about ``BATCH_BYTES`` bytes whatever their number, so that many short texts share a call and a few long ones do not
pile up their ids. A text longer than ``PART_CHARS`` characters is cut where no token can hold both neighbours, and the counts
of its parts are added:

* sentencepiece: between two characters that stand side by side in no piece of the vocabulary. Parts behind the first begin with
  a character that no piece holds, so that the space the library puts before a text stays away from them; its tokens are taken off;
* tokenizers: before a space between ASCII letters or digits and a letter, which splits words in all common patterns.

A text without such a place stays whole. Nothing is shuffled.

Defined cases: a null or empty text has the tokens the library gives for an empty text; very long texts are cut as above;
repeated rows give repeated results; an empty table gives an empty result; other columns of the input do not matter, whatever
their names.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from pathlib import Path
from typing import Protocol

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
import tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from tidemark.llm.registry import query
from tidemark.sources.tables import table

#: Texts, or parts, that are encoded in one call: bytes of UTF-8.
BATCH_BYTES = 1 << 18
#: Longer texts are cut.
PART_CHARS = 1 << 15
LIMIT = 4096
SPACE = "▁"


class Encoder(Protocol):
    """Lengths of texts in tokens, and places where a long text may be cut."""

    #: Put before every part but the first of a text, and the tokens this adds.
    guard: str
    guard_tokens: int

    def lengths(self, texts: list[str]) -> list[int]: ...

    def cut(self, text: str, at: int) -> int:
        """First safe place in ``text`` from ``at`` on; its length if there is none."""


class Pieces:
    """sentencepiece model."""

    def __init__(self, serialized: bytes):
        self.library = sentencepiece.SentencePieceProcessor(model_proto=serialized)
        size = self.library.get_piece_size()
        pieces = [self.library.id_to_piece(i) for i in range(size)
                  if not (self.library.is_control(i) or self.library.is_unknown(i) or self.library.is_byte(i) or self.library.is_unused(i))]
        self.joins = {p[i:i + 2] for p in pieces for i in range(len(p) - 1)}
        self.known = {c for p in pieces for c in p}
        self.guard = next(c for c in map(chr, range(0xE000, 0xF900)) if c not in self.known)
        self.guard_tokens = self.lengths([self.guard])[0]

    def lengths(self, texts: list[str]) -> list[int]:
        return [len(ids) for ids in self.library.encode(texts, num_threads=1)]

    def cut(self, text: str, at: int) -> int:
        before = text[at - 1].replace(" ", SPACE)
        for i in range(at, len(text)):
            here = text[i].replace(" ", SPACE)
            if before + here not in self.joins and here in self.known:
                return i
            before = here
        return len(text)


class Words:
    """tokenizers file."""

    guard, guard_tokens = "", 0
    _place = re.compile(r"(?<=[A-Za-z0-9])(?= [A-Za-z])")

    def __init__(self, serialized: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.library = tokenizers.Tokenizer.from_buffer(serialized)
        self.library.no_truncation()
        self.library.no_padding()

    def lengths(self, texts: list[str]) -> list[int]:
        return [len(e) for e in self.library.encode_batch(texts, add_special_tokens=False)]

    def cut(self, text: str, at: int) -> int:
        found = self._place.search(text, at)
        return found.start() if found else len(text)


_LIBRARIES: dict[str, type[Pieces] | type[Words]] = {".model": Pieces, ".json": Words}
_encoders: dict[tuple[str, bytes], Encoder] = {}


def encoder_of(suffix: str, serialized: bytes) -> Encoder:
    """The encoder of these bytes, built once per process."""
    key = suffix, hashlib.sha256(serialized).digest()
    if key not in _encoders:
        _encoders[key] = _LIBRARIES[suffix](serialized)
    return _encoders[key]


def parts(text: str, encoder: Encoder) -> Iterator[str]:
    """A text in safely cut parts of about ``PART_CHARS`` characters."""
    start = 0
    while len(text) - start > PART_CHARS:
        stop = encoder.cut(text, start + PART_CHARS)
        if stop == len(text):
            break
        yield encoder.guard + text[start:stop] if start else text[start:stop]
        start = stop
    yield encoder.guard + text[start:] if start else text


def count(column: pa.Array, encoder: Encoder) -> np.ndarray:
    """Tokens of each text of a column."""
    totals = np.zeros(len(column), np.int64)
    rows: list[int] = []
    batch: list[str] = []
    room = BATCH_BYTES

    def encode() -> None:
        np.add.at(totals, rows, np.array(encoder.lengths(batch), np.int64))
        rows.clear()
        batch.clear()

    for row, text in enumerate(column):
        for k, part in enumerate(parts(text.as_py() or "", encoder)):
            size = len(part) if part.isascii() else len(part.encode("utf-8"))
            if batch and size > room:
                encode()
                room = BATCH_BYTES
            rows.append(row)
            batch.append(part)
            room -= size
            if k:
                totals[row] -= encoder.guard_tokens
    if batch:
        encode()
    return totals


def with_counts(docs: DataFrame, path: str, limit: int = LIMIT, carry: list[str] | None = None) -> DataFrame:
    """``carry`` columns of ``docs`` (text, ...) with n_bytes, n_tokens and over_limit."""
    carry = carry or []
    suffix = Path(path).suffix
    if suffix not in _LIBRARIES:
        raise ValueError(f"no library reads {suffix!r} files; known: {', '.join(sorted(_LIBRARIES))}")
    packed = docs.sparkSession.sparkContext.broadcast(Path(path).read_bytes())
    added = [StructField("n_bytes", LongType()), StructField("n_tokens", LongType()), StructField("over_limit", BooleanType())]
    schema = StructType([*docs.select(*carry).schema.fields, *added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(suffix, packed.value)
        for batch in batches:
            tokens = count(batch.column(len(carry)), encoder)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:len(carry)], batch.column(len(carry) + 1), pa.array(tokens), pa.array(tokens > limit)], schema.names)

    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint")
    inputs = [*map(F.col, carry), F.col("text"), size]
    return docs.select(*[c.alias(f"in{k}") for k, c in enumerate(inputs)]).mapInArrow(run, schema)


@query("op12_tokens")
def tokens(spark: SparkSession, directory: str) -> DataFrame:
    """Token count of every document."""
    docs = table(spark, directory, "documents").withColumn("doc_id", F.col("doc_id").cast("bigint"))
    return with_counts(docs, public_tokenizers.path("piece_bpe_32k.model"), carry=["doc_id"])
