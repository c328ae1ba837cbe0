"""Encoding and decoding with a merge-type SentencePiece model, by backtracking.

The library builds an encoding by merging the best adjacent pair again and again. Here the result is found
from left to right instead: take the longest piece at the current place (Aho-Corasick over the vocabulary), and
accept it if it is compatible with the piece before it, that is, if merging the characters of both afresh
gives the two pieces back. If not, try the next shorter piece; if none is left, mark the place as failed in a bit
field and step back. A sequence whose neighbours are all compatible is the one that merging gives.

Texts are first cut where no piece of the vocabulary holds both neighbouring characters, since no merge can
cross such a border; the encodings of recent stretches are kept in each worker, up to ``KEPT``.
The model is read by its path on the driver and sent to the tasks; only the identity normaliser is supported.

Defined cases: a null text is empty; an empty text is the begin and end ids alone, and decodes to an empty text;
characters outside the vocabulary become byte pieces; repeated rows give repeated results.
"""

from __future__ import annotations

import codecs
import hashlib
import re
from collections.abc import Callable, Iterator
from itertools import chain
from pathlib import Path

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from tidemark.llm.registry import query
from tidemark.sources.tables import table

SPACE = "▁"
#: Stretches kept per worker; when full, the memory starts anew.
KEPT = 200_000
#: Longer stretches are not kept.
_LONG = 48
_ROWS = 256

_NORMAL, _UNKNOWN, _CONTROL, _USER, _BYTE = 1, 2, 3, 4, 6
_NEVER = float("-inf")


def _letter(c: str) -> bool:
    return bool(re.match(r"[^\W\d_]", c))


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protocol-buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = number()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, number()
        else:
            size = {1: 8, 5: 4}.get(kind) or number()
            yield tag >> 3, data[at:at + size]
            at += size


class _Kept(dict):
    """Ids by stretch; a stretch asked for the first time is encoded."""

    def __init__(self, encode: Callable[[str], list[int]]):
        super().__init__()
        self.encode = encode

    def __missing__(self, stretch: str) -> tuple[int, ...]:
        ids = tuple(self.encode(stretch))
        if len(stretch) <= _LONG:
            if len(self) >= KEPT:
                self.clear()
            self[stretch] = ids
        return ids


class Model:
    """Vocabulary of a merge-type model with byte fallback."""

    def __init__(self, serialized: bytes):
        self.pieces: list[str] = []
        self.kinds: list[int] = []
        scores: list[float] = []
        self.prefix, self.begin, self.end = True, 1, 2
        for field, value in _fields(serialized):
            if field == 1:
                piece = dict(_fields(value))
                self.pieces.append(piece[1].decode("utf-8"))
                scores.append(float(np.frombuffer(piece.get(2, bytes(4)), "<f4")[0]))
                self.kinds.append(piece.get(3, _NORMAL))
            elif field == 2:
                trainer = dict(_fields(value))
                if trainer.get(3, 1) != 2:
                    raise ValueError("only merge-type models are supported")
                self.begin, self.end = trainer.get(41, 1), trainer.get(42, 2)
            elif field == 3:
                normaliser = dict(_fields(value))
                if normaliser.get(2) or normaliser.get(4, 1):
                    raise ValueError("only the identity normaliser is supported")
                self.prefix = bool(normaliser.get(3, 1))
        if _USER in self.kinds:
            raise ValueError("user-defined pieces are not supported")
        self.ids = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k == _NORMAL}
        self.score = {p: scores[i] for p, i in self.ids.items()}
        self.bytes = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k == _BYTE}
        self.known = {p for p in self.ids if len(p) == 1}
        self.joins = {p[i:i + 2] for p in self.ids for i in range(len(p) - 1)}
        if any(j[1] == SPACE != j[0] for j in self.joins):
            raise ValueError("pieces that hold a space behind another character are not supported")
        # A coarse cut: letters, or others, behind their spaces. Letters that meet others in a piece count as others.
        odd = "".join(re.escape(c) for j in self.joins if j[0] != SPACE and _letter(j[0]) != _letter(j[1]) for c in j if _letter(c))
        self.cutter = re.compile(rf" *[^\W\d_{odd}]+| *(?:(?! )[\W\d_{odd}])+| +")
        self.controls = {i for i, k in enumerate(self.kinds) if k == _CONTROL}
        self.surface = [self._surface(p, k) for p, k in zip(self.pieces, self.kinds)]
        # Only pieces that merging can reach can stand in an encoding.
        self.reached = {p for p in self.ids if len(p) == 1 or self.merge(p) == [p]}
        self.automaton = ahocorasick.Automaton()
        for p in self.reached:
            self.automaton.add_word(p, p)
        self.automaton.make_automaton()
        self._compatible: dict[tuple[str, str], bool] = {}
        self._shorter: dict[str, str | None] = {}
        self._words = _Kept(self._word)
        self._parts = _Kept(self.stretch)

    @staticmethod
    def _surface(piece: str, kind: int) -> bytes:
        if kind == _BYTE:
            return bytes([int(piece[3:5], 16)])
        return {_NORMAL: piece.replace(SPACE, " "), _UNKNOWN: " ⁇ "}.get(kind, "").encode("utf-8")

    # -- encoding ------------------------------------------------------------------------------------------

    def merge(self, text: str) -> list[str]:
        """Merge the best adjacent pair, the leftmost on ties, until none is a piece."""
        score, parts = self.score.get, list(text)
        pairs = [score(a + b, _NEVER) for a, b in zip(parts, parts[1:])]
        while pairs and (best := max(pairs)) != _NEVER:
            i = pairs.index(best)
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i:
                pairs[i - 1] = score(parts[i - 1] + parts[i], _NEVER)
            if i < len(pairs):
                pairs[i] = score(parts[i] + parts[i + 1], _NEVER)
        return parts

    def compatible(self, left: str, right: str) -> bool:
        """Whether merging the characters of both pieces afresh gives just these two pieces."""
        if len(self._compatible) > KEPT:
            self._compatible.clear()
        known = self._compatible[left, right] = self.merge(left + right) == [left, right]
        return known

    def shorter(self, piece: str) -> str | None:
        """The next shorter piece that starts ``piece``."""
        if piece not in self._shorter:
            starts = (piece[:n] for n in range(len(piece) - 1, 0, -1))
            self._shorter[piece] = next((p for p in starts if p in self.reached), None)
        return self._shorter[piece]

    def backtrack(self, text: str, longest: list[str]) -> list[str]:
        """Encoding of a stretch whose characters are all pieces; ``longest`` has the longest piece at each place."""
        n, at, piece, out = len(text), 0, longest[0], []
        known = self._compatible.get
        open_places = (1 << (n + 1)) - 1  # a bit is cleared once no encoding goes on from its place
        while at < n:
            last = out[-1] if out else None
            while True:
                stop = at + len(piece)
                if open_places >> stop & 1:
                    fits = last is None or known((last, piece))
                    if fits is None:
                        fits = self.compatible(last, piece)
                    if fits:
                        out.append(piece)
                        at = stop
                        piece = longest[at] if at < n else None
                        break
                piece = self.shorter(piece)
                if piece is None:
                    open_places &= ~(1 << at)
                    piece = out.pop()
                    at -= len(piece)
                    break
        return out

    def stretch(self, text: str) -> list[int]:
        """Ids of a stretch with marked spaces; characters outside the vocabulary become bytes."""
        longest: list[str | None] = [None] * len(text)
        for end, piece in self.automaton.iter(text):
            longest[end + 1 - len(piece)] = piece  # longer pieces of the same start end later
        ids = self.ids
        if None not in longest:
            return [ids[p] for p in self.backtrack(text, longest)]
        out: list[int] = []
        start = 0
        for i in range(1, len(text) + 1):
            if i < len(text) and text[i - 1:i + 1] in self.joins:
                continue  # no border here
            part = text[start:i]
            if part in self.known or len(part) > 1:
                out += [ids[p] for p in self.backtrack(part, longest[start:i])]
            else:
                out += [self.bytes[b] for b in part.encode("utf-8")]
            start = i
        return out

    def _word(self, word: str) -> list[int]:
        """Ids of what stands between two spaces, the first of them included."""
        first, *rest = self.cutter.findall(" " + word)
        if not rest:
            return self.stretch(SPACE + word)
        ids = list(self.stretch(SPACE) if first == " " else self._words[first[1:]])
        for part in rest:
            ids.extend(self._parts[part])
        return ids

    def encode(self, text: str, ends: bool = True) -> list[int]:
        """All ids of a text, begin and end included if ``ends``."""
        text = text.replace(SPACE, " ")
        words = text.split(" ")
        if not text:
            ids: list[int] = []
        elif self.prefix and "" not in words:
            ids = list(chain.from_iterable(map(self._words.__getitem__, words)))
        else:
            parts = self.cutter.findall(" " + text if self.prefix else text)
            ids = list(chain.from_iterable(self._parts[p.replace(" ", SPACE)] for p in parts))
        return [self.begin, *ids, self.end] if ends else ids

    # -- decoding ------------------------------------------------------------------------------------------

    def decode(self, ids: list[int]) -> str:
        """Text of ids: control ids vanish, byte pieces join, the space put before the text goes."""
        if self.controls.isdisjoint(ids[1:-1]):
            runs = [ids]
        else:  # bytes on both sides of a control id do not join
            cuts = [-1, *(k for k, i in enumerate(ids) if i in self.controls), len(ids)]
            runs = [ids[a + 1:b] for a, b in zip(cuts, cuts[1:])]
        text = ""
        for run in runs:
            raw = b"".join([self.surface[i] for i in run])
            if self.prefix and not text and raw[:1] == b" ":
                raw = raw[self.kinds[next(i for i in run if self.surface[i])] == _NORMAL:]
            try:
                text += raw.decode("utf-8")
            except UnicodeDecodeError:  # byte pieces that are no character: one mark for each byte
                text += raw.decode("utf-8", "tidemark-byte")
        return text


def _mark(error: UnicodeError) -> tuple[str, int]:
    return "\ufffd", error.start + 1


codecs.register_error("tidemark-byte", _mark)

_models: dict[bytes, Model] = {}


def model_of(serialized: bytes) -> Model:
    """The model of these bytes, built once per process."""
    key = hashlib.sha256(serialized).digest()
    if key not in _models:
        _models[key] = Model(serialized)
    return _models[key]


def encoded(docs: DataFrame, model_path: str, carry: list[str] | None = None) -> DataFrame:
    """``carry`` columns of (text, ...) with ``ids`` (array of int) and ``decoded`` (string).

    The model file (bounded by its vocabulary) is read here and sent to the tasks with the function.
    """
    carry = carry or []
    packed = docs.sparkSession.sparkContext.broadcast(Path(model_path).read_bytes())
    schema = StructType([*docs.select(*carry).schema.fields, StructField("ids", ArrayType(IntegerType())), StructField("decoded", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(packed.value)
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):  # ids take more room than their text
                part = batch.slice(at, _ROWS)
                ids = [model.encode(t or "") for t in part.column("text").to_pylist()]
                decoded = [model.decode(i) for i in ids]
                yield pa.RecordBatch.from_arrays(
                    [part.column(c) for c in carry] + [pa.array(ids, pa.list_(pa.int32())), pa.array(decoded, pa.string())],
                    names=carry + ["ids", "decoded"])

    return docs.select(*carry, "text").mapInArrow(run, schema)


def digests(docs: DataFrame, model_path: str) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256, decoded_sha256.

    The ids are hashed where they arise, so that they need not be moved.
    """
    packed = docs.sparkSession.sparkContext.broadcast(Path(model_path).read_bytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(packed.value)
        for batch in batches:
            counts, of_ids, of_text = [], [], []
            for text in batch.column("text"):
                ids = model.encode(text.as_py() or "")
                counts.append(len(ids))
                of_ids.append(hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
                of_text.append(hashlib.sha256(model.decode(ids).encode("utf-8")).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(of_ids), pa.array(of_text)],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


@query("op7_sentencepiece")
def sentencepiece(spark: SparkSession, directory: str) -> DataFrame:
    """Ids of every document, and the text they decode to."""
    return digests(table(spark, directory, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
