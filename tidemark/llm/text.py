"""Vectorised work on the bytes of a column of texts.

An Arrow string column is one byte buffer with offsets, so word borders and hashes of all texts of a
chunk come from a few NumPy passes over that buffer, without a Python object per word. Chunks hold about
``CHUNK`` bytes (one text at least), which bounds memory whatever the batch holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

CHUNK = 1 << 20
BATCH_ROWS = 2_000
MULTIPLIER = 0x9E3779B97F4A7C15
_INVERSE = pow(MULTIPLIER, -1, 1 << 64)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Digits, lower-case letters and every byte of a character beyond ASCII.
WORD_BYTES = np.zeros(256, np.uint8)
WORD_BYTES[48:58] = WORD_BYTES[97:123] = WORD_BYTES[128:] = 1

_powers: dict[int, np.ndarray] = {}


def _geometric(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64, kept for the next chunk unless a giant text needed it."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        grown = np.empty(max(n, CHUNK + (CHUNK >> 2)), np.uint64)
        grown[0] = 1
        done, step = 1, base
        while done < len(grown):
            more = min(done, len(grown) - done)
            np.multiply(grown[:more], np.uint64(step), out=grown[done:done + more])
            done, step = done + more, step * step % (1 << 64)
        have = grown
        if n <= 2 * CHUNK:
            _powers[base] = grown
    return have[:n]


def small_batches(spark: SparkSession) -> None:
    """Hand texts to Python in batches of at most ``BATCH_ROWS`` rows in this session.

    Spark's default of 10,000 rows is meant for numbers; whole texts of that many rows fill tens of MB in the JVM and in
    the worker at once. A smaller setting of the session stays.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def buffer_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a text column; a null counts as an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    if not len(column) or column.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def chunks(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of rows of about ``CHUNK`` bytes each."""
    data, offsets = buffer_of(column)
    row, n = 0, len(offsets) - 1
    while row < n:
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + CHUNK, "right")) - 1)
        yield row, data[offsets[row]:offsets[stop]], offsets[row:stop + 1] - offsets[row]
        row = stop


def slices(batch: pa.RecordBatch, rows: int = 1_000) -> Iterator[pa.RecordBatch]:
    """A batch in parts, so that what is made from one part is handed on before the next is begun."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


class Words:
    """Words of a chunk: byte borders, first word of each text (``bounds``) and a 64-bit hash per word."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, inside: np.ndarray = WORD_BYTES, lower: bool = True):
        self.data = LOWER[data] if lower else data
        n = len(data)
        flags = np.zeros(n + 2, np.int8)
        flags[1:-1] = inside[self.data]
        steps = np.diff(flags)
        starts, ends = steps[:n] == 1, steps[1:] == -1
        cuts = offsets[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < n)]
        both = cuts[(flags[cuts] == 1) & (flags[cuts + 1] == 1)]
        starts[both] = True
        ends[both - 1] = True
        self.starts, self.ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
        self.bounds = np.searchsorted(self.starts, offsets)
        self._sums: np.ndarray | None = None

    def __len__(self) -> int:
        return len(self.starts)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def span_hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hash of any byte spans of the chunk; equal bytes give equal hashes wherever they stand."""
        if self._sums is None:
            n = len(self.data)
            self._sums = np.zeros(n + 1, np.uint64)
            np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * _geometric(MULTIPLIER, n), out=self._sums[1:])
        raw = (self._sums[ends] - self._sums[starts]) * _geometric(_INVERSE, len(self.data) + 1)[starts]
        return mix(raw)

    @property
    def hashes(self) -> np.ndarray:
        return self.span_hashes(self.starts, self.ends)

    def rows(self) -> np.ndarray:
        """Text number of each word."""
        return np.repeat(np.arange(len(self.bounds) - 1), self.counts)

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i]:self.ends[i]].tobytes()

    def phrase(self, first: int, stop: int) -> str:
        """Words ``first`` to ``stop`` - 1, joined by spaces."""
        return b" ".join(self.word(i) for i in range(first, stop)).decode("utf-8", "replace")
