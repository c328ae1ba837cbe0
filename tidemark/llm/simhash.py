"""SimHash near-duplicates by a byte-position inverted index with count filtering.

A 64-bit fingerprint is eight positional bytes. Fingerprints that differ in at most three bits differ in at
most three bytes, so they share at least five: the guaranteed minimum. The index lists fingerprints under
four positional bytes at a time, for the fourteen sets of four positions of the quadruple system on eight
points, in which any three positions lie in exactly one set and the complement of a set is again a set. So
whatever three bytes differ, one listed set avoids them all, and every pair to be found meets in a list. (Lists
under a single byte would hold a 256th of all fingerprints each, and their pairs would grow with the square
of the input.) Inside a list the shared positional bytes of each pair are tallied, pairs below five are dropped
and the others verified by their differing bits. Equal fingerprints are collapsed first.

A long list is searched through midpoints instead of pairs: two values differ in at most three bits if and only
if some value differs from one in at most one bit and from the other in at most two. That takes a fixed number of
values per member and gives the same links' components. Up to ``IN_TASK`` members that happens where the list is; the members of
a longer one pass through that task without being held, and Spark deals out their midpoints. A midpoint has at most 2,081 members,
since they differ from it in two bits at most, so no key is hot there.

Defined cases: a null or empty text has fingerprint zero and is linked like any other; rows with the same
doc_id are one document each and share a component only if their fingerprints are linked; a component without any
id has a null component_id.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.components import components
from tidemark.llm.registry import query
from tidemark.llm.rows import without
from tidemark.llm.text import LOWER, chunks
from tidemark.sources.tables import pin, table

SHINGLE = 3
SEED = 42
DISTANCE = 3
BYTES = 8
#: Lists up to this length are tallied pair by pair; longer ones go through midpoints, with the same result.
PAIRWISE = 1024
#: Lists longer than this are not held by one task.
IN_TASK = 1 << 14


def quadruples() -> list[tuple[int, ...]]:
    """The fourteen 4-sets of positions 0..7 whose members, seen as 3-bit vectors, add up to zero."""
    return [(a, b, c, a ^ b ^ c) for a in range(BYTES) for b in range(a + 1, BYTES) for c in range(b + 1, BYTES)
            if a ^ b ^ c > c]


MASKS = [sum(0xFF << (8 * p) for p in positions) for positions in quadruples()]


def _shingle_hashes(raw: bytes) -> list[int]:
    words = raw.split()  # splits at exactly the six ASCII white-space bytes
    joined = b" ".join(words)
    if len(words) <= SHINGLE:
        return [xxhash.xxh64_intdigest(joined, SEED)] if words else []
    ends = [e + i for i, e in enumerate(accumulate(map(len, words)))]
    starts = [0] + [e + 1 for e in ends[:-SHINGLE]]
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], SEED) for a, b in zip(starts, ends[SHINGLE - 1:])]


def fingerprints(column: pa.Array) -> np.ndarray:
    """SimHash of each text over its word shingles, repeats included."""
    out = np.zeros(len(column), np.uint64)
    for first, data, offsets in chunks(column):
        low = LOWER[data]
        for i in range(len(offsets) - 1):
            hashes = np.array(_shingle_hashes(low[offsets[i]:offsets[i + 1]].tobytes()), np.uint64)
            if not len(hashes):
                continue
            ones = np.zeros(64, np.int64)
            for at in range(0, len(hashes), 1 << 16):
                part = hashes[at:at + (1 << 16)].view(np.uint8).reshape(-1, BYTES)
                ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            out[first + i] = np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0]
    return out


def with_fingerprints(docs: DataFrame) -> DataFrame:
    """(uid, doc_id, fp) of documents (doc_id, text); uid is the place of the row in its table."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = fingerprints(batch.column("text")).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("uid"), batch.column("doc_id"), pa.array(values)],
                                             names=["uid", "doc_id", "fp"])
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return rows.mapInArrow(run, "uid bigint, doc_id bigint, fp bigint")


def _roots(links: tuple[np.ndarray, np.ndarray], n: int) -> np.ndarray:
    """Smallest member index reachable, by repeated minima along links and pointer jumps."""
    label, (a, b) = np.arange(n), links
    while True:
        before = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == before).all():
            return label


def _pairs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs that share enough positional bytes and differ in few enough bits."""
    a, b = np.triu_indices(len(values), 1)
    differing = values[a] ^ values[b]
    tally = (differing.view(np.uint8).reshape(-1, BYTES) == 0).sum(axis=1)
    kept = tally >= BYTES - DISTANCE
    kept[kept] = np.bitwise_count(differing[kept]) <= DISTANCE
    return a[kept], b[kept]


def _reached(values: np.ndarray, free: list[np.uint64]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(midpoint, beyond, member): what each value reaches by flipping up to one (beyond 0) or exactly two (1) of the free bits."""
    flips = np.array([0, *free] + [x | y for i, x in enumerate(free) for y in free[i + 1:]], np.uint64)
    beyond = (np.arange(len(flips)) > len(free)).astype(np.int8)
    return (values ^ flips[:, None]).ravel(), np.repeat(beyond, len(values)), np.tile(np.arange(len(values)), len(flips))


def _bits(mask: int) -> list[np.uint64]:
    return [np.uint64(1 << k) for k in range(64) if mask >> k & 1]


def _midpoints(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links with the same components as ``_pairs``, in time and memory linear in the list's length."""
    common = int(np.bitwise_and.reduce(values) | ~np.bitwise_or.reduce(values))
    key, beyond, owner = _reached(values, _bits(~common & (1 << 64) - 1))
    order = np.lexsort((beyond, key))
    return _stars((key[order],), beyond[order], owner[order])


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Where the groups of equal keys of sorted rows begin."""
    changed = np.zeros(len(keys[0]), bool)
    changed[:1] = True
    for key in keys:
        changed[1:] |= key[1:] != key[:-1]
    return np.flatnonzero(changed)


def _stars(keys: tuple[np.ndarray, ...], beyond: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of the members of each midpoint to its nearest one, if that is at most one bit away; rows sorted by keys and beyond."""
    first = _starts(*keys)
    size = np.diff(np.r_[first, len(owner)])
    hub, near = np.repeat(owner[first], size), np.repeat(beyond[first] == 0, size)
    link = near & (hub != owner)
    pairs = np.unique(np.stack([hub[link], owner[link]]), axis=1)
    return pairs[0], pairs[1]


def _links_of_lists(batches: Iterator[pa.RecordBatch], pairwise: int, in_task: int) -> Iterator[pa.RecordBatch]:
    """Rows (slot, bytes, fp), sorted, to links (u, v) between fingerprints, a spanning star per linked set of a list; the members of
    lists over ``in_task`` go on as (slot, u) as they come."""
    rest, going_on = None, None
    for batch in batches:
        now = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("slot", "bytes", "fp")]
        if rest is not None:
            now = [np.concatenate(x) for x in zip(rest, now)]
        slot, key, fp = now
        if not len(fp):
            continue
        first = _starts(slot, key)
        if going_on == (slot[0], key[0]):  # the rest of a list that goes on
            end = first[1] if len(first) > 1 else len(fp)
            yield _passed_on(slot[:end], fp[:end])
            slot, key, fp, first = slot[end:], key[end:], fp[end:], first[1:] - end
        if not len(first):
            rest = None
            continue
        rest = [x[first[-1]:] for x in (slot, key, fp)]
        yield from _links(slot, fp[:first[-1]], first[:-1], pairwise, in_task)
        going_on = None
        if len(rest[2]) > in_task:
            yield _passed_on(rest[0], rest[2])
            rest, going_on = None, (rest[0][0], rest[1][0])
    if rest is not None:
        yield from _links(rest[0], rest[2], np.zeros(1, int), pairwise, in_task)


def _passed_on(slot: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(slot, pa.int32()), pa.array(fp), pa.nulls(len(fp), pa.int64())], names=["slot", "u", "v"])


def _links(slot: np.ndarray, fp: np.ndarray, first: np.ndarray, pairwise: int, in_task: int) -> Iterator[pa.RecordBatch]:
    u, v = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    size = np.diff(np.r_[first, len(fp)])
    for at, n in zip(first[size > 1].tolist(), size[size > 1].tolist()):
        if n > in_task:
            yield _passed_on(slot[at:at + n], fp[at:at + n])
            continue
        values = fp[at:at + n].view(np.uint64)
        root = _roots(_pairs(values) if n <= pairwise else _midpoints(values), n)
        moved = np.flatnonzero(root != np.arange(n))
        u.append(fp[at:at + n][moved])
        v.append(fp[at:at + n][root[moved]])
    u, v = np.concatenate(u), np.concatenate(v)
    yield pa.RecordBatch.from_arrays([pa.nulls(len(u), pa.int32()), pa.array(u), pa.array(v)], names=["slot", "u", "v"])


def _reached_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (slot, u) to their midpoints within the list, a bounded number of members at a time."""
    free = [_bits(~mask & (1 << 64) - 1) for mask in MASKS]
    for batch in batches:
        slots, values = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("slot", "u"))
        for slot in np.unique(slots):
            mine = values[slots == slot].view(np.uint64)
            for part in (mine[i:i + 512] for i in range(0, len(mine), 512)):
                key, beyond, owner = _reached(part, free[slot])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(key), slot, np.int32)), pa.array(key.view(np.int64)), pa.array(beyond), pa.array(part[owner].view(np.int64))],
                    names=["slot", "midpoint", "beyond", "fp"])


def _links_of_midpoints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (slot, midpoint, beyond, fp) to links; of a midpoint that spans batches only its first row is kept."""
    held = None
    for batch in batches:
        now = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("slot", "midpoint", "beyond", "fp")]
        if held is not None:
            now = [np.concatenate(x) for x in zip(held, now)]
        if not len(now[0]):
            continue
        slot, midpoint, beyond, fp = now
        last = _starts(slot, midpoint)[-1]
        held = [x[last:last + 1] for x in now]
        u, v = _stars((slot, midpoint), beyond, fp)
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])


def linked(prints: DataFrame, pairwise: int = PAIRWISE, in_task: int = IN_TASK) -> DataFrame:
    """Links (u, v) between distinct fingerprints (column fp) at ``DISTANCE`` or fewer bits; components are complete."""
    listed = prints.select("fp", F.inline(F.array(*[
        F.struct(F.lit(i).alias("slot"), F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m)).alias("bytes"))
        for i, m in enumerate(MASKS)])))
    lists = listed.repartition("slot", "bytes").sortWithinPartitions("slot", "bytes")
    found = pin(lists.mapInArrow(lambda batches: _links_of_lists(batches, pairwise, in_task), "slot int, u bigint, v bigint"))
    links, members = found.filter("v IS NOT NULL").select("u", "v"), found.filter("v IS NULL").select("slot", "u")
    if members.isEmpty():
        return links
    reached = members.repartition("slot", "u").mapInArrow(_reached_rows, "slot int, midpoint bigint, beyond tinyint, fp bigint")
    met = reached.repartition("slot", "midpoint").sortWithinPartitions("slot", "midpoint", "beyond", "fp")
    return links.union(met.mapInArrow(_links_of_midpoints, "u bigint, v bigint"))


def near_duplicates(docs: DataFrame, pairwise: int = PAIRWISE, in_task: int = IN_TASK) -> DataFrame:
    """Per document: uid, doc_id, fingerprint, component_id, and ``keeper``, the uid of its component's first document."""
    prints = pin(with_fingerprints(docs))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "uid"))
    classes = prints.groupBy("fp").agg(first.alias("first"))
    roots = components(linked(classes.select("fp"), pairwise, in_task)).withColumnsRenamed({"node": "fp"})
    rooted = classes.join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "first")
    best = rooted.groupBy("root").agg(F.min("first").alias("best"))
    of_class = rooted.join(best, "root").select("fp", "best.doc_id", "best.uid")
    return (prints.join(of_class.select("fp", F.col("doc_id").alias("component_id"), F.col("uid").alias("keeper")), "fp")
            .select("uid", "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "keeper"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each component: the one with the smallest doc_id, the first row on ties."""
    return without(docs, near_duplicates(docs).filter("uid != keeper"))


@query("op8_simhash")
def simhash(spark: SparkSession, directory: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    return near_duplicates(table(spark, directory, "documents")).select("doc_id", "fingerprint", "component_id")
