"""Secret scans: rules, and a character convolutional network over every candidate and its context.

Rules find assignments to password-like names, access keys and long hexadecimal strings. A candidate is any run of at least
``LEAST_RUN`` characters that secrets are written in, or what rules leave over of one. The network reads a candidate piece by
piece: windows of ``WITHIN`` characters every ``SLIDE`` over all of it, and each part between separators, all with the characters
around them. The likeliest piece decides, and the whole candidate is added if that looks like a secret. It is trained with NumPy on labelled findings: candidates that a rule has confirmed
against candidates that none has. Half of the time a finding gets the surroundings of another candidate, which hides
the rule's word, so that the network learns what a secret looks like and not only the word before it. Its output is calibrated
(Platt) on a held-back fifth of either side, by all their pieces, all findings in other candidates' surroundings, since the network judges only
what no rule names; the threshold is the highest that still finds ``RECALL`` of these, whatever it costs in false alarms. The
shares found of these and of the other candidates held back are kept with the network.

Positions are found by NumPy on the bytes of many texts at once; only texts with something in them are read
further. Training reads all texts by the rules and uses every different labelled candidate of both sides. They are ordered by a digest and dealt
into buckets, whatever the order or the parts of the table; tasks train a copy of the network on each bucket, and every round
ends with the mean of the copies. Calibration and threshold are sums and an exact order statistic over all that is held back.

Defined cases: a null text is empty and has no spans; with fewer than ``LEAST_FINDINGS`` labelled findings the network adds
nothing; spans are code points, the end excluded; repeated rows give equal rows.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.registry import query
from tidemark.llm.text import CHUNK, Words, chunks, slices
from tidemark.operators.ranking import numbered, order_statistic
from tidemark.sources.tables import pin, table

# The rules.
ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
LEAST = {"assign": 6, "access": 20, "hex": 24}
KINDS = ("assign", "access", "hex", "network")

LEAST_RUN = 16
MASK = "[SECRET]"

#: Most labelled candidates a side in a bucket of training, and the fewest of a rare side.
PER_SIDE = 4_000
LEAST_SIDE = 500
LEAST_FINDINGS = 20
#: Every so many-th labelled candidate of a side is held back.
HELD = 5
RECALL = 0.95

# Shape of the network's input and of the network.
BEFORE, WITHIN, AFTER = 12, 40, 8
WIDTH = BEFORE + WITHIN + AFTER
SLIDE = 8
FILTERS, KERNEL = 24, 5
ROUNDS, BATCH, RATE = 8, 128, 0.01
#: Copies of the network that are added up by the driver; where there are more, tasks add them up first.
MOST_STATES = 64

CANDIDATE = "secret boolean, key binary, front int, size int, raw binary"
_CANDIDATE_NAMES = [part.split()[0] for part in CANDIDATE.split(", ")]
_CANDIDATE_TYPES = [pa.bool_(), pa.binary(), pa.int32(), pa.int32(), pa.binary()]


def _table(characters: str) -> np.ndarray:
    out = np.zeros(256, np.uint8)
    out[list(characters.encode())] = 1
    return out


_UPPERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_DIGITS = "0123456789"
_HEX = _table(_DIGITS + "abcdef")
_ACCESS = _table(_UPPERS + _DIGITS)
_RUN = _table(_UPPERS + _UPPERS.lower() + _DIGITS + "+/_=-")
#: What may be a secret between the separators of a candidate.
_PART = re.compile(rb"[A-Za-z0-9+]{%d,}" % LEAST_RUN)
_SIGNS = np.flatnonzero(_table(":="))
#: What may stand before the sign of an assignment: the last letters of the names, a quote or a space.
_BEFORE_SIGN = _table("dDtTnNyY\"' ")


def _classes() -> np.ndarray:
    """Symbol of each byte: 0 for nothing, letters without case, then digit, punctuation by kind, space, others."""
    out = np.full(256, 33, np.uint8)
    for i in range(26):
        out[97 + i] = out[65 + i] = 1 + i
    out[list(_DIGITS.encode())] = 27
    for k, characters in enumerate(("+/_=-.", "\"'`", ":,;()[]{}<>|", " \t", "\r\n\x0b\x0c")):
        out[list(characters.encode())] = 28 + k
    return out


_CLASS = _classes()
_UPPER = _table(_UPPERS).astype(bool)
SYMBOLS = 35  # 34 classes and a mark for capitals
#: Filters, their offsets, weights of the output and its offset.
SHAPES = ((KERNEL * SYMBOLS, FILTERS), (FILTERS,), (2 * FILTERS,), (1,))


@dataclass(frozen=True)
class Network:
    filters: np.ndarray   # (KERNEL * SYMBOLS, FILTERS)
    offsets: np.ndarray
    output: np.ndarray    # (2 * FILTERS,)
    bias: float
    slope: float = 1.0    # calibration of the output
    shift: float = 0.0
    threshold: float = 2.0  # above every probability: adds nothing
    recall: float = 0.0       # share found of the findings held back, in other candidates' surroundings
    false_alarms: float = 0.0  # share found of the other candidates held back


def pieces(data: np.ndarray, start: int, end: int) -> list[tuple[int, int]]:
    """Borders of what the network reads of a candidate: windows over all of it, then over each long part between separators."""
    parts = [(start + m.start(), start + m.end()) for m in _PART.finditer(data[start:end].tobytes())]
    out = []
    for a, b in [(start, end)] + [p for p in parts if p != (start, end)]:
        last = max(a, b - WITHIN)
        out += [(x, min(b, x + WITHIN)) for x in (*range(a, last, SLIDE), last)]
    return out


def windows(data: np.ndarray, low: np.ndarray, high: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Symbols around pieces of texts from ``low`` to ``high``: the end of what stands before, the piece, the start of what follows."""
    at = np.concatenate([starts[:, None] + np.arange(-BEFORE, WITHIN), ends[:, None] + np.arange(AFTER)], axis=1)
    stop = np.where(np.arange(WIDTH) < BEFORE + WITHIN, ends[:, None], high[:, None])
    kept = (at >= low[:, None]) & (at < stop)
    found = data[np.where(kept, at, 0)]
    return np.where(kept, _CLASS[found] + 64 * _UPPER[found], 0).astype(np.uint8)


def piece_windows(data: np.ndarray, offsets: np.ndarray, row: np.ndarray, start: np.ndarray, end: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(candidate, window) of all pieces of the candidates, some thousand at a time."""
    owner, borders = [], []
    for i, (a, b) in enumerate(zip(start.tolist(), end.tolist())):
        found = pieces(data, a, b)
        owner += [i] * len(found)
        borders += found
    owner, borders = np.array(owner, np.int64), np.array(borders, np.int64).reshape(-1, 2)
    for at in range(0, len(owner), 4096):
        mine = owner[at:at + 4096]
        yield mine, windows(data, offsets[row[mine]], offsets[row[mine] + 1], borders[at:at + 4096, 0], borders[at:at + 4096, 1])


def _one_hot(symbols: np.ndarray) -> np.ndarray:
    """(n, WIDTH) symbols to the (n, places, KERNEL * SYMBOLS) view that the filters see."""
    grid = np.zeros((*symbols.shape, SYMBOLS), np.float32)
    n, places = np.indices(symbols.shape)
    grid[n, places, symbols & 63] = 1
    grid[..., 0] = 0
    grid[..., SYMBOLS - 1] = symbols >> 6
    view = np.lib.stride_tricks.sliding_window_view(grid, KERNEL, axis=1)  # (n, places, SYMBOLS, KERNEL)
    return view.transpose(0, 1, 3, 2).reshape(len(symbols), WIDTH - KERNEL + 1, KERNEL * SYMBOLS)


def _forward(seen: np.ndarray, filters: np.ndarray, offsets: np.ndarray, output: np.ndarray, bias: float):
    places = np.maximum(seen @ filters + offsets, 0)
    pooled = np.concatenate([places.max(axis=1), places.mean(axis=1)], axis=1)
    return places, pooled, pooled @ output + bias


def logits(symbols: np.ndarray, net: Network) -> np.ndarray:
    parts = [_forward(_one_hot(symbols[i:i + 512]), net.filters, net.offsets, net.output, net.bias)[2]
             for i in range(0, len(symbols), 512)]
    return np.concatenate(parts) if parts else np.zeros(0)


def _chance(z: np.ndarray, net: Network) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(net.slope * z.astype(np.float64) + net.shift, -30, 30)))


def chances(symbols: np.ndarray, net: Network) -> np.ndarray:
    """Calibrated probability that each candidate is a secret."""
    return _chance(logits(symbols, net), net)


def _elsewhere(symbols: np.ndarray, which: np.ndarray, others: np.ndarray, draw: np.random.Generator) -> np.ndarray:
    """The windows; in ``which`` of them the candidate stands in the surroundings of one of ``others``."""
    out = symbols.copy()
    lent = others[draw.integers(0, len(others), int(which.sum()))]
    out[which, :BEFORE] = lent[:, :BEFORE]
    out[which, BEFORE + WITHIN:] = lent[:, BEFORE + WITHIN:]
    return out


def _views(state: np.ndarray) -> list[list[np.ndarray]]:
    """Weights, their first and their second moments in a flat state (3, all weights), as arrays that change it."""
    cuts = np.cumsum([0, *(math.prod(shape) for shape in SHAPES)])
    return [[row[a:b].reshape(shape) for a, b, shape in zip(cuts, cuts[1:], SHAPES)] for row in state]


def _start() -> np.ndarray:
    draw = np.random.default_rng(7)
    state = np.zeros((3, sum(map(math.prod, SHAPES))), np.float32)
    filters, _, output, _ = _views(state)[0]
    filters[:] = draw.normal(0, 0.1, filters.shape)
    output[:] = draw.normal(0, 0.1, output.shape)
    return state


def _learn(state: np.ndarray, step: int, seen: np.ndarray, secret: np.ndarray, draw: np.random.Generator) -> int:
    """One round of Adam on the windows ``seen`` of labelled candidates; changes the state, returns the count of steps so far.

    Either side weighs as much as the other.
    """
    values, first, second = _views(state)
    weight = np.where(secret, 0.5 / max(secret.mean(), 1e-3), 0.5 / max(1 - secret.mean(), 1e-3))
    for batch in np.array_split(draw.permutation(len(secret)), max(1, len(secret) // BATCH)):
        moved = secret[batch] & (draw.random(len(batch)) < 0.5)
        given = _one_hot(_elsewhere(seen[batch], moved, seen[~secret], draw))
        places, pooled, z = _forward(given, *values[:3], values[3][0])
        error = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - secret[batch]) * weight[batch] / len(batch)).astype(np.float32)
        back = error[:, None] * values[2]
        grid = np.repeat(back[:, None, FILTERS:] / places.shape[1], places.shape[1], axis=1)
        top = places.argmax(axis=1)
        np.put_along_axis(grid, top[:, None], np.take_along_axis(grid, top[:, None], 1) + back[:, None, :FILTERS], 1)
        grid *= places > 0
        flat = grid.reshape(-1, FILTERS)
        pulls = [given.reshape(-1, KERNEL * SYMBOLS).T @ flat, flat.sum(axis=0), pooled.T @ error, error.sum()[None]]
        step += 1
        for v, m, s, g in zip(values, first, second, pulls):
            m += 0.1 * (g - m)
            s += 0.001 * (g * g - s)
            v -= RATE * (m / (1 - 0.9 ** step)) / (np.sqrt(s / (1 - 0.999 ** step)) + 1e-8)
    return step


def _long(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) of the runs of at least ``least`` bytes of a kind."""
    runs = Words(data, offsets, inside, lower=False)
    keep = np.flatnonzero(runs.ends - runs.starts >= least)
    return runs.rows()[keep], runs.starts[keep], runs.ends[keep]


def findings(data: np.ndarray, offsets: np.ndarray) -> tuple[dict[int, list[tuple[int, int, int]]], tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Rule spans (start, kind, end) by row, and the candidates (row, start, end, whole); bytes of the chunk.

    A candidate is a run that no rule span touches (whole), or what is left of one before, between and behind such spans.
    """
    spans: dict[int, list[tuple[int, int, int]]] = {}
    for row, a, b in zip(*(x.tolist() for x in _long(data, offsets, _HEX, LEAST["hex"]))):
        spans.setdefault(row, []).append((a, 2, b))
    for row, a, b in zip(*(x.tolist() for x in _long(data, offsets, _ACCESS, LEAST["access"]))):
        at = data[a:b].tobytes().find(b"AKIA")
        if at >= 0 and b - a - at >= LEAST["access"]:
            spans.setdefault(row, []).append((a + at, 1, b))
    signs = np.flatnonzero(np.isin(data, _SIGNS))
    signs = signs[(signs > 0) & _BEFORE_SIGN[data[np.maximum(signs - 1, 0)]].astype(bool)]
    for row in np.unique(np.searchsorted(offsets, signs, "right") - 1).tolist():
        raw = data[offsets[row]:offsets[row + 1]].tobytes()
        text = raw.decode("utf-8")
        for m in ASSIGN.finditer(text):
            if len(m[2]) >= LEAST["assign"]:
                a = int(offsets[row]) + len(text[:m.start()].encode("utf-8"))
                spans.setdefault(row, []).append((a, 0, a + m.end() - m.start()))  # the rule matches ASCII alone
    row, start, end = _long(data, offsets, _RUN, LEAST_RUN)
    free = np.ones(len(row), bool)
    left: list[tuple[int, int, int]] = []
    for i in np.flatnonzero(np.isin(row, list(spans))).tolist():
        r, at, stop = int(row[i]), int(start[i]), int(end[i])
        inside = sorted((a, b) for a, _, b in spans[r] if a < stop and b > at)
        free[i] = not inside
        for a, b in inside + [(stop, stop)] * (not free[i]):
            if a - at >= LEAST_RUN:
                left.append((r, at, a))
            at = max(at, b)
    more = np.array(left, np.int64).reshape(-1, 3)
    whole = np.r_[np.ones(int(free.sum()), bool), np.zeros(len(more), bool)]
    return spans, (np.r_[row[free], more[:, 0]], np.r_[start[free], more[:, 1]], np.r_[end[free], more[:, 2]], whole)


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts to all labelled candidates (secret, key, front, size, raw): what the rules found, and every run that no rule touches.

    ``raw`` has the ``size`` bytes of the candidate from ``front`` on, between what stands before and behind. ``key`` is a digest of all
    windows on it, so that candidates which the network cannot tell apart have one key.
    """
    for batch in batches:
        for _, data, offsets in chunks(batch.column("text")):
            spans, (row, start, end, whole) = findings(data, offsets)
            chosen = [(r, a, b, False) for r, a, b in zip(row[whole].tolist(), start[whole].tolist(), end[whole].tolist())]
            for r, found in spans.items():
                for a, kind, b in found:
                    raw = data[a:b].tobytes()
                    value = a + (raw.rindex(ASSIGN.match(raw.decode())[2].encode()) if kind == 0 else 0)
                    if b - value >= LEAST_RUN:
                        chosen.append((r, value, b, True))
            rows = []
            for r, a, b, secret in chosen:
                low, high = int(offsets[r]), int(offsets[r + 1])
                digest = xxhash.xxh3_128()
                for _, seen in piece_windows(data, offsets, np.array([r]), np.array([a]), np.array([b])):
                    digest.update(seen.tobytes())
                low, high = max(low, a - BEFORE), min(high, b + AFTER)
                rows.append((secret, digest.digest(), a - low, b - a, data[low:high].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 5, _CANDIDATE_TYPES)], names=_CANDIDATE_NAMES)


def _labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A bounded look at a task's labelled candidates: the first ``PER_SIDE`` of either side by key. Training reads all of them."""
    kept: dict[bool, set[tuple]] = {True: set(), False: set()}
    for batch in _candidates(batches):
        for secret, *rest in zip(*(c.to_pylist() for c in batch.columns)):
            kept[secret].add(tuple(rest))
        for secret, found in kept.items():
            if len(found) > 2 * PER_SIDE:
                kept[secret] = set(heapq.nsmallest(PER_SIDE, found))
    for secret, found in kept.items():
        rows = [(secret, *rest) for rest in heapq.nsmallest(PER_SIDE, found)]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 5, _CANDIDATE_TYPES)], names=_CANDIDATE_NAMES)


def _stored(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Parts of batches of labelled candidates of about ``CHUNK`` bytes, with bytes, offsets, and the candidates' starts and ends."""
    for batch in batches:
        column = batch.column("raw").cast(pa.large_binary())
        if not len(column):
            continue
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
        data = np.frombuffer(column.buffers()[2], np.uint8)
        at = 0
        while at < len(column):
            stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK, "right")) - 1)
            part = batch.slice(at, stop - at)
            start = offsets[at:stop] + part.column("front").to_numpy()
            yield part, data, offsets[at:stop + 1], start, start + part.column("size").to_numpy()
            at = stop


def _drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Labelled candidates to (secret, place, seen): the window that each round reads, one after the other, drawn by the key."""
    for part, data, offsets, start, end in _stored(batches):
        out = []
        for i, (key, a, b) in enumerate(zip(part.column("key").to_pylist(), start.tolist(), end.tolist())):
            borders = np.array(pieces(data, a, b), np.int64)
            one = borders[[xxhash.xxh64_intdigest(key, turn) % len(borders) for turn in range(ROUNDS)]]
            out.append(windows(data, np.full(ROUNDS, offsets[i]), np.full(ROUNDS, offsets[i + 1]), one[:, 0], one[:, 1]).tobytes())
        yield pa.RecordBatch.from_arrays([part.column("secret"), part.column("place"), pa.array(out, pa.binary())], names=["secret", "place", "seen"])


def _rounds(state: np.ndarray, step: int, turn: int) -> Callable[[pa.Table], pa.Table]:
    """Trains a copy of the state on one bucket of candidates, a round for each window that they have."""
    def run(found: pa.Table) -> pa.Table:
        found = found.sort_by([("secret", "ascending"), ("place", "ascending")])
        bucket, n = found.column("bucket")[0].as_py(), found.num_rows
        seen = np.frombuffer(b"".join(found.column("seen").to_pylist()), np.uint8).reshape(n, -1, WIDTH)
        secret = found.column("secret").to_numpy()
        mine, steps, draw = state.copy(), step, np.random.default_rng([7, turn, bucket])
        for k in range(seen.shape[1]):
            steps = _learn(mine, steps, seen[:, k], secret, draw)
        return pa.table({"bucket": [bucket], "n": [1], "step": [steps], "total": pa.array([mine.astype(np.float64).tobytes()], pa.binary())})
    return run


def _summed(states: pa.Table) -> pa.Table:
    """States of some buckets, added in the order of the buckets."""
    states = states.sort_by("bucket")
    total = sum(np.frombuffer(t, np.float64) for t in states.column("total").to_pylist())
    return pa.table({"bucket": states.column("bucket")[:1], "n": [sum(states.column("n").to_pylist())], "step": [max(states.column("step").to_pylist())],
                     "total": pa.array([total.tobytes()], pa.binary())})


def _trained(learn: DataFrame, sizes: dict[bool, int]) -> Network:
    """Network from all candidates (secret, place, seen) whose places are not held back.

    They are dealt into buckets of at most ``PER_SIDE`` a side. In each round every bucket trains its own copy of the network on
    all its candidates, and the mean of the copies goes into the next round. If one side is rare, its candidates sit in several buckets, so
    that no bucket has fewer than ``LEAST_SIDE`` of them, or than there are.
    """
    buckets = math.ceil(max(sizes.values()) / PER_SIDE)
    copies = {side: math.ceil(buckets * min(n, LEAST_SIDE) / n) for side, n in sizes.items()}
    side = lambda of: F.when(F.col("secret"), of[True]).otherwise(of[False]).cast("bigint")
    rank = F.col("place") - F.expr(f"place div {HELD}") - 1
    own = F.floor(rank * buckets / side(sizes))
    every = F.transform(F.sequence(F.lit(0).cast("bigint"), side(copies) - 1), lambda k: F.pmod(own + k, F.lit(buckets)))
    dealt = pin(learn.select("secret", "place", "seen", F.explode(every).alias("bucket")))
    schema = "bucket bigint, n bigint, step bigint, total binary"
    state, step = _start(), 0
    at_once = ROUNDS if buckets == 1 else 1  # a single bucket needs no mean
    for turn in range(0, ROUNDS, at_once):
        read = dealt.withColumn("seen", F.substring("seen", turn * WIDTH + 1, at_once * WIDTH)).repartition(buckets, "bucket")
        states = read.groupBy("bucket").applyInArrow(_rounds(state, step, turn), schema)
        if buckets > MOST_STATES:
            states = states.groupBy(F.col("bucket") % MOST_STATES).applyInArrow(_summed, schema)
        done = _summed(pa.Table.from_pylist([r.asDict() for r in states.collect()]))
        step = done.column("step")[0].as_py()
        state = (np.frombuffer(done.column("total")[0].as_py(), np.float64) / done.column("n")[0].as_py()).astype(np.float32).reshape(state.shape)
    filters, offsets, output, bias = _views(state)[0]
    return Network(filters, offsets, output, float(bias[0]))


def _judged(net: Network) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Labelled candidates to (secret, z): the highest output over all pieces, each with the surroundings ``edge`` if that is given."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets, start, end in _stored(batches):
            edges = part.column("edge").to_pylist()
            lent = np.array([e is not None for e in edges])
            edge = np.frombuffer(b"".join(e or bytes(BEFORE + AFTER) for e in edges), np.uint8).reshape(-1, BEFORE + AFTER)
            z = np.full(len(edges), -np.inf)
            for owner, seen in piece_windows(data, offsets, np.arange(len(edges)), start, end):
                of = edge[owner]
                seen = np.where(lent[owner][:, None], np.concatenate([of[:, :BEFORE], seen[:, BEFORE:BEFORE + WITHIN], of[:, BEFORE:]], axis=1), seen)
                np.maximum.at(z, owner, logits(seen, net))
            yield pa.RecordBatch.from_arrays([part.column("secret"), pa.array(z)], names=["secret", "z"])
    return run


def _platt(judged: DataFrame, sizes: dict[bool, int]) -> tuple[float, float]:
    """Slope and shift of the logistic curve through softened targets: Newton steps, halved where the loss grows; one aggregate a step."""
    target = F.when(F.col("secret"), (sizes[True] + 1) / (sizes[True] + 2)).otherwise(1 / (sizes[False] + 2))
    at = last = np.array([1.0, 0.0])
    least = np.inf
    for _ in range(40):
        line = F.greatest(F.lit(-30.0), F.least(F.lit(30.0), F.col("z") * float(at[0]) + float(at[1])))
        p = 1 / (1 + F.exp(-line))
        e, w = p - target, p * (1 - p)
        row = judged.agg(F.sum(F.log1p(F.exp(line)) - target * line), F.sum(e * F.col("z")), F.sum(e),
                         F.sum(w * F.col("z") * F.col("z")), F.sum(w * F.col("z")), F.sum(w)).first()
        if row[0] > least:
            at = (at + last) / 2
        else:
            least, last = row[0], at
            move = np.linalg.solve([[row[3] + 1e-9, row[4]], [row[4], row[5] + 1e-9]], [row[1], row[2]])
            at = np.array([max(0.05, at[0] - move[0]), at[1] - move[1]])
        if np.abs(at - last).max() < 1e-6:
            break
    return float(last[0]), float(last[1])


def train(docs: DataFrame) -> Network:
    """Network from all different labelled candidates of all documents (column text); every ``HELD``-th of a side is held back."""
    found = pin(numbered(docs.select("text").mapInArrow(_candidates, CANDIDATE).dropDuplicates(["secret", "key"]), ["secret"], ["key"], "place"))
    n = {r[0]: r[1] for r in found.groupBy("secret").count().collect()}
    if min(n.get(True, 0), n.get(False, 0)) < LEAST_FINDINGS:
        return Network(*(np.zeros(shape, np.float32) for shape in SHAPES[:3]), 0.0)
    held = {side: -(-k // HELD) for side, k in n.items()}
    drawn = lambda rows: rows.mapInArrow(_drawn, "secret boolean, place bigint, seen binary")
    net = _trained(drawn(found.filter(F.col("place") % HELD != 0)), {side: n[side] - held[side] for side in n})

    # Each finding held back stands in the surroundings of another candidate held back.
    back = found.filter(F.col("place") % HELD == 0).withColumn("slot", F.expr(f"place div {HELD}"))
    edges = drawn(back.filter("not secret")).select(
        F.expr(f"place div {HELD}").alias("slot"), F.concat(F.substring("seen", 1, BEFORE), F.substring("seen", BEFORE + WITHIN + 1, AFTER)).alias("edge"))
    moved = back.filter("secret").withColumn("slot", F.col("slot") % held[False]).join(edges, "slot").drop("slot")
    stay = back.filter("not secret").withColumn("edge", F.lit(None).cast("binary")).drop("slot")
    judged = pin(moved.unionByName(stay).mapInArrow(_judged(net), "secret boolean, z double"))
    slope, shift = _platt(judged, held)
    cut = order_statistic(judged.filter("secret"), [], "z", lambda total: F.floor(total * (1 - RECALL)), "cut").first()["cut"]
    kept = {r[0]: r[1] for r in judged.groupBy("secret").agg(F.avg((F.col("z") >= cut).cast("double"))).collect()}
    net = replace(net, slope=slope, shift=shift, recall=kept[True], false_alarms=kept[False])
    return replace(net, threshold=float(_chance(np.array([cut]), net)[0]))


def spans_of(column: pa.Array, net: Network) -> list[list[tuple[int, int, int]]]:
    """Sorted spans (start, kind, end) of each text, in code points."""
    out: list[list[tuple[int, int, int]]] = []
    for _, data, offsets in chunks(column):
        spans, (row, start, end, _) = findings(data, offsets)
        if net.threshold <= 1 and len(row):
            likeliest = np.zeros(len(row))
            for owner, seen in piece_windows(data, offsets, row, start, end):
                np.maximum.at(likeliest, owner, chances(seen, net))
            for i in np.flatnonzero(likeliest >= net.threshold).tolist():
                spans.setdefault(int(row[i]), []).append((int(start[i]), 3, int(end[i])))
        base = len(out)
        out += [[] for _ in range(len(offsets) - 1)]
        for r, found in spans.items():
            text = data[offsets[r]:offsets[r + 1]]
            before = np.r_[0, np.cumsum((text & 0xC0) != 0x80)]
            out[base + r] = [(int(before[a - offsets[r]]), k, int(before[b - offsets[r]])) for a, k, b in sorted(found)]
    return out


def listing(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def with_secrets(docs: DataFrame, net: Network) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of documents (doc_id, text)."""
    sent = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = spans_of(batch.column("text"), sent.value)
            base = [[s for s in spans if s[1] < 3] for spans in every]
            counts = [pa.array([sum(k == kind for _, k, _ in b) for b in base], pa.int64()) for kind in range(3)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *counts, pa.array([hashlib.sha256(listing(b).encode()).hexdigest() for b in base], pa.string()),
                 pa.array([listing(s) for s in every], pa.string())],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string")


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each secret replaced; overlapping spans become one."""
    out, at = [], 0
    for a, _, b in spans:
        if a >= at:
            out += [text[at:a], MASK]
        at = max(at, b)
    return "".join(out) + text[at:]


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with their secrets masked in text, and n_chars, where there is one, set anew for the texts changed."""
    sent = docs.sparkSession.sparkContext.broadcast(train(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole)):
            every = spans_of(batch.column("text"), sent.value)
            if any(every):
                names = batch.schema.names
                texts = batch.column("text").to_pylist()
                hit = [i for i, s in enumerate(every) if s]
                for i in hit:
                    texts[i] = masked(texts[i], every[i])
                batch = batch.set_column(names.index("text"), "text", pa.array(texts, batch.schema.field("text").type))
                if "n_chars" in names:
                    counts = batch.column("n_chars").to_pylist()
                    for i in hit:
                        counts[i] = len(texts[i])
                    batch = batch.set_column(names.index("n_chars"), "n_chars", pa.array(counts, batch.schema.field("n_chars").type))
            yield batch

    return docs.mapInArrow(run, docs.schema)


@query("op10_secrets")
def secrets(spark: SparkSession, directory: str) -> DataFrame:
    """Secrets of every document."""
    docs = table(spark, directory, "documents")
    return with_secrets(docs, train(docs.select("doc_id", "text")))
