"""Sparse text features: hashes of words and of the byte n-grams inside words, present or not."""

from __future__ import annotations

import numpy as np

from tidemark.llm.text import Words


def of_words(words: Words, first: np.ndarray, grams: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """(owner, hash) of the features of the words at ``first``: the word itself and its n-grams."""
    starts, size = words.starts[first], (words.ends - words.starts)[first]
    owners, hashes = [np.arange(len(first))], [words.span_hashes(starts, starts + size)]
    for n in grams:
        places = np.maximum(size - n + 1, 0)
        at = np.arange(places.sum()) - np.repeat(np.cumsum(places) - places, places) + np.repeat(starts, places)
        owners.append(np.repeat(np.arange(len(first)), places))
        hashes.append(words.span_hashes(at, at + n) ^ np.uint64(n * 0x9E3779B1))
    return np.concatenate(owners), np.concatenate(hashes)


def spread(keys: np.ndarray, groups: np.ndarray, values: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each of ``keys`` (0..n-1), the ``values`` whose group it is: (index of the key, value)."""
    order = np.argsort(groups, kind="stable")
    groups, values = groups[order], values[order]
    low = np.searchsorted(groups, np.arange(n + 1))
    many = np.diff(low)[keys]
    pick = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low[keys], many)
    return np.repeat(np.arange(len(keys)), many), values[pick]


class Chosen:
    """A fixed set of features: finds which of them the texts of a chunk hold."""

    def __init__(self, keys: np.ndarray, grams: tuple[int, ...]):
        self.keys, self.grams = keys, grams  # sorted
        self._mask = np.uint64((1 << 20) - 1)
        self._maybe = np.zeros(1 << 20, bool)
        self._maybe[(keys & self._mask).astype(np.int64)] = True

    def present(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """(row, feature index) pairs, each once."""
        nothing = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not len(words) or not len(self.keys):
            return nothing
        _, first, inverse = np.unique(words.hashes, return_index=True, return_inverse=True)
        owner, hashes = of_words(words, first, self.grams)
        ask = np.flatnonzero(self._maybe[(hashes & self._mask).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.keys, hashes[ask]), len(self.keys) - 1)
        hit = self.keys[at] == hashes[ask]
        owner, feature = owner[ask[hit]], at[hit]
        if not len(owner):
            return nothing
        held = np.zeros(len(first), bool)
        held[owner] = True
        with_hit = np.flatnonzero(held[inverse])
        index, feature = spread(inverse[with_hit], owner, feature, len(first))
        pairs = np.unique(words.rows()[with_hit[index]] * len(self.keys) + feature)
        return pairs // len(self.keys), pairs % len(self.keys)


def presence(words: Words, grams: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every feature of each text, each once, sorted by row."""
    if not len(words):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    _, first, inverse = np.unique(words.hashes, return_index=True, return_inverse=True)
    pairs = np.unique(words.rows() * len(first) + inverse)
    row, word = pairs // len(first), pairs % len(first)
    index, hashes = spread(word, *of_words(words, first, grams), len(first))
    row = row[index]
    order = np.lexsort((hashes, row))
    row, hashes = row[order], hashes[order]
    new = np.r_[True, (row[1:] != row[:-1]) | (hashes[1:] != hashes[:-1])]
    return row[new], hashes[new]
