"""A minimal perfect hash over distinct 128-bit keys with arrays of values beside it.

Levels of bit arrays, twice as long as the keys that are left: a key whose bit no other key of
the level wants is placed there, the others go on to the next level. The rank of a key's bit
among all set bits is its position, so n keys take positions 0 to n-1 in about 4 bits each.
"""

from __future__ import annotations

import numpy as np

from gaugeflow.llm.packed import mix


class PerfectHash:
    def __init__(self, a: np.ndarray, b: np.ndarray):
        """a, b: the two halves of the keys, each pair once."""
        self._levels: list[tuple[np.ndarray, np.ndarray, int]] = []
        self.size, placed = len(a), 0
        while len(a):
            bits = -(-2 * len(a) // 64) * 64
            at = self._slot(a, b, len(self._levels), bits)
            alone = np.bincount(at, minlength=bits) == 1
            words = np.packbits(alone, bitorder="little").view(np.uint64)
            before = np.cumsum(np.bitwise_count(words), dtype=np.int64) - np.bitwise_count(words)
            self._levels.append((words, before + placed, bits))
            placed += int(alone.sum())
            left = ~alone[at]
            a, b = a[left], b[left]

    @staticmethod
    def _slot(a, b, level, bits):
        return (mix(a ^ mix(b + np.uint64(level))) % np.uint64(bits)).astype(np.int64)

    def positions(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Of each key; a key that was not given gets any position or -1, which its fingerprint tells."""
        out = np.full(len(a), -1, np.int64)
        open_ = np.arange(len(a))
        for level, (words, before, bits) in enumerate(self._levels):
            if not len(open_):
                break
            at = self._slot(a[open_], b[open_], level, bits)
            word, bit = words[at >> 6], (at & 63).astype(np.uint64)
            there = (word >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
            out[open_[there]] = (before[at >> 6] + below)[there]
            open_ = open_[~there]
        return out


class Counted:
    """Keys with a fingerprint, a count and the largest holder, all in arrays by perfect-hash position.

    The position comes from both halves of a key and the fingerprint is the second half, so a
    foreign key passes with a chance of 2^-64."""

    def __init__(self, a, b, count, last):
        order = np.lexsort((b, a))
        a, b, count, last = a[order], b[order], count[order], last[order]
        first = np.ones(len(a), bool)
        first[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        keys = a[first], b[first]
        self._hash = PerfectHash(*keys)
        place = self._hash.positions(*keys)
        starts = np.flatnonzero(first)
        self._print = np.zeros(len(place), np.uint64)
        self._count = np.zeros(len(place), np.int64)
        self._last = np.zeros(len(place), np.int64)
        self._print[place] = keys[1]
        if len(starts):
            self._count[place] = np.add.reduceat(count.astype(np.int64), starts)
            self._last[place] = np.maximum.reduceat(last, starts)

    def probe(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Count (0 for a key that is not held) and largest holder."""
        at = self._hash.positions(a, b)
        if not self._hash.size:
            return np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
        held = (at >= 0) & (self._print[at] == b)
        return np.where(held, self._count[at], 0), np.where(held, self._last[at], 0)
