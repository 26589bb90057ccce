"""Elias-Fano sequences and n-gram levels that are searched in their packed form.

A sequence keeps the low bits of its values side by side and the high bits in
unary.  ``get`` selects the one that stands for a value; ``successor`` selects
the zeros around a value's high bits, and looks only at the few low bits
between.  Both take many positions or values at once, and neither unpacks the
sequence: it may be a mapped file.
"""

from __future__ import annotations

import struct
from typing import NamedTuple

import numpy as np

_HEAD = struct.Struct("<QQQQ")
_ONE, _SIX = np.uint64(1), np.uint64(6)
#: Values that are looked up at once; what that takes stays in a core's cache.
CHUNK = 1 << 15


def _select_table() -> np.ndarray:
    """The place of the k-th one in each byte."""
    out = np.zeros((256, 8), np.uint8)
    for byte in range(256):
        at = [k for k in range(8) if byte >> k & 1]
        out[byte, : len(at)] = at
    return out


_SELECT = _select_table()


def _words(bits: np.ndarray) -> np.ndarray:
    """Bits, lowest first, as 64-bit words."""
    packed = np.packbits(bits, bitorder="little")
    return np.concatenate([packed, np.zeros(-len(packed) % 8, np.uint8)]).view(np.uint64)


def _within(words: np.ndarray, k: np.ndarray) -> np.ndarray:
    """The place of the k-th one in each word."""
    at = np.zeros(len(words), np.int64)
    for half in (32, 16, 8):
        many = np.bitwise_count(words & np.uint64((1 << half) - 1)).astype(np.int64)
        up = k >= many
        k = np.where(up, k - many, k)
        words = np.where(up, words >> np.uint64(half), words)
        at += up * half
    return at + _SELECT[(words & np.uint64(255)).astype(np.int64), k]


class EliasFano(NamedTuple):
    """An ascending sequence of numbers below 2**63."""

    n: int
    width: int  # low bits of a value
    low: np.ndarray
    high: np.ndarray
    ones: np.ndarray  # in the words of ``high`` before each

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        n = len(values)
        top = int(values[-1]) if n else 0
        width = max(0, (top // max(n, 1)).bit_length() - 1)
        values = values.astype(np.uint64)
        low = np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, count=width, bitorder="little").ravel()
        at = (values >> np.uint64(width)).astype(np.int64) + np.arange(n)
        bits = np.zeros(n + (top >> width) + 2, np.uint8)
        bits[at] = 1
        high = _words(bits)
        ones = np.concatenate([[0], np.cumsum(np.bitwise_count(high), dtype=np.int64)]).astype(np.uint32)
        return cls(n, width, np.concatenate([_words(low), np.zeros(1, np.uint64)]), high, ones)

    def dump(self) -> bytes:
        """Header and words; each part is padded to 8 bytes, so that a mapped file can be read in place."""
        ones = self.ones.tobytes()
        return _HEAD.pack(self.n, self.width, len(self.low), len(self.high)) + self.low.tobytes() + self.high.tobytes() + ones + b"\0" * (-len(ones) % 8)

    @classmethod
    def load(cls, buffer, at: int) -> tuple[EliasFano, int]:
        n, width, a, b = _HEAD.unpack_from(buffer, at)
        at += _HEAD.size
        low = np.frombuffer(buffer, np.uint64, a, at)
        at += 8 * a
        high = np.frombuffer(buffer, np.uint64, b, at)
        at += 8 * b
        return cls(n, width, low, high, np.frombuffer(buffer, np.uint32, b + 1, at)), at + -(-4 * (b + 1) // 8) * 8

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(i), np.uint64)
        bit = i.astype(np.uint64) * np.uint64(self.width)
        word, off = (bit >> _SIX).astype(np.int64), bit & np.uint64(63)
        return ((self.low[word] >> off) | ((self.low[word + 1] << _ONE) << (np.uint64(63) - off))) & np.uint64((1 << self.width) - 1)

    def _zeros(self) -> np.ndarray:
        """The zeros in the words of ``high`` before each."""
        return np.arange(len(self.ones), dtype=np.int64) * 64 - self.ones

    def _zero(self, k: np.ndarray, zeros: np.ndarray) -> np.ndarray:
        """The place of the k-th zero in the high bits."""
        word = np.searchsorted(zeros, k, "right") - 1
        return word * 64 + _within(~self.high[word], k - zeros[word])

    def _range(self, high: np.ndarray, zeros: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions, from and to, of the values with these high bits: the ones between two zeros."""
        place = np.zeros(len(high), np.int64)
        some = high > 0
        place[some] = self._zero(high[some] - 1, zeros) + 1
        begin = place - high
        off = (place & 63).astype(np.uint64)
        rest = ~(self.high[place >> 6] >> off)
        ones = np.bitwise_count((rest & (~rest + _ONE)) - _ONE).astype(np.int64)
        far = np.flatnonzero(ones + (place & 63) >= 64)  # the ones go on in the next word
        ones[far] = self._zero(high[far], zeros) - place[far]
        return begin, begin + ones

    def get(self, i: np.ndarray) -> np.ndarray:
        """The values at positions from 0 to n - 1."""
        i = np.asarray(i, np.int64)
        if len(i) > CHUNK:
            return np.concatenate([self.get(i[a : a + CHUNK]) for a in range(0, len(i), CHUNK)])
        word = np.searchsorted(self.ones, i, "right") - 1
        place = word * 64 + _within(self.high[word], i - self.ones[word])
        return (((place - i).astype(np.uint64) << np.uint64(self.width)) | self._low(i)).astype(np.int64)

    def _search(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The position of the first value of at least ``x``, n if there is none; and whether it is ``x``."""
        x = np.asarray(x, np.int64)
        out, same = np.full(len(x), self.n, np.int64), np.zeros(len(x), bool)
        if not self.n:
            return out, same
        top, zeros = self.get(np.array([self.n - 1]))[0], self._zeros()
        for a in range(0, len(x), CHUNK):
            near = a + np.flatnonzero(x[a : a + CHUNK] <= top)
            out[near], same[near] = self._near(x[near].astype(np.uint64), zeros)
        return out, same

    def _near(self, want: np.ndarray, zeros: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What ``_search`` gives, of numbers up to the last value."""
        begin, stop = self._range((want >> np.uint64(self.width)).astype(np.int64), zeros)
        want &= np.uint64((1 << self.width) - 1)
        end = stop.copy()
        open_ = np.flatnonzero(begin < end)
        while len(open_):
            middle = (begin[open_] + end[open_]) // 2
            less = self._low(middle) < want[open_]
            begin[open_] = np.where(less, middle + 1, begin[open_])
            end[open_] = np.where(less, end[open_], middle)
            open_ = open_[begin[open_] < end[open_]]
        # With the same high bits, the low bits decide.
        same, within = np.zeros(len(want), bool), np.flatnonzero(begin < stop)
        same[within] = self._low(begin[within]) == want[within]
        return begin, same

    def successor(self, x: np.ndarray) -> np.ndarray:
        """The position of the first value of at least ``x``, n if there is none."""
        return self._search(x)[0]

    def find(self, x: np.ndarray) -> np.ndarray:
        """The first position of ``x``, -1 if there is none."""
        at, same = self._search(x)
        return np.where(same, at, -1)


class Level:
    """One level of a trie: contexts with back-off weights, pointers to their words, and the words' probabilities.

    Words are kept relative to their context: each context's words are shifted
    behind those of the contexts before, so one ascending sequence holds them
    all, and a word is found by one search for its successor.  Probabilities
    and weights are quantised numbers of one byte.
    """

    def __init__(self, buffer) -> None:
        found, at = [], 0
        for _ in range(4):
            ef, at = EliasFano.load(buffer, at)
            found.append(ef)
        self.contexts, self.pointers, self.shifts, self.words = found
        self.weights = np.frombuffer(buffer, np.uint8, self.contexts.n, at)
        self.levels = np.frombuffer(buffer, np.uint8, self.words.n, at + self.contexts.n)

    @staticmethod
    def build(context: np.ndarray, word: np.ndarray, levels: np.ndarray, weights: np.ndarray) -> bytes:
        """Of pairs in ascending order; ``weights`` holds each pair's quantised back-off weight of its context."""
        n = len(context)
        first = np.flatnonzero(np.append(True, context[1:] != context[:-1])) if n else np.empty(0, np.int64)
        last = np.append(first[1:], n)[: len(first)] - 1
        many = last - first + 1
        shifts = np.concatenate([[0], np.cumsum(word[last] + 1)])[: len(first)].astype(np.int64)
        pointers = np.concatenate([[0], np.cumsum(many)]).astype(np.int64)
        parts = (context[first], pointers, shifts, word + np.repeat(shifts, many))
        return b"".join([*(EliasFano.of(p).dump() for p in parts), weights[first].astype(np.uint8).tobytes(), levels.astype(np.uint8).tobytes()])

    def find(self, context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The position of each pair, and of its context; -1 where the level has none.  Pairs of a context stand together."""
        at = np.full(len(context), -1, np.int64)
        if not len(context):
            return at, at
        first = np.flatnonzero(np.append(True, context[1:] != context[:-1]))
        many = np.diff(first, append=len(context))
        own = self.contexts.find(context[first])
        place = np.repeat(own, many)
        known, held = np.flatnonzero(place >= 0), own >= 0
        if not len(known):
            return at, place
        spread = lambda x: np.repeat(x, many[held])
        i = self.words.find(word[known] + spread(self.shifts.get(own[held])))
        good = (i >= 0) & (i < spread(self.pointers.get(own[held] + 1)))
        at[known[good]] = i[good]
        return at, place
