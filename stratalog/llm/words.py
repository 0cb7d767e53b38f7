"""Vectorised word splitting and 64-bit hashing of whole Arrow batches (no per-word Python objects)."""

from __future__ import annotations

import numpy as np

_U = np.uint64
#: Odd multipliers of the polynomial hashes (any odd numbers would do).
_BYTE_MUL, _WORD_MUL = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_MASK = (1 << 64) - 1

#: Word bytes of the class that excludes the space and U+0009-U+000D only.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False
#: A-Z to a-z, every other byte as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers: dict[str, np.ndarray] = {}


def _table(name: str, base: int, n: int) -> np.ndarray:
    """base ** (0 .. n-1) modulo 2^64, grown by doubling and kept per worker."""
    have = _powers.get(name)
    if have is None:
        have = np.ones(1, _U)
    while len(have) < n:
        have = np.concatenate([have, have * _U(pow(base, len(have), 1 << 64))])
    _powers[name] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser: spreads every input bit over the word."""
    h = (h ^ (h >> _U(32))) * _U(0xD6E8FEB86659FD93)
    h = (h ^ (h >> _U(29))) * _U(0xBF58476D1CE4E5B9)
    return h ^ (h >> _U(32))


class Words:
    """Words of the documents of one chunk: first[d] .. first[d+1] are those of document d."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray = NOT_SPACE, lower: bool = False):
        offsets = offsets - offsets[0]
        n_docs = len(offsets) - 1
        inside = is_word[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        before = np.empty(len(data), bool)
        after = np.empty(len(data), bool)
        if len(data):
            before[0], before[1:] = False, inside[:-1]
            after[-1], after[:-1] = False, inside[1:]
        before &= ~edge[:-1]
        after &= ~edge[1:]
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        self.doc = np.searchsorted(offsets, self.start, side="right") - 1
        self.count = np.bincount(self.doc, minlength=n_docs).astype(np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.count)])
        self._data, self._lower = data, lower

    def hashes(self) -> np.ndarray:
        data = LOWER[self._data] if self._lower else self._data
        n = len(data)
        if not len(self.start):
            return np.zeros(0, _U)
        total = np.concatenate([np.zeros(1, _U), np.cumsum((data.astype(_U) + _U(1)) * _table("byte", _BYTE_MUL, n))])
        inverse = _table("back", pow(_BYTE_MUL, -1, 1 << 64), n)
        return mix((total[self.end] - total[self.start]) * inverse[self.start])


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive words, by start; positions whose gram would leave the array are dropped."""
    if len(h) < k:
        return np.zeros(0, _U)
    n, out = len(h) - k + 1, np.zeros(len(h) - k + 1, _U)
    for j in range(k):
        out += h[j : j + n] * _U(pow(_WORD_MUL, j + 1, 1 << 64))
    return mix(out)


def window_min(a: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values, by doubling."""
    have, width = a, 1
    while width * 2 <= w:
        have, width = np.minimum(have[: len(have) - width], have[width:]), width * 2
    if width < w:
        gap = w - width
        have = np.minimum(have[: len(have) - gap], have[gap:])
    return have
