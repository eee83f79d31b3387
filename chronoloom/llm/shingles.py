"""Word shingles of texts as 64-bit hashes, and their fast similarity sketches. numpy only."""

from __future__ import annotations

import numpy as np

WORDS = 5
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_STEP = np.random.Generator(np.random.PCG64(2718281828)).integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POSITIONS = [np.random.Generator(np.random.PCG64(31415926)).integers(0, 1 << 63, 1 << 12, dtype=np.uint64) * np.uint64(2) + np.uint64(1)]


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _positions(n: int) -> np.ndarray:
    """Multipliers by position; for longer words the table is made anew, twice as long, with the same beginning."""
    while len(_POSITIONS[0]) < n:
        k = len(_POSITIONS[0])
        more = np.random.Generator(np.random.PCG64([31415926, k])).integers(0, 1 << 63, k, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        _POSITIONS[0] = np.concatenate((_POSITIONS[0], more))
    return _POSITIONS[0]


def word_hashes(text: bytes) -> np.ndarray:
    """A hash for each word, A-Z lower-cased."""
    data = np.frombuffer(text, np.uint8)
    if not len(data):
        return np.zeros(0, np.uint64)
    inside = ~_SPACE[data]
    edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=0, append=0))
    begin, end = edge[::2], edge[1::2]
    if not len(begin):
        return np.zeros(0, np.uint64)
    length = end - begin
    keep = data[inside]
    first = np.cumsum(length) - length
    place = np.arange(len(keep)) - np.repeat(first, length)
    part = (_LOWER[keep].astype(np.uint64) + np.uint64(1)) * _positions(int(length.max()))[place]
    return mixed(np.add.reduceat(part, first) + length.astype(np.uint64))


def shingle_set(text: bytes, words: int = WORDS) -> np.ndarray:
    """Sorted distinct shingles; a text of fewer words has its whole sequence as its only one; none without words."""
    h = word_hashes(text)
    n = len(h)
    if not n:
        return h
    k = min(n, words)
    s = np.zeros(n - k + 1, np.uint64)
    for j in range(k):
        s += h[j : n - k + 1 + j] * _STEP[j]
    return np.unique(mixed(s + np.uint64(k)))


def fingerprint(s: np.ndarray) -> tuple[int, int]:
    """128 bits that depend on the set alone."""
    a = int(np.add.reduce(mixed(s ^ np.uint64(0x5851F42D4C957F2D))))
    b = int(np.add.reduce(mixed(s ^ np.uint64(0x14057B7EF767814F))))
    return a - (1 << 64) * (a >> 63), b - (1 << 64) * (b >> 63)


class Sketcher:
    """Fast similarity sketching with t coordinates.

    In round i < t every element falls into a hashed bin with a hashed value, and a bin keeps the smallest (round,
    value); rounds t to 2t - 1 place all elements into bin i - t. So every coordinate fills, and once all have, no later
    round can change one. Small sets take many rounds, large sets one.
    """

    def __init__(self, t: int, seed: int = 20170607):
        self.t = t
        self.seeds = np.random.Generator(np.random.PCG64(seed)).integers(0, 1 << 63, 2 * t, dtype=np.uint64)

    def sketch(self, s: np.ndarray) -> np.ndarray:
        t, n = self.t, len(s)
        out = np.full(t, np.iinfo(np.uint64).max, np.uint64)
        i = 0
        while i < t:
            c = min(t - i, max(1, 3 * t // n))
            h = mixed((s[None, :] ^ self.seeds[i : i + c, None]).ravel())
            bins = ((h >> np.uint64(32)) * np.uint64(t) >> np.uint64(32)).astype(np.int64)
            value = (h & np.uint64(0xFFFFFFFF)) | (np.repeat(np.arange(i, i + c, dtype=np.uint64), n) << np.uint64(32))
            np.minimum.at(out, bins, value)
            i += c
            if out.max() < np.iinfo(np.uint64).max:
                return out
        for b in np.flatnonzero(out == np.iinfo(np.uint64).max):
            h = mixed(s ^ self.seeds[t + b])
            out[b] = np.min(h & np.uint64(0xFFFFFFFF)) | np.uint64(t + int(b)) << np.uint64(32)
        return out

    def bands(self, s: np.ndarray, rows: int) -> np.ndarray:
        """A signed 64-bit key for each band of `rows` coordinates."""
        sk = self.sketch(s).reshape(-1, rows)
        key = (mixed(sk) * _STEP[:rows]).sum(axis=1, dtype=np.uint64)
        return mixed(key + np.arange(len(sk), dtype=np.uint64) * _STEP[40]).view(np.int64)


def links(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, on the full sets."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both) and both > 0
