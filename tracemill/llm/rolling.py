"""Hashes of the words of many texts at once, and of their substrings, from prefix sums of a polynomial modulo 2**64."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import xxhash

#: Odd base, and the seed of the values that stand for bytes.
BASE, SEED = 0x9E3779B97F4A7C15, 11


@lru_cache(maxsize=1)
def _bytes() -> np.ndarray:
    return np.random.Generator(np.random.PCG64(SEED)).integers(1, 2**64, 256, np.uint64)


_grown: dict[bool, np.ndarray] = {}


def _powers(n: int, inverse: bool) -> np.ndarray:
    """BASE**0 .. BASE**(n - 1), or of its inverse."""
    have = _grown.get(inverse)
    if have is None or len(have) < n:
        have = np.ones(max(n, 1), np.uint64)
        have[1:] = np.uint64(pow(BASE, -1, 2**64) if inverse else BASE)
        have = _grown[inverse] = np.cumprod(have, dtype=np.uint64)
    return have[:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit numbers that spreads all bits."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


class Rolling:
    """Hashes of raw[i:i + size], to choose places by: equal bytes have equal hashes, but a polynomial modulo a power of
    two is no proof of equality."""

    def __init__(self, raw: np.ndarray):
        n = len(raw)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_bytes()[raw] * _powers(n, True), out=self.sums[1:])

    def grams(self, size: int) -> np.ndarray:
        n = len(self.sums) - size
        if n <= 0:
            return np.zeros(0, np.uint64)
        return mixed((self.sums[size:] - self.sums[:n]) * _powers(n, False) + np.uint64(size))


SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word (a run of bytes that aren't white space), and the number of words before each text
    (with the end). Words never span texts."""
    inside = ~SPACE[raw]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < len(raw))]
    first[cut] |= inside[cut]
    last[cut - 1] |= inside[cut - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(start, offsets)


#: Bytes of a word that are packed into two numbers, masks of their first 0 .. 16 bytes, words hashed at once.
PACKED = 16
MASKS = np.tril(np.full((PACKED + 1, PACKED + 1), 255, np.uint8), -1)[:, :PACKED].copy()
AT_ONCE = 1 << 18


def word_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of raw[start:end]: those of up to 16 bytes mix all their bytes and the length, xxh3 hashes longer ones."""
    out = np.zeros(len(start), np.uint64)
    view = np.lib.stride_tricks.sliding_window_view(np.concatenate((raw, np.zeros(PACKED, np.uint8))), PACKED)
    for i in range(0, len(start), AT_ONCE):
        a, size = start[i : i + AT_ONCE], end[i : i + AT_ONCE] - start[i : i + AT_ONCE]
        two = (view[a] & MASKS[np.minimum(size, PACKED)]).view(np.uint64)
        out[i : i + AT_ONCE] = mixed(two[:, 0] ^ mixed(two[:, 1] + size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    data = memoryview(np.ascontiguousarray(raw))
    for i in np.flatnonzero(end - start > PACKED).tolist():
        out[i] = xxhash.xxh3_64_intdigest(data[start[i] : end[i]], SEED)
    return out
