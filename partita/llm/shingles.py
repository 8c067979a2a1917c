"""Hashes of a text's words and word shingles, computed over bytes in numpy."""

from __future__ import annotations

import numpy as np

SIZE = 5
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64."""
    known = _powers.get(base)
    if known is None or len(known) < n:
        full = np.full(max(n, 4096), np.uint64(base))
        full[0] = 1
        known = np.multiply.accumulate(full)
        if len(known) <= 1 << 20:
            _powers[base] = known
    return known[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit numbers."""
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def word_hashes(text: str) -> np.ndarray:
    """A hash of each word of the lower-cased text, in order; words are runs without ASCII white space."""
    raw = np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), np.uint8)
    if not len(raw):
        return np.zeros(0, np.uint64)
    blank = (raw == 32) | (raw - np.uint8(9) < 5)
    edges = np.flatnonzero(np.diff(np.concatenate([[True], blank, [True]]).view(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _power(_BASE, len(raw)))])
    return mix((sums[ends] - sums[starts]) * _power(_INVERSE, len(raw))[starts] + (ends - starts).astype(np.uint64))


def shingle_hashes(text: str, size: int = SIZE) -> np.ndarray:
    """A hash of each run of ``size`` words; a text with fewer words has one shingle of all of them, if any."""
    words = word_hashes(text)
    n = len(words)
    if n == 0:
        return words
    k = min(size, n)
    out = np.full(n - k + 1, np.uint64(k))
    for i in range(k):
        out = out * np.uint64(0x9FB21C651E98DF25) + words[i : n - k + 1 + i]
    return mix(out)


def labelled(hashes: np.ndarray) -> np.ndarray:
    """Each hash joined with the number of equal ones before it, so that all of a text's shingles differ."""
    order = np.argsort(hashes, kind="stable")
    fresh = np.concatenate([[True], np.diff(hashes[order]) != 0]) if len(hashes) else np.zeros(0, bool)
    place = np.arange(len(hashes))
    count = np.empty(len(hashes), np.uint64)
    count[order] = place - np.maximum.accumulate(np.where(fresh, place, 0)) if len(hashes) else 0
    return mix(hashes + count * np.uint64(_BASE))
