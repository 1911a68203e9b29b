"""Words and byte n-grams of whole Arrow batches as numbers, without a Python loop over words."""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_BACK = pow(_BASE, -1, 1 << 64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    if len(_powers.get(base, ())) < n:
        p = np.full(max(n, 1 << 16), base, np.uint64)
        p[0] = 1
        _powers[base] = np.cumprod(p, dtype=np.uint64)
    return _powers[base][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads 64-bit numbers over all bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of ``inside`` that cross no text border."""
    n = len(inside)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.zeros(n + 1, bool)
    before[1:] = inside
    after = np.zeros(n + 1, bool)
    after[:n] = inside
    return np.flatnonzero(after & (~before | edge)), np.flatnonzero(before & (~after | edge))


def hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit polynomial hash of values[start:end] for each run, mixed with its length."""
    n = len(values)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * powers(_BASE, n), out=total[1:])
    h = (total[ends] - total[starts]) * powers(_BACK, n + 1)[starts]
    return mix(h + (ends - starts).astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))


def words(offsets: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the features of the lower-cased words (letters and digits; ASCII case only), and the word each text
    starts at.  Features: the whole word, its first four and five bytes, its last four; 0 where the word is shorter."""
    starts, ends = runs(_WORD[raw], offsets)
    low = _LOWER[raw]
    out = np.zeros((len(starts), 4), np.uint64)
    out[:, 0] = hashes(low, starts, ends)
    for k, (first, size) in enumerate(((True, 4), (True, 5), (False, 4)), 1):
        long = np.flatnonzero(ends - starts >= size)
        a = starts[long] if first else ends[long] - size
        out[long, k] = hashes(low, a, a + size) ^ np.uint64(k)
    return out, np.searchsorted(starts, offsets)
