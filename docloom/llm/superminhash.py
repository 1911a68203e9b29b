"""Shingle sets of whole texts and their SuperMinHash signatures, for Arrow batches."""

from __future__ import annotations

import numpy as np

from .words import _LOWER, hashes, mix, runs

_INSIDE = np.ones(256, bool)
_INSIDE[[32, *range(9, 14)]] = False
_FACTORS = [np.uint64(x) for x in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3)]


def shingles(offsets: np.ndarray, raw: np.ndarray, size: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of each text's distinct shingles of ``size`` words, sorted, and where each text's begin.

    Words are runs of anything but space and \\t-\\r, with A-Z in lower case; a text of fewer words has its whole
    sequence as one shingle, a text without words none."""
    starts, ends = runs(_INSIDE[raw], offsets)
    h = hashes(_LOWER[raw], starts, ends)
    at = np.searchsorted(starts, offsets)
    count = np.diff(at)
    text = np.repeat(np.arange(len(count)), count)
    short = count < size
    n = np.where(short, np.minimum(count, 1), count - size + 1)
    # a shingle begins at a word that has size - 1 more after it, or at the first word of a short text
    first = np.flatnonzero(np.arange(len(h)) - at[text] < n[text])
    left = np.minimum(at[text[first] + 1] - first, size) if len(first) else first
    s = np.zeros(len(first), np.uint64)
    for j in range(size):
        more = np.flatnonzero(left > j)
        s[more] = mix(s[more] + h[first[more] + j] * _FACTORS[j % 3])
    s = mix(s ^ left.astype(np.uint64))
    owner = text[first]
    order = np.lexsort((s, owner))
    s, owner = s[order], owner[order]
    keep = np.ones(len(s), bool)
    keep[1:] = (s[1:] != s[:-1]) | (owner[1:] != owner[:-1])
    s, owner = s[keep], owner[keep]
    return s, np.searchsorted(owner, np.arange(len(count) + 1))


def signatures(elements: np.ndarray, at: np.ndarray, slots: int = 64) -> np.ndarray:
    """SuperMinHash: (texts, slots) of level * 2**32 + rank, the least over a text's elements.

    Element e visits the slots in the order of a random permutation, drawn step by step (Fisher-Yates), and offers
    level + fraction at its level-th slot.  A text whose slots are all filled at or below a level is finished, as later
    levels only offer more; its elements stop there."""
    n = len(at) - 1
    sig = np.full(n * slots, np.uint64(slots) << np.uint64(32), np.uint64)
    owner = np.repeat(np.arange(n), np.diff(at))
    e, perm = elements, None
    for level in range(slots):
        if not len(e):
            break
        x = mix(e + np.uint64((level + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
        pick = level + (x >> np.uint64(32)).astype(np.int64) % (slots - level)
        offer = np.uint64(level) << np.uint64(32) | x & np.uint64(0xFFFFFFFF)
        if perm is None:
            slot = pick
        else:
            row = np.arange(len(e))
            slot = perm[row, pick].astype(np.int64)
            perm[row, pick] = perm[:, level]
        np.minimum.at(sig, owner * slots + slot, offer)
        open_ = (sig.reshape(n, slots).max(1) >= np.uint64(level + 1) << np.uint64(32))[owner]
        if perm is None:
            e, owner, pick = e[open_], owner[open_], pick[open_]
            perm = np.broadcast_to(np.arange(slots, dtype=np.uint8), (len(e), slots)).copy()
            perm[np.arange(len(e)), pick] = 0
        else:
            e, owner, perm = e[open_], owner[open_], perm[open_]
    return sig.reshape(n, slots)


def bands(sig: np.ndarray, rows: int) -> np.ndarray:
    """(texts, bands) 64-bit keys of ``rows`` consecutive slots each."""
    n, slots = sig.shape
    out = np.zeros((n, slots // rows), np.uint64)
    for j in range(rows):
        out = mix(out * _FACTORS[0] + sig[:, j::rows][:, : slots // rows])
    return out


def set_hashes(elements: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums over each set: equal for equal sets, and else different but for a chance of 2**-128."""
    sums = []
    for salt in (0x243F6A8885A308D3, 0x13198A2E03707344):
        total = np.zeros(len(elements) + 1, np.uint64)
        np.cumsum(mix(elements ^ np.uint64(salt)), out=total[1:])
        sums.append(total[at[1:]] - total[at[:-1]])
    return sums[0], sums[1]
