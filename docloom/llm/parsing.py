"""Rolling-hash triggers and the phrases they create, for byte batches."""

from __future__ import annotations

import numpy as np

from .words import _BASE, hashes, mix

SPAN, GRAM = 50, 20
WIDTH = SPAN - GRAM + 1  # positions that a trigger is chosen from: one in every string of SPAN bytes
_AT = np.uint64((1 << 24) - 1)


def gram_hashes(raw: np.ndarray) -> np.ndarray:
    """A 64-bit rolling hash of raw[i : i + GRAM] for each i, built from hashes of halves."""
    h = raw.astype(np.uint64) + np.uint64(1)
    have, base = 1, _BASE
    whole, done = None, 0
    for bit in range(GRAM.bit_length()):
        if GRAM >> bit & 1:
            if whole is None:
                whole, done = h, have
            else:
                n = len(whole) - have
                whole, done = whole[:n] * np.uint64(pow(base, 1, 1 << 64)) + h[done : done + n], done + have
        if GRAM >> (bit + 1):
            h = h[:-have] * np.uint64(base) + h[have:]
            have, base = have * 2, base * base % (1 << 64)
    return mix(whole)


TILE = 1 << 18


def triggers(offsets: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, ...]:
    """(hash, place, first, last, text) of each trigger of a run of texts, in order.

    A trigger is a gram whose hash is the least among the WIDTH grams of some string of SPAN bytes (leftmost among equals);
    first and last are the starts of the strings that choose it, so equal strings choose equal triggers at equal places,
    whatever stands around them.  No string crosses a text border.  Works through tiles of TILE starts; a trigger on their
    border comes twice, each time with strings of its own."""
    found = []
    for a in range(0, max(0, len(raw) - SPAN + 1), TILE):
        part = raw[a : a + TILE + SPAN - 1]
        h = gram_hashes(part)
        key = (h & ~_AT) | np.arange(len(h), dtype=np.uint64)
        least, have = key, 1
        while have * 2 <= WIDTH:
            least, have = np.minimum(least[:-have], least[have:]), have * 2
        rest = WIDTH - have
        least = np.minimum(least[: len(least) - rest], least[rest:])
        lo, hi = np.searchsorted(offsets, [a, a + len(least) - 1], "right") - 1
        inside = np.repeat(np.arange(lo, hi + 1), np.diff(np.clip(offsets[lo : hi + 2], a, a + len(least))))
        start = np.flatnonzero(np.arange(a, a + len(least)) + SPAN <= offsets[inside + 1])
        if not len(start):
            continue
        place, text = (least[start] & _AT).astype(np.int64), inside[start]
        new = np.concatenate([[True], (place[1:] != place[:-1]) | (text[1:] != text[:-1])])
        first = np.flatnonzero(new)
        last = np.concatenate([first[1:], [len(start)]]) - 1
        found.append((h[place[first]], a + place[first], a + start[first], a + start[last], text[first]))
    if not found:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, none, none
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


class Parse:
    """The triggers of a run of texts and its dictionary of distinct phrases.

    A phrase is the bytes of all strings that choose one trigger.  Phrases are ordered by trigger, then by a 64-bit hash of
    their bytes; ``phrase`` names each trigger's.  ``least`` is the smallest text that holds the phrase."""

    def __init__(self, offsets: np.ndarray, raw: np.ndarray, rank: np.ndarray, wanted=None):
        """rank: the texts' order, equal for texts of equal id.  wanted: picks triggers by (sorted distinct hashes) -> mask."""
        self.hash, self.place, self.first, self.last, text = triggers(offsets, raw)
        self.rank = rank[text]
        order = np.lexsort((self.rank, self.hash))
        h, r = self.hash[order], self.rank[order]
        new = np.concatenate([[True], h[1:] != h[:-1]]) if len(h) else np.zeros(0, bool)
        begin = np.flatnonzero(new)
        end = np.concatenate([begin[1:], [len(h)]]) - 1 if len(begin) else begin
        self.distinct, self.several = h[begin], r[end] != r[begin]
        if wanted is None:
            return
        keep = np.zeros(len(h), bool)
        keep[order] = wanted(self.distinct)[np.cumsum(new) - 1] if len(h) else False
        self.hash, self.place, self.first, self.last, self.rank = (x[keep] for x in (self.hash, self.place, self.first, self.last, self.rank))
        content = np.empty(len(self.first), np.uint64)
        for i in range(0, len(content), 8192):  # over a part of the bytes at a time
            a, z = self.first[i : i + 8192], self.last[i : i + 8192] + SPAN
            content[i : i + 8192] = hashes(raw[a[0] : z.max()], a - a[0], z - a[0])
        order = np.lexsort((self.rank, content, self.hash))
        h, c = self.hash[order], content[order]
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (c[1:] != c[:-1])]) if len(h) else np.zeros(0, bool)
        self.phrase = np.empty(len(h), np.int64)
        self.phrase[order] = np.cumsum(new) - 1
        self.one = order[np.flatnonzero(new)]  # an occurrence of each phrase, in its smallest text
        self.least = self.rank[self.one]


def around(raw: np.ndarray, place: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes before the gram, bytes after it, both concatenated phrase by phrase)."""
    left, right = place - first, last + SPAN - place - GRAM
    size = left + right
    at = np.repeat(first - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
    at += GRAM * (np.arange(len(at)) - np.repeat(np.concatenate([[0], np.cumsum(size)[:-1]]), size) >= np.repeat(left, size))
    return left, right, raw[at]


def earlier(gram: np.ndarray, left: np.ndarray, right: np.ndarray, context: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """For each phrase a bit mask: bit j is set if its j-th string of SPAN bytes occurs in a phrase of a smaller rank.

    The strings are the suffixes of the dictionary's phrases cut at SPAN bytes.  They are sorted by gram, by the gram's
    place in them and by their other bytes, eight at a time: a suffix array of the dictionary, in which equal strings are
    neighbours.  The least rank of each run of equals is the first text of the corpus that holds the string."""
    out = np.zeros(len(gram), np.uint32)
    rest = SPAN - GRAM
    size = left + right
    at = np.concatenate([[0], np.cumsum(size)])
    by_gram = np.argsort(gram, kind="stable")
    alone = np.concatenate([[True], gram[by_gram][1:] != gram[by_gram][:-1], [True]])
    by_gram = by_gram[~(alone[:-1] & alone[1:])]  # a gram with one phrase has no equals
    ends = np.flatnonzero(np.concatenate([gram[by_gram][1:] != gram[by_gram][:-1], [True]])) + 1 if len(by_gram) else by_gram
    i = 0
    while i < len(by_gram):
        j = int(ends[min(np.searchsorted(ends, i + BATCH), len(ends) - 1)])
        pick = by_gram[i:j]
        i = j
        count = left[pick] + right[pick] - rest + 1
        phrase = np.repeat(pick, count)
        nth = np.arange(count.sum()) - np.repeat(np.concatenate([[0], np.cumsum(count)[:-1]]), count)
        padded = np.concatenate([context, np.zeros(32, np.uint8)])
        start = at[phrase] + nth  # the string's bytes but for the gram's are consecutive
        keys = []
        for k in range(0, rest, 8):
            word = np.zeros(len(start), np.uint64)
            for b in range(8):
                word = word << np.uint64(8) | (padded[start + k + b].astype(np.uint64) if k + b < rest else np.uint64(0))
            keys.append(word)
        before = left[phrase] - nth
        who = rank[phrase]
        order = np.lexsort((who, *keys, before, gram[phrase]))
        same = np.ones(len(order), bool)
        same[:1] = False
        for x in (gram[phrase], before, *keys):
            x = x[order]
            same[1:] &= x[1:] == x[:-1]
        begin = np.flatnonzero(~same)
        first = np.repeat(who[order][begin], np.diff(np.concatenate([begin, [len(order)]])))
        hit = np.empty(len(order), bool)
        hit[order] = first < who[order]
        np.bitwise_or.at(out, phrase[hit], np.uint32(1) << nth[hit].astype(np.uint32))
    return out


#: Phrases whose strings are sorted at a time, but for those of one gram.
BATCH = 8_000
