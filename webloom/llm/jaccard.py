"""Exact Jaccard similarity of word shingles: sets, their MinHash bands, and the links among sets.

What ``simhash.near_copies`` needs to verify its candidates, and to find pairs that lie outside the reach of its
fingerprints. Sets share a band of MinHash values: at a similarity of 0.8 a pair shares none of the 32 bands of 6 values
with a probability of (1 - 0.8**6) ** 32, 0.00006.
"""

from __future__ import annotations

import numpy as np
import xxhash

BANDS, WIDTH = 32, 6
#: Least similarity, as a fraction, so that the comparison is one of whole numbers.
LEAST = (4, 5)
_random = np.random.default_rng(42)
FLIP, ODD = (_random.integers(0, 1 << 64, BANDS * WIDTH, np.uint64) for _ in range(2))
ODD |= np.uint64(1)


def hashes(text: bytes, words: int) -> np.ndarray:
    """64-bit hashes of the shingles of ``words`` words, A-Z lower-cased, repeats included; a shorter text is one shingle, one without a word has none."""
    w = text.lower().split()  # on bytes both know only ASCII
    if not w:
        return np.zeros(0, np.uint64)
    parts = map(b" ".join, zip(*(w[i:] for i in range(words)))) if len(w) > words else [b" ".join(w)]
    return np.array([xxhash.xxh64_intdigest(s, 42) for s in parts], np.uint64)


def shingles(text: bytes, words: int) -> np.ndarray:
    """The sorted distinct ``hashes``."""
    return np.unique(hashes(text, words))


def signature(found: np.ndarray) -> tuple[int, int]:
    """The set as a whole, as two numbers of 64 bits: equal sets are one node."""
    return divmod(xxhash.xxh128_intdigest(found.tobytes(), 42), 1 << 64)


def bands(found: np.ndarray) -> np.ndarray:
    """A code for each band of MinHash values; none for the empty set."""
    if not len(found):
        return np.zeros(0, np.uint64)
    least = np.full(BANDS * WIDTH, np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(found), 512):
        np.minimum(least, ((found[a : a + 512, None] ^ FLIP) * ODD).min(0), out=least)
    raw, step = least.tobytes(), 8 * WIDTH
    return np.array([xxhash.xxh64_intdigest(raw[step * b : step * b + step], b) for b in range(BANDS)], np.uint64)


def link(sets: list[np.ndarray]) -> np.ndarray:
    """For each set the first one of its component, where sets at LEAST or more are linked."""
    sizes = np.array([len(s) for s in sets])
    number = np.unique(np.concatenate(sets), return_inverse=True)[1]
    ends = np.cumsum(sizes)
    label = np.full(len(sets), -1)
    order = np.argsort(number, kind="stable")
    holder, shingle = np.repeat(np.arange(len(sets)), sizes)[order], number[order]
    indexed = len(sets)
    for first in range(len(sets)):
        if label[first] >= 0:
            continue
        label[first], ahead = first, [first]
        while ahead:
            open_ = int((label < 0).sum())
            if not open_:
                return label
            if 2 * open_ < indexed:  # the index holds only sets without a label, about
                left = label[holder] < 0
                holder, shingle, indexed = holder[left], shingle[left], open_
            i = ahead.pop()
            own = number[ends[i] - sizes[i] : ends[i]]
            start, n = np.searchsorted(shingle, own), np.searchsorted(shingle, own, "right")
            n -= start
            at = np.repeat(start - np.cumsum(n) + n, n) + np.arange(n.sum())
            both = np.bincount(holder[at], minlength=len(sets))
            near = np.flatnonzero((label < 0) & (LEAST[1] * both >= LEAST[0] * (sizes + sizes[i] - both)))
            label[near] = first
            ahead += near.tolist()
    return label
