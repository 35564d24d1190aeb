"""The binary Golay code [23, 12, 7] as a fuzzy hash of 23-bit words.

The code is perfect: every word lies within distance 3 of exactly one codeword.
A word's keys are the indices of all codewords within distance 4: one when the
nearest is at most 2 away, else that one and the five at distance 4. Two words
that differ in at most 2 bits share a key: the word midway between them is
within 3 of some codeword, which is then within 4 of both.
"""

from __future__ import annotations

import functools
from itertools import combinations

import numpy as np

GENERATOR = 0b101011100011  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1


def _remainder(words: np.ndarray) -> np.ndarray:
    r = words.astype(np.int64).copy()
    for shift in range(11, -1, -1):
        r = np.where((r >> (shift + 11)) & 1, r ^ (GENERATOR << shift), r)
    return r


@functools.lru_cache(maxsize=1)
def _patterns() -> tuple[np.ndarray, np.ndarray]:
    """Per syndrome (2048): up to six error patterns of weight <= 4 that lead to
    a codeword, and how many there are."""
    found: list[list[int]] = [[] for _ in range(1 << 11)]
    for weight in range(5):
        words = np.array([sum(1 << i for i in c) for c in combinations(range(23), weight)], dtype=np.int64)
        for s, w in zip(_remainder(words).tolist(), words.tolist()):
            found[s].append(w)
    count = np.array([len(x) for x in found])
    return np.array([x + [0] * (6 - len(x)) for x in found], dtype=np.int64), count


@functools.lru_cache(maxsize=1)
def _halves() -> tuple[np.ndarray, np.ndarray]:
    """Syndromes of the low 12 bits and of the high 11 bits of a word; the code
    is linear, so a word's syndrome is the sum of both."""
    return _remainder(np.arange(1 << 12)), _remainder(np.arange(1 << 11) << 12)


def syndromes(words: np.ndarray) -> np.ndarray:
    low, high = _halves()
    return low[words & 0xFFF] ^ high[words >> 12]


def keys(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position of the word, 12-bit codeword index) for every key of every word."""
    errors, count = _patterns()
    s = syndromes(words)
    n = count[s]
    at = np.repeat(np.arange(len(words)), n)
    nth = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
    return at, (words[at] ^ errors[s[at], nth]) >> 11  # the code is systematic in its high 12 bits
