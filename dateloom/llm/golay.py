"""The perfect binary Golay code (23, 12, 7), vectorised: every 23-bit word lies within 3 flips of one codeword."""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np

#: Fixed value: generator polynomial x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101
LENGTH, CHECKS = 23, 11


def remainder(word: int) -> int:
    for bit in range(LENGTH - 1, CHECKS - 1, -1):
        if word >> bit & 1:
            word ^= GENERATOR << (bit - CHECKS)
    return word


@cache
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the low 12 and the high 11 bits, and the error pattern of each syndrome."""
    low = np.array([remainder(x) for x in range(1 << 12)], np.int32)
    high = np.array([remainder(x << 12) for x in range(1 << 11)], np.int32)
    error = np.zeros(1 << CHECKS, np.int32)
    for n in range(4):
        for bits in combinations(range(LENGTH), n):
            pattern = sum(1 << b for b in bits)
            error[remainder(pattern)] = pattern
    return low, high, error


def nearest(words: np.ndarray) -> np.ndarray:
    """Index (0 to 4095) of the codeword nearest to each 23-bit word: the top 12 bits of that codeword."""
    low, high, error = tables()
    return (words ^ error[low[words & 0xFFF] ^ high[words >> 12]]) >> CHECKS


def nearby(words: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the codewords nearest to each word or to a word one flip (of its ``width`` low bits) away.

    Two words at most 2 flips apart share one, by the word between them; two
    words at most 1 flip apart have the nearest codeword of either among those
    of the other. Returns the indices, one column a flip, and which are new.
    """
    flips = np.concatenate([[0], 1 << np.arange(width)]).astype(np.int32)
    found = np.sort(nearest(words[:, None] ^ flips), axis=1)
    new = np.ones(found.shape, bool)
    new[:, 1:] = found[:, 1:] != found[:, :-1]
    return found, new
