"""Index keys from the binary Golay code (23, 12, 7): words within two bits of each other share a key.

The code is perfect: every 23-bit word lies within three bits of exactly one codeword. A word's keys are the codewords
of the word and of its neighbours at one bit: one key if its own codeword is two bits away or nearer, six otherwise.
If x and y differ in two bits, a word between them is a neighbour of both, and its codeword is a key of both.
"""

from __future__ import annotations

from functools import cache

import numpy as np

BITS, DATA, GENERATOR = 23, 12, 0b101011100011  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1


@cache
def _corrections() -> np.ndarray:
    """By syndrome (11 bits): the error of at most three bits that causes it."""
    table = np.zeros(1 << (BITS - DATA), np.uint32)
    one = [1 << i for i in range(BITS)]
    errors = [0, *one, *(a | b for i, a in enumerate(one) for b in one[:i]), *(a | b | c for i, a in enumerate(one) for j, b in enumerate(one[:i]) for c in one[:j])]
    errors = np.array(errors, np.uint32)
    table[syndrome(errors)] = errors
    return table


@cache
def _remainders() -> tuple[np.ndarray, np.ndarray]:
    """Of the low 12 and of the high 11 bits of a word: remainders as polynomials, modulo the generator."""
    single = []
    for bit in range(BITS):
        left = 1 << bit
        for high in range(BITS - 1, BITS - DATA - 1, -1):
            if left >> high & 1:
                left ^= GENERATOR << (high - (BITS - DATA))
        single.append(left)
    tables = []
    for low, width in ((0, 12), (12, 11)):
        table = np.zeros(1 << width, np.uint32)
        for bit in range(width):
            table[1 << bit : 2 << bit] = table[: 1 << bit] ^ np.uint32(single[low + bit])
        tables.append(table)
    return tables[0], tables[1]


def syndrome(words: np.ndarray) -> np.ndarray:
    """The remainder is linear over the bits, so two lookups give it."""
    low, high = _remainders()
    return low[words & 0xFFF] ^ high[words >> 12]


def decode(words: np.ndarray) -> np.ndarray:
    """The 12-bit index of each word's codeword."""
    words = words.astype(np.uint32)
    return (words ^ _corrections()[syndrome(words)]) >> (BITS - DATA)


def keys(words: np.ndarray) -> np.ndarray:
    """(n, 24) keys of words of at most 23 bits, repeated where neighbours decode alike: one or six of them differ."""
    words = words.astype(np.uint32)[:, None]
    flips = np.array([0, *(1 << i for i in range(BITS))], np.uint32)
    return decode(words ^ flips)
