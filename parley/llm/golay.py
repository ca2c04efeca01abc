"""The binary Golay code of length 23: every word lies within three bits of one of 4096 codewords."""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np

GENERATOR = 0b110001110101  # x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1
LENGTH, DATA = 23, 12


def _remainder(word: int) -> int:
    for bit in range(LENGTH - 1, LENGTH - DATA - 1, -1):
        if word >> bit & 1:
            word ^= GENERATOR << (bit - 11)
    return word


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Remainders of the bytes of a word; for each remainder the error patterns to the nearby codewords (-1: none)."""
    byte = np.array([[_remainder(v << 8 * k & 0x7FFFFF) for v in range(256)] for k in range(3)], dtype=np.int32)
    near = np.full((2048, 6), -1, dtype=np.int32)
    used = [0] * 2048
    for weight in range(5):
        for bits in combinations(range(LENGTH), weight):
            pattern = sum(1 << b for b in bits)
            s = _remainder(pattern)
            if weight == 4 and used[s] == 0:
                raise AssertionError("the code is perfect")
            near[s, used[s]] = pattern
            used[s] += 1
    return byte, near


def nearby(words: np.ndarray) -> np.ndarray:
    """[word, 6]: indices of the codewords within four bits, -1 where there are fewer.

    A word at three bits from its codeword has six of them, any other one. Words that differ in at most two bits share
    an index (a test runs over all cases).
    """
    byte, near = _tables()
    w = words.astype(np.int32)
    s = byte[0][w & 255] ^ byte[1][w >> 8 & 255] ^ byte[2][w >> 16]
    errors = near[s]
    return np.where(errors < 0, -1, (w[:, None] ^ errors) >> (LENGTH - DATA))


@cache
def codewords() -> np.ndarray:
    """[23, 4096] of +1 and -1: column m is the codeword with index m, row b its bit b."""
    m = np.arange(4096, dtype=np.int64) << (LENGTH - DATA)
    words = m | np.array([_remainder(int(x)) for x in m])
    return np.where(words[None, :] >> np.arange(LENGTH)[:, None] & 1, 1.0, -1.0).astype(np.float32)


def best_codewords(soft: np.ndarray, k: int = 2) -> np.ndarray:
    """[row, k]: indices of the codewords that agree best with signed bit strengths [row, 23], in rising order."""
    agree = soft.astype(np.float32) @ codewords()
    return np.sort(np.argpartition(-agree, k - 1, axis=1)[:, :k], axis=1)
