"""The perfect binary Golay code [23, 12, 7], vectorised: nearest codewords and fuzzy keys, hard and soft."""

from __future__ import annotations

from itertools import combinations

import numpy as np

#: Fixed value: the generator polynomial x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GENERATOR = 0b101011100011
LENGTH, CHECKS = 23, 11


def _remainder(word: int) -> int:
    for bit in range(LENGTH - 1, CHECKS - 1, -1):
        if word >> bit & 1:
            word ^= GENERATOR << (bit - CHECKS)
    return word


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    single = [_remainder(1 << b) for b in range(LENGTH)]

    def syndromes(first: int, width: int) -> np.ndarray:
        out = np.zeros(1 << width, np.int64)
        for b in range(width):
            out[1 << b : 2 << b] = out[: 1 << b] ^ single[first + b]
        return out

    # The code is perfect: every syndrome belongs to exactly one error pattern of weight 0 to 3.
    errors = np.zeros(1 << CHECKS, np.int64)
    for weight in (1, 2, 3):
        for bits in combinations(range(LENGTH), weight):
            s = 0
            for b in bits:
                s ^= single[b]
            errors[s] = sum(1 << b for b in bits)
    return syndromes(0, 12), syndromes(12, 11), errors


LOW, HIGH, ERRORS = _tables()


def index(words: np.ndarray) -> np.ndarray:
    """The 12-bit number of the one codeword within distance 3 of each 23-bit word."""
    s = LOW[words & 0xFFF] ^ HIGH[words >> 12]
    return (words ^ ERRORS[s]) >> CHECKS


def fuzzy_keys(words: np.ndarray, width: int) -> np.ndarray:
    """For each word of ``width`` bits the indices of the codewords nearest to it and to every word one bit away.

    Two words at distance 2 or less have a word within one bit of both, so they share an index. The code's
    geometry leaves 1 or 6 different indices of the ``width + 1``; repeats are -1. Shape (n, width + 1).
    """
    flips = np.concatenate([[0], 1 << np.arange(width)])
    keys = np.sort(index(words[:, None] ^ flips), axis=1)
    keys[:, 1:][keys[:, 1:] == keys[:, :-1]] = -1
    return keys


def _signs() -> np.ndarray:
    """The 4,096 codewords as rows of -1 and 1, the lowest bit first."""
    words = np.arange(1 << 12, dtype=np.int64) << CHECKS
    codes = words | np.array([_remainder(int(w)) for w in words])
    return ((codes[:, None] >> np.arange(LENGTH) & 1) * 2 - 1).astype(np.float32)


SIGNS = _signs()
_PLACES = 1 << np.arange(LENGTH)


def soft_keys(sums: np.ndarray, flips: int, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """For rows of LENGTH signed sums the indices of ``keep`` near codewords, nearest first, and their agreement.

    A bit is the sign of its sum, and the sum's size is how sure it is. The words that differ in any of the
    ``flips`` least sure bits are decoded (Chase's way); their codewords are ranked by the sum of what agrees less
    what does not. Where fewer than ``keep`` different ones are found, the rest has an agreement of -inf.
    """
    size = np.abs(sums)
    word = (sums > 0) @ _PLACES
    unsure = np.argpartition(size, flips, axis=1)[:, :flips] if flips < LENGTH else np.argsort(size, axis=1)
    masks = np.zeros((len(sums), 1), np.int64)
    for i in range(flips):
        masks = np.concatenate([masks, masks ^ (1 << unsure[:, i, None])], axis=1)
    codes = index(word[:, None] ^ masks)
    worth = np.einsum("nd,nkd->nk", sums, SIGNS[codes])
    rows = np.arange(len(sums))
    found, agreed = np.zeros((len(sums), keep), np.int64), np.full((len(sums), keep), -np.inf, np.float32)
    for i in range(keep):
        at = worth.argmax(axis=1)
        found[:, i], agreed[:, i] = codes[rows, at], worth[rows, at]
        worth[codes == found[:, i, None]] = -np.inf
    return found, agreed
