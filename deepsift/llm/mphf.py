"""A minimal perfect hash over 128-bit keys in numpy: levels of collision-free bits, ranked by popcount."""

from __future__ import annotations

import numpy as np

#: Bits a level has for each key that is left.
SPARE = 2.0
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_MASK = (1 << 64) - 1


def _place(h1: np.ndarray, h2: np.ndarray, level: int, bits: int) -> np.ndarray:
    x = (h1 ^ np.uint64((level + 1) * int(_A) & _MASK)) * _B + h2
    x ^= x >> np.uint64(29)
    x = x * _A + (h2 ^ np.uint64(level))
    x ^= x >> np.uint64(32)
    x *= _B
    return ((x >> np.uint64(11)) % np.uint64(bits)).astype(np.int64)


class PerfectHash:
    """slot() gives each key of the build a number of its own in 0..n-1; other keys get any number or -1."""

    def __init__(self, sizes: list[int], packed: bytes):
        self.sizes, self.packed = sizes, packed
        self.bits = np.unpackbits(np.frombuffer(packed, np.uint8), count=sum(sizes))
        self.rank = np.cumsum(self.bits, dtype=np.int64) - 1
        self.starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)

    @classmethod
    def build(cls, h1: np.ndarray, h2: np.ndarray) -> PerfectHash:
        """Of distinct pairs (h1, h2) of unsigned 64-bit numbers."""
        sizes, levels = [], []
        while len(h1):
            bits = max(8, int(SPARE * len(h1)))
            at = _place(h1, h2, len(sizes), bits)
            alone = np.bincount(at, minlength=bits) == 1
            sizes.append(bits)
            levels.append(alone)
            rest = ~alone[at]
            h1, h2 = h1[rest], h2[rest]
        return cls(sizes, np.packbits(np.concatenate(levels)).tobytes() if levels else b"")

    def slot(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        out = np.full(len(h1), -1, np.int64)
        left = np.arange(len(h1))
        for level, bits in enumerate(self.sizes):
            if not len(left):
                break
            at = self.starts[level] + _place(h1[left], h2[left], level, bits)
            hit = self.bits[at] == 1
            out[left[hit]] = self.rank[at[hit]]
            left = left[~hit]
        return out
