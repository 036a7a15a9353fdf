"""Tails of sums of unequal trials (Poisson-binomial), exact, over folded trials: each distinct chance comes with its number."""

from __future__ import annotations

import math

import numpy as np

_LONG = np.longdouble


def _binomial(p: float, n: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Chances of 0..most-1 successes of n trials, and tails: entry t of the second is P(successes >= t), t up to ``most``."""
    j = np.arange(min(n, most - 1), dtype=_LONG)
    steps = (n - j) / (j + 1) * (_LONG(p) / (1 - _LONG(p)))
    none = np.exp(n * np.log1p(-_LONG(p)))
    mass = np.zeros(most, _LONG)
    mass[: len(j) + 1] = none * np.concatenate([[_LONG(1)], np.cumprod(steps)])
    last = _LONG(0)
    if n >= most:
        if most <= n * p:
            last = max(_LONG(0), 1 - mass.sum())
        else:
            term = mass[most - 1] * (n - most + 1) / most * (_LONG(p) / (1 - _LONG(p)))
            for i in range(most, n + 1):
                last += term
                term *= _LONG(n - i) / (i + 1) * (_LONG(p) / (1 - _LONG(p)))
                if term <= last * _LONG(1e-21):
                    break
    tails = np.concatenate([last + np.cumsum(mass[::-1])[::-1], [last]])
    tails[0] = 1
    return mass, tails


def tails(chances: np.ndarray, numbers: np.ndarray, counts: np.ndarray, stop: float | None = None) -> np.ndarray:
    """P(successes >= k) for each k >= 1 of ``counts``, in extended precision (down to 1e-4900).

    With ``stop`` the walk ends as soon as the tail of the largest count is above it; all are 1 then.
    Chances of 0 change nothing; those of 1 are certain. Small chances come first, which keeps the sums stable.
    """
    order = np.argsort(chances, kind="stable")
    p, n = np.asarray(chances, np.float64)[order], np.asarray(numbers, np.int64)[order]
    certain = int(n[p >= 1].sum())
    p, n = p[(p > 0) & (p < 1)], n[(p > 0) & (p < 1)]
    most = int(max(counts)) - certain
    if most <= 0:
        return np.ones(len(counts), _LONG)
    state = np.zeros(most + 1, _LONG)
    state[0] = 1
    for chance, number in zip(p, n, strict=True):
        if number == 1:
            moved = state[:-1] * _LONG(chance)
            state[:-1] -= moved
            state[1:] += moved
        elif number * math.log1p(-chance) < -11_000:
            state[:] = 0  # that many successes are certain up to 1e-4700
            state[-1] = 1
        else:
            mass, above = _binomial(float(chance), int(number), most)
            last = state[-1] + (state[:-1] * above[most:0:-1]).sum()
            state[:-1] = np.convolve(state[:-1], mass)[:most]
            state[-1] = last
        if stop is not None and state[-1] > stop:
            return np.ones(len(counts), _LONG)
    through = np.cumsum(state[::-1])[::-1]
    return np.array([through[max(0, int(k) - certain)] for k in counts], _LONG)


def phred(p: _LONG, infinite: int) -> int:
    """Truncated; ``infinite`` for 0."""
    return infinite if p <= 0 else int(np.floor(-10 * np.log10(min(p, _LONG(1)))))
