"""Logarithm and exponential rounded to the nearest double but for some 1 in 100,000, as column expressions.

Spark's own are up to a unit in the last place off. That moves a truncated phred whose chance is a power of ten but for rounding.
"""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal, localcontext

from pyspark.sql import Column
from pyspark.sql import functions as F

PARTS = 128
_FINE = 2**40


def let(value: Column, of: Callable[[Column], Column]) -> Column:
    """``of`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), of), 1)


def table(values: list[float]) -> Column:
    """Doubles as one array, which the optimizer makes a literal; as text it is small to plan."""
    return F.split(F.lit(" ".join(map(repr, values))), " ").cast("array<double>")


def _split(exact: Decimal, unit: int) -> tuple[float, float]:
    """A multiple of 1 / ``unit`` and the rest."""
    high = round(exact * unit) / unit
    return high, float(exact - Decimal(high))


with localcontext() as _context:
    _context.prec = 50
    _LN2 = Decimal(2).ln()
    _LN2_HIGH, _LN2_LOW = _split(_LN2, _FINE)
    _STEP_HIGH, _STEP_LOW = _split(_LN2 / PARTS, _FINE)
    _INVERSE = [round(512 / (1 + (i + 0.5) / PARTS)) / 512 for i in range(PARTS)]  # few digits: their products with whole numbers are exact
    _LOG_HIGH, _LOG_LOW = zip(*(_split(-Decimal(v).ln(), _FINE) for v in _INVERSE), strict=True)
    _POWER_HIGH, _POWER_LOW = zip(*(_split((_LN2 * i / PARTS).exp(), 2**25) for i in range(PARTS)), strict=True)


def _polynomial(x: Column, coefficients: list[float]) -> Column:
    out = F.lit(coefficients[-1])
    for c in reversed(coefficients[:-1]):
        out = c + x * out
    return out


def log_whole(x: Column) -> Column:
    """ln x of a whole number from 8 to 2**40."""

    def near(k: Column, m: Column, i: Column) -> Column:
        def total(r: Column, w: Column) -> Column:
            rest = k * _LN2_LOW + F.element_at(table(_LOG_LOW), i) + r * r * _polynomial(r, [(-1.0) ** (j + 1) / j for j in range(2, 10)])
            return (w + r) + ((w - (w + r)) + r + rest)

        return let(m * F.element_at(table(_INVERSE), i) - 1.0, lambda r: let(k * _LN2_HIGH + F.element_at(table(_LOG_HIGH), i), lambda w: total(r, w)))

    x = x.cast("double")
    scaled = lambda k: let(x / F.pow(F.lit(2.0), k), lambda m: let(F.floor((m - 1.0) * PARTS).cast("int") + 1, lambda i: near(k, m, i)))
    return let(F.floor(F.log2(x + 0.5)).cast("double"), scaled)


def exp_nearest(x: Column) -> Column:
    """e to the x; Spark's own outside -700 to 700."""

    def of_rest(high: Column, low: Column, power: Column, tail: Column) -> Column:
        """(power + tail) e^(high + low) for a power and a high of so few digits that their product is exact."""
        r = high + low
        more = low + r * r * _polynomial(r, [0.5, 1 / 6, 1 / 24, 1 / 120, 1 / 720, 1 / 5040])
        first = power * high
        return (power + first) + ((power - (power + first)) + first + (tail + tail * (high + more) + power * more))

    def of_steps(n: Column) -> Column:
        j = F.pmod(n, F.lit(PARTS)).cast("int")
        over, less = x - n * _STEP_HIGH, n * _STEP_LOW
        high = (over - less + 1.5 * 2**26) - 1.5 * 2**26  # a multiple of 2**-26
        whole = let(high, lambda h: of_rest(h, (over - h) - less, F.element_at(table(_POWER_HIGH), j + 1), F.element_at(table(_POWER_LOW), j + 1)))
        return whole * F.pow(F.lit(2.0), (n - j) / PARTS)

    return F.when(F.abs(x) <= 700, let(F.rint(x * float(PARTS / _LN2)), of_steps)).otherwise(F.exp(x))
