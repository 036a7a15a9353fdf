"""Exact tests as column expressions: Poisson-binomial, Fisher, binomial, Poisson, and interval estimates."""

from __future__ import annotations

from decimal import Decimal
from math import factorial

from pyspark.sql import Column
from pyspark.sql import functions as F

from .quality import MAX_PHRED, col, prob_to_phred
from .rounded import exp_nearest, let, log_whole, table


#: Stirling's series as the C library's lgamma has it.
_SERIES = (4.18938533204672725052e-01, 8.33333333333329678849e-02, -2.77777777728775536470e-03, 7.93650558643019558500e-04, -5.95187557450339963135e-04, 8.36339918996282139126e-04, -1.63092934096575273989e-03)


def _stirling(x, log_x):
    """ln (x - 1)! for x >= 8, of numbers or columns, operation by operation as lgamma does it."""
    w0, w1, w2, w3, w4, w5, w6 = _SERIES
    z = 1.0 / x
    y = z * z
    return (x - 0.5) * (log_x - 1.0) + (w0 + z * (w1 + y * (w2 + y * (w3 + y * (w4 + y * (w5 + y * w6))))))


_FACTORIALS = [float(Decimal(factorial(n)).ln()) if n < 7 else _stirling(n + 1.0, float(Decimal(n + 1).ln())) for n in range(256)]


def log_factorial(n: Column | str) -> Column:
    """ln n! for whole n from 0 to 2**40: lgamma(n + 1) of the C library to the bit, but for some 1 in 50,000."""
    n = col(n).cast("double")
    many = let(F.greatest(n, F.lit(255.0)) + 1.0, lambda x: _stirling(x, log_whole(x)))
    return F.when(n <= 255, F.element_at(table(_FACTORIALS), n.cast("int") + 1)).otherwise(many)


def log_choose(n: Column, k: Column) -> Column:
    return log_factorial(n) - log_factorial(k) - log_factorial(n - k)


def poisson_binomial(probs: Column | str, most: Column | str) -> Column:
    """Chances of 0, 1, ..., most - 1 and of most or more successes in trials with the given probabilities.

    ``most`` is at least 1. The work is trials times ``most``; ascending probabilities keep the sums stable.
    """
    probs, most = col(probs), col(most).cast("int")
    start = F.transform(F.sequence(F.lit(0), most), lambda i: F.when(i == 0, 1.0).otherwise(0.0))

    def step(acc: Column, p: Column) -> Column:
        def cell(x: Column, k: Column) -> Column:
            below = F.element_at(acc, F.greatest(k, F.lit(1)))  # 1-based: the cell before
            return F.when(k == 0, x * (1 - p)).when(k == most, x + below * p).otherwise(x * (1 - p) + below * p)

        return F.transform(acc, cell)

    return F.aggregate(probs, start, step)


def tail_from(chances: Column | str, count: Column | str) -> Column:
    """P(X >= count) of poisson_binomial's result, count <= most."""
    chances = col(chances)
    return F.aggregate(F.slice(chances, col(count).cast("int") + 1, F.size(chances)), F.lit(0.0), lambda a, x: a + x)


def poisson_tail(k: Column | str, mean: Column | str) -> Column:
    """P(X >= k) of a Poisson variable, k >= 1."""
    k, mean = col(k).cast("int"), col(mean)
    below = F.transform(F.sequence(F.lit(0), k - 1), lambda i: F.exp(i * F.log(mean) - mean - log_factorial(i)))
    return F.greatest(F.lit(0.0), 1 - F.aggregate(below, F.lit(0.0), lambda a, x: a + x))


def binomial_cdf(k: Column | str, n: Column | str, p: Column | str) -> Column:
    """P(X <= k) of n trials with chance p; p outside (0, 1) is taken at its end."""
    k, n, p = col(k).cast("long"), col(n).cast("long"), col(p)
    term = lambda i: F.exp(log_choose(n.cast("double"), i.cast("double")) + i * F.log(p) + (n - i) * F.log(1 - p))
    total = F.aggregate(F.transform(F.sequence(F.lit(0).cast("long"), F.least(k, n)), term), F.lit(0.0), lambda a, x: a + x)
    return F.when(k < 0, 0.0).when((k >= n) | (p <= 0), 1.0).when(p >= 1, 0.0).otherwise(F.least(total, F.lit(1.0)))


def fisher_two_sided(a: Column | str, b: Column | str, c: Column | str, d: Column | str) -> Column:
    """Of the table a b / c d: the chance of all tables with its margins that are no likelier, up to 1e-8.

    Chances of exactly 0.1 or 0.01 are not rare, and their truncated phreds hang on the last bit. So terms are added in the order of the
    usual lgamma formula, each rounded as there.
    """
    a, b, c, d = (col(x).cast("long") for x in (a, b, c, d))

    row, other, column, n = a + b, c + d, a + c, a + b + c + d

    def chance(whole: Column) -> Column:
        f_row, f_other, f_n, f_column, f_rest = (F.element_at(whole, i) for i in range(1, 6))

        def likelihood(k: Column, start: Column) -> Column:
            parts = F.transform(F.array(k, row - k, column - k, other - column + k), log_factorial)
            of = lambda p: start - p[0] - p[1] + f_other - p[2] - p[3] - f_n + f_column + f_rest
            return let(parts, of)

        low, high = F.greatest(F.lit(0).cast("long"), row + column - n), F.least(row, column)
        logs = F.transform(F.sequence(low, high), lambda k: likelihood(k, f_row))
        return let(likelihood(a, 1e-8 + f_row), lambda most: F.aggregate(logs, F.lit(0.0), lambda s, x: s + F.when(x < most, exp_nearest(x)).otherwise(0.0)))

    return F.least(F.lit(1.0), let(F.transform(F.array(row, other, n, column, b + d), log_factorial), chance))


def fisher_one_sided(a: Column | str, b: Column | str, c: Column | str, d: Column | str) -> tuple[Column, Column]:
    """Of the table a b / c d: the chances of its first cell being a or less, and a or more."""
    a, b, c, d = (col(x).cast("long") for x in (a, b, c, d))
    row, column, n = a + b, a + c, a + b + c + d
    low, high = F.greatest(F.lit(0).cast("long"), row + column - n), F.least(row, column)
    mass = lambda k: F.exp(log_choose(row, k) + log_choose(n - row, column - k) - log_choose(n, column))
    total = lambda lo, hi: F.least(F.lit(1.0), F.aggregate(F.transform(F.sequence(lo, hi), mass), F.lit(0.0), lambda s, x: s + x))
    return total(low, a), total(a, high)


def strand_bias(ref_fw: Column | str, ref_rv: Column | str, alt_fw: Column | str, alt_rv: Column | str) -> Column:
    """Phred of Fisher's test; without reference bases and with alternatives on one strand it is infinite."""
    ref_fw, ref_rv, alt_fw, alt_rv = map(col, (ref_fw, ref_rv, alt_fw, alt_rv))
    lone = (ref_fw + ref_rv == 0) & ((alt_fw == 0) | (alt_rv == 0))
    return F.when(lone, F.lit(MAX_PHRED)).otherwise(prob_to_phred(fisher_two_sided(ref_fw, ref_rv, alt_fw, alt_rv)))


def frequency_interval(count: Column | str, depth: Column | str) -> tuple[Column, Column]:
    """An Agresti-Coull-like interval of a frequency: n + 4, x + 2, three times 2 standard errors, low end not below 0."""
    n, x = col(depth) + 4.0, col(count) + 2.0
    p = x / n
    half = 3 * 2 * F.sqrt(p * (1 - p) / n)
    return F.greatest(F.lit(0.0), p - half), p + half


def combine_two(p: Column | str, q: Column | str) -> Column:
    """Fisher's combination of two p-values: chi-square with 4 degrees of freedom, closed form."""
    x = -2 * (F.log(col(p)) + F.log(col(q)))
    return F.exp(-x / 2) * (1 + x / 2)


def normal_tail(z: Column | str) -> Column:
    """P(X > z) of the standard normal law, z >= 0: a power series below 3, a continued fraction from there on."""
    z = col(z)
    density = F.exp(-z * z / 2) * 0.3989422804014326779
    steps = F.sequence(F.lit(1), F.lit(60))
    start = F.struct(z.alias("term"), z.alias("sum"))
    grown = F.aggregate(steps, start, lambda s, k: F.struct((s["term"] * z * z / (2 * k + 1)).alias("term"), (s["sum"] + s["term"] * z * z / (2 * k + 1)).alias("sum")))["sum"]
    fraction = F.aggregate(F.reverse(steps), z, lambda x, k: z + k / x)
    return F.when(z < 3, 0.5 - density * grown).otherwise(density / fraction)


def log_sum(a: Column | str, b: Column | str) -> Column:
    """ln(e^a + e^b)."""
    hi, lo = F.greatest(col(a), col(b)), F.least(col(a), col(b))
    return hi + F.log1p(F.exp(lo - hi))


def log_diff(a: Column | str, b: Column | str) -> Column:
    """ln(e^a - e^b) for a over b; minus infinity where they are equal."""
    a, b = col(a), col(b)
    return F.when(a <= b, F.lit(float("-inf"))).otherwise(a + F.log(-F.expm1(b - a)))
