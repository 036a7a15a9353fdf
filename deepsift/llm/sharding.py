"""A reproducible shuffle into shards by a Feistel permutation of global row numbers; Spark functions only."""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, number_rows

ROUNDS = 8
WALK = 64


def permute(df: DataFrame, row: str, n: int, seed: int, out: str) -> DataFrame:
    """df with ``out``, the image of ``row`` (0..n-1) under a permutation of 0..n-1.

    The network works on wide * narrow >= n numbers, less than wide more than n. Where it leaves 0..n-1 it is
    applied again until it returns; that takes at most ``wide`` steps, and beyond n = WALK ** 2 each step is
    outside with a chance below 1/WALK. More than WALK steps raise an error instead of a wrong number.
    """
    if n == 0:
        return df.withColumn(out, F.lit(None).cast("long"))
    wide = isqrt(n - 1) + 1
    narrow = -(-n // wide)
    # Each half of a round is a column of its own, or the expression would double at every round.
    left, right = f"__{out}_l", f"__{out}_r"
    df = df.withColumn(left, F.expr(f"`{row}` div {narrow}")).withColumn(right, F.pmod(F.col(row), F.lit(narrow)))
    for i in range(ROUNDS):
        df = df.withColumn(*_round(i, left, right, wide, narrow, seed))
    first = F.col(left) * F.lit(narrow) + F.col(right)
    walk = F.aggregate(
        F.sequence(F.lit(1), F.lit(WALK)),
        F.struct(first.alias("x")),
        lambda s, _: F.when(s["x"] < n, s).otherwise(F.struct(_walked(s["x"], wide, narrow, seed).alias("x"))),
    )["x"]
    df = df.withColumn(out, F.when(first < n, first).otherwise(walk))
    lost = F.raise_error(F.lit("the walk did not return")).cast("long")
    return df.withColumn(out, F.when(F.col(out) < n, F.col(out)).otherwise(lost)).drop(left, right)


def _round(i: int, left: str, right: str, wide: int, narrow: int, seed: int) -> tuple[str, Column]:
    own, other, size = (right, left, narrow) if i % 2 else (left, right, wide)
    return own, F.pmod(F.col(own) + F.pmod(F.xxhash64(F.lit(seed), F.lit(i), F.col(other)), F.lit(size)), F.lit(size))


def _walked(x: Column, wide: int, narrow: int, seed: int) -> Column:
    """One application inside a lambda: a fold over the rounds, so that the expression stays small."""
    start = F.struct(((x - F.pmod(x, F.lit(narrow))) / F.lit(narrow)).cast("long").alias("l"), F.pmod(x, F.lit(narrow)).alias("r"))

    def step(s: Column, i: Column) -> Column:
        odd = F.pmod(i, F.lit(2)) == 1
        moved_r = F.pmod(s["r"] + F.pmod(F.xxhash64(F.lit(seed), i, s["l"]), F.lit(narrow)), F.lit(narrow))
        moved_l = F.pmod(s["l"] + F.pmod(F.xxhash64(F.lit(seed), i, s["r"]), F.lit(wide)), F.lit(wide))
        return F.struct(F.when(odd, s["l"]).otherwise(moved_l).alias("l"), F.when(odd, moved_r).otherwise(s["r"]).alias("r"))

    end = F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step)
    return end["l"] * F.lit(narrow) + end["r"]


def shards(rows: DataFrame, order: list[str], count: int, seed: int = 17, scratch: Scratch | None = None) -> DataFrame:
    """rows with shard (0..count-1) and slot (0.. without gaps in each shard), shard sizes at most one apart.

    Rows are numbered by ``order`` over the whole table; number r goes to place y = permute(r), which is slot
    y div count of shard y mod count. Shard and slot of a row follow from its number, n and the seed alone. The
    text never moves: pass only the columns that are wanted. An empty table returns no rows; nulls sort first;
    rows equal in all of ``order`` share out their places in any way. Input columns called shard or slot are
    replaced.
    """
    scratch = scratch or Scratch(rows.sparkSession, "shards")
    rows = rows.drop("shard", "slot")
    numbered = number_rows(scratch.save(rows), order, scratch, "__row")
    n = numbered.count()
    placed = permute(numbered, "__row", n, seed, "__place")
    return placed.withColumn("shard", F.pmod("__place", F.lit(count)).cast("int")).withColumn("slot", F.expr(f"__place div {count}")).drop("__row", "__place")
