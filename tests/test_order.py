"""Order along a contig with borders of bins in between."""

import random

import pytest
from pyspark.sql import functions as F

from deepsift.operators import order, pileup


@pytest.mark.parametrize("bits", [2, 5, 20])
def test_bins_change_nothing(spark, monkeypatch, bits):
    monkeypatch.setattr(order, "BIN_BITS", bits)
    rng = random.Random(bits)
    rows = [(c, p, "A" * rng.choice([1, 1, 1, 4, 9]), "T", rng.choice([None, 5, 9]), 0.5) for c in "ab" for p in sorted(rng.sample(range(300), 60)) for _ in range(rng.choice([1, 1, 2]))]
    df = spark.createDataFrame(rows, "chrom string, pos long, ref string, alt string, qual int, af double")
    got = sorted((r.chrom, r.pos, r.dist_left, r.dist_nearest) for r in order.distances(df).collect())
    want = []
    for c in "ab":
        at = sorted(r[1] for r in rows if r[0] == c)
        for i, p in enumerate(at):
            left = p - at[i - 1] if i else -1
            right = at[i + 1] - p if i + 1 < len(at) else -1
            want.append((c, p, left, min((x for x in (left, right) if x >= 0), default=-1)))
    assert got == sorted(want)
    near = {(r.chrom, r.pos): r.crowded for r in order.crowded(df, 3).collect()}
    assert near == {(c, p): any(d == c and 0 < abs(q - p) <= 3 for d, q, *_ in rows) for c, p, *_ in rows}
    picked = sorted((r.chrom, r.pos, r.ref) for r in order.stack_pick(df).collect())
    best = []
    for c in "ab":
        stack, end = [], -1
        for r in sorted((x for x in rows if x[0] == c), key=lambda x: x[1:4]) + [(c, 10**9, "A", "T", 0, 0.0)]:
            if r[1] >= end and stack:
                best.append(min(stack, key=lambda x: (-(2**31 if x[4] is None else x[4]), x[1:4]))[:3])
                stack = []
            stack.append(r)
            end = r[1] + max(len(r[2]), len(r[3]))
    assert picked == sorted(best)


@pytest.mark.parametrize("bits", [2, 20])
def test_homopolymers_over_bins(spark, monkeypatch, bits):
    monkeypatch.setattr(order, "BIN_BITS", bits)
    seq = "AAAAAAAAACCGTTTTTTTTTTTTAGGGGA"
    bases = spark.createDataFrame([("c", i, b) for i, b in enumerate(seq)], "chrom string, pos long, base string")
    got = sorted((r.start, r.base, r.length) for r in pileup.homopolymer_runs(bases).collect())
    assert got == [(0, "A", 9), (9, "C", 2), (11, "G", 1), (12, "T", 12), (24, "A", 1), (25, "G", 4), (29, "A", 1)]
    assert {r.pos: r.hrun for r in pileup.run_length_right(bases).where(F.col("pos") < 3).collect()} == {0: 9, 1: 9, 2: 9}
