"""Alignment models and the operators on reads against scalar versions."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from deepsift.functions import hmm
from deepsift.operators import align
from deepsift.sources import text

READS = "qname string, flag int, chrom string, pos long, mapq int, cigar string, seq string, qual array<int>, tags map<string,string>"


def frame(spark, rows):
    df = spark.createDataFrame(rows, READS)
    return df.withColumn("ops", text.cigar_ops("cigar"))


def scalar_posteriors(ref, query, wrong, band):
    """All states of the model by name, without scaling: {(state, base, place)} from 1."""
    n, m = len(query), len(ref)
    band = max(min(max(n, m), band), abs(n - m))
    leave, o, e = 1 / (2 * n + 2), hmm.OPEN, hmm.EXTEND
    go = {"MM": (1 - 2 * o) * (1 - leave), "MI": o * (1 - leave), "MD": o * (1 - leave), "IM": (1 - e) * (1 - leave), "II": e * (1 - leave), "DM": 1 - e, "DD": e}
    fits = lambda i, k: 1 <= k <= m and abs(k - i) <= band
    emit = lambda i, k: 1.0 if ref[k - 1] > 3 or query[i - 1] > 3 else 1 - wrong[i - 1] if ref[k - 1] == query[i - 1] else wrong[i - 1] / 3
    f, b = {}, {}
    for i in range(1, n + 1):
        for k in (k for k in range(1, m + 1) if fits(i, k)):
            if i == 1:
                f["M", 1, k], f["I", 1, k], f["D", 1, k] = emit(1, k) * (1 - o) / m, 0.25 * o / m, 0.0
            else:
                f["M", i, k] = emit(i, k) * sum(go[s + "M"] * f.get((s, i - 1, k - 1), 0) for s in "MID")
                f["I", i, k] = 0.25 * sum(go[s + "I"] * f.get((s, i - 1, k), 0) for s in "MI")
                f["D", i, k] = sum(go[s + "D"] * f.get((s, i, k - 1), 0) for s in "MD")
    total = sum(leave * (f.get(("M", n, k), 0) + f.get(("I", n, k), 0)) for k in range(1, m + 1))
    for i in range(n, 0, -1):
        for k in (k for k in range(m, 0, -1) if fits(i, k)):
            match = emit(i + 1, k + 1) * b.get(("M", i + 1, k + 1), 0) if i < n and fits(i + 1, k + 1) else 0
            b["D", i, k] = go["DM"] * match + go["DD"] * b.get(("D", i, k + 1), 0) if 1 < i < n else 0.0
            for s in "MI":
                b[s, i, k] = leave if i == n else go[s + "M"] * match + go[s + "I"] * 0.25 * b.get(("I", i + 1, k), 0) + (go["MD"] * b.get(("D", i, k + 1), 0) if s == "M" else 0)
    return {x: f[x] * b[x] / total for x in f}, band


@pytest.mark.parametrize("length, width, band", [(12, 12, 7), (20, 23, 7), (23, 20, 3), (9, 30, 7), (1, 5, 7)])
def test_posteriors(length, width, band):
    rng = np.random.default_rng(length)
    ref, query = rng.integers(0, 5, (3, width)), rng.integers(0, 5, (3, length))
    query[0, : min(length, width)] = ref[0, : min(length, width)]
    wrong = 10 ** (-rng.integers(2, 40, (3, length)) / 10)
    joint, total, used = hmm.posteriors(ref, query, wrong, band)
    assert np.allclose(total, 1)
    for n in range(3):
        want, own = scalar_posteriors(ref[n], query[n], wrong[n], band)
        assert own == used and max(abs(joint[n, i - 1, k - i + used, "MID".index(s)] - v) for (s, i, k), v in want.items()) < 1e-12


def path_score(ref, query, wrong, place, path):
    """log10 of the model's chance of an alignment that starts at a place of the reference."""
    width = len(ref) + 1
    leave, o, e = 1 / (2 * width), hmm.OPEN, hmm.EXTEND
    go = {"MM": (1 - 2 * o) * (1 - leave), "MI": o * (1 - leave), "MD": o * (1 - leave), "IM": (1 - e) * (1 - leave), "II": e * (1 - leave), "DM": 1 - e, "DD": e}
    out, last, r, q = math.log10({"M": (1 - o) / width, "I": o / width}.get(path[0], 1e-300)), None, place, 0
    for op in path:
        if last:
            out += math.log10(go.get(last + op, 1e-300))
        if op == "M":
            out += math.log10(1 - wrong[q] if ref[r] == query[q] else wrong[q] / 3)
        elif op == "I":
            out += math.log10(0.25)
        r, q, last = r + (op != "I"), q + (op != "D"), op
    return out


def test_likeliest_path():
    """No other placement of up to one gap is likelier; gaps stand as far to the left as they can."""
    rng = random.Random(1)
    for _ in range(40):
        ref = "".join(rng.choice("ACGT") for _ in range(40))
        at = rng.randrange(3, 8)
        query, gap, n = ref[at : at + 24], rng.randrange(5, 18), rng.randrange(0, 4)
        query = query[:gap] + query[gap + n :] if rng.random() < 0.5 else query[:gap] + "".join(rng.choice("ACGT") for _ in range(n)) + query[gap:]
        wrong = np.array([10 ** -rng.choice([2, 3, 4]) for _ in query])
        place, path = hmm.likeliest_path(ref, query, wrong)
        own = path_score(ref, query, wrong, place, path)
        for start in range(0, 41 - len(query) - 4):
            tries = ["M" * len(query)] + ["M" * g + "D" * k + "M" * (len(query) - g) for g in range(1, len(query)) for k in range(1, 5)] + ["M" * g + "I" * k + "M" * (len(query) - g - k) for k in range(1, 5) for g in range(1, len(query) - k)]
            assert all(path_score(ref, query, wrong, start, t) <= own + 0.05 for t in tries)  # moving a gap swaps equal bases of other qualities
    assert hmm.left_aligned("ACGTTTTA", "ACGTTTA", "MMMMMMDM") == "MMMDMMMM"
    assert hmm.left_aligned("ACGTTTA", "ACGTTTTA", "MMMMMMIM") == "MMMIMMMM"


CONTIG = "".join(random.Random(3).choices("ACGT", k=400))


@pytest.fixture(scope="module")
def contigs(spark):
    return spark.createDataFrame([("c", CONTIG[:100] + "AAAAAAAA" + CONTIG[108:])], "chrom string, seq string")


def test_realign_scrambled_reads(spark, contigs):
    ref = contigs.first().seq
    rows = [("a", 0, "c", 120, 60, "20M3I10M3D42M", ref[120:195], [30] * 75, {"NM": "6", "XX": "1"}), ("b", 16, "c", 203, 60, "2S5M2I66M", "TT" + ref[200:273], [2] * 40 + [35] * 35, {"MD": "x"}),
            ("plain", 0, "c", 10, 60, "30M", ref[10:40], [30] * 30, {"NM": "0"}), ("hard", 0, "c", 10, 60, "5H10M2I18M", ref[10:40], [30] * 30, {}), ("lost", 4, None, 0, 0, "*", "ACGT", [30] * 4, {"NM": "0"}),
            ("low", 0, "c", 10, 60, "10M2I18M", ref[10:40], [2] * 30, {}), ("other", 0, "nowhere", 10, 60, "10M2I18M", ref[10:40], [30] * 30, {})]
    got = {r.qname: r for r in align.realign(frame(spark, rows), contigs).collect()}
    assert (got["a"].cigar, got["a"].pos, got["a"].tags) == ("75M", 120, {"XX": "1"}) and [(o.op, o.len) for o in got["a"].ops] == [("M", 75)]
    assert (got["b"].cigar, got["b"].pos) == ("2S73M", 200) and got["b"].tags == {}
    for name in ("plain", "hard", "low", "other"):
        assert (got[name].cigar, got[name].pos) == (next(r[5] for r in rows if r[0] == name), 10)
    assert len(got) == 7 and got["plain"].tags == {} and got["lost"].pos == 0
    kept = {r.qname: r.tags for r in align.realign(frame(spark, rows), contigs, keep_tags=True).collect()}
    assert kept["a"] == {"NM": "6", "XX": "1"}


def test_alignment_qualities(spark, contigs):
    ref = contigs.first().seq
    deleted = ref[80:103] + ref[104:130]  # one A of eight
    inserted = ref[80:110] + "GT" + ref[110:130]
    rows = [("fit", 0, "c", 80, 60, "50M", ref[80:130], [30] * 50, {}), ("del", 0, "c", 80, 60, "20M1D29M", deleted, [35] * 49, {}), ("late", 0, "c", 80, 60, "27M1D22M", deleted, [35] * 49, {"lb": "old"}),
            ("ins", 0, "c", 80, 60, "30M2I20M", inserted, [35] * 52, {}), ("shifted", 0, "c", 81, 60, "25M", ref[80:92] + ref[95:108], [30] * 25, {}), ("lost", 4, "c", 80, 60, "50M", ref[80:130], [30] * 50, {"z": "1"})]
    got = {r.qname: r.tags for r in align.alignment_qualities(frame(spark, rows), contigs).collect()}
    for name, _, _, pos, _, cigar, seq, qual, _ in rows[:2] + rows[3:5]:
        ops = [(o, int(n)) for n, o in __import__("re").findall(r"(\d+)(\D)", cigar)]
        read = {"pos": pos, "ops": [{"op": o, "len": n} for o, n in ops], "seq": seq, "qual": qual, "ref": ref, "ref_start": 0}
        xb, xe, band = align._window(read)
        wrong = [10 ** (-q / 10) for q in qual]
        want, band = scalar_posteriors(align._codes(ref[xb:xe]), align._codes(seq), wrong, band)
        base = []
        for i in range(1, len(seq) + 1):
            own = {(k, s): v for (s, j, k), v in want.items() if j == i and s != "D"}
            best = max(own, key=lambda x: (own[x], -x[0], x[1] == "M"))
            base.append((best, -4.343 * math.log(max(1e-40, 1 - own[best] / sum(own.values()))) + 0.499))
        r, q, expect = pos, 0, list(qual)
        for op, n in ops:
            if op == "M":
                raw = [min(99, int(v)) if k == (r + j - xb + 1, "M") else 0 for j, (k, v) in enumerate(base[q : q + n])]
                expect[q : q + n] = [min(max(raw[: j + 1]), max(raw[j:])) for j in range(n)]
                r, q = r + n, q + n
            r, q = r + n * (op == "D"), q + n * (op == "I")
        assert [min(93, x) for x in expect] == pytest.approx([ord(c) - 33 for c in got[name]["lb"]], abs=1), name
        for tag, op, state in (("ad", "D", "D"), ("ai", "I", "I")):
            if op in cigar:
                at = next(j for j, (o, _) in enumerate(ops) if o == op)
                q, r = sum(n for o, n in ops[:at] if o in "MI"), pos + sum(n for o, n in ops[:at] if o in "MD")
                unit = ref[r : r + ops[at][1]] if op == "D" else seq[q : q + ops[at][1]]
                past, rep = r + (ops[at][1] if op == "D" else 0), 0
                while past + rep < xe and ref[past + rep] == unit[rep % len(unit)]:
                    rep += 1
                share = sum(want.get((state, q + j + (op == "I"), r - xb + j + (op == "D")), 0) for j in range(rep + 1))
                assert got[name][tag][q - 1] == align._phred_char(1 - share) and set(got[name][tag][: q - 1] + got[name][tag][q:]) == {"~"}
            else:
                assert tag not in got[name]
    assert got["del"]["ad"][19] > got["late"]["ad"][26] and got["late"]["lb"] == "old" and got["lost"] == {"z": "1"}
    again = {r.qname: r.tags for r in align.alignment_qualities(frame(spark, rows), contigs, redo=True, indels=False).collect()}
    assert again["late"]["lb"] != "old" and "ad" not in again["late"]
    assert "lb" not in {r.qname: r.tags for r in align.alignment_qualities(frame(spark, rows), contigs, bases=False).collect()}["fit"]


def brute_source(chances, most):
    dist = [1.0]
    for n, p in enumerate(sorted(chances), 1):
        dist = [a * (1 - p) + b * p for a, b in zip([*dist, 0], [0, *dist], strict=True)]
        if n > most and sum(dist[most:]) > 0.05:
            break
    return dist[most - 1]


def test_source_quality(spark, contigs):
    ref = contigs.first().seq
    wrong = lambda s, at: "".join("ACGT"["ACGT".index(c) - 1] if i in at else c for i, c in enumerate(s))
    rows = [("three", 0, "c", 130, 60, "40M", wrong(ref[130:170], {3, 9, 30}), [20] * 40, {}), ("one", 0, "c", 130, 60, "40M", wrong(ref[130:170], {3}), [20] * 40, {}), ("indels", 0, "c", 130, 60, "10M2D10M3I10M", wrong(ref[130:140] + ref[142:152] + "AAA" + ref[152:162], {4}), [30] * 33, {}),
            ("none", 0, "c", 130, 60, "5S", "ACGTA", [30] * 5, {}), ("elsewhere", 0, "x", 130, 60, "5M", "ACGTA", [30] * 5, {})]
    got = {r.qname: r for r in align.operation_counts(frame(spark, rows), contigs).collect()}
    assert [got["three"][k] for k in align.KINDS] == [37, 3, 0, 0] and [got["indels"][k] for k in align.KINDS] == [29, 1, 1, 1]
    assert got["three"].source_quality == int(-10 * math.log10(1 - brute_source([0.01] * 40, 2)))
    assert got["indels"].source_quality == int(-10 * math.log10(1 - brute_source([0.001] * 30 + [10**-4.5] * 2, 2)))
    assert got["one"].source_quality == align.CERTAIN and got["none"].source_quality == 0 and got["elsewhere"].source_quality is None
    sites = spark.createDataFrame([("c", 133), ("c", 139), ("c", 149 + 2)], "chrom string, pos long")
    fewer = {r.qname: r for r in align.operation_counts(frame(spark, rows), contigs, ignore=sites).collect()}
    assert [fewer["three"][k] for k in align.KINDS] == [37, 1, 0, 0] and fewer["indels"].insertions == 0
    tags = {r.qname: r.tags for r in align.source_qualities(frame(spark, rows), contigs).collect()}
    assert tags["one"] == {"sq": str(align.CERTAIN)} and tags["elsewhere"] == {}
    shares = {(r.kind, r.n): r.share for r in align.operation_histogram(align.operation_counts(frame(spark, rows), contigs)).collect()}
    assert shares["insertions", 1] == 0.25 and shares["mismatches", 3] == 0.25


def test_reference_chunks(spark):
    """Reads at and over the borders of chunks, and one longer than a chunk, meet their own bases."""
    rng = random.Random(4)
    seq = "".join(rng.choices("ACGT", k=3 * text.CHUNK))
    contigs = spark.createDataFrame([("c", seq)], "chrom string, seq string")
    at = [0, 5, text.CHUNK - 30, text.CHUNK - 1, 2 * text.CHUNK + 7, len(seq) - 20]
    rows = [(str(p), 0, "c", p, 60, "50M", "A" * 50, [30] * 50, {}) for p in at] + [("far", 0, "c", 100, 60, f"20M{text.CHUNK}N30M", "A" * 50, [30] * 50, {})]
    got = {r.qname: r for r in text.with_reference(frame(spark, rows), contigs, F.lit(10)).collect()}
    for p in at:
        low = max(0, p - 10)
        assert (got[str(p)].ref_start, got[str(p)].ref) == (low, seq[low : p + 60])
    assert got["far"].ref == seq[90 : 100 + 50 + text.CHUNK + 10]
