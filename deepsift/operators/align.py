"""Alignment of reads looked at again: qualities of bases and indels by a pair model, realignment, and how well a read fits its place.

Reads are rows of ``sources.text.read_sam``; each meets its own stretch of the reference (``with_reference``). The
models run on Arrow batches; a read is decided by itself, so nothing is shuffled but that join.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import hmm
from ..sources.text import cigar_ops, with_reference, with_sites

#: Names of the tags.
BASE_TAG, INS_TAG, DEL_TAG, SOURCE_TAG = "lb", "ai", "ad", "sq"
MATCHED, ALONG_READ, ALONG_REF = frozenset("M=X"), frozenset("M=XIS"), frozenset("M=XDN")
#: An indel of more bases has no alignment quality.
LONGEST = 16
#: A read needs a band as wide as it differs from its stretch in length; beyond this one it keeps its tags.
WIDEST = 5000
TOGETHER = 128
_CODES = np.full(256, 4, np.int64)
for _i, _b in enumerate(b"ACGT"):
    _CODES[_b] = _CODES[_b + 32] = _i


def _codes(s: str) -> np.ndarray:
    return _CODES[np.frombuffer(s.encode("latin-1"), np.uint8)]


def _blocks(read: dict):
    """(op, length, place on the reference, place on the read) of each operation."""
    r, q = read["pos"], 0
    for o in read["ops"]:
        yield o["op"], o["len"], r, q
        r += o["len"] if o["op"] in ALONG_REF else 0
        q += o["len"] if o["op"] in ALONG_READ else 0


def _window(read: dict) -> tuple[int, int, int] | None:
    """First and past the last place of the reference that a read is aligned with, and the band."""
    matched = [(n, r, q) for op, n, r, q in _blocks(read) if op in MATCHED]
    if not matched:
        return None
    (_, xb, yb), (n, r, q) = matched[0], matched[-1]
    xe, ye, length = r + n, q + n, len(read["seq"])
    band = 7
    if (off := abs((xe - xb) - (ye - yb))) > band:
        band = off + 3
    xb, xe = max(0, xb - yb - band // 2), xe + length - ye + band // 2
    if (over := xe - xb - length - band) > 0:
        xb, xe = xb + over // 2, xe - over // 2
    return xb, min(xe, read["ref_start"] + len(read["ref"])), band


def _phred_char(p: float) -> str:
    return "~" if p < np.finfo(float).eps else chr(min(126, max(33, int(-10 * np.log10(p)) + 33)))


def _base_tag(read: dict, xb: int, place: np.ndarray, inserted: np.ndarray, quality: np.ndarray, extended: bool) -> str:
    out = np.array(read["qual"], np.int64)
    for op, n, r, q in _blocks(read):
        if op in MATCHED:
            at = slice(q, q + n)
            own = np.where(~inserted[at] & (place[at] == r - xb + np.arange(n)), quality[at], 0)
            if extended:
                own = np.minimum(np.maximum.accumulate(own), np.maximum.accumulate(own[::-1])[::-1])
            out[at] = own
    return (np.minimum(out, 93) + 33).astype(np.uint8).tobytes().decode("latin-1")


def _indel_tags(read: dict, xb: int, xe: int, joint: np.ndarray, band: int) -> tuple[str | None, str | None]:
    """Chance that an indel is not there: one less the sum over all placements that give the same sequence, on the base before it."""
    length, tags, seen = len(read["seq"]), {"I": None, "D": None}, set()
    ref = read["ref"]
    for op, n, r, q in _blocks(read):
        if op not in "ID" or n > LONGEST or (op == "D" and q == 0):
            continue
        seen.add(op)
        tags[op] = tags[op] or ["~"] * length
        if q == 0:
            continue
        unit = read["seq"][q : q + n].upper() if op == "I" else ref[r - read["ref_start"] : r - read["ref_start"] + n]
        at, repeats = r + (n if op == "D" else 0), 0
        while at + repeats < xe and ref[at + repeats - read["ref_start"]] == unit[repeats % n]:
            repeats += 1
        share = 0.0
        for j in range(repeats + 1):
            base, place = (q + j - 1, r - xb + j) if op == "D" else (q + j, r - xb + j - 1)
            if base >= length:
                break
            if 0 <= (d := place - base + band) <= 2 * band:
                share += joint[base, d, 2 if op == "D" else 1]
        tags[op][q - 1] = _phred_char(1 - share)
    return tuple("".join(tags[op]) if op in seen else None for op in "ID")


def _qualities(extended: bool):
    def tagged(reads: list[dict]) -> list[tuple[str | None, ...]]:
        out: list[tuple[str | None, ...]] = [(None, None, None)] * len(reads)
        alike = defaultdict(list)
        for i, r in enumerate(reads):
            if r["ref"] and r["seq"] and r["seq"] != "*" and r["ops"] and not r["flag"] & 4 and len(r["qual"]) == len(r["seq"]) and (w := _window(r)):
                if w[1] > w[0] and w[2] <= WIDEST and sum(o["len"] for o in r["ops"] if o["op"] in ALONG_READ) == len(r["seq"]):
                    alike[len(r["seq"]), w[1] - w[0], w[2]].append((i, w))
        for (_, width, band), members in alike.items():
            step = max(1, TOGETHER * 16 // (2 * band + 1))
            for lo in range(0, len(members), step):
                part = members[lo : lo + step]
                own = [reads[i] for i, _ in part]
                ref = np.stack([_codes(r["ref"][w[0] - r["ref_start"] :][:width]) for r, (_, w) in zip(own, part, strict=True)])
                wrong = 10 ** (-np.array([r["qual"] for r in own], np.float64) / 10)
                joint, total, used = hmm.posteriors(ref, np.stack([_codes(r["seq"]) for r in own]), wrong, band)
                place, inserted, quality = hmm.best_states(joint, total, used)
                for k, (i, w) in enumerate(part):
                    out[i] = (_base_tag(reads[i], w[0], place[k], inserted[k], quality[k], extended), *_indel_tags(reads[i], w[0], w[1], joint[k], used))
        return out

    return tagged


_NEEDS = ["flag", "pos", "ops", "seq", "qual", "ref", "ref_start"]


def _mapped(reads: DataFrame, needs: list[str], made: T.StructType, compute) -> DataFrame:
    """reads with the columns that compute(list of dicts) makes of each; all other columns pass as they are."""
    kinds = {T.StringType: pa.string(), T.LongType: pa.int64(), T.IntegerType: pa.int32()}
    keep = [c for c in reads.columns if c not in ("ref", "ref_start", "sites")]

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 1024):
                part = b.slice(lo, 1024)
                columns = list(zip(*compute(part.select(needs).to_pylist()), strict=True))
                new = [pa.array(c, kinds[type(f.dataType)]) for c, f in zip(columns, made, strict=True)]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], *new], [*keep, *made.names])

    return reads.mapInArrow(run, T.StructType([*[reads.schema[c] for c in keep], *made.fields]))


def _set_tags(reads: DataFrame, **columns: str) -> DataFrame:
    """Tags set from columns where they are not null."""
    told = F.map_filter(F.create_map(*[x for tag, c in columns.items() for x in (F.lit(tag), F.col(c).cast("string"))]), lambda k, v: v.isNotNull())
    rest = F.map_filter(F.coalesce("tags", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))), lambda k, v: ~F.map_contains_key(told, k))
    return reads.withColumn("tags", F.map_concat(rest, told)).drop(*columns.values())


def alignment_qualities(reads: DataFrame, contigs: DataFrame, bases: bool = True, indels: bool = True, extended: bool = True, redo: bool = False) -> DataFrame:
    """reads with tags lb (quality of each base's alignment), ai and ad (of each insertion's and deletion's).

    A base that the model puts elsewhere has 0; inserted and clipped bases keep their own quality. ``extended`` lifts a
    base to the least of the best qualities on its either side within its block. An indel's quality stands on the base
    before it, over all equal placements; other bases have the highest. Tags that are there stay unless ``redo``.
    Unmapped reads, reads without a reference and reads whose lengths do not fit stay as they are.
    """
    met = with_reference(reads, contigs, around=F.length("seq") + 16)
    done = _mapped(met, _NEEDS, T.StructType([T.StructField(f"_{t}", T.StringType()) for t in (BASE_TAG, INS_TAG, DEL_TAG)]), _qualities(extended))
    asked = {BASE_TAG: bases, INS_TAG: indels, DEL_TAG: indels}
    for tag, wanted in asked.items():
        if not wanted:
            done = done.withColumn(f"_{tag}", F.lit(None).cast("string"))
        elif not redo:
            done = done.withColumn(f"_{tag}", F.when(F.coalesce(F.map_contains_key("tags", F.lit(tag)), F.lit(False)), F.lit(None)).otherwise(F.col(f"_{tag}")))
    return _set_tags(done, **{t: f"_{t}" for t in asked})


#: Bases on either side that a read may move over.
AROUND = 10
#: Fixed value: a quality that means unknown.
UNKNOWN = 2
STALE = ("NM", "MC", "MD", "AS")


def _cigar(ops: list[tuple[int, str]]) -> str:
    return "".join(f"{n}{op}" for n, op in ops)


def _runs(path: str) -> list[tuple[int, str]]:
    cuts = [0, *(i for i in range(1, len(path)) if path[i] != path[i - 1]), len(path)]
    return [(b - a, path[a]) for a, b in zip(cuts, cuts[1:], strict=False)]


def _clipped(ops: list[tuple[int, str]]) -> list[tuple[int, str]]:
    """Insertions at either end as soft clips."""
    return [(n, "S" if op == "I" and i in (0, len(ops) - 1) else op) for i, (n, op) in enumerate(ops)]


def _realigned(default: int | None, reclip: bool):
    def one(read: dict) -> tuple[int | None, str | None]:
        ops = [(o["len"], o["op"]) for o in read["ops"] or []]
        if read["flag"] & 4 or not read["ref"] or not {op for _, op in ops} <= set("M=XIDS") or not {op for _, op in ops} & set("ID"):
            return None, None
        inner = [i for op, n, _, q in _blocks(read) if op in "M=XI" for i in range(q, q + n)]
        query, quality = "".join(read["seq"][i].upper() for i in inner), np.array([read["qual"][i] for i in inner], np.int64)
        known = np.sort(quality[quality != UNKNOWN])
        if not len(known):
            return (None, _cigar(_clipped(ops))) if reclip else (None, None)
        middle = default if default is not None else int((known[(len(known) - 1) // 2] + known[len(known) // 2]) / 2)
        wrong = 10 ** (-np.where(quality == UNKNOWN, middle, quality) / 10)
        end = read["pos"] + sum(n for n, op in ops if op in ALONG_REF)
        low = max(0, read["pos"] - AROUND)
        place, path = hmm.likeliest_path(read["ref"][low - read["ref_start"] : end + AROUND - read["ref_start"]], query, wrong)
        made = [*[x for x in ops[:1] if x[1] == "S"], *_runs(path), *[x for x in ops[-1:] if x[1] == "S"]]
        return low + place, _cigar(_clipped(made) if reclip else made)

    return lambda reads: [one(r) for r in reads]


def realign(reads: DataFrame, contigs: DataFrame, keep_tags: bool = False, default_quality: int | None = None, reclip: bool = False) -> DataFrame:
    """reads with pos, cigar and ops by the likeliest path through 10 bases around, gaps to the left.

    Only mapped reads with an insertion or deletion and without hard clips, skips or padding move. A quality of 2 is
    unknown: ``default_quality`` stands for it, or the median of the read's others; a read of nothing else stays.
    Tags that a new alignment belies (NM, MC, MD, AS) go from all reads unless ``keep_tags``. ``reclip`` turns
    insertions at the ends into soft clips.
    """
    met = with_reference(reads, contigs, around=F.lit(AROUND))
    moved = _mapped(met, _NEEDS, T.StructType([T.StructField("_pos", T.LongType()), T.StructField("_cigar", T.StringType())]), _realigned(default_quality, reclip))
    out = moved.withColumns({"pos": F.coalesce("_pos", "pos"), "cigar": F.coalesce("_cigar", "cigar"), "ops": F.when(F.col("_cigar").isNotNull(), cigar_ops("_cigar")).otherwise(F.col("ops"))}).drop("_pos", "_cigar")
    return out if keep_tags else out.withColumn("tags", F.map_filter("tags", lambda k, v: ~k.isin(*STALE)))


#: The quality of an indel as an operation, and the phred of the least positive chance.
INDEL_QUALITY, CERTAIN = 45, 49314
KINDS = ("matches", "mismatches", "insertions", "deletions")


def _operations(read: dict, min_bq: int) -> tuple[list[int], list[int]]:
    """Counts of KINDS and the quality of each counted operation; mismatches and indels at the read's sites are left out."""
    counts, quality, sites = [0, 0, 0, 0], [], set(read.get("sites") or ())
    ref, start = read["ref"], read["ref_start"]
    for op, n, r, q in _blocks(read):
        if op in "MX":
            for i in range(n):
                bq = read["qual"][q + i]
                differs = op == "X" or not 0 <= r + i - start < len(ref) or ref[r + i - start] != read["seq"][q + i].upper()
                if bq >= min_bq and not (differs and r + i in sites):
                    counts[differs] += 1
                    quality.append(bq)
        elif op in "ID" and (r - (op == "I")) not in sites:
            counts[2 + (op == "D")] += 1
            quality.append(INDEL_QUALITY)
    return counts, quality


def _exactly(chances: list[float], most: int) -> float:
    """P(most - 1 errors) over ascending chances; the walk ends where ``most`` or more are likelier than 5 %."""
    eps = np.finfo(float).eps
    state = np.zeros(most + 1)
    state[0] = 1.0
    for n, p in enumerate(chances, 1):
        p = min(max(p, eps), 1 - eps)
        moved = state[:-1] * p
        state[:-1] -= moved
        state[1:] += moved
        if n > most and state[-1] > 0.05:
            break
    return float(state[most - 1])


def _source(min_bq: int, nonmatch: int | None):
    def one(read: dict) -> tuple[int | None, ...]:
        if read["ref"] is None or read["flag"] & 4 or len(read["qual"]) != len(read["seq"]):
            return None, *[None] * len(KINDS)
        counts, quality = _operations(read, min_bq)
        wrong = sum(counts[1:])
        if not quality:
            return 0, *counts
        if wrong <= 1:
            return CERTAIN, *counts
        chances = sorted(10 ** (-(q if nonmatch is None else nonmatch) / 10) for q in quality)
        left = 1 - _exactly(chances, wrong - 1)
        return (CERTAIN if left <= 0 else int(-10 * np.log10(left))), *counts

    return lambda reads: [one(r) for r in reads]


def operation_counts(reads: DataFrame, contigs: DataFrame, min_bq: int = 0, ignore: DataFrame | None = None, nonmatch_quality: int | None = None) -> DataFrame:
    """reads with source_quality, matches, mismatches, insertions and deletions (each indel one operation).

    The source quality is the phred of the chance that the read does not come from here: one less that of exactly its
    operations without a match, two less, among all, by their qualities (45 for an indel; ``nonmatch_quality`` for
    all). With one or none it is certain; a read without operations has 0. ``=`` is not looked into. Mismatches and
    indels at ignore(chrom, pos) do not count. Reads without a reference have nulls.
    """
    met = with_reference(reads, contigs, around=F.lit(0))
    met = with_sites(met, ignore) if ignore is not None else met.withColumn("sites", F.array().cast("array<bigint>"))
    made = T.StructType([T.StructField("source_quality", T.IntegerType()), *[T.StructField(k, T.IntegerType()) for k in KINDS]])
    return _mapped(met, [*_NEEDS, "sites"], made, _source(min_bq, nonmatch_quality))


def source_qualities(reads: DataFrame, contigs: DataFrame, **options) -> DataFrame:
    """reads with the source quality of operation_counts in tag sq."""
    found = operation_counts(reads, contigs, **options).drop(*KINDS)
    return _set_tags(found, **{SOURCE_TAG: "source_quality"})


def operation_histogram(counts: DataFrame) -> DataFrame:
    """chrom, kind, n, share: of a contig's reads the share with n operations of a kind, of operation_counts."""
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("n")) for k in KINDS]))
    each = counts.where(F.col("matches").isNotNull()).select("chrom", kinds.alias("x")).groupBy("chrom", "x.kind", "x.n").agg(F.count("*").alias("reads"))
    whole = each.groupBy("chrom", "kind").agg(F.sum("reads").alias("all"))
    return each.join(whole, ["chrom", "kind"]).select("chrom", "kind", "n", (F.col("reads") / F.col("all")).alias("share"))


def error_profile(obs: DataFrame) -> DataFrame:
    """chrom, place, used, error of obs(chrom, place, nt, ref_nt, bq): by place in the read, the mean chance that a mismatch is none of the base's own errors."""
    miss = F.when(F.col("nt") != F.col("ref_nt"), 1 - F.pow(F.lit(10.0), -F.col("bq") / 10.0)).otherwise(0.0)
    return obs.where("nt < 4 AND ref_nt < 4").groupBy("chrom", "place").agg(F.count("*").alias("used"), F.avg(miss).alias("error"))


def normalised_profile(profile: DataFrame) -> DataFrame:
    """profile with each contig's errors over their median there; a contig whose median is 0 keeps them."""
    middle = profile.groupBy("chrom").agg(F.percentile("error", F.lit(0.5)).alias("middle"))
    met = profile.join(middle, "chrom")
    return met.withColumn("error", F.when(F.col("middle") > 0, F.col("error") / F.col("middle")).otherwise(F.col("error"))).drop("middle")

