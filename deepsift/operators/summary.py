"""Distribution summaries of variant tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.quality import is_transition, substitution
from .mtc import _ranked

POINTS = {"p1": 0.01, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p99": 0.99}


def distribution(df: DataFrame, values: dict[str, Column]) -> DataFrame:
    """A row per named value: smallest, percentiles with linear interpolation, largest. Nulls don't count.

    One scan counts the different values of all; ranks come from those counts, bucket by bucket.
    """
    named = F.explode(F.array(*[F.struct(F.lit(n).alias("property"), v.cast("double").alias("value")) for n, v in values.items()]))
    ranked = _ranked(df.select(named.alias("x")).select("x.property", "x.value"), "value", ["property"])
    whole = ranked.groupBy("property").agg(F.sum("_n").alias("all"))  # a row for each property
    met = ranked.join(whole, "property")
    at = lambda share: F.lit(share) * (F.col("all") - 1)
    held = lambda rank: F.max(F.when((rank < F.col("_last")) & (rank >= F.col("_last") - F.col("_n")), F.col("_p")))
    ends = [x for k, p in POINTS.items() for x in (held(F.floor(at(p))).alias(f"{k}_lo"), held(F.ceil(at(p))).alias(f"{k}_hi"))]
    found = met.groupBy("property", "all").agg(F.min("_p").alias("min"), F.max("_p").alias("max"), *ends)
    points = {k: F.col(f"{k}_lo") + (F.col(f"{k}_hi") - F.col(f"{k}_lo")) * (at(p) - F.floor(at(p))) for k, p in POINTS.items()}
    return found.select("property", F.round("min", 6).alias("min"), *[F.round(v, 6).alias(k) for k, v in points.items()], F.round("max", 6).alias("max"))


def histogram(df: DataFrame, value: str, bins: int = 10) -> DataFrame:
    """Equal-width bins between the extremes; the last one holds its right end. Empty bins have no row."""
    ends = df.agg(F.min(value).cast("double").alias("lo"), F.max(value).cast("double").alias("hi"))
    met = df.where(F.col(value).isNotNull()).crossJoin(F.broadcast(ends))  # one row
    at = F.when(F.col("hi") == F.col("lo"), 0).otherwise(F.least(F.lit(bins - 1), F.floor((F.col(value) - F.col("lo")) * bins / (F.col("hi") - F.col("lo"))).cast("int")))
    return met.groupBy(at.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def histogram_2d(df: DataFrame, x: str, y: str, bins: int = 20) -> DataFrame:
    ends = df.agg(*[f(c).cast("double").alias(f"{n}_{i}") for i, c in enumerate((x, y)) for n, f in (("lo", F.min), ("hi", F.max))])
    met = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).crossJoin(F.broadcast(ends))  # one row

    def at(c: str, i: int) -> Column:
        lo, hi = F.col(f"lo_{i}"), F.col(f"hi_{i}")
        return F.when(hi == lo, 0).otherwise(F.least(F.lit(bins - 1), F.floor((F.col(c) - lo) * bins / F.nullif(hi - lo, F.lit(0.0))).cast("int")))

    return met.groupBy(at(x, 0).cast("int").alias("x_bin"), at(y, 1).cast("int").alias("y_bin")).agg(F.count("*").alias("n"))


def substitution_spectrum(df: DataFrame) -> DataFrame:
    return df.where("length(ref) = 1 AND length(alt) = 1").groupBy(substitution("ref", "alt").alias("substitution")).agg(F.count("*").alias("n"))


def ts_tv(df: DataFrame) -> DataFrame:
    """Transitions, transversions and their ratio (null without transversions)."""
    snv = df.where("length(ref) = 1 AND length(alt) = 1")
    ts = F.count_if(is_transition("ref", "alt"))
    tv = F.count_if(~is_transition("ref", "alt"))
    return snv.agg(ts.alias("ts"), tv.alias("tv"), F.round(F.try_divide(ts, tv), 6).alias("ts_tv"))


def sample_annotation(variants: DataFrame, obs: DataFrame) -> DataFrame:
    """DP, reference and alternative counts, and quality extremes of each variant's column in one sample; -1 without bases."""
    keys = variants.select("chrom", "pos", "ref", "alt", "alt_nt")
    met = keys.join(obs, ["chrom", "pos"], "left")
    is_ref, is_alt, seen = F.col("nt") == F.col("ref_nt"), F.col("nt") == F.col("alt_nt"), F.col("nt").isNotNull()
    stats = [F.coalesce(f(F.when(is_alt, F.col(q))), F.lit(-1)).cast("int").alias(f"alt_{q}_{n}") for q in ("bq", "mq") for n, f in (("min", F.min), ("max", F.max))]
    return met.groupBy("chrom", "pos", "ref", "alt").agg(F.count_if(seen).alias("dp"), F.count_if(is_ref).alias("ref_n"), F.count_if(is_alt).alias("alt_n"), *stats)


def alt_in_normal(variants: DataFrame, normal: DataFrame) -> DataFrame:
    """present: the normal's column has 2 alternative bases or 3 % of them, with base qualities over 20 in all."""
    keys = variants.select("chrom", "pos", "ref", "alt", "alt_nt")
    met = keys.join(normal, ["chrom", "pos"], "left")
    is_alt = F.col("nt") == F.col("alt_nt")
    n_alt, n_ref, total = F.count_if(is_alt), F.count_if(F.col("nt") == F.col("ref_nt")), F.coalesce(F.sum(F.when(is_alt, F.col("bq"))), F.lit(0))
    share = F.coalesce(F.try_divide(n_alt, n_alt + n_ref), F.lit(0.0))
    return met.groupBy("chrom", "pos", "ref", "alt").agg(n_alt.alias("alt_n"), (((n_alt >= 2) | (share >= 0.03)) & (total > 20)).alias("present"))


def idxstats(reads: DataFrame, contigs: DataFrame) -> DataFrame:
    """Mapped and unmapped reads of each contig; contigs without reads too, and ``*`` for reads without a contig."""
    unmapped = F.col("flag").bitwiseAND(4) != 0
    counts = reads.groupBy(F.coalesce("chrom", F.lit("*")).alias("chrom")).agg(F.count_if(~unmapped).alias("mapped"), F.count_if(unmapped).alias("unmapped"))
    return contigs.select("chrom", "len").join(counts, "chrom", "full").select("chrom", F.coalesce("len", F.lit(0)).cast("long").alias("len"), F.coalesce("mapped", F.lit(0)).alias("mapped"), F.coalesce("unmapped", F.lit(0)).alias("unmapped"))


def check_reference(header: DataFrame, contigs: DataFrame) -> DataFrame:
    """Contigs of header(chrom, len) that the reference lacks or has at another length."""
    ref = contigs.select("chrom", F.col("len").alias("ref_len"))
    return header.join(ref, "chrom", "left").where(F.col("ref_len").isNull() | (F.col("ref_len") != F.col("len"))).select("chrom", "len", "ref_len")


def consensus_variants(df: DataFrame) -> DataFrame:
    """One row: variants, and those that are consensus variants (flag ``consvar``)."""
    return df.agg(F.count("*").alias("variants"), F.count_if(F.coalesce("consvar", F.lit(False))).alias("consensus"))


def haplotypes(contig: str, variants: DataFrame, cluster: str = "cluster") -> DataFrame:
    """A cluster's haplotype: the contig with its variants put in, from right to left so that lengths do not matter."""
    edits = F.reverse(F.array_sort(F.collect_list(F.struct("pos", "ref", "alt"))))
    put = F.aggregate(edits, F.lit(contig), lambda s, x: F.overlay(s, x["alt"], (x["pos"] + 1).cast("int"), F.length(x["ref"])))
    return variants.groupBy(cluster).agg(put.alias("seq"))
