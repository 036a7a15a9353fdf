"""Variant tables: filters and their tags, set operations, uniqueness, tumour against normal, audits.

Variants have chrom, pos (0-based), ref, alt, qual (null: missing), filter ('.' or PASS or tags) and typed
columns af, dp, sb, ref_fw, ref_rv, alt_fw, alt_rv as far as they are known.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.quality import MAX_PHRED, is_indel, phred_to_prob, prob_to_phred
from ..functions.tests import binomial_cdf, poisson_binomial, tail_from
from .mtc import significant

KEYS = ("chrom", "pos", "ref", "alt")
POSITION = ("chrom", "pos")
MOSTLY = 0.85


def passed(filter_: Column | str = "filter") -> Column:
    """No filter was applied or all were passed."""
    f = F.col(filter_) if isinstance(filter_, str) else filter_
    return (f == ".") | f.startswith("PASS")


def passed_strictly(filter_: Column | str = "filter") -> Column:
    f = F.col(filter_) if isinstance(filter_, str) else filter_
    return f.isin(".", "PASS")


def mostly_one_strand(fw: Column | str = "alt_fw", rv: Column | str = "alt_rv") -> Column:
    """More than 85 % of the alternative bases are on one strand; unknown counts say no."""
    fw, rv = (F.col(x) if isinstance(x, str) else x for x in (fw, rv))
    return F.coalesce(F.greatest(fw, rv) > MOSTLY * (fw + rv), F.lit(False))


@dataclass(frozen=True)
class FilterConfig:
    """Thresholds and corrections; None is off. The defaults are those of a plain filter run."""

    min_af: float | None = None
    max_af: float | None = None
    min_dp: int | None = 10
    max_dp: int | None = None
    max_sb: int | None = None
    sb_mtc: str | None = "fdr"
    sb_alpha: float = 0.001
    sb_compound: bool = True
    sb_indels: bool = False
    snv_qual: int | None = None
    snv_mtc: str | None = None
    snv_alpha: float = 0.01
    snv_ntests: int | None = None
    indel_qual: int | None = None
    indel_mtc: str | None = None
    indel_alpha: float = 0.01
    indel_ntests: int | None = None
    only: str | None = None  # "snvs" or "indels"

    def __post_init__(self):
        for a, b in ((self.snv_qual, self.snv_mtc), (self.indel_qual, self.indel_mtc), (self.max_sb, self.sb_mtc)):
            if a is not None and b is not None:
                raise ValueError("a threshold and a correction for the same quality exclude each other")


def _tested(df: DataFrame, p: Column, where: Column, method: str, alpha: float, ntests: int | None, out: str) -> DataFrame:
    """out: true for rows of ``where`` that are significant among them; missing qualities are the most significant."""
    marked = df.withColumn("_q", F.when(where, p))
    return significant(marked, "_q", method, alpha, ntests, out=out).drop("_q")


def _tagged(held: Column | str, found: Column) -> Column:
    held = F.col(held) if isinstance(held, str) else held
    own = F.when(held.isNull() | (held == "PASS") | (held == "") | held.startswith("."), F.array().cast("array<string>")).otherwise(F.split(held, ";"))
    return F.coalesce(F.nullif(F.array_join(F.concat(own, found), ";"), F.lit("")), F.lit("PASS"))


def filter_variants(df: DataFrame, config: FilterConfig = FilterConfig(), print_all: bool = False) -> DataFrame:
    """Rows with their tags added to those that ``filter`` has, PASS where there are none; without print_all only those without tags.

    A filter of '.' or PASS has no tags. A row that lacks a value isn't filtered by it. Corrections rank all rows of a
    type, whatever other tags they have or ``only`` says.
    """
    indel = is_indel("ref", "alt")
    tags: list[tuple[str, Column]] = []
    at = lambda name, cond: tags.append((name, F.coalesce(cond, F.lit(False))))
    if config.min_af is not None:
        at(f"min_af_{config.min_af:f}", F.col("af") < config.min_af)
    if config.max_af is not None:
        at(f"max_af_{config.max_af:f}", F.col("af") > config.max_af)
    if config.min_dp is not None:
        at(f"min_dp_{config.min_dp}", F.col("dp") < config.min_dp)
    if config.max_dp is not None:
        at(f"max_dp_{config.max_dp}", F.col("dp") > config.max_dp)
    if config.snv_qual is not None:
        at(f"min_snvqual_{config.snv_qual}", ~indel & (F.col("qual") < config.snv_qual))
    if config.indel_qual is not None:
        at(f"min_indelqual_{config.indel_qual}", indel & (F.col("qual") < config.indel_qual))
    p_qual = F.when(F.col("qual").isNull(), 0.0).otherwise(phred_to_prob("qual"))
    if config.snv_mtc:
        df = _tested(df, p_qual, ~indel, config.snv_mtc, config.snv_alpha, config.snv_ntests, "_snv")
        at(f"snvqual_{config.snv_mtc}", ~indel & ~F.col("_snv"))
    if config.indel_mtc:
        df = _tested(df, p_qual, indel, config.indel_mtc, config.indel_alpha, config.indel_ntests, "_indel")
        at(f"indelqual_{config.indel_mtc}", indel & ~F.col("_indel"))
    one = mostly_one_strand() if config.sb_compound else F.lit(True)
    of_sb = F.lit(True) if config.sb_indels else ~indel
    if config.max_sb is not None:
        at(f"max_sb_{config.max_sb}", of_sb & one & (F.col("sb") > config.max_sb))
    if config.sb_mtc:
        p_sb = F.when(F.col("sb") == MAX_PHRED, 0.0).otherwise(phred_to_prob("sb"))
        df = _tested(df, p_sb, of_sb & F.col("sb").isNotNull(), config.sb_mtc, config.sb_alpha, None, "_sb")
        at(f"sb_{config.sb_mtc}", of_sb & one & F.col("_sb"))
    found = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in tags]), lambda x: x.isNotNull()) if tags else F.array().cast("array<string>")
    out = df.withColumn("filter", _tagged("filter", found) if "filter" in df.columns else _tagged(F.lit("."), found)).drop("_snv", "_indel", "_sb")
    if config.only:
        out = out.where(indel if config.only == "indels" else ~indel)
    return out if print_all else out.where(passed())


def _side(df: DataFrame, only_passed: bool, only: str | None) -> DataFrame:
    df = df.where(passed()) if only_passed else df
    return df.where(is_indel("ref", "alt") if only == "indels" else ~is_indel("ref", "alt")) if only else df


def intersect(a: DataFrame, b: DataFrame, only_pos: bool = False, only_passed: bool = False, only: str | None = None) -> DataFrame:
    """Rows of a, repeats included, that are in b by allele or position. The shorter side builds, by Spark's choice."""
    keys = list(POSITION if only_pos else KEYS)
    a = a if only_pos else require_single_alleles(a)
    return _side(a, only_passed, only).join(_side(b, only_passed, only).select(*keys), keys, "left_semi")


def complement(a: DataFrame, b: DataFrame, only_pos: bool = False, only_passed: bool = False, only: str | None = None) -> DataFrame:
    """Rows of a, repeats included, that are not in b."""
    keys = list(POSITION if only_pos else KEYS)
    a = a if only_pos else require_single_alleles(a)
    return _side(a, only_passed, only).join(_side(b, only_passed, only).select(*keys), keys, "left_anti")


def concat(*parts: DataFrame, only_passed: bool = False, only: str | None = None) -> DataFrame:
    """All rows of all parts with the part's number in ``file_no``."""
    out = None
    for i, part in enumerate(parts):
        part = _side(part, only_passed, only).withColumn("file_no", F.lit(i))
        out = part if out is None else out.unionByName(part)
    return out


def require_single_alleles(df: DataFrame) -> DataFrame:
    """Fails at the first row with several alternative alleles."""
    return df.withColumn("alt", F.when(F.instr("alt", ",") > 0, F.raise_error(F.lit("several alternative alleles; compare positions only"))).otherwise(F.col("alt")))


def overlap(df: DataFrame, regions: DataFrame, bin_bits: int = 13) -> DataFrame:
    """Rows of (chrom, pos) within some half-open region(chrom, beg, end): an equi-join on bins, then the exact test."""
    width = 1 << bin_bits
    bins = regions.where("end > beg").select("chrom", "beg", "end", F.explode(F.sequence(F.expr(f"beg div {width}"), F.expr(f"(end - 1) div {width}"))).alias("_bin"))
    left, right = df.withColumn("_bin", F.expr(f"pos div {width}")), bins.alias("r")
    within = (F.col("l._bin") == F.col("r._bin")) & (F.col("l.chrom") == F.col("r.chrom")) & (F.col("l.pos") >= F.col("r.beg")) & (F.col("l.pos") < F.col("r.end"))
    return left.alias("l").join(right, within, "left_semi").drop("_bin")


def uniqueness(variants: DataFrame, other: DataFrame, freq: float | None = None) -> DataFrame:
    """UQ: phred of the chance of so few alternative bases in the other sample at the variant's or a fixed frequency.

    other(chrom, pos, alt, dp, alt_n) is that sample's pileup; one join looks all variants up. A variant without
    coverage there has UQ 0.
    """
    depth = other.select(*POSITION, "dp").distinct().withColumnRenamed("dp", "other_dp")
    counts = other.select(*POSITION, "alt", F.col("alt_n").alias("other_alt"))
    met = variants.join(depth, list(POSITION), "left").join(counts, [*POSITION, "alt"], "left").withColumn("other_alt", F.coalesce("other_alt", F.lit(0)))
    p = binomial_cdf("other_alt", F.coalesce("other_dp", F.lit(0)), F.lit(freq) if freq is not None else F.col("af"))
    return met.withColumn("uq", F.when(F.col("other_dp").isNull() | (F.col("other_dp") == 0), 0).otherwise(prob_to_phred(p)))


def uniqueness_of(variants: DataFrame, obs: DataFrame, freq: float | None = None, min_bq: int = 3) -> DataFrame:
    """variants with UQ by the other sample's observations: substitutions by bases, insertions and deletions by events with the same bases.

    A variant's depth there is that of all reads; without any UQ is 0. One aggregation counts what each position
    shows, one join looks all variants up.
    """
    longer, shorter = F.length("alt") > F.length("ref"), F.length("alt") < F.length("ref")
    what = F.when(longer, F.concat(F.lit("+"), F.substr("alt", F.lit(2)))).when(shorter, F.concat(F.lit("-"), F.substr("ref", F.lit(2)))).otherwise(F.col("alt"))
    base = F.when((F.col("nt") < 4) & (F.col("bq") >= min_bq), F.substr(F.lit("ACGT"), F.col("nt").cast("int") + 1, F.lit(1)))
    event = F.concat(F.when(F.col("kind") == "ins", "+").otherwise("-"), F.col("key")) if "kind" in obs.columns else F.lit(None).cast("string")
    shown = F.array_distinct(F.filter(F.array(F.lit(""), base, event), lambda x: x.isNotNull()))  # '' counts the read itself
    sites = obs.join(variants.select(*POSITION).distinct(), list(POSITION), "left_semi")
    counts = sites.select(*POSITION, F.explode(shown).alias("_what")).groupBy(*POSITION, "_what").agg(F.count("*").alias("_n"))
    depth = counts.where("_what = ''").select(*POSITION, F.col("_n").alias("other_dp"))
    alts = counts.where("_what <> ''").select(*POSITION, "_what", F.col("_n").alias("other_alt"))
    met = variants.withColumn("_what", what).join(depth, list(POSITION), "left").join(alts, [*POSITION, "_what"], "left").drop("_what")
    met = met.withColumn("other_dp", F.coalesce("other_dp", F.lit(0))).withColumn("other_alt", F.coalesce("other_alt", F.lit(0)))
    p = binomial_cdf("other_alt", "other_dp", F.lit(freq) if freq is not None else F.col("af"))
    return met.withColumn("uq", F.when(F.col("other_dp") == 0, 0).otherwise(prob_to_phred(p)))


def unique_by_mtc(df: DataFrame, method: str = "fdr", alpha: float = 0.001, ntests: int | None = None) -> DataFrame:
    """Variants that are significantly unique by UQ after the named correction over ``ntests``, or all of them."""
    p = F.when(F.col("uq") == MAX_PHRED, 0.0).otherwise(phred_to_prob("uq"))
    return significant(df.withColumn("_chance", p), "_chance", method, alpha, ntests).where("rejected").drop("_chance", "rejected")


def detectable(variants: DataFrame, other_errors: DataFrame, alpha: float = 0.01) -> DataFrame:
    """uniq: the frequency would have been found in the other sample, other_errors(chrom, pos, errors)."""
    met = variants.join(other_errors, list(POSITION), "left")
    count = F.greatest(F.lit(1), F.floor(F.col("af") * F.size("errors")).cast("int"))
    p = tail_from(poisson_binomial("errors", count), count)
    return met.withColumn("uniq", F.coalesce(F.when(F.size("errors") > 0, p < alpha), F.lit(False))).drop("errors")


def unique_by_fdr(df: DataFrame, alpha: float = 0.001, strict: bool = False, ntests: int | None = None) -> DataFrame:
    """Variants that are significantly unique by UQ. As commonly run, the step-up's rejections all have p <= alpha,
    and that plain comparison decides; ``strict`` takes Benjamini-Hochberg's verdict instead."""
    p = F.when(F.col("uq") == MAX_PHRED, 0.0).otherwise(phred_to_prob("uq"))
    if not strict:
        return df.where(p <= alpha)
    return unique_by_mtc(df, "fdr", alpha, ntests)


def somatic(tumor: DataFrame, normal: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Tumour variants that the normal sample lacks (indels: at that position), and the known list too."""
    snvs = complement(tumor.where(~is_indel("ref", "alt")), normal)
    indels = complement(tumor.where(is_indel("ref", "alt")), normal.where(is_indel("ref", "alt")), only_pos=True)
    out = snvs.unionByName(indels)
    return complement(out, known) if known is not None else out


def germline(normal: DataFrame, tumor: DataFrame) -> DataFrame:
    return intersect(normal, tumor)


def audit(truth: DataFrame, stages: dict[str, DataFrame]) -> DataFrame:
    """A row per true variant with a column per stage: its quality there, or null."""
    out = truth.select(*KEYS)
    for name, df in stages.items():
        out = out.join(df.groupBy(*KEYS).agg(F.max("qual").alias(name)), list(KEYS), "left")
    return out
