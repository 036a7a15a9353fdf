"""Pileup columns from observations: a row per base that a read puts on a reference position.

Observations have chrom, pos (0-based), ref_nt, nt (0..3 for A, C, G, T; 4 for N), bq, mq, baq, is_rev. Columns
are grouped by (chrom, pos) with partial aggregation; a column's observations meet in one task, its counts do
not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.quality import MAX_PHRED, phred_to_prob
from .order import binned, neighbours, running

SITE = ["chrom", "pos"]
MIN_PLP_BQ = 3
BASES = "ACGT"


def read_filter(reads: DataFrame, flag: str = "flag") -> DataFrame:
    """Drops unmapped, secondary, failed and duplicate reads; supplementary ones stay."""
    return reads.where(F.col(flag).bitwiseAND(0x704) == 0)


def mapping_filter(reads: DataFrame, min_mq: int = 0, max_mq: int = 255, use_orphans: bool = False) -> DataFrame:
    """Caps mapping qualities, drops low ones and orphans; a read that was capped is not asked for its pair."""
    mq, flag = F.col("mapq"), F.col("flag")
    orphan = (flag.bitwiseAND(1) != 0) & (flag.bitwiseAND(2) == 0)
    keep = F.when(mq > max_mq, F.lit(True)).when(mq < min_mq, F.lit(False)).when(orphan, F.lit(use_orphans)).otherwise(F.lit(True))
    return reads.where(keep).withColumn("mapq", F.least(mq, F.lit(max_mq)))


def depth_cap(obs: DataFrame, most: int, order: list[str]) -> DataFrame:
    """At most ``most`` observations of each column, first by ``order``. Columns within the cap skip the sort."""
    size = F.count("*").over(Window.partitionBy(*SITE))
    first = F.row_number().over(Window.partitionBy(*SITE).orderBy(*order))
    return obs.withColumn("_n", size).withColumn("_r", F.when(F.col("_n") > most, first).otherwise(0)).where(F.col("_r") <= most).drop("_n", "_r")


def summary(obs: DataFrame, min_bq: int = MIN_PLP_BQ) -> DataFrame:
    """Counts of each column: coverage, bases, and bases by nucleotide and strand."""
    seen = F.col("bq") >= min_bq
    counts = []
    for i, b in enumerate(BASES):
        for rev, tag in ((False, "fw"), (True, "rv")):
            counts.append(F.count_if(seen & (F.col("nt") == i) & (F.col("is_rev") == rev)).alias(f"{b.lower()}_{tag}"))
    return obs.groupBy(*SITE, "ref_nt").agg(F.count("*").alias("coverage"), F.count_if(seen).alias("num_bases"), *counts)


def consensus(obs: DataFrame, min_bq: int = MIN_PLP_BQ) -> DataFrame:
    """The nucleotide with the largest expected count of right bases; ties go to the earlier of A, C, G, T."""
    weights = [F.sum(F.when((F.col("nt") == i) & (F.col("bq") >= min_bq), 1 - phred_to_prob("bq")).otherwise(0.0)) for i in range(4)]
    sums = obs.groupBy(*SITE).agg(F.array(*weights).alias("w"))
    top = F.array_max("w")
    return sums.select(*SITE, F.substring(F.lit(BASES), F.array_position("w", top).cast("int"), F.lit(1)).alias("cons_base"), F.round(top, 6).alias("weight"))


def alt_counts(obs: DataFrame) -> DataFrame:
    """A row per column and alternative base with DP4; columns without alternatives have none."""
    whole = obs.groupBy(*SITE, "ref_nt", "nt").agg(F.count("*").alias("n"), F.count_if(~F.col("is_rev")).alias("fw"), F.count_if("is_rev").alias("rv"), F.sum("bq").cast("long").alias("bq_sum"))
    is_ref = F.col("nt") == F.col("ref_nt")
    sites = whole.groupBy(*SITE, "ref_nt").agg(
        F.sum("n").alias("dp"),
        F.coalesce(F.sum(F.when(is_ref, F.col("fw"))), F.lit(0)).alias("ref_fw"),
        F.coalesce(F.sum(F.when(is_ref, F.col("rv"))), F.lit(0)).alias("ref_rv"),
        F.collect_list(F.when(~is_ref, F.struct("nt", "n", "fw", "rv", "bq_sum"))).alias("alts"),
    )
    return sites.select(*SITE, "ref_nt", "dp", "ref_fw", "ref_rv", F.explode("alts").alias("a")).select(
        *SITE, "ref_nt", F.col("a.nt").alias("alt_nt"), "dp", F.col("a.n").alias("alt_n"), "ref_fw", "ref_rv", F.col("a.fw").alias("alt_fw"), F.col("a.rv").alias("alt_rv"), F.col("a.bq_sum").alias("alt_bq")
    )


def homopolymer_runs(contigs: DataFrame) -> DataFrame:
    """Runs of one base along contigs(chrom, pos, base): chrom, start, base, length."""
    last = neighbours(binned(contigs), ["pos"], {"_last": F.col("base")})
    runs = running(last.withColumn("_new", F.when(F.col("_last") == F.col("base"), 0).otherwise(1)), ["pos"], "_new", "_run")
    return runs.groupBy("chrom", "_run").agg(F.min("pos").alias("start"), F.first("base").alias("base"), F.count("*").alias("length")).drop("_run")


def run_length_right(contigs: DataFrame) -> DataFrame:
    """HRUN of each position: the run that holds the next base."""
    runs = homopolymer_runs(contigs).select("chrom", "start", (F.col("start") + F.col("length")).alias("end"), "length")
    at = runs.select("chrom", F.explode(F.sequence(F.col("start"), F.col("end") - 1)).alias("next"), F.col("length").alias("hrun"))
    return at.where("next > 0").select("chrom", (F.col("next") - 1).alias("pos"), "hrun")


def infinite(c: Column) -> Column:
    return c == MAX_PHRED


def indel_summary(obs: DataFrame) -> DataFrame:
    """chrom, pos, heads, tails, ins, dels, deleted: reads that start or end at a column, with an indel after it, or with a gap there."""
    return obs.groupBy(*SITE).agg(
        F.count_if("is_head").alias("heads"), F.count_if("is_tail").alias("tails"), F.count_if(F.col("kind") == "ins").alias("ins"), F.count_if(F.col("kind") == "del").alias("dels"), F.count_if(F.col("nt").isNull()).alias("deleted")
    )


def quality_lists(obs: DataFrame, min_bq: int = MIN_PLP_BQ) -> DataFrame:
    """chrom, pos, what, bq, mq, baq: sorted qualities by base, and of an indel event (what: its sign and bases) its own, mapping and alignment quality."""
    base = obs.where((F.col("nt") < 4) & (F.col("bq") >= min_bq)).select(*SITE, F.substr(F.lit(BASES), F.col("nt").cast("int") + 1, F.lit(1)).alias("what"), "bq", "mq", "baq")
    sign = F.when(F.col("kind") == "ins", "+").otherwise("-")
    event = obs.where(F.col("kind").isNotNull()).select(*SITE, F.concat(sign, "key").alias("what"), F.when(F.col("kind") == "ins", F.col("iq")).otherwise(F.col("dq")).alias("bq"), "mq", F.col("aq").alias("baq"))
    return base.unionByName(event).groupBy(*SITE, "what").agg(*[F.sort_array(F.collect_list(c)).alias(c) for c in ("bq", "mq", "baq")])


def printed(obs: DataFrame) -> DataFrame:
    """A line for each column: contig, position from 1, reference base, depth, then bases with their forward and reverse counts."""
    counts = [F.concat(F.lit(f"{b}:"), F.count_if((F.col("nt") == i) & ~F.col("is_rev") & (F.col("bq") >= MIN_PLP_BQ)).cast("string"), F.lit("/"), F.count_if((F.col("nt") == i) & F.col("is_rev") & (F.col("bq") >= MIN_PLP_BQ)).cast("string")).alias(b) for i, b in enumerate(BASES)]
    sums = obs.groupBy(*SITE, "ref_nt").agg(F.count("*").alias("n"), *counts)
    ref = F.substr(F.lit(BASES + "N"), F.col("ref_nt").cast("int") + 1, F.lit(1))
    return sums.select(*SITE, F.concat_ws("\t", "chrom", (F.col("pos") + 1).cast("string"), ref, F.col("n").cast("string"), *BASES).alias("line"))


def tool_filter(reads: DataFrame, flag: str = "flag") -> DataFrame:
    """Drops unmapped, secondary, failed and duplicate reads, as the tools beside the caller do."""
    return read_filter(reads, flag)


def statistics_filter(reads: DataFrame, min_mq: int = 0, need: int = 0, avoid: int = 0x704 | 0x800) -> DataFrame:
    """Reads for statistics: mapping quality, flags that have to be set, flags that must not (supplementary ones too)."""
    return reads.where((F.col("mapq") >= min_mq) & (F.col("flag").bitwiseAND(need) == need) & (F.col("flag").bitwiseAND(avoid) == 0))


def contigs_with_reads(contigs: DataFrame, reads: DataFrame) -> DataFrame:
    """Contigs that some read is mapped to."""
    return contigs.join(reads.where(F.col("flag").bitwiseAND(4) == 0).select("chrom"), "chrom", "left_semi")
