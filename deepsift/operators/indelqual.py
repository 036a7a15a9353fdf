"""Insertion and deletion qualities of reads: one for all, or by the homopolymer that follows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.text import ALIGNED
from .pileup import homopolymer_runs

#: Fixed value: quality characters by the length of the run that starts at the next base, 0 to 18.
BY_RUN = "!MMMLKEC@=<;:988776"
NONE = BY_RUN[0]
_READ = ["qname", "flag", "chrom", "pos", "cigar", "seq"]
#: Reads with one of these flags stay as they are: unmapped, secondary, failed, duplicate.
LEFT_ALONE = 0x704


def uniform(reads: DataFrame, insertion: int, deletion: int | None = None) -> DataFrame:
    """reads with tags BI and BD of one quality for each base; the deletion's is the insertion's unless given."""
    chars = [chr(33 + q) for q in (insertion, insertion if deletion is None else deletion)]
    return _tagged(reads, *[F.repeat(F.lit(c), F.length("seq")) for c in chars])


def position_qualities(bases: DataFrame) -> DataFrame:
    """chrom, pos, q of contig bases(chrom, pos, base): the quality of the run that starts at the next position.

    A next base within a run counts as a run of one; a run of more than 18, and a contig's last position, have
    quality 0.
    """
    starts = homopolymer_runs(bases).select("chrom", (F.col("start") - 1).alias("pos"), "length")
    ends = bases.groupBy("chrom").agg(F.max("pos").alias("_end"))  # a row for each contig
    met = bases.select("chrom", "pos").join(ends, "chrom").withColumn("_last", F.col("pos") == F.col("_end")).join(starts, ["chrom", "pos"], "left")
    length = F.coalesce("length", F.lit(1)).cast("int")
    q = F.when(F.col("_last") | (length >= len(BY_RUN)), NONE).otherwise(F.substring(F.lit(BY_RUN), length + 1, F.lit(1)))
    return met.select("chrom", "pos", q.alias("q"))


def by_homopolymer(reads: DataFrame, bases: DataFrame) -> DataFrame:
    """reads with tags BI and BD by position_qualities; inserted and soft-clipped bases have quality 0.

    Different reads meet the positions they cover by an equi-join; a read's own bases are all that a group holds.
    Reads with a failing flag or without an alignment keep their tags.
    """
    one = reads.where(F.col("flag").bitwiseAND(LEFT_ALONE) == 0).select(*_READ, "ops").dropDuplicates(_READ)
    blocks = one.select(F.xxhash64(*_READ).alias("_k1"), F.xxhash64(F.lit(1), *_READ).alias("_k2"), "chrom", F.explode(F.expr(ALIGNED)).alias("b"))
    each = blocks.select("_k1", "_k2", "chrom", "b", F.explode(F.expr("sequence(0, b.len - 1)")).alias("i"))
    # a base carries its read's key, not the read
    at = each.select("_k1", "_k2", "chrom", (F.col("b.r") + F.col("i")).alias("_at"), (F.col("b.q") + F.col("i")).alias("_q"))
    found = at.join(position_qualities(bases).select("chrom", F.col("pos").alias("_at"), "q"), ["chrom", "_at"])
    kept = found.groupBy("_k1", "_k2").agg(F.map_from_entries(F.collect_list(F.struct("_q", "q"))).alias("_by"))
    met = reads.withColumns({"_k1": F.xxhash64(*_READ), "_k2": F.xxhash64(F.lit(1), *_READ)}).join(kept, ["_k1", "_k2"], "left")
    whole = F.array_join(F.transform(F.sequence(F.lit(0), F.length("seq") - 1), lambda i: F.coalesce(F.try_element_at("_by", i), F.lit(NONE))), "")
    met = met.withColumn("_chars", F.when(F.col("_by").isNotNull() & (F.col("flag").bitwiseAND(LEFT_ALONE) == 0), whole)).drop("_k1", "_k2", "_by")
    return _tagged(met, F.col("_chars"), F.col("_chars")).drop("_chars")


def _tagged(reads: DataFrame, ins, dele) -> DataFrame:
    """BI and BD set where they are known, any older ones replaced."""
    rest = F.map_filter("tags", lambda k, v: ~k.isin("BI", "BD"))
    return reads.withColumn("tags", F.when(ins.isNull(), F.col("tags")).otherwise(F.map_concat(rest, F.create_map(F.lit("BI"), ins, F.lit("BD"), dele))))


def parse_uniform(text: str) -> tuple[int, int]:
    """(insertion, deletion) quality of "I" or "I,D"."""
    parts = [int(x) for x in text.split(",")]
    if not 1 <= len(parts) <= 2 or min(parts) < 0:
        raise ValueError(f"not a quality or two: {text}")
    return parts[0], parts[-1]
