"""Do alternative bases have lower qualities than reference bases? Rank sums of value counts, never of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.quality import prob_to_phred
from ..functions.tests import combine_two, normal_tail
from .mtc import METHODS, significant

_SITE = ["chrom", "pos", "ref_nt", "alt_nt"]


def rank_sum(variants: DataFrame, obs: DataFrame, prop: str) -> DataFrame:
    """chrom, pos, ref_nt, alt_nt, p: one-sided Mann-Whitney by the normal law, corrected for ties and continuity.

    p is 1 unless both alleles are seen, values differ, and the alternative's mean is the lower one. Observations
    are counted by (position, base, value) before they meet the variants; a quality has under 256 values.
    """
    counted = obs.groupBy("chrom", "pos", "nt", F.col(prop).alias("v")).agg(F.count("*").alias("n"))
    keys = variants.select(*_SITE).distinct()
    met = keys.join(counted, ["chrom", "pos"]).where((F.col("nt") == F.col("ref_nt")) | (F.col("nt") == F.col("alt_nt")))
    by_value = met.groupBy(*_SITE, "v").agg(F.sum(F.when(F.col("nt") == F.col("ref_nt"), F.col("n")).otherwise(0)).alias("r"), F.sum(F.when(F.col("nt") == F.col("alt_nt"), F.col("n")).otherwise(0)).alias("a"))
    below = F.coalesce(F.sum("a").over(Window.partitionBy(*_SITE).orderBy("v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    d = lambda c: F.col(c).cast("double")
    t = d("r") + d("a")
    sums = by_value.withColumn("_u", d("r") * (below + d("a") / 2)).groupBy(*_SITE).agg(
        F.sum("_u").alias("u"), F.sum(d("r")).alias("nr"), F.sum(d("a")).alias("na"), F.sum(t * t * t - t).alias("ties"),
        F.sum(d("r") * F.col("v")).alias("sr"), F.sum(d("a") * F.col("v")).alias("sa"), F.count("*").alias("values"),
    )
    pairs, n = F.col("nr") * F.col("na"), F.col("nr") + F.col("na")
    sd = F.sqrt((1 - F.col("ties") / (n * n * n - n)) * pairs * (n + 1) / 12)
    z = F.abs((F.greatest(F.col("u"), pairs - F.col("u")) - 0.5 - pairs / 2) / sd)
    asked = (F.col("values") > 1) & (F.col("nr") > 0) & (F.col("na") > 0) & (F.col("sa") * F.col("nr") < F.col("sr") * F.col("na"))
    tested = sums.select(*_SITE, F.when(asked, normal_tail(z)).otherwise(1.0).alias("p"))
    return keys.join(tested, _SITE, "left").withColumn("p", F.coalesce("p", F.lit(1.0)))


def bias_test(variants: DataFrame, obs: DataFrame) -> DataFrame:
    """variants with mb_p, bb_p (mapping and base qualities) and cb_p (both combined)."""
    for name, prop in (("mb_p", "mq"), ("bb_p", "bq")):
        variants = variants.join(rank_sum(variants, obs, prop).withColumnRenamed("p", name), _SITE, "left")
    return variants.withColumn("cb_p", F.least(F.lit(1.0), combine_two("mb_p", "bb_p")))


def bias_filter(variants: DataFrame, obs: DataFrame, tag: str = "bb", method: str = "fdr", alpha: float = 0.001, ntests: int | None = None) -> DataFrame:
    """variants with mb, bb and cb (phreds of bias_test) and a tag in ``filter`` for those whose ``tag`` is significant after the correction."""
    if tag not in ("mb", "bb", "cb"):
        raise ValueError(f"no such test: {tag}")
    tested = significant(bias_test(variants, obs), f"{tag}_p", method, alpha, ntests)
    held = F.when(F.col("filter").isNull() | F.col("filter").isin(".", "PASS"), F.array().cast("array<string>")).otherwise(F.split("filter", ";"))
    name = F.when(F.col("rejected"), F.array(F.lit(f"{tag}_{METHODS[method]}"))).otherwise(F.array().cast("array<string>"))
    marked = F.coalesce(F.nullif(F.array_join(F.concat(held, name), ";"), F.lit("")), F.lit("PASS"))
    return tested.withColumns({c: prob_to_phred(f"{c}_p") for c in ("mb", "bb", "cb")} | {"filter": marked}).drop("rejected", "mb_p", "bb_p", "cb_p")
