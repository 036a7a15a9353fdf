"""Multiple-testing correction without a window over all rows.

Corrections need the rank of each p-value among all of them. Rows are first counted by distinct p-value; only
that table, small where p-values come from integer phreds, is ranked. Ranking is by range partition and partial
counts, so no task sees all distinct values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The names a method may be given by.
METHODS = {"bonf": "bonf", "bonferroni": "bonf", "holm": "holm", "holmbonf": "holm", "holm-bonf": "holm", "holmbonferroni": "holm", "fdr": "fdr"}


def _ranked(df: DataFrame, p: str, family: list[str]) -> DataFrame:
    """(family, p, n, last): rows with each distinct p and how many have it or a smaller one; nulls are no tests."""
    counts = df.where(F.col(p).isNotNull()).groupBy(*family, F.col(p).alias("_p")).agg(F.count("*").alias("_n"))
    # Two levels: values within a bucket of their magnitude, and buckets. Both windows are small.
    bucket = F.when(F.col("_p") <= 0, F.lit(-100_000)).otherwise(F.floor(F.log10("_p") * 64)).cast("int")
    counts = counts.withColumn("_b", bucket)
    within = Window.partitionBy(*family, "_b").orderBy("_p")
    buckets = counts.groupBy(*family, "_b").agg(F.sum("_n").alias("_bn"))
    before = Window.partitionBy(*family).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.withColumn("_before", F.coalesce(F.sum("_bn").over(before), F.lit(0))).drop("_bn")
    ranked = counts.withColumn("_in", F.sum("_n").over(within)).join(buckets, [*family, "_b"])
    return ranked.select(*family, "_p", "_n", (F.col("_before") + F.col("_in")).alias("_last"))


def _with_all(df: DataFrame, family: list[str], ntests: int | None, name: str = "_all") -> DataFrame:
    if ntests is not None:
        return df.withColumn(name, F.lit(ntests).cast("long"))
    if not family:
        return df.crossJoin(F.broadcast(df.agg(F.sum("_n").alias(name))))  # one row
    return df.join(df.groupBy(*family).agg(F.sum("_n").alias(name)), family)


def _attach(df: DataFrame, verdicts: DataFrame, p: str, family: list[str], out: list[str]) -> DataFrame:
    """Rows meet the verdict on their p-value; rows without a p-value keep nulls."""
    keyed = df.withColumn("_p", F.col(p))
    return keyed.join(verdicts.select(*family, "_p", *out), [*family, "_p"], "left").drop("_p").select(*df.columns, *out)


def bonferroni(df: DataFrame, p: str, ntests: int | None = None, family: list[str] | None = None, out: str = "p_adjusted") -> DataFrame:
    """p times the number of tests."""
    family = family or []
    if ntests is not None:
        return df.withColumn(out, F.col(p) * ntests)
    counts = df.groupBy(*family).agg(F.count(p).alias("_all"))
    met = df.crossJoin(F.broadcast(counts)) if not family else df.join(counts, family, "left")
    return met.select(*df.columns, (F.col(p) * F.col("_all")).alias(out))


def sidak(df: DataFrame, p: str, alpha: float = 0.05, ntests: int | None = None, out: str = "p_adjusted") -> DataFrame:
    """p scaled so that alpha stands for 1 - (1 - alpha)^(1 / n)."""
    n = F.lit(ntests) if ntests is not None else F.col("_all")
    met = df if ntests is not None else df.crossJoin(F.broadcast(df.agg(F.count(p).alias("_all"))))
    return met.select(*df.columns, (F.col(p) * alpha / (1 - F.pow(F.lit(1 - alpha), 1 / n))).alias(out))


def holm(df: DataFrame, p: str, ntests: int | None = None, family: list[str] | None = None, out: str = "p_adjusted") -> DataFrame:
    """p times n - (tests with a smaller p); tied p-values share their factor."""
    family = family or []
    ranked = _with_all(_ranked(df, p, family), family, ntests)
    factor = F.col("_all") - (F.col("_last") - F.col("_n"))
    return _attach(df, ranked.withColumn(out, F.col("_p") * factor), p, family, [out])


def fdr(df: DataFrame, p: str, alpha: float = 0.05, ntests: int | None = None, family: list[str] | None = None, out: str = "rejected") -> DataFrame:
    """Benjamini-Hochberg step-up: the largest rank i with p_i < alpha * i / n, and all ranks up to it, are rejected."""
    family = family or []
    ranked = _with_all(_ranked(df, p, family), family, ntests)
    passing = ranked.where(F.col("_p") < F.lit(alpha) * F.col("_last") / F.col("_all")).groupBy(*family).agg(F.max("_p").alias("_cut"))
    met = ranked.join(passing, family, "left") if family else ranked.crossJoin(F.broadcast(passing))
    verdicts = met.withColumn(out, F.coalesce(F.col("_p") <= F.col("_cut"), F.lit(False)))
    return _attach(df, verdicts, p, family, [out]).withColumn(out, F.coalesce(out, F.lit(False)))


def significant(df: DataFrame, p: str, method: str, alpha: float, ntests: int | None = None, family: list[str] | None = None, out: str = "rejected") -> DataFrame:
    """Rows whose p-value is below alpha after the named correction."""
    kind = METHODS[method.lower()]
    if kind == "fdr":
        return fdr(df, p, alpha, ntests, family, out)
    corrected = (bonferroni if kind == "bonf" else holm)(df, p, ntests, family, "_adj")
    return corrected.withColumn(out, F.coalesce(F.col("_adj") < alpha, F.lit(False))).drop("_adj")
