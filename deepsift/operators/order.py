"""Operators that depend on order along a contig: distances, neighbourhoods, stacks, clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.tests import frequency_interval

#: A window never sees more of a contig than so many positions; what crosses a border goes through a row for each bin.
BIN_BITS = 20


def binned(df: DataFrame) -> DataFrame:
    return df.withColumn("_bin", F.shiftright("pos", BIN_BITS))


def neighbours(df: DataFrame, order: list[str], carry: dict[str, Column]) -> DataFrame:
    """binned df with the ``carry`` values of the row before along its contig, null for the first."""
    edge = df.groupBy("chrom", "_bin").agg(F.max_by(F.struct(*[v.alias(k) for k, v in carry.items()]), F.struct(*order)).alias("_edge"))
    edge = edge.select("chrom", "_bin", F.lag("_edge").over(Window.partitionBy("chrom").orderBy("_bin")).alias("_edge"))  # a row for each bin
    within = Window.partitionBy("chrom", "_bin").orderBy(*order)
    near = df.withColumns({f"_{k}": F.lag(v).over(within) for k, v in carry.items()} | {"_has": F.lag(F.lit(True)).over(within)}).join(edge, ["chrom", "_bin"])
    return near.withColumns({k: F.when(F.col("_has"), F.col(f"_{k}")).otherwise(F.col(f"_edge.{k}")) for k in carry}).drop("_has", "_edge", *[f"_{k}" for k in carry])


def running(df: DataFrame, order: list[str], flag: str, name: str) -> DataFrame:
    """binned df with the sum of ``flag`` up to each row along its contig."""
    before = Window.partitionBy("chrom").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    start = df.groupBy("chrom", "_bin").agg(F.sum(flag).alias("_n")).select("chrom", "_bin", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = F.sum(flag).over(Window.partitionBy("chrom", "_bin").orderBy(*order))
    return df.withColumn("_in", within).join(start, ["chrom", "_bin"]).withColumn(name, F.col("_start") + F.col("_in")).drop("_start", "_in")


def distances(df: DataFrame) -> DataFrame:
    """dist_left to the variant before (-1: first) and dist_nearest to either neighbour (-1: alone)."""
    df = binned(df)
    bins = Window.partitionBy("chrom").orderBy("_bin")
    edges = df.groupBy("chrom", "_bin").agg(F.min("pos").alias("_lo"), F.max("pos").alias("_hi")).select("chrom", "_bin", F.lag("_hi").over(bins).alias("_before"), F.lead("_lo").over(bins).alias("_after"))
    within = Window.partitionBy("chrom", "_bin").orderBy("pos")  # both sides by one order, also among rows of one position
    sides = df.withColumns({"_left": F.lag("pos").over(within), "_right": F.lead("pos").over(within)}).join(edges, ["chrom", "_bin"])
    left, right = F.col("pos") - F.coalesce("_left", "_before"), F.coalesce("_right", "_after") - F.col("pos")
    return sides.withColumn("dist_left", F.coalesce(left, F.lit(-1))).withColumn("dist_nearest", F.coalesce(F.least(left, right), F.lit(-1))).drop("_left", "_right", "_before", "_after", "_bin")


def crowded(df: DataFrame, within: int) -> DataFrame:
    """crowded: another position with a variant is at most ``within`` away."""
    near = distances(df.select("chrom", "pos").distinct()).select("chrom", "pos", ((F.col("dist_nearest") > 0) & (F.col("dist_nearest") <= within)).alias("crowded"))
    return df.join(near, ["chrom", "pos"])


def stack_pick(df: DataFrame) -> DataFrame:
    """Of overlapping variants the best by quality, then frequency.

    A stack goes on while the next one starts before the last one's end (its longer allele); a missing quality
    is the best one.
    """
    order = ["pos", "ref", "alt"]
    ends = neighbours(binned(df), order, {"_end": F.col("pos") + F.greatest(F.length("ref"), F.length("alt"))})
    stacks = running(ends.withColumn("_new", F.when(F.col("pos") < F.col("_end"), 0).otherwise(1)), order, "_new", "_stack")
    worth = F.coalesce(F.col("qual").cast("double"), F.lit(2147483647.0)) + F.coalesce("af", F.lit(0.0))
    best = Window.partitionBy("chrom", "_stack").orderBy(worth.desc(), *order)
    return stacks.withColumn("_r", F.row_number().over(best)).where("_r = 1").drop("_new", "_stack", "_r", "_end", "_bin")


def frequency_clusters(df: DataFrame, group: list[str]) -> DataFrame:
    """cluster: variants of a group by falling frequency; each joins while its interval reaches the seed's, else seeds anew.

    The walk needs the order, so a group is one array folded inside the JVM; use groups of a size that fits a task.
    """
    low, high = frequency_interval("alt_n", "dp")
    items = F.sort_array(F.collect_list(F.struct((-F.col("alt_n") / F.col("dp")).alias("key"), "pos", "ref", "alt", low.alias("low"), high.alias("high"))))
    start = F.struct(F.lit(0).alias("no"), F.lit(float("inf")).alias("seed"), F.array().cast("array<struct<pos:bigint,ref:string,alt:string,cluster:int>>").alias("out"))

    def step(s, x):
        joins = x["high"] > s["seed"]
        no = F.when(joins, s["no"]).otherwise(s["no"] + 1)
        row = F.struct(x["pos"].cast("long").alias("pos"), x["ref"].alias("ref"), x["alt"].alias("alt"), no.alias("cluster"))
        return F.struct(no.alias("no"), F.when(joins, s["seed"]).otherwise(x["low"]).alias("seed"), F.concat(s["out"], F.array(row)).alias("out"))

    folded = df.groupBy(*group).agg(items.alias("items")).select(*group, F.explode(F.aggregate("items", start, step)["out"]).alias("x"))
    return folded.select(*group, "x.pos", "x.ref", "x.alt", "x.cluster")
