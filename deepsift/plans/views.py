"""Pileup observations, contigs, regions and variants derived from order and part tables, in Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.quality import base_of
from ..operators.pileup import alt_counts

_NT = "CASE WHEN (l_orderkey*7 + l_suppkey*13 + l_linenumber*31) % 100 < CASE WHEN l_partkey % 17 = 0 THEN 25 ELSE 2 END THEN (p_size + 1 + (l_orderkey + l_linenumber) % 3) % 4 ELSE p_size % 4 END"


def obs(spark: SparkSession, sf_dir: str, where: str = "true") -> DataFrame:
    """One row per base on a reference position."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").where(where)
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_size")
    return lines.join(parts, lines.l_partkey == parts.p_partkey).selectExpr(
        "concat('chr', CAST(1 + l_partkey % 4 AS STRING)) AS chrom", "l_partkey div 4 AS pos", "CAST(p_size % 4 AS INT) AS ref_nt", f"CAST({_NT} AS INT) AS nt",
        "20 + CAST(l_quantity AS INT) % 21 AS bq", "20 + 5 * CAST(round(l_tax * 100) AS INT) AS mq", "20 + 2 * CAST(round(l_discount * 100) AS INT) AS baq", "l_linestatus = 'F' AS is_rev",
    )


_RAW = {
    "chrom": "concat('chr', CAST(1 + l_partkey % 4 AS STRING))", "pos": "l_partkey div 4", "ref_nt": "CAST(CASE WHEN p_partkey % 23 = 0 THEN 4 ELSE p_size % 4 END AS INT)",
    "nt": f"CAST(CASE WHEN (l_orderkey + l_linenumber) % 29 = 0 THEN NULL WHEN (l_orderkey + l_linenumber) % 31 = 0 THEN 4 ELSE {_NT} END AS INT)",
    "bq": "2 * CAST(l_quantity AS INT)", "mq": "CAST(CASE l_orderkey % 13 WHEN 0 THEN 0 WHEN 1 THEN 255 ELSE 20 + 5 * CAST(round(l_tax * 100) AS INT) END AS INT)",
    "baq": "CAST(CASE WHEN l_orderkey % 7 = 0 THEN -1 ELSE 20 + 2 * CAST(round(l_discount * 100) AS INT) END AS INT)", "sq": "CAST(10 + l_suppkey % 30 AS INT)", "is_rev": "l_linestatus = 'F'",
    "kind": "CASE WHEN (l_orderkey * 11 + l_suppkey * 7 + l_linenumber * 17) % 100 < CASE WHEN l_partkey % 57 = 0 THEN 95 WHEN l_partkey % 19 = 0 THEN 22 ELSE 1 END THEN CASE WHEN l_linenumber % 3 = 0 THEN 'ins' ELSE 'del' END END",
    "key": "substr('ACGTTA', CAST(1 + p_size % 4 AS INT), CAST(1 + (l_linenumber + p_size) % 2 AS INT))", "iq": "CAST(20 + l_linenumber * 3 AS INT)", "dq": "CAST(16 + l_linenumber * 4 AS INT)",
    "aq": "CAST(20 + l_suppkey % 20 AS INT)", "is_tail": "l_orderkey % 37 = 0", "is_head": "l_orderkey % 41 = 0",
}


def raw_obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations that call for every threshold: low and too high base qualities, unknown and zero mapping qualities, N, deleted bases, indels, tails."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_size")
    return lines.join(parts, lines.l_partkey == parts.p_partkey).selectExpr(*[f"{e} AS {c}" for c, e in _RAW.items()])


def raw_sql(name: str = "raw") -> str:
    """The same in SQL, base qualities capped, an event's key only with its kind."""
    said = lambda e: e.replace("AS STRING", "AS VARCHAR").replace(" div ", " // ")
    return f"""{name} AS (SELECT * REPLACE (least(bq, 93) AS bq, CASE WHEN kind IS NOT NULL THEN key END AS key)
  FROM (SELECT {", ".join(f"{said(e)} AS {c}" for c, e in _RAW.items())} FROM lineitem JOIN part ON l_partkey = p_partkey))"""


def contig(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = spark.read.parquet(f"{sf_dir}/part.parquet")
    return parts.select(F.expr("concat('chr', CAST(1 + p_partkey % 4 AS STRING))").alias("chrom"), F.expr("p_partkey div 4").alias("pos"), base_of(F.col("p_size") % 4).alias("base"))


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    return s.selectExpr("concat('chr', CAST(1 + s_suppkey % 4 AS STRING)) AS chrom", "s_suppkey * 5 AS beg", "s_suppkey * 5 + 3 AS end")


def variants(observed: DataFrame) -> DataFrame:
    """Alternative alleles with qualities that can be missing, strand bias, filters, and one in eleven an insertion."""
    a = alt_counts(observed)
    return a.select(
        "chrom", "pos", base_of("ref_nt").alias("ref"), F.concat(base_of("alt_nt"), F.when(F.col("pos") % 11 == 0, "T").otherwise("")).alias("alt"), "ref_nt", "alt_nt",
        F.when(F.col("alt_bq") % 7 != 0, 3 * F.col("alt_bq")).cast("int").alias("qual"), F.when(F.col("alt_bq") % 3 == 0, "lowq").otherwise("PASS").alias("filter"),
        "dp", "alt_n", (F.col("alt_n") / F.col("dp")).alias("af"), (15 * F.abs(F.col("alt_fw") - F.col("alt_rv"))).cast("int").alias("sb"), "ref_fw", "ref_rv", "alt_fw", "alt_rv",
    )


def obs_sql(name: str = "obs", where: str = "true") -> str:
    return f"""{name} AS (
  SELECT 'chr' || CAST(1 + l_partkey % 4 AS VARCHAR) AS chrom, l_partkey // 4 AS pos, CAST(p_size % 4 AS INT) AS ref_nt, CAST({_NT} AS INT) AS nt,
         20 + CAST(l_quantity AS INT) % 21 AS bq, 20 + 5 * CAST(round(l_tax * 100) AS INT) AS mq, 20 + 2 * CAST(round(l_discount * 100) AS INT) AS baq, l_linestatus = 'F' AS is_rev
  FROM lineitem JOIN part ON l_partkey = p_partkey WHERE {where})"""


def variants_sql(name: str = "v", of: str = "obs") -> str:
    return f"""{name}_alts AS (
  SELECT chrom, pos, ref_nt, nt AS alt_nt, count(*) AS alt_n, count(*) FILTER (NOT is_rev) AS alt_fw, count(*) FILTER (is_rev) AS alt_rv, CAST(sum(bq) AS BIGINT) AS alt_bq
  FROM {of} WHERE nt <> ref_nt GROUP BY ALL
), {name}_sites AS (
  SELECT chrom, pos, ref_nt, count(*) AS dp, count(*) FILTER (nt = ref_nt AND NOT is_rev) AS ref_fw, count(*) FILTER (nt = ref_nt AND is_rev) AS ref_rv FROM {of} GROUP BY ALL
), {name} AS (
  SELECT chrom, pos, substr('ACGTN', 1 + ref_nt, 1) AS ref, substr('ACGTN', 1 + alt_nt, 1) || CASE WHEN pos % 11 = 0 THEN 'T' ELSE '' END AS alt, ref_nt, alt_nt,
         CASE WHEN alt_bq % 7 <> 0 THEN CAST(3 * alt_bq AS INT) END AS qual, CASE WHEN alt_bq % 3 = 0 THEN 'lowq' ELSE 'PASS' END AS filter,
         dp, alt_n, alt_n / dp AS af, CAST(15 * abs(alt_fw - alt_rv) AS INT) AS sb, ref_fw, ref_rv, alt_fw, alt_rv
  FROM {name}_alts JOIN {name}_sites USING (chrom, pos, ref_nt))"""


CONTIG_SQL = "contig AS (SELECT 'chr' || CAST(1 + p_partkey % 4 AS VARCHAR) AS chrom, p_partkey // 4 AS pos, substr('ACGTN', CAST(1 + p_size % 4 AS INT), 1) AS base FROM part)"
REGIONS_SQL = "regions AS (SELECT 'chr' || CAST(1 + s_suppkey % 4 AS VARCHAR) AS chrom, s_suppkey * 5 AS beg, s_suppkey * 5 + 3 AS end_ FROM supplier)"
FIRST, SECOND = "l_returnflag = 'A'", "l_returnflag = 'R'"
ONE = f"WITH {obs_sql()}, {variants_sql()}"
TWO = f"WITH {obs_sql('oa', FIRST)}, {variants_sql('a', 'oa')}, {obs_sql('ob', SECOND)}, {variants_sql('b', 'ob')}"
