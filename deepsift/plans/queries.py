"""Every registered query with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.quality import base_of, merged_error, phred_to_prob, prob_to_phred
from ..functions.tests import combine_two, frequency_interval, poisson_tail, strand_bias
from ..operators import bias, call, indelqual, mtc, order, pileup, summary
from ..operators import variants as V
from . import views as W

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
CALLS = ("chrom", "pos", "ref", "alt")
SHOWN = (*CALLS, "qual", "dp")


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


def _vs(spark, sf_dir, where="true"):
    return W.variants(W.obs(spark, sf_dir, where))


def _two(spark, sf_dir):
    return _vs(spark, sf_dir, W.FIRST), _vs(spark, sf_dir, W.SECOND)


_STRANDS = ", ".join(f"count(*) FILTER (bq >= 3 AND nt = {i} AND {'is_rev' if s == 'rv' else 'NOT is_rev'}) AS {b}_{s}" for i, b in enumerate("acgt") for s in ("fw", "rv"))


@query(f"WITH {W.obs_sql()} SELECT chrom, pos, ref_nt, count(*) AS coverage, count(*) FILTER (bq >= 3) AS num_bases, {_STRANDS} FROM obs GROUP BY chrom, pos, ref_nt")
def pileup_summary(spark, sf_dir):
    return pileup.summary(W.obs(spark, sf_dir))


_P = lambda q: f"pow(10.0, -{q} / 10.0)"
_PM = f"(CASE WHEN mq = 255 THEN 0.0 WHEN mq = 0 THEN 0.5 ELSE {_P('mq')} END)"
_MERGED = f"({_PM} + (1 - {_PM}) * {_P('baq')} + (1 - {_PM}) * (1 - {_P('baq')}) * {_P('bq')})"


@query(f"WITH {W.obs_sql()} SELECT chrom, count(*) AS n, round(sum({_MERGED}), 6) AS errors, round(max({_MERGED}), 9) AS worst, round(min({_MERGED}), 9) AS best FROM obs GROUP BY chrom")
def merged_errors(spark, sf_dir):
    e = merged_error("bq", "mq", "baq")
    return W.obs(spark, sf_dir).groupBy("chrom").agg(F.count("*").alias("n"), F.round(F.sum(e), 6).alias("errors"), F.round(F.max(e), 9).alias("worst"), F.round(F.min(e), 9).alias("best"))


@query(f"""WITH {W.obs_sql()}, s AS (SELECT chrom, pos, {", ".join(f"sum(CASE WHEN nt = {i} THEN 1 - {_P('bq')} ELSE 0 END) AS w{i}" for i in range(4))} FROM obs GROUP BY chrom, pos)
SELECT chrom, pos, CASE WHEN w0 >= w1 AND w0 >= w2 AND w0 >= w3 THEN 'A' WHEN w1 >= w2 AND w1 >= w3 THEN 'C' WHEN w2 >= w3 THEN 'G' ELSE 'T' END AS cons_base, round(greatest(w0, w1, w2, w3), 6) AS weight FROM s""")
def consensus_base(spark, sf_dir):
    return pileup.consensus(W.obs(spark, sf_dir))


_FISHER = """least(1.0, list_sum(list_transform(
  list_filter(list_transform(range(greatest(0, a + b + a + c - n), least(a + b, a + c) + 1),
    lambda i: lgamma(a+b+1) - lgamma(i+1) - lgamma(a+b-i+1) + lgamma(c+d+1) - lgamma(a+c-i+1) - lgamma(c+d-a-c+i+1) - lgamma(n+1) + lgamma(a+c+1) + lgamma(b+d+1)),
    lambda x: x < 1e-8 + lgamma(a+b+1) - lgamma(a+1) - lgamma(b+1) + lgamma(c+d+1) - lgamma(c+1) - lgamma(d+1) - lgamma(n+1) + lgamma(a+c+1) + lgamma(b+d+1)),
  lambda x: exp(x))))"""
_SB = f"CASE WHEN a + b = 0 AND (c = 0 OR d = 0) THEN 2147483647 ELSE CAST(floor(-10 * log10({_FISHER})) AS INT) END"


@query(f"""{W.ONE}, t AS (SELECT *, ref_fw AS a, ref_rv AS b, alt_fw AS c, alt_rv AS d, ref_fw + ref_rv + alt_fw + alt_rv AS n FROM v) SELECT chrom, pos, ref, alt, {_SB} AS strand_bias FROM t""")
def strand_bias_phred(spark, sf_dir):
    return _vs(spark, sf_dir).select(*CALLS, strand_bias("ref_fw", "ref_rv", "alt_fw", "alt_rv").alias("strand_bias"))


def _calls_sql(factor: str, extra: str = "true") -> str:
    counts = ", ".join(f"count(*) FILTER (nt = {i} AND nt <> ref_nt) AS n{i}, count(*) FILTER (nt = {i} AND NOT is_rev) AS f{i}, count(*) FILTER (nt = {i} AND is_rev) AS r{i}" for i in range(4))
    pick = lambda c, of: "CASE " + of + " " + " ".join(f"WHEN {i} THEN {c}{i}" for i in range(4)) + " END"
    return f"""WITH {W.obs_sql()}, cols AS (
  SELECT chrom, pos, ref_nt, list(e ORDER BY e) AS eps, count(*) AS dp, {counts}
  FROM (SELECT *, {_MERGED} AS e FROM obs WHERE bq >= 6) GROUP BY chrom, pos, ref_nt
), tested AS (SELECT *, greatest(n0, n1, n2, n3) AS kmax FROM cols WHERE greatest(n0, n1, n2, n3) > 0 AND {extra}
), done AS (
  SELECT *, list_reduce(list_concat([list_transform(range(0, kmax + 1), lambda j: CASE WHEN j = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)], list_transform(eps, lambda e: [e])),
    lambda acc, e: list_transform(range(0, kmax + 1), lambda j: CASE WHEN j = kmax THEN acc[j + 1] + acc[j] * e[1] WHEN j = 0 THEN acc[1] * (1 - e[1]) ELSE acc[j + 1] * (1 - e[1]) + acc[j] * e[1] END)) AS chances FROM tested
), alts AS (
  SELECT *, {pick("n", "alt_nt")} AS alt_n, {pick("f", "ref_nt")} AS a, {pick("r", "ref_nt")} AS b, {pick("f", "alt_nt")} AS c, {pick("r", "alt_nt")} AS d FROM done CROSS JOIN (SELECT unnest([0, 1, 2, 3]) AS alt_nt)
), hits AS (SELECT *, a + b + c + d AS n, list_sum(chances[CAST(alt_n AS BIGINT) + 1:]) AS p FROM alts WHERE alt_n > 0)
SELECT chrom, pos, substr('ACGT', 1 + ref_nt, 1) AS ref, substr('ACGT', 1 + alt_nt, 1) AS alt, CAST(floor(-10 * log10(p)) AS INT) AS qual, dp, round(alt_n / dp, 6) AS af, {_SB} AS sb, a AS ref_fw, b AS ref_rv, c AS alt_fw, d AS alt_rv
FROM hits WHERE p * {factor} < 0.01"""


@query(_calls_sql("(SELECT 3 * count(*) FROM tested)"))
def snv_call(spark, sf_dir):
    return call.call_snvs(W.obs(spark, sf_dir)).drop("hqa")


@query(_calls_sql("500"))
def snv_call_fixed_bonf(spark, sf_dir):
    return call.call_snvs(W.obs(spark, sf_dir), call.CallConfig(bonf=500)).drop("hqa")


@query(_calls_sql("500", "dp >= 30"))
def snv_call_min_cov(spark, sf_dir):
    return call.call_snvs(W.obs(spark, sf_dir), call.CallConfig(bonf=500, min_cov=30)).drop("hqa")


_DP = """list_reduce(list_concat([list_transform(range(0, kmax + 1), lambda j: CASE WHEN j = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)], list_transform(eps, lambda e: [e])),
    lambda acc, e: list_transform(range(0, kmax + 1), lambda j: CASE WHEN j = kmax THEN acc[j + 1] + acc[j] * e[1] WHEN j = 0 THEN acc[1] * (1 - e[1]) ELSE acc[j + 1] * (1 - e[1]) + acc[j] * e[1] END))"""
_ERR = lambda q: f"(CASE WHEN {q} IS NULL OR {q} < 0 THEN 0.0 ELSE {_P(q)} END)"


def _raw_calls_sql(bq: str = "bq", used: str = "bq >= 6", sq: str = "0.0", extra: str = "true") -> str:
    """From the rule: raw counts over raw depth for what is shown, filtered ones for the test."""
    counts = ", ".join(
        f"count(*) FILTER (used AND nt = {i} AND nt <> ref_nt) AS n{i}, count(*) FILTER (seen AND nt = {i} AND NOT is_rev) AS f{i}, count(*) FILTER (seen AND nt = {i} AND is_rev) AS r{i}" for i in range(4)
    )
    pick = lambda c, of: "CASE " + of + " " + " ".join(f"WHEN {i} THEN {c}{i}" for i in range(4)) + " END"
    pb = _ERR("q")
    error = f"{_PM} + (1 - {_PM}) * {sq} + (1 - {_PM}) * (1 - {sq}) * {_ERR('baq')} + (1 - {_PM}) * (1 - {sq}) * (1 - {_ERR('baq')}) * {pb}"
    return f"""WITH {W.raw_sql()}, medians AS (
  SELECT chrom, pos, CAST(floor(quantile_cont(bq, 0.5)) AS INT) AS ref_bq FROM raw WHERE nt = ref_nt AND bq >= 3 GROUP BY chrom, pos
), marked AS (
  SELECT * EXCLUDE (ref_bq), coalesce(ref_bq, -1) AS ref_bq, coalesce(nt IS NOT NULL AND bq >= 3, false) AS seen, CASE WHEN nt <> ref_nt THEN {bq} ELSE bq END AS q FROM raw LEFT JOIN medians USING (chrom, pos)
), errors AS (SELECT *, {error} AS e FROM marked
), judged AS (SELECT *, coalesce(seen AND nt < 4 AND {used}, false) AS used FROM errors
), cols AS (
  SELECT chrom, pos, ref_nt, list(e ORDER BY e) FILTER (used) AS eps, count(*) AS dp, count(*) FILTER (seen) AS bases, {counts} FROM judged GROUP BY chrom, pos, ref_nt
), tested AS (SELECT *, greatest(n0, n1, n2, n3) AS kmax FROM cols WHERE ref_nt < 4 AND greatest(n0, n1, n2, n3) > 0 AND bases >= 1 AND 2 * bases >= dp AND {extra}
), done AS (SELECT *, {_DP} AS chances FROM tested
), alts AS (
  SELECT *, {pick("n", "alt_nt")} AS alt_n, {pick("f", "ref_nt")} AS a, {pick("r", "ref_nt")} AS b, {pick("f", "alt_nt")} AS c, {pick("r", "alt_nt")} AS d FROM done CROSS JOIN (SELECT unnest([0, 1, 2, 3]) AS alt_nt)
), hits AS (SELECT *, a + b + c + d AS n, list_sum(chances[CAST(alt_n AS BIGINT) + 1:]) AS p FROM alts WHERE alt_n > 0)
SELECT chrom, pos, substr('ACGT', 1 + ref_nt, 1) AS ref, substr('ACGT', 1 + alt_nt, 1) AS alt, CAST(floor(-10 * log10(least(1.0, p))) AS INT) AS qual, dp, round((c + d) / dp, 6) AS af, {_SB} AS sb,
       a AS ref_fw, b AS ref_rv, c AS alt_fw, d AS alt_rv, alt_n AS hqa
FROM hits WHERE p * (SELECT 3 * count(*) FROM tested) < 0.01"""


@query(_raw_calls_sql())
def snv_call_raw(spark, sf_dir):
    """Low qualities, N, deleted bases: they count for depth and frequency as far as the rule says."""
    return call.call_snvs(W.raw_obs(spark, sf_dir))


@query(_raw_calls_sql("CASE WHEN ref_bq < 0 THEN NULL ELSE ref_bq END", "bq >= 6 AND floor(-10 * log10(e)) >= CASE WHEN nt <> ref_nt THEN 12 ELSE 8 END", _ERR("sq")))
def snv_call_joined(spark, sf_dir):
    """Alternative bases with the median quality of reference bases, source qualities, and thresholds on joined qualities."""
    return call.call_snvs(W.raw_obs(spark, sf_dir), call.CallConfig(def_alt_bq=-1, min_jq=8, min_alt_jq=12, use_sq=True))


def _merged_sql(*parts: str) -> str:
    right, out = "1.0", []
    for x in parts:
        out.append(f"{right} * {x}")
        right += f" * (1 - {x})"
    return " + ".join(out)


_FACE = f"(CASE WHEN mq = 0 THEN 0.5 ELSE {_P('mq')} END)"
_SITES_SQL = f"""{W.raw_sql()}, sites AS (SELECT chrom, pos, ref_nt, count(*) AS cov, count(*) FILTER (is_tail) AS tails FROM raw GROUP BY chrom, pos, ref_nt
), ev AS (SELECT chrom, pos, ref_nt, kind, key, count(*) AS n, count(*) FILTER (NOT is_rev) AS c, count(*) FILTER (is_rev) AS d FROM raw WHERE kind IS NOT NULL AND ref_nt < 4 GROUP BY chrom, pos, ref_nt, kind, key
), tested AS (
  SELECT ev.*, cov, tails, cov - tails AS dp FROM ev JOIN sites USING (chrom, pos, ref_nt)
  WHERE NOT (key IN ('A', 'T') AND ev.n < 0.05 * (cov - tails) AND EXISTS (SELECT 1 FROM ev x WHERE x.chrom = ev.chrom AND x.pos = ev.pos AND x.key = ev.key AND x.kind <> ev.kind AND x.n < 0.05 * (cov - tails))))"""
_INDEL_SQL = f"""WITH {_SITES_SQL}, each AS (
  SELECT t.chrom, t.pos, t.ref_nt, t.kind, t.key, r.is_rev, coalesce(r.kind = t.kind, false) AS of,
         CASE WHEN coalesce(r.kind = t.kind, false) THEN {_merged_sql(_PM, "CASE WHEN r.key = t.key THEN " + _ERR("aq") + " ELSE 0.0 END", "pow(10.0, -CASE WHEN t.kind = 'ins' THEN iq ELSE dq END / 10.0)")}
              ELSE {_merged_sql(_FACE, "pow(10.0, -CASE WHEN t.kind = 'ins' THEN iq ELSE dq END / 10.0)")} END AS e
  FROM tested t JOIN raw r ON r.chrom = t.chrom AND r.pos = t.pos
), cols AS (
  SELECT chrom, pos, ref_nt, kind, key, list(e ORDER BY e) AS eps, count(*) FILTER (NOT of AND NOT is_rev) AS a, count(*) FILTER (NOT of AND is_rev) AS b FROM each GROUP BY chrom, pos, ref_nt, kind, key
), done AS (SELECT *, t.n AS kmax FROM cols JOIN tested t USING (chrom, pos, ref_nt, kind, key)
), hits AS (SELECT * EXCLUDE (n), n AS alt_n, a + b + c + d AS n, {_DP}[CAST(kmax AS BIGINT) + 1] AS p FROM done
), shown AS (SELECT *, substr('ACGT', 1 + ref_nt, 1) AS base FROM hits WHERE p * (SELECT 1 + count(*) FROM tested) < 0.01)
SELECT chrom, pos, CASE WHEN kind = 'ins' THEN base ELSE base || key END AS ref, CASE WHEN kind = 'ins' THEN base || key ELSE base END AS alt, CAST(floor(-10 * log10(least(1.0, p))) AS INT) AS qual, dp,
       round(alt_n / dp, 6) AS af, {_SB} AS sb, a AS ref_fw, b AS ref_rv, c AS alt_fw, d AS alt_rv FROM shown"""


@query(_INDEL_SQL)
def indel_call(spark, sf_dir):
    return call.call_indels(W.raw_obs(spark, sf_dir), call.CallConfig(call_indels=True)).drop("indel")


@query(f"""WITH {W.raw_sql()}, w AS (
  SELECT chrom, pos, kind, key, sum(CASE WHEN kind = 'ins' THEN iq ELSE dq END) AS w FROM raw WHERE kind IS NOT NULL GROUP BY chrom, pos, kind, key
), rest AS (SELECT chrom, pos, sum(iq) FILTER (kind IS NULL OR kind <> 'ins') AS ins, sum(dq) FILTER (kind IS NULL OR kind <> 'del') AS del FROM raw GROUP BY chrom, pos
), best AS (SELECT chrom, pos, kind, max(w) AS w, max_by(key, (w, key)) AS key FROM w GROUP BY chrom, pos, kind
), won AS (SELECT chrom, pos, kind, key FROM best JOIN rest USING (chrom, pos) WHERE w > coalesce(CASE WHEN kind = 'ins' THEN ins ELSE del END, 0))
SELECT chrom, pos, CASE max(kind) WHEN 'ins' THEN '+' ELSE '-' END || max_by(key, kind) AS cons FROM won GROUP BY chrom, pos""")
def indel_consensus(spark, sf_dir):
    return call.indel_consensus(W.raw_obs(spark, sf_dir))


@query(f"""WITH {_SITES_SQL}, cols AS (
  SELECT chrom, pos, ref_nt, count(*) AS dp, count(*) FILTER (nt IS NOT NULL AND bq >= 3) AS bases, count(*) FILTER (nt < 4 AND nt <> ref_nt AND bq >= 6) AS alts FROM raw GROUP BY chrom, pos, ref_nt)
SELECT (SELECT 3 * count(*) FROM cols WHERE ref_nt < 4 AND alts > 0 AND bases >= 1 AND 2 * bases >= dp) AS snv_tests, (SELECT count(*) FROM tested) AS indel_tests""")
def test_counts(spark, sf_dir):
    return call.test_counts(W.raw_obs(spark, sf_dir))


@query(f"""{W.ONE}, t AS (SELECT *, dp * 0.01 AS mean FROM v)
SELECT chrom, pos, alt, round(greatest(0.0, 1 - list_sum(list_transform(range(0, alt_n), lambda i: exp(i * ln(mean) - mean - lgamma(i + 1))))), 9) AS tail FROM t""")
def poisson_prescreen(spark, sf_dir):
    return _vs(spark, sf_dir).select("chrom", "pos", "alt", F.round(poisson_tail("alt_n", F.col("dp") * 0.01), 9).alias("tail"))


_INDEL = "(length(ref) > 1 OR length(alt) > 1)"
# tags are added to those that a row has
_TAGS = lambda *t: "coalesce(nullif(concat_ws(';', CASE WHEN v.filter <> 'PASS' THEN v.filter END, " + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in t) + "), ''), 'PASS')"
_OFF = dict(min_dp=None, sb_mtc=None)


@query(f"{W.ONE} SELECT chrom, pos, ref, alt, {_TAGS(('min_af_0.050000', 'af < 0.05'), ('max_af_0.500000', 'af > 0.5'), ('min_dp_20', 'dp < 20'), ('max_dp_40', 'dp > 40'))} AS filter FROM v")
def filter_af_dp(spark, sf_dir):
    return V.filter_variants(_vs(spark, sf_dir), V.FilterConfig(sb_mtc=None, min_af=0.05, max_af=0.5, min_dp=20, max_dp=40), print_all=True).select(*CALLS, "filter")


@query(f"{W.ONE} SELECT chrom, pos, ref, alt, qual, dp FROM v WHERE filter = 'PASS' AND NOT coalesce((NOT {_INDEL} AND qual < 150) OR ({_INDEL} AND qual < 120), false)")
def filter_quality(spark, sf_dir):
    return V.filter_variants(_vs(spark, sf_dir), V.FilterConfig(**_OFF, snv_qual=150, indel_qual=120)).select(*SHOWN)


@query(f"{W.ONE} SELECT chrom, pos, ref, alt, {_TAGS(('max_sb_30', f'NOT {_INDEL} AND sb > 30 AND greatest(alt_fw, alt_rv) > 0.85 * (alt_fw + alt_rv)'))} AS filter FROM v")
def filter_sb_compound(spark, sf_dir):
    return V.filter_variants(_vs(spark, sf_dir), V.FilterConfig(min_dp=None, sb_mtc=None, max_sb=30), print_all=True).select(*CALLS, "filter")


def _bh(p: str, alpha: float, of: str, n: str = "count(*) OVER ()") -> str:
    return f"(SELECT *, coalesce(rk <= max(CASE WHEN p < {alpha} * rk / n THEN rk END) OVER (), false) AS hit FROM (SELECT *, row_number() OVER (ORDER BY p) AS rk, {n} AS n FROM (SELECT *, {p} AS p FROM {of})))"


@query(f"""{W.ONE}, r AS {_bh("pow(10.0, -sb / 10.0)", 0.001, f"(SELECT * FROM v WHERE NOT {_INDEL})")}
SELECT v.chrom, v.pos, v.ref, v.alt, {_TAGS(('min_dp_10', 'v.dp < 10'), ('sb_fdr', 'coalesce(hit, false) AND greatest(v.alt_fw, v.alt_rv) > 0.85 * (v.alt_fw + v.alt_rv)'))} AS filter
FROM v LEFT JOIN r ON v.chrom = r.chrom AND v.pos = r.pos AND v.ref = r.ref AND v.alt = r.alt""")
def filter_default(spark, sf_dir):
    return V.filter_variants(_vs(spark, sf_dir), print_all=True).select(*CALLS, "filter")


@query(f"""{W.ONE}, r AS {_bh("coalesce(pow(10.0, -qual / 10.0), 0.0)", 1e-9, f"(SELECT * FROM v WHERE NOT {_INDEL})")} SELECT chrom, pos, ref, alt FROM r WHERE hit AND filter = 'PASS'
UNION ALL SELECT chrom, pos, ref, alt FROM v WHERE {_INDEL} AND filter = 'PASS'""")
def filter_snv_fdr(spark, sf_dir):
    return V.filter_variants(_vs(spark, sf_dir), V.FilterConfig(**_OFF, snv_mtc="fdr", snv_alpha=1e-9)).select(*CALLS)


_Q = "(SELECT chrom, pos, alt, pow(10.0, -(qual % 60) / 10.0) AS p FROM v WHERE qual IS NOT NULL)"


def _p(spark, sf_dir):
    return _vs(spark, sf_dir).where("qual IS NOT NULL").select("chrom", "pos", "alt", phred_to_prob(F.col("qual") % 60).alias("p"))


@query(f"{W.ONE} SELECT chrom, pos, alt, round(p * count(*) OVER (), 6) AS p_adjusted FROM {_Q}")
def mtc_bonf(spark, sf_dir):
    return mtc.bonferroni(_p(spark, sf_dir), "p").select("chrom", "pos", "alt", F.round("p_adjusted", 6).alias("p_adjusted"))


@query(f"{W.ONE} SELECT chrom, pos, alt, round(p * (count(*) OVER () - (rank() OVER (ORDER BY p) - 1)), 6) AS p_adjusted FROM {_Q}")
def mtc_holm(spark, sf_dir):
    return mtc.holm(_p(spark, sf_dir), "p").select("chrom", "pos", "alt", F.round("p_adjusted", 6).alias("p_adjusted"))


@query(f"{W.ONE} SELECT chrom, pos, alt, hit AS rejected FROM {_bh('p', 0.05, _Q)}".replace("p AS p", "p"))
def mtc_fdr(spark, sf_dir):
    return mtc.fdr(_p(spark, sf_dir), "p", 0.05).select("chrom", "pos", "alt", "rejected")


@query(f"{W.ONE} SELECT chrom, pos, alt, round(p * 0.05 / (1 - pow(0.95, 1.0 / count(*) OVER ())), 6) AS p_adjusted FROM {_Q}")
def mtc_sidak(spark, sf_dir):
    return mtc.sidak(_p(spark, sf_dir), "p").select("chrom", "pos", "alt", F.round("p_adjusted", 6).alias("p_adjusted"))


_SAME = "b.chrom = a.chrom AND b.pos = a.pos"
_ALLELE = f"{_SAME} AND b.ref = a.ref AND b.alt = a.alt"
_A = "SELECT a.chrom, a.pos, a.ref, a.alt, a.qual, a.dp FROM a"


@query(f"{W.TWO} {_A} WHERE EXISTS (SELECT 1 FROM b WHERE {_ALLELE})")
def set_intersect(spark, sf_dir):
    return V.intersect(*_two(spark, sf_dir)).select(*SHOWN)


@query(f"{W.TWO} {_A} WHERE NOT EXISTS (SELECT 1 FROM b WHERE {_ALLELE})")
def set_complement(spark, sf_dir):
    return V.complement(*_two(spark, sf_dir)).select(*SHOWN)


@query(f"{W.TWO} {_A} WHERE EXISTS (SELECT 1 FROM b WHERE {_SAME})")
def set_intersect_pos_only(spark, sf_dir):
    return V.intersect(*_two(spark, sf_dir), only_pos=True).select(*SHOWN)


@query(f"{W.TWO} {_A} WHERE NOT EXISTS (SELECT 1 FROM b WHERE {_SAME})")
def set_complement_pos_only(spark, sf_dir):
    return V.complement(*_two(spark, sf_dir), only_pos=True).select(*SHOWN)


@query(f"{W.TWO} {_A} WHERE filter = 'PASS' AND NOT EXISTS (SELECT 1 FROM b WHERE filter = 'PASS' AND NOT {_INDEL.replace('ref', 'b.ref').replace('alt', 'b.alt')} AND {_ALLELE}) AND NOT {_INDEL.replace('ref', 'a.ref').replace('alt', 'a.alt')}")
def set_complement_passed_snvs(spark, sf_dir):
    return V.complement(*_two(spark, sf_dir), only_passed=True, only="snvs").select(*SHOWN)


@query(f"{W.TWO} SELECT chrom, pos, ref, alt, qual, dp, 0 AS file_no FROM a UNION ALL SELECT chrom, pos, ref, alt, qual, dp, 1 AS file_no FROM b")
def set_concat(spark, sf_dir):
    return V.concat(*_two(spark, sf_dir)).select(*SHOWN, "file_no")


@query(f"{W.TWO} SELECT count(*) AS n FROM a WHERE EXISTS (SELECT 1 FROM b WHERE {_ALLELE})")
def set_count(spark, sf_dir):
    return V.intersect(*_two(spark, sf_dir)).agg(F.count("*").alias("n"))


@query(f"{W.ONE}, {W.REGIONS_SQL} SELECT chrom, pos, ref, alt, qual, dp FROM v WHERE EXISTS (SELECT 1 FROM regions r WHERE r.chrom = v.chrom AND v.pos >= r.beg AND v.pos < r.end_)")
def bed_overlap(spark, sf_dir):
    return V.overlap(_vs(spark, sf_dir), W.regions(spark, sf_dir)).select(*SHOWN)


@query(f"WITH {W.obs_sql()}, {W.obs_sql('ob', W.SECOND)}, {W.variants_sql('b', 'ob')} SELECT chrom, count(*) AS n FROM obs a WHERE NOT EXISTS (SELECT 1 FROM b WHERE {_SAME}) GROUP BY chrom")
def ign_list(spark, sf_dir):
    listed = _vs(spark, sf_dir, W.SECOND).select("chrom", "pos")
    return W.obs(spark, sf_dir).join(listed, ["chrom", "pos"], "left_anti").groupBy("chrom").agg(F.count("*").alias("n"))


_OTHER = f"""{W.TWO}, looked AS (
  SELECT a.chrom, a.pos, a.ref, a.alt, a.af, s.dp AS n, coalesce(b.alt_n, 0) AS k FROM a LEFT JOIN (SELECT DISTINCT chrom, pos, dp FROM b) s USING (chrom, pos)
  LEFT JOIN b ON {_ALLELE}
)"""
_CDF = "least(1.0, CASE WHEN k >= n OR af <= 0 THEN 1.0 WHEN af >= 1 THEN 0.0 ELSE list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(af) + (n - i) * ln(1 - af)))) END)"
_UQ = f"CASE WHEN n IS NULL THEN 0 WHEN {_CDF} <= 0 THEN 2147483647 ELSE CAST(floor(-10 * log10({_CDF})) AS INT) END"


@query(f"{_OTHER} SELECT chrom, pos, ref, alt, {_UQ} AS uq FROM looked")
def uniq_binom(spark, sf_dir):
    a, b = _two(spark, sf_dir)
    return V.uniqueness(a, b).select(*CALLS, "uq")


@query(f"{_OTHER} SELECT chrom, pos, ref, alt, uq FROM (SELECT *, {_UQ} AS uq FROM looked) WHERE pow(10.0, -uq / 10.0) <= 0.05")
def uniq_fdr_compat(spark, sf_dir):
    a, b = _two(spark, sf_dir)
    return V.unique_by_fdr(V.uniqueness(a, b), 0.05).select(*CALLS, "uq")


@query(f"""{W.TWO} {_A} WHERE NOT {_INDEL.replace('ref', 'a.ref').replace('alt', 'a.alt')} AND NOT EXISTS (SELECT 1 FROM b WHERE {_ALLELE})
UNION ALL {_A} WHERE {_INDEL.replace('ref', 'a.ref').replace('alt', 'a.alt')} AND NOT EXISTS (SELECT 1 FROM b WHERE {_SAME} AND {_INDEL.replace('ref', 'b.ref').replace('alt', 'b.alt')})""")
def somatic_subtract(spark, sf_dir):
    return V.somatic(*_two(spark, sf_dir)).select(*SHOWN)


@query(f"{W.TWO} SELECT a.chrom, a.pos, a.ref, a.alt, a.qual, a.dp FROM b AS a WHERE EXISTS (SELECT 1 FROM a AS b WHERE {_ALLELE})")
def germline(spark, sf_dir):
    tumor, normal = _two(spark, sf_dir)
    return V.germline(normal, tumor).select(*SHOWN)


@query(f"""{W.TWO}, {W.obs_sql('oc', "l_returnflag = 'N'")}, {W.variants_sql('k', 'oc')} {_A} WHERE a.filter = 'PASS' AND NOT EXISTS (SELECT 1 FROM k AS b WHERE {_ALLELE})""")
def minus_known(spark, sf_dir):
    known = _vs(spark, sf_dir, "l_returnflag = 'N'")
    return V.complement(_vs(spark, sf_dir, W.FIRST).where(V.passed()), known).select(*SHOWN)


@query(f"""{W.TWO} SELECT a.chrom, a.pos, a.ref, a.alt, (SELECT max(qual) FROM b WHERE {_ALLELE}) AS in_b, CASE WHEN a.filter = 'PASS' THEN a.qual END AS in_passed FROM a""")
def lost_call_audit(spark, sf_dir):
    a, b = _two(spark, sf_dir)
    return V.audit(a, {"in_b": b, "in_passed": a.where(V.passed())})


_RUNS = f"""WITH {W.CONTIG_SQL}, i AS (SELECT *, row_number() OVER (PARTITION BY chrom ORDER BY pos) - row_number() OVER (PARTITION BY chrom, base ORDER BY pos) AS g FROM contig),
runs AS (SELECT chrom, min(pos) AS start, base, count(*) AS length FROM i GROUP BY chrom, base, g)"""


@query(f"{_RUNS} SELECT chrom, start, base, length FROM runs")
def homopolymer_runs(spark, sf_dir):
    return pileup.homopolymer_runs(W.contig(spark, sf_dir))


@query(f"{_RUNS} SELECT c.chrom, c.pos, r.length AS hrun FROM contig c JOIN runs r ON r.chrom = c.chrom AND c.pos + 1 >= r.start AND c.pos + 1 < r.start + r.length")
def hrun(spark, sf_dir):
    return pileup.run_length_right(W.contig(spark, sf_dir))


_SITES = "(SELECT DISTINCT chrom, pos FROM v)"


@query(f"{W.ONE} SELECT chrom, pos, coalesce(pos - lag(pos) OVER w, -1) AS dist_left, coalesce(least(pos - lag(pos) OVER w, lead(pos) OVER w - pos), -1) AS dist_nearest FROM {_SITES} WINDOW w AS (PARTITION BY chrom ORDER BY pos)")
def neighbour_distance(spark, sf_dir):
    return order.distances(_vs(spark, sf_dir).select("chrom", "pos").distinct())


@query(f"{W.ONE} SELECT chrom, pos, ref, alt, EXISTS (SELECT 1 FROM v AS w WHERE w.chrom = v.chrom AND w.pos <> v.pos AND abs(w.pos - v.pos) <= 2) AS crowded FROM v")
def window_filter(spark, sf_dir):
    return order.crowded(_vs(spark, sf_dir), 2).select(*CALLS, "crowded")


@query(f"""{W.ONE}, s AS (SELECT *, greatest(length(ref), length(alt)) AS span FROM v),
f AS (SELECT *, CASE WHEN pos < lag(pos + span) OVER w THEN 0 ELSE 1 END AS fresh FROM s WINDOW w AS (PARTITION BY chrom ORDER BY pos, ref, alt)),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY chrom ORDER BY pos, ref, alt) AS stack FROM f),
r AS (SELECT *, row_number() OVER (PARTITION BY chrom, stack ORDER BY coalesce(qual, 2147483647) + af DESC, pos, ref, alt) AS rn FROM g)
SELECT chrom, pos, ref, alt FROM r WHERE rn = 1""")
def overlap_stack_pick(spark, sf_dir):
    return order.stack_pick(_vs(spark, sf_dir)).select(*CALLS)


@query(f"""{W.ONE} SELECT chrom, pos, alt, round(greatest(0.0, p - 6 * sqrt(p * (1 - p) / n)), 6) AS low, round(p + 6 * sqrt(p * (1 - p) / n), 6) AS high FROM (SELECT *, dp + 4.0::DOUBLE AS n, (alt_n + 2) / (dp + 4.0::DOUBLE) AS p FROM v)""")
def frequency_intervals(spark, sf_dir):
    low, high = frequency_interval("alt_n", "dp")
    return _vs(spark, sf_dir).select("chrom", "pos", "alt", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


_DIST = lambda n, x: f"SELECT '{n}' AS property, round(min({x})::DOUBLE, 6) AS min, " + ", ".join(f"round(quantile_cont({x}::DOUBLE, {q}), 6) AS {k}" for k, q in summary.POINTS.items()) + f", round(max({x})::DOUBLE, 6) AS max FROM v"


@query(f"{W.ONE} {_DIST('AF', 'af')} UNION ALL {_DIST('DP', 'dp')} UNION ALL {_DIST('QUAL', 'qual')}")
def dist_summary(spark, sf_dir):
    return summary.distribution(_vs(spark, sf_dir), {"AF": F.col("af"), "DP": F.col("dp"), "QUAL": F.col("qual")})


@query(f"{W.ONE}, e AS (SELECT min(dp)::DOUBLE AS lo, max(dp)::DOUBLE AS hi FROM v) SELECT CAST(least(9, floor((dp - lo) * 10 / (hi - lo))) AS INT) AS bin, count(*) AS n FROM v, e GROUP BY 1")
def depth_histogram(spark, sf_dir):
    return summary.histogram(_vs(spark, sf_dir), "dp")


@query(f"""{W.ONE}, e AS (SELECT min(dp)::DOUBLE AS xl, max(dp)::DOUBLE AS xh, min(sb)::DOUBLE AS yl, max(sb)::DOUBLE AS yh FROM v)
SELECT CAST(least(19, floor((dp - xl) * 20 / (xh - xl))) AS INT) AS x_bin, CAST(least(19, floor((sb - yl) * 20 / (yh - yl))) AS INT) AS y_bin, count(*) AS n FROM v, e GROUP BY 1, 2""")
def depth_bias_histogram(spark, sf_dir):
    return summary.histogram_2d(_vs(spark, sf_dir), "dp", "sb")


_ONE_WAY, _OTHER_WAY = "ref || '>' || alt", "translate(ref, 'ACGT', 'TGCA') || '>' || translate(alt, 'ACGT', 'TGCA')"


@query(f"{W.ONE} SELECT least({_ONE_WAY}, {_OTHER_WAY}) || '|' || greatest({_ONE_WAY}, {_OTHER_WAY}) AS substitution, count(*) AS n FROM v WHERE NOT {_INDEL} GROUP BY 1")
def subst_spectrum(spark, sf_dir):
    return summary.substitution_spectrum(_vs(spark, sf_dir))


@query(f"{W.ONE} SELECT ts, tv, round(ts / tv, 6) AS ts_tv FROM (SELECT count(*) FILTER (ref || alt IN ('AG', 'GA', 'CT', 'TC')) AS ts, count(*) FILTER (ref || alt NOT IN ('AG', 'GA', 'CT', 'TC')) AS tv FROM v WHERE NOT {_INDEL})")
def ts_tv(spark, sf_dir):
    return summary.ts_tv(_vs(spark, sf_dir))


_LOOK = f"{W.TWO}, t AS (SELECT a.chrom, a.pos, a.ref, a.alt, a.alt_nt, o.nt, o.ref_nt, o.bq, o.mq FROM a LEFT JOIN ob o ON o.chrom = a.chrom AND o.pos = a.pos)"


@query(f"""{_LOOK} SELECT chrom, pos, ref, alt, count(nt) AS dp, count(*) FILTER (nt = ref_nt) AS ref_n, count(*) FILTER (nt = alt_nt) AS alt_n,
{", ".join(f"CAST(coalesce({f}({q}) FILTER (nt = alt_nt), -1) AS INT) AS alt_{q}_{f}" for q in ("bq", "mq") for f in ("min", "max"))} FROM t GROUP BY chrom, pos, ref, alt""")
def sample_annotation(spark, sf_dir):
    return summary.sample_annotation(_vs(spark, sf_dir, W.FIRST), W.obs(spark, sf_dir, W.SECOND))


@query(f"""{_LOOK} SELECT chrom, pos, ref, alt, count(*) FILTER (nt = alt_nt) AS alt_n,
(count(*) FILTER (nt = alt_nt) >= 2 OR coalesce(count(*) FILTER (nt = alt_nt) / nullif(count(*) FILTER (nt = alt_nt OR nt = ref_nt), 0), 0) >= 0.03) AND coalesce(sum(bq) FILTER (nt = alt_nt), 0) > 20 AS present FROM t GROUP BY chrom, pos, ref, alt""")
def alt_in_normal(spark, sf_dir):
    return summary.alt_in_normal(_vs(spark, sf_dir, W.FIRST), W.obs(spark, sf_dir, W.SECOND))


_READS = "reads AS (SELECT CASE WHEN l_suppkey % 50 <> 0 THEN 'chr' || CAST(1 + l_partkey % 4 AS VARCHAR) END AS chrom, CASE WHEN l_linenumber = 7 OR l_suppkey % 50 = 0 THEN 4 ELSE 0 END AS flag FROM lineitem)"


@query(f"""WITH {_READS}, {W.CONTIG_SQL}, c AS (SELECT chrom, count(*) AS len FROM contig GROUP BY chrom UNION ALL SELECT 'chr9', 100)
SELECT coalesce(c.chrom, r.chrom) AS chrom, coalesce(len, 0) AS len, coalesce(mapped, 0) AS mapped, coalesce(unmapped, 0) AS unmapped
FROM c FULL JOIN (SELECT coalesce(chrom, '*') AS chrom, count(*) FILTER (flag = 0) AS mapped, count(*) FILTER (flag = 4) AS unmapped FROM reads GROUP BY 1) r ON c.chrom = r.chrom""")
def idxstats(spark, sf_dir):
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    reads = lines.selectExpr("CASE WHEN l_suppkey % 50 <> 0 THEN concat('chr', CAST(1 + l_partkey % 4 AS STRING)) END AS chrom", "CASE WHEN l_linenumber = 7 OR l_suppkey % 50 = 0 THEN 4 ELSE 0 END AS flag")
    contigs = W.contig(spark, sf_dir).groupBy("chrom").agg(F.count("*").alias("len")).unionByName(spark.range(1).selectExpr("'chr9' AS chrom", "100L AS len"))
    return summary.idxstats(reads, contigs)


@query(f"""WITH {W.CONTIG_SQL}, c AS (SELECT chrom, count(*) AS len FROM contig GROUP BY chrom), h AS (SELECT chrom, len + CASE WHEN chrom = 'chr2' THEN 1 ELSE 0 END AS len FROM c UNION ALL SELECT 'chrX', 5)
SELECT h.chrom, h.len, c.len AS ref_len FROM h LEFT JOIN c USING (chrom) WHERE c.len IS NULL OR c.len <> h.len""")
def checkref(spark, sf_dir):
    contigs = W.contig(spark, sf_dir).groupBy("chrom").agg(F.count("*").alias("len"))
    header = contigs.select("chrom", (F.col("len") + F.when(F.col("chrom") == "chr2", 1).otherwise(0)).alias("len")).unionByName(spark.range(1).selectExpr("'chrX' AS chrom", "5L AS len"))
    return summary.check_reference(header, contigs)


@query(f"WITH {W.obs_sql()}, r AS (SELECT *, row_number() OVER (PARTITION BY chrom, pos ORDER BY bq DESC, mq DESC, baq DESC, nt, is_rev) AS rn FROM obs) SELECT chrom, pos, count(*) AS n, CAST(sum(bq) AS BIGINT) AS bq_sum, count(*) FILTER (nt = ref_nt) AS ref_n FROM r WHERE rn <= 20 GROUP BY chrom, pos")
def depth_cap(spark, sf_dir):
    capped = pileup.depth_cap(W.obs(spark, sf_dir).withColumn("_b", -F.col("bq")).withColumn("_m", -F.col("mq")).withColumn("_a", -F.col("baq")), 20, ["_b", "_m", "_a", "nt", "is_rev"])
    return capped.groupBy("chrom", "pos").agg(F.count("*").alias("n"), F.sum("bq").cast("long").alias("bq_sum"), F.count_if(F.col("nt") == F.col("ref_nt")).alias("ref_n"))


@query(f"{W.ONE} SELECT chrom, pos, alt, CAST(floor(-10 * log10(least(1.0, x))) AS INT) AS cb FROM (SELECT chrom, pos, alt, p * q * (1 - ln(p) - ln(q)) AS x FROM (SELECT *, {_P('sb')} AS p, {_P('(dp % 30)')} AS q FROM v))")
def combined_bias(spark, sf_dir):
    return _vs(spark, sf_dir).select("chrom", "pos", "alt", prob_to_phred(combine_two(phred_to_prob("sb"), phred_to_prob(F.col("dp") % 30))).alias("cb"))


@query(f"""{_RUNS} SELECT c.chrom, c.pos, CASE WHEN c.pos = max(c.pos) OVER (PARTITION BY c.chrom) OR r.length > 18 THEN '!' ELSE substr('{indelqual.BY_RUN}', 1 + coalesce(r.length, 1), 1) END AS q
FROM contig c LEFT JOIN runs r ON r.chrom = c.chrom AND r.start = c.pos + 1""")
def dindel_quality(spark, sf_dir):
    return indelqual.position_qualities(W.contig(spark, sf_dir))


_TAIL = """CASE WHEN z < 3 THEN 0.5 - exp(-z * z / 2) / sqrt(2 * pi()) * CASE WHEN z = 0 THEN 0.0 ELSE list_sum(list_transform(range(0, 61), lambda k: exp((2 * k + 1) * ln(z) + k * ln(2) + lgamma(k + 1) - lgamma(2 * k + 2)))) END
  ELSE exp(-z * z / 2) / sqrt(2 * pi()) / list_reduce(list_concat([z], list_transform(range(60, 0, -1), lambda k: CAST(k AS DOUBLE))), lambda x, k: z + k / x) END"""


def _ranks(name: str, prop: str) -> str:
    return f"""{name}_c AS (SELECT v.chrom, v.pos, v.ref_nt, v.alt_nt, o.{prop} AS x, count(*) FILTER (o.nt = v.ref_nt)::DOUBLE AS r, count(*) FILTER (o.nt = v.alt_nt)::DOUBLE AS a
  FROM v JOIN obs o ON o.chrom = v.chrom AND o.pos = v.pos AND (o.nt = v.ref_nt OR o.nt = v.alt_nt) GROUP BY ALL
), {name}_s AS (SELECT chrom, pos, ref_nt, alt_nt, sum(u) AS u, sum(r) AS nr, sum(a) AS na, sum(pow(r + a, 3) - r - a) AS ties, sum(r * x) / sum(r) AS mr, sum(a * x) / sum(a) AS ma, count(*) AS nv
  FROM (SELECT *, r * (coalesce(sum(a) OVER (PARTITION BY chrom, pos, alt_nt ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + a / 2) AS u FROM {name}_c) GROUP BY ALL
), {name}_z AS (SELECT *, CASE WHEN nv > 1 AND nr > 0 AND na > 0 AND ma < mr THEN abs((greatest(u, nr * na - u) - 0.5 - nr * na / 2) / sqrt((1 - ties / (pow(nr + na, 3) - nr - na)) * nr * na * (nr + na + 1) / 12)) END AS z FROM {name}_s
), {name} AS (SELECT chrom, pos, alt_nt, CASE WHEN z IS NULL THEN 1.0 ELSE {_TAIL} END AS p FROM {name}_z)"""


@query(f"""{W.ONE}, {_ranks("m", "mq")}, {_ranks("b", "bq")} SELECT v.chrom, v.pos, v.ref, v.alt, round(m.p, 6) AS mb_p, round(b.p, 6) AS bb_p, round(least(1.0, m.p * b.p * (1 - ln(m.p) - ln(b.p))), 6) AS cb_p
FROM v JOIN m ON m.chrom = v.chrom AND m.pos = v.pos AND m.alt_nt = v.alt_nt JOIN b ON b.chrom = v.chrom AND b.pos = v.pos AND b.alt_nt = v.alt_nt""")
def bias_test(spark, sf_dir):
    observed = W.obs(spark, sf_dir)
    return bias.bias_test(W.variants(observed), observed).select(*CALLS, *[F.round(c, 6).alias(c) for c in ("mb_p", "bb_p", "cb_p")])


_SHOWN = ", ".join(f"'{b}:' || count(*) FILTER (nt = {i} AND NOT is_rev AND bq >= 3) || '/' || count(*) FILTER (nt = {i} AND is_rev AND bq >= 3)" for i, b in enumerate("ACGT"))


@query(f"WITH {W.raw_sql()} SELECT chrom, pos, concat_ws(chr(9), chrom, pos + 1, substr('ACGTN', 1 + ref_nt, 1), count(*), {_SHOWN}) AS line FROM raw GROUP BY chrom, pos, ref_nt")
def pileup_lines(spark, sf_dir):
    return pileup.printed(W.raw_obs(spark, sf_dir))


@query(f"""WITH {W.raw_sql()} SELECT chrom, pos, count(*) FILTER (is_head) AS heads, count(*) FILTER (is_tail) AS tails, count(*) FILTER (kind = 'ins') AS ins, count(*) FILTER (kind = 'del') AS dels,
       count(*) FILTER (nt IS NULL) AS deleted FROM raw GROUP BY chrom, pos""")
def indel_summary(spark, sf_dir):
    return pileup.indel_summary(W.raw_obs(spark, sf_dir))


@query(f"""WITH {W.raw_sql()}, w AS (
  SELECT chrom, pos, substr('ACGT', 1 + nt, 1) AS what, bq, mq, baq FROM raw WHERE nt < 4 AND bq >= 3
  UNION ALL SELECT chrom, pos, CASE kind WHEN 'ins' THEN '+' ELSE '-' END || key, CASE kind WHEN 'ins' THEN iq ELSE dq END, mq, aq FROM raw WHERE kind IS NOT NULL)
SELECT chrom, pos, what, count(*) AS n, sum(bq) AS bq_sum, min(mq) AS mq_min, max(baq) AS baq_max FROM w GROUP BY chrom, pos, what""")
def quality_lists(spark, sf_dir):
    """Digests of the lists: their lengths, sums and ends."""
    lists = pileup.quality_lists(W.raw_obs(spark, sf_dir).withColumn("bq", F.least(F.col("bq"), F.lit(93))))
    total = F.aggregate("bq", F.lit(0).cast("long"), lambda a, x: a + x)
    return lists.select("chrom", "pos", "what", F.size("bq").cast("long").alias("n"), total.alias("bq_sum"), F.array_min("mq").alias("mq_min"), F.array_max("baq").alias("baq_max"))


@query(f"""WITH {W.raw_sql()}, {W.obs_sql()}, {W.variants_sql()}, depths AS (SELECT chrom, pos, count(*) AS n FROM raw GROUP BY chrom, pos
), looked AS (
  SELECT v.chrom, v.pos, v.ref, v.alt, v.af, d.n, (SELECT count(*) FROM raw r WHERE r.chrom = v.chrom AND r.pos = v.pos AND CASE WHEN length(v.alt) > length(v.ref) THEN r.kind = 'ins' AND r.key = substr(v.alt, 2)
    ELSE r.nt < 4 AND r.bq >= 3 AND substr('ACGT', 1 + r.nt, 1) = v.alt END) AS k FROM v LEFT JOIN depths d ON d.chrom = v.chrom AND d.pos = v.pos)
SELECT chrom, pos, ref, alt, coalesce(n, 0) AS other_dp, k AS other_alt, {_UQ} AS uq FROM looked""")
def uniq_events(spark, sf_dir):
    """Substitutions by bases and insertions by events of the same bases in the other sample."""
    return V.uniqueness_of(_vs(spark, sf_dir), W.raw_obs(spark, sf_dir)).select(*CALLS, "other_dp", "other_alt", "uq")


@query(f"""WITH {W.obs_sql()}, {W.variants_sql()}, nearest AS (SELECT *, lag(pos) OVER (PARTITION BY chrom ORDER BY pos) AS before, lead(pos) OVER (PARTITION BY chrom ORDER BY pos) AS after FROM (SELECT DISTINCT chrom, pos FROM v))
SELECT chrom, count(*) AS sites, count(*) FILTER (coalesce(pos - before <= 2, false) OR coalesce(after - pos <= 2, false)) AS crowded FROM nearest GROUP BY chrom""")
def crowded_sites(spark, sf_dir):
    near = order.crowded(_vs(spark, sf_dir), 2).select("chrom", "pos", "crowded").distinct()
    return near.groupBy("chrom").agg(F.count("*").alias("sites"), F.count_if("crowded").alias("crowded"))
