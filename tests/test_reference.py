"""Golden values, algebraic identities and the SQL of every query on the smallest tables."""

import math
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from deepsift.functions import quality as Q
from deepsift.functions import tests as S
from deepsift.operators import indelqual, mtc, order
from deepsift.operators import variants as V
from deepsift.plans import queries as P
from deepsift.sources import text, vcf

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_phred(spark):
    r = one(spark, Q.prob_to_phred(F.lit(0.01)), Q.phred_to_prob(F.lit(20)), Q.prob_to_phred(F.lit(0.5)), Q.prob_to_phred(F.lit(0.0)))
    assert (r[0], round(r[1], 12), r[2], r[3]) == (20, 0.01, 3, Q.MAX_PHRED)


def test_complement(spark):
    r = one(spark, Q.complement(F.lit("UTAGC")), Q.complement_rna(F.lit("UTAGC")), Q.complement(F.lit("acgT")))
    assert tuple(r) == ("AATCG", "AAUCG", "tgcA")


def test_exact_tests(spark):
    r = one(spark, S.binomial_cdf(F.lit(2), F.lit(10), F.lit(0.3)), S.log_factorial(F.lit(1000)), S.fisher_two_sided(F.lit(3), F.lit(1), F.lit(1), F.lit(3)))
    assert math.isclose(r[0], sum(math.comb(10, k) * 0.3**k * 0.7 ** (10 - k) for k in range(3)), rel_tol=1e-12)
    assert math.isclose(r[1], math.lgamma(1001), rel_tol=1e-13)
    assert math.isclose(r[2], 34 / 70, rel_tol=1e-12)
    trials = F.array(*[F.lit(0.001)] * 10)
    r = one(spark, S.tail_from(S.poisson_binomial(trials, F.lit(1)), F.lit(1)), S.poisson_tail(F.lit(2), F.lit(0.5)))
    assert math.isclose(r[0], 1 - 0.999**10, rel_tol=1e-12)
    assert math.isclose(r[1], 1 - math.exp(-0.5) * 1.5, rel_tol=1e-12)


@pytest.mark.parametrize("n, factor", [(None, [4, 4, 2, 1, 5]), (999, [998, 998, 996, 995, 999])])
def test_holm(spark, n, factor):
    p = [0.01, 0.01, 0.03, 0.05, 0.005]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(p)], "i int, p double")
    got = {r.i: r.p_adjusted for r in mtc.holm(df, "p", n).collect()}
    want = [0.04, 0.04, 0.06, 0.05, 0.025] if n is None else [9.98, 9.98, 29.88, 49.75, 4.995]
    assert all(math.isclose(got[i], w) for i, w in enumerate(want))


def test_bonferroni_and_sidak(spark):
    df = spark.createDataFrame([(i, x) for i, x in enumerate([0.01, 0.01, 0.03, 0.05, 0.005])], "i int, p double")
    got = [r.p_adjusted for r in mtc.bonferroni(df, "p").orderBy("i").collect()]
    assert all(math.isclose(a, b) for a, b in zip(got, [0.05, 0.05, 0.15, 0.25, 0.025]))
    got = [r.p_adjusted for r in mtc.sidak(df, "p", 0.05).orderBy("i").collect()]
    assert all(abs(a - b) < 1e-7 for a, b in zip(got, [0.04898974, 0.04898974, 0.14696923, 0.24494871, 0.02449487]))


@pytest.mark.parametrize("p, alpha, n", [([], 0.2, 0), ([1.0], 0.2, 0), ([0.01, 0.032, 0.07, 0.07, 0.116, 0.133, 0.192, 0.331, 0.378, 0.595, 0.679, 0.755], 0.2, None), ([0.0, 1e-200, 0.9], 0.05, 2)])
def test_fdr(spark, p, alpha, n):
    df = spark.createDataFrame([(x,) for x in p], "p double")
    got = mtc.fdr(df, "p", alpha).where("rejected").count()
    rank = max([i for i, x in enumerate(sorted(p), 1) if x < alpha * i / len(p)], default=0)
    assert got == rank and (n is None or got == n)


def _v(spark, rows):
    return spark.createDataFrame(rows, "chrom string, pos long, ref string, alt string, qual int, filter string, dp long, af double, sb int, alt_fw long, alt_rv long")


def test_set_algebra(spark):
    a = _v(spark, [("c", 1, "A", "T", 50, "PASS", 20, 0.1, 0, 1, 1), ("c", 1, "A", "T", 50, "PASS", 20, 0.1, 0, 1, 1), ("c", 2, "A", "AT", None, "low", 20, 0.1, 0, 1, 1)])
    swapped = a.select("chrom", "pos", F.col("alt").alias("ref"), F.col("ref").alias("alt"), "qual", "filter", "dp", "af", "sb", "alt_fw", "alt_rv")
    assert V.complement(a, a).count() == 0 and V.intersect(a, a).count() == 3
    assert V.intersect(a, swapped).count() == 0 and V.intersect(a, swapped, only_pos=True).count() == 3
    assert V.concat(a, a, only="indels").count() == 2
    assert V.filter_variants(a, print_all=True).count() == 3
    strict = V.FilterConfig(min_dp=None, sb_mtc=None, snv_qual=60, indel_qual=60)
    assert V.filter_variants(a.withColumn("filter", F.lit(".")), strict).count() == 1  # a missing quality passes
    assert V.filter_variants(a, strict).count() == 0  # an older tag stays
    assert {r["filter"] for r in V.filter_variants(a.withColumn("filter", F.lit("old;low")), strict, print_all=True).collect()} == {"old;low;min_snvqual_60", "old;low"}


def test_filter_is_monotone(spark):
    rows = [("c", i, "A", "T", 10 + i, "PASS", 20, 0.1, i, 9, 0) for i in range(60)]
    df = _v(spark, rows)
    kept = [V.filter_variants(df, V.FilterConfig(min_dp=None, sb_mtc=None, snv_mtc=m, snv_alpha=0.01)).count() for m in ("bonf", "holm", "fdr")]
    assert kept == sorted(kept)
    assert V.filter_variants(df, V.FilterConfig(min_dp=None, sb_mtc="fdr")).count() < 60


def test_overlap_and_order(spark):
    df = _v(spark, [("c", p, "A", "T", 9, ".", 20, 0.1, 0, 1, 1) for p in (5, 8191, 8192, 20000)])
    regions = spark.createDataFrame([("c", 8190, 8193), ("c", 0, 5)], "chrom string, beg long, end long")
    assert sorted(r.pos for r in V.overlap(df, regions).collect()) == [8191, 8192]
    got = {r.pos: (r.dist_left, r.dist_nearest) for r in order.distances(df).collect()}
    assert got[5] == (-1, 8186) and got[8192] == (1, 1)
    stacked = _v(spark, [("c", 5, "ACG", "A", 10, ".", 20, 0.1, 0, 1, 1), ("c", 7, "G", "T", None, ".", 20, 0.2, 0, 1, 1), ("c", 9, "G", "T", 5, ".", 20, 0.2, 0, 1, 1)])
    assert sorted(r.pos for r in order.stack_pick(stacked).collect()) == [7, 9]


def test_clusters(spark):
    rows = [("g", p, "A", "T", n, 1000) for p, n in ((1, 500), (2, 490), (3, 20), (4, 18))]
    got = order.frequency_clusters(spark.createDataFrame(rows, "g string, pos long, ref string, alt string, alt_n long, dp long"), ["g"])
    assert {r.pos: r.cluster for r in got.collect()} == {1: 1, 2: 1, 3: 2, 4: 2}


def test_files(spark, tmp_path):
    (tmp_path / "a.vcf").write_text("##x\n#CHROM\tPOS\nc1\t5\t.\tA\tT\t48.7\tPASS\tDP=10;AF=0.25;SB=3;DP4=1,2,3,4\nc1\t7\trs\tA\tAT\t.\t.\tINDEL;dp=3\nbroken\n")
    df = vcf.read_vcf(spark, str(tmp_path / "a.vcf"))
    a, b = df.orderBy("pos").collect()
    assert (a.pos, a.qual, a.dp, a.af, a.ref_rv, a.indel) == (4, 48, 10, 0.25, 2, False) and (b.qual, b.indel, b.dp) == (None, True, 3)
    vcf.write_vcf(df, str(tmp_path / "out"))
    again = vcf.read_vcf(spark, str(tmp_path / "out"))
    cols = ["chrom", "pos", "ref", "alt", "qual", "info"]
    assert sorted(map(str, again.select(cols).collect())) == sorted(map(str, df.select(cols).collect()))
    (tmp_path / "r.bed").write_text("# c\ntrack x\nc1\t0\t5\nc1 9\n")
    assert sorted((r.beg, r.end) for r in text.read_regions(spark, str(tmp_path / "r.bed")).collect()) == [(0, 5), (8, 9)]
    (tmp_path / "f.fa").write_text(">c1 words\nacgta\nCGT\n>c2\nTT\n")
    assert {r.chrom: r.seq for r in text.read_fasta(spark, str(tmp_path / "f.fa")).collect()} == {"c1": "ACGTACGT", "c2": "TT"}


def test_allele_frequencies_of_reads(spark, tmp_path):
    (tmp_path / "f.fa").write_text(">c\nACGTACGT\n")
    (tmp_path / "r.sam").write_text("@HD\n" + "".join("\t".join((q, f, "c", "1", "60", c, "*", "0", "0", s, "I" * len(s))) + "\n" for q, f, c, s in (("a", "0", "8M", "ACGTACGT"), ("b", "16", "1M2D5M", "ATACGT"), ("c", "0", "2M2I6M", "ACAAGTACGT"), ("d", "0", "2S4M", "GGACTT"))))
    contigs, reads = text.read_fasta(spark, str(tmp_path / "f.fa")), text.read_sam(spark, str(tmp_path / "r.sam"))
    obs = text.observations(reads, text.contig_bases(contigs))
    assert obs.where("nt <> ref_nt").select("pos", "nt").collect() == [(2, 3)]
    assert Counter(r.pos for r in obs.collect())[0] == 4
    got = {(r.pos, r.kind, r.key, r.fw, r.rv) for r in text.indel_events(reads, contigs).collect()}
    assert got == {(0, "del", "CG", 0, 1), (1, "ins", "AA", 1, 0)}


def _norm(v):
    if v is None or v != v:
        return None
    return round(float(v), 6) if isinstance(v, int | float) and not isinstance(v, bool) else str(v)


@pytest.mark.parametrize("name", sorted(P.QUERIES))
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = P.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({P.SQL[name]})").fetchall()
    assert sorted(str([_norm(v) for v in r]) for r in df.select(cols).collect()) == sorted(str([_norm(v) for v in r]) for r in want)


def test_normal_tail(spark):
    for z in (0.0, 0.5, 1.96, 2.999, 3.0, 5.0, 8.0):
        assert math.isclose(one(spark, S.normal_tail(F.lit(z)))[0], math.erfc(z / math.sqrt(2)) / 2, rel_tol=1e-9)


def test_indel_qualities_of_reads(spark, tmp_path):
    contig = spark.createDataFrame([("c", i, b) for i, b in enumerate("ACCCGTTA")], "chrom string, pos long, base string")
    assert "".join(r.q for r in indelqual.position_qualities(contig).orderBy("pos").collect()) == "MMMMMMM!"
    file = tmp_path / "r.sam"
    file.write_text("".join(f"{n}\t{f}\tc\t{p}\t30\t{c}\t*\t0\t0\t{s}\t*\tBI:Z:old\n" for n, f, p, c, s in (("a", 0, 1, "2S3M1I2M", "TTACCGCG"), ("a", 0, 1, "2S3M1I2M", "TTACCGCG"), ("b", 4, 1, "3M", "ACC"), ("c", 0, 6, "3M", "TTA"))))
    reads = text.read_sam(spark, str(file))
    got = sorted((r.qname, r.tags["BI"], r.tags.get("BD")) for r in indelqual.by_homopolymer(reads, contig).collect())
    assert got == [("a", "!!MMM!MM", "!!MMM!MM"), ("a", "!!MMM!MM", "!!MMM!MM"), ("b", "old", None), ("c", "MM!", "MM!")]
    assert {r.tags["BD"] for r in indelqual.uniform(reads, 20, 30).where("qname = 'c'").collect()} == {"???"}
