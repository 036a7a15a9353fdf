"""Formats, filters and small functions that no registered query reaches."""

import math
import struct
import zlib
from decimal import Decimal

import duckdb
import pytest
from pyspark.sql import functions as F

from deepsift.functions import poibin
from deepsift.functions import quality as Q
from deepsift.functions import tests as S
from deepsift.functions.rounded import exp_nearest, log_whole
from deepsift.operators import bias, indelqual, pileup, summary
from deepsift.operators import variants as V
from deepsift.plans import queries
from deepsift.sources import bam, text, vcf


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_logs_and_fisher(spark):
    a, b = math.log(0.3), math.log(0.1)
    got = one(spark, S.log_sum(F.lit(a), F.lit(b)), S.log_diff(F.lit(a), F.lit(b)), S.log_diff(F.lit(a), F.lit(a)))
    assert got[:2] == pytest.approx((math.log(0.4), math.log(0.2))) and got[2] == -math.inf
    left, right = one(spark, *S.fisher_one_sided(F.lit(3), F.lit(1), F.lit(1), F.lit(3)))
    mass = [math.comb(4, k) * math.comb(4, 4 - k) / math.comb(8, 4) for k in range(5)]
    assert (left, right) == pytest.approx((sum(mass[:4]), sum(mass[3:])))


def test_strand_bias_of_chances_that_are_powers_of_ten(spark):
    """Their truncated phred hangs on the last bit; 5 14 / 2 0 is a site of the test tables."""
    tables = [(5, 14, 2, 0), (3, 0, 0, 2), (2, 0, 0, 3), (1, 18, 1, 0), (18, 1, 0, 1), (11, 27, 3, 1), (27, 1, 11, 3), (9, 0, 0, 1), (99, 0, 0, 1), (8999, 1000, 0, 1), (0, 0, 2, 0), (40, 0, 0, 30)]
    tables += [(a, b, c, d) for n in range(10, 3000, 10) for a, b, c, d in ((n // 10 - 1, n - n // 10, 1, 0), (n - n // 10, n // 10 - 1, 0, 1))]
    counts = ", ".join(f"({', '.join(f'{x}::BIGINT' for x in t)})" for t in tables)
    want = duckdb.sql(f"SELECT a, b, c, d, {queries._SB} FROM (SELECT *, a + b + c + d AS n FROM (VALUES {counts}) AS t(a, b, c, d))").fetchall()
    got = spark.createDataFrame(tables, "a long, b long, c long, d long").select("a", "b", "c", "d", S.strand_bias("a", "b", "c", "d"))
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_log_factorial_and_exponential_to_the_bit(spark):
    whole, powers = [0, 1, 6, 7, 8, 255, 256, 257, 300, 1000, 4095, 4096], [0.0, -1e-9, -0.004, -0.5, -1.0, -2.302585092994046, -30.25, -699.5, 12.75]
    got = one(spark, F.array(*[S.log_factorial(F.lit(n)) for n in whole]), F.array(*[log_whole(F.lit(n)) for n in whole[4:]]), F.array(*[exp_nearest(F.lit(x)) for x in powers]))
    exact = [float(sum((Decimal(i).ln() for i in range(2, n + 1)), Decimal(0))) for n in whole]
    assert got[0] == pytest.approx(exact, rel=4e-16) and got[1] == [float(Decimal(n).ln()) for n in whole[4:]]
    assert got[2] == [float(Decimal(x).exp()) for x in powers]


def test_poisson_binomial():
    def brute(p, k):
        dist = [1.0]
        for x in p:
            dist = [u * (1 - x) + v * x for u, v in zip([*dist, 0], [0, *dist], strict=True)]
        return sum(dist[k:])

    p, n = [0.3, 0.01, 0.001, 0.0, 0.5], [3, 40, 200, 5, 1]
    flat = [x for x, m in zip(p, n, strict=True) for _ in range(m)]
    got = poibin.tails(p, n, [1, 4, 9, 30])
    assert [float(x) for x in got] == pytest.approx([brute(flat, k) for k in (1, 4, 9, 30)], rel=1e-9)
    assert list(poibin.tails(p, n, [1], stop=1e-3)) == [1] and list(poibin.tails([1.0], [3], [3, 4])) == [1, 0]
    tiny = poibin.tails([1e-4], [90], [85])[0]  # far below the doubles
    exact = math.log10(math.comb(90, 85)) - 4 * 85
    assert poibin.phred(tiny, 2147483647) == math.floor(-10 * (exact + 5 * math.log10(1 - 1e-4) + math.log10(1 + 1e-5))) == 3323
    assert float(poibin.tails([0.01], [1_000_000], [100])[0]) == 1.0


def test_reads_are_filtered(spark):
    rows = [("ok", 3, 30), ("orphan", 1, 30), ("single", 0, 30), ("dup", 0x400, 30), ("unmapped", 4, 0), ("supp", 0x800 | 3, 30), ("low", 3, 5), ("high", 1, 90)]
    reads = spark.createDataFrame(rows, "qname string, flag int, mapq int")
    names = lambda df: {r.qname for r in df.collect()}
    assert names(pileup.read_filter(reads)) == {"ok", "orphan", "single", "supp", "low", "high"} == names(pileup.tool_filter(reads))
    kept = pileup.mapping_filter(pileup.read_filter(reads), min_mq=10, max_mq=60)
    assert names(kept) == {"ok", "single", "supp", "high"} and {r.mapq for r in kept.where("qname = 'high'").collect()} == {60}
    assert "orphan" in names(pileup.mapping_filter(reads, use_orphans=True))
    assert names(pileup.statistics_filter(reads, min_mq=10, need=2)) == {"ok"}
    contigs = spark.createDataFrame([("a",), ("b",)], "chrom string")
    assert names(pileup.contigs_with_reads(contigs, spark.createDataFrame([("a", 0), ("b", 4)], "chrom string, flag int")).withColumnRenamed("chrom", "qname")) == {"a"}


def test_qualities_and_alleles(spark):
    got = one(spark, Q.illumina13(F.array(F.lit(40), F.lit(10))), Q.sanger_char(F.lit(0.001)), Q.sanger_char(F.lit(0.0)), Q.prob_to_phred_rounded(F.lit(0.0011)), *Q.indel_alleles(F.lit("A"), F.lit("ins"), F.lit("GT")), *Q.indel_alleles(F.lit("A"), F.lit("del"), F.lit("GT")))
    assert got == ([9, 0], "?", "~", 30, "A", "AGT", "AGT", "A")
    assert indelqual.parse_uniform("30") == (30, 30) and indelqual.parse_uniform("30,20") == (30, 20)
    with pytest.raises(ValueError):
        indelqual.parse_uniform("1,2,3")
    ops = text.cigar_ops(F.lit("5S10M2I3D1M"))
    assert one(spark, text.cigar_text(ops), text.cigar_text(text.cigar_ops(F.lit("*")))) == ("5S10M2I3D1M", "*")


def test_several_alleles_are_refused(spark):
    df = spark.createDataFrame([("c", 1, "A", "T,G")], "chrom string, pos long, ref string, alt string")
    with pytest.raises(Exception, match="several alternative alleles"):
        V.intersect(df, df).collect()
    assert V.intersect(df, df, only_pos=True).count() == 1


def test_detection_limit(spark):
    variants = spark.createDataFrame([("c", 1, "A", "T", 0.5), ("c", 2, "A", "T", 0.01), ("c", 3, "A", "T", 0.5)], "chrom string, pos long, ref string, alt string, af double")
    errors = spark.createDataFrame([("c", 1, [0.001] * 50), ("c", 2, [0.05] * 50)], "chrom string, pos long, errors array<double>")
    assert {r.pos: r.uniq for r in V.detectable(variants, errors).collect()} == {1: True, 2: False, 3: False}


def test_homopolymer_pairs(spark):
    events = spark.createDataFrame([("c", 1, "ins", "A", 2), ("c", 1, "del", "A", 1), ("c", 2, "ins", "A", 2), ("c", 3, "ins", "G", 1), ("c", 3, "del", "G", 1)], "chrom string, pos long, kind string, key string, n long")
    depth = spark.createDataFrame([("c", p, 100) for p in (1, 2, 3)], "chrom string, pos long, dp long")
    assert sorted(r.pos for r in text.drop_homopolymer_pairs(events, depth).collect()) == [2, 3, 3]


def test_columns_as_lists_and_lines(spark):
    rows = [("c", 4, 0, 0, 30, 60, -1, False, True, False, None, None, 0, 0, None), ("c", 4, 0, 2, 20, 50, -1, True, False, True, "ins", "GT", 40, 41, 33), ("c", 4, 0, None, None, 60, None, False, False, False, None, None, 0, 0, None), ("c", 4, 0, 0, 2, 60, -1, False, False, False, None, None, 0, 0, None)]
    obs = spark.createDataFrame(rows, "chrom string, pos long, ref_nt int, nt int, bq int, mq int, baq int, is_rev boolean, is_head boolean, is_tail boolean, kind string, key string, iq int, dq int, aq int")
    assert tuple(pileup.indel_summary(obs).first())[2:] == (1, 1, 1, 0, 1)
    got = {r.what: (r.bq, r.mq, r.baq) for r in pileup.quality_lists(obs).collect()}
    assert got == {"A": ([30], [60], [-1]), "G": ([20], [50], [-1]), "+GT": ([40], [50], [33])}
    assert pileup.printed(obs).first().line == "c\t5\tA\t4\tA:1/0\tC:0/0\tG:0/1\tT:0/0"


def test_bias_tags(spark):
    obs = spark.createDataFrame([("c", 1, 0, 60, 30 + i % 8) for i in range(60)] + [("c", 1, 1, 60, 5 + i % 4) for i in range(20)], "chrom string, pos long, nt int, mq int, bq int")
    variants = spark.createDataFrame([("c", 1, 0, 1, "."), ("c", 2, 0, 1, "old")], "chrom string, pos long, ref_nt int, alt_nt int, filter string")
    got = {r.pos: r for r in bias.bias_filter(variants, obs).collect()}
    assert got[1]["filter"] == "bb_fdr" and got[1].bb > 30 and got[1].mb == 0 and got[2]["filter"] == "old"
    with pytest.raises(ValueError):
        bias.bias_filter(variants, obs, tag="xx")


def test_haplotypes(spark):
    df = spark.createDataFrame([(1, 2, "G", "GTT"), (1, 5, "CG", "C"), (2, 0, "A", "C")], "cluster int, pos long, ref string, alt string")
    assert {r.cluster: r.seq for r in summary.haplotypes("ACGTACGT", df).collect()} == {1: "ACGTTTACT", 2: "CCGTACGT"}
    flagged = df.withColumn("consvar", F.col("pos") == 0)
    assert tuple(summary.consensus_variants(flagged).first()) == (3, 1)


def test_vcf_more(spark, tmp_path):
    header = vcf.new_header("me", reference="ref.fa")
    assert "##reference=ref.fa" in header and any("HQA" in x for x in header)
    assert vcf.insert_header(header, "##x")[-2] == "##x" and vcf.header_types(header)["DP"] == ("1", "Integer")
    df = spark.createDataFrame([("c1", 5, "A", "T", 30, "PASS", 20, 0.25, 3, 1, 2, 3, 4, False, 7, 9, True), ("c1", 7, "A", "AT", None, ".", 20, 0.5, 3, 1, 2, 3, 4, True, 7, 9, False)],
                               "chrom string, pos long, ref string, alt string, qual int, filter string, dp int, af double, sb int, ref_fw int, ref_rv int, alt_fw int, alt_rv int, indel boolean, hrun int, hqa int, consvar boolean")
    told = {r.pos: r.info for r in vcf.format_info(df).collect()}
    assert told == {5: "DP=20;AF=0.250000;SB=3;DP4=1,2,3,4;HQA=9;CONSVAR", 7: "DP=20;AF=0.500000;SB=3;DP4=1,2,3,4;INDEL;HRUN=7"}
    vcf.write_vcf(vcf.add_genotypes(vcf.format_info(df), 2), f"{tmp_path}/o", header, compress=True)
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS|already exists"):
        vcf.write_vcf(df, f"{tmp_path}/o")
    assert vcf.read_header(spark, f"{tmp_path}/o") == header
    back = vcf.read_vcf(spark, f"{tmp_path}/o")
    typed = {r.pos: r for r in vcf.typed_info(back, header).collect()}
    assert typed[5].info_DP4 == [1, 2, 3, 4] and typed[5].info_AF == 0.25 and typed[7].info_INDEL and typed[5].info_CONSVAR and typed[7]["samples"] == [".", "."]
    with pytest.raises(Exception, match="another format"):
        vcf.add_genotypes(df.withColumn("format", F.lit("GT:DP")), 1).collect()
    note = spark.createDataFrame([("c1", 5, "A", "T", 9, 5, 4, 10, 20, 30, 40)], "chrom string, pos long, ref string, alt string, dp long, ref_n long, alt_n long, alt_bq_min int, alt_bq_max int, alt_mq_min int, alt_mq_max int")
    assert {r.pos: r["samples"] for r in vcf.add_samples(df, [note]).collect()} == {5: ["9:5:4:10:20:30:40"], 7: ["."]}


def test_strict_regions(spark, tmp_path):
    (tmp_path / "a.bed").write_text("c\t1e2\t200\n")
    assert tuple(text.read_regions(spark, str(tmp_path / "a.bed"), strict=True).first()) == ("c", 100, 200)
    (tmp_path / "b.bed").write_text("c\t5\t5\n")
    with pytest.raises(Exception, match="empty region"):
        text.read_regions(spark, str(tmp_path / "b.bed"), strict=True).collect()


def packed(rows, contigs, block=200):
    """A binary alignment file of the rows."""
    out = b"BAM\x01" + struct.pack("<i", 4) + b"@HD\n" + struct.pack("<i", len(contigs))
    for name, n in contigs:
        out += struct.pack("<i", len(name) + 1) + name.encode() + b"\0" + struct.pack("<i", n)
    for qname, flag, tid, pos, mapq, ops, seq, qual, tags in rows:
        codes = [bam.BASES.index(c) for c in seq] + [0]
        body = struct.pack("<iiBBHHHiiii", tid, pos, len(qname) + 1, mapq, 0, len(ops), flag, len(seq), -1, -1, 0) + qname.encode() + b"\0"
        body += b"".join(struct.pack("<I", n << 4 | bam.OPERATIONS.index(op)) for op, n in ops)
        body += bytes(codes[i] << 4 | codes[i + 1] for i in range(0, len(seq), 2)) + bytes(qual) + tags
        out += struct.pack("<i", len(body)) + body
    raw = b""
    for i in range(0, len(out), block):
        deflate = zlib.compressobj(wbits=-15)
        part = out[i : i + block]
        data = deflate.compress(part) + deflate.flush()
        raw += struct.pack("<BBBBIBBHBBHH", 31, 139, 8, 4, 0, 0, 255, 6, 66, 67, 2, len(data) + 25) + data + struct.pack("<II", zlib.crc32(part), len(part))
    return raw


def test_bam(spark, tmp_path):
    rows = [("r1", 16, 1, 9, 60, [("S", 1), ("M", 4)], "ACGTN", [30, 31, 32, 33, 34], b"NMC\x02" + b"BIZ55555\0" + b"XFf" + struct.pack("<f", 0.5) + b"XBBs" + struct.pack("<Ihh", 2, -1, 7)), ("r2", 4, -1, -1, 0, [], "", [], b"XAAq")]
    rows += [(f"x{i}", 0, 0, i, 60, [("M", 3)], "ACG", [255, 255, 255], b"") for i in range(50)]
    (tmp_path / "a.bam").write_bytes(packed(rows, [("c1", 100), ("c2", 50)]))
    got = {r.qname: r for r in bam.read_bam(spark, str(tmp_path / "a.bam")).collect()}
    assert len(got) == 52 and tuple(got["r1"])[1:6] == (16, "c2", 9, 60, "1S4M") and got["r1"].seq == "ACGTN" and got["r1"].qual == [30, 31, 32, 33, 34]
    assert got["r1"].tags == {"NM": "2", "BI": "55555", "XF": "0.5", "XB": "s,-1,7"} and got["r2"].chrom is None and got["r2"].cigar == "*" and got["x3"].qual == []
    assert {(r.chrom, r.len, r.contig_no) for r in bam.read_bam_contigs(spark, str(tmp_path / "a.bam")).collect()} == {("c1", 100, 0), ("c2", 50, 1)}
    text.write_sam(bam.read_bam(spark, str(tmp_path / "a.bam")), f"{tmp_path}/o")
    again = {r.qname: r for r in text.read_sam(spark, f"{tmp_path}/o").collect()}
    assert {k: tuple(again[k])[1:6] for k in ("r1", "x7")} == {k: tuple(got[k])[1:6] for k in ("r1", "x7")} and again["r1"].tags == got["r1"].tags
    (tmp_path / "bad.bam").write_bytes(packed(rows, [("c1", 100), ("c2", 50)])[:-400])
    with pytest.raises(Exception, match="ends within|cut one"):
        bam.read_bam(spark, str(tmp_path / "bad.bam")).collect()


def test_error_profile(spark):
    from deepsift.operators import align

    rows = [("c", 0, 0, 0, 30), ("c", 0, 1, 0, 10), ("c", 1, 2, 0, 20), ("c", 2, 3, 3, 20), ("c", 2, 4, 3, 20)]
    got = align.error_profile(spark.createDataFrame(rows, "chrom string, place int, nt int, ref_nt int, bq int"))
    assert {r.place: (r.used, round(r.error, 6)) for r in got.collect()} == {0: (2, 0.45), 1: (1, 0.99), 2: (1, 0.0)}
    assert {r.place: round(r.error, 6) for r in align.normalised_profile(got).collect()} == {0: 1.0, 1: 2.2, 2: 0.0}


def test_prepared_reads(spark):
    """Realigned, with indel qualities: the steps before a call."""
    from deepsift.operators import workflow

    seq = "ACGTTTACGGATCCATTTTTGACCAGTACG" * 3
    contigs = spark.createDataFrame([("c", seq)], "chrom string, seq string")
    schema = "qname string, flag int, chrom string, pos long, mapq int, cigar string, seq string, qual array<int>, tags map<string,string>"
    reads = spark.createDataFrame([("a", 0, "c", 12, 60, "10M1I2M1D17M", seq[12:42], [30] * 30, {}), ("b", 4, None, 0, 0, "*", "ACG", [30] * 3, {})], schema).withColumn("ops", text.cigar_ops("cigar"))
    got = {r.qname: r for r in workflow.prepared(reads, contigs).collect()}
    assert got["a"].cigar == "30M" and len(got["a"].tags["BI"]) == 30 == len(got["a"].tags["BD"]) and got["b"].tags == {}
    assert {r.qname: r.tags for r in workflow.prepared(reads, contigs, uniform=(30, 20)).collect()}["a"] == {"BI": "?" * 30, "BD": "5" * 30}
