"""Reads to calls, end to end."""

import random

import pytest
from pyspark.sql import functions as F

from deepsift.operators import call, workflow
from deepsift.operators import variants as V
from deepsift.sources import text

READS = "qname string, flag int, chrom string, pos long, mapq int, cigar string, seq string, qual array<int>, tags map<string,string>"
CONTIG = "".join(random.Random(8).choices("ACGT", k=600))


def sample(spark, seed, changes, depth=60, indel=None):
    """Reads of 60 bases; changes {pos: share}, indel (pos, share, inserted bases)."""
    rng, rows = random.Random(seed), []
    for i in range(depth * 9):
        at = rng.randrange(0, 540)
        seq = list(CONTIG[at : at + 60])
        for p, share in changes.items():
            if at <= p < at + 60 and rng.random() < share:
                seq[p - at] = "ACGT"["ACGT".index(seq[p - at]) - 1]
        cigar, seq = "60M", "".join(seq)
        if indel and at + 5 < indel[0] < at + 50 and rng.random() < indel[1]:
            k = indel[0] - at + 1
            cigar, seq = f"{k}M{len(indel[2])}I{60 - k}M", seq[:k] + indel[2] + seq[k:]
        rows.append((f"r{i}", rng.choice([0, 16]), "c", at, 60, cigar, seq, [35] * len(seq), {"BI": "I" * len(seq), "BD": "I" * len(seq)}))
    rows += [("bad", 4, None, 0, 0, "*", "ACGT", [30] * 4, {}), ("dup", 1024, "c", 10, 60, "60M", "T" * 60, [35] * 60, {})]
    return spark.createDataFrame(rows, READS).withColumn("ops", text.cigar_ops("cigar")).repartition(3)


@pytest.fixture(scope="module")
def contigs(spark):
    return spark.createDataFrame([("c", CONTIG)], "chrom string, seq string").withColumn("len", F.length("seq").cast("long"))


def test_column_observations(spark, contigs):
    rows = [("a", 0, "c", 10, 60, "2S3M2I2M1D3M", "TT" + CONTIG[10:13] + "GG" + CONTIG[13:15] + CONTIG[16:19], list(range(20, 32)), {"BI": "5" * 12, "BD": "6" * 12, "ai": "A" * 12, "ad": "B" * 12, "lb": "C" * 12, "sq": "17"})]
    obs = text.column_observations(spark.createDataFrame(rows, READS).withColumn("ops", text.cigar_ops("cigar")), contigs)
    got = {r.pos: r for r in obs.collect()}
    assert sorted(got) == list(range(10, 19)) and all(r.ref_nt == "ACGT".index(CONTIG[p]) for p, r in got.items())
    assert [got[p].bq for p in range(10, 19)] == [22, 23, 24, 27, 28, None, 29, 30, 31] and got[15].nt is None
    assert (got[12].kind, got[12].key, got[12].aq) == ("ins", "GG", 32) and (got[14].kind, got[14].key, got[14].aq) == ("del", CONTIG[15], 33)
    assert got[10].is_head and got[18].is_tail and not got[15].is_tail and got[10].kind is None
    assert {(r.iq, r.dq, r.baq, r.sq) for r in got.values()} == {(20, 21, 34, 17)}


def test_calls_of_reads(spark, contigs):
    reads = sample(spark, 1, {200: 0.2, 400: 1.0}, indel=(300, 0.3, "GA" if CONTIG[301:303] != "GA" else "CT"))
    config = call.CallConfig(call_indels=True)
    got = {(r.pos, r.indel): r for r in workflow.call_reads(reads, contigs, config).collect()}
    assert {p for p, _ in got} == {200, 300, 400} and got[300, True].alt[1:] in ("GA", "CT")
    assert 0.1 < got[200, False].af < 0.3 and got[400, False].af == 1.0 and 0.15 < got[300, True].af < 0.45
    with pytest.raises(ValueError):
        call.CallConfig(only_indels=True)
    regions = spark.createDataFrame([("c", 190, 210)], "chrom string, beg long, end long")
    assert [r.pos for r in workflow.call_reads(reads, contigs, config, regions=regions).collect()] == [200]
    assert text.overlapping(reads, regions).count() == reads.where("chrom = 'c' AND pos < 210 AND pos + 60 > 190").count()
    with pytest.raises(ValueError):
        workflow.check_contigs(spark.createDataFrame([("c", 599)], "chrom string, len long"), contigs)
    workflow.check_contigs(spark.createDataFrame([("c", 600)], "chrom string, len long"), contigs)


def test_somatic_run(spark, contigs, tmp_path):
    normal, tumor = sample(spark, 2, {100: 0.5}), sample(spark, 3, {100: 0.5, 250: 0.3, 450: 0.4})
    known = spark.createDataFrame([("c", 450, CONTIG[450], "ACGT"["ACGT".index(CONTIG[450]) - 1])], "chrom string, pos long, ref string, alt string")
    out = workflow.somatic_run(spark, normal, tumor, contigs, f"{tmp_path}/run", workflow.SomaticConfig(germline=True), known=known)
    at = lambda name: sorted(r.pos for r in out[name].collect())
    assert at("somatic") == [250, 450] and at("somatic_minus_known") == [250] and at("germline") == [100] and 100 in at("tumor_stringent")
    again = workflow.somatic_run(spark, normal.limit(0), tumor.limit(0), contigs, f"{tmp_path}/run", workflow.SomaticConfig(germline=True), known=known, resume=True)
    assert sorted(r.pos for r in again["somatic"].collect()) == [250, 450]


def test_uniqueness_of_indels(spark):
    obs = spark.createDataFrame([("c", 5, 0, 30, "ins", "T")] * 3 + [("c", 5, 0, 30, None, None)] * 17, "chrom string, pos long, nt int, bq int, kind string, key string")
    variants = spark.createDataFrame([("c", 5, "A", "AT", 0.5), ("c", 5, "A", "AG", 0.5), ("c", 5, "A", "C", 0.5), ("c", 9, "A", "C", 0.5)], "chrom string, pos long, ref string, alt string, af double")
    got = {(r.pos, r.alt): (r.other_dp, r.other_alt, r.uq) for r in V.uniqueness_of(variants, obs).collect()}
    assert got[5, "AT"][:2] == (20, 3) and got[5, "AG"] == (20, 0, 60) and got[5, "C"] == (20, 0, 60) and got[9, "C"] == (0, 0, 0)
    scored = V.uniqueness_of(variants, obs)
    assert [V.unique_by_mtc(scored, m, 0.001).count() for m in ("bonf", "holm", "fdr")] == [2, 2, 2]
