"""Whole runs: from reads to filtered calls, and a tumour against its normal sample."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.quality import is_indel
from ..sources import text
from . import align, call, indelqual, pileup
from . import variants as V


@dataclass(frozen=True)
class ReadConfig:
    """How reads are taken in before a call."""

    min_mq: int = 0
    max_mq: int = 255
    use_orphans: bool = False
    illumina13: bool = False
    baq: bool = True
    extended_baq: bool = True
    idaq: bool = True
    source_quality: bool = False
    nonmatch_quality: int | None = None
    max_depth: int = 1_000_000


def check_contigs(header: DataFrame, contigs: DataFrame) -> None:
    """An error where a contig of header(chrom, len) is not in the reference or has another length there."""
    from .summary import check_reference

    if wrong := check_reference(header, contigs).limit(3).collect():
        raise ValueError(f"reads are of another reference: {[r.chrom for r in wrong]}")


def observed(reads: DataFrame, contigs: DataFrame, config: ReadConfig = ReadConfig(), regions: DataFrame | None = None, ignore: DataFrame | None = None) -> DataFrame:
    """Column observations of the reads that pass, within the regions if there are any."""
    reads = pileup.mapping_filter(pileup.read_filter(reads), config.min_mq, config.max_mq, config.use_orphans)
    if regions is not None:
        reads = text.overlapping(reads, regions)
    if config.illumina13:
        from ..functions.quality import illumina13

        reads = reads.withColumn("qual", illumina13("qual"))
    if config.baq or config.idaq:
        reads = align.alignment_qualities(reads, contigs, config.baq, config.idaq, config.extended_baq)
    if config.source_quality:
        reads = align.source_qualities(reads, contigs, ignore=ignore, nonmatch_quality=config.nonmatch_quality)
    obs = text.column_observations(reads, contigs)
    if regions is not None:
        obs = V.overlap(obs, regions)
    return pileup.depth_cap(obs, config.max_depth, ["qname"]) if config.max_depth < 1_000_000 else obs


def prepared(reads: DataFrame, contigs: DataFrame, uniform: tuple[int, int] | None = None) -> DataFrame:
    """Reads realigned and with indel qualities: by homopolymers, or uniform ones."""
    moved = align.realign(reads, contigs)
    return indelqual.uniform(moved, *uniform) if uniform else indelqual.by_homopolymer(moved, text.contig_bases(contigs))


def call_reads(reads: DataFrame, contigs: DataFrame, config: call.CallConfig = call.CallConfig(), how: ReadConfig = ReadConfig(), regions: DataFrame | None = None, ignore: DataFrame | None = None, default_filter: bool = True) -> DataFrame:
    """Calls from reads, through the default filter unless that is off.

    The tests, their count and the indels' consensus ask for the same observations, so these, and the
    calls, are held on executors' disks; what is lost with an executor is made again.
    """
    obs = observed(reads, contigs, how, regions, ignore).persist(StorageLevel.DISK_ONLY)
    calls = call.call_variants(obs, config).withColumn("filter", F.lit(".")).persist(StorageLevel.DISK_ONLY)  # corrections read them several times
    return V.filter_variants(calls) if default_filter else calls


@dataclass(frozen=True)
class SomaticConfig:
    """The levels of a tumour against normal run."""

    normal_sig: float = 0.10
    tumor_sig: float = 0.01
    min_cov: int = 7
    max_cov: int = 100_000
    sb_alpha: float = 0.001
    tumor_mtc: str = "bonf"
    tumor_alpha: float = 1.0
    tumor_indel_mtc: str = "bonf"
    tumor_indel_alpha: float = 0.01
    normal_mtc: str = "fdr"
    normal_alpha: float = 0.01
    unique_frequency: float = 0.5
    unique_snv_alpha: float = 0.001
    unique_indel_alpha: float = 0.0001
    call_indels: bool = False
    use_orphans: bool = False
    baq: bool = True
    source_quality: bool = True
    germline: bool = False
    extra: dict = field(default_factory=dict)


def _stringent(calls: DataFrame, config: SomaticConfig, mtc: str, alpha: float, indel_mtc: str, indel_alpha: float, tests: tuple[int, int]) -> DataFrame:
    return V.filter_variants(calls, V.FilterConfig(
        min_dp=config.min_cov, max_dp=config.max_cov, sb_mtc="fdr", sb_alpha=config.sb_alpha, snv_mtc=mtc, snv_alpha=alpha, snv_ntests=max(1, tests[0]),
        indel_mtc=indel_mtc, indel_alpha=indel_alpha, indel_ntests=max(1, tests[1]),
    ))


def somatic_run(
    spark: SparkSession, normal: DataFrame, tumor: DataFrame, contigs: DataFrame, folder: str, config: SomaticConfig = SomaticConfig(),
    regions: DataFrame | None = None, known: DataFrame | None = None, resume: bool = False,
) -> dict[str, DataFrame]:
    """Tables by name: normal_relaxed, normal_stringent, tumor_relaxed, tumor_stringent, somatic_raw, somatic, somatic_minus_known, germline.

    Relaxed calls have a factor of one and no filter: the normal sample's at 10 % with orphans and without alignment or
    mapping qualities, the tumour's at 1 % with source qualities that leave out the normal's variants. Stringent ones
    pass the strand filter, depths, and corrections over the tests that the relaxed calls made. Somatic ones are the
    tumour's that the normal lacks, by allele or, for indels, by position, and that are unlike it by chance. Each
    table is written to ``folder`` and read again; with ``resume`` those that are there are taken as they are.
    """
    hadoop = spark._jvm.org.apache.hadoop.fs

    def there(path: str) -> bool:
        p = hadoop.Path(f"{path}/_SUCCESS")
        return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def step(name: str, make: Callable[[], DataFrame]) -> DataFrame:
        path = f"{folder.rstrip('/')}/{name}"
        if not (resume and there(path)):
            make().write.mode("overwrite" if resume else "errorifexists").parquet(path)
        return spark.read.parquet(path)

    relaxed = call.CallConfig(bonf=1, bonf_indel=1, call_indels=config.call_indels)
    of_normal = replace(relaxed, sig=config.normal_sig, use_mq=False, use_baq=False, use_idaq=False)
    of_tumor = replace(relaxed, sig=config.tumor_sig, min_cov=config.min_cov, use_sq=config.source_quality)
    normal_obs = step("normal_columns", lambda: observed(normal, contigs, ReadConfig(use_orphans=True, baq=False, idaq=False), regions))
    out = {"normal_relaxed": step("normal_relaxed", lambda: call.call_variants(normal_obs, of_normal).withColumn("filter", F.lit(".")))}
    tested = lambda name, obs, how: tuple(step(name, lambda: call.test_counts(obs, how)).first())
    out["normal_stringent"] = step("normal_stringent", lambda: _stringent(out["normal_relaxed"], config, config.normal_mtc, config.normal_alpha, config.normal_mtc, config.normal_alpha, tested("normal_tests", normal_obs, of_normal)))
    ignore = out["normal_stringent"].select("chrom", "pos").distinct() if config.source_quality else None
    how = ReadConfig(use_orphans=config.use_orphans, baq=config.baq, idaq=config.call_indels, source_quality=config.source_quality)
    tumor_obs = step("tumor_columns", lambda: observed(tumor, contigs, how, regions, ignore))
    out["tumor_relaxed"] = step("tumor_relaxed", lambda: call.call_variants(tumor_obs, of_tumor).withColumn("filter", F.lit(".")))
    tests = tested("tumor_tests", tumor_obs, of_tumor)
    out["tumor_stringent"] = step("tumor_stringent", lambda: _stringent(out["tumor_relaxed"], config, config.tumor_mtc, config.tumor_alpha, config.tumor_indel_mtc, config.tumor_indel_alpha, tests))
    out["somatic_raw"] = step("somatic_raw", lambda: V.somatic(out["tumor_stringent"], out["normal_relaxed"]).withColumn("somatic", F.lit(True)))

    def unique() -> DataFrame:
        met = V.uniqueness_of(out["somatic_raw"], normal_obs, config.unique_frequency)
        indel = is_indel("ref", "alt")
        snvs = V.unique_by_mtc(met.where(~indel), "fdr", config.unique_snv_alpha)
        return snvs.unionByName(V.unique_by_mtc(met.where(indel), "fdr", config.unique_indel_alpha))

    out["somatic"] = step("somatic", unique)
    if known is not None:
        out["somatic_minus_known"] = step("somatic_minus_known", lambda: V.complement(out["somatic"], known))
    if config.germline:
        out["germline"] = step("germline", lambda: V.germline(out["normal_relaxed"], out["tumor_stringent"]))
    return out
