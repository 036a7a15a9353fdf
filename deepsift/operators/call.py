"""Calling substitutions and indels: exact Poisson-binomial tests of what a column's bases show against the reference.

Observations (see ``pileup``) may have more columns: ``nt`` null for a read whose base is deleted there, ``sq``;
and for indels ``kind`` ('ins', 'del' or null), ``key`` (its bases), ``iq`` and ``dq`` (insertion and deletion
quality), ``aq`` (alignment quality of the event), ``is_tail`` (the read ends there).

A column's observations are counted by what tells them apart before they meet, so a deep column is a list of
distinct errors with their numbers. The same shuffle serves the tests and their count. The tests themselves run on
Arrow batches, a column's list at a time.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.poibin import phred, tails
from ..functions.quality import MAX_PHRED, base_of, indel_alleles, merged_error, phred_to_prob, prob_to_phred, quality_error
from ..functions.tests import strand_bias
from .pileup import MIN_PLP_BQ, SITE


@dataclass(frozen=True)
class CallConfig:
    """Options of a call; ``bonf`` and ``bonf_indel`` None count the tests.

    ``def_alt_bq`` 0 keeps qualities of alternative bases, -1 takes the median of the column's reference bases, another
    value replaces them; ``def_alt_jq`` replaces joined ones unless 0.
    """

    min_bq: int = 6
    min_alt_bq: int = 6
    def_alt_bq: int = 0
    min_jq: int = 0
    min_alt_jq: int = 0
    def_alt_jq: int = 0
    min_cov: int = 1
    sig: float = 0.01
    bonf: int | None = None
    bonf_indel: int | None = None
    use_mq: bool = True
    use_baq: bool = True
    use_sq: bool = False
    use_idaq: bool = True
    min_idq: int = 0
    call_indels: bool = False
    only_indels: bool = False

    def __post_init__(self):
        if self.def_alt_jq < 0:
            raise ValueError("no median of joined qualities: def_alt_jq is 0 or more")
        if self.only_indels and not self.call_indels:
            raise ValueError("only_indels goes with call_indels")


def _with(obs: DataFrame, **kinds: str) -> DataFrame:
    """Missing columns as nulls."""
    return obs.withColumns({c: F.lit(None).cast(k) for c, k in kinds.items() if c not in obs.columns}) if any(c not in obs.columns for c in kinds) else obs


def _reference_medians(obs: DataFrame) -> DataFrame:
    """chrom, pos, ref_bq: the median quality of a column's reference bases, the two middle ones' mean cut to whole."""
    counted = obs.where((F.col("nt") == F.col("ref_nt")) & (F.col("bq") >= MIN_PLP_BQ)).groupBy(*SITE, "bq").agg(F.count("*").alias("n"))
    return counted.groupBy(*SITE).agg(F.expr("floor(percentile(bq, 0.5, n))").cast("int").alias("ref_bq"))


def substitution_columns(obs: DataFrame, config: CallConfig = CallConfig()) -> DataFrame:
    """chrom, pos, ref_nt and o, the column's observations folded to (nt, rev, seen, e, n); e is null where the thresholds leave a base out.

    ``seen``: the base counts for the raw frequency, the strands and the number of bases.
    """
    obs = _with(obs, sq="int", baq="int").withColumn("bq", F.least(F.col("bq"), F.lit(93)))
    is_alt, bq = F.col("nt") != F.col("ref_nt"), F.col("bq")
    seen = F.coalesce((F.col("bq") >= MIN_PLP_BQ) & F.col("nt").isNotNull(), F.lit(False))
    if config.def_alt_bq == -1:
        obs = obs.join(_reference_medians(obs), SITE, "left")
        bq = F.when(is_alt, F.coalesce("ref_bq", F.lit(-1))).otherwise(bq)
    elif config.def_alt_bq:
        bq = F.when(is_alt, F.lit(config.def_alt_bq)).otherwise(bq)
    error = merged_error(bq, "mq" if config.use_mq else None, "baq" if config.use_baq else None, "sq" if config.use_sq else None)
    used = seen & (F.col("nt") < 4) & (F.col("bq") >= F.when(is_alt, max(config.min_bq, config.min_alt_bq)).otherwise(config.min_bq))
    obs = obs.withColumn("e", error)
    joined = prob_to_phred("e")
    if config.min_jq or config.min_alt_jq:
        used &= joined >= F.when(is_alt, max(config.min_jq, config.min_alt_jq)).otherwise(config.min_jq)
    e = F.when(is_alt, phred_to_prob(F.lit(config.def_alt_jq))).otherwise(F.col("e")) if config.def_alt_jq else F.col("e")
    folded = obs.select(*SITE, "ref_nt", F.when(seen, F.col("nt").cast("int")).alias("nt"), F.when(seen, F.col("is_rev")).alias("rev"), seen.alias("seen"), F.when(used, e).alias("e"))
    folded = folded.groupBy(*SITE, "ref_nt", "nt", "rev", "seen", "e").agg(F.count("*").alias("n"))
    return folded.groupBy(*SITE, "ref_nt").agg(F.collect_list(F.struct("nt", "rev", "seen", "e", "n")).alias("o"))


def _sum(o: str, take) -> Column:
    return F.aggregate(F.filter(o, take), F.lit(0).cast("long"), lambda a, x: a + x["n"])


def tested_columns(obs: DataFrame, config: CallConfig = CallConfig(), indel_sites: DataFrame | None = None) -> DataFrame:
    """Columns whose alternative bases are tested: a reference base, enough bases, no indel consensus, an alternative left.

    A column fails where less than half of its reads have a base, or where it is in indel_sites(chrom, pos).
    """
    columns = substitution_columns(obs, config).where("ref_nt < 4")
    bases, coverage = _sum("o", lambda x: x["seen"]), _sum("o", lambda x: F.lit(True))
    alt = F.exists("o", lambda x: x["e"].isNotNull() & (x["nt"] != F.col("ref_nt")))
    columns = columns.where(alt & (bases >= config.min_cov) & (2 * bases >= coverage))
    return columns.join(indel_sites.select(*SITE).distinct(), SITE, "left_anti") if indel_sites is not None else columns


_COUNTS = ["ref_fw", "ref_rv", "alt_fw", "alt_rv"]
TESTED = T.StructType([T.StructField("chrom", T.StringType()), T.StructField("pos", T.LongType()), T.StructField("ref_nt", T.IntegerType()), T.StructField("alt_nt", T.IntegerType()),
                       *[T.StructField(c, T.LongType()) for c in ("dp", "raw_n", "alt_n", *_COUNTS)], T.StructField("p", T.DoubleType()), T.StructField("qual", T.IntegerType()), T.StructField("hit", T.BooleanType())])


def _lists(b: pa.RecordBatch, name: str = "o") -> tuple[np.ndarray, pa.StructArray]:
    """Offsets of a column of lists, and its flat structs."""
    column = b.column(name)
    offsets = column.offsets.to_numpy()
    return offsets - offsets[0], column.flatten()


def _np(structs: pa.StructArray, name: str, fill) -> np.ndarray:
    return structs.field(name).fill_null(fill).to_numpy(zero_copy_only=False)


def _test_substitutions(sig: float | None):
    """Rows of alternatives; with ``sig`` only those that are significant at it after the factor, and hopeless columns end early."""

    def run(batches):
        for b in batches:
            offsets, o = _lists(b)
            nt, rev, seen, e, n = (_np(o, c, f) for c, f in (("nt", -1), ("rev", False), ("seen", False), ("e", -1.0), ("n", 0)))
            rows = []
            factors = b.column("factor").to_pylist()
            for i, (chrom, pos, ref) in enumerate(zip(*(b.column(c).to_pylist() for c in ("chrom", "pos", "ref_nt")), strict=True)):
                at = slice(offsets[i], offsets[i + 1])
                own, many, used, base = nt[at], n[at], e[at] >= 0, seen[at]
                alts = np.array([many[used & (own == k)].sum() if k != ref else 0 for k in range(4)])
                stop = sig / factors[i] if sig is not None else None
                chance = tails(e[at][used], many[used], [max(int(x), 1) for x in alts], stop)
                strand = lambda k, r, own=own, many=many, base=base, at=at: int(many[base & (own == k) & (rev[at] == r)].sum())
                for k in np.nonzero(alts)[0]:
                    hit = bool(chance[k] * factors[i] < sig) if sig is not None else False
                    if hit or sig is None:
                        k = int(k)
                        rows.append((chrom, pos, ref, k, int(many.sum()), strand(k, False) + strand(k, True), int(alts[k]), strand(ref, False), strand(ref, True), strand(k, False), strand(k, True), float(chance[k]), phred(chance[k], MAX_PHRED), hit))
            yield pa.RecordBatch.from_pylist([dict(zip(TESTED.names, r, strict=True)) for r in rows], _arrow(TESTED))

    return run


def _arrow(schema: T.StructType) -> pa.Schema:
    kinds = {T.StringType: pa.string(), T.LongType: pa.int64(), T.IntegerType: pa.int32(), T.DoubleType: pa.float64(), T.BooleanType: pa.bool_()}
    return pa.schema([(f.name, kinds[type(f.dataType)]) for f in schema])


def p_values(columns: DataFrame) -> DataFrame:
    """A row per tested column and alternative base with its p-value, counts and quality."""
    typed = columns.withColumns({"pos": F.col("pos").cast("long"), "ref_nt": F.col("ref_nt").cast("int"), "factor": F.lit(1).cast("long")})
    return typed.mapInArrow(_test_substitutions(None), TESTED).drop("hit")


def substitution_tests(columns: DataFrame) -> DataFrame:
    """factor: three tests for each tested column. It reads what the tests read, so Spark shuffles once for both."""
    return columns.agg((3 * F.count("o")).alias("factor"))


def _with_factor(df: DataFrame, fixed: int | None, counted: DataFrame) -> DataFrame:
    if fixed is not None:
        return df.withColumn("factor", F.lit(fixed).cast("long"))
    return df.crossJoin(F.broadcast(counted))  # one row


def call_snvs(obs: DataFrame, config: CallConfig = CallConfig(), indel_sites: DataFrame | None = None) -> DataFrame:
    """Significant substitutions: chrom, pos (0-based), ref, alt, qual, dp, af, sb and DP4, and hqa, the alternatives that were tested.

    dp is the raw depth, af the raw alternative bases over it; filters on qualities bear on the test alone. Without a
    fixed factor p-values are multiplied by three times the number of tested columns; a running factor, never above
    it, cannot lose a call that it keeps.
    """
    columns = tested_columns(obs, config, indel_sites)
    typed = columns.withColumns({"pos": F.col("pos").cast("long"), "ref_nt": F.col("ref_nt").cast("int")})
    hits = _with_factor(typed, config.bonf, substitution_tests(columns)).mapInArrow(_test_substitutions(config.sig), TESTED)
    return hits.select(
        *SITE, base_of("ref_nt").alias("ref"), base_of("alt_nt").alias("alt"), "qual", "dp", F.round(F.col("raw_n") / F.col("dp"), 6).alias("af"),
        strand_bias(*_COUNTS).alias("sb"), *_COUNTS, F.col("alt_n").alias("hqa"),
    )


# Indels

EVENT = ("kind", "key")


def indel_columns(obs: DataFrame, config: CallConfig = CallConfig()) -> DataFrame:
    """chrom, pos, ref_nt, coverage, tails, ignored and o, folded to (kind, key, iq, dq, aq, mq, sq, rev, n), of columns with an indel event.

    Reads whose insertion or deletion quality is under ``min_idq`` are left out of o; their indels are ``ignored``.
    """
    obs = _with(obs, kind="string", key="string", iq="int", dq="int", aq="int", sq="int", is_tail="boolean")
    iq, dq = F.coalesce("iq", F.lit(0)), F.coalesce("dq", F.lit(0))
    ok = (iq >= config.min_idq) & (dq >= config.min_idq)
    folded = obs.select(*SITE, "ref_nt", ok.alias("ok"), "kind", "key", F.when(ok, iq).alias("iq"), F.when(ok, dq).alias("dq"), F.when(ok & F.col("kind").isNotNull(), F.col("aq")).alias("aq"), F.when(ok, F.col("mq")).alias("mq"), F.when(ok, F.col("sq")).alias("sq"), "is_rev", F.coalesce("is_tail", F.lit(False)).alias("tail"))
    folded = folded.groupBy(*folded.columns).agg(F.count("*").alias("n"))
    item = F.struct("kind", "key", "iq", "dq", "aq", "mq", "sq", F.col("is_rev").alias("rev"), "n")
    columns = folded.groupBy(*SITE, "ref_nt").agg(
        F.sum("n").alias("coverage"), F.sum(F.when(F.col("tail"), F.col("n")).otherwise(0)).alias("tails"),
        F.sum(F.when(~F.col("ok") & F.col("kind").isNotNull(), F.col("n")).otherwise(0)).alias("ignored"), F.collect_list(F.when(F.col("ok"), item)).alias("o"),
    )
    return columns.where(F.exists("o", lambda x: x["kind"].isNotNull()))


def _events(least: float = 0.05) -> Column:
    """The (kind, key, n) of o that are tested: a single A or T that is both inserted and deleted, each in under 5 % of the depth, is not."""
    distinct = F.array_distinct(F.transform(F.filter("o", lambda x: x["kind"].isNotNull()), lambda x: F.struct(x["kind"].alias("kind"), x["key"].alias("key"))))
    counted = F.transform(distinct, lambda e: F.struct(e["kind"].alias("kind"), e["key"].alias("key"), _sum("o", lambda x: (x["kind"] == e["kind"]) & (x["key"] == e["key"])).alias("n")))
    rare = lambda x: x["n"] < least * (F.col("coverage") - F.col("tails"))
    twin = lambda e: F.exists(counted, lambda x: (x["kind"] != e["kind"]) & (x["key"] == e["key"]) & rare(x))
    return F.filter(counted, lambda e: ~(e["key"].isin("A", "T") & rare(e) & twin(e)))


def indel_consensus(obs: DataFrame, config: CallConfig = CallConfig()) -> DataFrame:
    """chrom, pos, cons ('+' or '-' and the bases): columns where an event's qualities outweigh those of all reads without one of its kind; insertions first."""
    columns = indel_columns(obs, config)

    def weight(q: str, take) -> Column:
        return F.aggregate(F.filter("o", take), F.lit(0).cast("long"), lambda a, x: a + x[q] * x["n"])

    def pick(kind: str, q: str, sign: str) -> Column:
        of = lambda x: F.coalesce(x["kind"] == kind, F.lit(False))
        keys = F.array_distinct(F.transform(F.filter("o", of), lambda x: x["key"]))
        best = F.array_max(F.transform(keys, lambda k: F.struct(weight(q, lambda x: of(x) & (x["key"] == k)).alias("w"), k.alias("key"))))
        return F.when(best["w"] > weight(q, lambda x: ~of(x)), F.concat(F.lit(sign), best["key"]))

    return columns.select(*SITE, F.coalesce(pick("ins", "iq", "+"), pick("del", "dq", "-")).alias("cons")).where("cons IS NOT NULL")


FOUND = T.StructType([T.StructField("chrom", T.StringType()), T.StructField("pos", T.LongType()), T.StructField("ref_nt", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("key", T.StringType()),
                      *[T.StructField(c, T.LongType()) for c in ("dp", "alt_n", *_COUNTS)], T.StructField("p", T.DoubleType()), T.StructField("qual", T.IntegerType())])


def _prob(q: np.ndarray) -> np.ndarray:
    return np.where(q < 0, 0.0, np.power(10.0, -q / 10.0))


def _merge(*parts: np.ndarray) -> np.ndarray:
    """Chance that any of independent errors happens, in their order."""
    wrong, right = 0.0, 1.0
    for p in parts:
        wrong = wrong + right * p
        right = right * (1 - p)
    return wrong


def _test_indels(config: CallConfig):
    def run(batches):
        for b in batches:
            offsets, o = _lists(b)
            kind, key = (o.field(c).to_numpy(zero_copy_only=False) for c in EVENT)
            iq, dq, aq, mq, sq = (_np(o, c, -1).astype(np.int64) for c in ("iq", "dq", "aq", "mq", "sq"))
            rev, n = _np(o, "rev", False), _np(o, "n", 0)
            mapping = lambda q: np.where(q == 0, 0.5, _prob(q))
            unknown = np.where(mq == 255, -1, mq)
            rows = []
            for i, r in enumerate(b.select(["chrom", "pos", "ref_nt", "coverage", "tails", "events", "factor"]).to_pylist()):
                at = slice(offsets[i], offsets[i + 1])
                for e in r["events"]:
                    of, is_ins = kind[at] == e["kind"], e["kind"] == "ins"
                    own = of & (key[at] == e["key"])
                    q = (iq if is_ins else dq)[at]
                    none = np.full(len(q), -1)
                    # reads without an event of this kind: an unknown mapping quality is taken at its face value
                    m = np.where(of, unknown[at], mq[at]) if config.use_mq else none
                    a = np.where(own, aq[at], -1) if config.use_idaq else none
                    s = np.where(of, sq[at], -1) if config.use_sq else none
                    error = _merge(mapping(m), _prob(s), _prob(a), _prob(q))
                    p = tails(error, n[at], [e["n"]], config.sig / r["factor"])[0]
                    if p * r["factor"] < config.sig:
                        strand = lambda which, back, at=at: int(n[at][which & (rev[at] == back)].sum())
                        rows.append((r["chrom"], r["pos"], r["ref_nt"], e["kind"], e["key"], r["coverage"] - r["tails"], e["n"], strand(~of, False), strand(~of, True), strand(own, False), strand(own, True), float(p), phred(p, MAX_PHRED)))
            yield pa.RecordBatch.from_pylist([dict(zip(FOUND.names, x, strict=True)) for x in rows], _arrow(FOUND))

    return run


def tested_indels(obs: DataFrame, config: CallConfig = CallConfig()) -> DataFrame:
    """Columns with the events to test: a reference base, and enough reads whose indel qualities pass."""
    columns = indel_columns(obs, config).where("ref_nt < 4").where(_sum("o", lambda x: F.lit(True)) >= config.min_cov)
    return columns.withColumn("events", _events()).where(F.size("events") > 0)


def call_indels(obs: DataFrame, config: CallConfig = CallConfig(), hrun: DataFrame | None = None) -> DataFrame:
    """Significant insertions and deletions: chrom, pos (the base before), ref, alt, qual, dp, af, sb, DP4, indel, hrun.

    dp leaves out reads that end at the column. An event's errors are those of reads with any event of its kind, with
    alignment qualities for its own bases alone, and of all other reads. Without a fixed factor p-values are
    multiplied by the number of tested events and one. hrun(chrom, pos, hrun) is looked up where it is given.
    """
    columns = tested_indels(obs, config)
    typed = columns.withColumns({"pos": F.col("pos").cast("long"), "ref_nt": F.col("ref_nt").cast("int")})
    tests = columns.agg((1 + F.coalesce(F.sum(F.size("events")), F.lit(0))).alias("factor"))
    hits = _with_factor(typed, config.bonf_indel, tests).mapInArrow(_test_indels(config), FOUND)
    ref, alt = indel_alleles(base_of("ref_nt"), "kind", "key")
    out = hits.select(*SITE, ref.alias("ref"), alt.alias("alt"), "qual", "dp", F.round(F.col("alt_n") / F.col("dp"), 6).alias("af"), strand_bias(*_COUNTS).alias("sb"), *_COUNTS, F.lit(True).alias("indel"))
    return out.join(hrun, SITE, "left") if hrun is not None else out


def call_variants(obs: DataFrame, config: CallConfig = CallConfig()) -> DataFrame:
    """Substitutions and, where the options say so, indels: chrom, pos, ref, alt, qual, dp, af, sb, DP4, indel."""
    shown = [*SITE, "ref", "alt", "qual", "dp", "af", "sb", *_COUNTS, "indel"]
    snvs = call_snvs(obs, config, indel_consensus(obs, config) if config.call_indels else None).withColumn("indel", F.lit(False)).select(*shown)
    if not config.call_indels:
        return snvs
    indels = call_indels(obs, config).select(*shown)
    return indels if config.only_indels else snvs.unionByName(indels)


def test_counts(obs: DataFrame, config: CallConfig = CallConfig()) -> DataFrame:
    """One row: snv_tests (three for each tested column) and indel_tests."""
    snv = substitution_tests(tested_columns(obs, config, indel_consensus(obs, config) if config.call_indels else None)).select(F.col("factor").alias("snv_tests"))
    indel = tested_indels(obs, config).agg(F.coalesce(F.sum(F.size("events")), F.lit(0)).cast("long").alias("indel_tests"))
    return snv.crossJoin(F.broadcast(indel))  # one row each
