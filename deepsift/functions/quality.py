"""Phred scales, merged error probabilities, alleles and sequence tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: what an infinite phred is written as.
MAX_PHRED = 2147483647


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def phred_to_prob(q: Column | str) -> Column:
    return F.pow(F.lit(10.0), -col(q) / 10.0)


def prob_to_phred(p: Column | str) -> Column:
    """Truncated, as integer; a probability of 0 or less is infinite."""
    p = col(p)
    return F.when(p <= 0, F.lit(MAX_PHRED)).otherwise(F.floor(-10 * F.log10(F.least(p, F.lit(1.0)))).cast("int"))


def prob_to_phred_rounded(p: Column | str) -> Column:
    p = col(p)
    return F.when(p <= 0, F.lit(MAX_PHRED)).otherwise(F.round(-10 * F.log10(p)).cast("int"))


def mapping_error(mq: Column | str) -> Column:
    """255 is unknown and adds nothing; 0 is a chance of one half."""
    mq = col(mq)
    return F.when(mq.isNull() | (mq == 255) | (mq < 0), 0.0).when(mq == 0, 0.5).otherwise(phred_to_prob(mq))


def quality_error(q: Column | str) -> Column:
    """Null and -1 are missing and add nothing."""
    q = col(q)
    return F.when(q.isNull() | (q < 0), 0.0).otherwise(phred_to_prob(q))


def merged_error(bq: Column | str, mq: Column | str | None = None, baq: Column | str | None = None, sq: Column | str | None = None) -> Column:
    """Chance that mapping, source, alignment or base is wrong, each given that those before are right."""
    none = F.lit(0.0)
    pm = mapping_error(mq) if mq is not None else none
    ps = quality_error(sq) if sq is not None else none
    pa = quality_error(baq) if baq is not None else none
    pb = quality_error(bq)
    return pm + (1 - pm) * ps + (1 - pm) * (1 - ps) * pa + (1 - pm) * (1 - ps) * (1 - pa) * pb


def illumina13(qual: Column | str) -> Column:
    """Arrays of Illumina-1.3 qualities moved down by 31, not below 0."""
    return F.transform(col(qual), lambda q: F.greatest(q - 31, F.lit(0)))


def sanger_char(p: Column | str) -> Column:
    """A probability as a quality character between 33 and 126."""
    q = F.least(F.lit(126), F.lit(33) + F.least(F.lit(93), prob_to_phred(p)))
    return F.char(q)


def base_of(code: Column | str) -> Column:
    return F.substring(F.lit("ACGTN"), 1 + F.least(F.lit(4), col(code).cast("int")), F.lit(1))


def code_of(base: Column | str) -> Column:
    at = F.instr(F.lit("ACGT"), F.upper(col(base)))
    return F.when(at > 0, at - 1).otherwise(4)


def complement(seq: Column | str) -> Column:
    return F.translate(col(seq), "ACGTUacgtu", "TGCAAtgcaa")


def complement_rna(seq: Column | str) -> Column:
    return F.translate(col(seq), "ACGTUacgtu", "UGCAAugcaa")


def reverse_complement(seq: Column | str) -> Column:
    return F.reverse(complement(seq))


def is_transition(ref: Column | str, alt: Column | str) -> Column:
    return F.concat(col(ref), col(alt)).isin("AG", "GA", "CT", "TC")


def substitution(ref: Column | str, alt: Column | str) -> Column:
    """A strand-collapsed type, the smaller of X>Y and that of the other strand."""
    one = F.concat_ws(">", col(ref), col(alt))
    other = F.concat_ws(">", complement(ref), complement(alt))
    return F.concat_ws("|", F.least(one, other), F.greatest(one, other))


def is_indel(ref: Column | str, alt: Column | str, flag: Column | None = None) -> Column:
    out = (F.length(col(ref)) > 1) | (F.length(col(alt)) > 1)
    return out | F.coalesce(flag, F.lit(False)) if flag is not None else out


def indel_alleles(anchor: Column | str, kind: Column | str, key: Column | str) -> tuple[Column, Column]:
    """(REF, ALT) of an insertion ('ins') or deletion of ``key`` after the anchor base."""
    long = F.concat(col(anchor), col(key))
    ins = col(kind) == "ins"
    return F.when(ins, col(anchor)).otherwise(long), F.when(ins, long).otherwise(col(anchor))
