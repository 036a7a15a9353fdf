"""Quality rules whose cutoffs come with a proven limit on false rejections.

A rule rejects a document if a statistic is above its cutoff. Cutoffs are set for each stratum (language) from
all labelled documents: candidates come from one half of them, and the other half, the holdout, tests them
from the most lenient one on. A candidate passes if the exact (Clopper-Pearson) upper bound of the share of good
documents that it rejects is at most RISK / number of rules; the last one before the first failure is taken
(fixed-sequence testing, so candidates need no further correction), and strata and rules share DELTA by
Bonferroni. With probability 1 - DELTA no stratum loses more than RISK of its good documents to these rules. A
stratum or rule without enough labels for a proof rejects nothing.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import DBL, INT, LONG, STR, Scratch, fields, slices

RISK, DELTA = 0.03, 0.05
CANDIDATES = 60
SYMBOLS = "#*$%&|<>"
RULES = ("symbols", "repeats", "dup_lines", "upper", "marks", "word_length")

STATS = fields(doc_id=LONG, stratum=STR, n_words=LONG, word_chars=LONG, n_symbols=LONG, n_dup_lines=LONG, n_repeat_words=LONG, n_upper=LONG, n_marks=LONG, n_lines=LONG)
_BLANK = " \t\n\x0b\x0c\r"


def repeat_words(words: list[bytes]) -> int:
    """Words within 3-word windows that are found twice or more, the first one included."""
    n = len(words) - 2
    if n < 2:
        return 0
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == n:
        return 0
    found = Counter(windows)
    hit = np.fromiter((found[w] > 1 for w in windows), bool, n)
    covered = np.zeros(n + 2, bool)
    for i in range(3):
        covered[i : n + i] |= hit
    return int(covered.sum())


def text_stats(text: str | None) -> tuple[int, ...]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_upper, n_marks, n_lines of a whole text."""
    if not text:
        return (0,) * 8
    words = text.encode().split()
    lines = [x for x in text.split("\n") if x.strip(_BLANK)]
    return (
        len(words),
        len(text) - sum(map(text.count, _BLANK)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeat_words(words),
        sum(map(str.isupper, text)) if not text.islower() else 0,
        text.count("!") + text.count("?"),
        len(lines),
    )


def document_stats(docs: DataFrame, stratum: str = "lang") -> DataFrame:
    """The statistics of documents(doc_id, text, ``stratum``), a row each; a null text has zeros."""

    def run(batches):
        for b in slices(batches):
            columns = list(zip(*map(text_stats, b.column(2).to_pylist()), strict=True)) or [()] * 8
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *[pa.array(c, pa.int64()) for c in columns]], STATS.names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(stratum).cast("string").alias("stratum"), "text").mapInArrow(run, STATS)


def with_rules(stats: DataFrame) -> DataFrame:
    """The rules' statistics; documents without words have zeros."""
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return stats.withColumns({
        "r_symbols": ratio("n_symbols", "n_words"), "r_repeats": ratio("n_repeat_words", "n_words"), "r_dup_lines": ratio("n_dup_lines", "n_lines"),
        "r_upper": ratio("n_upper", "word_chars"), "r_marks": ratio("n_marks", "n_words"), "r_word_length": ratio("word_chars", "n_words"),
    })


def binomial_cdf(k: int, n: int, p: float) -> float:
    """P(X <= k) for X of n trials with chance p."""
    if k >= n or p <= 0:
        return 1.0
    if p >= 1:
        return 0.0
    odds, log_term = p / (1 - p), n * math.log1p(-p)
    peak, terms = log_term, [log_term]
    for i in range(k):
        log_term += math.log(odds * (n - i) / (i + 1))
        terms.append(log_term)
        peak = max(peak, log_term)
    return min(1.0, math.exp(peak) * math.fsum(math.exp(t - peak) for t in terms))


def upper_bound(k: int, n: int, delta: float) -> float:
    """Clopper-Pearson: the largest p with P(X <= k) >= delta."""
    if k >= n:
        return 1.0
    lo, hi = k / n, 1.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if binomial_cdf(k, n, mid) >= delta else (lo, mid)
    return hi


def _last_passing(steps: np.ndarray, lost: list[int], n: int, limit: float, level: float) -> float:
    """The least of the ascending ``steps`` before the first failure from the top; ``lost`` of n good documents are above each."""
    chosen = math.inf
    for c, k in zip(steps[::-1], lost[::-1], strict=True):
        # the upper bound is within the limit where so few losses are too unlikely at the limit
        if not n or k > limit * n or binomial_cdf(k, n, limit) > level:
            break
        chosen = float(c)
    return chosen


def _levels(strata: int, risk: float, delta: float) -> tuple[float, float]:
    return risk / len(RULES), delta / (len(RULES) * max(1, strata))


def choose_cutoffs(rows: list[tuple[int, str | None, int, tuple[float, ...]]], risk: float = RISK, delta: float = DELTA) -> dict[str | None, list[float]]:
    """Cutoffs by stratum and rule (inf: rejects nothing) from (hash, stratum, quality 1 good or 0, rule statistics).

    For rows in hand; ``cutoffs`` finds the same for a table.
    """
    strata = defaultdict(lambda: ([], []))
    for h, s, good, values in rows:
        strata[s][h % 2].append((good, values))
    limit, level = _levels(len(strata), risk, delta)
    out = {}
    for s, (first, second) in strata.items():
        tune = np.array([v for _, v in first], np.float64).reshape(-1, len(RULES))
        hold = np.array([v for good, v in second if good], np.float64).reshape(-1, len(RULES))
        steps = [np.unique(np.quantile(tune[:, r], np.linspace(0.5, 1, CANDIDATES))) if len(tune) else np.zeros(0) for r in range(len(RULES))]
        out[s] = [_last_passing(x, [int((hold[:, r] > c).sum()) for c in x], len(hold), limit, level) for r, x in enumerate(steps)]
    return out


def _candidates(tune: DataFrame, scratch: Scratch) -> dict[str | None, list[np.ndarray]]:
    """For each stratum of tune(stratum, r_*) and each rule the different ones among CANDIDATES exact quantiles, ascending.

    Different values are counted, range partitioned and moved up by the counts of the partitions before, so neither a
    stratum nor a frequent value meets in one task.
    """
    order = ["stratum", "rule", "value"]
    long = tune.select("stratum", F.posexplode(F.array(*[f"r_{r}" for r in RULES])).alias("rule", "value"))
    counted = scratch.save(long.groupBy(*order).agg(F.count("*").alias("k")))
    placed = scratch.save(counted.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("part").agg(F.sum("k").alias("k")).select("part", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("start"))
    through = F.sum("k").over(Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    ranked = scratch.save(placed.withColumn("through", through).join(F.broadcast(starts), "part").select(*order, "k", (F.col("start") + F.col("through")).alias("end")))
    wanted = {}
    for g in ranked.groupBy("stratum", "rule").agg(F.min(F.col("end") - F.col("k")).alias("first"), F.sum("k").alias("size")).collect():  # strata x rules
        at = np.linspace(0.5, 1, CANDIDATES) * (g["size"] - 1)
        wanted[g.stratum, g.rule] = (g["first"] + np.floor(at).astype(int), g["first"] + np.ceil(at).astype(int), at - np.floor(at))
    ranks = [(s, r, sorted({int(n) for n in (*lo, *hi)})) for (s, r), (lo, hi, _) in wanted.items()]
    types = T.StructType([T.StructField("of", STR), T.StructField("by", INT), T.StructField("ranks", T.ArrayType(LONG))])
    shared = F.broadcast(tune.sparkSession.createDataFrame(ranks, types))  # a row per stratum and rule
    met = ranked.join(shared, ranked.stratum.eqNullSafe(shared["of"]) & (ranked.rule == shared["by"]))
    hit = F.filter("ranks", lambda n: (n < F.col("end")) & (n >= F.col("end") - F.col("k")))
    value = {n: r.value for r in met.select("value", hit.alias("hit")).where(F.size("hit") > 0).collect() for n in r.hit}  # 2 * CANDIDATES each
    out = defaultdict(lambda: [np.zeros(0)] * len(RULES))
    for (s, r), (lo, hi, part) in wanted.items():
        a, b = (np.array([value[int(n)] for n in x]) for x in (lo, hi))
        out[s][r] = np.unique(a + (b - a) * part)
    return out


def cutoffs(known: DataFrame, scratch: Scratch, risk: float = RISK, delta: float = DELTA) -> dict[str | None, list[float]]:
    """Cutoffs by stratum and rule from all rows of a saved known(h, stratum, quality, r_*); the driver sees numbers for each stratum and rule."""
    strata = [r.stratum for r in known.select("stratum").distinct().collect()]
    limit, level = _levels(len(strata), risk, delta)
    steps = _candidates(known.where("h % 2 = 0"), scratch)
    rows = [(s, *[[float(c) for c in x] for x in steps[s]]) for s in strata]
    types = T.StructType([T.StructField("of", STR), *[T.StructField(f"s_{r}", T.ArrayType(DBL)) for r in RULES]])
    shared = F.broadcast(known.sparkSession.createDataFrame(rows, types))  # a row per stratum
    good = known.where("h % 2 = 1 AND quality <> 0").join(shared, known.stratum.eqNullSafe(shared["of"]))
    under = lambda steps, x: F.size(F.filter(steps, lambda c: c < x))
    above = F.array(*[under(f"s_{r}", F.col(f"r_{r}")) for r in RULES])
    hits = good.select("stratum", F.posexplode(above).alias("rule", "above")).groupBy("stratum", "rule", "above").count().collect()
    found = defaultdict(Counter)
    for h in hits:
        found[h.stratum, h.rule][h.above] += h["count"]
    out = {}
    for s in strata:
        out[s] = [_last_passing(x, [sum(k for j, k in found[s, r].items() if j > i) for i in range(len(x))], sum(found[s, r].values()), limit, level) for r, x in enumerate(steps[s])]
    return out


def judge(docs: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA, scratch: Scratch | None = None) -> DataFrame:
    """A row per row of documents(doc_id, text, lang) with its statistics, base_failed, failed_rules and kept.

    labels(doc_id, quality) marks good (1) and bad (0) documents. base_failed: fewer than 50 words, or more than
    half of the words in repeated windows. failed_rules names the calibrated rules that reject it; kept is false
    after either. A null lang is a stratum like any other. Null and empty texts fail the base. Without labels
    all that pass the base are kept. Repeated rows return repeated rows; other columns are ignored; an empty
    table returns no rows.
    """
    scratch = scratch or Scratch(docs.sparkSession, "quality")
    saved = scratch.save(document_stats(docs))
    stats = with_rules(saved)
    marked = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.min("quality").alias("quality"))
    # equal rows of a doc_id count once: copies prove nothing
    own = stats.select("doc_id", "stratum", *[f"r_{r}" for r in RULES]).where("doc_id IS NOT NULL").distinct()
    known = own.join(marked, own.doc_id == marked.id).select(F.abs(F.xxhash64("id", F.lit(3)) % 1024).alias("h"), "stratum", "quality", *[f"r_{r}" for r in RULES])
    found = cutoffs(scratch.save(known), scratch, risk, delta)
    scratch.only(saved)
    rows = [(s, *map(float, c)) for s, c in found.items()] or [("", *[math.inf] * len(RULES))]
    limits = docs.sparkSession.createDataFrame(rows, fields(limit_stratum=STR, **{f"c_{r}": DBL for r in RULES}))
    met = stats.join(F.broadcast(limits), stats.stratum.eqNullSafe(limits.limit_stratum), "left")  # a row per stratum of the sample
    failed = F.filter(F.array(*[F.when(F.col(f"r_{r}") > F.col(f"c_{r}"), F.lit(r)) for r in RULES]), lambda x: x.isNotNull())
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return met.select("doc_id", "stratum", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), failed.alias("failed_rules"), (~base & (F.size(failed) == 0)).alias("kept"))
