"""Mixing sources to target weights by the cube method.

A source whose target is r times its size takes each document floor(r) times, and once more for a sample with
inclusion probability r - floor(r). The sample is balanced by the cube method on words and on documents: a
random walk in the null space of the constraints that ends when probabilities are 0 or 1. The flight runs on
blocks of about BLOCK documents at a time, each leaving fewer than three undecided; those meet in the next
round's blocks until a source has one block, where the last few land on the nearest totals. Only doc_id,
source and size move.
"""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import DBL, INT, LONG, STR, Scratch, fields

WEIGHTS = (1, 2, 3)
CAP = 3
BLOCK = 4096
#: So many undecided documents of a source land together.
LAST = 12
#: One row per source comes to the driver; more sources than this are an error, not a silent cut.
MAX_SOURCES = 1_000_000
#: Plans of so many sources are broadcast; those of more meet their rows by a shuffle.
BROADCAST_SOURCES = 10_000
_EPS = 1e-9


def source_targets(sizes: dict[str | None, int], weights=WEIGHTS, cap: int = CAP) -> dict[str | None, Fraction]:
    """Targets that share all sizes by weight, none above cap times its source's size; the excess is shared again."""
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, out = sum(sizes.values()), {}
    open_, left = list(order), Fraction(total)
    while open_:
        share = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if share * weight[s] > cap * sizes[s]]
        if not full:
            return out | {s: share * weight[s] for s in open_}
        for s in full:
            out[s] = Fraction(cap * sizes[s])
            left -= out[s]
        shut = set(full)
        open_ = [s for s in open_ if s not in shut]
    return out


def _step(p: list[float], x: list[float], rng) -> None:
    """Move three probabilities along the null space of (x, 1) until one is 0 or 1; in place."""
    u = (x[1] - x[2], x[2] - x[0], x[0] - x[1])
    if not any(u):
        u = (1.0, -1.0, 0.0)
    up = min((1 - q) / d if d > 0 else q / -d for q, d in zip(p, u, strict=True) if d)
    down = min(q / d if d > 0 else (1 - q) / -d for q, d in zip(p, u, strict=True) if d)
    move = up if rng.random() * (up + down) < down else -down
    for i in range(3):
        q = p[i] + move * u[i]
        p[i] = 0.0 if q < _EPS else 1.0 if q > 1 - _EPS else q


def flight(prob: np.ndarray, size: np.ndarray, rng, keep: int = 2) -> np.ndarray:
    """Fast flight phase: all but at most ``keep`` (2 or more) probabilities become 0 or 1; sums of prob and prob * size stay."""
    out = prob.copy()
    todo = [i for i in range(len(out)) if _EPS < out[i] < 1 - _EPS]
    live, at = todo[:3], 3
    while len(live) == 3 and 3 + len(todo) - at > keep:
        p = [float(out[i]) for i in live]
        _step(p, [float(size[i]) for i in live], rng)
        for i, q in zip(live, p, strict=True):
            out[i] = q
        live = [i for i in live if 0 < out[i] < 1]
        while len(live) < 3 and at < len(todo):
            live.append(todo[at])
            at += 1
    return out


def landing(prob: np.ndarray, size: np.ndarray, rest: float) -> np.ndarray:
    """Decide the last probabilities, LAST at most, so that the chosen sizes come nearest to ``rest``, then their number to its own."""
    at = np.nonzero((prob > 0) & (prob < 1))[0]
    out = prob.copy()
    ways = (np.arange(1 << len(at))[:, None] >> np.arange(len(at)) & 1).astype(np.int64)
    off = np.abs(ways @ size[at] - rest)
    number = np.abs(ways.sum(axis=1) - prob[at].sum())
    out[at] = ways[np.lexsort((np.arange(len(ways)), number, off))[0]]
    return out


def _walk(seed: int, level: int):
    def run(group: pa.Table) -> pa.Table:
        h, k = (group.column(c).to_numpy().view(np.uint64) for c in ("text_hash", "k"))
        order = np.lexsort((k, h, (h ^ (k * _ODD) ^ np.uint64(level)) * _ODD))
        group = group.take(pa.array(order))
        prob, size = (group.column(c).to_numpy().astype(np.float64) for c in ("more", "size"))
        rng = np.random.default_rng([seed, level, int(h[order[0]] & np.uint64(0x7FFFFFFF)), len(order)])
        last = group.column("_last")[0].as_py()
        out = flight(prob, size, rng, LAST if last else 2)
        if last:
            # earlier rounds keep the source's expected sum, so what this block has to reach is its own
            out = landing(out, size, float((prob * size).sum() - (size * (out == 1)).sum()))
        at = group.schema.get_field_index("more")
        return group.set_column(at, "more", pa.array(out, pa.float64())).select(WALK.names)

    return run


#: Rows equal in all are numbered in runs of so many.
RUN = 100_000
WALK = fields(doc_id=LONG, source=STR, text_hash=LONG, k=LONG, size=LONG, source_size=LONG, target=DBL, whole=INT, part=DBL, rest=DBL, n=LONG, more=DBL)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def text_hash(docs: DataFrame) -> Column:
    """What tells rows of one doc_id apart: a hash of doc_id and text."""
    return F.xxhash64(docs["doc_id"].cast("long"), docs["text"])


def _sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, text_hash, size and k: rows equal in all are counted, then numbered, so none depends on where it was read."""
    words = F.size(F.expr(r"regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+', 0)"))
    keys = ["doc_id", "source", "text_hash", "size"]
    rows = docs.select("text", docs["doc_id"].cast("long").alias("doc_id"), docs["source"].cast("string").alias("source"), text_hash(docs).alias("text_hash"))
    rows = rows.select("doc_id", "source", "text_hash", words.cast("long").alias("size"))
    classes = rows.groupBy(*keys).agg(F.count("*").alias("m"))
    starts = classes.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1, F.lit(RUN).cast("long"))).alias("at"))
    return starts.select(*keys, F.explode(F.sequence("at", F.least(F.col("at") + RUN, F.col("m")) - 1)).alias("k"))


def mix(docs: DataFrame, weights=WEIGHTS, cap: int = CAP, seed: int = 7, block: int = BLOCK, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, source, text_hash, size, source_size, target, copies and taken (copies * size) of documents(doc_id, text, source).

    Sizes are words; null and empty texts have none and are taken 0 words whatever their copies. Sources stand
    by code point with null last, weigh ``weights`` by turns, and share all words. Copies are at most ``cap``.
    The same input gives the same result: blocks, the order in a block and the walk follow hashes of doc_id and text,
    and rows equal in doc_id, source and text are numbered and spread. Other columns are ignored; an empty table
    returns no rows.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "mix")
    sized = scratch.save(_sized(docs))
    sums = sized.groupBy("source").agg(F.sum("size").alias("words"), F.count("*").alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(sums) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    targets = source_targets({r.source: r.words for r in sums}, weights, cap)
    plan = []
    for r in sums:
        rate = targets[r.source] / r.words if r.words else Fraction(0)
        whole = min(cap, math.floor(rate))
        plan.append((r.source, r.words, float(targets[r.source]), whole, float(rate - whole), float(targets[r.source] - whole * r.words), r.n))
    plans = spark.createDataFrame(plan, fields(plan_source=STR, source_size=LONG, target=DBL, whole=INT, part=DBL, rest=DBL, n=LONG))
    few = F.broadcast(plans) if len(plan) <= BROADCAST_SOURCES else plans  # a row per source
    met = sized.join(few, sized.source.eqNullSafe(plans.plan_source)).drop("plan_source")
    level, most = 0, max((r.n for r in sums), default=0)
    now = scratch.save(met.select(*WALK.names[:-1], F.col("part").alias("more")))
    final, read = [], [now]
    while True:
        blocks = F.greatest(F.lit(1), F.ceil(F.col("n") / F.lit(float(block) * (block // 4) ** level)))
        last = most <= block * (block // 4) ** level
        one = F.lit(last)
        number = F.pmod(F.xxhash64(F.lit(seed), F.lit(level), "text_hash", "k"), blocks)
        walked = now.where("more > 0 AND more < 1").withColumn("_b", number).withColumn("_last", one)
        done = scratch.save(walked.groupBy("source", "_b").applyInArrow(_walk(seed, level), WALK))
        final.append(now.where("NOT (more > 0 AND more < 1)") if level == 0 else None)
        read.append(done)
        final.append(done.where("NOT (more > 0 AND more < 1)"))
        if last:
            break
        now = done.where("more > 0 AND more < 1")
        level += 1
    scratch.only(*read)
    out = None
    for part in final:
        if part is not None:
            out = part if out is None else out.unionByName(part)
    copies = F.least(F.lit(cap), F.col("whole") + F.col("more").cast("int"))
    return out.select("doc_id", "source", "text_hash", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, scratch: Scratch | None = None, **options) -> DataFrame:
    """documents(doc_id, text, source, ...), each row as often as ``mix`` with the same options takes it.

    Rows equal in doc_id, source and text count as one that is taken as often as they are together. Null and empty
    texts are taken like any other of their source. Other columns stay, whatever their names; an empty table
    returns no rows. Whole rows move once, to meet their count.
    """
    scratch, names = scratch or Scratch(docs.sparkSession, "mixed"), docs.columns
    plan = mix(docs, scratch=scratch, **options).groupBy("doc_id", "source", "text_hash").agg(F.sum("copies").alias("times"), F.count("*").alias("rows"))
    plan = scratch.save(plan.where("times > 0").toDF("p_id", "p_source", "p_hash", "times", "rows"))
    own = [docs[c].alias(f"c{i}") for i, c in enumerate(names)]
    rows = docs.select(*own, docs["doc_id"].cast("long").alias("id"), docs["source"].cast("string").alias("of"), text_hash(docs).alias("h"))
    plain = [f"c{i}" for i in range(len(names))]

    def met(plan: DataFrame) -> DataFrame:
        return rows.join(plan, (rows.h == plan.p_hash) & rows.id.eqNullSafe(plan.p_id) & rows["of"].eqNullSafe(plan.p_source))

    scratch.only(plan)
    out, several = met(plan.where("rows = 1")).select(*plain, "times"), plan.where("rows > 1")
    if not several.isEmpty():
        again = met(several).groupBy("p_id", "p_source", "p_hash").agg(F.first(F.struct(*plain)).alias("row"), F.first("times").alias("times"))
        out = out.unionByName(again.select("row.*", "times"))
    return out.select(*plain, F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).select(*plain).toDF(*names)
