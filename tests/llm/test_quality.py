"""Cutoffs from all labels against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from deepsift.llm import common, quality


def test_cutoffs_of_all_rows(spark):
    rng = random.Random(6)
    rows = []
    for i in range(30_000):
        good = int(rng.random() < 0.7)
        values = [rng.random() + (1 - good) * rng.choice([0, 2]), rng.choice([0.0, 0.0, 0.1, 0.5]), 0.0, round(rng.random(), 2), rng.expovariate(3), rng.gauss(5, 1)]
        rows.append((rng.randrange(1024), rng.choices(["en", "fr", None, "es"], [60, 25, 14, 1])[0], good, *values))
    known = spark.createDataFrame(rows, "h long, stratum string, quality int, " + ", ".join(f"r_{r} double" for r in quality.RULES)).repartition(6)
    scratch = common.Scratch(spark, "t")
    got = quality.cutoffs(scratch.save(known), scratch)
    want = quality.choose_cutoffs([(h, s, q, tuple(v)) for h, s, q, *v in rows])
    assert set(got) == set(want) and all(got[s] == pytest.approx(want[s]) for s in want)
    assert got["en"][0] < 2.2 and got["fr"][0] < 2.2


def test_all_labels_count_and_a_minority_gets_cutoffs(spark):
    """es has 5 % of 120,000 labels: 3,000 of them are in the holdout, of a sample of 50,000 only 1,250."""
    n = F.col("id")
    lang = F.when(n % 20 == 0, "es").when(n % 20 < 7, "de").when(n % 20 < 14, "fr").otherwise("en")
    bad = F.pmod(F.xxhash64("id"), F.lit(10)) == 0
    text = F.when(bad, "# # # some words").otherwise("some plain words of a text")
    docs = spark.range(120_000).select(n.alias("doc_id"), text.alias("text"), lang.alias("lang"))
    labels = spark.range(120_000).select(n.alias("doc_id"), (~bad).cast("int").alias("quality"))
    got = quality.judge(docs, labels)
    failed = {r.stratum: r.n for r in got.where(F.array_contains("failed_rules", "symbols")).groupBy("stratum").agg(F.count("*").alias("n")).collect()}
    want = {r.lang: r.n for r in docs.where("text LIKE '#%'").groupBy("lang").agg(F.count("*").alias("n")).collect()}
    assert failed == want


def test_copies_of_a_labelled_document_count_once(spark):
    """A good document with symbols, a quarter of all rows and in the holdout, does not undo the rule that rejects the bad ones."""
    n = F.col("id")
    bad = F.pmod(F.xxhash64("id"), F.lit(10)) == 0
    docs = spark.range(30_000).select(n.alias("doc_id"), F.when(bad, "# # # some words").otherwise("some plain words of a text").alias("text"), F.lit("en").alias("lang"))
    odd = spark.range(30_000).where(~bad).where(F.abs(F.xxhash64("id", F.lit(3))) % 2 == 1).agg(F.min("id")).first()[0]
    hot = spark.range(10_000).select(F.lit(odd).cast("long").alias("doc_id"), F.lit("# # # # a good one").alias("text"), F.lit("en").alias("lang"))
    labels = spark.range(30_000).select(n.alias("doc_id"), (~bad).cast("int").alias("quality"))
    got = quality.judge(docs.unionByName(hot), labels).where("doc_id <> %d" % odd)
    assert got.where(F.array_contains("failed_rules", "symbols")).count() == docs.where("text LIKE '#%'").count() > 0
