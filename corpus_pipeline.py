"""A corpus pipeline: language, lines, near duplicates, mixture, packing; each stage works on all the one before kept.

A stage keeps all columns of its input, whatever their names, and an empty table stays empty. Null and repeated
doc_ids are documents like others unless a stage says otherwise; texts are taken whole.
"""

from __future__ import annotations

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deepsift.llm import langid, linededup, mixing, neartexts, packing
from deepsift.llm.common import Scratch, slices, table

TOKENIZER = "word_bpe_49k.json"


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a letter and is near enough to some language's centroid; a row decides for itself.

    Null and empty texts have no letter and go.
    """
    model = langid.learn(docs)
    shared = spark.sparkContext.broadcast(model)  # a fixed number of centroids for each language

    def run(batches):
        for b in slices(batches):
            keep = [not rejected for _, _, rejected in shared.value.predict(b.column("text").to_pylist())]
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that other documents hold too are gone from all but the first; n_chars follows the text.

    Rows of one doc_id are one document; a null doc_id comes after all others. A null text stays null.
    """
    own = {c: f"__own_{c}" for c in ("n_lines", "n_dropped") if c in docs.columns}
    kept = linededup.dedup_lines(docs.withColumnsRenamed(own))
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return kept.drop(*own).withColumnsRenamed({v: k for k, v in own.items()}).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group stays; texts are linked from a five-word Jaccard of 0.8 on.

    A null doc_id comes after all others, texts without words are one group, and rows equal in doc_id and text are one.
    """
    return neartexts.keep_first(docs, Scratch(spark, "near"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture takes it.

    A null source is one of its own, the last. Rows equal in doc_id, source and text are taken together.
    """
    return mixing.mixed(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 4096 tokens; a null or empty text is the end token alone."""
    return packing.pack(docs, public_tokenizers.path(TOKENIZER))


STAGES = [("language", language), ("lines", lines), ("near_duplicates", near_duplicates), ("mixture", mixture), ("packing", packed)]

#: Centroids, shingle components, the cube's walk and column generation are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir))
        scratch.only(docs)
    return STAGES[-1][1](spark, docs, sf_dir)
