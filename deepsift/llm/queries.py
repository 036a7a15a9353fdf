"""The ten operators as queries over the driver's tables, with SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, langid, linededup, mixing, packing, quality, segments, sharding, simhash, vectors
from .common import table

TOKENIZER = "word_bpe_49k.json"
SHARDS = 40


def _fold(n: int):
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of the held-out fold are filtered away before the operator sees them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(_fold(5) != 0)
    found = segments.score_documents(docs, segments.learn(docs, labels))
    held = F.coalesce(_fold(5) == 0, F.lit(False))
    return found.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "passages")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed_rules")


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract gives every text with a letter a language; what the operator finds too far is in ``rejected``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.learn(docs.where(_fold(4) != 2))
    held = F.coalesce(_fold(4) == 2, F.lit(False))
    return langid.predict_documents(docs.select("doc_id", "text"), model).select("doc_id", held.alias("held_out"), "lang_pred", "score", "rejected")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = linededup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.maximal_conversations(table(spark, sf_dir, "conversations"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.mix(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "source_size", "target", "taken", "source")


def op9_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit("")).cast("binary")
    rows = table(spark, sf_dir, "documents").select("doc_id", (F.length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    placed = sharding.shards(rows, ["doc_id", "size", "text_crc32"], SHARDS)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_simhash, op2_toxicity, op3_quality, op4_language, op5_packing, op6_line_dedup, op7_chat, op8_mixing, op9_vectors, op10_sharding)
    return {f.__name__: f for f in own}


_CHARS = "chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||' '"

OP6_SQL = f"""
WITH lines AS (
  SELECT doc_id, pos, line,
         translate(trim(line, {_CHARS}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(parts) AS line, unnest(range(1, len(parts) + 1)) AS pos
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents))
), owners AS (
  SELECT k, min(doc_id) AS owner FROM lines WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) > 1
), marked AS (
  SELECT doc_id, pos, line, owner IS NOT NULL AND owner <> doc_id AS gone FROM lines LEFT JOIN owners USING (k)
)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

_ROLE = "replace(coalesce(role, ''), '<|', '< |')"
_TEXT = "replace(coalesce(text, ''), '<|', '< |')"

OP7_SQL = f"""
WITH whole AS (
  SELECT conv_id, count(*) AS n, list(struct_pack(r := coalesce(role, ''), t := coalesce(text, '')) ORDER BY turn, role, text) AS turns,
         string_agg('<|im_start|>' || {_ROLE} || chr(10) || {_TEXT} || '<|im_end|>' || chr(10), '' ORDER BY turn, role, text) AS rendered
  FROM conversations GROUP BY conv_id
), heads AS (
  SELECT turns, n, min(conv_id) AS conv_id, count(*) AS n_copies, any_value(rendered) AS rendered FROM whole GROUP BY turns, n
), prefixes AS (
  SELECT DISTINCT turns[1:k] AS turns FROM (SELECT turns, unnest(range(1, n)) AS k FROM heads)
)
SELECT conv_id, n AS n_turns, n_copies, rendered FROM heads WHERE turns NOT IN (SELECT turns FROM prefixes)
"""


def oracle_sql() -> dict[str, str]:
    return {"op6_line_dedup": OP6_SQL, "op7_chat": OP7_SQL}
