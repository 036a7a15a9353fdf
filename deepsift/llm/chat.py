"""Logged conversations without those that longer ones begin with, rendered for training; Spark functions only.

A log that writes a conversation after every turn holds each of its prefixes. Two rolling 64-bit hashes over
numbers, roles and texts of turns name every prefix. Equal conversations collapse to the smallest conv_id by an aggregation that
combines before its shuffle; proper prefixes of what is left, made distinct, are removed by an anti-join on
(length, hashes), where a key is there once on either side. Texts meet only within their own conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch

START, END = "<|im_start|>", "<|im_end|>"


def _rolled(log: DataFrame) -> DataFrame:
    """conv_id, n (the turn's number from 1), role, text, h1, h2: the hashes of all turns up to this one, in one pass over sorted turns."""
    told = log.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    through = order.rowsBetween(Window.unboundedPreceding, 0)
    numbered = told.withColumn("n", F.row_number().over(order))
    h1, h2 = F.xxhash64("n", "role", "text"), F.xxhash64(F.lit(1), "text", "n", "role")
    return numbered.select("conv_id", "n", "role", "text", F.bit_xor(h1).over(through).alias("h1"), F.bit_xor(h2).over(through).alias("h2"))


def render(turns: Column) -> Column:
    """Turns between markers; a marker's opening ``<|`` within a text is parted by a space."""
    plain = lambda c: F.replace(c, F.lit("<|"), F.lit("< |"))
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(START), plain(t["role"]), F.lit("\n"), plain(t["text"]), F.lit(END + "\n"))), "")


def maximal_conversations(log: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """conv_id, n_turns, n_copies (conversations equal to it, itself included) and rendered of log(conv_id, turn, role, text).

    Turns stand in the order of turn (nulls first), then role and text; null roles and texts count as empty,
    and a null conv_id is a conversation of its own. A conversation goes if a longer one begins with all its
    turns or if an equal one has a smaller conv_id (a null one is smallest). Other columns are ignored; an
    empty log returns no rows.
    """
    scratch = scratch or Scratch(log.sparkSession, "chat")
    turns = F.sort_array(F.collect_list(F.struct("n", "role", "text", "h1", "h2")))
    whole = _rolled(log).groupBy("conv_id").agg(turns.alias("turns"))
    last = F.element_at("turns", -1)
    hashes, plain = F.transform("turns", lambda x: F.struct(x["h1"].alias("h1"), x["h2"].alias("h2"))), F.transform("turns", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text")))
    hashed = scratch.save(whole.select("conv_id", last["n"].alias("n"), plain.alias("turns"), hashes.alias("hashes"), last["h1"].alias("h1"), last["h2"].alias("h2")))
    # min_by with a struct keeps null ids smallest
    first = F.min(F.struct("conv_id")).alias("id")
    heads = hashed.groupBy("n", "h1", "h2").agg(first, F.count("*").alias("n_copies")).select("n", "h1", "h2", F.col("id.conv_id").alias("conv_id"), "n_copies")
    # of equal conversations one array of hashes is enough
    inner = F.explode(F.expr("transform(slice(hashes, 1, n - 1), (x, i) -> struct(i + 1 AS n, x.h1 AS h1, x.h2 AS h2))"))
    prefixes = hashed.select(inner.alias("p")).select("p.n", "p.h1", "p.h2").distinct()
    kept = scratch.save(heads.join(prefixes, ["n", "h1", "h2"], "left_anti").select("conv_id", "n_copies"))
    scratch.only(hashed, kept)
    kept = kept.withColumnRenamed("conv_id", "kept_id")
    met = hashed.join(kept, hashed.conv_id.eqNullSafe(kept.kept_id))
    return met.select("conv_id", F.col("n").cast("long").alias("n_turns"), "n_copies", render(F.col("turns")).alias("rendered"))
