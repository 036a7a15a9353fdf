"""Near-duplicate documents by SimHash fingerprints and Golay-code fuzzy hashing.

Fingerprints are 64 bits, by majority over the XXH64 of all word shingles. Links (at most 2 differing bits)
are found among *distinct* fingerprints only, so copies cost nothing. A fingerprint has three segments of
22, 21 and 21 bits. With 2 errors or fewer, one segment has none and the next one at most 2, so two linked
fingerprints share a key (segment without errors, Golay index near the next segment): 3 to 18 keys each.

Keys found once lead nowhere. A key with up to ``SMALL`` fingerprints is joined and verified pair by pair.
Members of larger ones emit the 65 words within one bit of them: two fingerprints are linked exactly if they
share one, and such a group never has more than 65 members, so a crowded key costs rows in proportion to its
members and loses no link.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LONG, Scratch, components, fields, slices
from .golay import fuzzy_keys

SEED = 42
WIDTHS = (22, 21, 21)
#: Pairs within a key are tried one by one up to so many members; more go the other, equally exact way.
SMALL = 24
_digest = partial(xxhash.xxh64_digest, seed=SEED)


def fingerprint(text: bytes | None, width: int = 3) -> int:
    """The unsigned fingerprint of a whole text in UTF-8; 0 for a text without words or null."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    if len(words) < width:
        hashes = _digest(b" ".join(words))
    else:
        hashes = b"".join(map(_digest, map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False))))
    rows = np.frombuffer(hashes, np.uint8).reshape(-1, 8)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(rows), 1 << 15):
        ones += np.unpackbits(rows[i : i + (1 << 15)], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(rows)).tobytes(), "big")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def with_fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fp) of documents(doc_id, text); fp is the fingerprint as a signed long."""

    def run(batches):
        for b in slices(batches):
            prints = pa.array([_signed(fingerprint(t, width)) for t in b.column(1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), prints], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, fields(doc_id=LONG, fp=LONG))


def _keys(batches):
    for b in batches:
        fp = b.column(0).to_numpy(zero_copy_only=False)
        word, segments, at = fp.view(np.uint64), [], 64
        for w in WIDTHS:
            at -= w
            segments.append((word >> np.uint64(at) & np.uint64((1 << w) - 1)).astype(np.int64))
        for i, own in enumerate(segments):
            j = (i + 1) % 3
            near = fuzzy_keys(segments[j], WIDTHS[j])
            row, col = np.nonzero(near >= 0)
            key = (i << 40) | (own[row] << 12) | near[row, col]
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[row])], ["key", "fp"])


def links(prints: DataFrame, scratch: Scratch, small: int = SMALL) -> DataFrame:
    """Edges (u, v) between distinct fingerprints(fp) that connect all pairs at 2 or fewer differing bits.

    Every edge is a pair at that distance; a pair at that distance has an edge or a path of edges.
    """
    keyed = scratch.save(prints.select("fp").mapInArrow(_keys, fields(key=LONG, fp=LONG)))
    sizes = keyed.groupBy("key").count().where("count > 1")
    shared = scratch.save(keyed.join(sizes, "key"))
    lists = shared.where(F.col("count") <= small).groupBy("key").agg(F.sort_array(F.collect_list("fp")).alias("fps"))
    u, v = F.col("u"), F.col("v")
    pairs = (
        lists.select("fps", F.explode("fps").alias("u"))
        .select("u", F.explode(F.filter("fps", lambda x: (x > u) & (F.bit_count(x.bitwiseXOR(u)) <= 2))).alias("v"))
        .select("u", "v")
    )
    crowded = shared.where(F.col("count") > small).select("fp").distinct()
    near = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(_signed(1 << b))) for b in range(64)])
    middles = crowded.select("fp", F.explode(near).alias("mid")).groupBy("mid").agg(F.sort_array(F.collect_list("fp")).alias("fps")).where(F.size("fps") > 1)
    stars = middles.select(F.element_at("fps", 1).alias("u"), F.explode("fps").alias("v")).where(u < v)
    return pairs.unionByName(stars)


def near_duplicates(docs: DataFrame, width: int = 3, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for each row of documents(doc_id, text).

    Texts that are null, empty or without words have fingerprint zero and link like any other. Repeated rows
    return repeated rows; a null doc_id stays null and is never a component_id unless its whole component has
    none. An empty table returns no rows. Other columns are ignored, whatever their names.
    """
    scratch = scratch or Scratch(docs.sparkSession, "simhash")
    marked = scratch.save(with_fingerprints(docs, width))
    classes = scratch.save(marked.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = scratch.save(components(links(classes, scratch), scratch))
    rooted = classes.join(roots, classes.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    rooted = scratch.save(rooted)
    heads = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    heads = scratch.save(rooted.select("fp", "root").join(heads, "root").select("fp", "component_id"))
    scratch.only(marked, heads)
    return marked.join(heads, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
