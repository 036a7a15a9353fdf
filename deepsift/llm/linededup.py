"""Lines that several documents share, dropped from all but the first, by sharded minimal perfect hashes.

1. Each document gives the 128-bit hashes of its distinct line keys; nothing below this sees a line's text.
2. One aggregation counts each distinct hash and finds its smallest doc_id (copies meet before the shuffle).
3. Hashes are dealt into shards of about SHARD_KEYS. A shard becomes one row: a minimal perfect hash that
   indexes an array of 32-bit fingerprints, one of saturating 8-bit counts, and owners of what is repeated.
4. A document's hashes go to their shard and probe its arrays as a stream; the shard is in memory, they are
   not. A shard with more than HOT_LEAST and 1/HOT of all probes (a very frequent line) has copies for parts of its probes;
   there are at most HOT such shards, whatever the input.
5. Documents meet the hashes that they lose and drop those lines.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BIN, INT, LONG, Scratch, fields, slices
from .mphf import PerfectHash

MIN_CHARS = 10
SHARD_KEYS = 50_000
HOT = 512
#: A shard has copies for parts of its probes only above so many.
HOT_LEAST = 4 * SHARD_KEYS
#: Stands for "no document" among owners.
NOBODY = (1 << 63) - 1


def line_key(line: bytes, least: int = MIN_CHARS) -> bytes | None:
    """The hash of a line's key, None for keys of fewer than ``least`` code points."""
    key = line.strip()
    if len(key) < least or len(key) < 4 * least and len(key.decode()) < least:
        return None
    return xxhash.xxh3_128_digest(key.lower())


def _halves(digests: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(digests), "<u8").reshape(-1, 2)
    return both[:, 0].view(np.int64), both[:, 1].view(np.int64)


def line_hashes(docs: DataFrame, least: int = MIN_CHARS) -> DataFrame:
    """(h1, h2, doc_id, own): the distinct keys of each row of documents(doc_id, text); own is a hash of the text."""

    def run(batches):
        for b in slices(batches):
            found, digests = [], []
            for t in b.column(2).to_pylist():
                keys = {line_key(x, least) for x in t.split(b"\n")} - {None} if t else ()
                digests.extend(keys)
                found.append(len(keys))
            h1, h2 = _halves(digests)
            row = pa.array(np.repeat(np.arange(len(found)), found))
            yield pa.RecordBatch.from_arrays([pa.array(h1), pa.array(h2), b.column(0).take(row), b.column(1).take(row)], PROBES.names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("own"), F.col("text").cast("binary").alias("text")).mapInArrow(run, PROBES)


PROBES = fields(h1=LONG, h2=LONG, doc_id=LONG, own=LONG)


INDEX = fields(shard=LONG, probes=LONG, sizes=T.ArrayType(INT), bits=BIN, prints=BIN, counts=BIN, owners=BIN)


def _shard(key, group):
    h1, h2, n, owner = (group.column(c).to_numpy() for c in ("h1", "h2", "n", "owner"))
    made = PerfectHash.build(h1.view(np.uint64), h2.view(np.uint64))
    at = made.slot(h1.view(np.uint64), h2.view(np.uint64))
    prints, counts, owners = np.zeros(len(at), np.uint32), np.zeros(len(at), np.uint8), np.zeros(len(at), np.int64)
    prints[at], counts[at], owners[at] = h2.view(np.uint64).astype(np.uint32), np.minimum(n, 255), owner
    row = {"shard": [key[0].as_py()], "probes": [int(n.sum())], "sizes": [made.sizes], "bits": [made.packed], "prints": [prints.tobytes()], "counts": [counts.tobytes()], "owners": [owners[counts > 1].tobytes()]}
    return pa.Table.from_pydict(row, schema=pa.schema([("shard", pa.int64()), ("probes", pa.int64()), ("sizes", pa.list_(pa.int32())), ("bits", pa.binary()), ("prints", pa.binary()), ("counts", pa.binary()), ("owners", pa.binary())]))


class Shard:
    """One shard's arrays, ready to be probed."""

    def __init__(self, row: dict):
        self.hash = PerfectHash(row["sizes"], row["bits"])
        self.prints = np.frombuffer(row["prints"], np.uint32)
        self.repeated = np.frombuffer(row["counts"], np.uint8) > 1
        self.owners = np.frombuffer(row["owners"], np.int64)
        self.owner_at = np.cumsum(self.repeated) - 1

    def lost(self, h1: np.ndarray, h2: np.ndarray, ids: np.ndarray, known: np.ndarray) -> np.ndarray:
        """True where another document with a smaller doc_id holds the line; known: doc_id is not null."""
        at = self.hash.slot(h1.view(np.uint64), h2.view(np.uint64))
        hit = (at >= 0) & (self.prints[at] == h2.view(np.uint64).astype(np.uint32)) & self.repeated[at]
        out = np.zeros(len(at), bool)
        owner = self.owners[self.owner_at[at[hit]]]
        out[hit] = (owner != NOBODY) & ((ids[hit] > owner) | ~known[hit])
        return out


def _probe(batches):
    """Over rows sorted by shard, its arrays first."""
    shard, number = None, None
    for b in batches:
        numbers = b.column("shard").to_numpy()
        heads = np.nonzero(b.column("probe").to_numpy(zero_copy_only=False) == 0)[0]
        cuts = np.unique(np.concatenate([[0], heads, heads + 1, np.nonzero(np.diff(numbers))[0] + 1, [len(numbers)]]))
        ids, owns, drops = [], [], []
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            if not b.column("probe")[int(lo)].as_py():
                shard, number = Shard(b.slice(lo, 1).to_pylist()[0]), numbers[lo]
                continue
            if number != numbers[lo]:
                raise RuntimeError("probes came without the arrays of their shard")
            part = b.slice(lo, hi - lo)
            h1, h2 = part.column("h1").to_numpy(), part.column("h2").to_numpy()
            known = part.column("doc_id").is_valid().to_numpy(zero_copy_only=False)
            lost = shard.lost(h1, h2, part.column("doc_id").fill_null(0).to_numpy(), known)
            ids.append(part.column("doc_id").filter(pa.array(lost)))
            owns.append(part.column("own").filter(pa.array(lost)))
            raw = np.stack([h1[lost], h2[lost]], axis=1).tobytes()
            drops.extend(raw[i : i + 16] for i in range(0, len(raw), 16))
        if ids:
            yield pa.RecordBatch.from_arrays([pa.concat_arrays(ids), pa.concat_arrays(owns), pa.array(drops, pa.binary())], LOST.names)


LOST = fields(doc_id=LONG, own=LONG, line=BIN)


def lost_lines(docs: DataFrame, least: int = MIN_CHARS, scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, own, line): the 16-byte hashes of line keys that a text has to lose; own is its hash."""
    scratch = scratch or Scratch(docs.sparkSession, "lines")
    probes = scratch.save(line_hashes(docs, least))
    distinct = scratch.save(probes.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.coalesce(F.min("doc_id"), F.lit(NOBODY)).alias("owner")))
    shards = max(1, -(-distinct.count() // SHARD_KEYS))
    shard = F.pmod("h1", F.lit(shards)).alias("shard")
    index = scratch.save(distinct.select(shard, "h1", "h2", "n", "owner").groupBy("shard").applyInArrow(_shard, INDEX))
    total = index.agg(F.sum("probes")).first()[0] or 0
    share = max(HOT_LEAST, total // HOT)
    parts = F.ceil(F.col("probes") / share).cast("int")
    hot = scratch.save(index.where(F.col("probes") > share).select("shard", parts.alias("parts")))
    hot = F.broadcast(hot)  # at most HOT rows
    dealt = probes.select(shard, *PROBES.names).join(hot, "shard", "left")
    salt = F.pmod(F.xxhash64("doc_id", "h1"), F.coalesce("parts", F.lit(1))).cast("int")
    arrays = [f.name for f in INDEX.fields[2:]]
    dealt = dealt.select("shard", salt.alias("salt"), F.lit(1).alias("probe"), *PROBES.names, *[F.lit(None).cast(INDEX[a].dataType).alias(a) for a in arrays])
    copies = F.explode(F.sequence(F.lit(0), parts - 1))
    nothing = [F.lit(None).cast("long").alias(c) for c in PROBES.names]
    heads = index.select("shard", F.when(F.col("probes") > share, parts).otherwise(1).alias("parts"), *arrays)
    heads = heads.select("shard", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt"), F.lit(0).alias("probe"), *nothing, *arrays)
    met = heads.unionByName(dealt).repartition("shard", "salt").sortWithinPartitions("shard", "salt", "probe")
    return met.mapInArrow(_probe, LOST)


def dedup_lines(docs: DataFrame, least: int = MIN_CHARS, scratch: Scratch | None = None) -> DataFrame:
    """documents(doc_id, text, ...) with the text that is left, n_lines and n_dropped; other columns stay as they are.

    Keys are lines without white space at both ends, A-Z folded; a key of ``least`` code points or more that
    several doc_ids hold stays in the smallest alone, with all its repeats there. A null text stays null and
    counts as one empty line, like an empty one. A null doc_id is larger than any other; if all that hold a
    line are null, it stays. Rows that repeat a doc_id count as one document. Columns of the input that are
    called n_lines or n_dropped are replaced. An empty table returns no rows.
    """
    scratch = scratch or Scratch(docs.sparkSession, "lines")
    # a list is never longer than the lines of one text, however many rows share its id
    lost = scratch.save(lost_lines(docs, least, scratch).groupBy("doc_id", "own").agg(F.collect_set("line").alias("lines")))
    scratch.only(lost)
    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    text_at = names.index("text")
    plain = docs.select(*[docs[c].alias(f"c{i}") for i, c in enumerate(names)])
    own = F.col(f"c{names.index('doc_id')}").cast("long")
    met = plain.join(lost, own.eqNullSafe(lost.doc_id) & (F.xxhash64(f"c{text_at}") == lost.own), "left").drop("doc_id", "own")

    def run(batches):
        for b in slices(batches):
            texts, lines, dropped = [], [], []
            for t, gone in zip(b.column(text_at).to_pylist(), b.column(len(names)).to_pylist(), strict=True):
                rows = (t or "").split("\n")
                if gone:
                    gone = set(gone)
                    kept = [x for x in rows if line_key(x.encode(), least) not in gone]
                    t = "\n".join(kept)
                    dropped.append(len(rows) - len(kept))
                else:
                    dropped.append(0)
                texts.append(t)
                lines.append(len(rows))
            columns = list(b.columns[: len(names)])
            columns[text_at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())], [*[f"c{i}" for i in range(len(names))], "n_lines", "n_dropped"])

    schema = T.StructType([*plain.schema.fields, T.StructField("n_lines", LONG), T.StructField("n_dropped", LONG)])
    return met.mapInArrow(run, schema).toDF(*names, "n_lines", "n_dropped")
