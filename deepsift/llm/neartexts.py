"""SimHash near-dedup of texts at an exact Jaccard similarity of their word shingles: the operator of ``simhash`` with wide fingerprints.

Texts with the same words in the same order are one node. A node's fingerprint has BANDS x 46 bits, each the sign of a
sum over the hashes of its distinct shingles. A band is two segments of 23 bits. Each segment is decoded to the Golay
codewords near it, by the sums' sizes where bits are unsure, and a band gives KEYS keys, the likeliest pairs of
codeword indices. At a Jaccard of 0.8 the cosine is 0.889 or more, so a bit differs with a chance of 0.15 or less; the
errors are spread over the segments, and two texts share a key of a band with a chance of 0.31, of some band with
1 - 0.69^BANDS (0.9994). At 0.85 that is 0.99999.

Pairs that share a key are verified in steps: sizes, the first 64 and then all whole words of bits of their fingerprints
(limits that a linked pair is over with a chance under 1e-6), and then the shingles themselves, so a link is never wrong.

A key's nodes are first held against a leader. Keys whose nodes are then not all in one component are looked at again:
with up to ``SMALL`` nodes pair by pair of different components, larger ones within pairs of blocks of their nodes, which
no pair leaves. So a crowded key costs rows in proportion to its members, for each block of them, and no key loses a pair.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LONG, SALTS, Scratch, components, fields, slices
from .golay import LENGTH, soft_keys

WIDTH = 5
#: Two texts are linked if 5 times what they share is 4 times all that they have, or more.
SHARE = (4, 5)
BANDS, KEYS = 20, 4
#: Bits of a segment that may be wrong, and codewords of it.
FLIPS, NEAREST = 4, 4
#: Of the fingerprint's first 64 bits, and of all whole words of it; texts under SHORT shingles have ties among their sums.
RADIUS = 24
WIDE_RADIUS, WIDE_RADIUS_SHORT, SHORT = 192, 228, 24
SMALL = 16
#: So many shingles are summed at once: their ones fit a byte.
PART = 255
#: A task remembers so many nodes.
SEEN = 100_000
_SEGMENTS = 2 * BANDS
_WORDS = -(-_SEGMENTS * LENGTH // 64)
_rng = np.random.default_rng(42)
_FACTORS, _PLACES = (_rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for n in (_WORDS, WIDTH))
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()


def shingles(words: list[bytes]) -> set[tuple[bytes, ...]]:
    """All windows of WIDTH words; of a shorter text the whole of it."""
    if len(words) < WIDTH:
        return {tuple(words)} if words else set()
    return set(zip(*(words[i:] for i in range(WIDTH)), strict=False))


def alike(a: set, b: set) -> bool:
    part, whole = SHARE
    if whole * min(len(a), len(b)) < part * max(len(a), len(b)):
        return False
    both = len(a & b)
    return whole * both >= part * (len(a) + len(b) - both)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    return x ^ (x >> np.uint64(29))


def shingle_hashes(words: list[bytes]) -> np.ndarray:
    """The different shingles of a text with words, ascending."""
    one = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    x = np.zeros(max(1, len(one) - WIDTH + 1), np.uint64)
    for i in range(min(WIDTH, len(one))):
        x += one[i : i + len(x)] * _PLACES[i]
    return np.unique(_mixed(x))


def sums_of(words: list[bytes]) -> tuple[np.ndarray, int]:
    """The signed sums of a text with words, a positive one is a fingerprint bit of 1; and its number of different shingles."""
    x = shingle_hashes(words)
    ones = np.zeros(64 * _WORDS, np.int32)
    for i in range(0, len(x), PART):
        bits = np.unpackbits(_mixed(x[i : i + PART, None] * _FACTORS).view(np.uint8), axis=1)
        ones += np.add.reduce(bits, axis=0, dtype=np.uint8)
    return (2 * ones - len(x)).astype(np.float32), len(x)


def band_keys(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows of sums the keys, and the row of each, ascending."""
    n = len(sums)
    code, worth = soft_keys(sums[:, : _SEGMENTS * LENGTH].reshape(-1, LENGTH), FLIPS, NEAREST)
    code, worth = code.reshape(n, BANDS, 2, NEAREST), worth.reshape(n, BANDS, 2, NEAREST)
    both = (worth[:, :, 0, :, None] + worth[:, :, 1, None, :]).reshape(n, BANDS, -1)
    pair = (code[:, :, 0, :, None] << 12 | code[:, :, 1, None, :]).reshape(n, BANDS, -1)
    best = np.argpartition(-both, KEYS - 1, axis=2)[:, :, :KEYS]
    key = np.take_along_axis(pair, best, 2) | (np.arange(BANDS) << 24)[None, :, None]
    row, *_ = np.nonzero(ok := np.isfinite(np.take_along_axis(both, best, 2)))
    return key[ok], row


KEYED = fields(key=LONG, id=LONG, bits=LONG)
#: A node's number of shingles and words of its fingerprint.
COMPARED = _WORDS - 1
NODES = T.StructType([*fields(id=LONG, size=LONG, **{f"w{i}": LONG for i in range(COMPARED)}).fields, T.StructField("keys", T.ArrayType(LONG, False))])
PRINTS = fields(id=LONG, size=LONG, **{f"w{i}": LONG for i in range(COMPARED)})


def _node(words: list[bytes]) -> int:
    x = xxhash.xxh3_64_intdigest(b" ".join(words))
    return x - (1 << 64) if x >> 63 else x


def _nodes(batches):
    for b in slices(batches, 64):
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([_node(words_of(t)) for t in b.column(2).to_pylist()], pa.int64())], ["doc_id", "h", "id"])


def _keyed(batches):
    seen: set[int] = set()  # copies need their keys once; forgetting some only repeats rows
    for b in slices(batches, 64):
        some = {}
        for words in map(words_of, b.column(0).to_pylist()):
            if words and (i := _node(words)) not in seen:
                seen.add(i)
                some[i] = sums_of(words)
        if len(seen) > SEEN:
            seen.clear()
        if some:
            ids = np.fromiter(some, np.int64, len(some))
            keys, row = band_keys(np.stack([x for x, _ in some.values()]))
            prints = np.packbits(np.stack([x[: 64 * COMPARED] > 0 for x, _ in some.values()]), axis=1, bitorder="little").view(np.int64)
            # of a node the keys stand in one row, so they move once and its fingerprint with them
            lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(ids)))]).astype(np.int32), pa.array(keys))
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array([m for _, m in some.values()], pa.int64()), *map(pa.array, np.ascontiguousarray(prints.T)), lists], NODES.names)


def _alike(batches):
    for b in slices(batches, 64):
        last, own, hit = None, set(), []
        for u, a, t in zip(*(b.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
            if u != last:
                last, own = u, shingles(words_of(a))
            hit.append(alike(own, shingles(words_of(t))))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["u", "v"]).filter(pa.array(hit, pa.bool_()))


def verified(pairs: DataFrame, texts: DataFrame, scratch: Scratch) -> DataFrame:
    """The pairs (u, v) whose texts are alike; the pairs of a u that has many stay spread over SALTS keys."""
    texts = scratch.save(texts)
    pairs = pairs.withColumn("s", F.pmod(F.xxhash64("v"), F.lit(SALTS)))
    first = pairs.select("u", "s").distinct().join(texts.select(F.col("id").alias("u"), F.col("text").alias("a")), "u")
    met = pairs.join(first, ["u", "s"]).join(texts.select(F.col("id").alias("v"), F.col("text").alias("b")), "v")
    return met.select("u", "v", "a", "b").mapInArrow(_alike, fields(u=LONG, v=LONG))


def _close(a: Column | str, b: Column | str) -> Column:
    """The first 64 bits of two fingerprints differ in RADIUS bits at most."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.bit_count(a.bitwiseXOR(b)) <= RADIUS


def _by_key(members: DataFrame, *found) -> DataFrame:
    """members(key, n, id, ...) with aggregates of their key, named and mergeable by min or max; a key of more than BLOCK members stays spread."""
    salted = members.withColumn("s", F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / BLOCK)))
    parts = salted.groupBy("key", "s").agg(*[f(c).alias(name) for name, f, c in found])
    whole = parts.groupBy("key").agg(*[f(name).alias(name) for name, f, _ in found])
    return salted.join(parts.select("key", "s").join(whole, "key"), ["key", "s"]).drop("s")


def _apart(members: DataFrame, edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Members (key, n, id, bits, root) of keys whose members are not all in one component."""
    roots = scratch.save(components(edges, scratch))
    rooted = members.join(roots, members.id == roots.node, "left").select("key", "n", "id", "bits", F.coalesce("root", "id").alias("root"))
    return _by_key(rooted, ("lo", F.min, "root"), ("hi", F.max, "root")).where("lo <> hi").select("key", "n", "id", "bits", "root")


def likely(pairs: DataFrame, prints: DataFrame) -> DataFrame:
    """The pairs whose sizes and whole fingerprints leave a similarity of SHARE possible; prints(id, size, w0, w1, ...)."""
    side = lambda c: prints.select(F.col("id").alias(c), F.struct(*PRINTS.names[1:]).alias(f"{c}_print"))
    met = pairs.join(side("p"), F.col("u") == F.col("p")).join(side("q"), F.col("v") == F.col("q"))
    return met.where(_possible(F.col("p_print"), F.col("q_print"))).select(*pairs.columns)


def _possible(a: Column, b: Column) -> Column:
    """Of two structs with size, w0, w1, ..."""
    part, whole = SHARE
    apart = sum((F.bit_count(a[f"w{i}"].bitwiseXOR(b[f"w{i}"])) for i in range(1, COMPARED)), F.bit_count(a["w0"].bitwiseXOR(b["w0"])))
    least = F.least(a["size"], b["size"])
    return (whole * least >= part * F.greatest(a["size"], b["size"])) & (apart <= F.when(least < SHORT, WIDE_RADIUS_SHORT).otherwise(WIDE_RADIUS))


def links(keyed: DataFrame, prints: DataFrame, texts_of, scratch: Scratch, small: int = SMALL) -> DataFrame:
    """Edges (u, v) between alike nodes that connect all alike nodes of a key.

    texts_of(pairs) gives (id, text); the saved table keyed(key, id, bits) has each id once for a key and is dropped;
    prints(id, size, w0, ...) has the nodes' whole fingerprints.
    """
    found = [F.count("*").alias("n"), F.min(F.struct("id", "bits")).alias("lead"), F.max("id").alias("hi"), F.bit_xor("bits").alias("apart")]
    sizes = scratch.save(keyed.groupBy("key").agg(*found).where("n > 1"))
    # of two members the aggregate has all; most chance meetings end here
    pairs = sizes.where((F.col("n") == 2) & (F.bit_count("apart") <= RADIUS)).select(F.col("lead.id").alias("u"), F.col("hi").alias("v"))
    shared = scratch.save(keyed.join(sizes.where("n > 2").select("key", "n", "lead"), "key"))
    stars = shared.where((F.col("id") != F.col("lead.id")) & _close("bits", "lead.bits"))
    pairs = pairs.unionByName(stars.select(F.col("lead.id").alias("u"), F.col("id").alias("v")))
    pairs = scratch.save(likely(pairs.distinct(), prints))
    scratch.drop(keyed, sizes)
    edges = scratch.save(verified(pairs, texts_of(pairs), scratch))
    left = scratch.save(_apart(shared.select("key", "n", "id", "bits"), edges, scratch))
    scratch.drop(shared)
    if left.isEmpty():
        return edges
    held = scratch.save(left.join(prints, "id"))
    words = PRINTS.names[1:]
    members = held.where(F.col("n") <= small).groupBy("key").agg(F.collect_list(F.struct("id", "bits", "root", *words)).alias("all"))
    near = lambda x: F.filter("all", lambda y: (y["id"] > x["id"]) & (y["root"] != x["root"]) & _close(y["bits"], x["bits"]) & _possible(x, y))
    few = members.select(F.explode(F.flatten(F.transform("all", lambda x: F.transform(near(x), lambda y: F.struct(x["id"].alias("u"), y["id"].alias("v")))))).alias("p")).select("p.u", "p.v")
    few = scratch.save(few.distinct())
    edges = scratch.save(edges.unionByName(verified(few, texts_of(few), scratch)))
    return scratch.save(edges.unionByName(_tiles(held.where(F.col("n") > small), texts_of, scratch)))


#: Members of a crowded key are dealt into blocks of about so many.
BLOCK = 128


def _tiles(left: DataFrame, texts_of, scratch: Scratch) -> DataFrame:
    """Edges (u, v) that connect all alike members of a key that are in different components; left(key, n, id, root, size, w0, ...).

    Two blocks of a key's members, with their texts, are one group: pairs are compared within it, first by
    fingerprints, and no pair leaves it but a forest of links between components.
    """
    ids = left.select("id").distinct()
    texts = scratch.save(texts_of(ids.select(F.col("id").alias("u"), F.col("id").alias("v"))))
    members = left.select("key", "id", "root", "size", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"), F.array(*PRINTS.names[2:]).alias("print"))
    dealt = members.join(texts, "id").withColumn("own", F.pmod(F.xxhash64("id", F.lit(1)), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    tiles = dealt.select("*", other.alias("other")).withColumn("lo", F.least("own", "other")).withColumn("hi", F.greatest("own", "other"))
    return tiles.select("key", "lo", "hi", "own", "id", "root", "size", "print", "text").groupBy("key", "lo", "hi").applyInArrow(_tile, fields(u=LONG, v=LONG))


def _find(parent: dict[int, int], x: int) -> int:
    while (up := parent.setdefault(x, x)) != x:
        parent[x] = x = parent[up]
    return x


def _tile(key, group):
    lo, hi = key[1].as_py(), key[2].as_py()
    own, ids, roots, sizes = (group.column(c).to_numpy() for c in ("own", "id", "root", "size"))
    prints = group.column("print").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(ids), -1)
    texts, sets = group.column("text"), {}
    parent, edges = {}, []
    part, whole = SHARE

    def held(i: int) -> np.ndarray:
        if i not in sets:
            sets[i] = shingle_hashes(words_of(texts[i].as_py()))
        return sets[i]

    def linked(i: int, j: int) -> bool:
        """By hashes, and for what they find by the shingles themselves."""
        a, b = held(i), held(j)
        both = len(np.intersect1d(a, b, assume_unique=True))
        return whole * both >= part * (len(a) + len(b) - both) and alike(*(shingles(words_of(texts[k].as_py())) for k in (i, j)))

    first, second = (range(len(ids)), np.arange(len(ids))) if lo == hi else (np.nonzero(own == lo)[0].tolist(), np.nonzero(own == hi)[0])
    for i in first:
        js = second[second > i] if lo == hi else second
        js = js[roots[js] != roots[i]]
        js = js[whole * np.minimum(sizes[js], sizes[i]) >= part * np.maximum(sizes[js], sizes[i])]
        if len(js):
            apart = np.bitwise_count(prints[js] ^ prints[i]).sum(axis=1, dtype=np.int64)
            for j in js[apart <= np.where(np.minimum(sizes[js], sizes[i]) < SHORT, WIDE_RADIUS_SHORT, WIDE_RADIUS)].tolist():
                a, b = _find(parent, int(roots[i])), _find(parent, int(roots[j]))
                if a != b and linked(i, j):
                    parent[a] = b
                    edges.append((int(ids[i]), int(ids[j])))
    u, v = zip(*edges, strict=True) if edges else ((), ())
    return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})


def keep_first(docs: DataFrame, scratch: Scratch | None = None, small: int = SMALL) -> DataFrame:
    """One row of documents(doc_id, text, ...) for each group of linked texts, the one with the smallest doc_id.

    Groups are components. A null doc_id comes after all others; equal doc_ids are told apart by their text, and rows
    equal in both count as one. Null and empty texts and texts without words are one group. Texts are read whole. An
    empty table returns no rows. Other columns stay as they are, whatever their names.
    """
    scratch = scratch or Scratch(docs.sparkSession, "neartexts")
    names = docs.columns
    docs = docs.toDF(*[f"c{i}" for i in range(len(names))])
    doc_id, text = (F.col(f"c{names.index(c)}") for c in ("doc_id", "text"))
    doc_id, h, text = doc_id.cast("long"), F.xxhash64(text), text.cast("binary").alias("text")
    marked = scratch.save(docs.select(doc_id.alias("doc_id"), h.alias("h"), text).mapInArrow(_nodes, fields(doc_id=LONG, h=LONG, id=LONG)))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "h")).alias("first")
    classes = scratch.save(marked.groupBy("id").agg(first))
    nodes = scratch.save(docs.select(text).mapInArrow(_keyed, NODES).dropDuplicates(["id"]))
    keyed = scratch.save(nodes.select(F.explode("keys").alias("key"), "id", F.col("w0").alias("bits")))
    prints = nodes.select(*PRINTS.names)

    def row_of(wanted: DataFrame, *columns) -> DataFrame:
        """The rows of documents that wanted(__doc, __hash) names."""
        own = docs.select(*columns, doc_id.alias("__id"), h.alias("__h"))
        return own.join(wanted, F.col("__id").eqNullSafe(F.col("__doc")) & (F.col("__h") == F.col("__hash")))

    def texts_of(pairs: DataFrame) -> DataFrame:
        ids = pairs.select(F.explode(F.array("u", "v")).alias("id")).distinct()
        wanted = ids.join(classes, "id").select("id", F.col("first.doc_id").alias("__doc"), F.col("first.h").alias("__hash"))
        return row_of(wanted, text).select("id", "text").dropDuplicates(["id"])

    roots = scratch.save(components(links(keyed, prints, texts_of, scratch, small), scratch))
    rooted = classes.join(roots, classes.id == roots.node, "left").select(F.coalesce("root", "id").alias("root"), "first")
    kept = rooted.groupBy("root").agg(F.min("first").alias("first")).select("first.doc_id", "first.h")
    copies = marked.groupBy("doc_id", "h").agg(F.count("*").alias("n"))
    met = kept.join(copies, kept.doc_id.eqNullSafe(copies.doc_id) & (kept.h == copies.h))
    kept = scratch.save(met.select(kept.doc_id.alias("__doc"), kept.h.alias("__hash"), "n"))
    scratch.only(kept)
    once = row_of(kept.where("n = 1"), *docs.columns).select(*docs.columns)
    several = kept.where("n > 1")
    if not several.isEmpty():
        whole = F.struct(*docs.columns).alias("__row")
        again = row_of(several, *docs.columns).groupBy("__id", "__h").agg(F.first(whole).alias("__row")).select("__row.*")
        once = once.unionByName(again)
    return once.toDF(*names)
