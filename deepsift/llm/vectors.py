"""Near-duplicate embeddings by epsilon grid order.

Unit vectors at cosine c or more are at distance sqrt(2 - 2c) = eps or less. Distinct vectors (equal ones are
one class with a count) are projected on leading principal directions, sorted by the cells of a grid of width
eps, and cut into blocks of consecutive vectors. Blocks form a tree of sequence intervals with bounding boxes;
pairs of intervals are joined from the root down, and a pair more than eps apart in the projection is never
opened. The blocks of two nodes of the last level but one meet in one task, each sent there once, and near ones are
compared in double precision. They give link counts and spanning forests of their links, never the links themselves,
so output grows with rows and not with pairs.

Directions are fitted to a bounded sample; any orthonormal directions keep the result exact, better ones skip
more.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BIN, DBL, INT, LONG, STR, Scratch, components, fields, number_rows

COSINE = 0.98
AXES = 8
BLOCK = 256
FAN = 8
SAMPLE = 8192


def _axes(sample: list[list[float]]) -> dict[int, np.ndarray]:
    """For each dimension in the sample its leading principal directions, as columns."""
    out = {}
    for dim in {len(v) for v in sample}:
        m = np.array([v for v in sample if len(v) == dim], np.float64)
        m /= np.linalg.norm(m, axis=1, keepdims=True)
        m -= m.mean(axis=0)
        _, vectors = np.linalg.eigh(m.T @ m)
        out[dim] = vectors[:, ::-1][:, : min(AXES, dim)]
    return out


def _unit(flat: np.ndarray, dim: int) -> np.ndarray:
    m = flat.reshape(-1, dim)
    m = m / np.abs(m).max(axis=1, keepdims=True)  # no overflow or underflow in the squares
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def _forest(links: np.ndarray) -> np.ndarray:
    """For each node the least node of its component in a symmetric boolean matrix."""
    root = np.arange(len(links))
    if not links.any():
        return root
    while True:
        new = np.minimum(root, np.where(links, root[None, :], len(links)).min(axis=1))
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _flat(column, dtype) -> np.ndarray:
    return np.frombuffer(column.as_py(), dtype)


BLOCKS = fields(label=STR, dim=INT, blk=LONG, ids=BIN, counts=BIN, rows=BIN, lo=T.ArrayType(DBL), hi=T.ArrayType(DBL))
FOUND = fields(id=LONG, links=LONG, other=LONG)


def _block(key, group):
    dim = key[1].as_py()
    proj = group.column("proj").combine_chunks().flatten().to_numpy().reshape(group.num_rows, -1)
    rows = _unit(group.column("embedding").combine_chunks().flatten().to_numpy(), dim)
    lo, hi = (np.pad(f(axis=0), (0, AXES - proj.shape[1])) for f in (proj.min, proj.max))
    row = {"label": [key[0].as_py()], "dim": [dim], "blk": [key[2].as_py()], "ids": [group.column("row").to_numpy().tobytes()], "counts": [group.column("n").to_numpy().tobytes()], "rows": [rows.tobytes()], "lo": [lo.tolist()], "hi": [hi.tolist()]}
    return pa.Table.from_pydict(row, schema=pa.schema([("label", pa.string()), ("dim", pa.int32()), ("blk", pa.int64()), ("ids", pa.binary()), ("counts", pa.binary()), ("rows", pa.binary()), ("lo", pa.list_(pa.float64())), ("hi", pa.list_(pa.float64()))]))


def _links(x: np.ndarray, y: np.ndarray | None, cosine: float) -> np.ndarray:
    """The symmetric matrix of links among the rows of x, or of x and y against each other."""
    if y is None:
        links = x @ x.T >= cosine
        links |= links.T
        np.fill_diagonal(links, False)
        return links
    part = x @ y.T >= cosine
    links = np.zeros((len(x) + len(y),) * 2, bool)
    links[: len(x), len(x) :] = part
    links[len(x) :, : len(x)] = part.T
    return links


def _compare(cosine: float, eps: float):
    """Over the blocks of two tree nodes, each of them there once: counts of links, and links that span components."""

    def run(key, group):
        dim, low, high = key[1].as_py(), key[2].as_py(), key[3].as_py()
        rows = group.select(["blk", "node"]).to_pydict()
        ids, counts = ([_flat(x, np.int64) for x in group.column(c)] for c in ("ids", "counts"))
        vectors = [_flat(x, np.float64).reshape(-1, dim) for x in group.column("rows")]
        lo, hi = (np.array(group.column(c).to_pylist()) for c in ("lo", "hi"))
        degree = [np.zeros(len(x), np.int64) for x in ids]
        edges = []
        for i in range(len(ids)):
            for j in range(len(ids)):
                ordered = (rows["node"][i], rows["blk"][i]) <= (rows["node"][j], rows["blk"][j])
                if {rows["node"][i], rows["node"][j]} != {low, high} or not ordered:
                    continue
                gap = np.maximum(0.0, np.maximum(lo[i] - hi[j], lo[j] - hi[i]))
                if float(gap @ gap) > eps * eps + 1e-9:
                    continue
                links = _links(vectors[i], None if i == j else vectors[j], cosine)
                own = ids[i] if i == j else np.concatenate([ids[i], ids[j]])
                found = links @ (counts[i] if i == j else np.concatenate([counts[i], counts[j]]))
                if i == j:
                    degree[i] += found + counts[i] - 1
                else:
                    degree[i] += found[: len(ids[i])]
                    degree[j] += found[len(ids[i]) :]
                root = _forest(links)
                at = np.nonzero(root != np.arange(len(root)))[0]
                edges.append((own[at], own[root[at]]))
        every, links = np.concatenate(ids), np.concatenate(degree)
        at = links > 0
        u, v = (np.concatenate([every[at], *(e[k] for e in edges)]) for k in (0, 1))
        return pa.table({"id": u, "links": np.concatenate([links[at], np.zeros(len(u) - at.sum(), np.int64)]), "other": v})

    return run


def near_vectors(vectors: DataFrame, cosine: float = COSINE, scratch: Scratch | None = None) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of embeddings(vec_id, embedding, label).

    Rows link if labels are equal and not null, dimensions are equal, and the cosine is ``cosine`` or more.
    Vectors that are null, empty, zero, or hold a null or non-finite component link with nothing, equal ones
    included: 0 links, their own vec_id as component_id, kept. Each row counts as a vector of its own, also
    where rows or vec_ids repeat. A null vec_id has a component_id only from others and is not kept. Other
    columns are ignored; an empty table returns no rows.
    """
    spark = vectors.sparkSession
    scratch = scratch or Scratch(spark, "vectors")
    e = F.col("embedding")
    base = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").cast("string").alias("label"))
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    ok = F.coalesce(F.col("label").isNotNull() & finite & F.exists(e, lambda x: x != 0), F.lit(False))
    base = base.withColumn("ok", ok).withColumn("dim", F.size("embedding")).withColumn("k1", F.xxhash64("embedding")).withColumn("k2", F.xxhash64(F.lit(1), "embedding"))
    base = scratch.save(base)
    good = base.where("ok")
    classes = scratch.save(good.groupBy("label", "dim", "k1", "k2").agg(F.first("embedding").alias("embedding"), F.count("*").alias("n"), F.min("vec_id").alias("first")))
    sample = classes.select("embedding").orderBy(F.xxhash64("k1", F.lit(5)), "k2").limit(SAMPLE).collect()
    axes = _axes([r.embedding for r in sample])
    eps = float(np.sqrt(2 - 2 * cosine))

    def project(batches):
        for b in batches:
            proj, cells = [], []
            for v in b.column("embedding").to_pylist():
                u = _unit(np.array(v), len(v))[0]
                p = u @ axes[len(v)] if len(v) in axes else u[:AXES]
                proj.append(p)
                cells.append((np.floor(p / max(eps, 1e-3)) + 32768).astype(">u2").tobytes())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(proj, pa.list_(pa.float64())), pa.array(cells, pa.binary())], [*b.schema.names, "proj", "cell"])

    placed = classes.mapInArrow(project, T.StructType([*classes.schema.fields, T.StructField("proj", T.ArrayType(DBL)), T.StructField("cell", BIN)]))
    ordered = scratch.save(number_rows(placed, ["label", "dim", "cell", "k1", "k2"], scratch, "row"))
    group = ["label", "dim"]
    blocks = scratch.save(ordered.withColumn("blk", F.expr(f"row div {BLOCK}")).groupBy(*group, "blk").applyInArrow(_block, BLOCKS))
    low, high = [f"l{i}" for i in range(AXES)], [f"h{i}" for i in range(AXES)]
    nodes = [blocks.select(*group, F.col("blk").alias("node"), *[F.col("lo")[i].alias(c) for i, c in enumerate(low)], *[F.col("hi")[i].alias(c) for i, c in enumerate(high)])]
    most = (blocks.agg(F.max("blk")).first()[0] or 0) + 1
    while most > 1:
        most = -(-most // FAN)
        up = nodes[-1].groupBy(*group, F.expr(f"node div {FAN}").alias("node"))
        nodes.append(up.agg(*[F.min(c).alias(c) for c in low], *[F.max(c).alias(c) for c in high]))
    pairs = nodes[-1].select(*group, F.col("node").alias("a"), F.col("node").alias("b"))
    gap = lambda i: F.greatest(F.lit(0.0), F.col(f"a_l{i}") - F.col(f"b_h{i}"), F.col(f"b_l{i}") - F.col(f"a_h{i}"))
    apart = sum((gap(i) * gap(i) for i in range(1, AXES)), gap(0) * gap(0))
    for level in reversed(nodes[1:-1]):
        side = lambda s, level=level: level.select(*group, F.expr(f"node div {FAN}").alias(s), F.col("node").alias(f"{s}_node"), *[F.col(c).alias(f"{s}_{c}") for c in low + high])
        opened = pairs.join(side("a"), [*group, "a"]).join(side("b"), [*group, "b"])
        opened = opened.where((F.col("a_node") <= F.col("b_node")) & (apart <= eps * eps + 1e-9))
        pairs = scratch.save(opened.select(*group, F.col("a_node").alias("a"), F.col("b_node").alias("b")))
    # the last step is taken where the vectors are: FAN blocks a side meet at once, each sent there once
    held = blocks.withColumn("node", F.expr(f"blk div {FAN}") if len(nodes) > 1 else F.col("blk"))
    first = held.join(pairs.withColumn("node", F.col("a")), [*group, "node"])
    second = held.join(pairs.where("a <> b").withColumn("node", F.col("b")), [*group, "node"])
    found = scratch.save(first.unionByName(second).groupBy(*group, "a", "b").applyInArrow(_compare(cosine, eps), FOUND))
    degree = found.groupBy("id").agg(F.sum("links").alias("n_links"))
    roots = scratch.save(components(found.select(F.col("id").alias("u"), F.col("other").alias("v")), scratch))
    keyed = ordered.select("row", "label", "dim", "k1", "k2", "first")
    known = keyed.join(roots, keyed.row == roots.node, "left").withColumn("root", F.coalesce("root", "row"))
    known = scratch.save(known.join(degree, known.row == degree.id, "left").select("label", "dim", "k1", "k2", "first", "root", F.coalesce("n_links", F.lit(0)).alias("n_links")))
    heads = known.groupBy("root").agg(F.min("first").alias("head"))
    known = scratch.save(known.join(heads, "root").select("label", "dim", "k1", "k2", "n_links", "head"))
    scratch.only(base, known)
    one = base.select("vec_id", F.when(F.col("ok"), F.col("label")).alias("label"), "dim", "k1", "k2")
    met = one.join(known, ["label", "dim", "k1", "k2"], "left")
    head = F.coalesce("head", "vec_id")
    return met.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), head.alias("component_id"), F.coalesce(F.col("vec_id") == head, F.lit(False)).alias("kept"))
