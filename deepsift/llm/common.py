"""What several operators share: tables in the shared folder, row numbers, components."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: The six white-space characters that the operators' words and lines know.
BLANKS = b" \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a new local one in local mode, else an error."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        held = spark.sparkContext.getCheckpointDir()
        if held is None:
            if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
                raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="deepsift-"))
            held = spark.sparkContext.getCheckpointDir()
        place = held
    return place.rstrip("/")


class Scratch:
    """Tables written to the shared folder, so that neither lineage nor a lost executor repeats the work above them."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.count = 0
        self.held: dict[str, DataFrame] = {}

    def save(self, df: DataFrame) -> DataFrame:
        self.count += 1
        path = f"{self.root}/t{self.count}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        self.held[path] = out
        return out

    def only(self, *tables: DataFrame) -> None:
        """Delete all tables but these, which a result still reads."""
        left = {t._scratch_path for t in tables}
        self.drop(*[t for path, t in self.held.items() if path not in left])

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that nothing reads any more."""
        jvm = self.spark._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for df in tables:
            self.held.pop(df._scratch_path, None)
            path = jvm.org.apache.hadoop.fs.Path(df._scratch_path)
            path.getFileSystem(conf).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold_ascii(c: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def number_rows(df: DataFrame, order: Iterable[str], scratch: Scratch, name: str = "row_number") -> DataFrame:
    """Global row numbers 0..n-1 in the given order without one task that sees all rows.

    Rows are range partitioned and sorted, numbered within their partition, and moved up by the rows of the
    partitions before. The only broadcast has a row per partition. Rows equal in all of ``order`` are
    interchangeable, so the order should hold every column that matters.
    """
    order = list(order)
    placed = scratch.save(
        df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__mid", F.monotonically_increasing_id())
    )
    part = F.shiftrightunsigned("__mid", 33).cast("int")
    sizes = placed.groupBy(part.alias("__part")).count()
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("__part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__start"))
    return (
        placed.withColumn("__part", part)
        .join(F.broadcast(starts), "__part")
        .withColumn(name, F.col("__start") + F.col("__mid").bitwiseAND((1 << 33) - 1))
        .drop("__part", "__mid", "__start")
    )


#: A hub's edges are dealt over so many keys.
SALTS = 64


def _least(edges: DataFrame) -> DataFrame:
    """edges(u, v) with m, the least of u and its v; the edges of a hub stay spread over SALTS keys."""
    salt = F.pmod(F.xxhash64("v"), F.lit(SALTS)).alias("s")
    salted = edges.select("u", "v", salt)
    parts = salted.groupBy("u", "s").agg(F.min("v").alias("m"))
    whole = parts.groupBy("u").agg(F.min("m").alias("m"))
    back = parts.select("u", "s").join(whole, "u")
    return salted.join(back, ["u", "s"]).select("u", "v", F.least("u", "m").alias("m"))


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Connected components of edges(u, v), longs: a row (node, root) for each node, root the least node of its component.

    Alternates large-star and small-star (Kiveris et al., "Connected Components in MapReduce and Beyond") until
    the edges are stars. Each half round ends in a table in the shared folder, so lineage stays short; the
    driver sees a count and a checksum of a round and never an edge. Self-loops and repeated edges do no harm.
    """
    flat = scratch.save(edges.where("u <> v").select("u", "v").distinct())
    sign = None
    while True:
        both = flat.select("u", "v").unionByName(flat.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = scratch.save(_least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        scratch.drop(flat)
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        m = _least(down)
        star = F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v"))))
        flat = scratch.save(m.select(star.alias("e")).select("e.u", "e.v").where("u <> v").distinct())
        scratch.drop(large)
        row = flat.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("x")).first()
        if (row.n, row.x) == sign:
            break
        sign = (row.n, row.x)
    leaves = flat.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return leaves.unionByName(leaves.select(F.col("root").alias("node"), "root").distinct())


LONG, INT, STR, DBL, BIN, BOOL = T.LongType(), T.IntegerType(), T.StringType(), T.DoubleType(), T.BinaryType(), T.BooleanType()


def fields(**types: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in types.items()])


#: A Python worker takes so many rows of a batch into its hands at once; the batch itself is Arrow memory.
TOGETHER = 512


def tidy() -> None:
    """Give freed memory back: a Python worker stays for a minute after its task, beside those of the next stage."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):
        ctypes.CDLL(None).malloc_trim(0)


def slices(batches: Iterable, rows: int = TOGETHER, by_bytes: int | None = None) -> Iterable:
    """Arrow batches in slices of at most ``rows`` rows, without a copy; after the last one the worker is tidied.

    With ``by_bytes``, the last column's texts of a slice have so many bytes in all, or the slice is one row.
    """
    for b in batches:
        if by_bytes is None:
            yield from (b.slice(lo, rows) for lo in range(0, b.num_rows, rows))
            continue
        through = np.cumsum(pc.fill_null(pc.binary_length(b.column(b.num_columns - 1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        lo, before = 0, 0
        while lo < b.num_rows:
            hi = max(lo + 1, int(np.searchsorted(through, before + by_bytes, side="right")))
            yield b.slice(lo, hi - lo)
            lo, before = hi, int(through[hi - 1])
    del batches
    tidy()
