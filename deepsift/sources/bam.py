"""Binary alignments (BGZF blocks of records) as the rows that ``text.read_sam`` gives.

A file is one row of Spark's binary reader, so any store that Spark reads will do and files are the unit of work; one
of over 2 GB has to be split by contig first. Records stream out of a file in batches.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .text import cigar_ops

#: The format's base and operation letters.
BASES, OPERATIONS = "=ACMGRSVTWYHKDBN", "MIDNSHP=X"
SCHEMA = "qname string, flag int, chrom string, pos long, mapq int, cigar string, seq string, qual array<int>, tags map<string,string>"
_PAIRS = [a + b for a in BASES for b in BASES]
_SIZES = {"c": "b", "C": "B", "s": "h", "S": "H", "i": "i", "I": "I", "f": "f"}


def inflated(raw: bytes) -> Iterator[bytes]:
    """The contents of each block."""
    at = 0
    while at < len(raw):
        out = zlib.decompressobj(31)
        yield out.decompress(raw[at:at + (1 << 16) + 64])
        if not out.eof:
            raise ValueError("a block of more than 64 kB, or a cut one")
        at += min(len(raw) - at, (1 << 16) + 64) - len(out.unused_data)


def _tags(raw: bytes) -> dict[str, str]:
    out, at = {}, 0
    while at < len(raw):
        name, kind, at = raw[at : at + 2].decode(), chr(raw[at + 2]), at + 3
        if kind == "A":
            out[name], at = chr(raw[at]), at + 1
        elif kind in "ZH":
            end = raw.index(0, at)
            out[name], at = raw[at:end].decode("latin-1"), end + 1
        elif kind == "B":
            form, n = "<" + _SIZES[chr(raw[at])], struct.unpack_from("<I", raw, at + 1)[0]
            size = struct.calcsize(form)
            values = [struct.unpack_from(form, raw, at + 5 + size * i)[0] for i in range(n)]
            out[name], at = ",".join([chr(raw[at]), *map(_number, values)]), at + 5 + size * n
        else:
            form = "<" + _SIZES[kind]
            out[name], at = _number(struct.unpack_from(form, raw, at)[0]), at + struct.calcsize(form)
    return out


def _number(x) -> str:
    return f"{x:g}" if isinstance(x, float) else str(x)


def _record(raw: bytes, contigs: list[str]) -> tuple:
    tid, pos, name_len, mapq, _, n_ops, flag, length = struct.unpack_from("<iiBBHHHi", raw)
    at = 32 + name_len
    qname = raw[32 : at - 1].decode("latin-1")
    ops = struct.unpack_from(f"<{n_ops}I", raw, at)
    at += 4 * n_ops
    packed = raw[at : at + (length + 1) // 2]
    at += len(packed)
    qual = list(raw[at : at + length])
    seq = "".join(map(_PAIRS.__getitem__, packed))[:length]
    cigar = "".join(f"{x >> 4}{OPERATIONS[x & 15]}" for x in ops)
    return qname, flag, contigs[tid] if tid >= 0 else None, pos, mapq, cigar or "*", seq or "*", [] if qual[:1] == [255] else qual, list(_tags(raw[at + length :]).items())


def header_and_records(raw: bytes) -> Iterator[tuple]:
    """First (header text, [(contig, length)]), then records; no more than a record and a block are held."""
    blocks, held, at = inflated(raw), b"", 0

    def take(n: int) -> bytes | None:
        nonlocal held, at
        if len(held) - at < n:
            parts, have = [held[at:]], len(held) - at
            while have < n and (block := next(blocks, None)) is not None:
                parts.append(block)
                have += len(block)
            held, at = b"".join(parts), 0
        if len(held) < n:
            if held:
                raise ValueError("the file ends within a record")
            return None
        at += n
        return held[at - n : at]

    number = lambda: struct.unpack("<i", take(4))[0]
    if take(4) != b"BAM\x01":
        raise ValueError("not a binary alignment file")
    text = take(number()).decode("latin-1").rstrip("\0")
    contigs = []
    for _ in range(number()):
        name = take(number())[:-1].decode("latin-1")
        contigs.append((name, number()))
    yield text, contigs
    names = [c for c, _ in contigs]
    while (size := take(4)) is not None:
        yield _record(take(struct.unpack("<i", size)[0]), names)


def read_bam(spark: SparkSession, path: str) -> DataFrame:
    """qname, flag, chrom, pos (0-based), mapq, cigar, ops, seq, qual, tags of the files at a path."""
    kinds = pa.schema([("qname", pa.string()), ("flag", pa.int32()), ("chrom", pa.string()), ("pos", pa.int64()), ("mapq", pa.int32()), ("cigar", pa.string()), ("seq", pa.string()), ("qual", pa.list_(pa.int32())), ("tags", pa.map_(pa.string(), pa.string()))])

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), kinds, strict=True)], schema=kinds)

    def run(batches):
        for b in batches:
            for raw in b.column(0):
                rows, found = [], header_and_records(raw.as_py())
                next(found)
                for r in found:
                    rows.append(r)
                    if len(rows) == 4096:
                        yield batch(rows)
                        rows = []
                if rows:
                    yield batch(rows)

    files = spark.read.format("binaryFile").load(path).select("content").repartition(max(1, spark.sparkContext.defaultParallelism))
    return files.mapInArrow(run, SCHEMA).withColumn("ops", cigar_ops("cigar"))


def read_bam_contigs(spark: SparkSession, path: str) -> DataFrame:
    """chrom, len, contig_no of the files' headers."""

    def run(batches):
        for b in batches:
            for raw in b.column(0):
                _, contigs = next(header_and_records(raw.as_py()))
                yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in contigs], pa.string()), pa.array([n for _, n in contigs], pa.int64()), pa.array(range(len(contigs)), pa.int64())], ["chrom", "len", "contig_no"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "chrom string, len long, contig_no long").distinct()
