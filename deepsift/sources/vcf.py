"""VCF text: rows with typed INFO, headers, and a sorted writer. ``.gz`` files are read and written as such."""

from __future__ import annotations

import re
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The INFO declarations of a new header.
INFO = (
    ("DP", "1", "Integer", "Raw Depth"), ("AF", "1", "Float", "Allele Frequency"), ("SB", "1", "Integer", "Phred-scaled strand bias at this position"),
    ("DP4", "4", "Integer", "Counts for ref-forward bases, ref-reverse, alt-forward and alt-reverse bases"), ("INDEL", "0", "Flag", "Indicates that the variant is an INDEL."),
    ("CONSVAR", "0", "Flag", "Indicates that the variant is a consensus variant (as opposed to a low frequency variant)."), ("HRUN", "1", "Integer", "Homopolymer length to the right of report indel position"),
    ("HQA", "1", "Integer", "Number of high-quality alternative bases"),
)
COLUMNS = ("#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO")


def new_header(source: str, day: date | None = None, reference: str | None = None) -> list[str]:
    out = ["##fileformat=VCFv4.0", f"##fileDate={(day or date.today()):%Y%m%d}", f"##source={source}", *([f"##reference={reference}"] if reference else [])]
    return [*out, *[f'##INFO=<ID={i},Number={n},Type={t},Description="{d}">' for i, n, t, d in INFO], "\t".join(COLUMNS)]


def insert_header(header: list[str], line: str) -> list[str]:
    """The header with a line before the one of column names, or at its end."""
    at = next((i for i, x in enumerate(header) if x.startswith("#CHROM")), len(header))
    return [*header[:at], line, *header[at:]]


def info_value(info: Column | str, key: str) -> Column:
    """The value of an INFO key in any case; null without the key, empty for a flag."""
    parts = F.split(F.col(info) if isinstance(info, str) else info, ";")
    hit = F.filter(parts, lambda x: F.lower(F.split(x, "=")[0]) == key.lower())
    return F.when(F.size(hit) > 0, F.regexp_replace(F.try_element_at(hit, F.lit(1)), "^[^=]*=?", ""))


def read_vcf(spark: SparkSession, path: str) -> DataFrame:
    """chrom, pos (0-based), id, ref, alt, qual (null for '.', decimals cut), filter, info, format, samples and typed INFO.

    Lines with fewer than 5 fields are malformed and left out; fields missing up to INFO are '.'. Plain and
    compressed files are read line by line on the executors; plain ones in splits.
    """
    f = F.split("value", "\t")
    at = lambda i: F.coalesce(F.try_element_at(f, F.lit(i + 1)), F.lit("."))
    rows = spark.read.text(path).where(~F.startswith("value", F.lit("#")) & (F.size(f) >= 5))
    qual = F.when(at(5) == ".", None).otherwise(F.coalesce(F.regexp_extract(at(5), r"^-?\d+", 0).try_cast("int"), F.lit(0)))
    out = rows.select(at(0).alias("chrom"), (at(1).cast("long") - 1).alias("pos"), at(2).alias("id"), at(3).alias("ref"), at(4).alias("alt"), qual.alias("qual"), at(6).alias("filter"), at(7).alias("info"), F.try_element_at(f, F.lit(9)).alias("format"), F.slice(f, 10, F.greatest(F.lit(0), F.size(f) - 9)).alias("samples"))
    dp4 = F.split(info_value("info", "DP4"), ",")
    typed = {"dp": info_value("info", "DP").try_cast("int"), "af": info_value("info", "AF").try_cast("double"), "sb": info_value("info", "SB").try_cast("int"), "indel": info_value("info", "INDEL").isNotNull(), "hrun": info_value("info", "HRUN").try_cast("int")}
    typed |= {n: F.try_element_at(dp4, F.lit(i + 1)).try_cast("int") for i, n in enumerate(("ref_fw", "ref_rv", "alt_fw", "alt_rv"))}
    return out.withColumns(typed)


def read_header(spark: SparkSession, path: str) -> list[str]:
    """Header lines in order; a header is small and comes to the driver. Without one, the minimal header."""
    numbered = spark.read.text(path).withColumn("_at", F.monotonically_increasing_id())
    first = numbered.where(F.startswith("value", F.lit("#"))).orderBy("_at").limit(10_000)  # part files and lines in order
    lines = [r.value for r in first.collect()]
    return lines or ["\t".join(COLUMNS)]


def format_info(df: DataFrame) -> DataFrame:
    """df with ``info`` written from its typed columns."""
    has = set(df.columns)
    parts = [F.concat(F.lit("DP="), F.col("dp")), F.concat(F.lit("AF="), F.format_string("%f", F.col("af").cast("double"))), F.concat(F.lit("SB="), F.col("sb")), F.concat(F.lit("DP4="), F.concat_ws(",", "ref_fw", "ref_rv", "alt_fw", "alt_rv"))]
    if "indel" in has:
        parts += [F.when(F.col("indel"), F.lit("INDEL")), F.when(F.col("indel"), F.concat(F.lit("HRUN="), F.col("hrun")))]
    if "hqa" in has:
        parts.append(F.concat(F.lit("HQA="), F.when(~F.col("indel"), F.col("hqa")) if "indel" in has else F.col("hqa")))
    if "consvar" in has:
        parts.append(F.when(F.col("consvar"), F.lit("CONSVAR")))
    return df.withColumn("info", F.concat_ws(";", *parts))


def variant_lines(df: DataFrame, contigs: DataFrame | None = None) -> DataFrame:
    """Lines in genome order, by contigs(chrom, contig_no) or by name; missing values are '.'."""
    for name, kind in (("id", "string"), ("filter", "string"), ("info", "string"), ("format", "string"), ("samples", "array<string>")):
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast(kind))
    dot = lambda c: F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit("."))
    line = F.concat_ws("\t", "chrom", (F.col("pos") + 1).cast("string"), dot("id"), "ref", "alt", dot("qual"), dot("filter"), dot("info"), "format", F.concat_ws("\t", F.filter("samples", lambda x: x.isNotNull())))
    line = F.rtrim(line, F.lit("\t"))
    if contigs is not None:
        df = df.join(F.broadcast(contigs.select("chrom", "contig_no")), "chrom", "left")  # one row per contig
    else:
        df = df.withColumn("contig_no", F.col("chrom"))
    return df.orderBy("contig_no", "pos", "ref", "alt").select(line.alias("value"))


def write_vcf(df: DataFrame, path: str, header: list[str] | None = None, contigs: DataFrame | None = None, compress: bool = False) -> None:
    """A folder of part files in genome order, the header in the first; refuses an existing path."""
    spark = df.sparkSession
    head = spark.createDataFrame([(x,) for x in header or new_header("deepsift")], "value string").coalesce(1)
    body = head.unionByName(variant_lines(df, contigs))
    body.write.mode("errorifexists").option("compression", "gzip" if compress else "none").text(path)


def add_genotypes(df: DataFrame, samples: int) -> DataFrame:
    """A GT column of '.' for each sample; an error where there is another format already."""
    other = F.coalesce(F.col("format") != "GT", F.lit(False)) if "format" in df.columns else F.lit(False)
    checked = F.when(other, F.raise_error(F.concat(F.lit("samples of another format: "), F.col("format"))).cast("string")).otherwise(F.lit("GT")) if "format" in df.columns else F.lit("GT")
    return df.withColumn("format", checked).withColumn("samples", F.array_repeat(F.lit("."), samples))


#: What a sample column tells of a variant's column in a sample.
SAMPLE_FORMAT = ("dp", "ref_n", "alt_n", "alt_bq_min", "alt_bq_max", "alt_mq_min", "alt_mq_max")


def add_samples(df: DataFrame, samples: list[DataFrame]) -> DataFrame:
    """df with a format and a column for each sample's annotation (``summary.sample_annotation``), '.' without one."""
    keys = ["chrom", "pos", "ref", "alt"]
    out = df.withColumn("format", F.lit(":".join(c.upper() for c in SAMPLE_FORMAT)))
    texts = []
    for i, s in enumerate(samples):
        told = F.concat_ws(":", *[F.col(c).cast("string") for c in SAMPLE_FORMAT]).alias(f"_s{i}")
        out = out.join(s.select(*keys, told), keys, "left")
        texts.append(F.coalesce(f"_s{i}", F.lit(".")))
    return out.withColumn("samples", F.array(*texts)).drop(*[f"_s{i}" for i in range(len(samples))])


def header_types(header: list[str], kind: str = "INFO") -> dict[str, tuple[str, str]]:
    """Number and type by id of a header's INFO or FORMAT lines."""
    found = (re.match(rf"##{kind}=<ID=([^,]+),Number=([^,]+),Type=([^,>]+)", x) for x in header)
    return {m[1]: (m[2], m[3]) for m in found if m}


def typed_info(df: DataFrame, header: list[str]) -> DataFrame:
    """df with a column info_<id> for each INFO declaration: flags as booleans, numbers as such, lists where the header says so."""
    kinds = {"Integer": "int", "Float": "double"}
    columns = {}
    for name, (number, kind) in header_types(header).items():
        text = info_value("info", name)
        if kind == "Flag" or number == "0":
            columns[f"info_{name}"] = text.isNotNull()
        elif number == "1":
            columns[f"info_{name}"] = text.try_cast(kinds[kind]) if kind in kinds else text
        else:
            columns[f"info_{name}"] = F.split(text, ",") if kind not in kinds else F.split(text, ",").try_cast(f"array<{kinds[kind]}>")
    return df.withColumns(columns)
