"""Regions, sequences and alignments from text files."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def read_regions(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """chrom, beg, end (half-open, 0-based) of BED lines; lines of two fields are 1-based positions.

    Comments, blank, browser and track lines are left out. ``strict`` reads three fields only, numbers also in
    scientific notation, and fails where end <= beg.
    """
    rows = spark.read.text(path).where(~F.col("value").rlike(r"^\s*($|#|browser|track)"))
    f = F.split(F.trim("value"), r"\s+")
    if strict:
        beg, end = f[1].cast("double").cast("long"), f[2].cast("double").cast("long")
        return rows.select(f[0].alias("chrom"), beg.alias("beg"), F.when(end > beg, end).otherwise(F.raise_error(F.concat(F.lit("empty region: "), "value")).cast("long")).alias("end"))
    beg = f[1].cast("long")
    two = F.size(f) == 2
    end = F.when(two, beg).when(F.size(f) >= 3, F.try_element_at(f, F.lit(3)).cast("long")).otherwise(F.raise_error(F.concat(F.lit("bad region: "), "value")).cast("long"))
    return rows.select(f[0].alias("chrom"), F.when(two, beg - 1).otherwise(beg).alias("beg"), end.alias("end"))


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """chrom, seq (upper case), len: a record is a line block after '>', read whole by its separator."""
    rows = spark.read.option("lineSep", ">").text(path).where(F.length(F.trim("value")) > 0)
    name = F.regexp_extract("value", r"^\s*(\S+)", 1)
    seq = F.upper(F.regexp_replace(F.regexp_replace("value", r"^[^\n]*\n?", ""), r"\s", ""))
    return rows.select(name.alias("chrom"), seq.alias("seq")).withColumn("len", F.length("seq").cast("long"))


def contig_bases(contigs: DataFrame) -> DataFrame:
    """chrom, pos, base."""
    return contigs.select("chrom", F.posexplode(F.split("seq", "")).alias("pos", "base")).where("base <> ''").withColumn("pos", F.col("pos").cast("long"))


def cigar_ops(cigar: Column | str) -> Column:
    """An array of (op, len)."""
    c = F.col(cigar) if isinstance(cigar, str) else cigar
    return F.transform(F.regexp_extract_all(c, F.lit(r"(\d+)([MIDNSHP=X])"), 0), lambda x: F.struct(F.right(x, F.lit(1)).alias("op"), F.regexp_extract(x, r"\d+", 0).cast("int").alias("len")))


def cigar_text(ops: Column | str) -> Column:
    """The text of an array of (op, len), '*' for none."""
    c = F.col(ops) if isinstance(ops, str) else ops
    return F.coalesce(F.nullif(F.array_join(F.transform(c, lambda x: F.concat(x["len"].cast("string"), x["op"])), ""), F.lit("")), F.lit("*"))


def write_sam(reads: DataFrame, path: str, header: list[str] | None = None, contigs: DataFrame | None = None) -> None:
    """Reads as SAM text in genome order, header lines first; mates are not kept. Refuses an existing path."""
    tags = F.transform(F.array_sort(F.map_entries(F.coalesce("tags", F.create_map().cast("map<string,string>")))), lambda x: F.concat(x["key"], F.when(x["value"].rlike("^-?[0-9]+$"), ":i:").otherwise(":Z:"), x["value"]))
    qual = F.when(F.size("qual") > 0, F.array_join(F.transform("qual", lambda q: F.char(q + 33)), "")).otherwise("*")
    line = F.concat_ws("\t", "qname", F.col("flag").cast("string"), F.coalesce("chrom", F.lit("*")), (F.col("pos") + 1).cast("string"), F.col("mapq").cast("string"), "cigar", F.lit("*"), F.lit("0"), F.lit("0"), "seq", qual, F.array_join(tags, "\t"))
    placed = reads.join(F.broadcast(contigs.select("chrom", "contig_no")), "chrom", "left") if contigs is not None else reads.withColumn("contig_no", F.col("chrom"))  # a row for each contig
    body = placed.orderBy(F.col("contig_no").asc_nulls_last(), "pos", "qname", "flag").select(F.rtrim(line, F.lit("\t")).alias("value"))
    head = reads.sparkSession.createDataFrame([(x,) for x in header or ["@HD\tVN:1.6\tSO:coordinate"]], "value string").coalesce(1)
    head.unionByName(body).write.mode("errorifexists").text(path)


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """qname, flag, chrom (null for '*'), pos (0-based), mapq, cigar, ops, seq, qual (array), tags (map) of SAM text."""
    f = F.split("value", "\t")
    rows = spark.read.text(path).where(~F.startswith("value", F.lit("@")) & (F.size(f) >= 11))
    quals = F.when(f[10] == "*", F.array().cast("array<int>")).otherwise(F.transform(F.filter(F.split(f[10], ""), lambda x: x != ""), lambda x: F.ascii(x) - 33))
    tags = F.map_from_entries(F.transform(F.slice(f, 12, F.greatest(F.lit(0), F.size(f) - 11)), lambda x: F.struct(F.substring(x, 1, 2).alias("k"), F.regexp_replace(x, "^..:.:", "").alias("v"))))
    return rows.select(f[0].alias("qname"), f[1].cast("int").alias("flag"), F.nullif(f[2], F.lit("*")).alias("chrom"), (f[3].cast("long") - 1).alias("pos"), f[4].cast("int").alias("mapq"), f[5].alias("cigar"), cigar_ops(f[5]).alias("ops"), f[9].alias("seq"), quals.alias("qual"), tags.alias("tags"))


#: Blocks of a read's bases on the reference, from ops and pos: (r, q, len).
ALIGNED = """
  aggregate(ops, named_struct('r', pos, 'q', 0, 'out', cast(array() AS array<struct<r: bigint, q: int, len: int>>)),
    (s, o) -> CASE
      WHEN o.op IN ('M', '=', 'X') THEN named_struct('r', s.r + o.len, 'q', s.q + o.len, 'out', concat(s.out, array(named_struct('r', s.r, 'q', s.q, 'len', o.len))))
      WHEN o.op IN ('I', 'S') THEN named_struct('r', s.r, 'q', s.q + o.len, 'out', s.out)
      WHEN o.op IN ('D', 'N') THEN named_struct('r', s.r + o.len, 'q', s.q, 'out', s.out)
      ELSE s END).out"""


#: Contigs are kept in overlapping chunks: one starts every CHUNK bases and has twice as many.
CHUNK = 1 << 16
SPAN = "aggregate(ops, 0, (n, o) -> n + CASE WHEN o.op IN ('M', '=', 'X', 'D', 'N') THEN o.len ELSE 0 END)"


def reference_chunks(contigs: DataFrame) -> DataFrame:
    """chrom, chunk, bases of contigs(chrom, seq)."""

    def run(batches):
        for b in batches:
            for chrom, seq in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for i in range(0, len(seq), CHUNK * 64):
                    at = range(i, min(i + CHUNK * 64, len(seq)), CHUNK)
                    yield pa.RecordBatch.from_arrays([pa.array([chrom] * len(at)), pa.array([x // CHUNK for x in at], pa.int64()), pa.array([seq[x : x + 2 * CHUNK] for x in at])], ["chrom", "chunk", "bases"])

    return contigs.select("chrom", "seq").mapInArrow(run, "chrom string, chunk long, bases string")


def with_reference(reads: DataFrame, contigs: DataFrame, around: Column) -> DataFrame:
    """reads with ref_start and ref: the reference that a read covers with so many bases ``around``, null without a contig.

    A read meets one chunk of its contig by an equi-join; one that covers more than CHUNK bases meets the contig.
    """
    start = F.greatest(F.lit(0), F.col("pos") - around).cast("long")
    spanned = reads.withColumns({"ref_start": start, "_stop": F.col("pos") + F.expr(SPAN) + around})
    wide = F.coalesce(F.col("_stop") - F.col("ref_start") > CHUNK, F.lit(False))
    cut = lambda seq, first: F.substring(seq, (F.col("ref_start") - first + 1).cast("int"), (F.col("_stop") - F.col("ref_start")).cast("int"))
    near = spanned.where(~wide).withColumn("chunk", F.expr(f"ref_start div {CHUNK}")).join(reference_chunks(contigs), ["chrom", "chunk"], "left")
    near = near.withColumn("ref", cut(F.col("bases"), F.col("chunk") * CHUNK)).select(*reads.columns, "ref_start", "ref")
    far = spanned.where(wide).join(contigs.select("chrom", F.col("seq").alias("bases")), "chrom", "left").withColumn("ref", cut(F.col("bases"), F.lit(0))).select(*reads.columns, "ref_start", "ref")
    return near.unionByName(far)


def with_sites(reads: DataFrame, sites: DataFrame) -> DataFrame:
    """reads with the positions among sites(chrom, pos) that they cover, or just miss, as an array; long reads are looked up chunk by chunk."""
    first, last = F.expr(f"greatest(0, pos - 1) div {CHUNK}"), F.expr(f"(pos + {SPAN}) div {CHUNK}")
    listed = sites.select("chrom", F.expr(f"pos div {CHUNK}").alias("chunk"), F.col("pos").cast("long").alias("_site")).distinct().groupBy("chrom", "chunk").agg(F.collect_list("_site").alias("_sites"))
    keyed = reads.withColumn("_read", F.struct(*reads.columns)).select("_read", "chrom", "pos", F.expr(SPAN).alias("_span"), first.alias("_a"), last.alias("_b"))
    inside = F.filter("_sites", lambda x: (x >= F.col("pos") - 1) & (x <= F.col("pos") + F.col("_span")))
    narrow = keyed.where("coalesce(_a = _b, true)").withColumn("chunk", F.col("_a")).join(listed, ["chrom", "chunk"], "left").select("_read", F.coalesce(inside, F.array().cast("array<bigint>")).alias("sites"))
    two = keyed.where("_a < _b").withColumn("_id", F.monotonically_increasing_id()).withColumn("chunk", F.explode(F.sequence("_a", "_b"))).join(listed, ["chrom", "chunk"], "left")
    wide = two.groupBy("_id").agg(F.first("_read").alias("_read"), F.flatten(F.collect_list(inside)).alias("sites")).drop("_id")
    return narrow.unionByName(wide).select("_read.*", "sites")


def observations(reads: DataFrame, bases: DataFrame) -> DataFrame:
    """A row per aligned base: the CIGAR walk as array expressions, then an equi-join with the reference's bases.

    ``M``, ``=`` and ``X`` put bases on positions; insertions and soft clips move along the read, deletions and
    skips along the reference.
    """
    walk = F.expr(ALIGNED)
    blocks = reads.select("qname", "chrom", "mapq", "seq", "qual", (F.col("flag").bitwiseAND(16) != 0).alias("is_rev"), F.explode(walk).alias("b"))
    each = blocks.select("*", F.explode(F.expr("sequence(0, b.len - 1)")).alias("i"))
    at = F.col("b.q") + F.col("i") + 1
    rows = each.select("qname", "chrom", (F.col("b.r") + F.col("i")).alias("pos"), F.upper(F.substring("seq", at, F.lit(1))).alias("base"), F.least(F.lit(93), F.coalesce(F.try_element_at("qual", at), F.lit(0))).alias("bq"), F.col("mapq").alias("mq"), "is_rev")
    met = rows.join(bases.select("chrom", "pos", F.col("base").alias("ref_base")), ["chrom", "pos"], "left")
    return met.select("qname", "chrom", "pos", F.instr(F.lit("ACGT"), F.col("ref_base")).alias("_r"), F.instr(F.lit("ACGT"), F.col("base")).alias("_b"), "bq", "mq", F.lit(-1).alias("baq"), "is_rev").withColumn("ref_nt", F.when(F.col("_r") > 0, F.col("_r") - 1).otherwise(4)).withColumn("nt", F.when(F.col("_b") > 0, F.col("_b") - 1).otherwise(4)).drop("_r", "_b")


def indel_events(reads: DataFrame, contigs: DataFrame) -> DataFrame:
    """chrom, pos (the base before), kind ('ins' or 'del'), key, n, fw, rv: indels counted by sequence."""
    walk = F.expr("""
      aggregate(ops, named_struct('r', pos, 'q', 0, 'out', cast(array() AS array<struct<kind: string, r: bigint, q: int, len: int>>)),
        (s, o) -> CASE
          WHEN o.op IN ('M', '=', 'X') THEN named_struct('r', s.r + o.len, 'q', s.q + o.len, 'out', s.out)
          WHEN o.op = 'I' THEN named_struct('r', s.r, 'q', s.q + o.len, 'out', concat(s.out, array(named_struct('kind', 'ins', 'r', s.r - 1, 'q', s.q, 'len', o.len))))
          WHEN o.op = 'S' THEN named_struct('r', s.r, 'q', s.q + o.len, 'out', s.out)
          WHEN o.op = 'D' THEN named_struct('r', s.r + o.len, 'q', s.q, 'out', concat(s.out, array(named_struct('kind', 'del', 'r', s.r - 1, 'q', s.q, 'len', o.len))))
          WHEN o.op = 'N' THEN named_struct('r', s.r + o.len, 'q', s.q, 'out', s.out)
          ELSE s END).out""")
    events = reads.select("chrom", "seq", (F.col("flag").bitwiseAND(16) != 0).alias("is_rev"), F.explode(walk).alias("e"))
    met = events.join(contigs.select("chrom", F.col("seq").alias("ref")), "chrom", "left")
    deleted = F.coalesce(F.substring("ref", (F.col("e.r") + 2).cast("int"), F.col("e.len")), F.repeat(F.lit("N"), F.col("e.len")))
    key = F.when(F.col("e.kind") == "ins", F.upper(F.substring("seq", F.col("e.q") + 1, F.col("e.len")))).otherwise(deleted)
    return met.select("chrom", F.col("e.r").alias("pos"), F.col("e.kind").alias("kind"), key.alias("key"), "is_rev").groupBy("chrom", "pos", "kind", "key").agg(F.count("*").alias("n"), F.count_if(~F.col("is_rev")).alias("fw"), F.count_if("is_rev").alias("rv"))


def drop_homopolymer_pairs(events: DataFrame, depth: DataFrame, least: float = 0.05) -> DataFrame:
    """Without one-base A or T events that are both inserted and deleted at a position, each in under 5 % of depth(chrom, pos, dp)."""
    w = Window.partitionBy("chrom", "pos", "key")
    af = F.col("n") / F.col("dp")
    met = events.join(depth, ["chrom", "pos"], "left")
    both = (F.count("*").over(w) == 2) & (F.max(af).over(w) < least) & F.col("key").isin("A", "T")
    return met.withColumn("_both", F.coalesce(both, F.lit(False))).where(~F.col("_both")).select(*events.columns)


#: What a read puts on the reference, block by block: matched bases, or a gap; with the indel that follows a matched block.
_PLACED = """
  aggregate(sequence(0, size(ops) - 1), named_struct('r', pos, 'q', 0, 'out', cast(array() AS array<struct<r: bigint, q: int, len: int, gap: boolean, ins: int, del: int>>)),
    (s, i) -> CASE
      WHEN ops[i].op IN ('M', '=', 'X') THEN named_struct('r', s.r + ops[i].len, 'q', s.q + ops[i].len, 'out', concat(s.out, array(named_struct('r', s.r, 'q', s.q, 'len', ops[i].len, 'gap', false,
        'ins', CASE WHEN get(ops, i + 1).op = 'I' THEN get(ops, i + 1).len ELSE 0 END, 'del', CASE WHEN get(ops, i + 1).op = 'D' THEN get(ops, i + 1).len ELSE 0 END))))
      WHEN ops[i].op IN ('I', 'S') THEN named_struct('r', s.r, 'q', s.q + ops[i].len, 'out', s.out)
      WHEN ops[i].op IN ('D', 'N') THEN named_struct('r', s.r + ops[i].len, 'q', s.q, 'out', concat(s.out, array(named_struct('r', s.r, 'q', s.q, 'len', ops[i].len, 'gap', true, 'ins', 0, 'del', 0))))
      ELSE s END).out"""


def column_observations(reads: DataFrame, contigs: DataFrame) -> DataFrame:
    """A row per read and reference position that it covers, deleted and skipped ones included, with what callers ask for.

    chrom, pos, ref_nt, nt (null in a gap), bq, mq, baq, sq, is_rev, is_head, is_tail, kind and key of an indel right
    after the position, iq and dq (tags BI and BD, 0 without), aq (tags ai and ad), qname. Alignment qualities come
    from tag lb, source qualities from sq; null where there is none. A read brings its own stretch of the reference,
    and only numbers leave it.
    """
    met = with_reference(reads.where((F.col("flag").bitwiseAND(4) == 0) & (F.size("ops") > 0)), contigs, F.lit(1)).withColumn("_end", F.col("pos") + F.expr(SPAN))
    blocks = met.select("*", F.explode(F.expr(_PLACED)).alias("b"))
    each = blocks.select("*", F.explode(F.expr("sequence(0, b.len - 1)")).alias("i"))
    q = F.when(F.col("b.gap"), F.col("b.q")).otherwise(F.col("b.q") + F.col("i"))
    at = F.col("b.r") + F.col("i")
    tag = lambda name: F.try_element_at("tags", F.lit(name))
    char = lambda name: F.when(F.length(tag(name)) > q, F.ascii(F.substring(tag(name), q + 1, F.lit(1))) - 33)
    code = lambda base: F.when(F.instr(F.lit("ACGT"), base) > 0, F.instr(F.lit("ACGT"), base) - 1).otherwise(4)
    last = ~F.col("b.gap") & (F.col("i") == F.col("b.len") - 1)
    ins, dele = last & (F.col("b.ins") > 0), last & (F.col("b.del") > 0)
    gone = F.rpad(F.coalesce(F.substring("ref", (at - F.col("ref_start") + 2).cast("int"), F.col("b.del")), F.lit("")), F.col("b.del"), F.lit("N"))
    return each.select(
        "qname", "chrom", at.alias("pos"), code(F.coalesce(F.substring("ref", (at - F.col("ref_start") + 1).cast("int"), F.lit(1)), F.lit("N"))).alias("ref_nt"),
        F.when(~F.col("b.gap"), code(F.upper(F.substring("seq", q + 1, F.lit(1))))).alias("nt"), F.when(~F.col("b.gap"), F.coalesce(F.try_element_at("qual", q + 1), F.lit(0))).alias("bq"), F.col("mapq").alias("mq"),
        char("lb").alias("baq"), tag("sq").try_cast("int").alias("sq"), (F.col("flag").bitwiseAND(16) != 0).alias("is_rev"), (~F.col("b.gap") & (at == F.col("pos"))).alias("is_head"), (~F.col("b.gap") & (at == F.col("_end") - 1)).alias("is_tail"),
        F.when(ins, "ins").when(dele, "del").alias("kind"), F.when(ins, F.upper(F.substring("seq", F.col("b.q") + F.col("b.len") + 1, F.col("b.ins")))).when(dele, gone).alias("key"),
        F.coalesce(char("BI"), F.lit(0)).alias("iq"), F.coalesce(char("BD"), F.lit(0)).alias("dq"), F.when(ins, char("ai")).when(dele, char("ad")).alias("aq"),
    )


def overlapping(reads: DataFrame, regions: DataFrame, bin_bits: int = 13) -> DataFrame:
    """Reads that cover a base of some half-open region(chrom, beg, end).

    A region stands in each bin where a read that reaches it can start, by the longest span of all reads; so a read is
    looked up in one bin.
    """
    width = 1 << bin_bits
    spanned = reads.withColumn("_end", F.col("pos") + F.expr(SPAN))
    longest = spanned.agg(F.coalesce(F.max(F.col("_end") - F.col("pos")), F.lit(1)).alias("n")).first().n
    bins = regions.where("end > beg").select(F.col("chrom").alias("_chrom"), "beg", "end", F.explode(F.sequence(F.expr(f"greatest(0, beg - {longest} + 1) div {width}"), F.expr(f"(end - 1) div {width}"))).alias("_bin"))
    hit = (F.expr(f"pos div {width}") == F.col("_bin")) & (F.col("chrom") == F.col("_chrom")) & (F.col("beg") < F.col("_end")) & (F.col("end") > F.col("pos"))
    return spanned.join(bins, hit, "left_semi").drop("_end")
