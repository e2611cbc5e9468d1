"""Readers of line formats. Each takes a path (gzip is read as it is) and gives tags, fragments, step functions or regions.

Tags are ``(chrom, pos, strand)`` with strand 0 or 1, fragments ``(chrom, l, r[, barcode, cnt])``. Blank lines, comments
and track lines are skipped. A strand that can't be read fails the job; use ``sources.export_lines`` to load what is
valid and get the rest with its reason.
"""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits of the flag by which a read is left out: unmapped, secondary, quality-failed, supplementary.
DROP_FLAGS = 4 | 256 | 512 | 2048
_SKIP = "^(track|browse|#)|^\\s*$"


def _lines(spark: SparkSession, path: str | list[str], skip: str = _SKIP) -> DataFrame:
    rows = spark.read.text(path)
    return rows.select(F.regexp_replace("value", "\\r$", "").alias("value")).where(~F.col("value").rlike(skip))


def _fields(spark: SparkSession, path: str | list[str], skip: str = _SKIP, sep: str = "\t") -> tuple[DataFrame, Column]:
    return _lines(spark, path, skip).select(F.split("value", sep, -1).alias("f")), F.col("f")


def _strand(c: Column, plus: str = "+", minus: str = "-") -> Column:
    bad = F.raise_error(F.concat(F.lit("strand can't be read: "), F.coalesce(c, F.lit("null")))).cast("int")
    return F.when(c == plus, 0).when(c == minus, 1).otherwise(bad)


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    """Tags of BED lines: the start of forward, the end of reverse intervals; forward where no strand is given."""
    rows, f = _fields(spark, path)
    strand = F.when(F.size(f) < 6, 0).otherwise(_strand(F.trim(F.get(f, F.lit(5)))))
    rows = rows.select(f[0].alias("chrom"), f[1].cast("int").alias("_s"), f[2].cast("int").alias("_e"), strand.alias("strand"))
    return rows.select("chrom", F.when(F.col("strand") == 0, F.col("_s")).otherwise(F.col("_e")).alias("pos"), "strand")


def read_bedpe(spark: SparkSession, path: str) -> DataFrame:
    """Fragments of three columns; an end not after its start fails the job."""
    rows, f = _fields(spark, path)
    rows = rows.select(f[0].alias("chrom"), f[1].cast("int").alias("l"), f[2].cast("int").alias("r"))
    return rows.withColumn("r", F.when(F.col("r") > F.col("l"), F.col("r")).otherwise(F.raise_error(F.lit("a fragment ends before it starts")).cast("int")))


def read_frag(spark: SparkSession, path: str, max_count: int | None = None) -> DataFrame:
    """Barcoded fragments; counts are limited to 65535 and to ``max_count``."""
    rows, f = _fields(spark, path)
    cap = min(65535, max_count) if max_count else 65535
    return rows.select(f[0].alias("chrom"), f[1].cast("int").alias("l"), f[2].cast("int").alias("r"), F.get(f, F.lit(3)).alias("barcode"), F.least(F.coalesce(F.get(f, F.lit(4)).cast("int"), F.lit(1)), F.lit(cap)).alias("cnt"))


def usable(flag: Column) -> Column:
    """Reads that count: mapped, primary, passed; of pairs, those properly paired, with a mapped mate, and not the second of two."""
    paired = flag.bitwiseAND(1) != 0
    bad = (flag.bitwiseAND(DROP_FLAGS) != 0) | (paired & ((flag.bitwiseAND(8 | 128) != 0) | (flag.bitwiseAND(2) == 0)))
    return ~bad


def reference_length(cigar: Column) -> Column:
    """Bases of the reference that a CIGAR text covers (operations M, D, N, =, X)."""
    parts = F.regexp_extract_all(cigar, F.lit("(\\d+)[MDN=X]"), 1)
    return F.aggregate(parts, F.lit(0), lambda a, x: a + x.cast("int"))


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """Tags of SAM lines at the 5' end of each usable read, 0-based."""
    rows, f = _fields(spark, path, "^@|^\\s*$")
    rows = rows.select(F.regexp_replace(f[2], "\\.fa$", "").alias("chrom"), f[3].cast("int").alias("_p"), f[1].cast("int").alias("_f"), f[5].alias("_c")).where(usable(F.col("_f")) & (F.col("chrom") != "*"))
    strand = F.when(F.col("_f").bitwiseAND(16) != 0, 1).otherwise(0)
    return rows.select("chrom", F.when(strand == 0, F.col("_p") - 1).otherwise(F.col("_p") - 1 + reference_length(F.col("_c"))).alias("pos"), strand.alias("strand"))


def _five_end(start: Column, length: Column, strand: Column) -> Column:
    return F.when(strand == 0, start).otherwise(start + length)


def read_eland_result(spark: SparkSession, path: str) -> DataFrame:
    """Tags of unique hits (U0, U1, U2)."""
    rows, f = _fields(spark, path)
    rows = rows.where(f[2].isin("U0", "U1", "U2"))
    strand = _strand(f[8], "F", "R")
    return rows.select(F.regexp_replace(f[6], "\\.fa$", "").alias("chrom"), _five_end(f[7].cast("int") - 1, F.length(f[1]), strand).alias("pos"), strand.alias("strand"))


def read_eland_multi(spark: SparkSession, path: str) -> DataFrame:
    """Tags of reads with exactly one hit; the hit reads ``name.fa:<pos><F|R><mismatches>``."""
    rows, f = _fields(spark, path)
    hits = F.aggregate(F.split(f[2], ":"), F.lit(0), lambda a, x: a + F.coalesce(x.try_cast("int"), F.lit(2)))
    rows = rows.where((F.size(f) > 3) & (hits == 1))
    at = F.regexp_extract(f[3], ":(\\d+)([FR])", 1).cast("int") - 1
    strand = _strand(F.regexp_extract(f[3], ":(\\d+)([FR])", 2), "F", "R")
    return rows.select(F.regexp_replace(F.regexp_extract(f[3], "^([^:]+):", 1), "\\.fa$", "").alias("chrom"), _five_end(at, F.length(f[1]), strand).alias("pos"), strand.alias("strand"))


def read_eland_export(spark: SparkSession, path: str) -> DataFrame:
    """Tags of the aligned, valid records of an export file (failed lines are left out: see ``export_lines``)."""
    from tidemark.sources.export_lines import loaded_lines

    rows = spark.read.text(path).select(F.monotonically_increasing_id().alias("line_id"), F.col("value").alias("raw_line"))
    good = loaded_lines(rows).where("pos is not null")
    return good.select("chrom", _five_end(F.col("pos"), F.col("read_len"), F.col("strand")).alias("pos"), F.col("strand").cast("int").alias("strand"))


def read_bowtie(spark: SparkSession, path: str) -> DataFrame:
    """Tags of a bowtie map: strand, chrom, 0-based offset, sequence in columns 2 to 5."""
    rows, f = _fields(spark, path)
    strand = _strand(f[1])
    return rows.select(F.regexp_replace(f[2], "\\.fa$", "").alias("chrom"), _five_end(f[3].cast("int"), F.length(f[4]), strand).alias("pos"), strand.alias("strand"))


def read_bedgraph(spark: SparkSession, path: str, baseline: float = 0.0, merge: bool = True) -> DataFrame:
    """A step function; a gap before a chrom's first segment gets the baseline, equal touching neighbours merge."""
    from tidemark.operators.step import rle

    rows, f = _fields(spark, path, sep="\\s+")
    segs = rows.select(f[0].alias("chrom"), f[1].cast("long").alias("start"), f[2].cast("long").alias("end"), f[3].cast("double").alias("value"))
    first = segs.groupBy("chrom").agg(F.min("start").alias("end")).where("end > 0").select("chrom", F.lit(0).cast("long").alias("start"), "end", F.lit(float(baseline)).alias("value"))
    both = segs.unionByName(first)
    return rle(both).select("chrom", "start", "end", "value") if merge else both


def read_regions(spark: SparkSession, path: str) -> DataFrame:
    """``(chrom, start, end, name)`` of BED-like files; columns may be split by any white space."""
    rows, f = _fields(spark, path, sep="\\s+")
    return rows.select(f[0].alias("chrom"), f[1].cast("long").alias("start"), f[2].cast("long").alias("end"), F.get(f, F.lit(3)).alias("name"))


def read_barcodes(spark: SparkSession, path: str) -> DataFrame:
    return _lines(spark, path).select(F.trim("value").alias("barcode")).distinct()


def read_peak_table(spark: SparkSession, path: str) -> DataFrame:
    """Peaks of a tab-separated report with a header line; positions become 0-based."""
    rows, f = _fields(spark, path, "^#|^\\s*$|^chr\\tstart\\t")
    d = lambda i: F.get(f, F.lit(i)).try_cast("double")
    return rows.select(f[0].alias("chrom"), (f[1].cast("long") - 1).alias("start"), f[2].cast("long").alias("end"), (f[4].cast("long") - 1).alias("summit"), d(5).alias("pileup"), d(6).alias("pscore"), d(7).alias("fc"), d(8).alias("qscore"), F.get(f, F.lit(9)).alias("name"))


READERS = {"BED": read_bed, "SAM": read_sam, "ELAND": read_eland_result, "ELANDMULTI": read_eland_multi, "ELANDEXPORT": read_eland_export, "BOWTIE": read_bowtie, "BEDPE": read_bedpe, "FRAG": read_frag, "BEDGRAPH": read_bedgraph}


def _is_bam(spark: SparkSession, path: str) -> bool:
    """Does the first compressed block begin as a BAM file does?"""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(at) or fs.getFileStatus(at).isDirectory():
        return False
    stream = fs.open(at)
    try:
        head = bytes(stream.readNBytes(1 << 16))
    finally:
        stream.close()
    return head[:2] == b"\x1f\x8b" and zlib.decompressobj(31).decompress(head, 4) == b"BAM\1"


def sniff(spark: SparkSession, path: str) -> str:
    """The format of a file: BAM by its first bytes, others by their first lines (no more than 50): the first reader whose shape fits most of them."""
    if _is_bam(spark, path):
        return "BAM"
    first = [r[0].rstrip("\r") for r in spark.read.text(path).limit(50).collect()]
    if any(x.startswith("@") and "\t" in x for x in first):
        return "SAM"
    rows = [x.split("\t") for x in first if x.strip() and not x.startswith(("#", "track", "browse", "@"))]
    num = lambda x: x.lstrip("-").isdigit()
    tests = {
        "BED": lambda f: len(f) >= 6 and num(f[1]) and num(f[2]) and f[5].strip() in "+-.",
        "FRAG": lambda f: len(f) >= 5 and num(f[1]) and num(f[2]) and num(f[4]) and not num(f[3]),
        "BEDGRAPH": lambda f: len(f) == 4 and num(f[1]) and num(f[2]) and f[3].replace(".", "", 1).lstrip("-").isdigit(),
        "BEDPE": lambda f: len(f) == 3 and num(f[1]) and num(f[2]),
        "ELAND": lambda f: len(f) > 8 and f[2] in ("U0", "U1", "U2", "R0", "R1", "R2", "NM", "QC"),
        "ELANDMULTI": lambda f: len(f) >= 3 and (":" in f[2] or f[2] == "NM") and f[0].startswith(">"),
        "ELANDEXPORT": lambda f: len(f) == 22,
        "SAM": lambda f: len(f) >= 11 and num(f[1]) and num(f[3]) and num(f[4]),
        "BOWTIE": lambda f: len(f) >= 6 and f[1] in "+-" and num(f[3]),
    }
    for name, fits in tests.items():
        if rows and sum(fits(f) for f in rows) * 2 > len(rows):
            return name
    raise ValueError(f"no known format: {path}")


def read_tags(spark: SparkSession, path: str, kind: str = "AUTO") -> DataFrame:
    kind = sniff(spark, path) if kind == "AUTO" else kind
    if kind == "BAM":
        from tidemark.sources import bam

        bam.register(spark)
        return bam.tags(spark.read.format("bam").load(path))
    return READERS[kind](spark, path)


#: Of each format the field that holds a read's sequence.
_SEQUENCE = {"SAM": 9, "ELAND": 1, "ELANDMULTI": 1, "ELANDEXPORT": 8, "BOWTIE": 4}


def tag_size(spark: SparkSession, path: str, kind: str = "AUTO") -> float | None:
    """Mean length of the first 10 tags among the first 10,000 lines; null where there is none."""
    kind = sniff(spark, path) if kind == "AUTO" else kind
    if kind == "BAM":
        from tidemark.sources import bam

        bam.register(spark)
        sizes = spark.read.format("bam").load(path).select(F.length("seq").alias("n"))
    else:
        rows, f = _fields(spark, path, "^@|" + _SKIP if kind == "SAM" else _SKIP)
        at = _SEQUENCE.get(kind)
        sizes = rows.limit(10_000).select((F.get(f, F.lit(2)).try_cast("int") - F.get(f, F.lit(1)).try_cast("int") if at is None else F.length(F.get(f, F.lit(at)))).alias("n"))
    return sizes.where("n > 0").limit(10).agg(F.avg("n")).first()[0]
