"""Writers of line formats: each gives a DataFrame with one string column ``value``, ordered as the file is, or writes it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import step
from tidemark.operators.ordered import along
from tidemark.operators.tracks import subpeak_letters


def write(lines: DataFrame, path: str, header: list[str] | None = None, single: bool = False, compression: str = "none") -> None:
    """Lines to a folder of text files (``gzip`` ones by ``compression``); ``header`` lines lead the first. One file only if ``single``."""
    out = lines.select("value")
    if header:
        top = lines.sparkSession.createDataFrame([(h,) for h in header], "value string").coalesce(1)
        out = top.union(out)
    (out.coalesce(1) if single else out).write.mode("overwrite").option("compression", compression).text(path)


def _sorted(df: DataFrame, value: Column, *more: str) -> DataFrame:
    return df.orderBy("chrom", "start", *more).select(value.alias("value"))


def general(c: Column, digits: int = 6) -> Column:
    """A number to so many significant digits, without trailing zeros."""
    size = F.when(c == 0, 0).otherwise(F.floor(F.log10(F.abs(c))).cast("int"))
    plain = F.rtrim(F.format_string("%.12f", F.round(c * F.pow(F.lit(10.0), F.lit(digits - 1) - size)) / F.pow(F.lit(10.0), F.lit(digits - 1) - size)), F.lit("0"))
    mant = F.regexp_replace(F.regexp_replace(F.format_string(f"%.{digits - 1}e", c), "\\.?0+e", "e"), "e([+-])(\\d)$", "e$10$2")
    return F.when((c != 0) & ((size < -5 + 1) | (size >= digits)), mant).otherwise(F.regexp_replace(plain, "\\.$", ""))


def bedgraph(df: DataFrame, column: str = "value", digits: int = 5) -> DataFrame:
    return _sorted(df, F.format_string(f"%s\t%d\t%d\t%.{digits}f", "chrom", F.col("start").cast("long"), F.col("end").cast("long"), F.col(column).cast("double")))


def track_bedgraph(cells: DataFrame, column: str = "score", tolerance: float = 1e-5) -> DataFrame:
    """bedGraph of one column of cells; neighbours that differ by at most ``tolerance`` are one line."""
    return bedgraph(step.rle(cells.select("chrom", "start", "end", F.col(column).cast("double").alias("value")), tolerance=tolerance))


def pair_bedgraphs(cells: DataFrame, per_million: float | None = None) -> dict[str, DataFrame]:
    """bedGraphs of ``treat`` and ``ctrl``; with ``per_million`` (reads of the treatment) values are per million of them."""
    k = 1e6 / per_million if per_million else 1.0
    return {c: track_bedgraph(cells.withColumn(c, F.col(c) * k), c) for c in ("treat", "ctrl")}


def condition_matrix(cells: DataFrame) -> DataFrame:
    """One line per cell of a differential track: ``chrom:start_end`` and its three ratios."""
    return _sorted(cells, F.format_string("%s:%d_%d\t%.5f\t%.5f\t%.5f", "chrom", F.col("start").cast("long"), F.col("end").cast("long"), "llr1", "llr2", "llr12"))


def condition_bedgraph(cells: DataFrame, column: str) -> DataFrame:
    """bedGraph of one ratio (``llr1``, ``llr2``, ``llr12``) of a differential track."""
    return track_bedgraph(cells, column, 1e-6)


def state_bed(runs: DataFrame) -> DataFrame:
    """State runs but those of the background."""
    return _sorted(runs.where("state <> 'bg'"), F.concat_ws("\t", "chrom", "start", "end", "state"))


def likelihood_bedgraphs(posteriors: DataFrame, size: int = 10) -> dict[str, DataFrame]:
    """bedGraphs of the posteriors of the three states; what no bin covers, from 0 on, is background."""
    names = ("p_open", "p_nuc", "p_bg")
    cells = posteriors.select("chrom", (F.col("bin_end") - size).alias("start"), F.col("bin_end").alias("end"), *names)
    seen = along(cells, ["chrom"], "start", lags={"_e": F.col("end")})
    void = F.when(F.col("start") > F.coalesce("_e", F.lit(0)), F.struct(F.coalesce("_e", F.lit(0)).cast("long").alias("start"), F.col("start").alias("end"), F.lit(0.0).alias("p_open"), F.lit(0.0).alias("p_nuc"), F.lit(1.0).alias("p_bg")))
    full = seen.select("chrom", F.inline(F.filter(F.array(F.struct("start", "end", *names), void), lambda x: x.isNotNull())))
    return {n.removeprefix("p_"): bedgraph(step.rle(full.select("chrom", "start", "end", F.col(n).alias("value")))) for n in names}


def fastq(reads: DataFrame) -> DataFrame:
    """Four lines a read in one row, as sequenced: reverse reads are turned back; qualities are shifted by 33."""
    back = F.col("flag").bitwiseAND(16) != 0
    seq = F.when(back, F.translate(F.reverse("seq"), "ACGTacgt", "TGCAtgca")).otherwise(F.col("seq"))
    codes = F.transform(F.split(F.regexp_replace(F.hex("qual"), "(..)(?!$)", "$1,"), ","), lambda x: F.chr(F.conv(x, 16, 10).cast("int") + 33))
    text = F.when(F.length("qual") == 0, "").otherwise(F.array_join(codes, ""))
    return reads.select(F.concat(F.lit("@"), "name", F.lit("\n"), seq, F.lit("\n+\n"), F.when(back, F.reverse(text)).otherwise(text)).alias("value"))


def regions(df: DataFrame) -> DataFrame:
    return _sorted(df, F.concat_ws("\t", "chrom", "start", "end"), "end")


def named(peaks: DataFrame, prefix: str = "peak_") -> DataFrame:
    """Peaks with names: numbered by chrom and start; those that share their bounds get letters by summit."""
    spots = peaks.select("chrom", "start", "end").distinct()
    from tidemark.operators.intervals import batches

    number = batches(spots, 1).select("chrom", "start", "end", (F.col("batch") + 1).alias("_n"))
    w = Window.partitionBy("chrom", "start", "end")
    many = F.count("*").over(w) > 1
    letter = F.when(many, subpeak_letters(F.row_number().over(w.orderBy("summit")) - 1)).otherwise("")
    return peaks.withColumn("_l", letter).join(number, ["chrom", "start", "end"]).withColumn("name", F.concat(F.lit(prefix), F.col("_n").cast("string"), "_l")).drop("_n", "_l")


def bed(peaks: DataFrame, column: str = "score") -> DataFrame:
    return _sorted(peaks, F.concat_ws("\t", "chrom", "start", "end", "name", F.format_string("%.5f", F.col(column).cast("double"))), "name")


def summits_bed(peaks: DataFrame, column: str = "score") -> DataFrame:
    return _sorted(peaks, F.concat_ws("\t", "chrom", "summit", F.col("summit") + 1, "name", F.format_string("%.5f", F.col(column).cast("double"))), "name")


def narrow_peak(peaks: DataFrame, column: str = "qscore") -> DataFrame:
    """Ten columns; the score is ten times the column, cut to a whole number; the summit is an offset, -1 without one."""
    offset = F.coalesce(F.col("summit") - F.col("start"), F.lit(-1))
    return _sorted(peaks, F.concat_ws("\t", "chrom", "start", "end", "name", (10 * F.col(column)).cast("int"), F.lit("."), general(F.col("fc")), general(F.col("pscore")), general(F.col("qscore")), offset), "name")


def peak_table(peaks: DataFrame) -> DataFrame:
    """The tab-separated report with 1-based positions; its header is ``PEAK_TABLE_HEADER``."""
    pile = general(F.round("pileup", 2))
    return _sorted(peaks, F.concat_ws("\t", "chrom", F.col("start") + 1, "end", F.col("end") - F.col("start"), F.col("summit") + 1, pile, general(F.col("pscore")), general(F.col("fc")), general(F.col("qscore")), "name"), "name")


# Fixed value: the header line of the report.
PEAK_TABLE_HEADER = "\t".join(["chr", "start", "end", "length", "abs_summit", "pileup", "-log10(pvalue)", "fold_enrichment", "-log10(qvalue)", "name"])


def broad_peak(peaks: DataFrame, column: str = "qscore") -> DataFrame:
    return _sorted(peaks, F.concat_ws("\t", "chrom", "start", "end", "name", (10 * F.col(column)).cast("int"), F.lit("."), general(F.col("fc")), general(F.col("pscore")), general(F.col("qscore"))), "name")


def gapped_peak(peaks: DataFrame, column: str = "qscore") -> DataFrame:
    """BED12 with the strong regions as blocks, then fc, pscore and qscore."""
    return _sorted(peaks, F.concat_ws("\t", *_bed12(column), general(F.col("fc")), general(F.col("pscore")), general(F.col("qscore"))), "name")


def bed12(peaks: DataFrame, column: str = "score") -> DataFrame:
    return _sorted(peaks, F.concat_ws("\t", *_bed12(column)), "name")


def _bed12(column: str) -> list[Column]:
    join = lambda field: F.concat_ws(",", F.transform("blocks", lambda b: b[field].cast("string")))
    thick = [F.coalesce(F.col(c), F.lit(0)).cast("string") for c in ("thick_start", "thick_end")]
    return [F.col("chrom"), F.col("start").cast("string"), F.col("end").cast("string"), F.col("name"), (10 * F.col(column)).cast("int").cast("string"), F.lit("."), *thick, F.lit("0"), F.size("blocks").cast("string"), join("size"), join("offset")]


def tag_bed(tags: DataFrame, size: int) -> DataFrame:
    start = F.when(F.col("strand") == 0, F.col("pos")).otherwise(F.greatest(F.col("pos") - size, F.lit(0)))
    end = F.when(F.col("strand") == 0, F.col("pos") + size).otherwise(F.col("pos"))
    rows = tags.withColumn("start", start).withColumn("end", end)
    return _sorted(rows, F.concat_ws("\t", "chrom", "start", "end", F.lit("."), F.lit("."), F.when(F.col("strand") == 0, "+").otherwise("-")), "end")


def fragment_bed(frags: DataFrame) -> DataFrame:
    more = [c for c in ("barcode", "cnt") if c in frags.columns]
    return frags.orderBy("chrom", "l", "r").select(F.concat_ws("\t", "chrom", "l", "r", *more).alias("value"))


def cutoff_lines(table: DataFrame) -> DataFrame:
    """Lines of a cutoff table, the highest first, with its ``qscore`` if it has one; headers are ``CUTOFF_HEADERS``."""
    more = ["qscore"] if "qscore" in table.columns else []
    line = F.format_string("%.2f\t" + "%.2f\t" * len(more) + "%d\t%d\t%.2f", "cutoff", *more, "npeaks", "lpeaks", "avelpeak")
    return table.orderBy(F.col("cutoff").desc()).select(line.alias("value"))


# Header lines of cutoff tables, of a track's scores and of a caller's.
CUTOFF_HEADERS = ("score\tnpeaks\tlpeaks\tavelpeak", "pscore\tqscore\tnpeaks\tlpeaks\tavelpeak")
# The fields of a variant line and what they mean (number, type, description).
VCF_INFO = {
    "M": (".", "String", "model of the lowest BIC"),
    "MT": (".", "String", "SNV, Insertion or Deletion"),
    "DPT": ("1", "Integer", "depth in the treatment"),
    "DPC": ("1", "Integer", "depth in the control"),
    "DP1T": (".", "String", "depth of the first allele in the treatment"),
    "DP2T": (".", "String", "depth of the second allele in the treatment"),
    "DP1C": (".", "String", "depth of the first allele in the control"),
    "DP2C": (".", "String", "depth of the second allele in the control"),
    "SB": ("4", "Integer", "first and second allele on the forward, then on the reverse strand"),
    "DBIC": (".", "Float", "BIC of the second best model less that of the best"),
    "BICHOMOMAJOR": ("1", "Float", "BIC of the first allele alone"),
    "BICHOMOMINOR": ("1", "Float", "BIC of the second allele alone"),
    "BICHETERNOAS": ("1", "Float", "BIC of both alleles in balance"),
    "BICHETERAS": ("1", "Float", "BIC of both alleles with a bias"),
    "AR": ("1", "Float", "share of the first allele in the treatment"),
}
VCF_FORMAT = {"GT": ("1", "String", "genotype"), "DP": ("1", "Integer", "depth"), "GQ": ("1", "Integer", "genotype quality"), "PL": ("3", "Integer", "Phred-scaled likelihoods of 00, 01 and 11")}
VCF_COLUMNS = "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tSAMPLE"


def vcf_header(contigs: dict[str, int], date: str = "", source: str = "tidemark", arguments: str = "") -> list[str]:
    """Header lines of a VCF 4.1 file; ``contigs`` are names and lengths (of a BAM header)."""
    out = ["##fileformat=VCFv4.1", f"##fileDate={date}", f"##source={source}", f"##Program_Args={arguments}"]
    for kind, fields in (("INFO", VCF_INFO), ("FORMAT", VCF_FORMAT)):
        out += [f'##{kind}=<ID={k},Number={n},Type={t},Description="{d}">' for k, (n, t, d) in fields.items()]
    return out + [f"##contig=<ID={c},length={n},assembly=NA>" for c, n in contigs.items()] + [VCF_COLUMNS]


def variant_vcf(calls: DataFrame) -> DataFrame:
    """VCF lines of called variants (``operators.variants.CALLS``), positions 1-based."""
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    whole = lambda c: F.format_string("%d", F.round(c).cast("long"))
    real = lambda c: F.format_string("%.2f", c)
    deep = lambda m, allele: F.concat(whole(m), F.coalesce(F.col(allele), F.lit("")))
    t1, t2 = n("n1") - n("ctrl1"), n("n2") - n("ctrl2")
    strands = F.concat_ws(",", whole(n("plus1")), whole(n("plus2")), whole(n("n1") - n("plus1")), whole(n("n2") - n("plus2")))
    values = {
        "M": F.col("model"), "MT": F.col("mutation"), "DPT": whole(F.col("depth") - n("depth_ctrl")), "DPC": whole(n("depth_ctrl")), "DP1T": deep(t1, "top1"), "DP2T": deep(t2, "top2"), "DP1C": deep(n("ctrl1"), "top1"), "DP2C": deep(n("ctrl2"), "top2"), "SB": strands,
        "DBIC": real(F.col("delta_bic")), "BICHOMOMAJOR": real(F.col("bic_major")), "BICHOMOMINOR": real(F.col("bic_minor")), "BICHETERNOAS": real(F.col("bic_hetero")), "BICHETERAS": real(F.col("bic_biased")), "AR": real(F.coalesce(F.try_divide(t1, t1 + t2), F.lit(0.0))),
    }
    info = F.concat_ws(";", *(F.concat(F.lit(f"{k}="), v) for k, v in values.items()))
    sample = F.concat_ws(":", "gt", whole(F.col("depth")), whole(F.col("gq")), F.array_join(F.col("pl").cast("array<string>"), ","))
    return vcf(calls.select("chrom", "pos", "ref", "alt", whole(F.col("gq")).alias("qual"), info.alias("info"), F.lit(":".join(VCF_FORMAT)).alias("format"), sample.alias("sample")))


def vcf(variants: DataFrame) -> DataFrame:
    """VCF lines of ``(chrom, pos 0-based, ref, alt, qual, info, format, sample)``."""
    rows = variants.withColumn("start", F.col("pos"))
    return _sorted(rows, F.concat_ws("\t", "chrom", F.col("pos") + 1, F.lit("."), "ref", "alt", F.col("qual").cast("string"), F.lit("."), "info", "format", "sample"))


def matrix(counts: DataFrame, path: str) -> None:
    """The entity-by-region matrix in long form, partitioned by chrom."""
    counts.write.mode("overwrite").partitionBy("chrom").parquet(path)
