"""Queries of readers and sinks: tables written in a line format and read back, or the lines themselves, with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import pileup
from tidemark.plans import views as V
from tidemark.plans.tables import scratch, table
from tidemark.sources import sinks, text

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _add(name: str, run: Callable[[SparkSession, str], DataFrame], sql: str) -> None:
    QUERIES[name], SQL[name] = run, sql


def _file(lines: DataFrame, label: str, header: list[str] | None = None) -> str:
    path = scratch(lines.sparkSession, label)
    sinks.write(lines, path, header)
    return path


def _text(df: DataFrame, *fields) -> DataFrame:
    """Tab-separated lines of columns and literals."""
    return df.select(F.concat_ws("\t", *(f if not isinstance(f, str) else F.lit(f) for f in fields)).alias("value"))


_SEQ = "ACGTACGTAC"
_letter = lambda: F.when(F.col("strand") == 0, "F").otherwise("R")
_TAGS = f"WITH {V.TREAT} SELECT chrom, CAST({{}} AS INT) AS pos, strand FROM tt"
_AT_END = "CASE WHEN strand = 0 THEN pos ELSE pos + {} END"


def _sam(spark: SparkSession, d: str) -> DataFrame:
    """Alignments with a skipped stretch; unmapped ones among them are not read."""
    one = lambda df, flag: _text(df, "r", flag.cast("string"), F.concat("chrom", F.lit(".fa")), (F.col("pos") + 1).cast("string"), "30", "20M5N20M", "*", "0", "0", _SEQ, "IIIIIIIIII")
    lines = one(V.tags_treat(spark, d), F.col("strand") * 16).union(one(V.tags_ctrl(spark, d), F.lit(4)))
    return text.read_sam(spark, _file(lines, "sam", ["@HD\tVN:1.0"]))


_add("format_bed", lambda s, d: text.read_bed(s, _file(sinks.tag_bed(V.tags_treat(s, d), 50), "bed", ["track name=tags"])), _TAGS.format("pos"))
_add("format_bedpe", lambda s, d: text.read_bedpe(s, _file(sinks.fragment_bed(V.fragments(s, d).select("chrom", "l", "r")), "bedpe")), f"WITH {V.FRAGS} SELECT chrom, l, r FROM f")
_add("format_frag", lambda s, d: text.read_frag(s, _file(sinks.fragment_bed(V.fragments(s, d).where("barcode is not null and cnt is not null").select("chrom", "l", "r", "barcode", "cnt")), "frag")), f"WITH {V.FRAGS} SELECT chrom, l, r, barcode, CAST(least(cnt, 65535) AS INT) AS cnt FROM f WHERE barcode IS NOT NULL AND cnt IS NOT NULL")
_add("format_sam", _sam, _TAGS.format(_AT_END.format(45)))
_add(
    "format_eland_result",
    lambda s, d: text.read_eland_result(s, _file(_text(V.tags_treat(s, d), ">r", _SEQ, "U1", "0", "1", "0", F.concat("chrom", F.lit(".fa")), (F.col("pos") + 1).cast("string"), _letter(), "..").union(_text(V.tags_ctrl(s, d), ">r", _SEQ, "NM", "0", "0", "0")), "eland")),
    _TAGS.format(_AT_END.format(len(_SEQ))),
)
_add(
    "format_eland_multi",
    lambda s, d: text.read_eland_multi(s, _file(_text(V.tags_treat(s, d), ">r", _SEQ, "0:1:0", F.concat("chrom", F.lit(".fa:"), (F.col("pos") + 1).cast("string"), _letter(), F.lit("1"))).union(_text(V.tags_ctrl(s, d), ">r", _SEQ, "1:1:0", "x.fa:1F0,2F1")), "multi")),
    _TAGS.format(_AT_END.format(len(_SEQ))),
)
_add("format_bowtie", lambda s, d: text.read_bowtie(s, _file(_text(V.tags_treat(s, d), "r", F.when(F.col("strand") == 0, "+").otherwise("-"), "chrom", F.col("pos").cast("string"), _SEQ, "IIIIIIIIII").select(F.regexp_replace("value", "\tchrom\t", "\tX\t").alias("value")), "bowtie")), f"WITH {V.TREAT} SELECT 'X' AS chrom, CAST({_AT_END.format(len(_SEQ))} AS INT) AS pos, strand FROM tt")
_add("format_bedgraph", lambda s, d: text.read_bedgraph(s, _file(sinks.bedgraph(V.signal_a(s, d)), "bedgraph", ["track type=bedGraph"])), f'WITH {V.SIGNAL_A}, {V.sql_rle("z", "a")} SELECT chrom, s AS "start", e AS "end", v AS value FROM z')
_MERGED = f"WITH {V.REGIONS}, rd AS (SELECT DISTINCT chrom, s, e FROM rg), {V.sql_islands('ri', 'rd')}, mr AS (SELECT chrom, min(s) AS s, max(e) AS e FROM ri GROUP BY chrom, g)"
_add("format_regions", lambda s, d: text.read_regions(s, _file(sinks.regions(V.merged_regions(s, d)), "regions")).drop("name"), f'{_MERGED} SELECT chrom, s AS "start", e AS "end" FROM mr')
_add("format_barcodes", lambda s, d: text.read_barcodes(s, _file(table(s, d, "fragments").where("barcode is not null").select(F.col("barcode").alias("value")), "barcodes")), "SELECT DISTINCT barcode FROM fragments WHERE barcode IS NOT NULL")
_add("sink_bedgraph", lambda s, d: sinks.track_bedgraph(V.signal_b(s, d), "value"), f"""WITH {V.SIGNAL_B}, {V.sql_rle("z", "b")} SELECT printf('%s\t%d\t%d\t%.5f', chrom, s, e, v) AS value FROM z""")
_add(
    "sink_per_million",
    lambda s, d: sinks.pair_bedgraphs(pileup.together({"treat": {"df": pileup.clip(pileup.tag_intervals(V.tags_treat(s, d), V.TREAT_EXT))}, "ctrl": {"df": pileup.clip(pileup.tag_intervals(V.tags_ctrl(s, d), V.CTRL_EXT, directional=False))}}), 4e6)["treat"],
    f"""WITH {V.SIGNAL_A}, {V.CTRL}, {V.sql_tag_intervals("ci", "tc", V.CTRL_EXT, directional=False)}, {V.sql_pileup("b", "ci")}, {V.sql_align("x", ["a", "b"])}, y AS (SELECT chrom, s, e, v0 / 4 AS v FROM x), {V.sql_rle("z", "y")} SELECT printf('%s\t%d\t%d\t%.5f', chrom, s, e, v) AS value FROM z""",
)
_add("sink_fragments", lambda s, d: sinks.fragment_bed(V.fragments(s, d).select("chrom", "l", "r")), f"WITH {V.FRAGS} SELECT concat_ws('\t', chrom, l, r) AS value FROM f")

def _sniffed(spark: SparkSession, d: str) -> DataFrame:
    """The formats found of files in five formats."""
    tags = V.tags_treat(spark, d)
    files = {
        "bed": sinks.tag_bed(tags, 50),
        "bedpe": sinks.fragment_bed(V.fragments(spark, d).select("chrom", "l", "r")),
        "frag": sinks.fragment_bed(V.fragments(spark, d).where("barcode is not null and cnt is not null").select("chrom", "l", "r", "barcode", "cnt")),
        "eland": _text(tags, ">r", _SEQ, "U1", "0", "1", "0", "c.fa", "1", _letter(), ".."),
        "bowtie": _text(tags, "r", "+", "c", "1", _SEQ, "IIIIIIIIII"),
    }
    paths = {name: _file(lines, name) for name, lines in files.items()}
    found = [(name, text.sniff(spark, path), text.tag_size(spark, path) if name in ("eland", "bowtie") else None) for name, path in paths.items()]
    return spark.createDataFrame(found, "file string, kind string, tag_size double")


_add("format_sniff", _sniffed, "SELECT * FROM (VALUES ('bed', 'BED', CAST(NULL AS DOUBLE)), ('bedpe', 'BEDPE', NULL), ('frag', 'FRAG', NULL), ('eland', 'ELAND', 10.0), ('bowtie', 'BOWTIE', 10.0)) AS t(file, kind, tag_size)")
