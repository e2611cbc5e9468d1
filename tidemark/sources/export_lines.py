"""Export records from raw lines: valid rows loaded, failed rows with their reason."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the record layout.
N_FIELDS = 22
SEQUENCE, QUALITY, CHROM, POSITION, STRAND, FILTER = 8, 9, 10, 12, 13, 21
#: (column, kind, reason, rank, only for aligned reads); rank orders the reasons of a record.
RULES = [
    (SEQUENCE, "bases", "sequence", 3, False),
    (QUALITY, "as_long", "quality", 4, False),
    (CHROM, "not_blank", "chrom", 5, True),
    (POSITION, "position", "position", 6, True),
    (STRAND, "strand", "strand", 7, True),
    (FILTER, "yes_no", "filter", 8, False),
]
REASONS = {1: "quoting", 2: "columns"} | {rank: reason for _, _, reason, rank, _ in RULES}
#: A field: quoted with doubled quotes inside, or plain. Possessive, so that long fields need no stack.
FIELD = '"(?:[^"]|"")*+"|[^"\\t][^\\t]*+|'


def parsed(df: DataFrame, line: str = "raw_line", ident: str = "line_id") -> DataFrame:
    """``(ident, h, rank, cells)`` of each record line: cells hold the fields' values, rank is 1 or 2 where they can't be had.

    A trailing carriage return is dropped; null, blank and ``#`` lines are no records and do not come out. ``h`` tells
    lines apart that share an ident; equal lines under one ident are one record.
    """
    body = F.regexp_replace(F.col(line), "\\r\\z", "")
    rows = df.select(F.col(ident).alias("ident"), F.xxhash64(F.col(line)).alias("h"), body.alias("body"))
    rows = rows.where((F.length("body") > 0) & ~F.col("body").startswith("#"))
    quoted = F.instr("body", '"') > 0
    # Only lines with a quote need the pattern; all others split at tabs.
    sound = ~quoted | F.col("body").rlike(f"\\A(?:{FIELD})(?:\\t(?:{FIELD}))*+\\z")
    raw = F.when(~quoted, F.split("body", "\t", -1)).when(sound, F.regexp_extract_all(F.concat(F.lit("\t"), "body"), F.lit(f"\\t({FIELD})"), 1))
    rows = rows.select("ident", "h", F.when(~sound, 1).alias("broken"), raw.alias("raw"))
    value = lambda x: F.when(x.startswith('"'), F.replace(x.substr(F.lit(2), F.length(x) - 2), F.lit('""'), F.lit('"'))).otherwise(x)
    return rows.select("ident", "h", F.coalesce("broken", F.when(F.size("raw") != N_FIELDS, 2)).alias("rank"), F.transform("raw", value).alias("cells"))


def violations(records: DataFrame) -> DataFrame:
    """``(ident, h, rank)``: the first rule in order that each failing record breaks.

    Parsed cells are exploded into (row, column, value), joined with the rule table (a handful of rows, fixed) by
    column, checked, and the broken rules aggregated per record.
    """
    spark = records.sparkSession
    rules = spark.createDataFrame(RULES, "col int, kind string, reason string, rule_rank int, aligned_only boolean").drop("reason")
    whole = records.where("rank is null")
    cells = whole.select("ident", "h", F.length(F.col("cells")[SEQUENCE]).alias("n_seq"), (F.col("cells")[POSITION] != "").alias("aligned"), F.posexplode("cells").alias("col", "value"))
    checked = cells.join(F.broadcast(rules), "col").where(F.col("aligned") | ~F.col("aligned_only"))
    v = F.col("value")
    good = (
        F.when(F.col("kind") == "bases", v.rlike("\\A[ACGTN.]+\\z"))
        .when(F.col("kind") == "as_long", F.length(v) == F.col("n_seq"))
        .when(F.col("kind") == "not_blank", v.rlike("[^ ]"))
        .when(F.col("kind") == "position", v.rlike("\\A[0-9]{1,10}\\z") & F.expr("try_cast(value as bigint)").between(1, 2147483647))
        .when(F.col("kind") == "strand", v.isin("F", "R"))
        .when(F.col("kind") == "yes_no", v.isin("Y", "N"))
    )
    broken = checked.where(~good).select("ident", "h", F.col("rule_rank").alias("rank"))
    return broken.unionByName(records.where("rank is not null").select("ident", "h", "rank")).groupBy("ident", "h").agg(F.min("rank").alias("rank"))


def failed_lines(df: DataFrame, line: str = "raw_line", ident: str = "line_id") -> DataFrame:
    """``(ident, reason)``: the lines that fail and the first reason in the fixed order. Empty input gives no rows."""
    reason = F.create_map(*(F.lit(x) for kv in REASONS.items() for x in kv))[F.col("rank")]
    return violations(parsed(df, line, ident)).select(F.col("ident").alias(ident), reason.alias("reason"))


def loaded_lines(df: DataFrame, line: str = "raw_line", ident: str = "line_id") -> DataFrame:
    """The valid records, typed; failed ones are removed by anti-join, lines that are no records never enter.

    Position becomes 0-based; an unaligned record has null chrom, pos and strand. Strand is 0 for F and 1 for R.
    """
    records = parsed(df, line, ident)
    bad = violations(records).select(F.col("ident").alias("bad_ident"), F.col("h").alias("bad_h"))
    clean = records.where("rank is null").join(bad, F.col("ident").eqNullSafe(F.col("bad_ident")) & (F.col("h") == F.col("bad_h")), "left_anti")
    c = F.col("cells")
    aligned = c[POSITION] != ""
    return clean.dropDuplicates(["ident", "h"]).select(
        F.col("ident").alias(ident),
        F.when(aligned, c[CHROM]).alias("chrom"),
        F.when(aligned, c[POSITION].cast("long") - 1).cast("int").alias("pos"),
        F.when(aligned, (c[STRAND] == "R").cast("tinyint")).alias("strand"),
        F.length(c[SEQUENCE]).alias("read_len"),
        (c[FILTER] == "Y").alias("passed"),
    )
