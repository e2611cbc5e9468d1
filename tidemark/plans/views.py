"""The data folder's tables seen as tags, fragments, regions and signals, in Spark and as SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import intervals, peaks, pileup
from tidemark.plans.tables import table

#: Axis units of a day in the tag views: a day's rows spread over it by their part or customer, so that the axis crosses many shards.
DAY = 1000
#: Axis settings of the tag views.
TREAT_EXT, CTRL_EXT, CTRL_SCALE = 3 * DAY, 12 * DAY, 0.9


def fragments(spark: SparkSession, d: str) -> DataFrame:
    """Valid fragments, each id once: (frag_id, run_id, chrom, l, r, barcode, cnt)."""
    rows = table(spark, d, "fragments").where("frag_id is not null and chrom is not null and l is not null and r > l")
    return rows.select("frag_id", "run_id", "chrom", "l", "r", "barcode", "cnt").distinct()


def regions(spark: SparkSession, d: str) -> DataFrame:
    """Valid peaks as regions, each id once: (peak_id, run_id, chrom, start, end)."""
    rows = table(spark, d, "peaks").where("peak_id is not null and chrom is not null and start_pos is not null and end_pos > start_pos")
    return rows.select("peak_id", "run_id", "chrom", F.col("start_pos").cast("long").alias("start"), F.col("end_pos").cast("long").alias("end")).distinct()


def tags_treat(spark: SparkSession, d: str) -> DataFrame:
    days = F.datediff(F.to_date("l_shipdate"), F.to_date(F.lit("1995-01-01")))
    return table(spark, d, "lineitem").select(F.col("l_returnflag").alias("chrom"), (days * DAY + F.col("l_partkey") % DAY).cast("int").alias("pos"), (F.col("l_linestatus") == "F").cast("int").alias("strand"))


def tags_ctrl(spark: SparkSession, d: str) -> DataFrame:
    days = F.datediff(F.to_date("o_orderdate"), F.to_date(F.lit("1995-01-01")))
    name = F.when(F.col("o_orderstatus") == "F", "A").when(F.col("o_orderstatus") == "O", "N").otherwise("R")
    return table(spark, d, "orders").select(name.alias("chrom"), (days * DAY + F.col("o_custkey") % DAY).cast("int").alias("pos"), (F.col("o_orderpriority") < "3").cast("int").alias("strand"))


def signal_a(spark: SparkSession, d: str) -> DataFrame:
    """Treatment coverage of the tag view."""
    return pileup.pileup_tags(tags_treat(spark, d), TREAT_EXT)


def signal_b(spark: SparkSession, d: str) -> DataFrame:
    """Control coverage: symmetric windows, scaled, at least 1."""
    return pileup.pileup_tags(tags_ctrl(spark, d), CTRL_EXT, directional=False, scale=CTRL_SCALE, baseline=1.0)


def coverage(spark: SparkSession, d: str, kind: str) -> DataFrame:
    """Coverage of the fragments of single cells (``cells``) or of bulk runs (``bulk``)."""
    f = fragments(spark, d)
    return pileup.pileup(f.where("barcode is not null" if kind == "cells" else "barcode is null"))


def islands(spark: SparkSession, d: str) -> DataFrame:
    """Regions where cells cover the axis."""
    return peaks.call(coverage(spark, d, "cells"), 1.0, 50, 100).select("chrom", "start", "end")


merged_regions = lambda spark, d: intervals.merge(regions(spark, d))

# SQL text of the same views.
FRAGS = "f AS (SELECT DISTINCT frag_id, run_id, chrom, l, r, barcode, cnt FROM fragments WHERE frag_id IS NOT NULL AND chrom IS NOT NULL AND l IS NOT NULL AND r > l)"
REGIONS = "rg AS (SELECT DISTINCT peak_id, run_id, chrom, CAST(start_pos AS BIGINT) AS s, CAST(end_pos AS BIGINT) AS e FROM peaks WHERE peak_id IS NOT NULL AND chrom IS NOT NULL AND start_pos IS NOT NULL AND end_pos > start_pos)"
_AT = f"date_diff('day', DATE '1995-01-01', CAST({{}} AS DATE)) * {DAY} + {{}} % {DAY}"
TREAT = f"tt AS (SELECT l_returnflag AS chrom, {_AT.format('l_shipdate', 'l_partkey')} AS pos, CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END AS strand FROM lineitem)"
CTRL = f"tc AS (SELECT CASE o_orderstatus WHEN 'F' THEN 'A' WHEN 'O' THEN 'N' ELSE 'R' END AS chrom, {_AT.format('o_orderdate', 'o_custkey')} AS pos, CASE WHEN o_orderpriority < '3' THEN 1 ELSE 0 END AS strand FROM orders)"


def sql_tag_intervals(name: str, src: str, d: int, shift: int = 0, directional: bool = True) -> str:
    five, three = (-shift, shift + d) if directional else (d // 2 - shift, shift + d - d // 2)
    lo = f"CASE WHEN strand = 0 THEN pos - ({five}) ELSE pos - ({three}) END"
    hi = f"CASE WHEN strand = 0 THEN pos + ({three}) ELSE pos + ({five}) END"
    return f"{name} AS (SELECT chrom, greatest({lo}, 0) AS l, greatest({hi}, 0) AS r FROM {src})"


def sql_pileup(name: str, src: str, w: str = "1", value: str = "v", where: str = "true") -> str:
    """CTEs that define ``name(chrom, s, e, v)`` from ``src(chrom, l, r)``; ``value`` maps the raw sum v."""
    return f"""{name}_e AS (SELECT chrom, p, sum(d) AS d FROM (SELECT chrom, l AS p, {w} AS d FROM {src} WHERE r > l AND {where} UNION ALL SELECT chrom, r, -({w}) FROM {src} WHERE r > l AND {where}) GROUP BY chrom, p HAVING sum(d) <> 0),
{name}_c AS (SELECT chrom, p AS s, lead(p) OVER o AS e, sum(d) OVER o AS v FROM {name}_e WINDOW o AS (PARTITION BY chrom ORDER BY p)),
{name} AS MATERIALIZED (SELECT chrom, CAST(s AS BIGINT) AS s, CAST(e AS BIGINT) AS e, CAST({value} AS DOUBLE) AS v FROM (SELECT chrom, s, e, v FROM {name}_c WHERE e IS NOT NULL UNION ALL SELECT chrom, 0, min(s), 0 FROM {name}_c GROUP BY chrom HAVING min(s) > 0))"""


def sql_align(name: str, tracks: list[str]) -> str:
    """CTEs that define ``name(chrom, s, e, v0, v1, ...)`` over cells that all tracks cover."""
    ends = " UNION ".join(f"SELECT chrom, s AS p FROM {t} UNION SELECT chrom, e FROM {t}" for t in tracks)
    joins = " ".join(f"ASOF JOIN {t} AS j{i} ON c.chrom = j{i}.chrom AND c.s >= j{i}.s" for i, t in enumerate(tracks))
    inside = " AND ".join(f"j{i}.e >= c.e" for i in range(len(tracks)))
    values = ", ".join(f"j{i}.v AS v{i}" for i in range(len(tracks)))
    return f"""{name}_p AS ({ends}), {name}_c AS MATERIALIZED (SELECT chrom, p AS s, lead(p) OVER (PARTITION BY chrom ORDER BY p) AS e FROM {name}_p),
{name} AS MATERIALIZED (SELECT c.chrom, c.s, c.e, {values} FROM {name}_c AS c {joins} WHERE {inside})"""


def sql_rle(name: str, src: str) -> str:
    """CTEs that merge touching equal neighbours of ``src(chrom, s, e, v)``."""
    return f"""{name}_l AS (SELECT *, lag(e) OVER o AS pe, lag(v) OVER o AS pv FROM {src} WINDOW o AS (PARTITION BY chrom ORDER BY s)),
{name}_g AS (SELECT *, sum(CASE WHEN pe = s AND pv IS NOT DISTINCT FROM v THEN 0 ELSE 1 END) OVER (PARTITION BY chrom ORDER BY s) AS g FROM {name}_l),
{name} AS (SELECT chrom, min(s) AS s, max(e) AS e, any_value(v) AS v FROM {name}_g GROUP BY chrom, g)"""


def sql_islands(name: str, src: str, gap: int = 0, keys: str = "chrom") -> str:
    """CTEs that number the islands ``g`` of ``src(keys, s, e, ...)``."""
    return f"""{name}_r AS (SELECT *, max(e) OVER (PARTITION BY {keys} ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM {src}),
{name} AS MATERIALIZED (SELECT *, sum(CASE WHEN s - reach <= {gap} THEN 0 ELSE 1 END) OVER (PARTITION BY {keys} ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM {name}_r)"""


def sql_summits(name: str, src: str, v: str = "v", more: str = "", keys: str = "chrom") -> str:
    """CTEs ``name(keys, g, s, e, summit, top, more)`` from numbered segments."""
    pick = f", {more}" if more else ""
    return f"""{name}_b AS (SELECT {keys}, g, min(s) AS bs, max(e) AS be, max({v}) AS top FROM {src} GROUP BY {keys}, g),
{name}_t AS (SELECT t.*, b.bs, b.be, b.top, row_number() OVER w AS i, count(*) OVER (PARTITION BY {", ".join("t." + k.strip() for k in keys.split(","))}, t.g) AS n FROM {src} AS t JOIN {name}_b AS b USING ({keys}, g) WHERE t.{v} = b.top WINDOW w AS (PARTITION BY {", ".join("t." + k.strip() for k in keys.split(","))}, t.g ORDER BY t.s)),
{name} AS (SELECT {keys}, g, bs AS s, be AS e, CAST((s + e) // 2 AS BIGINT) AS summit, top{pick} FROM {name}_t WHERE i = (n + 1) // 2)"""


SIGNAL_A = ", ".join([TREAT, sql_tag_intervals("ti", "tt", TREAT_EXT), sql_pileup("a", "ti")])
SIGNAL_B = ", ".join([CTRL, sql_tag_intervals("ci", "tc", CTRL_EXT, directional=False), sql_pileup("b", "ci", value=f"greatest(v * {CTRL_SCALE}, 1.0)")])

# Export lines: the fields of each record, the reason of those that fail, and what the valid ones hold.
_P5_CELLS = """
WITH b AS (SELECT line_id, CASE WHEN ends_with(raw_line, chr(13)) THEN left(raw_line, length(raw_line) - 1) ELSE raw_line END AS body FROM export_lines WHERE raw_line IS NOT NULL),
k AS (SELECT * FROM b WHERE length(body) > 0 AND NOT starts_with(body, '#')),
t AS (SELECT line_id, regexp_full_match(body, '(?s)(?:"(?:[^"]|"")*"|[^"\\t][^\\t]*|)(?:\\t(?:"(?:[^"]|"")*"|[^"\\t][^\\t]*|))*') AS sound,
  list_transform(regexp_extract_all(chr(9) || body, '(?s)\\t("(?:[^"]|"")*"|[^"\\t][^\\t]*|)', 1), lambda x: CASE WHEN starts_with(x, '"') THEN replace(substr(x, 2, length(x) - 2), '""', '"') ELSE x END) AS c FROM k),
r AS (SELECT line_id, c, CASE WHEN NOT sound THEN 'quoting' WHEN len(c) <> 22 THEN 'columns'
  WHEN NOT regexp_full_match(c[9], '[ACGTN.]+') THEN 'sequence' WHEN length(c[10]) <> length(c[9]) THEN 'quality'
  WHEN c[13] <> '' AND trim(c[11], ' ') = '' THEN 'chrom'
  WHEN c[13] <> '' AND NOT coalesce(regexp_full_match(c[13], '[0-9]{1,10}') AND TRY_CAST(c[13] AS BIGINT) BETWEEN 1 AND 2147483647, false) THEN 'position'
  WHEN c[13] <> '' AND c[14] NOT IN ('F', 'R') THEN 'strand' WHEN c[22] NOT IN ('Y', 'N') THEN 'filter' END AS reason FROM t)
"""
P5_SQL = _P5_CELLS + "SELECT line_id, reason FROM r WHERE reason IS NOT NULL"
P5_LOADED_SQL = _P5_CELLS + """SELECT line_id, CASE WHEN c[13] <> '' THEN c[11] END AS chrom, CASE WHEN c[13] <> '' THEN CAST(CAST(c[13] AS BIGINT) - 1 AS INT) END AS pos,
  CASE WHEN c[13] <> '' THEN CAST(c[14] = 'R' AS TINYINT) END AS strand, CAST(length(c[9]) AS INT) AS read_len, c[22] = 'Y' AS passed FROM r WHERE reason IS NULL"""
