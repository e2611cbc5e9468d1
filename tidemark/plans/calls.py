"""Queries of whole commands and of distributions, with their SQL twins."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import scores, stats
from tidemark.operators import models, peaks, pileup, step, tracks, variants
from tidemark.plans import commands
from tidemark.plans import views as V
from tidemark.plans.tables import table
from tidemark.sources import sinks, text
from tidemark.sources.export_lines import loaded_lines

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def add(name: str, run: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = run
    if sql:
        SQL[name] = sql


def _round(df: DataFrame, n: int = 3) -> DataFrame:
    return df.select(*(F.round(F.col(c), n).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


# Enriched intervals of tags against a control: the smaller control is scaled up, the background is the greatest of
# three windows around control tags and of the whole genome's.
_CALL = {"genome": 7.5e6, "keep_dup": "all", "extsize": 3000, "slocal": 6000, "llocal": 30000, "max_gap": 100, "min_length": 300, "scale_to": "large", "p": 0.01}
_D, _WINDOWS = _CALL["extsize"], {"w0": (3000, 1.0), "w1": (6000, 0.5), "w2": (30000, 0.1)}
_BG = f"(SELECT count(*) * {_D} / {_CALL['genome']} FROM tt)"
_RATIO = "(SELECT (SELECT count(*) FROM tt) / (SELECT count(*) FROM tc))"


def _called(spark: SparkSession, d: str, **more) -> dict[str, DataFrame]:
    return commands.callpeak(V.tags_treat(spark, d), V.tags_ctrl(spark, d), **(_CALL | more))


def _cells_sql(windows: list[str], bg: str) -> str:
    """CTEs that define ``x`` (treatment v0 beside the greatest of the windows v1) from ``t`` and the windows' pileups."""
    ends = " UNION ".join(f"SELECT chrom, s AS p FROM {t} UNION SELECT chrom, e FROM {t}" for t in ("t", *windows))
    joins = " ".join(f"ASOF LEFT JOIN {n} ON c.chrom = {n}.chrom AND c.s >= {n}.s" for n in windows)
    back = ", ".join(f"CASE WHEN {n}.e >= c.e THEN {n}.v ELSE {bg} END" for n in windows)
    return f"""bp AS ({ends}), c AS MATERIALIZED (SELECT chrom, p AS s, lead(p) OVER (PARTITION BY chrom ORDER BY p) AS e FROM bp),
x AS MATERIALIZED (SELECT c.chrom, c.s, c.e, t.v AS v0, greatest({back}) AS v1 FROM c ASOF JOIN t ON c.chrom = t.chrom AND c.s >= t.s {joins} WHERE t.e >= c.e)"""


def _windows_sql() -> str:
    parts = [f"{V.sql_tag_intervals(f'i{n}', 'tc', w, directional=False)}, {V.sql_pileup(n, f'i{n}', value=f'greatest(round(v, 9) * {k} * {_RATIO}, {_BG})')}" for n, (w, k) in _WINDOWS.items()]
    return f"""{V.TREAT}, {V.CTRL}, {V.sql_tag_intervals("ti", "tt", _D)}, {V.sql_pileup("t", "ti")}, {", ".join(parts)}, {_cells_sql(list(_WINDOWS), _BG)}"""


# Terms of the tail from k + 1 up, and how many of them count: the first to raise the logarithm by less than 1e-5 is the last.
_TERMS = "list_transform(range(CAST(k AS BIGINT) + 1, CAST(k AS BIGINT) + 201), lambda j: exp(j * ln(lam) - lam - lgamma(j + 1)))"
_TAIL = "-log10(list_sum(x[1:list_filter(range(2, 201), lambda i: x[i] < (exp(1e-5) - 1) * list_sum(x[1:i - 1]))[1]]))"
# Distinct pairs are told apart to 9 decimals, as the two engines may differ in the last bit.
_PQ = f"""k AS (SELECT *, trunc(v0) AS k, round(v1, 9) AS lam FROM x), dk AS (SELECT DISTINCT k, lam FROM k), tk AS (SELECT k, lam, {_TERMS} AS x FROM dk), pk AS (SELECT k, lam, round({_TAIL}, 5) AS p FROM tk), p AS MATERIALIZED (SELECT k.chrom, k.s, k.e, v0, v1, p FROM k JOIN pk USING (k, lam)),
h AS (SELECT p, sum(e - s) AS n FROM p GROUP BY p), r AS (SELECT p, n, 1 + coalesce(sum(n) OVER (ORDER BY p DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k, sum(n) OVER () AS t FROM h),
q AS (SELECT p, greatest(0.0, min(p + log10(k) - log10(t)) OVER (ORDER BY p DESC ROWS UNBOUNDED PRECEDING)) AS q FROM r), pq AS MATERIALIZED (SELECT p.chrom, p.s, p.e, v0, v1, p.p, q.q FROM p JOIN q USING (p))"""
_SCORED = f"WITH {_windows_sql()}, {_PQ}"
_P, _WEAK = -math.log10(0.01), -math.log10(0.1)
_BOUNDS = 'chrom, s AS "start", e AS "end"'

add("callpeak_cells", lambda s, d: _round(_called(s, d)["cells"]), f"{_SCORED} SELECT {_BOUNDS}, round(v0, 3) AS treat, round(v1, 3) AS ctrl, round(p, 3) AS pscore, round(q, 3) AS qscore FROM pq")
add(
    "callpeak_control",
    lambda s, d: _round(_called(s, d)["peaks"]),
    f"""{_SCORED}, z AS (SELECT * FROM pq WHERE p > {_P}), {V.sql_islands("i", "z", 100)}, {V.sql_summits("u", "i", "v0", "v1, p, q")}
SELECT {_BOUNDS}, summit, round(top, 3) AS pileup, round((top + 1) / (v1 + 1), 3) AS fc, round(p, 3) AS pscore, round(q, 3) AS qscore FROM u WHERE e - s >= 300 AND p >= {_P} AND (top + 1) / (v1 + 1) >= 1""",
)
add(
    "callpeak_broad",
    lambda s, d: _round(_called(s, d, broad=True, broad_cutoff=0.1)["peaks"]).select("chrom", "start", "end", "thick_start", "thick_end", F.size("blocks").cast("bigint").alias("n_blocks"), "pileup", "fc", "pscore", "qscore"),
    f"""{_SCORED}, z1 AS (SELECT * FROM pq WHERE p > {_P}), {V.sql_islands("i1", "z1", 100)}, z2 AS (SELECT * FROM pq WHERE p > {_WEAK}), {V.sql_islands("i2", "z2", 400)},
s1 AS (SELECT chrom, min(s) AS s, max(e) AS e FROM i1 GROUP BY chrom, g HAVING max(e) - min(s) >= 300),
s2 AS (SELECT chrom, min(s) AS s, max(e) AS e, sum(v0 * (e - s)) / sum(e - s) AS a, sum((v0 + 1) / (v1 + 1) * (e - s)) / sum(e - s) AS b, sum(p * (e - s)) / sum(e - s) AS c, sum(q * (e - s)) / sum(e - s) AS m FROM i2 GROUP BY chrom, g HAVING max(e) - min(s) >= 300),
n AS (SELECT s2.chrom, s2.s, s2.e, any_value(a) AS a, any_value(b) AS b, any_value(c) AS c, any_value(m) AS m, min(s1.s) AS ts, max(s1.e) AS te, count(s1.s) AS n FROM s2 LEFT JOIN s1 ON s1.chrom = s2.chrom AND s1.s >= s2.s AND s1.e <= s2.e WHERE s2.chrom IN (SELECT chrom FROM s1) GROUP BY s2.chrom, s2.s, s2.e)
SELECT {_BOUNDS}, ts AS thick_start, te AS thick_end, CAST(n + CASE WHEN ts IS NULL OR ts > s THEN 1 ELSE 0 END + CASE WHEN te IS NULL OR te < e THEN 1 ELSE 0 END AS BIGINT) AS n_blocks, round(a, 3) AS pileup, round(b, 3) AS fc, round(c, 3) AS pscore, round(m, 3) AS qscore FROM n WHERE b >= 1""",
)
_GRID = [round(0.3 * k, 1) for k in range(1, 34)]
add(
    "callpeak_cutoffs",
    lambda s, d: _round(_called(s, d, cutoff_analysis=True)["cutoffs"], 2),
    f"""{_SCORED}, g AS (SELECT unnest({_GRID}) AS cutoff), z AS (SELECT cutoff, chrom, s, e FROM pq, g WHERE p > cutoff), {V.sql_islands("i", "z", 100, "cutoff, chrom")}, n AS (SELECT cutoff, max(e) - min(s) AS len FROM i GROUP BY cutoff, chrom, g HAVING max(e) - min(s) >= 300)
SELECT CAST(cutoff AS DOUBLE) AS cutoff, count(*) AS npeaks, CAST(sum(len) AS BIGINT) AS lpeaks, round(avg(len), 2) AS avelpeak, round(any_value(qs), 2) AS qscore FROM n JOIN (SELECT cutoff, arg_min(q, p) AS qs FROM g, (SELECT DISTINCT p, q FROM pq) AS u WHERE u.p >= cutoff GROUP BY cutoff) USING (cutoff) GROUP BY cutoff""",
)
_NAMED = f"""{_SCORED}, z AS (SELECT * FROM pq WHERE p > {_P}), {V.sql_islands("i", "z", 100)}, {V.sql_summits("u", "i", "v0", "v1, p, q")},
y AS (SELECT chrom, s, e, summit, round(top, 3) AS pileup, round((top + 1) / (v1 + 1), 3) AS fc, round(p, 3) AS p, round(q, 3) AS q FROM u WHERE e - s >= 300 AND p >= {_P} AND (top + 1) / (v1 + 1) >= 1),
o AS (SELECT *, 'peak_' || row_number() OVER (ORDER BY chrom, s) AS name FROM y)"""
_named = lambda s, d: sinks.named(_round(_called(s, d)["peaks"]))
add("sink_narrow_peak", lambda s, d: sinks.narrow_peak(_named(s, d)), f"{_NAMED} SELECT concat_ws('\t', chrom, s, e, name, CAST(trunc(10 * q) AS INT), '.', format('{{:.6g}}', fc), format('{{:.6g}}', p), format('{{:.6g}}', q), summit - s) AS value FROM o")
add("sink_summits", lambda s, d: sinks.summits_bed(_named(s, d), "qscore"), f"{_NAMED} SELECT concat_ws('\t', chrom, summit, summit + 1, name, printf('%.5f', q)) AS value FROM o")
add("sink_bed", lambda s, d: sinks.bed(_named(s, d), "qscore"), f"{_NAMED} SELECT concat_ws('\t', chrom, s, e, name, printf('%.5f', q)) AS value FROM o")
add("sink_cutoffs", lambda s, d: sinks.cutoff_lines(_round(_called(s, d, cutoff_analysis=True)["cutoffs"], 2)), "WITH y AS (" + SQL["callpeak_cutoffs"] + ") SELECT printf('%.2f\t%.2f\t%d\t%d\t%.2f', cutoff, qscore, npeaks, lpeaks, avelpeak) AS value FROM y")


def _table_back(spark: SparkSession, d: str) -> DataFrame:
    """The tab-separated report, written and read."""
    from tidemark.plans.formats import _file

    return text.read_peak_table(spark, _file(sinks.peak_table(_named(spark, d)), "peaks", ["# a comment", sinks.PEAK_TABLE_HEADER]))


add("format_peak_table", _table_back, f'{_NAMED} SELECT chrom, s AS "start", e AS "end", summit, CAST(format(\'{{:.6g}}\', round(pileup, 2)) AS DOUBLE) AS pileup, CAST(format(\'{{:.6g}}\', p) AS DOUBLE) AS pscore, CAST(format(\'{{:.6g}}\', fc) AS DOUBLE) AS fc, CAST(format(\'{{:.6g}}\', q) AS DOUBLE) AS qscore, name FROM o')
add("callpeak_by_fold", lambda s, d: _round(_called(s, d, cutoffs={"f": 1.2})["peaks"]).select("chrom", "start", "end", "summit", "pileup", "fc"), f"""{_SCORED}, z AS (SELECT * FROM pq WHERE (v0 + 1) / (v1 + 1) > 1.2), {V.sql_islands("i", "z", 100)}, {V.sql_summits("u", "i", "v0", "v1")}
SELECT {_BOUNDS}, summit, round(top, 3) AS pileup, round((top + 1) / (v1 + 1), 3) AS fc FROM u WHERE e - s >= 300 AND (top + 1) / (v1 + 1) >= 1.2""")

# Fragments of cells against those of bulk runs: sizes and scales come from the totals, control windows stand around both ends.
_PAR = """par AS MATERIALIZED (SELECT *, CASE WHEN larger THEN 1 / r ELSE 1.0 END AS ts, CASE WHEN larger THEN cs ELSE tl END / 2913022398 AS bg, CASE WHEN larger THEN 1.0 ELSE r END AS k FROM
  (SELECT CAST(floor(tl / tn) AS BIGINT) AS d, tl, 2 * cl AS cs, tl / (2 * cl) AS r, tn > 2 * cn AS larger FROM (SELECT sum(r - l) FILTER (barcode IS NOT NULL) AS tl, count(*) FILTER (barcode IS NOT NULL) AS tn, sum(r - l) FILTER (barcode IS NULL) AS cl, count(*) FILTER (barcode IS NULL) AS cn FROM f)))"""
_ENDS = {"w0": ("(SELECT d FROM par)", "k"), "w1": ("1000", "k * d / 1000"), "w2": ("10000", "k * d / 10000")}
_FRAG_CELLS = ", ".join(
    [V.FRAGS, _PAR, V.sql_pileup("t", "f", value="v * (SELECT ts FROM par)", where="barcode IS NOT NULL"), "pe AS (SELECT chrom, l AS p FROM f WHERE barcode IS NULL UNION ALL SELECT chrom, r FROM f WHERE barcode IS NULL)"]
    + [f"g{n} AS (SELECT chrom, greatest(p - {w} // 2, 0) AS l, p + {w} // 2 AS r FROM pe), {V.sql_pileup(n, f'g{n}', value=f'greatest(v * (SELECT {k} FROM par), (SELECT bg FROM par))')}" for n, (w, k) in _ENDS.items()]
    + [_cells_sql(list(_ENDS), "(SELECT bg FROM par)"), _PQ]
)
add(
    "callpeak_command",
    lambda s, d: _round(commands.callpeak(V.fragments(s, d).where("barcode is not null").select("chrom", "l", "r"), V.fragments(s, d).where("barcode is null").select("chrom", "l", "r"), genome="hs", q=0.05, keep_dup="all", max_gap=50)["peaks"]),
    f"""WITH {_FRAG_CELLS}, z AS (SELECT * FROM pq WHERE q > {-math.log10(0.05)}), {V.sql_islands("i", "z", 50)}, {V.sql_summits("u", "i", "v0", "v1, p, q")}
SELECT {_BOUNDS}, summit, round(top, 3) AS pileup, round((top + 1) / (v1 + 1), 3) AS fc, round(p, 3) AS pscore, round(q, 3) AS qscore FROM u WHERE e - s >= (SELECT d FROM par) AND q >= {-math.log10(0.05)} AND (top + 1) / (v1 + 1) >= 1""",
)

# Broad calls as lines: the name, the score as a whole number, blocks with one base where no strong region reaches an end.
_BROAD_LINES = SQL["callpeak_broad"].split("SELECT chrom, s AS \"start\"")[0].rsplit("n AS (SELECT s2.chrom", 1)[0] + f"""
n AS (SELECT s2.chrom, s2.s, s2.e, round(any_value(a), 3) AS a, round(any_value(b), 3) AS b, round(any_value(c), 3) AS c, round(any_value(m), 3) AS m, any_value(b) AS fc, list({{'o': s1.s - s2.s, 'n': s1.e - s1.s}} ORDER BY s1.s) FILTER (s1.s IS NOT NULL) AS k, min(s1.s) AS ts, max(s1.e) AS te
  FROM s2 LEFT JOIN s1 ON s1.chrom = s2.chrom AND s1.s >= s2.s AND s1.e <= s2.e WHERE s2.chrom IN (SELECT chrom FROM s1) GROUP BY s2.chrom, s2.s, s2.e),
o AS (SELECT *, 'peak_' || row_number() OVER (ORDER BY chrom, s) AS name, list_concat(CASE WHEN ts IS NULL OR ts > s THEN [{{'o': 0, 'n': 1}}] ELSE [] END, coalesce(k, []), CASE WHEN te IS NULL OR te < e THEN [{{'o': e - s - 1, 'n': 1}}] ELSE [] END) AS bl FROM n WHERE fc >= 1)"""
_LEAD = "chrom, s, e, name, CAST(trunc(10 * m) AS INT), '.'"
_TRIPLE = "format('{:.6g}', b), format('{:.6g}', c), format('{:.6g}', m)"
_BED12 = f"{_LEAD}, coalesce(ts, 0), coalesce(te, 0), '0', len(bl), array_to_string(list_transform(bl, lambda x: x.n), ','), array_to_string(list_transform(bl, lambda x: x.o), ',')"
_broad = lambda s, d: sinks.named(_round(_called(s, d, broad=True, broad_cutoff=0.1)["peaks"]).withColumn("summit", F.lit(None).cast("bigint")))
add("sink_broad_peak", lambda s, d: sinks.broad_peak(_broad(s, d)), f"{_BROAD_LINES} SELECT concat_ws('\t', {_LEAD}, {_TRIPLE}) AS value FROM o")
add("sink_gapped_peak", lambda s, d: sinks.gapped_peak(_broad(s, d)), f"{_BROAD_LINES} SELECT concat_ws('\t', {_BED12}, {_TRIPLE}) AS value FROM o")
add("sink_bed12", lambda s, d: sinks.bed12(_broad(s, d), "qscore"), f"{_BROAD_LINES} SELECT concat_ws('\t', {_BED12}) AS value FROM o")

# Smaller commands.
_DEPTHS = "(SELECT count(*) FROM tt) AS t, (SELECT count(*) FROM tc) AS c"


def _normalized(spark: SparkSession, d: str) -> DataFrame:
    """Factors of every change of normalization between the depths of two tracks."""
    t, c = float(V.tags_treat(spark, d).count()), float(V.tags_ctrl(spark, d).count())
    rows = [(a, b, *scores.normalization(b, t, c, a)) for a in "TCMN" for b in "TCMN"]
    return _round(spark.createDataFrame(rows, "was string, mode string, treat double, ctrl double"), 9)


_FACTORS = "CASE {m} WHEN 'T' THEN 1.0 WHEN 'C' THEN c / t WHEN 'M' THEN 1 / t ELSE 1.0 END", "CASE {m} WHEN 'T' THEN t / c WHEN 'C' THEN 1.0 WHEN 'M' THEN 1 / c ELSE 1.0 END"
add("normalization", _normalized, f"WITH {V.TREAT}, {V.CTRL}, n AS (SELECT {_DEPTHS}), m AS (SELECT unnest(['T', 'C', 'M', 'N']) AS m) SELECT a.m AS was, b.m AS mode, round(({_FACTORS[0].format(m='b.m')}) / ({_FACTORS[0].format(m='a.m')}), 9) AS treat, round(({_FACTORS[1].format(m='b.m')}) / ({_FACTORS[1].format(m='a.m')}), 9) AS ctrl FROM m AS a, m AS b, n")
add("filterdup_auto", lambda s, d: commands.filterdup(V.tags_treat(s, d), "auto", 1e5).groupBy("chrom").agg(F.count("*").alias("n")), f"""WITH {V.TREAT}, n AS (SELECT count(*) AS n, 1e-5 AS p FROM tt), x AS (SELECT unnest(range(0, 60)) AS x), b AS (SELECT x, sum(exp(lgamma(n + 1) - lgamma(x + 1) - lgamma(n - x + 1) + x * ln(p) + (n - x) * ln(1 - p))) OVER (ORDER BY x) AS c FROM x, n),
k AS (SELECT greatest(1, min(x)) AS k FROM b WHERE c >= 1 - 1e-5), r AS (SELECT chrom, row_number() OVER (PARTITION BY chrom, pos, strand ORDER BY pos) AS i FROM tt) SELECT chrom, count(*) AS n FROM r, k WHERE i <= k GROUP BY chrom""")


def _sampled(spark: SparkSession, d: str) -> DataFrame:
    """Of every chrom: how many rows were drawn, how many of them are rows of the input, distinct, and drawn again by the same seed but not by another."""
    f = V.fragments(spark, d).select("frag_id", "chrom", "l", "r", "barcode", "cnt")
    one, same, other = (commands.randsample(f, share=0.25, seed=k).select("chrom", "frag_id") for k in (3, 3, 4))
    hits = lambda df, name: df.distinct().withColumn(name, F.lit(1))
    both = one.join(hits(f.select("chrom", "frag_id"), "known"), ["chrom", "frag_id"], "left").join(hits(same, "again"), ["chrom", "frag_id"], "left").join(hits(other, "also"), ["chrom", "frag_id"], "left")
    return both.groupBy("chrom").agg(F.count("*").alias("n"), F.countDistinct("frag_id").alias("n_distinct"), F.sum("known").alias("n_known"), F.sum("again").alias("n_again"), (F.count("*") >= F.sum(F.coalesce("also", F.lit(0)))).alias("seed_matters"))


add("randsample_rows", _sampled, f"WITH {V.FRAGS} SELECT chrom, n, n AS n_distinct, n AS n_known, n AS n_again, true AS seed_matters FROM (SELECT chrom, CAST(floor(count(*) * 0.25) AS BIGINT) AS n FROM f GROUP BY chrom) WHERE n > 0")
add("randsample_number", lambda s, d: commands.randsample(V.fragments(s, d), number=5000).groupBy("chrom").agg(F.count("*").alias("n")), f"WITH {V.FRAGS}, t AS (SELECT count(*) AS t FROM f) SELECT chrom, n FROM (SELECT chrom, CAST(floor(round(count(*) * (5000 / any_value(t)), 5)) AS BIGINT) AS n FROM f, t GROUP BY chrom) WHERE n > 0")
add(
    "pick_peaks",
    lambda s, d: tracks.pick(V.regions(s, d), 100, 7).join(V.regions(s, d).select("peak_id"), "peak_id", "left_semi").agg(F.count("*").alias("n"), F.countDistinct(F.struct("peak_id", "run_id", "chrom", "start", "end")).alias("n_distinct")),
    "SELECT CAST(100 AS BIGINT) AS n, CAST(100 AS BIGINT) AS n_distinct",
)
add("concatenated_tags", lambda s, d: commands.pileup_track(pileup.union_all([V.tags_treat(s, d), V.tags_ctrl(s, d)]), 3000), f'WITH {V.TREAT}, {V.CTRL}, bo AS (SELECT * FROM tt UNION ALL SELECT * FROM tc), {V.sql_tag_intervals("bi", "bo", 3000)}, {V.sql_pileup("a", "bi")} SELECT {_BOUNDS}, v AS value FROM a')
add(
    "cutoff_elbows",
    lambda s, d: step.elbows(s.createDataFrame([tuple(r) for r in commands.bdgpeakcall(V.signal_a(s, d), 0, 500, 300, [float(x) for x in range(10, 44, 3)]).select("cutoff", "npeaks").collect()], "cutoff double, value long"), 50.0),
    f"""WITH {V.SIGNAL_A}, k AS (SELECT cutoff, chrom, s, e FROM a, (SELECT unnest(range(10, 44, 3)) AS cutoff) WHERE v > cutoff), {V.sql_islands("i", "k", 300, "cutoff, chrom")}, n AS (SELECT cutoff, max(e) - min(s) AS len FROM i GROUP BY cutoff, chrom, g HAVING max(e) - min(s) >= 500),
t AS (SELECT CAST(cutoff AS DOUBLE) AS cutoff, count(*) AS value FROM n GROUP BY cutoff), u AS (SELECT *, value - lag(value) OVER (ORDER BY cutoff) AS d FROM t), w AS (SELECT *, abs(d - lag(d) OVER (ORDER BY cutoff)) AS c FROM u) SELECT cutoff, value FROM w WHERE c > 50""",
)
add("predictd_fragments", lambda s, d: s.createDataFrame([(round(commands.predictd(V.fragments(s, d).select("chrom", "l", "r"))["d"], 5),)], "d double"), f"WITH {V.FRAGS} SELECT round(sum(r - l) / count(*), 5) AS d FROM f")
add("pileup_command", lambda s, d: commands.pileup_track(V.tags_treat(s, d), 1500, both=True), f'WITH {V.TREAT}, {V.sql_tag_intervals("ti", "tt", 3000, directional=False)}, {V.sql_pileup("a", "ti")} SELECT {_BOUNDS}, v AS value FROM a')


def _paired_tags(spark: SparkSession, d: str) -> DataFrame:
    """Tags in clusters along the axis, forward ones left of each centre and reverse ones right of it."""
    rows = table(spark, d, "lineitem")
    strand = (F.col("l_linestatus") == "F").cast("int")
    centre = (F.col("l_partkey") % 300) * 2000 + 1000
    off = 75 - F.col("l_linenumber") * 4
    return rows.select(F.col("l_returnflag").alias("chrom"), F.when(strand == 0, centre - off).otherwise(centre + off).cast("int").alias("pos"), strand.alias("strand"))


def model_d(spark: SparkSession, d: str) -> DataFrame:
    """The fragment size modelled from both strands' tags, and the offset between their densities."""
    m = models.strand_model(_paired_tags(spark, d), 1.8e6, mfold=(0.5, 500))
    return spark.createDataFrame([(m["d"], m["pairs"])], "d int, pairs int")


add("model_d", model_d)


# Alleles of the reads of export lines, which have bases and qualities but no reference.
def _reads(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "export_lines")
    good = loaded_lines(lines).where("pos is not null").select("line_id", "chrom", "pos", "strand")
    f = F.split("raw_line", "\t", -1)
    cells = lines.where("instr(raw_line, '\"') = 0").select(F.col("line_id").alias("_i"), F.get(f, F.lit(8)).alias("seq"), F.get(f, F.lit(9)).alias("q"))
    joined = good.join(cells, F.col("line_id") == F.col("_i"))
    n = F.length("seq").cast("string")
    return joined.select(F.col("line_id").cast("string").alias("name"), "chrom", "pos", (F.col("strand") * 16).cast("int").alias("flag"), F.concat(n, F.lit("M")).alias("cigar"), "seq", F.encode("q", "UTF-8").alias("qual"), n.alias("md"))


_BASES = f"""WITH good AS ({V.P5_LOADED_SQL}), rd AS (SELECT g.chrom, g.pos, g.strand, string_split(raw_line, '\t')[9] AS seq, string_split(raw_line, '\t')[10] AS q FROM good AS g JOIN export_lines USING (line_id) WHERE g.pos IS NOT NULL AND NOT contains(raw_line, '"')),
o AS (SELECT *, unnest(range(1, length(seq) + 1)) AS i FROM rd), b AS (SELECT chrom, CAST(pos + i - 1 AS BIGINT) AS pos, seq[i] AS allele, ascii(q[i]) AS bq, strand, i = 1 OR i = length(seq) AS tip FROM o WHERE ascii(q[i]) > 66)"""


def allele_piles(spark: SparkSession, d: str) -> DataFrame:
    piles = variants.pile(variants.bases(_reads(spark, d), 66))
    return piles.groupBy("chrom", "pos", "allele").agg(F.sum("n").alias("n"), F.sum("n_plus").cast("bigint").alias("n_plus"), F.sum("n_tip").alias("n_tip"), F.sum(F.expr("aggregate(quals, 0L, (a, x) -> a + x.bq * x.c)")).alias("quality"))


def top_alleles(spark: SparkSession, d: str) -> DataFrame:
    return variants.top_alleles(variants.pile(variants.bases(_reads(spark, d), 66).withColumn("ref", F.lit("N")))).select("chrom", "pos", "allele", "n", F.col("rank").cast("int").alias("rank"))


add("allele_piles", allele_piles, f"{_BASES} SELECT chrom, pos, allele, count(*) AS n, CAST(sum(1 - strand) AS BIGINT) AS n_plus, CAST(sum(CASE WHEN tip THEN 1 ELSE 0 END) AS BIGINT) AS n_tip, CAST(sum(bq) AS BIGINT) AS quality FROM b GROUP BY chrom, pos, allele")
add("top_alleles", top_alleles, f"{_BASES}, n AS (SELECT chrom, pos, allele, count(*) AS n FROM b GROUP BY chrom, pos, allele), k AS (SELECT *, CAST(row_number() OVER (PARTITION BY chrom, pos ORDER BY n DESC, allele) AS INT) AS rank FROM n) SELECT chrom, pos, allele, n, rank FROM k WHERE rank <= 2")


# Distributions over the distinct values of the tables.
_LAM = "l_discount * 100 + l_tax * 50 + 0.5"
_poisson = lambda s, d: table(s, d, "lineitem").select(F.col("l_quantity").cast("long").alias("k"), F.round(F.expr(_LAM), 4).alias("lam")).distinct()
_PMF = "exp(j * ln(lam) - lam - lgamma(j + 1))"
add(
    "dist_poisson",
    lambda s, d: _poisson(s, d).select("k", "lam", F.round(stats.poisson_cdf_of(F.col("k"), F.col("lam")), 9).alias("cdf"), F.round(stats.poisson_log10_sf(F.col("k"), F.col("lam")), 6).alias("log10_sf"), F.round(stats.poisson_log10_pmf(F.col("k"), F.col("lam")), 6).alias("log10_pmf")),
    f"""WITH v AS (SELECT DISTINCT CAST(l_quantity AS BIGINT) AS k, round({_LAM}, 4) AS lam FROM lineitem)
SELECT k, lam, round(list_sum(list_transform(range(0, k + 1), lambda j: {_PMF})), 9) AS cdf, round(log10(list_sum(list_transform(range(k + 1, k + 301), lambda j: {_PMF}))), 6) AS log10_sf, round((k * ln(lam) - lam - lgamma(k + 1)) / ln(10), 6) AS log10_pmf FROM v""",
)
_BIN = "exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln(p) + (n - j) * ln(1 - p))"
add(
    "dist_binomial",
    lambda s, d: table(s, d, "lineitem").select(F.col("l_linenumber").cast("long").alias("x"), (F.col("l_quantity") * 4).cast("long").alias("n"), F.round(F.expr("l_discount * 3 + 0.0137"), 4).alias("p")).distinct().select("x", "n", "p", F.round(stats.binomial_log_pmf_of(F.col("x"), F.col("n"), F.col("p")), 4).alias("log_pmf"), F.round(stats.binomial_cdf_of(F.col("x"), F.col("n"), F.col("p")), 7).alias("cdf")),
    f"""WITH v AS (SELECT DISTINCT CAST(l_linenumber AS BIGINT) AS x, CAST(l_quantity * 4 AS BIGINT) AS n, round(l_discount * 3 + 0.0137, 4) AS p FROM lineitem)
SELECT x, n, p, CASE WHEN x <= n THEN round(lgamma(n + 1) - lgamma(x + 1) - lgamma(greatest(n - x, 0) + 1) + x * ln(p) + (n - x) * ln(1 - p), 4) END AS log_pmf, round(CASE WHEN x >= n THEN 1.0 ELSE list_sum(list_transform(range(0, x + 1), lambda j: {_BIN})) END, 7) AS cdf FROM v""",
)
# The error function by Simpson's rule with 2,000 steps.
_ERF = "(2 / sqrt(pi()) * a / 6000 * list_sum(list_transform(range(0, 2001), lambda j: (CASE WHEN j = 0 OR j = 2000 THEN 1 WHEN j % 2 = 1 THEN 4 ELSE 2 END) * exp(-(a * j / 2000) * (a * j / 2000)))))"
_Z = "round((l_quantity - 25) / 8, 3)"
add(
    "dist_normal",
    lambda s, d: table(s, d, "lineitem").select(F.expr(_Z).alias("z")).distinct().select("z", F.round(stats.normal_pdf(F.col("z"), 0.5, 1.5), 9).alias("pdf"), F.round(stats.normal_cdf(F.col("z")), 8).alias("cdf")),
    f"WITH v AS (SELECT DISTINCT {_Z} AS z, abs({_Z}) / sqrt(2) AS a FROM lineitem) SELECT z, round(exp(-(z - 0.5) * (z - 0.5) / 3) / sqrt(3 * pi()), 9) AS pdf, round((1 + sign(z) * {_ERF}) / 2, 8) AS cdf FROM v",
)
_CHI = "(x / 2 - ln(list_sum(list_transform(range(0, {df} // 2), lambda j: exp(j * ln(x / 2) - lgamma(j + 1)))))) / ln(10)"
add(
    "dist_chi_square",
    lambda s, d: table(s, d, "lineitem").select(F.round(F.col("l_quantity") * 0.7, 2).alias("x")).distinct().select("x", F.round(stats.chi2_cdf(F.col("x"), 1), 8).alias("cdf1"), *(F.round(stats.chi2_log10_sf(F.col("x"), k), 6).alias(f"sf{k}") for k in (2, 6, 20)), F.round(stats.chi2_cdf(F.col("x"), 6), 8).alias("cdf6")),
    f"WITH v AS (SELECT DISTINCT round(l_quantity * 0.7, 2) AS x FROM lineitem), w AS (SELECT x, sqrt(x / 2) AS a FROM v) SELECT x, round({_ERF}, 8) AS cdf1, {', '.join(f'round({_CHI.format(df=k)}, 6) AS sf{k}' for k in (2, 6, 20))}, round(1 - pow(10, -{_CHI.format(df=6)}), 8) AS cdf6 FROM w",
)
add("genome_sizes", lambda s, d: s.createDataFrame(list(stats.GENOME_SIZES.items()), "genome string, size long"), "SELECT * FROM (VALUES ('hs', 2913022398), ('mm', 2652783500), ('ce', 100286401), ('dm', 142573017)) AS t(genome, size)")

# Fragments as signals of four classes, and their model.
_DENS = {"short": (50, 20), "mono": (200, 20), "di": (400, 20), "tri": (600, 20)}
_dens = lambda m, s: f"exp(-(len - {m}) * (len - {m}) / {2.0 * s * s}) / {s * math.sqrt(2 * math.pi)!r}"
add(
    "length_weights",
    lambda s, d: _round(models.length_weights(tracks.length_histogram(V.fragments(s, d)), [50, 200, 400, 600], [20, 20, 20, 20]), 6),
    f"WITH {V.FRAGS}, n AS (SELECT DISTINCT CAST(r - l AS INT) AS len FROM f), d AS (SELECT len, {', '.join(f'{_dens(m, s)} AS {c}' for c, (m, s) in _DENS.items())} FROM n) SELECT len, {', '.join(f'round(CASE WHEN greatest(short, mono, di, tri) < 0.001 THEN 0.0 ELSE {c} / (short + mono + di + tri) END, 6) AS {c}' for c in _DENS)} FROM d",
)
add("peaks_kept", lambda s, d: peaks.keep(table(s, d, "peaks").where("score is not null and fc is not null and not isnan(score) and not isnan(fc)"), score=50.0, fc=(2.0, 20.0)).select("peak_id", "score", "fc", "loaded_at").drop("loaded_at"), "SELECT peak_id, score, fc FROM peaks WHERE score >= 50 AND NOT isnan(score) AND NOT isnan(fc) AND fc >= 2 AND fc < 20")


def frag_em_all(spark: SparkSession, d: str) -> DataFrame:
    """The mixture of fragment lengths, fitted on all fragments."""
    means, stddevs = models.mixture(V.fragments(spark, d), share=1.0)
    return spark.createDataFrame(list(zip(models.CLASSES, means, stddevs)), "class string, mean double, stddev double")


_CLASS = [f"w{k} * exp(-(x - m{k}) * (x - m{k}) / (2 * s{k} * s{k})) / (s{k} * sqrt(2 * pi()))" for k in range(3)]
_MASS = lambda k, v: f"sum(CASE WHEN b = {k} THEN {v} ELSE 0 END)"
_MEANS = [f"CASE WHEN n{k} > 1 THEN m{k} + 1.5 * (x{k} / n{k} - m{k}) ELSE m{k} END" for k in range(3)]
add(
    "frag_em_all",
    frag_em_all,
    f"""WITH RECURSIVE {V.FRAGS}, h AS MATERIALIZED (SELECT CAST(r - l AS DOUBLE) AS x, count(*) AS n FROM f WHERE r - l BETWEEN 100 AND 1000 GROUP BY r - l),
st AS (SELECT 0 AS it, 1e9 AS moved, 200.0::DOUBLE AS m0, 400.0::DOUBLE AS m1, 600.0::DOUBLE AS m2, 20.0::DOUBLE AS s0, 20.0::DOUBLE AS s1, 20.0::DOUBLE AS s2, (1.0 / 3)::DOUBLE AS w0, (1.0 / 3)::DOUBLE AS w1, (1.0 / 3)::DOUBLE AS w2
UNION ALL SELECT it + 1, greatest(abs(a0 - m0), abs(a1 - m1), abs(a2 - m2)), a0, a1, a2, {', '.join(f"CASE WHEN n{k} > 1 THEN greatest(1e-3, s{k} + 1.5 * (sqrt(greatest(0, q{k} / n{k} - (x{k} / n{k}) * (x{k} / n{k}))) - s{k})) ELSE s{k} END" for k in range(3))}, {', '.join(f"CASE WHEN n{k} > 1 THEN n{k} / (n0 + n1 + n2) ELSE w{k} END" for k in range(3))}
  FROM (SELECT *, {', '.join(f"{e} AS a{k}" for k, e in enumerate(_MEANS))} FROM (SELECT it, moved, m0, m1, m2, s0, s1, s2, w0, w1, w2, {', '.join(f"{_MASS(k, 'n')} AS n{k}, {_MASS(k, 'n * x')} AS x{k}, {_MASS(k, 'n * x * x')} AS q{k}" for k in range(3))}
    FROM (SELECT st.*, h.x, h.n, CASE WHEN d0 > d1 AND d0 > d2 THEN 0 WHEN d1 > d0 AND d1 > d2 THEN 1 WHEN d2 > d0 AND d2 > d1 THEN 2 END AS b FROM st, h, LATERAL (SELECT {', '.join(f"{e} AS d{k}" for k, e in enumerate(_CLASS))})) WHERE it < 20 AND moved >= 0.05 GROUP BY ALL))),
z AS (SELECT * FROM st ORDER BY it DESC LIMIT 1)
SELECT * FROM (SELECT 'short' AS class, 50.0::DOUBLE AS mean, 20.0::DOUBLE AS stddev UNION ALL SELECT 'mono', round(m0, 1), round(s0, 1) FROM z UNION ALL SELECT 'di', round(m1, 1), round(s1, 1) FROM z UNION ALL SELECT 'tri', round(m2, 1), round(s2, 1) FROM z)""",
)
