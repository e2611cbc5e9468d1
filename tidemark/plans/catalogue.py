"""The core query catalogue: what runs over the tables of a data folder, and its SQL twin where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import scores, stats
from tidemark.operators import coverage, intervals, models, peaks, pileup, qvalue, shapes, skew, step, tracks
from tidemark.plans import calls, commands, formats
from tidemark.plans import views as V
from tidemark.plans.tables import scratch, table
from tidemark.sources import export_lines, sinks


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return skew.key_profile(table(spark, d, "fragments"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return coverage.periods_and_gaps(table(spark, d, "peaks"), ["run_id", "chrom"], "start_pos", "end_pos")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return export_lines.failed_lines(table(spark, d, "export_lines"))


def p5_loaded(spark: SparkSession, d: str) -> DataFrame:
    return export_lines.loaded_lines(table(spark, d, "export_lines"))


P2_SQL = """
WITH f AS (SELECT DISTINCT frag_id, chrom, l, r FROM fragments WHERE chrom IS NOT NULL AND l IS NOT NULL AND r > l AND frag_id IS NOT NULL),
e AS (SELECT chrom, pos, sum(d) AS d FROM (SELECT chrom, l AS pos, 1 AS d FROM f UNION ALL SELECT chrom, r, -1 FROM f) GROUP BY chrom, pos),
c AS (SELECT chrom, sum(d) OVER (PARTITION BY chrom ORDER BY pos) AS depth FROM e),
m AS (SELECT chrom, max(depth) AS max_depth FROM c GROUP BY chrom),
n AS (SELECT chrom, count(*) AS n_frag, count(DISTINCT (l, r)) AS n_loc FROM f GROUP BY chrom)
SELECT chrom, CAST(n_frag AS BIGINT) AS n_frag, CAST(n_loc AS BIGINT) AS n_loc, CAST(max_depth AS BIGINT) AS max_depth FROM n JOIN m USING (chrom)
"""

P3_SQL = """
WITH v AS (SELECT DISTINCT run_id, chrom, start_pos AS s, end_pos AS e FROM peaks WHERE run_id IS NOT NULL AND chrom IS NOT NULL AND end_pos > start_pos),
m AS (SELECT *, max(e) OVER (PARTITION BY run_id, chrom ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM v),
g AS (SELECT *, sum(CASE WHEN s <= reach THEN 0 ELSE 1 END) OVER (PARTITION BY run_id, chrom ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS isle FROM m),
p AS (SELECT run_id, chrom, min(s) AS s, max(e) AS e FROM g GROUP BY run_id, chrom, isle),
n AS (SELECT *, lead(s) OVER (PARTITION BY run_id, chrom ORDER BY s) AS nxt FROM p)
SELECT run_id, chrom, 'period' AS kind, CAST(s AS INT) AS seg_start, CAST(e AS INT) AS seg_end FROM n
UNION ALL SELECT run_id, chrom, 'gap', CAST(e AS INT), CAST(nxt AS INT) FROM n WHERE nxt IS NOT NULL
"""

# The engine's own operators.

_ROUND = 5


def _r(c, n: int = _ROUND):
    return F.round(c, n)


def _out(df: DataFrame, n: int = _ROUND) -> DataFrame:
    """Segments with rounded doubles."""
    return df.select(*(_r(F.col(c), n).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


_SEG = 'chrom, s AS "start", e AS "end"'
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _add(name: str, run: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = run
    if sql:
        SQL[name] = sql


# Coverage.
_add("pileup_unit", lambda s, d: pileup.pileup(V.fragments(s, d)), f'WITH {V.FRAGS}, {V.sql_pileup("a", "f")} SELECT {_SEG}, v AS value FROM a')
_add("pileup_weighted", lambda s, d: pileup.pileup(tracks.cap_counts(V.fragments(s, d)), F.col("cnt").cast("long")), f'WITH {V.FRAGS}, {V.sql_pileup("a", "f", "coalesce(least(cnt, 65535), 0)")} SELECT {_SEG}, v AS value FROM a')
_add("pileup_tags_directional", lambda s, d: commands.pileup_track(V.tags_treat(s, d), V.TREAT_EXT), f'WITH {V.SIGNAL_A} SELECT {_SEG}, v AS value FROM a')
_add("pileup_tags_bidirectional", lambda s, d: _out(V.signal_b(s, d)), f'WITH {V.SIGNAL_B} SELECT {_SEG}, round(v, 5) AS value FROM b')
_add(
    "pileup_both_ends",
    lambda s, d: pileup.pileup(pileup.both_ends(V.fragments(s, d), 200)),
    f"""WITH {V.FRAGS}, g AS (SELECT chrom, greatest(p - 100, 0) AS l, p + 100 AS r FROM (SELECT chrom, l AS p FROM f UNION ALL SELECT chrom, r FROM f)), {V.sql_pileup("a", "g")} SELECT {_SEG}, v AS value FROM a""",
)
_LAMBDA = [(12 * V.DAY, 0.9), (60 * V.DAY, 0.18), (180 * V.DAY, 0.06)]
_add(
    "local_lambda_max",
    lambda s, d: _out(pileup.local_lambda([(pileup.clip(pileup.tag_intervals(V.tags_ctrl(s, d), w, directional=False)), k) for w, k in _LAMBDA], 1.0)),
    "WITH " + ", ".join([V.CTRL, *(f'{V.sql_tag_intervals(f"i{k}", "tc", w, directional=False)}, {V.sql_pileup(f"w{k}", f"i{k}", value=f"greatest(v * {x}, 1.0)")}' for k, (w, x) in enumerate(_LAMBDA))])
    + """, bp AS (SELECT chrom, s AS p FROM w0 UNION SELECT chrom, e FROM w0 UNION SELECT chrom, s FROM w1 UNION SELECT chrom, e FROM w1 UNION SELECT chrom, s FROM w2 UNION SELECT chrom, e FROM w2),
c AS (SELECT chrom, p AS s, lead(p) OVER (PARTITION BY chrom ORDER BY p) AS e FROM bp),
m AS (SELECT c.chrom, c.s, c.e, round(greatest(coalesce(w0.v, 1.0), coalesce(w1.v, 1.0), coalesce(w2.v, 1.0)), 9) AS v FROM c LEFT JOIN w0 ON w0.chrom = c.chrom AND w0.s <= c.s AND w0.e >= c.e LEFT JOIN w1 ON w1.chrom = c.chrom AND w1.s <= c.s AND w1.e >= c.e LEFT JOIN w2 ON w2.chrom = c.chrom AND w2.s <= c.s AND w2.e >= c.e WHERE c.e IS NOT NULL), """
    + V.sql_rle("z", "m") + f" SELECT {_SEG}, round(v, 5) AS value FROM z",
)

# Step algebra.
_AB = f'WITH {V.SIGNAL_A}, {V.SIGNAL_B}, {V.sql_align("x", ["a", "b"])}'
_cells = lambda s, d: step.align({"treat": V.signal_a(s, d), "ctrl": V.signal_b(s, d)})
_add("step_align2", lambda s, d: _out(_cells(s, d)), f"{_AB} SELECT {_SEG}, v0 AS treat, round(v1, 5) AS ctrl FROM x")
_SQL_REDUCERS = {"max": "greatest(v0, v1)", "min": "least(v0, v1)", "mean": "(v0 + v1) / 2", "sum": "v0 + v1", "product": "v0 * v1", "subtract": "v1 - v0", "divide": "v0 / v1"}
for _name, _expr in _SQL_REDUCERS.items():
    _add(
        f"step_overlay_{_name}",
        lambda s, d, f=_name: _out((commands.cmbreps if f in ("max", "mean") else step.overlay)([V.signal_a(s, d), V.signal_b(s, d)], f)),
        f'{_AB}, y AS (SELECT chrom, s, e, round({_expr}, 9) AS v FROM x), {V.sql_rle("z", "y")} SELECT {_SEG}, round(v, 5) AS value FROM z',
    )
_FISHER = "ln(10) * (v0 + v1)"  # half of the chi-square statistic of two -log10 scores
_add(
    "step_overlay_fisher",
    lambda s, d: _out(commands.cmbreps([V.signal_a(s, d), V.signal_b(s, d)], "fisher").where("value is not null")),
    f"""{_AB}, y AS (SELECT chrom, s, e, CASE WHEN v0 + v1 > 0 THEN ({_FISHER} - ln(1 + {_FISHER})) / ln(10) ELSE 0.0 END AS v FROM x), {V.sql_rle("z", "y")} SELECT {_SEG}, round(v, 5) AS value FROM z""",
)
_add("step_rle_merge", lambda s, d: step.rle(step.apply(V.signal_a(s, d), lambda v: F.floor(v / 25).cast("double"))), f'WITH {V.SIGNAL_A}, y AS (SELECT chrom, s, e, CAST(floor(v / 25) AS DOUBLE) AS v FROM a), {V.sql_rle("z", "y")} SELECT {_SEG}, v AS value FROM z')
_add("step_threshold_baseline", lambda s, d: step.below_to_baseline(V.signal_a(s, d), 20.0), f'WITH {V.SIGNAL_A}, y AS (SELECT chrom, s, e, CASE WHEN v < 20 THEN 0.0 ELSE v END AS v FROM a), {V.sql_rle("z", "y")} SELECT {_SEG}, v AS value FROM z')
_add("step_above", lambda s, d: step.above(V.signal_a(s, d), 20.0), f"WITH {V.SIGNAL_A} SELECT {_SEG}, v AS value FROM a WHERE v > 20")
_add("step_scale_clip", lambda s, d: _out(step.scale_clip(V.signal_a(s, d), 0.5, 4.0)), f"WITH {V.SIGNAL_A} SELECT {_SEG}, round(greatest(v * 0.5, 4.0), 5) AS value FROM a")
for _name, _k, _expr in (("multiply", 2.5, "v * 2.5"), ("add", 1.5, "v + 1.5"), ("max", 20.0, "greatest(v, 20.0)"), ("min", 20.0, "least(v, 20.0)")):
    _add(f"bdgopt_{_name}", lambda s, d, f=_name, k=_k: _out(commands.bdgopt(V.signal_a(s, d), f, k)), f"WITH {V.SIGNAL_A} SELECT {_SEG}, round({_expr}, 5) AS value FROM a")
_add("step_constant", lambda s, d: step.constant(V.signal_a(s, d), 7.0), f'WITH {V.SIGNAL_A} SELECT chrom, CAST(0 AS BIGINT) AS "start", max(e) AS "end", CAST(7 AS DOUBLE) AS value FROM a GROUP BY chrom')
_add("step_summary", lambda s, d: _out(step.summary(V.signal_a(s, d))), f"""WITH {V.SIGNAL_A}, t AS (SELECT sum(v * (e - s)) AS t, CAST(sum(e - s) AS BIGINT) AS n, max(v) AS hi, min(v) AS lo, sum(v * v * (e - s)) AS q FROM a)
SELECT round(t, 5) AS total, n AS bases, hi AS "max", lo AS "min", round(t / n, 5) AS mean, round(sqrt(q / n - (t / n) * (t / n)), 5) AS std FROM t""")
_add("step_median_by_length", lambda s, d: step.median_by_length(V.signal_a(s, d), ["chrom"]), f"""WITH {V.SIGNAL_A}, w AS (SELECT chrom, v, sum(sum(e - s)) OVER (PARTITION BY chrom ORDER BY v) AS c, sum(sum(e - s)) OVER (PARTITION BY chrom) AS n FROM a GROUP BY chrom, v)
SELECT chrom, min(v) AS median FROM w WHERE c >= ceil(0.5 * n) GROUP BY chrom""")

# Scores.
# Terms of the tail from k + 1 up, and how many of them count: the first to raise the logarithm by less than 1e-5 is the last.
_TERMS = "list_transform(range(CAST(k AS BIGINT) + 1, CAST(k AS BIGINT) + 201), lambda j: exp(j * ln(lam) - lam - lgamma(j + 1)))"
_PSF = "-log10(list_sum(x[1:list_filter(range(2, 201), lambda i: x[i] < (exp(1e-5) - 1) * list_sum(x[1:i - 1]))[1]]))"
_SCORES = {
    "pois": ("p", ""),
    "fe": ("F", "round((v0 + 1) / (v1 + 1), 4)"),
    "logfe": ("f", "round(log10((v0 + 1) / (v1 + 1)), 4)"),
    "loglr": ("l", "round(CASE WHEN v0 > v1 THEN ((v0+1) * ln((v0+1) / (v1+1)) + v1 - v0) / ln(10) WHEN v0 < v1 THEN -((v0+1) * ln((v0+1) / (v1+1)) + v1 - v0) / ln(10) ELSE 0 END, 4)"),
    "sloglr": ("s", "round(CASE WHEN v0 > v1 THEN ((v0+1) * ln((v0+1) / (v1+1)) + v1 - v0) / ln(10) WHEN v0 < v1 THEN ((v1+1) * ln((v0+1) / (v1+1)) + v1 - v0) / ln(10) ELSE 0 END, 4)"),
    "subtract": ("d", "round(v0 - v1, 4)"),
    "max": ("M", "round(greatest(v0, v1), 4)"),
    "spmr": ("m", "round(v0 / 2.5, 4)"),
}


def _compared(spark: SparkSession, d: str, letter: str) -> DataFrame:
    """Scores of treatment against control by the command's method, or per million reads."""
    method = next((n for n, x in scores.NAMES.items() if x == letter), None)
    if method is None:
        rows = _cells(spark, d).select("chrom", "start", "end", scores.score(letter, F.col("treat"), F.col("ctrl"), treat_depth=2.5).alias("score"))
    else:
        rows = commands.bdgcmp(V.signal_a(spark, d), V.signal_b(spark, d), [method], 1.0).withColumnRenamed(method, "score")
    return _out(rows, 4)


for _name, (_letter, _expr) in _SCORES.items():
    if _name == "pois":
        continue
    _add(
        f"score_{_name}",
        lambda s, d, m=_letter: _compared(s, d, m),
        f"{_AB} SELECT {_SEG}, {_expr} AS score FROM x",
    )
_P = f"{_AB}, k AS (SELECT *, trunc(v0 + 1) AS k, v1 + 1 AS lam FROM x), dk AS (SELECT DISTINCT k, lam FROM k), tk AS (SELECT k, lam, {_TERMS} AS x FROM dk), pk AS (SELECT k, lam, round({_PSF}, 5) AS p FROM tk), p AS (SELECT k.chrom, k.s, k.e, v0, v1, p FROM k JOIN pk USING (k, lam))"
_scored = lambda s, d: qvalue.scored(_cells(s, d), 1.0)
_add("score_pois", lambda s, d: _scored(s, d).select("chrom", "start", "end", _r(F.col("pscore"), 5).alias("score")), f"{_P} SELECT {_SEG}, round(p, 5) AS score FROM p")
_Q = f"""{_P}, h AS (SELECT p, sum(e - s) AS n FROM p GROUP BY p), c AS (SELECT p, n, 1 + coalesce(sum(n) OVER (ORDER BY p DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k, sum(n) OVER () AS t FROM h),
q AS (SELECT p, n, k, greatest(0.0, min(p + log10(k) - log10(t)) OVER (ORDER BY p DESC ROWS UNBOUNDED PRECEDING)) AS q FROM c)"""
_add("pq_table", lambda s, d: qvalue.table(_scored(s, d)).select(_r(F.col("p"), 5).alias("p"), "bases", "rank", _r(F.col("q"), 3).alias("q")), f"{_Q} SELECT round(p, 5) AS p, CAST(n AS BIGINT) AS bases, CAST(k AS BIGINT) AS rank, round(q, 3) AS q FROM q")
_add("score_qpois", lambda s, d: qvalue.with_qscore(_scored(s, d)).select("chrom", "start", "end", _r(F.col("qscore"), 3).alias("score")), f"{_Q} SELECT {_SEG}, round(q.q, 3) AS score FROM p JOIN q USING (p)")
_add("bdg_p2q", lambda s, d: _out(step.p2q(V.signal_a(s, d))), f"WITH {V.SIGNAL_A} SELECT {_SEG}, round(greatest(0.0, v - log10((SELECT sum(e - s) FROM a))), 5) AS value FROM a")

# Peaks.
_add(
    "peaks_narrow",
    lambda s, d: commands.bdgpeakcall(V.coverage(s, d, "cells"), 2.0, 50, 100),
    f'WITH {V.FRAGS}, {V.sql_pileup("a", "f", where="barcode IS NOT NULL")}, k AS (SELECT * FROM a WHERE v >= 2), {V.sql_islands("i", "k", 100)}, {V.sql_summits("u", "i")} SELECT {_SEG}, summit, top AS score FROM u WHERE e - s >= 50',
)
_add(
    "peaks_narrow_tags",
    lambda s, d: peaks.call(V.signal_a(s, d), 30.0, 500, 300, strict=True),
    f'WITH {V.SIGNAL_A}, k AS (SELECT * FROM a WHERE v > 30), {V.sql_islands("i", "k", 300)}, {V.sql_summits("u", "i")} SELECT {_SEG}, summit, top AS score FROM u WHERE e - s >= 500',
)


def peaks_broad(spark: SparkSession, d: str) -> DataFrame:
    out = commands.bdgbroadcall(V.coverage(spark, d, "cells"), 2.0, 1.0, 60, 100, 400)
    return out.select("chrom", "start", "end", "thick_start", "thick_end", F.size("blocks").cast("bigint").alias("n_blocks"), F.expr("aggregate(blocks, 0L, (a, b) -> a + b.size)").alias("block_bases"), _r(F.col("score")).alias("score"))


_add(
    "peaks_broad",
    peaks_broad,
    f"""WITH {V.FRAGS}, {V.sql_pileup("a", "f", where="barcode IS NOT NULL")}, k1 AS (SELECT * FROM a WHERE v >= 2), {V.sql_islands("i1", "k1", 100)}, k2 AS (SELECT * FROM a WHERE v >= 1), {V.sql_islands("i2", "k2", 400)},
s1 AS (SELECT chrom, min(s) AS s, max(e) AS e FROM i1 GROUP BY chrom, g HAVING max(e) - min(s) >= 60), s2 AS (SELECT chrom, min(s) AS s, max(e) AS e, sum(v * (e - s)) / sum(e - s) AS m FROM i2 GROUP BY chrom, g HAVING max(e) - min(s) >= 60),
n AS (SELECT s2.chrom, s2.s, s2.e, any_value(m) AS m, min(s1.s) AS ts, max(s1.e) AS te, count(s1.s) AS c, coalesce(sum(s1.e - s1.s), 0) AS b FROM s2 LEFT JOIN s1 ON s1.chrom = s2.chrom AND s1.s >= s2.s AND s1.e <= s2.e WHERE s2.chrom IN (SELECT chrom FROM s1) GROUP BY s2.chrom, s2.s, s2.e)
SELECT {_SEG}, ts AS thick_start, te AS thick_end, CAST(c + CASE WHEN ts IS NULL OR ts > s THEN 1 ELSE 0 END + CASE WHEN te IS NULL OR te < e THEN 1 ELSE 0 END AS BIGINT) AS n_blocks,
CAST(b + CASE WHEN ts IS NULL OR ts > s THEN 1 ELSE 0 END + CASE WHEN te IS NULL OR te < e THEN 1 ELSE 0 END AS BIGINT) AS block_bases, round(m, 5) AS score FROM n""",
)
_GRID = [float(x) for x in range(4, 44, 2)]
_add(
    "cutoff_analysis",
    lambda s, d: _out(commands.bdgpeakcall(V.signal_a(s, d), 0, 500, 300, _GRID)),
    f"""WITH {V.SIGNAL_A}, k AS (SELECT cutoff, chrom, s, e FROM a, (SELECT unnest({_GRID}) AS cutoff) WHERE v > cutoff), {V.sql_islands("i", "k", 300, "cutoff, chrom")}, n AS (SELECT cutoff, max(e) - min(s) AS len FROM i GROUP BY cutoff, chrom, g HAVING max(e) - min(s) >= 500)
SELECT CAST(cutoff AS DOUBLE) AS cutoff, count(*) AS npeaks, CAST(sum(len) AS BIGINT) AS lpeaks, round(avg(len), 5) AS avelpeak FROM n GROUP BY cutoff""",
)
_E2E_Q = 0.5


def callpeak_e2e(spark: SparkSession, d: str) -> DataFrame:
    """Coverage, background, p and q scores, gap merging and summits in one plan."""
    treat = pileup.clip(pileup.tag_intervals(V.tags_treat(spark, d), V.TREAT_EXT))
    ctrl = pileup.clip(pileup.tag_intervals(V.tags_ctrl(spark, d), V.CTRL_EXT, directional=False))
    cells = qvalue.scored_pq(pileup.together({"treat": {"df": treat}, "ctrl": {"df": ctrl, "scale": V.CTRL_SCALE, "baseline": 1.0}}))
    found = _out(peaks.call_scored(cells, {"qscore": _E2E_Q}, 300, 100).where("fc >= 1.0"), n=3)
    return found.select("chrom", "start", "end", "summit", "pileup", *(_r(F.col(c), 3).alias(c) for c in ("fc", "pscore", "qscore")))


_E2E = _Q.replace("trunc(v0 + 1) AS k, v1 + 1 AS lam", "trunc(v0) AS k, v1 AS lam")
_add(
    "callpeak_e2e",
    callpeak_e2e,
    f"""{_E2E}, z AS (SELECT p.chrom, p.s, p.e, v0, v1, p.p, q.q FROM p JOIN q USING (p) WHERE q.q > {_E2E_Q}), {V.sql_islands("i", "z", 100)}, {V.sql_summits("u", "i", "v0", "v1, p, q")}
SELECT {_SEG}, summit, top AS pileup, round((top + 1) / (v1 + 1), 3) AS fc, round(p, 3) AS pscore, round(q, 3) AS qscore FROM u WHERE e - s >= 300 AND q >= {_E2E_Q} AND (top + 1) / (v1 + 1) >= 1""",
)


#: Extensions, background and cutoff of the differential calls.
_DIFF_EXT, _DIFF_CTRL, _DIFF_SCALE, _DIFF_CUT = 300, 3000, 0.05, 1.0


def _conditions(spark: SparkSession, d: str) -> list[DataFrame]:
    """Tags on both strands as two conditions, each beside the control."""
    t = V.tags_treat(spark, d)
    one, two = (pileup.pileup_tags(t.where(f"strand = {k}"), _DIFF_EXT) for k in (0, 1))
    b = pileup.pileup_tags(V.tags_ctrl(spark, d), _DIFF_CTRL, directional=False, scale=_DIFF_SCALE, baseline=0.5)
    return [one, b, two, b]


def _differential(spark: SparkSession, d: str) -> DataFrame:
    return commands.bdgdiff(*_conditions(spark, d), _DIFF_CUT, 50, 20, 10.0, 8.0)


def _four(spark: SparkSession, d: str) -> DataFrame:
    return peaks.differential(*_conditions(spark, d), 10.0, 8.0)


_LLR = "CASE WHEN {x} > {y} THEN ({x} * ln({x} / {y}) + {y} - {x}) / ln(10) WHEN {x} < {y} THEN {neg} ELSE 0 END"
_asym = lambda x, y: _LLR.format(x=x, y=y, neg=f"-({x} * ln({x} / {y}) + {y} - {x}) / ln(10)")
_sym = lambda x, y: _LLR.format(x=x, y=y, neg=f"({y} * ln({x} / {y}) + {y} - {x}) / ln(10)")
_DIFF = (
    f"WITH {V.TREAT}, t0 AS (SELECT * FROM tt WHERE strand = 0), t1 AS (SELECT * FROM tt WHERE strand = 1), {V.sql_tag_intervals('i0', 't0', _DIFF_EXT)}, {V.sql_tag_intervals('i1', 't1', _DIFF_EXT)}, {V.sql_pileup('p0', 'i0')}, {V.sql_pileup('p1', 'i1')}, {V.CTRL}, {V.sql_tag_intervals('ci', 'tc', _DIFF_CTRL, directional=False)}, {V.sql_pileup('b', 'ci', value=f'greatest(v * {_DIFF_SCALE}, 0.5)')}, {V.sql_align('x', ['p0', 'b', 'p1'])}, "
    "m AS (SELECT chrom, s, e, (v0 + 0.01) * 0.8 AS a1, (v1 + 0.01) * 0.8 AS b1, (v2 + 0.01) AS a2, (v1 + 0.01) AS b2 FROM x), "
    f"l AS (SELECT chrom, s, e, {_asym('a1', 'b1')} AS l1, {_asym('a2', 'b2')} AS l2, {_sym('a1', 'a2')} AS l12 FROM m)"
)
for _name, _cond, _sc in (("cond1", "l1 >= {c} AND l12 >= {c}", "l12"), ("cond2", "l2 >= {c} AND l12 <= -{c}", "-l12"), ("common", "l1 >= {c} AND l2 >= {c} AND abs(l12) <= {c}", "abs(l12)")):
    _add(
        f"bdgdiff_{_name}",
        lambda s, d, c=_name: _out(_differential(s, d).where(F.col("category") == c).drop("category")),
        f'{_DIFF}, k AS (SELECT chrom, s, e, {_sc} AS v FROM l WHERE {_cond.format(c=_DIFF_CUT)}), {V.sql_islands("i", "k", 20)} SELECT chrom, min(s) AS "start", max(e) AS "end", round(sum(v * (e - s)) / sum(e - s), 5) AS score FROM i GROUP BY chrom, g HAVING max(e) - min(s) >= 50',
    )

# Intervals.
_RG = f"WITH {V.REGIONS}, rd AS (SELECT DISTINCT chrom, s, e FROM rg), {V.sql_islands('ri', 'rd')}, mr AS (SELECT chrom, min(s) AS s, max(e) AS e FROM ri GROUP BY chrom, g)"
_IS = f"{V.FRAGS}, {V.sql_pileup('ca', 'f', where='barcode IS NOT NULL')}, ck AS (SELECT * FROM ca WHERE v >= 1), {V.sql_islands('cj', 'ck', 100)}, isl AS MATERIALIZED (SELECT chrom, min(s) AS s, max(e) AS e FROM cj GROUP BY chrom, g HAVING max(e) - min(s) >= 50)"
_add("regions_merge", V.merged_regions, f"{_RG} SELECT {_SEG} FROM mr")
_add("regions_expand", lambda s, d: intervals.merge(intervals.expand(V.regions(s, d), 150)), f"WITH {V.REGIONS}, x AS (SELECT DISTINCT chrom, greatest(s - 150, 0) AS s, e + 150 AS e FROM rg), {V.sql_islands('xi', 'x')} SELECT chrom, min(s) AS \"start\", max(e) AS \"end\" FROM xi GROUP BY chrom, g")
_add("regions_intersect", lambda s, d: intervals.intersect(V.merged_regions(s, d), V.islands(s, d)), f"{_RG}, {_IS} SELECT mr.chrom, greatest(mr.s, isl.s) AS \"start\", least(mr.e, isl.e) AS \"end\" FROM mr JOIN isl ON mr.chrom = isl.chrom AND mr.s < isl.e AND mr.e > isl.s UNION ALL SELECT {_SEG} FROM mr WHERE chrom NOT IN (SELECT chrom FROM isl)")
_add("regions_exclude", lambda s, d: intervals.exclude(V.regions(s, d), V.islands(s, d)), f"{_RG}, {_IS} SELECT peak_id, run_id, chrom, s AS \"start\", e AS \"end\" FROM rg WHERE NOT EXISTS (SELECT 1 FROM isl WHERE isl.chrom = rg.chrom AND rg.s < isl.e AND rg.e > isl.s)")
_add("regions_within", lambda s, d: intervals.within(V.regions(s, d), V.islands(s, d)), f"{_RG}, {_IS} SELECT peak_id, run_id, chrom, s AS \"start\", e AS \"end\" FROM rg WHERE EXISTS (SELECT 1 FROM isl WHERE isl.chrom = rg.chrom AND rg.s < isl.e AND rg.e > isl.s)")
_add("regions_total_length", lambda s, d: intervals.total_length(V.regions(s, d)), f"{_RG} SELECT CAST(sum(e - s) AS BIGINT) AS total_length FROM mr")
_add("regions_jaccard", lambda s, d: _out(intervals.jaccard(V.regions(s, d), V.islands(s, d))), f"{_RG}, {_IS}, c AS (SELECT coalesce(sum(least(mr.e, isl.e) - greatest(mr.s, isl.s)), 0) AS c FROM mr JOIN isl ON mr.chrom = isl.chrom AND mr.s < isl.e AND mr.e > isl.s), u AS (SELECT (SELECT sum(e - s) FROM mr) + (SELECT sum(e - s) FROM isl) - (SELECT c FROM c) AS u) SELECT CAST(c AS BIGINT) AS common, CAST(u AS BIGINT) AS united, round(c / u, 5) AS jaccard FROM c, u")
_add("regions_bins", lambda s, d: intervals.bins(V.merged_regions(s, d), 100).select("chrom", F.col("region.start").alias("start"), F.col("region.end").alias("end"), "bin_end"), f"{_RG} SELECT chrom, s AS \"start\", e AS \"end\", unnest(range(s // 100 * 100 + 100, e // 100 * 100 + 1, 100)) AS bin_end FROM mr")
_add("regions_batches", lambda s, d: intervals.batches(V.merged_regions(s, d), 500), f"{_RG} SELECT {_SEG}, CAST((row_number() OVER (ORDER BY chrom, s) - 1) // 500 AS BIGINT) AS batch FROM mr")
_add("fragments_exclude", lambda s, d: intervals.exclude(V.fragments(s, d), V.regions(s, d), "l", "r").select("frag_id", "chrom", "l", "r"), f"{_RG}, {V.FRAGS} SELECT frag_id, chrom, l, r FROM f WHERE NOT EXISTS (SELECT 1 FROM mr WHERE mr.chrom = f.chrom AND f.l < mr.e AND f.r > mr.s)")
_add("overlap_pairs", lambda s, d: intervals.overlap_join(V.fragments(s, d), V.islands(s, d)).select("frag_id", "chrom", "l", "r", F.col("b_start").alias("start"), F.col("b_end").alias("end")), f"WITH {_IS} SELECT frag_id, f.chrom, l, r, isl.s AS \"start\", isl.e AS \"end\" FROM f JOIN isl ON f.chrom = isl.chrom AND f.l < isl.e AND f.r > isl.s")
_add("points_in_windows", lambda s, d: intervals.points_in_windows(table(s, d, "peaks").where("peak_id is not null and summit is not null and chrom is not null").select("peak_id", "chrom", F.col("summit").alias("pos")).distinct(), V.islands(s, d), 100).select("peak_id", "chrom", "pos", F.col("b_start").alias("start"), F.col("b_end").alias("end")), f"WITH {_IS}, q AS (SELECT DISTINCT peak_id, chrom, summit AS pos FROM peaks WHERE peak_id IS NOT NULL AND summit IS NOT NULL AND chrom IS NOT NULL) SELECT peak_id, q.chrom, pos, isl.s AS \"start\", isl.e AS \"end\" FROM q JOIN isl ON q.chrom = isl.chrom AND pos BETWEEN isl.s - 100 AND isl.e + 100")
_add("barcode_subset", lambda s, d: tracks.subset(V.fragments(s, d), V.fragments(s, d).groupBy("barcode").count().where("count >= 3")).select("frag_id", "barcode"), f"WITH {V.FRAGS} SELECT frag_id, barcode FROM f WHERE barcode IN (SELECT barcode FROM f WHERE barcode IS NOT NULL GROUP BY barcode HAVING count(*) >= 3)")
_add("cell_by_peak", lambda s, d: intervals.counts_by_entity(V.fragments(s, d), V.regions(s, d)), f"{_RG}, {V.FRAGS} SELECT barcode, f.chrom, mr.s AS \"start\", mr.e AS \"end\", CAST(sum(cnt) AS BIGINT) AS cnt FROM f JOIN mr ON f.chrom = mr.chrom AND f.l < mr.e AND f.r > mr.s WHERE barcode IS NOT NULL AND cnt IS NOT NULL GROUP BY barcode, f.chrom, mr.s, mr.e")

# Tracks.
_add("filterdup_tags", lambda s, d: commands.filterdup(V.tags_treat(s, d), 2), f"WITH {V.TREAT}, n AS (SELECT chrom, pos, strand, row_number() OVER (PARTITION BY chrom, pos, strand ORDER BY pos) AS i FROM tt) SELECT chrom, CAST(pos AS INT) AS pos, strand FROM n WHERE i <= 2")
_add("filterdup_frags", lambda s, d: tracks.limit_duplicates(V.fragments(s, d), ["chrom", "l", "r"], 1, True), f"WITH {V.FRAGS} SELECT chrom, l, r, count(*) AS n_before FROM f GROUP BY chrom, l, r")
_add("fraglen_hist", lambda s, d: tracks.length_histogram(V.fragments(s, d)), f"WITH {V.FRAGS} SELECT CAST(r - l AS INT) AS len, count(*) AS n FROM f GROUP BY r - l")
_add("mean_template", lambda s, d: _out(tracks.totals(V.fragments(s, d).drop("cnt"))), f"WITH {V.FRAGS} SELECT count(*) AS total, CAST(sum(r - l) AS BIGINT) AS length, round(sum(r - l) / count(*), 5) AS mean_length FROM f")
_add("totals_by_count", lambda s, d: _out(tracks.totals(tracks.cap_counts(V.fragments(s, d)))), f"WITH {V.FRAGS} SELECT CAST(sum(least(cnt, 65535)) AS BIGINT) AS total, CAST(sum((r - l) * least(cnt, 65535)) AS BIGINT) AS length, round(sum((r - l) * least(cnt, 65535)) / sum(least(cnt, 65535)), 5) AS mean_length FROM f")
_add("refine_peaks_to_signal", lambda s, d: peaks.refine(V.coverage(s, d, "cells").where("value > 0"), V.merged_regions(s, d)), f"{_RG}, {V.FRAGS}, {V.sql_pileup('ca', 'f', where='barcode IS NOT NULL')}, k AS (SELECT ca.chrom, mr.s AS g, greatest(ca.s, mr.s) AS s, least(ca.e, mr.e) AS e, v FROM ca JOIN mr ON ca.chrom = mr.chrom AND ca.s < mr.e AND ca.e > mr.s WHERE v > 0), {V.sql_summits('u', 'k')} SELECT {_SEG}, summit, top AS score FROM u")
_add("signal_at_bins", lambda s, d: step.sample_at(V.coverage(s, d, "cells"), intervals.bins(V.islands(s, d), 50).select("chrom", "bin_end")), f"WITH {_IS}, bn AS (SELECT chrom, unnest(range(s // 50 * 50 + 50, e // 50 * 50 + 1, 50)) AS bin_end FROM isl) SELECT bn.chrom, bin_end, CASE WHEN ca.e >= bin_end THEN v END AS value FROM bn ASOF LEFT JOIN ca ON ca.chrom = bn.chrom AND bin_end > ca.s")
_add("top_two_barcodes", lambda s, d: tracks.top_two(V.fragments(s, d).where("barcode is not null"), ["run_id"], "barcode"), f"WITH {V.FRAGS}, n AS (SELECT run_id, barcode, count(*) AS n FROM f WHERE barcode IS NOT NULL GROUP BY run_id, barcode), k AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY n DESC, barcode) AS rank FROM n) SELECT run_id, barcode, n, CAST(rank AS INT) AS rank FROM k WHERE rank <= 2")
_add("weighted_percentiles", lambda s, d: skew.weighted_percentile(skew.value_frequencies(V.fragments(s, d), ["chrom"], [(F.col("r") - F.col("l")).cast("long")]), ["k0"], "v0", [0.05, 0.5, 0.95]).select(F.col("k0").alias("chrom"), "q", "value"), f"WITH {V.FRAGS}, w AS (SELECT chrom, r - l AS v, sum(count(*)) OVER (PARTITION BY chrom ORDER BY r - l) AS c, sum(count(*)) OVER (PARTITION BY chrom) AS n FROM f GROUP BY chrom, r - l), q AS (SELECT unnest([0.05, 0.5, 0.95]) AS q) SELECT chrom, CAST(q AS DOUBLE) AS q, CAST(min(v) AS BIGINT) AS value FROM w, q WHERE c >= greatest(1, ceil(CAST(q AS DOUBLE) * n)) GROUP BY chrom, q")
_add("randsample_exact", lambda s, d: tracks.sample(V.fragments(s, d), ["chrom"], 0.25).groupBy("chrom").agg(F.count("*").alias("n")), f"WITH {V.FRAGS} SELECT chrom, CAST(floor(count(*) * 0.25) AS BIGINT) AS n FROM f GROUP BY chrom HAVING floor(count(*) * 0.25) > 0")


# No SQL twin: array-shaped or fitted. Tests hold them against planted cases.
_strong = lambda s, d: peaks.call(V.signal_a(s, d), 30.0, 500, 300, strict=True).select("chrom", "start", "end")
# A region's profile at every position, padded by 20 zeros before it and mirrored by half a window to both sides; the slope's
# sign from running sums; summits, dips between them, bars, and what rises over them.
_SUBPEAKS = f"""WITH {V.SIGNAL_A}, k AS (SELECT * FROM a WHERE v > 30), {V.sql_islands("i", "k", 300)}, rg AS (SELECT chrom, min(s) AS s, max(e) AS e FROM i GROUP BY chrom, g HAVING max(e) - min(s) >= 500),
cv AS (SELECT rg.chrom, rg.s, rg.e, unnest(range(greatest(a.s, rg.s), least(a.e, rg.e))) - rg.s + 20 AS i, v FROM rg JOIN a ON a.chrom = rg.chrom AND a.s < rg.e AND a.e > rg.s),
y AS MATERIALIZED (SELECT rg.chrom, rg.s, rg.e, n.i, coalesce(cv.v, 0) AS v FROM (SELECT *, unnest(range(0, e - s + 20)) AS i FROM rg) AS n JOIN rg USING (chrom, s) LEFT JOIN cv ON cv.chrom = n.chrom AND cv.s = n.s AND cv.i = n.i),
z AS (SELECT chrom, s, e, last(v ORDER BY i) AS v FROM y GROUP BY chrom, s, e),
wide AS (SELECT chrom, s, e, i, v FROM y UNION ALL SELECT chrom, s, e, -i, -v FROM y WHERE i BETWEEN 1 AND 250
  UNION ALL SELECT y.chrom, y.s, y.e, 2 * (y.e - y.s + 19) - i, z.v + abs(y.v - z.v) FROM y JOIN z USING (chrom, s, e) WHERE i BETWEEN y.e - y.s + 19 - 250 AND y.e - y.s + 18),
sl AS (SELECT chrom, s, e, i, v, sign(sum(v * i) OVER w - i * sum(v) OVER w) AS d FROM wide WINDOW w AS (PARTITION BY chrom, s ORDER BY i ROWS BETWEEN 250 PRECEDING AND 250 FOLLOWING)),
sg AS (SELECT *, lead(d) OVER (PARTITION BY chrom, s ORDER BY i) AS nd FROM (SELECT * FROM sl WHERE i BETWEEN 0 AND e - s + 19)),
tp AS (SELECT chrom, s, e, i, v, lead(i) OVER (PARTITION BY chrom, s ORDER BY i) AS ni, row_number() OVER (PARTITION BY chrom, s ORDER BY i) AS k, count(*) OVER (PARTITION BY chrom, s) AS n FROM sg WHERE nd < d AND i BETWEEN 10 AND e - s + 10),
dp AS (SELECT tp.chrom, tp.s, tp.k, arg_min(y.i, (y.v, y.i)) AS i, min(y.v) + sqrt(min(y.v)) AS bar FROM tp JOIN y ON y.chrom = tp.chrom AND y.s = tp.s AND y.i >= tp.i AND y.i < tp.ni GROUP BY tp.chrom, tp.s, tp.k),
sd AS (SELECT tp.*, coalesce(b.i, 0) AS lo, coalesce(c.i, tp.e - tp.s + 20) AS hi, CASE WHEN tp.k = 1 THEN c.bar + sqrt(c.bar) ELSE greatest(coalesce(b.bar, 0), coalesce(c.bar, 0)) END AS bar FROM tp LEFT JOIN dp AS b ON b.chrom = tp.chrom AND b.s = tp.s AND b.k = tp.k - 1 LEFT JOIN dp AS c ON c.chrom = tp.chrom AND c.s = tp.s AND c.k = tp.k),
un AS (SELECT sd.*, coalesce((SELECT min(y.i) FROM y WHERE y.chrom = sd.chrom AND y.s = sd.s AND y.i >= sd.i AND y.i < sd.hi AND y.v < sd.bar), hi) AS up FROM sd),
ok AS (SELECT un.chrom, un.s, un.e, un.i FROM un JOIN y ON y.chrom = un.chrom AND y.s = un.s AND y.i >= lo AND y.i < up WHERE n > 1 GROUP BY un.chrom, un.s, un.e, un.i, lo, up HAVING any_value(up - lo) >= 50 AND count(DISTINCT y.v) >= 6 UNION ALL SELECT chrom, s, e, i FROM tp WHERE n = 1),
mx AS (SELECT chrom, s, e, i, row_number() OVER (PARTITION BY chrom, s ORDER BY i) AS k, count(*) OVER (PARTITION BY chrom, s) AS n FROM (SELECT y.*, max(v) OVER (PARTITION BY chrom, s) AS top FROM y WHERE i >= 20) WHERE v = top),
al AS (SELECT * FROM ok UNION ALL SELECT chrom, s, e, i FROM mx WHERE k = (n - 1) // 2 + 1 AND (chrom, s) NOT IN (SELECT (chrom, s) FROM ok))
SELECT al.chrom, al.s AS "start", al.e AS "end", al.s + al.i - 20 AS summit, y.v AS score FROM al JOIN y ON y.chrom = al.chrom AND y.s = al.s AND y.i = greatest(al.i, 20)"""
_add("subpeak_summits", lambda s, d: shapes.subpeaks(V.signal_a(s, d), _strong(s, d), 500), _SUBPEAKS)
_add(
    "wtd_refine",
    lambda s, d: _out(commands.refinepeak(_strong(s, d).withColumn("name", F.concat_ws("_", "chrom", "start")), V.tags_treat(s, d), 5.0, 400)),
    f"""WITH {V.SIGNAL_A}, k AS (SELECT * FROM a WHERE v > 30), {V.sql_islands("i", "k", 300)}, rg AS (SELECT chrom, min(s) AS s, max(e) AS e FROM i GROUP BY chrom, g HAVING max(e) - min(s) >= 500),
sp AS (SELECT chrom, s, unnest(range(s - 400, e + 401)) AS p FROM rg), n AS (SELECT chrom, pos, strand, count(*) AS n FROM tt GROUP BY chrom, pos, strand),
near AS (SELECT rg.chrom, rg.s, n.pos, n.strand, n.n FROM rg JOIN n ON n.chrom = rg.chrom AND n.pos BETWEEN rg.s - 800 AND rg.e + 800),
c AS (SELECT sp.chrom, sp.s, p, coalesce(sum(n) FILTER (strand = 0 AND pos < p), 0) AS wl, coalesce(sum(n) FILTER (strand = 0 AND pos >= p), 0) AS wr, coalesce(sum(n) FILTER (strand = 1 AND pos < p), 0) AS cl, coalesce(sum(n) FILTER (strand = 1 AND pos >= p), 0) AS cr
  FROM sp LEFT JOIN near ON near.chrom = sp.chrom AND near.s = sp.s AND near.pos BETWEEN p - 400 AND p + 400 GROUP BY sp.chrom, sp.s, p),
m AS (SELECT chrom, s, p, 2 * sqrt(wl * cr) - wr - cl AS score, row_number() OVER (PARTITION BY chrom, s ORDER BY round(2 * sqrt(wl * cr) - wr - cl, 9) DESC, p) AS k FROM c)
SELECT chrom, chrom || '_' || s || CASE WHEN score > 5 THEN '_R' ELSE '_F' END AS name, p AS summit, round(score, 5) AS score FROM m WHERE k = 1""",
)


def frag_em(spark: SparkSession, d: str) -> DataFrame:
    means, stddevs = models.mixture(V.fragments(spark, d))
    return spark.createDataFrame(list(zip(models.CLASSES, means, stddevs)), "class string, mean double, stddev double")


_add("frag_em", frag_em)


def hmm_states(spark: SparkSession, d: str) -> DataFrame:
    """State runs of the cells' four fragment-length signals over their islands, by a given Poisson model."""
    frags = V.fragments(spark, d).where("barcode is not null").select("chrom", "l", "r")
    weights = models.length_weights(tracks.length_histogram(frags), [50, 200, 400, 600], [20, 20, 20, 20])
    model = models.StateModel("poisson", [0.2, 0.3, 0.5], [[0.9, 0.08, 0.02], [0.05, 0.9, 0.05], [0.01, 0.04, 0.95]], [[2.0, 0.5, 0.2, 0.1], [0.5, 1.5, 0.4, 0.2], [0.1, 0.1, 0.05, 0.05]])
    bins = models.bin_signals(models.digested(frags, weights), V.islands(spark, d), 10)
    return models.state_runs(models.decode_states(bins, model), 10)


_add("hmm_states", hmm_states)


_add("sink_condition_matrix", lambda s, d: sinks.condition_matrix(_four(s, d)), f"{_DIFF} SELECT printf('%s:%d_%d', chrom, s, e) || printf('\t%.5f\t%.5f\t%.5f', l1, l2, l12) AS value FROM l")


def matrix_back(spark: SparkSession, d: str) -> DataFrame:
    """The entity-by-region matrix, written partitioned by chrom and read."""
    path = scratch(spark, "matrix")
    sinks.matrix(intervals.counts_by_entity(V.fragments(spark, d), V.regions(spark, d)), path)
    return spark.read.parquet(path).select("barcode", "chrom", "start", "end", "cnt")


_add("sink_cell_matrix", matrix_back, SQL["cell_by_peak"])
_add(
    "pileup_clipped",
    lambda s, d: pileup.pileup(pileup.clip(V.fragments(s, d).select("chrom", (F.col("l") - 500).alias("l"), (F.col("r") + 500).alias("r")), table(s, d, "chrom_sizes"))),
    f"""WITH {V.FRAGS}, z AS (SELECT chrom, max(chrom_len) AS n FROM chrom_sizes GROUP BY chrom), g AS (SELECT f.chrom, greatest(least(l - 500, coalesce(n, 2147483647)), 0) AS l, greatest(least(r + 500, coalesce(n, 2147483647)), 0) AS r FROM f LEFT JOIN z ON z.chrom = f.chrom), {V.sql_pileup("a", "g")} SELECT {_SEG}, v AS value FROM a""",
)
_add("segment_counts", lambda s, d: V.signal_a(s, d).groupBy("chrom").agg(F.count("*").alias("n")), f"WITH {V.SIGNAL_A} SELECT chrom, count(*) AS n FROM a GROUP BY chrom")
_STRONG = f"""{V.SIGNAL_A}, k AS (SELECT * FROM a WHERE v > 30), {V.sql_islands("i", "k", 300)}, rg AS (SELECT chrom, min(s) AS s, max(e) AS e FROM i GROUP BY chrom, g HAVING max(e) - min(s) >= 500)"""


def _centre_counts(spark: SparkSession, d: str) -> DataFrame:
    """Tags by strand and offset around the middle of strong regions."""
    middle = _strong(spark, d).select("chrom", F.floor((F.col("start") + F.col("end")) / 2).cast("long").alias("start")).withColumn("end", F.col("start"))
    hits = intervals.points_in_windows(V.tags_treat(spark, d), middle, 200)
    return hits.groupBy("strand", (F.col("pos") - F.col("b_start")).cast("int").alias("offset")).agg(F.count("*").alias("n"))


_add("centre_counts", _centre_counts, f"WITH {_STRONG} SELECT strand, CAST(pos - (s + e) // 2 AS INT) AS \"offset\", count(*) AS n FROM rg JOIN tt ON tt.chrom = rg.chrom AND abs(pos - (s + e) // 2) <= 200 GROUP BY ALL")


def _posteriors(spark: SparkSession, d: str) -> DataFrame:
    """Bins of strong regions with three weights that follow the signal."""
    bins = intervals.bins(_strong(spark, d), 100).select("chrom", "bin_end")
    v = F.col("value") / 60
    return step.sample_at(V.signal_a(spark, d), bins).select("chrom", "bin_end", (v * v).alias("p_open"), F.lit(0.34).alias("p_nuc"), F.greatest(0.85 - v, F.lit(0.0)).alias("p_bg"))


_POST = f"""WITH {_STRONG}, bn AS (SELECT chrom, unnest(range(s // 100 * 100 + 100, e // 100 * 100 + 1, 100)) AS bin_end FROM rg), sv AS (SELECT bn.chrom, bin_end, v / 60 AS v FROM bn ASOF JOIN a ON a.chrom = bn.chrom AND bin_end > a.s),
y AS (SELECT chrom, bin_end - 100 AS s, bin_end AS e, CASE WHEN v * v >= 0.34 AND v * v >= greatest(0.85::DOUBLE - v, 0) THEN 'open' WHEN 0.34 >= greatest(0.85::DOUBLE - v, 0) THEN 'nuc' ELSE 'bg' END AS v FROM sv), {V.sql_rle("z", "y")}"""
_add("state_runs", lambda s, d: models.state_runs(_posteriors(s, d), 100), f"{_POST} SELECT {_SEG}, v AS state FROM z")
_add("sink_state_bed", lambda s, d: sinks.state_bed(models.state_runs(_posteriors(s, d), 100)), f"{_POST} SELECT concat_ws('\t', chrom, s, e, v) AS value FROM z WHERE v <> 'bg'")
_add(
    "accessible_runs",
    lambda s, d: models.accessible(step.rle(V.signal_a(s, d).select("chrom", "start", "end", F.when(F.col("value") >= 28, "open").when(F.col("value") >= 20, "nuc").otherwise("bg").alias("state")), ["state"]), 100),
    f"""WITH {V.SIGNAL_A}, y AS (SELECT chrom, s, e, CASE WHEN v >= 28 THEN 'open' WHEN v >= 20 THEN 'nuc' ELSE 'bg' END AS v FROM a), {V.sql_rle("z", "y")}, n AS (SELECT *, lag(v) OVER w AS pv, lag(s) OVER w AS ps, lag(e) OVER w AS pe, lead(v) OVER w AS nv, lead(s) OVER w AS ns, lead(e) OVER w AS ne FROM z WINDOW w AS (PARTITION BY chrom ORDER BY s))
SELECT chrom, ps AS "start", ne AS "end", s AS open_start, e AS open_end FROM n WHERE v = 'open' AND pv = 'nuc' AND nv = 'nuc' AND pe = s AND ns = e AND ne - ps > 100""",
)


def _inverse(spark: SparkSession, d: str) -> DataFrame:
    """Quantiles of Poisson and binomial counts over a grid."""
    rows = [(lam, q, stats.poisson_cdf_inv(q, lam), stats.poisson_sf_inv(q, lam), stats.binomial_cdf_inv(q, 200, lam / 200)) for lam in (0.5, 3.0, 17.5, 60.0) for q in (0.011, 0.123, 0.456, 0.789, 0.987)]
    return spark.createDataFrame(rows, "lam double, q double, poisson int, poisson_upper int, binomial int")


_add(
    "dist_inverse",
    _inverse,
    """WITH g AS (SELECT CAST(lam AS DOUBLE) AS lam, CAST(q AS DOUBLE) AS q FROM (SELECT unnest([0.5, 3.0, 17.5, 60.0]) AS lam), (SELECT unnest([0.011, 0.123, 0.456, 0.789, 0.987]) AS q)), k AS (SELECT lam, q, unnest(range(0, 201)) AS k FROM g),
c AS (SELECT lam, q, k, sum(exp(k * ln(lam) - lam - lgamma(k + 1))) OVER w AS p, sum(exp(lgamma(201) - lgamma(k + 1) - lgamma(200 - k + 1) + k * ln(lam / 200) + (200 - k) * ln(1 - lam / 200))) OVER w AS b FROM k WINDOW w AS (PARTITION BY lam, q ORDER BY k))
SELECT lam, q, CAST(min(k) FILTER (p >= q) AS INT) AS poisson, CAST(min(k) FILTER (1 - p <= q) AS INT) AS poisson_upper, CAST(min(k) FILTER (b >= q) AS INT) AS binomial FROM c GROUP BY lam, q""",
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"p2_found": p2_found, "p3_found": p3_found, "p5_found": p5_found, "p5_loaded": p5_loaded} | QUERIES | calls.QUERIES | formats.QUERIES


def oracle_sql() -> dict[str, str]:
    return {"p2_found": P2_SQL, "p3_found": P3_SQL, "p5_found": V.P5_SQL, "p5_loaded": V.P5_LOADED_SQL} | SQL | calls.SQL | formats.SQL
