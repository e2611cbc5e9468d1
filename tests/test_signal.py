"""Coverage, step algebra, statistics and scores.

Fixed values: the literal numbers of this file are published results that must come out; they are stated as they are.
"""

import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import scores, stats
from tidemark.operators import intervals, peaks, pileup, qvalue, step
from tidemark.operators.ordered import along, islands

SEG = "chrom string, start long, end long, value double"


def ends(df):
    return [(r["end"], r["value"]) for r in df.orderBy("chrom", "start").collect()]


def track(spark, *cells):
    """(end, value) cells of one contiguous chrom."""
    out, at = [], 0
    for e, v in cells:
        out.append(("chrY", at, e, float(v)))
        at = e
    return spark.createDataFrame(out, SEG)


FRAGS = [(1, 5), (2, 6), (4, 8), (4, 8), (5, 9), (6, 10), (12, 14), (13, 17), (14, 18), (17, 19)]


@pytest.mark.parametrize("shard", [3, 1 << 16])
def test_pileup_of_fragments(spark, shard):
    df = spark.createDataFrame([("c", l, r) for l, r in FRAGS], "chrom string, l int, r int")
    assert ends(pileup.pileup(df, shard=shard)) == [(1, 0), (2, 1), (4, 2), (8, 4), (9, 2), (10, 1), (12, 0), (13, 1), (18, 2), (19, 1)]
    w = pileup.pileup(df, F.log2(F.col("r") - F.col("l")))
    assert [(e, round(v, 6)) for e, v in ends(w)] == [(1, 0), (2, 2), (4, 4), (8, 8), (9, 4), (10, 2), (12, 0), (13, 1), (14, 3), (17, 4), (18, 3), (19, 1)]


def test_pileup_weights_nulls_and_clashing_names(spark):
    df = spark.createDataFrame([("c", 5, 9, 2, 1), ("c", 1, 4, 1, 1), ("c", 2, 6, 3, 1), ("c", 2, 6, 2, 1), (None, 1, 2, 9, 1), ("c", None, 2, 9, 1), ("c", 4, 4, 9, 1), ("c", 1, 2, None, 1)], "chrom string, l int, r int, cnt int, value int")
    assert ends(pileup.pileup(df, F.col("cnt").cast("long"))) == [(1, 0), (2, 1), (4, 6), (5, 5), (6, 7), (9, 2)]
    assert pileup.pileup(df.limit(0)).count() == 0


def test_single_end_pileups(spark):
    tags = spark.createDataFrame([("c", p, 0) for p in (0, 1, 3, 3, 4, 5)] + [("c", p, 1) for p in (5, 6, 8, 8, 9, 10)], "chrom string, pos int, strand int")
    assert ends(pileup.pileup_tags(tags, 2)) == [(1, 1), (2, 2), (3, 1), (4, 3), (5, 5), (8, 3), (9, 2), (10, 1)]
    both = spark.createDataFrame([("c", p, 0) for p in (2, 3, 5, 5, 6, 7)], "chrom string, pos int, strand int")
    assert ends(pileup.pileup_tags(both, 4, directional=False)) == [(1, 1), (3, 2), (7, 4), (8, 2), (9, 1)]


def test_along_carries_across_shards(spark):
    df = spark.createDataFrame([("a", p, v) for p, v in ((0, 1), (5, None), (12, 3), (40, None), (41, 2))] + [(None, 7, 4)], "k string, p long, v long")
    for shard in (4, 10, 1000):
        out = along(df, ["k"], "p", sums={"s": F.coalesce("v", F.lit(0))}, lags={"a": F.col("p")}, leads={"b": F.col("p")}, fills={"f": F.col("v")}, reach={"m": F.col("p")}, shard=shard)
        got = [tuple(r) for r in out.where("k is not null").orderBy("p").select("p", "s", "a", "b", "f", "m").collect()]
        assert got == [(0, 1, None, 5, 1, None), (5, 1, 0, 12, 1, 0), (12, 4, 5, 40, 3, 5), (40, 4, 12, 41, 3, 12), (41, 6, 40, None, 2, 40)]


def test_islands_of_equal_rows(spark):
    df = spark.createDataFrame([("a", s, e) for s, e in ((1, 3), (10, 12), (10, 12), (10, 12), (11, 20), (30, 31), (30, 31))], "k string, s long, e long")
    got = islands(df, ["k"], "s", "e", shard=4).groupBy("island").agg(F.min("s"), F.max("e"), F.count("*")).orderBy("island").collect()
    assert [tuple(r)[1:] for r in got] == [(1, 3, 1), (10, 20, 4), (30, 31, 2)]


@pytest.mark.parametrize("shard", [2, 7, 1000])
def test_islands_and_runs_across_shards(spark, shard):
    rng = random.Random(shard)
    data = [(rng.choice(["a", "b", None]), s, s + rng.choice([1, 2, 3, 9, 40])) for s in (rng.randrange(400) for _ in range(200))]
    for gap in (0, 3):
        want = []
        for k in ("a", "b", None):
            reach = None
            for s, e in sorted((s, e) for kk, s, e in data if kk == k):
                if reach is None or s - reach > gap:
                    want.append([k or "", s, e, 0])
                want[-1][2], want[-1][3] = max(want[-1][2], e), want[-1][3] + 1
                reach = max(reach or e, e)
        got = islands(spark.createDataFrame(data, "k string, s long, e long"), ["k"], "s", "e", gap, shard=shard).groupBy("k", "island").agg(F.max("e"), F.count("*")).collect()
        assert sorted([r[0] or "", *r[1:]] for r in got) == sorted(want)
    at, segs = 0, []
    for _ in range(200):
        n = rng.choice([1, 2, 5, 30])
        segs.append(("a", at, at + n, rng.choice([1.0, 1.0, 2.0, None])))
        at += n + (rng.random() < 0.1)
    want = []
    for _, s, e, v in segs:
        if want and want[-1][1] == s and want[-1][2] == v:
            want[-1][1] = e
        else:
            want.append([s, e, v])
    assert [list(r)[1:] for r in step.rle(spark.createDataFrame(segs, "chrom string, start long, end long, value double"), shard=shard).orderBy("start").select("chrom", "start", "end", "value").collect()] == want


def test_together_is_the_alignment_of_pileups(spark, rows):
    rng = random.Random(12)
    mk = lambda n, far: spark.createDataFrame([(rng.choice(["a", "b"]), s, s + rng.randrange(1, 30)) for s in (rng.randrange(far) for _ in range(n))] + [("a", None, 3), (None, 1, 2), ("b", 5, 5)], "chrom string, l long, r long")
    one, two = mk(60, 300), mk(40, 200)
    for how in ("inner", "outer"):
        got = pileup.together({"x": {"df": one, "scale": 0.5}, "y": {"df": two, "baseline": 1.0}}, how, shard=16)
        want = step.align({"x": pileup.pileup(one, scale=0.5), "y": pileup.pileup(two, baseline=1.0)}, how)
        key = lambda r: (r[0], r[1])
        assert sorted(map(tuple, got.collect()), key=key) == sorted(map(tuple, want.collect()), key=key)


def test_overlays(spark):
    t1, t2, t3 = track(spark, (70, 0), (80, 7), (150, 0)), track(spark, (85, 0), (90, 75), (155, 0)), track(spark, (75, 20), (90, 35), (150, 10))
    assert ends(step.overlay([t1, t2, t3], "max")) == [(75, 20), (85, 35), (90, 75), (150, 10)]
    assert [(e, round(v, 5)) for e, v in ends(step.overlay([t1, t2, t3], "mean"))] == [(70, 6.66667), (75, 9), (80, 14), (85, 11.66667), (90, 36.66667), (150, 3.33333)]
    assert [(e, round(v, 4)) for e, v in ends(step.overlay([t1, t2, t3], "fisher"))] == [(70, 16.9557), (75, 23.6999), (80, 38.3211), (85, 31.4777), (90, 105.4904), (150, 7.5389)]
    p1, p2 = track(spark, (2, 1), (5, 2), (7, 3), (8, 4), (9, 3), (12, 2)), track(spark, (1, 5), (4, 3), (6, 2), (8, 1), (10, 0), (11, 3))
    cells = step.align({"a": p1, "b": p2}, shard=4).orderBy("start")
    assert [(r["end"], max(r["a"], r["b"])) for r in cells.collect()] == [(1, 5), (2, 3), (4, 3), (5, 2), (6, 3), (7, 3), (8, 4), (9, 3), (10, 2), (11, 3)]


def test_refine_and_sample(spark):
    full = track(spark, (70, 6.66667), (75, 9), (80, 14), (85, 11.66667), (90, 36.66667), (150, 3.33333), (155, 0))
    regions = spark.createDataFrame([("chrY", 50, 80), ("chrY", 95, 152)], "chrom string, start long, end long")
    assert [tuple(r) for r in peaks.refine(full, regions).orderBy("start").collect()] == [("chrY", 50, 80, 77, 14.0), ("chrY", 95, 152, 122, 3.33333)]
    at = spark.createDataFrame([("chrY", 70), ("chrY", 71), ("chrY", 200)], "chrom string, bin_end long")
    assert sorted((r["bin_end"], r["value"]) for r in step.sample_at(full, at).collect() if r["value"] is not None) == [(70, 6.66667), (71, 9.0)]


def scored_cells(spark):
    t, c = track(spark, (10, 100), (60, 10), (110, 15), (160, 5), (210, 20)), track(spark, (10, 10), (60, 10), (110, 20), (160, 20), (210, 5))
    return step.align({"treat": t, "ctrl": c})


def test_scores(spark):
    p = qvalue.scored(scored_cells(spark), 1.0)
    assert [round(r["pscore"], 5) for r in p.orderBy("start").collect()] == [60.48912, 0.37599, 0.07723, 0.00006, 6.40804]
    q = qvalue.with_qscore(p).orderBy("start").collect()
    assert [round(r["qscore"], 2) for r in q] == [58.17, 0, 0, 0, 5.13]
    want = {"l": [58.17, 0, -0.28, -3.25, 4.91], "f": [0.96, 0, -0.12, -0.54, 0.54], "d": [90, 0, -5, -15, 15]}
    for m, values in want.items():
        got = scored_cells(spark).orderBy("start").select(scores.score(m, F.col("treat"), F.col("ctrl"), 1.0).alias("s")).collect()
        assert [round(r["s"], 2) + 0 for r in got] == values
    assert scores.normalization("T", 10, 5) == (1.0, 2.0)


def test_score_track_peaks(spark):
    track_p = qvalue.scored(scored_cells(spark), 1.0).withColumn("value", F.col("pscore"))
    got = [(r["start"], r["end"], r["summit"], round(r["score"], 4)) for r in peaks.call(track_p, 0.1, 10, 10).orderBy("start").collect()]
    assert got == [(0, 60, 5, 60.4891), (160, 210, 185, 6.408)]


def test_poisson_and_chi_square(spark):
    one = spark.range(1)
    val = lambda c: one.select(c.alias("x")).first()[0]
    assert 10 ** val(stats.poisson_log10_sf(F.lit(80), F.lit(100.0))) == pytest.approx(0.97735, abs=1e-5)
    assert val(stats.poisson_log10_sf(F.lit(200), F.lit(100.0))) == pytest.approx(math.log10(4.626179e-19), abs=1e-6)
    assert val(stats.poisson_log10_sf(F.lit(1500), F.lit(1000.0))) == pytest.approx(math.log10(2.097225e-49), abs=1e-6)
    assert val(stats.poisson_log10_sf(F.lit(3), F.lit(0.0))) is None
    for x, df, want in ((10, 2, 2.1715), (1000, 22, 196.7085), (10, 4, 1.3933), (100, 8, 17.3697), (1000, 80, 158.1618), (54, 6, 9.1321), (7765, 12, 1670.2814)):
        assert val(stats.chi2_log10_sf(F.lit(float(x)), df)) == pytest.approx(want, abs=1e-4)
    for x in (-3.5, -1.0, 0.0, 0.3, 2.9, 3.1, 5.0):
        assert val(stats.erf(F.lit(x))) == pytest.approx(math.erf(x), abs=1e-9)
    assert stats.binomial_cdf(20, 1000, 0.01) == pytest.approx(0.9985035) and stats.binomial_pmf(20, 1000, 0.01) == pytest.approx(0.001791878)
    assert (stats.binomial_cdf_inv(0.1, 1000, 0.01), stats.binomial_cdf_inv(0.01, 1000, 0.01)) == (6, 3)
    assert stats.poisson_cdf(80, 100) == pytest.approx(0.02265, abs=1e-5)


def test_barcoded_fragments(spark):
    a, b, c = "A", "B", "C"
    data = [(0, 100, a, 2), (70, 170, a, 1), (80, 190, a, 1), (85, 180, a, 3), (100, 190, a, 1), (0, 100, b, 1), (70, 170, b, 2), (80, 190, b, 1), (85, 180, b, 1), (100, 190, b, 3), (10, 110, c, 1), (50, 160, c, 2), (100, 170, c, 3)]
    df = spark.createDataFrame([("chrY", *x) for x in data], "chrom string, l int, r int, barcode string, cnt int")
    cover = pileup.pileup(df, F.col("cnt").cast("long"))
    assert ends(cover) == list(zip((10, 50, 70, 80, 85, 100, 110, 160, 170, 180, 190), (3, 4, 6, 9, 11, 15, 19, 18, 16, 10, 6)))
    assert [tuple(r) for r in peaks.call(cover, 10, 20, 10).collect()] == [("chrY", 80, 180, 105, 19.0)]
    left = intervals.exclude(df, spark.createDataFrame([("chrY", 10, 75)], "chrom string, start long, end long"), "l", "r")
    assert left.agg(F.sum("cnt"), F.sum((F.col("r") - F.col("l")) * F.col("cnt"))).first()[:] == (13, 1170)


def test_cell_by_region(spark):
    df = spark.createDataFrame([("c", 0, 150, "A", 2), ("c", 190, 260, "B", 3), ("c", 0, 150, None, 9)], "chrom string, l int, r int, barcode string, cnt int")
    regions = spark.createDataFrame([("c", 10, 90), ("c", 80, 120), ("c", 200, 240)], "chrom string, start long, end long")
    assert sorted(tuple(r) for r in intervals.counts_by_entity(df, regions, size=16).collect()) == [("A", "c", 10, 120, 2), ("B", "c", 200, 240, 3)]


def test_region_algebra(spark, rows):
    mk = lambda xs: spark.createDataFrame([("chrY", a, b) for a, b in xs], "chrom string, start long, end long")
    both = mk([(0, 100), (300, 500), (700, 900), (1000, 1200), (100, 200), (300, 400), (600, 800), (1200, 1300)])
    assert [r[1:] for r in rows(intervals.merge(both).select("chrom", "start", "end"))] == [(0, 200), (300, 500), (600, 900), (1000, 1300)]
    r4, r5 = mk([(0, 100), (300, 500), (700, 900), (1000, 1200)]), mk([(100, 200), (300, 400), (600, 800), (1100, 1150), (1175, 1300)])
    want = [(300, 400), (700, 800), (1100, 1150), (1175, 1200)]
    assert [r[1:] for r in rows(intervals.intersect(r4, r5))] == want == [r[1:] for r in rows(intervals.intersect(r5, r4))]
    assert rows(intervals.exclude(r4, mk([(90, 300)]))) == [("chrY", 300, 500), ("chrY", 700, 900), ("chrY", 1000, 1200)]
    assert sorted(r["batch"] for r in intervals.batches(both, 3).collect()) == [0, 0, 0, 1, 1, 1, 2, 2]
    assert intervals.total_length(mk([]).limit(0)).first()[0] == 0


def test_broad_blocks(spark):
    t = track(spark, (100, 0), (150, 3), (200, 1.5), (260, 3), (300, 1.5), (400, 0))
    got = peaks.call_broad(t, 2, 1, 40, 10, 100).first()
    assert (got["start"], got["end"], got["thick_start"], got["thick_end"]) == (100, 300, 100, 260)
    assert [(b["offset"], b["size"]) for b in got["blocks"]] == [(0, 50), (100, 60), (199, 1)]
