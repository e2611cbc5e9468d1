"""Per-key profiles, periods and gaps, and export lines against brute force, with nulls, ties, repeats and empty tables."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import coverage, intervals, skew, tracks
from tidemark.sources import export_lines


def test_key_profile_brute_force(spark):
    rng = random.Random(1)
    data = []
    for i in range(600):
        chrom = rng.choice(["hot"] * 6 + ["a", "b", None])
        l = rng.choice([None, 5, rng.randrange(200)])
        r = None if l is None else l + rng.randrange(-2, 30)
        data += [(i, chrom, l, r, "x")] * rng.choice([1, 1, 2])
    want = {}
    for i, c, l, r, _ in set(data):
        if c and l is not None and r > l:
            want.setdefault(c, []).append((l, r))
    expect = sorted((c, len(v), len(set(v)), max(sum(l <= p < r for l, r in v) for p in range(240))) for c, v in want.items())
    df = spark.createDataFrame(data, "frag_id long, chrom string, l int, r int, n_frag string")
    for shard in (16, 1 << 14):
        assert sorted(tuple(x) for x in skew.key_profile(df, shard=shard).collect()) == expect
    assert skew.key_profile(df.limit(0)).count() == 0


def test_weighted_percentiles_and_mode(spark):
    rng = random.Random(2)
    data = [("hot", rng.randrange(1000)) for _ in range(3000)] + [("one", 7), ("two", 3), ("two", 9), ("null", None)]
    df = spark.createDataFrame(data, "k string, v long")
    freq = skew.value_frequencies(df, ["k"], ["v"])
    got = {(r["k0"], r["q"]): r["value"] for r in skew.weighted_percentile(freq, ["k0"], "v0", [0.1, 0.5, 1.0], shards=8).collect()}
    for key in ("hot", "one", "two"):
        xs = sorted(v for k, v in data if k == key)
        for q in (0.1, 0.5, 1.0):
            assert got[key, q] == xs[max(1, -(-int(round(q * len(xs) * 1000)) // 1000)) - 1]
    modes = {r["k0"]: r["mode"] for r in skew.weighted_mode(freq, ["k0"], "v0").collect()}
    assert modes["two"] == 3 and modes["one"] == 7
    assert {r["k0"]: (r["n"], r["n_distinct"]) for r in skew.weighted_distinct(freq, ["k0"]).collect()}["two"] == (2, 2)


def brute_periods(xs):
    out, gaps = [], []
    for s, e in sorted(xs):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    gaps = [(a[1], b[0]) for a, b in zip(out, out[1:])]
    return [("period", *p) for p in out] + [("gap", *g) for g in gaps]


@pytest.mark.parametrize("shard", [4, 10, 64, 1 << 18])
def test_periods_and_gaps(spark, shard):
    rng = random.Random(shard)
    data = []
    for ent in ("a", "b", "c"):
        for _ in range(40):
            s = rng.randrange(300)
            data.append((1, ent, s, s + rng.choice([0, -1, 1, 2, 3, 10, 45])))
    data += [(1, "lone", 3, 9), (None, "a", 1, 9), (1, None, 1, 9), (1, "a", None, 9), (2, "edge", 0, shard), (2, "edge", shard, 2 * shard), (3, "neg", -5, -2), (3, "neg", 1, 2)]
    want = []
    groups = {}
    for r, c, s, e in data:
        if None not in (r, c, s, e) and e > s:
            groups.setdefault((r, c), []).append((s, e))
    for k, xs in groups.items():
        want += [(*k, *p) for p in brute_periods(xs)]
    df = spark.createDataFrame(data + data[:20], "run_id long, chrom string, start_pos int, end_pos int")
    assert sorted(tuple(x) for x in coverage.periods_and_gaps(df, ["run_id", "chrom"], "start_pos", "end_pos", shard).collect()) == sorted(want)
    assert coverage.periods_and_gaps(df.limit(0), ["run_id", "chrom"], "start_pos", "end_pos").count() == 0


def test_periods_on_time_axes(spark):
    from datetime import datetime, timedelta

    t0 = datetime(1969, 12, 31, 23, 59, 59, 999_998)
    spans = [(0, 5), (3, 9), (9, 12), (3_000_000_000, 3_000_000_007), (9_000_000_000_000, 9_000_000_000_001)]
    want = [("period", 0, 12), ("gap", 12, 3_000_000_000), ("period", 3_000_000_000, 3_000_000_007), ("gap", 3_000_000_007, 9_000_000_000_000), ("period", 9_000_000_000_000, 9_000_000_000_001)]
    numbers = spark.createDataFrame([("k", a, b) for a, b in spans], "k string, s long, e long")
    assert sorted(tuple(r)[1:] for r in coverage.periods_and_gaps(numbers, ["k"], "s", "e").collect()) == sorted(want)
    at = lambda n: t0 + timedelta(microseconds=n)
    for kind in ("timestamp", "timestamp_ntz"):
        times = spark.createDataFrame([("k", at(a), at(b)) for a, b in spans], f"k string, s {kind}, e {kind}")
        got = coverage.periods_and_gaps(times, ["k"], "s", "e")
        assert dict(got.dtypes)["seg_start"] == kind
        assert sorted(tuple(r)[1:] for r in got.select("k", "kind", *(F.col(c).cast("string").alias(c) for c in ("seg_start", "seg_end"))).collect()) == sorted((k, *(x.isoformat(" ").rstrip("0") for x in map(at, ab))) for k, *ab in want)
    days = spark.sql("select 'k' k, date'2024-02-28' s, date'2024-03-01' e union all select 'k', date'2024-03-05', date'2024-03-06'")
    assert sorted(map(str, [v for r in coverage.periods_and_gaps(days, ["k"], "s", "e").where("kind = 'gap'").collect() for v in r[2:]])) == ["2024-03-01", "2024-03-05"]
    with pytest.raises(TypeError):
        coverage.periods_and_gaps(spark.createDataFrame([("k", 1.0, 2.0)], "k string, s double, e double"), ["k"], "s", "e")


def line(**over):
    f = ["m", "1", "2", "3", "4", "5", "6", "7", "ACGT", "IIII", "chr1", "", "123", "F", "x", "1", "2", "3", "4", "5", "6", "Y"]
    for k, v in over.items():
        f[int(k[1:])] = v
    return "\t".join(f)


LINES = [
    (line(), None), (line() + "\r", None), (None, "skip"), ("", "skip"), ("# x", "skip"), ("\r", "skip"), (line() + "\textra", "columns"), ("a\tb", "columns"), (line(f0='"a\tb ""q"""'), None), (line(f0='"open'), "quoting"),
    (line(f0='"a"b'), "quoting"), (line(f0='a"b'), None), (line(f8=""), "sequence"), (line(f8="ACGU"), "sequence"), (line(f9="III"), "quality"), (line(f10="  "), "chrom"), (line(f12="0"), "position"), (line(f12="2147483648"), "position"),
    (line(f12="٣"), "position"), (line(f12="2147483647"), None), (line(f13="f"), "strand"), (line(f12="", f13="", f10=""), None), (line(f21="y"), "filter"), (line(f9="II", f13="?"), "quality"), (line(f0='"' + "x" * 200000 + '"'), None), (line(f21="Y\r"), "filter"),
]


def test_export_lines(spark):
    df = spark.createDataFrame([(i, x, "c") for i, (x, _) in enumerate(LINES)], "line_id long, raw_line string, reason string")
    want = {i: r for i, (_, r) in enumerate(LINES) if r not in (None, "skip")}
    want.pop(25)  # one carriage return is dropped, so this line is whole
    assert {r["line_id"]: r["reason"] for r in export_lines.failed_lines(df).collect()} == want
    loaded = {r["line_id"]: r for r in export_lines.loaded_lines(df).collect()}
    assert set(loaded) == {i for i, (_, r) in enumerate(LINES) if r is None} | {25}
    assert loaded[0]["pos"] == 122 and loaded[0]["strand"] == 0 and loaded[21]["chrom"] is None
    assert export_lines.failed_lines(df.limit(0)).count() == 0 and export_lines.loaded_lines(df.limit(0)).count() == 0


def test_tracks(spark):
    tags = [("c", p, 0) for p in (0, 90, 150, 70, 80, 85, 85, 85, 85)] + [("c", p, 1) for p in (90, 150, 70, 80, 80, 80, 85, 90)]
    df = spark.createDataFrame(tags, "chrom string, pos int, strand int")
    assert [tracks.limit_duplicates(df, ["chrom", "pos", "strand"], k).count() for k in (3, 2, 1)] == [16, 14, 11]  # of FIXTURES F1
    assert tracks.sample(df, ["chrom", "strand"], 0.5).count() == 8
    assert sorted(map(tuple, tracks.sample(df, ["chrom"], 0.5).collect())) == sorted(map(tuple, tracks.sample(df, ["chrom"], 0.5).collect()))


@pytest.mark.parametrize("size", [4, 1 << 12])
def test_overlaps_brute_force(spark, size):
    """Intervals of all lengths, one location that most rows share, nulls and empty intervals."""
    rng = random.Random(size)
    draw = lambda: (lambda s: (rng.choice(["a", "b"]), s, s + rng.choice([1, 2, 5, 40, 700, 9000])))(rng.randrange(3000))
    left = [draw() for _ in range(60)] + [("a", 500, 520)] * 150 + [(None, 1, 5), ("a", None, 5), ("a", 9, 9)]
    right = [draw() for _ in range(40)] + [("b", None, 9), (None, 1, 2), ("a", 7, 3)]
    a = spark.createDataFrame([(i, *x, "c") for i, x in enumerate(left)], "i int, chrom string, l int, r int, start string")
    b = spark.createDataFrame([(i, *x) for i, x in enumerate(right)], "j int, chrom string, start int, end int")
    ok = lambda x: None not in x and x[2] > x[1]
    want = sorted((i, j) for i, x in enumerate(left) for j, y in enumerate(right) if ok(x) and ok(y) and x[0] == y[0] and x[1] < y[2] and x[2] > y[1])
    assert sorted((r["i"], r["b_j"]) for r in intervals.overlap_join(a, b, size=size).collect()) == want
    hit = {i for i, _ in want}
    assert sorted(r["i"] for r in intervals.within(a, b, "l", "r", 16).collect()) == sorted(hit)
    assert sorted(r["i"] for r in intervals.exclude(a, b, "l", "r", 16).collect()) == sorted(set(range(len(left))) - hit)
    assert {r["i"] for r in intervals.flag_overlap(a, b, "l", "r").where("overlaps").collect()} == hit
    for x, y in ((a.limit(0), b), (a, b.limit(0))):
        assert intervals.overlap_join(x, y).count() == 0 and intervals.within(x, y, "l", "r").count() == 0
