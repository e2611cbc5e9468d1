"""Readers, sinks, the BAM source, models, shapes and streaming on small inputs."""

import gzip
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import models, shapes
from tidemark.plans import commands
from tidemark.sources import bam, sinks, text
from tidemark.streaming import islands


def put(path, body):
    path.write_text(body)
    return str(path)


def test_text_readers(spark, tmp_path, rows):
    bed = put(tmp_path / "a.bed", "track x\n#c\nchr1\t10\t60\tn\t0\t+\nchr1\t20\t70\tn\t0\t-\r\n\n")
    assert text.sniff(spark, bed) == "BED" and rows(text.read_tags(spark, bed)) == [("chr1", 10, 0), ("chr1", 70, 1)]
    with pytest.raises(Exception, match="strand"):
        text.read_bed(spark, put(tmp_path / "b.bed", "chr1\t1\t2\tn\t0\tx\n")).collect()
    (tmp_path / "f.tsv.gz").write_bytes(gzip.compress(b"chr1\t1\t9\tAA\t70000\nchr1\t3\t5\tBB\t2\n"))
    assert rows(text.read_frag(spark, str(tmp_path / "f.tsv.gz"))) == [("chr1", 1, 9, "AA", 65535), ("chr1", 3, 5, "BB", 2)]
    sam = put(tmp_path / "a.sam", "@HD\tVN:1\nr1\t0\tchr1.fa\t11\t9\t5M2I5M\t*\t0\t0\tA\tI\nr2\t16\tchr1\t11\t9\t5M2D5M3S\t*\t0\t0\tA\tI\nr3\t4\t*\t0\t0\t*\t*\t0\t0\tA\tI\nr4\t131\tchr1\t5\t9\t5M\t=\t5\t9\tA\tI\n")
    assert text.sniff(spark, sam) == "SAM" and rows(text.read_sam(spark, sam)) == [("chr1", 10, 0), ("chr1", 22, 1)]
    bdg = put(tmp_path / "a.bdg", "track type=bedGraph\nbrowser x\nchr1\t10\t20\t1.50\nchr1\t20\t30\t0.40\nchr2\t0\t5\t-2.0\n")
    assert rows(text.read_bedgraph(spark, bdg, -1)) == [("chr1", 0, 10, -1.0), ("chr1", 10, 20, 1.5), ("chr1", 20, 30, 0.4), ("chr2", 0, 5, -2.0)]
    multi = put(tmp_path / "m.txt", ">r\tACGT\t1:0:0\tchr1.fa:101F0\n>r\tACGT\t1:1:0\tx\n")
    assert rows(text.read_eland_multi(spark, multi)) == [("chr1", 100, 0)]


def test_sinks(spark, rows):
    p = spark.createDataFrame([("c", 10, 50, 30, 5.128, 4.0, 63.2725, 3.5), ("c", 10, 50, 20, 5.1, 4.0, 7.0, 3.5), ("b", 5, 9, None, 1.0, 1.0, 1e-7, 1234567.0)], "chrom string, start long, end long, summit long, qscore double, pileup double, pscore double, fc double")
    lines = [r["value"] for r in sinks.narrow_peak(sinks.named(p, "x_")).collect()]
    assert lines == ["b\t5\t9\tx_1\t10\t.\t1.23457e+06\t1e-07\t1\t-1", "c\t10\t50\tx_2a\t51\t.\t3.5\t7\t5.1\t10", "c\t10\t50\tx_2b\t51\t.\t3.5\t63.2725\t5.128\t20"]
    assert [r["value"] for r in sinks.bedgraph(spark.createDataFrame([("c", 0, 5, 1.5)], "chrom string, start long, end long, value double")).collect()] == ["c\t0\t5\t1.50000"]


def test_gzip_lines(spark, tmp_path):
    lines = spark.createDataFrame([("c\t1\t9",), ("c\t2\t8",)], "value string").coalesce(1)
    sinks.write(lines, str(tmp_path / "z"), ["track"], single=True, compression="gzip")
    (part,) = (tmp_path / "z").glob("*.gz")
    assert gzip.decompress(part.read_bytes()) == b"track\nc\t1\t9\nc\t2\t8\n" and text.read_bedpe(spark, str(tmp_path / "z")).count() == 2


def test_track_sinks(spark):
    cells = spark.createDataFrame([("c", 0, 5, 1.0, 2.0), ("c", 5, 9, 1.0 + 5e-6, 2.5), ("c", 9, 12, 3.0, 2.5)], "chrom string, start long, end long, treat double, ctrl double")
    lines = lambda df: [r["value"] for r in df.collect()]
    assert lines(sinks.track_bedgraph(cells, "treat")) == ["c\t0\t9\t1.00000", "c\t9\t12\t3.00000"]
    pair = sinks.pair_bedgraphs(cells, 2e6)
    assert lines(pair["ctrl"]) == ["c\t0\t5\t1.00000", "c\t5\t12\t1.25000"] and lines(pair["treat"])[1] == "c\t9\t12\t1.50000"
    diff = cells.select("chrom", "start", "end", F.col("treat").alias("llr1"), F.col("ctrl").alias("llr2"), F.lit(-1.0).alias("llr12"))
    assert lines(sinks.condition_matrix(diff))[0] == "c:0_5\t1.00000\t2.00000\t-1.00000" and len(lines(sinks.condition_bedgraph(diff, "llr12"))) == 1
    post = spark.createDataFrame([("c", 30, 0.8, 0.1, 0.1), ("c", 40, 0.8, 0.1, 0.1), ("c", 60, 0.1, 0.8, 0.1)], "chrom string, bin_end long, p_open double, p_nuc double, p_bg double")
    assert lines(sinks.likelihood_bedgraphs(post)["bg"]) == ["c\t0\t20\t1.00000", "c\t20\t40\t0.10000", "c\t40\t50\t1.00000", "c\t50\t60\t0.10000"]
    runs = spark.createDataFrame([("c", 0, 20, "bg"), ("c", 20, 40, "open")], "chrom string, start long, end long, state string")
    assert lines(sinks.state_bed(runs)) == ["c\t20\t40\topen"]
    table = spark.createDataFrame([(1.0, 3, 30, 10.0, 0.5), (2.0, 1, 9, 9.0, 1.5)], "cutoff double, npeaks long, lpeaks long, avelpeak double, qscore double")
    assert lines(sinks.cutoff_lines(table)) == ["2.00\t1.50\t1\t9\t9.00", "1.00\t0.50\t3\t30\t10.00"] and lines(sinks.cutoff_lines(table.drop("qscore")))[0] == "2.00\t1\t9\t9.00"


def test_normalization_is_consistent():
    from tidemark.functions import scores, stats

    for a in "TCMN":
        for b in "TCMN":
            one, two = scores.normalization(a, 10, 4), scores.normalization(b, 10, 4, a)
            assert [x * y for x, y in zip(one, two)] == pytest.approx(scores.normalization(b, 10, 4))
    assert scores.normalization("T", 10, 4, "C") == pytest.approx((2.5, 2.5)) and scores.normalization("M", 10, 4, "T") == pytest.approx((0.1, 0.1))
    assert stats.poisson_sf_inv(0.05, 10.0) == 15 and stats.poisson_sf_inv(0.05, 10.0, 9) == 9 and stats.poisson_cdf_inv(0.95, 10.0) == 15


def block(data):
    c = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = c.compress(data) + c.flush()
    return b"\x1f\x8b\x08\x04" + b"\0" * 4 + b"\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(data), len(data))


def test_bam_source_splits(spark, tmp_path):
    rng = random.Random(8)
    head = b"BAM\1" + struct.pack("<i", 0) + struct.pack("<i", 1) + struct.pack("<i", 5) + b"chr1\0" + struct.pack("<i", 10**6)
    recs, want = b"", []
    for i in range(4000):
        pos, flag = rng.randrange(10**5), rng.choice([0, 16, 4])
        name, seq = f"read{i}".encode() + b"\0", rng.randbytes(10)
        body = struct.pack("<iiBBHHHiiii", 0, pos, len(name), 30, 0, 1, flag, 20, -1, -1, 0) + name + struct.pack("<I", 20 << 4) + seq + b"\x20" * 20 + b"MDZ20\0"
        recs += struct.pack("<i", len(body)) + body
        want.append((f"read{i}", flag, pos))
    data = head + recs
    (tmp_path / "x.bam").write_bytes(b"".join(block(data[k : k + 3000]) for k in range(0, len(data), 3000)) + block(b""))
    bam.register(spark)
    for step in (64 << 20, 20000, 7001):
        df = spark.read.format("bam").option("split_bytes", step).load(str(tmp_path / "x.bam"))
        got = [(r["name"], r["flag"], r["pos"]) for r in df.select("name", "flag", "pos", "md").collect()]
        assert sorted(got) == sorted(want)
    assert text.sniff(spark, str(tmp_path / "x.bam")) == "BAM" and text.read_tags(spark, str(tmp_path / "x.bam")).count() == bam.tags(df).count() and text.tag_size(spark, str(tmp_path / "x.bam")) == 20
    first = df.where("name = 'read0'").first()
    assert first["cigar"] == "20M" and first["md"] == "20" and len(first["seq"]) == 20
    assert bam.tags(df).count() == sum(f != 4 for _, f, _ in want)


def test_state_model_and_mixture(spark):
    rng = np.random.default_rng(1)
    level = {"bg": 1, "nuc": 8, "open": 25}
    path = (["bg"] * 20 + ["nuc"] * 8 + ["open"] * 6 + ["nuc"] * 8 + ["bg"] * 20) * 4
    x = rng.normal([[level[s]] * 4 for s in path], 0.7)
    m = models.StateModel.load(models.train_states(x, [len(x)]).dump())
    post, _, _ = m.forward_backward(x)
    names = {k: n for n, k in m.labels().items()}
    assert np.mean([names[k] == s for k, s in zip(post.argmax(1), path)]) > 0.98
    bins = spark.createDataFrame([("c", 0, 10 * len(x), 10 * (i + 1), *map(float, r)) for i, r in enumerate(x)], "chrom string, start long, end long, bin_end long, short double, mono double, di double, tri double")
    runs = models.state_runs(models.decode_states(bins, m))
    assert models.accessible(runs, 100).count() == 4
    lens = [int(v) for mu in (200, 400, 600) for v in rng.normal(mu, 20, 300)]
    frags = spark.createDataFrame([("c", i, i + n) for i, n in enumerate(lens)], "chrom string, l int, r int")
    means, _ = models.mixture(frags, (50, 180, 380, 580), share=1.0)
    assert [round(v, -1) for v in means[1:]] == [200, 400, 600]


@pytest.mark.parametrize("kind", ["poisson", "gaussian"])
def test_states_of_cut_regions(spark, kind):
    """Chunks give the posteriors of the whole sequence: regions shorter and longer than a chunk, of one bin, on both sides of its edges."""
    rng = np.random.default_rng(3)
    means = np.array([[9.0, 3, 2, 1], [4, 6, 2, 1], [0.5, 0.5, 0.5, 0.5]])
    m = models.StateModel(kind, [0.2, 0.3, 0.5], [[0.9, 0.08, 0.02], [0.05, 0.9, 0.05], [0.01, 0.04, 0.95]], means, None if kind == "poisson" else np.array([np.eye(4) * 4] * 3))
    rows, want = [], {}
    for r, n in enumerate((1, 6, 7, 8, 14, 15, 100)):
        x = rng.poisson(means[rng.integers(3, size=n)]).astype(float)
        post, _, _ = m.forward_backward(x)
        start = 1000 * r + 7
        rows += [("c", start, start + 10 * n, start + 10 * (i + 1), *map(float, v)) for i, v in enumerate(x)]
        want |= {start + 10 * (i + 1): [p[m.labels()[s]] for s in ("open", "nuc", "bg")] for i, p in enumerate(post)}
    bins = spark.createDataFrame(rows, "chrom string, start long, end long, bin_end long, short double, mono double, di double, tri double")
    got = models.decode_states(bins, m, 7).collect()
    assert len(got) == len(want)
    for g in got:
        assert [g["p_open"], g["p_nuc"], g["p_bg"]] == pytest.approx(want[g["bin_end"]], abs=1e-9)
    assert models.decode_states(bins.limit(0), m).count() == 0


def test_shapes(spark):
    xs = np.arange(600)
    y = 100 * np.exp(-((xs - 200) ** 2) / 5000) + 80 * np.exp(-((xs - 420) ** 2) / 5000)
    signal = spark.createDataFrame([("c", int(i), int(i) + 1, float(v)) for i, v in zip(xs, y)], "chrom string, start long, end long, value double")
    region = spark.createDataFrame([("c", 20, 580)], "chrom string, start long, end long")
    tops = [r["summit"] for r in shapes.subpeaks(signal, region, 60).orderBy("summit").collect()]
    assert len(tops) == 2 and abs(tops[0] - 200) <= 2 and abs(tops[1] - 420) <= 2
    two = y[20:580]
    assert shapes.tops(two, 61, 20).tolist() == [k - 20 for k in tops] and shapes.tops(np.zeros(300), 61, 20).tolist() == []
    bumps = np.array([0, 5, 4.9, 6, 1, 3, 2.9, 0.0])
    assert shapes.valleys(bumps, [1, 3, 5]).tolist() == [3, 5] and shapes.valleys(bumps, [1, 3], 0.99).tolist() == [1, 3]
    low = np.concatenate([np.linspace(0, 9, 40), np.linspace(9, 4, 60), np.linspace(4, 9, 60), np.linspace(9, 0, 60)])
    assert shapes.peaky(low, np.array([40, 160])).tolist() == [160]  # the bar of the first is 6 + sqrt(6), the last clears 6
    tags = spark.createDataFrame([("c", 480 + i % 9, 0) for i in range(40)] + [("c", 520 + i % 9, 1) for i in range(40)], "chrom string, pos int, strand int")
    named = spark.createDataFrame([("c", 450, 560, "p1")], "chrom string, start long, end long, name string")
    got = shapes.refine_by_balance(tags, named, 50, 5.0).first()
    assert got["name"] == "p1_R" and 488 < got["summit"] <= 521


def test_callpeak_finds_planted_regions(spark):
    rng = random.Random(9)
    pos = [rng.randrange(50000) for _ in range(1500)] + [rng.randrange(20000, 20300) for _ in range(400)]
    treat = spark.createDataFrame([("c", p, p + 150) for p in pos], "chrom string, l int, r int")
    ctrl = spark.createDataFrame([("c", p, p + 150) for p in (rng.randrange(50000) for _ in range(1500))], "chrom string, l int, r int")
    out = commands.callpeak(treat, ctrl, genome=50000, q=0.01, keep_dup="all", max_gap=50)
    best = out["peaks"].orderBy(F.col("qscore").desc()).first()
    assert 19800 < best["start"] < 20300 < best["end"] + 300 and best["fc"] > 3
    alone = commands.callpeak(treat, genome=50000, q=0.01, keep_dup="all", max_gap=50, broad=True)["peaks"].orderBy(F.col("qscore").desc()).first()
    assert alone["start"] < 20300 and alone["end"] > 20000


def test_fragment_size(spark):
    rng = random.Random(10)
    tags = []
    for c in range(1000, 300000, 1500):
        tags += [("c", c - 60 + rng.randrange(-8, 8), 0) for _ in range(12)] + [("c", c + 60 + rng.randrange(-8, 8), 1) for _ in range(12)]
    df = spark.createDataFrame(tags, "chrom string, pos int, strand int")
    got = models.strand_model(df, 3_000_000, bandwidth=150, mfold=(2, 100), least_pairs=50)
    assert abs(got["d"] - 120) <= 10
    curves = models.model_table(spark, got)
    assert curves.where("curve = 'correlation'").orderBy(F.col("value").desc()).first()["offset"] == got["d"]
    assert curves.where("curve = 'plus'").agg(F.min("offset"), F.max("offset")).first()[:] == (-305, 305)


def test_interval_stream(spark, tmp_path):
    src = tmp_path / "in"
    rows = [("a", "2025-01-01 00:00:00", "2025-01-01 00:01:00"), ("a", "2025-01-01 00:00:30", "2025-01-01 00:02:00"), ("a", "2025-01-01 00:05:00", "2025-01-01 00:06:00")]
    late = [("a", "2025-01-02 00:00:00", "2025-01-02 00:01:00")]
    for part in (rows, late, [("a", "2025-01-03 00:00:00", "2025-01-03 00:01:00")]):
        spark.createDataFrame(part, "k string, s string, e string").selectExpr("k", "cast(s as timestamp) s", "cast(e as timestamp) e").coalesce(1).write.mode("append").parquet(str(src))
    stream = spark.readStream.schema("k string, s timestamp, e timestamp").option("maxFilesPerTrigger", 1).parquet(str(src))
    q = islands.interval_islands(stream, "k", "s", "e", 30).writeStream.format("memory").queryName("isles").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = sorted((str(r["start"]), str(r["end"]), r["n"]) for r in spark.table("isles").collect())
    assert got[:2] == [("2025-01-01 00:00:00", "2025-01-01 00:02:00", 2), ("2025-01-01 00:05:00", "2025-01-01 00:06:00", 1)]
