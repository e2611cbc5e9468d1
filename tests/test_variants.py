import math
import random
import re

import pytest
from pyspark.sql import functions as F

from tidemark.operators import variants as V
from tidemark.plans import commands
from tidemark.sources import sinks


def read_bases(at, cigar_text, seq, qual, md):
    """By hand: (position, allele, reference base, quality, at the read's end) for every reference base the read covers."""
    cigar = [(int(n), o) for n, o in re.findall(r"(\d+)([MIDNSHP=X])", cigar_text)]
    ref = V.reference_bases(seq, cigar, md)
    out, p, q, r = [], at, 0, 0
    for n, op in cigar:
        if op in "M=X":
            out += [[p + k, seq[q + k], ref[r + k], qual[q + k]] for k in range(n)]
            p, q, r = p + n, q + n, r + n
        elif op == "D":
            out += [[p + k, "*", ref[r + k], qual[min(q, len(qual) - 1)]] for k in range(n)]
            p, r = p + n, r + n
        elif op == "N":
            p += n
        elif op == "I":
            if out:
                out[-1][1] += seq[q : q + n]
            q += n
        elif op == "S":
            q += n
    return [(*x, i in (0, len(out) - 1)) for i, x in enumerate(out)]


def test_reference_and_bases():
    cigar = [(2, "S"), (4, "M"), (1, "I"), (3, "M"), (2, "D"), (2, "M")]
    seq = "NNACGTGTTACC"
    assert V.reference_bases(seq, cigar, "1A5^GG2") == "AAGTTTAGGCC"
    got = read_bases(100, "2S4M1I3M2D2M", seq, bytes([30] * 12), "1A5^GG2")
    assert got[1][:3] == (101, "C", "A") and got[3][1] == "TG" and got[7][1] == "*" and len(got) == 11


def test_bases_of_a_batch():
    rng = random.Random(4)
    reads = []
    for _ in range(200):
        ops, md, size, aligned, run = [], "", 0, 0, 0
        shape = [("S", 2)] * rng.randrange(2) + [("M", rng.randrange(1, 6))] + [(rng.choice("IDN"), rng.randrange(1, 4)) for _ in range(rng.randrange(2))]
        shape += [("M", rng.randrange(1, 6))] * (shape[-1][0] != "M") + [("D", 1), ("M", 1)] * rng.randrange(2) + [("S", 1)] * rng.randrange(2)
        for o, n in shape:
            ops.append(f"{n}{o}")
            size += n * (o in "MIS")
            if o == "M":
                for _ in range(n):
                    if rng.random() < 0.3:
                        md, run = md + f"{run}" + rng.choice("ACGT"), 0
                    else:
                        run += 1
            if o == "D":
                md, run = md + f"{run}^" + "".join(rng.choice("ACGT") for _ in range(n)), 0
        reads.append((rng.randrange(1000), "".join(ops), "".join(rng.choice("ACGT") for _ in range(size)), bytes(rng.randrange(2, 41) for _ in range(size)), md + f"{run}"))
    got = V.batch_bases(*map(list, zip(*reads)))
    rows = list(zip(*(got[k].tolist() for k in ("read", "pos", "allele", "ref", "bq", "tip"))))
    assert rows == [(i, *x) for i, r in enumerate(reads) for x in read_bases(*r)]
    assert len(V.batch_bases([], [], [], [], [])["pos"]) == 0


def test_outliers_and_strands(spark):
    reads = [("a", f"{k % 3}S10M", "10") for k in range(99)] + [("a", "10M", "2A3^ACGT5")] + [("b", "10M", None)]
    df = spark.createDataFrame(reads, "k string, cigar string, md string")
    assert {(r["k"], r["e"]) for r in df.select("k", V.n_edits(F.col("cigar"), F.col("md")).alias("e")).collect()} == {("a", 0), ("a", 1), ("a", 2), ("a", 5), ("b", None)}
    assert V.without_outliers(df, ["k"]).groupBy("k").count().orderBy("k").collect()[0]["count"] == 99
    assert V.without_outliers(df, ["k"], 50).where("k = 'a'").count() == 66
    assert V.strand_bias(1, 12, 12, 1) and not V.strand_bias(6, 12, 6, 1) and not V.strand_bias(0, 0, 5, 5) and not V.strand_bias(12, 12, 1, 1)


def test_indels_are_joined(spark):
    cols = "chrom string, pos long, ref string, alt string, gt string"
    rows = [("c", 10, "A", "*", "1/1"), ("c", 11, "C", "*", "0/1"), ("c", 12, "G", "*", "1/1"), ("c", 20, "A", "AT", "0/1"), ("c", 21, "G", "*", "0/1"), ("c", 30, "A", "T", "1/1"), ("c", 31, "C", "*", "0/1"), ("c", 40, "T", "TT", "1/1"), ("c", 0, "G", "*", "1/1")]
    piles = spark.createDataFrame([("c", 9, "T"), ("c", 20, "A"), ("c", 30, "A"), ("c", 9, "T")], "chrom string, pos long, ref string")
    got = sorted(tuple(r)[1:] for r in V.fix_indels(spark.createDataFrame(rows, cols), piles).collect())
    assert got == [(0, "G", "*", "1/1"), (9, "TACG", "T", "1/1"), (30, "A", "T", "1/1"), (31, "C", "*", "0/1"), (40, "T", "TT", "1/1")]


def test_genotypes(spark):
    reads = []
    for i in range(40):
        base = "T" if i < 20 else "A"
        seq = "ACGT" + base + "C" + "GGTT"
        md = "4A0G4" if base == "T" else "5G4"
        reads.append(("chr1", 100, "10M", seq, bytes([35] * 10), md, 16 * (i % 2)))
    reads.append(("chr1", 100, "10M", "ACGTAGGGTT", bytes([35] * 10), None, 0))
    df = spark.createDataFrame(reads, "chrom string, pos int, cigar string, seq string, qual binary, md string, flag int")
    calls = {r["pos"]: r for r in V.call_variants(V.pile(V.bases(df))).collect()}
    assert set(calls) == {104, 105}
    assert calls[104]["gt"] == "0/1" and calls[104]["alt"] == "T" and calls[105]["gt"] == "1/1" and calls[105]["alt"] == "C"
    assert V.call_variants(V.pile(V.bases(df.limit(0)))).count() == 0


def test_genotype_takes_the_best_of_all_counts():
    rng = random.Random(9)
    for n in [1, 2, 3, 30, 201, 202, 450, 3000, *(rng.randrange(2, 1200) for _ in range(25))]:
        n2 = rng.randrange(0, n // 2 + 1) if rng.random() < 0.5 else min(n // 2, rng.randrange(0, 8))
        split = rng.randrange(0, n - n2 + 1)
        q1, q2 = [(rng.choice([2, 5, 21, 35]), n - n2 - split), (40, split)], [(rng.choice([2, 21, 30, 37]), n2)] * (n2 > 0)
        ks = range(1, max(1, n - 1) + 1)
        ll = [float(V.log_likelihood(q1, q2, x / n)) for x in ks]
        binom = [math.lgamma(n + 1) - math.lgamma(x + 1) - math.lgamma(n - x + 1) for x in ks]
        got = V.genotype(q1, q2)
        assert got["hetero"][0] == pytest.approx(max(a + b + n * math.log(0.5) for a, b in zip(ll, binom)), abs=1e-6)
        assert got["biased"][0] == pytest.approx(max(a + b + x * math.log(x / n) + (n - x) * math.log(max(1 - x / n, 1e-300)) for a, b, x in zip(ll, binom, ks)), abs=1e-6)


def test_rare_allele_of_a_deep_site(spark):
    pile = [("chr1", 7, "A", "A", 99_800, 50_000, 0, [(30, 99_800)]), ("chr1", 7, "A", "T", 200, 100, 0, [(30, 200)])]
    df = spark.createDataFrame(pile, "chrom string, pos long, ref string, allele string, n long, n_plus long, n_tip long, quals array<struct<bq:int,c:long>>")
    got = V.call_variants(df).collect()
    m = V.genotype([(30, 99_800)], [(30, 200)])
    assert m["biased"][0] > m["major"][0] + 10
    assert [(r["alt"], r["gt"], r["model"]) for r in got] == [("T", "0/1", "biased")]


def test_callvar_and_vcf(spark, tmp_path):
    """Reads over two regions: a balanced substitution, a homozygous one and a deletion of two bases; repeats and bad reads fall away."""
    ref = "ACGTACGTTGCAACGTAGCTAGCTTACGATCG"
    rows = []
    for i in range(40):
        start = i % 6
        seq = list(ref[start : start + 24])
        if i % 2:
            seq[12 - start] = "G" if ref[12] != "G" else "T"
        seq[15 - start] = "C" if ref[15] != "C" else "A"
        cut = seq[: 18 - start] + seq[20 - start :]
        body, own = ref[start : start + 24], ""
        run = 0
        for k, (a, b) in enumerate(zip(seq, body)):
            if k == 18 - start:
                own, run = own + f"{run}^{body[k : k + 2]}", 0
            if k in (18 - start, 19 - start):
                continue
            if a == b:
                run += 1
            else:
                own, run = own + f"{run}{b}", 0
        rows.append((f"r{i}", "c", 100 + start, 16 * ((i // 2) % 2), f"{18 - start}M2D{4 + start}M", "".join(cut), bytes([35] * len(cut)), own + str(run)))
    rows.append(("bad", "c", 100, 4, "10M", ref[:10], bytes([35] * 10), "10"))
    cols = "name string, chrom string, pos int, flag int, cigar string, seq string, qual binary, md string"
    reads = spark.createDataFrame(rows, cols)
    regions = spark.createDataFrame([("c", 90, 117), ("c", 116, 140), ("d", 1, 9)], "chrom string, start long, end long")
    out = commands.callvar(reads, regions, control=reads.where("name in ('r1', 'r2')"), max_duplicates=99, outliers=0)
    got = {r["pos"]: r for r in out.collect()}
    assert set(got) == {112, 115, 117} and got[112]["gt"] == "0/1" and got[115]["gt"] == "1/1"
    assert (got[117]["ref"], got[117]["alt"], got[117]["mutation"]) == (ref[17:20], ref[17], "Deletion")
    assert got[115]["depth"] == 42 and got[115]["depth_ctrl"] == 2 and got[115]["pl"][2] == 0 and got[112]["pl"][1] == 0
    lines = [r["value"].split("\t") for r in sinks.variant_vcf(out).collect()]
    assert [x[1] for x in lines] == ["113", "116", "118"] and all(len(x) == 10 for x in lines)
    assert "DPT=40;DPC=2" in lines[1][7] and lines[1][8] == "GT:DP:GQ:PL" and lines[1][9].startswith("1/1:42:")
    head = sinks.vcf_header({"c": 1000})
    assert head[0] == "##fileformat=VCFv4.1" and head[-1].startswith("#CHROM") and "##contig=<ID=c,length=1000,assembly=NA>" in head
    assert commands.callvar(reads, regions).count() <= 3 and commands.callvar(reads.limit(0), regions).count() == 0


def test_fastq(spark):
    df = spark.createDataFrame([("a", 0, "ACG", bytes([0, 10, 40])), ("b", 16, "ACG", bytes([0, 10, 40]))], "name string, flag int, seq string, qual binary")
    assert [r["value"] for r in sinks.fastq(df).collect()] == ["@a\nACG\n+\n!+I", "@b\nCGT\n+\nI+!"]
