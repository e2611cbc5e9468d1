"""Alleles per reference position and genotypes by model selection, without assembly.

The models follow the published meaning (homozygous, heterozygous, heterozygous with allele bias; lowest BIC by a margin
of 2), in a formulation of our own: the share of the first allele is taken at its best over all counts at every depth, with a binomial
term for its balance. Borderline sites may come out differently than elsewhere.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import stats
from tidemark.operators.ordered import islands

BASES = "chrom string, pos long, allele string, ref string, bq int, strand int, tip boolean, ctrl boolean"


def n_edits(cigar: Column, md: Column) -> Column:
    """Bases by which a read differs from its reference: inserted, clipped, deleted and substituted ones."""
    added = F.aggregate(F.regexp_extract_all(cigar, F.lit("(\\d+)[IS]"), 1), F.lit(0), lambda a, x: a + x.cast("int"))
    return added + F.length(F.regexp_replace(md, "[^A-Z]", ""))


def without_outliers(reads: DataFrame, keys: list[str], percent: int = 5) -> DataFrame:
    """The reads of each group without those of the most edits: at most as many edits as the one at ``1 - percent / 100`` of the sorted group.

    Reads fold to counts per number of edits, so no group is sorted. Null keys form a group; reads without MD or CIGAR have no edits.
    """
    rows = reads.withColumn("_e", F.coalesce(n_edits(F.col("cigar"), F.col("md")), F.lit(0)))
    hist = rows.groupBy(*keys, "_e").agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*keys)
    upto, total = F.sum("_n").over(w.orderBy("_e")), F.sum("_n").over(w)
    most = hist.withColumn("_ok", upto > F.least(F.floor(total * (1 - percent * 0.01)), total - 1)).where("_ok").groupBy(*keys).agg(F.min("_e").alias("_most"))
    named = most.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), "_most")
    on = F.col("_e") <= F.col("_most")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return rows.join(named, on, "left_semi").drop("_e")


def limit_alignments(reads: DataFrame, keys: list[str], most: int) -> DataFrame:
    """At most ``most`` reads of the same start and strand, by name."""
    same = Window.partitionBy(*keys, "chrom", "pos", F.col("flag").bitwiseAND(16)).orderBy("name", "flag", "cigar", "seq")
    return reads.withColumn("_i", F.row_number().over(same)).where(F.col("_i") <= most).drop("_i")


def reference_bases(seq: str, cigar: list[tuple[int, str]], md: str) -> str:
    """The reference under a read, from its sequence, CIGAR and MD text (deleted bases included, clips and insertions not)."""
    own, p = [], 0
    for n, op in cigar:
        if op in "M=X":
            own += seq[p : p + n]
        if op in "M=XIS":
            p += n
    out, at = [], 0
    for num, dele, sub in re.findall(r"(\d+)|\^([A-Z]+)|([A-Z])", md):
        if num:
            out += own[at : at + int(num)]
            at += int(num)
        elif dele:
            out += dele
        else:
            out.append(sub)
            at += 1
    return "".join(out)


_OPS = re.compile(r"(\d+)([MIDNSHP=X])")
_MD = re.compile(r"(\d+)|\^([A-Z]+)|([A-Z])")


def _expand(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for every run."""
    return np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())


def batch_bases(pos: list[int], cigar: list[str], seq: list[str], qual: list[bytes], md: list[str]) -> dict[str, np.ndarray]:
    """``read, pos, allele, ref, bq, tip`` of every reference base that the reads of a batch cover, in order.

    A deleted base is ``*`` with the quality of the base after it; inserted bases follow the base before them. Operations
    are parsed read by read, bases are arrays over the batch.
    """
    ops = []  # read, kind, size, reference start, query start in the batch
    patches, gone = [], []  # substituted: (read's aligned base, letter); deleted letters, in order
    at, aligned = 0, 0
    for r, (p, c, s, m) in enumerate(zip(pos, cigar, seq, md)):
        q, a0 = at, aligned
        for n, o in _OPS.findall(c):
            n = int(n)
            if o in "M=XDIN":
                ops.append((r, 2 if o == "D" else 1 if o == "I" else 3 if o == "N" else 0, n, p, q))
            p += n * (o in "M=XDN")
            q += n * (o in "M=XIS")
            aligned += n * (o in "M=X")
        k = a0
        for num, dele, sub in _MD.findall(m):
            if num:
                k += int(num)
            elif dele:
                gone.append(dele)
            else:
                patches.append((k, sub))
                k += 1
        at += len(s)
    letters = np.frombuffer("".join(seq).encode(), "S1").astype("U1")
    quals = np.frombuffer(b"".join(bytes(x) for x in qual), np.uint8)
    if not ops or not len(letters):
        return {k: np.zeros(0, int) for k in ("read", "pos", "allele", "ref", "bq", "tip")}
    read, kind, size, start, query = np.array(ops).T
    held = (kind == 0) | (kind == 2)
    n = np.where(held, size, 0)
    row = np.repeat(np.arange(len(n)), n)
    dele = kind[row] == 2
    where, spot = _expand(start, n), _expand(query, n)
    spot = np.where(dele, query[row], spot)
    ends = np.cumsum([len(x) for x in seq])[read[row]] - 1
    spot = np.minimum(spot, ends)
    allele = np.where(dele, "*", letters[spot]).astype(object)
    ref = letters[spot].astype(object)
    if patches:
        here = np.flatnonzero(~dele)
        k, letter = zip(*((k, x) for k, x in patches if k < len(here)))
        ref[here[list(k)]] = letter
    if gone:
        own = np.array(list("".join(gone)), object)
        ref[np.flatnonzero(dele)[: len(own)]] = own[: int(dele.sum())]
    first = np.cumsum(n) - n
    for k in np.flatnonzero(kind == 1):  # insertions are rare
        if first[k] > 0 and read[row[first[k] - 1]] == read[k]:
            allele[first[k] - 1] += "".join(letters[query[k] : query[k] + size[k]])
    owner = read[row]
    tip = np.r_[True, owner[1:] != owner[:-1]] | np.r_[owner[1:] != owner[:-1], True]
    return {"read": owner, "pos": where, "allele": allele, "ref": ref, "bq": quals[spot], "tip": tip}


def bases(reads: DataFrame, min_quality: int = 20) -> DataFrame:
    """One row per read base of quality above ``min_quality``; reads without MD, CIGAR or sequence are left out.

    ``reads`` is (chrom, pos, cigar, seq, qual, md, flag) and may have ``ctrl``, true for the reads of a control.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            b = batch_bases(*(pdf[c].tolist() for c in ("pos", "cigar", "seq", "qual", "md")))
            good = np.flatnonzero(b["bq"] > min_quality)
            r = b["read"][good]
            mine = {"chrom": pdf["chrom"].to_numpy()[r], "strand": (pdf["flag"].to_numpy()[r] & 16 > 0).astype(int), "ctrl": pdf["ctrl"].to_numpy()[r]}
            yield pd.DataFrame({k: mine[k] if k in mine else b[k][good] for k in ("chrom", "pos", "allele", "ref", "bq", "strand", "tip", "ctrl")})

    ok = reads.where("chrom is not null and pos is not null and md is not null and cigar <> '*' and cigar <> '' and length(seq) > 0 and length(seq) = length(qual)")
    ctrl = F.coalesce(F.col("ctrl"), F.lit(False)) if "ctrl" in reads.columns else F.lit(False)
    return ok.select("chrom", "pos", "cigar", "seq", "qual", "md", F.coalesce("flag", F.lit(0)).alias("flag"), ctrl.alias("ctrl")).mapInPandas(run, BASES)


def pile(rows: DataFrame) -> DataFrame:
    """``(chrom, pos, ref, allele, n, n_ctrl, n_plus, n_tip, quals)``: qualities as (quality, count) pairs, so depth does not grow a row."""
    sums = lambda c: F.sum(F.col(c).cast("long"))
    by_quality = rows.groupBy("chrom", "pos", "ref", "allele", "bq").agg(F.count("*").alias("n"), sums("ctrl").alias("x"), F.sum(1 - F.col("strand")).alias("p"), sums("tip").alias("t"))
    quals = F.sort_array(F.collect_list(F.struct("bq", F.col("n").alias("c"))))
    return by_quality.groupBy("chrom", "pos", "ref", "allele").agg(F.sum("n").alias("n"), F.sum("x").alias("n_ctrl"), F.sum("p").alias("n_plus"), F.sum("t").alias("n_tip"), quals.alias("quals"))


def top_alleles(piles: DataFrame) -> DataFrame:
    """The two deepest alleles of each position, of equal depths the reference first."""
    w = Window.partitionBy("chrom", "pos").orderBy(F.col("n").desc(), (F.col("allele") != F.col("ref")).asc(), F.col("allele"))
    return piles.withColumn("rank", F.row_number().over(w)).where("rank <= 2")


def log_likelihood(q1: list[tuple[int, int]], q2: list[tuple[int, int]], share):
    """ln L of the two alleles' (quality, count) pairs if the first makes up ``share`` (one or an array) of the molecules."""
    total = 0.0
    for pairs, f in ((q1, share), (q2, 1 - share)):
        for bq, c in pairs:
            e = 10 ** (-bq / 10)
            total = total + c * np.log(np.maximum(f * (1 - e) + (1 - f) * e, 1e-300))
    return total


def _first(holds, low: int, high: int) -> int:
    """The least of low..high from which on ``holds`` is true; it is at high."""
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if holds(mid) else (mid + 1, high)
    return low


def _peak(f, low: int, high: int) -> int:
    """Where a concave ``f`` is greatest among low..high."""
    return _first(lambda x: x == high or f(x + 1) <= f(x), low, high)


def genotype(q1: list[tuple[int, int]], q2: list[tuple[int, int]]) -> dict:
    """ln L and BIC of the models: ``major`` and ``minor`` homozygous, ``hetero`` balanced, ``biased`` with a free share."""
    n = sum(c for _, c in q1) + sum(c for _, c in q2)
    last = max(1, n - 1)

    def ll(x):
        return log_likelihood(q1, q2, x / n)

    def binom(x: int) -> float:
        return math.lgamma(n + 1) - math.lgamma(x + 1) - math.lgamma(n - x + 1)

    def odds(x: int) -> float:
        return binom(x) + x * math.log(x / n) + (n - x) * math.log(max(1 - x / n, 1e-300))

    # ln L and the binomial term are concave in the count, so the balanced model has one peak. The term of the biased model is
    # convex and greatest at the ends: its best count lies where ln L is no further below its peak than that term can make up.
    x = _peak(lambda x: ll(x) + binom(x), 1, last)
    balanced = ll(x) + binom(x) + n * math.log(0.5)
    top = _peak(ll, 1, last)
    floor = ll(top) + odds(top) - max(odds(1), odds(last)) - 1e-6
    low, high = _first(lambda x: ll(x) >= floor, 1, top), last + 1 - _first(lambda x: ll(last + 1 - x) >= floor, 1, last + 1 - top)
    free = max(float(np.max(ll(x) + np.array([odds(i) for i in x.tolist()]))) for s in range(low, high + 1, 65536) for x in [np.arange(s, min(s + 65536, high + 1))])
    like = {"major": log_likelihood(q1, q2, 1.0), "minor": log_likelihood(q1, q2, 0.0), "hetero": balanced, "biased": free}
    terms = {"major": 0, "minor": 0, "hetero": 1, "biased": 2}
    return {m: (v, -2 * v + terms[m] * math.log(n)) for m, v in like.items()}


def strand_bias(plus1: int, plus2: int, minus1: int, minus2: int) -> bool:
    """Do the two alleles lean significantly (below 0.05 at even odds) to opposite strands?"""
    if plus1 + plus2 == 0 or minus1 + minus2 == 0:
        return False
    few = lambda a, b: stats.binomial_cdf(a, a + b, 0.5) < 0.05
    return (few(plus1, minus1) and few(minus2, plus2)) or (few(minus1, plus1) and few(plus2, minus2))


CALLS = (
    "chrom string, pos long, ref string, alt string, gt string, model string, gq double, depth long, delta_bic double, mutation string, top1 string, top2 string, n1 long, n2 long, "
    "ctrl1 long, ctrl2 long, plus1 long, plus2 long, depth_ctrl long, bic_major double, bic_minor double, bic_hetero double, bic_biased double, pl array<int>"
)


def mutation(alt: str) -> str:
    return "Deletion" if alt == "*" else "Insertion" if len(alt) > 1 else "SNV"


def call_variants(piles: DataFrame, min_alt: int = 2, min_share: float = 0.8, min_gq_hetero: float = 0.0, min_gq_homo: float = 0.0, check_strands: bool = True) -> DataFrame:
    """Variants (columns ``CALLS``): positions whose best model is not the reference.

    The two deepest alleles must hold ``min_share`` of the depth; an alternative needs ``min_alt`` bases off read ends;
    alleles that lean to opposite strands fall away. ``pl`` has the Phred-scaled likelihoods of the reference, both and
    the alternative, the best of them 0.
    """
    more = [c for c in ("n_ctrl",) if c in piles.columns]
    deep = piles.groupBy("chrom", "pos").agg(F.sum("n").alias("depth"), F.sum(more[0] if more else F.lit(0).cast("long")).alias("depth_ctrl"))
    two = top_alleles(piles).groupBy("chrom", "pos", "ref").agg(F.sort_array(F.collect_list(F.struct("rank", "allele", "n", "n_tip", "n_plus", (F.col("n_ctrl") if more else F.lit(0).cast("long")).alias("n_ctrl"), "quals"))).alias("a"))
    sites = two.join(deep, ["chrom", "pos"]).where((F.col("ref") != "N") & ((F.size("a") > 1) | (F.col("a")[0]["allele"] != F.col("ref"))))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            out = []
            for c, p, ref, a, depth, depth_ctrl in pdf[["chrom", "pos", "ref", "a", "depth", "depth_ctrl"]].itertuples(index=False):
                a = list(a)
                if sum(x["n"] for x in a) < min_share * depth:
                    continue
                qs = [[(y["bq"], y["c"]) for y in x["quals"]] for x in a] + [[]]
                m = genotype(qs[0], qs[1])
                best = min(m, key=lambda k: m[k][1])
                others = [v[1] for k, v in m.items() if k != best and not {k, best} == {"hetero", "biased"}]
                delta = min(others) - m[best][1]
                first, second = a[0]["allele"], a[1]["allele"] if len(a) > 1 else None
                homo = best in ("major", "minor")
                alt = (first if best == "major" else second) if homo else next((x["allele"] for x in a if x["allele"] != ref), None)
                own = next((x for x in a if x["allele"] == alt), None)
                if delta < 2 or own is None or alt == ref or own["n"] - own["n_tip"] < min_alt:
                    continue
                one, other = a[0], a[1] if len(a) > 1 else {"n": 0, "n_plus": 0, "n_ctrl": 0}
                if check_strands and strand_bias(one["n_plus"], other["n_plus"], one["n"] - one["n_plus"], other["n"] - other["n_plus"]):
                    continue
                gt = "1/1" if homo else "0/1" if ref in (first, second) else "1/2"
                gq = min(10 / math.log(10) * (m[best][0] - v[0]) for k, v in m.items() if k != best and not {k, best} == {"hetero", "biased"})
                if gq >= (min_gq_homo if homo else min_gq_hetero):
                    pure = {"major": first, "minor": second}
                    like = [max((m[k][0] for k in pure if pure[k] == x), default=-1e9) for x in (ref, alt)]
                    like = [like[0], max(m["hetero"][0], m["biased"][0]), like[1]]
                    pl = [int(min(999, round(10 / math.log(10) * (max(like) - x)))) for x in like]
                    bics = [float(m[k][1]) for k in ("major", "minor", "hetero", "biased")]
                    out.append((c, p, ref, alt, gt, best, gq, depth, delta, mutation(alt), first, second, one["n"], other["n"], one["n_ctrl"], other["n_ctrl"], one["n_plus"], other["n_plus"], depth_ctrl, *bics, pl))
            yield pd.DataFrame(out, columns=[x.split(" ")[0] for x in CALLS.split(", ")])

    return sites.mapInPandas(run, CALLS)


def fix_indels(calls: DataFrame, piles: DataFrame) -> DataFrame:
    """Variants as a VCF has them: neighbouring deletions as one, with the reference base before it.

    A deletion right after an insertion falls away with it (a third allele, or a repeat that was aligned in two ways). A
    deletion whose base before it is itself a variant, or not covered, keeps its place and ``*``.
    """
    dele = calls.where("alt = '*'").withColumn("_end", F.col("pos") + 1)
    runs = islands(dele, ["chrom"], "pos", "_end")
    first = [c for c in calls.columns if c not in ("chrom", "pos", "ref")]
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "ref"))), lambda x: x["ref"]), "")
    joined = runs.groupBy("chrom", F.col("island").alias("_p")).agg(text.alias("ref"), *(F.min_by(c, "pos").alias(c) for c in first)).select("chrom", F.col("_p").alias("pos"), "ref", *first)
    other = calls.where("alt <> '*'")
    before = other.select(F.col("chrom").alias("_c"), (F.col("pos") + 1).alias("_q"), (F.length("alt") > 1).alias("_ins"))
    seen = joined.join(before, (F.col("chrom") == F.col("_c")) & (F.col("pos") == F.col("_q")), "left").drop("_c", "_q")
    base = piles.select(F.col("chrom").alias("_c"), (F.col("pos") + 1).alias("_q"), F.substring("ref", 1, 1).alias("_base")).distinct()
    seen = seen.where(~F.coalesce("_ins", F.lit(False))).join(base, (F.col("chrom") == F.col("_c")) & (F.col("pos") == F.col("_q")), "left")
    moved = F.col("_ins").isNull() & F.col("_base").isNotNull()
    fixed = seen.withColumn("ref", F.when(moved, F.concat("_base", "ref")).otherwise(F.col("ref"))).withColumn("alt", F.when(moved, F.col("_base")).otherwise(F.col("alt"))).withColumn("pos", F.when(moved, F.col("pos") - 1).otherwise(F.col("pos")))
    lost = joined.select(F.col("chrom").alias("_c"), (F.col("pos") - 1).alias("_q"))
    kept = other.join(lost, (F.col("chrom") == F.col("_c")) & (F.col("pos") == F.col("_q")) & (F.length("alt") > 1), "left_anti")
    return kept.select(*calls.columns).unionByName(fixed.select(*calls.columns))
