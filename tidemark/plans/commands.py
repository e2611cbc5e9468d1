"""Whole pipelines over DataFrames, one function per command. Inputs come from ``tidemark.sources``, outputs go to its sinks."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import scores, stats
from tidemark.operators import intervals, models, peaks, pileup, qvalue, shapes, step, tracks, variants
from tidemark.plans.tables import stage
from tidemark.sources import text


def _kind(df: DataFrame) -> str:
    return "tags" if "pos" in df.columns else "counts" if "cnt" in df.columns else "pairs"


def _genome(g: float | str) -> float:
    return float(stats.GENOME_SIZES.get(g, g) if isinstance(g, str) else g)


def filterdup(data: DataFrame, keep: int | str = "auto", genome: float | str = "hs") -> DataFrame:
    """At most ``keep`` equal tags or fragments; ``auto`` is what chance allows, ``all`` keeps everything."""
    if keep == "all" or _kind(data) == "counts":
        return data
    cols = ["chrom", "pos", "strand"] if _kind(data) == "tags" else ["chrom", "l", "r"]
    most = stats.max_duplicates(_genome(genome), data.count()) if keep == "auto" else int(keep)
    return tracks.limit_duplicates(data, cols, most)


def randsample(data: DataFrame, share: float | None = None, number: int | None = None, seed: int = 0) -> DataFrame:
    groups = ["chrom", "strand"] if _kind(data) == "tags" else ["chrom"]
    return tracks.sample(data, groups, share, seed=seed) if share is not None else tracks.sample_number(data, groups, number, seed=seed)


def predictd(data: DataFrame, genome: float | str = "hs", bandwidth: int = 300, mfold=(5, 50), d_min: int = 20) -> dict:
    """The fragment size: modelled for tags, the mean length for fragments."""
    if _kind(data) == "tags":
        return models.strand_model(data, _genome(genome), bandwidth, mfold, d_min)
    return {"d": tracks.totals(data).first()["mean_length"]}


def pileup_track(data: DataFrame, extsize: int = 200, both: bool = False, lengths: DataFrame | None = None, barcodes: DataFrame | None = None) -> DataFrame:
    if barcodes is not None:
        data = tracks.subset(data, barcodes)
    if _kind(data) == "tags":
        return pileup.pileup_tags(data, 2 * extsize if both else extsize, directional=not both, lengths=lengths)
    frags = pileup.clip(data, lengths)
    return pileup.pileup(frags, F.col("cnt").cast("long") if _kind(data) == "counts" else None)


def scaling(treat: dict, ctrl: dict | None, kind: str, d: int, genome: float, slocal: int = 1000, llocal: int = 10000, nolambda: bool = False, to_control: bool = False, ratio: float | None = None) -> dict:
    """Scales and windows of a call: ``treat_scale``, ``lambda_bg`` and (window, scale) pairs of the background.

    ``treat`` and ``ctrl`` hold ``total`` and ``length``. With a control its windows are d, slocal and llocal, scaled to
    the treatment's depth (or the treatment to the control's); without one the treatment itself in the llocal window.
    """
    if not d <= slocal <= llocal:
        raise ValueError("d, slocal and llocal must not fall")
    paired = kind != "tags"
    t_sum = treat["length"] if paired else treat["total"] * d
    if ctrl is None:
        bg = t_sum / genome
        scale = treat["length"] / (llocal * treat["total"] * 2) if paired else d / llocal
        return {"treat_scale": 1.0, "lambda_bg": bg, "windows": [] if nolambda else [(llocal, scale)]}
    c_sum = 2 * ctrl["total"] * ctrl["length"] / ctrl["total"] if paired else ctrl["total"] * d
    r = t_sum / c_sum if ratio is None else ratio
    bg, t_scale, k = (c_sum / genome, 1 / r, 1.0) if to_control else (t_sum / genome, 1.0, r)
    windows = [(d, k)] + ([] if nolambda else [(slocal, d / slocal * k)] + ([(llocal, d / llocal * k)] if llocal > slocal else []))
    return {"treat_scale": t_scale, "lambda_bg": bg, "windows": [] if nolambda else windows}


def _windows(data: DataFrame, w: int) -> DataFrame:
    kind = _kind(data)
    return pileup.tag_intervals(data, w, directional=False) if kind == "tags" else pileup.both_ends(data, w, centred=kind == "pairs")


def cells(treat: DataFrame, ctrl: DataFrame | None, d: int, plan: dict, shift: int = 0, lengths: DataFrame | None = None) -> DataFrame:
    """``(chrom, start, end, treat, ctrl)``: treatment coverage beside the local background."""
    kind = _kind(treat)
    count = lambda df: F.col("cnt").cast("long") if _kind(df) == "counts" else None
    rows = pileup.tag_intervals(treat, d, shift) if kind == "tags" else treat
    tracks_ = {"treat": {"df": pileup.clip(rows, lengths), "weight": count(treat), "scale": plan["treat_scale"]}}
    source = treat if ctrl is None else ctrl
    for i, (w, s) in enumerate(plan["windows"]):
        tracks_[f"w{i}"] = {"df": pileup.clip(_windows(source, w), lengths), "weight": count(source), "scale": s, "baseline": plan["lambda_bg"]}
    both = pileup.together(tracks_, "outer").where("treat is not null")
    bg = [F.coalesce(F.col(n), F.lit(float(plan["lambda_bg"]))) for n in tracks_ if n != "treat"] or [F.lit(float(plan["lambda_bg"]))]
    return both.select("chrom", "start", "end", "treat", (F.greatest(*bg) if len(bg) > 1 else bg[0]).alias("ctrl"))


#: Scores by their symbol.
SYMBOLS = {"p": "pscore", "q": "qscore", "f": "fold", "s": "excess"}


def callpeak(
    treat: DataFrame, ctrl: DataFrame | None = None, genome: float | str = "hs", q: float | None = 0.05, p: float | None = None, keep_dup: int | str = 1, nomodel: bool = True, extsize: int = 200, shift: int = 0, slocal: int = 1000,
    llocal: int = 10000, nolambda: bool = False, broad: bool = False, broad_cutoff: float = 0.1, max_gap: int | None = None, min_length: int | None = None, tag_size: int = 50, fe_cutoff: float = 1.0, call_summits: bool = False,
    scale_to: str = "small", down_sample: bool = False, seed: int = 0, barcodes: DataFrame | None = None, max_count: int | None = None, lengths: DataFrame | None = None, mfold=(5, 50), bandwidth: int = 300, cutoff_analysis: bool = False,
    cutoffs: dict[str, float] | None = None,
) -> dict[str, DataFrame]:
    """Enriched intervals of a treatment against its control or its own surroundings.

    Gives ``cells`` (aligned coverage with p and q scores), ``peaks`` (narrow or broad) and, if asked, ``cutoffs``. Only
    totals reach the driver. Chroms missing from the treatment do not come out. ``cutoffs`` names scores by symbol
    instead of ``p`` and ``q``: -log10 p and q scores, ``f`` fold change (pseudocount 1), ``s`` the difference.
    """
    g = _genome(genome)
    if barcodes is not None:
        treat = tracks.subset(treat, barcodes)
    if _kind(treat) == "counts":
        treat = tracks.cap_counts(treat, max_count)
    treat = stage(filterdup(treat, keep_dup, g), "treat-filtered")
    ctrl = None if ctrl is None else stage(filterdup(ctrl, keep_dup, g), "ctrl-filtered")
    kind = _kind(treat)
    size = lambda x: ({"total": x.count(), "length": 0} if kind == "tags" else {k: v or 0 for k, v in tracks.totals(x).first().asDict().items()})
    st, sc = size(treat), None if ctrl is None else size(ctrl)
    if kind != "tags":
        d = max(1, int(st["length"] / max(1, st["total"])))
    else:
        d = extsize if nomodel else models.strand_model(treat, g, bandwidth, mfold)["d"]
    if down_sample and sc and st["total"] and sc["total"]:
        more = st["total"] > sc["total"]
        small = min(st["total"], sc["total"])
        if more:
            treat = stage(randsample(treat, number=small, seed=seed), "treat-sampled")
            st = size(treat)
        else:
            ctrl = stage(randsample(ctrl, number=small, seed=seed), "ctrl-sampled")
            sc = size(ctrl)
    larger = sc is not None and st["total"] > sc["total"] * (2 if kind != "tags" else 1)
    plan = scaling(st, sc, kind, d, g, max(slocal, d), max(llocal, slocal, d), nolambda, to_control=larger == (scale_to == "small") if sc else False)
    by = {SYMBOLS[k]: x for k, x in cutoffs.items()} if cutoffs else {"pscore": -math.log10(p)} if p is not None else {"qscore": -math.log10(q)}
    c = stage(qvalue.scored_pq(cells(treat, ctrl, d, plan, shift, lengths)), "scored")
    more = {"fold": (F.col("treat") + 1) / (F.col("ctrl") + 1), "excess": F.col("treat") - F.col("ctrl")}
    for name in set(by) & set(more):
        c = c.withColumn(name, more[name])
    gap, least = tag_size if max_gap is None else max_gap, d if min_length is None else min_length
    out = {"cells": c}
    if cutoff_analysis:
        swept = peaks.cutoff_table(c, [round(0.3 * k, 1) for k in range(1, 34)], least, gap, "pscore")
        # The q score of a cutoff is that of the least p score from it on.
        q_of = stage(c.where("pscore is not null").groupBy("pscore").agg(F.max("qscore").alias("qscore")), "q-of-p")
        out["cutoffs"] = swept.join(q_of, q_of["pscore"] >= swept["cutoff"]).groupBy(*swept.columns).agg(F.min_by("qscore", "pscore").alias("qscore"))
    if broad:
        fc = (F.col("treat") + 1) / (F.col("ctrl") + 1)
        means = {"pileup": F.col("treat"), "fc": fc, "pscore": F.col("pscore"), "qscore": F.col("qscore")}
        name = next(iter(by))
        strong = peaks.broad_islands(c, by, least, gap, means)
        weak = peaks.broad_islands(c, {name: -math.log10(broad_cutoff)}, least, 4 * gap, means)
        out["peaks"] = peaks.nest(strong, weak, list(means)).where(F.col("fc") >= fe_cutoff)
        return out
    found = peaks.call_scored(c, by, least, gap).where(F.col("fc") >= fe_cutoff)
    if call_summits:
        tops = shapes.subpeaks(c.select("chrom", "start", "end", F.col("treat").alias("value")), found.select("chrom", "start", "end"), least)
        found = found.drop("summit").join(tops.select("chrom", "start", "end", "summit"), ["chrom", "start", "end"])
    out["peaks"] = found
    return out


def callvar(
    reads: DataFrame, regions: DataFrame, control: DataFrame | None = None, min_quality: int = 20, max_duplicates: int = 1, outliers: int = 5, min_share: float = 0.8, min_alt: int = 2, min_gq_hetero: float = 0.0, min_gq_homo: float = 0.0,
) -> DataFrame:
    """Variants (``operators.variants.CALLS``) of the reads in regions, with neighbouring deletions joined; write them by ``sinks.variant_vcf``.

    Reads are (name, chrom, pos, flag, cigar, seq, qual, md) as the BAM source gives them. Repeated alignments are limited and
    the reads of most edits of each region dropped; control reads add to the depth and are told apart in the counts.
    Local assembly is not offered.
    """
    both = reads.withColumn("ctrl", F.lit(False))
    if control is not None:
        both = both.unionByName(control.withColumn("ctrl", F.lit(True)), allowMissingColumns=True)
    own = ["name", "chrom", "pos", "flag", "cigar", "seq", "qual", "md", "ctrl"]
    sized = both.where(text.usable(F.col("flag"))).select(*own, (F.col("pos") + text.reference_length(F.col("cigar"))).alias("_end"))
    held = intervals.overlap_join(sized, intervals.merge(regions), ("pos", "_end"), ("start", "end"))
    held = variants.limit_alignments(held, ["b_start", "ctrl"], max_duplicates)
    held = stage(variants.without_outliers(held, ["chrom", "b_start"], outliers), "variant-reads")
    rows = variants.bases(held.select(*own), min_quality)
    inside = intervals.hosts(rows.withColumn("start", F.col("pos")).withColumn("end", F.col("pos") + 1), intervals.merge(regions), ["start"]).where("host is not null")
    piles = stage(variants.pile(inside), "allele-piles")
    calls = stage(variants.call_variants(piles, min_alt, min_share, min_gq_hetero, min_gq_homo), "variants")
    return variants.fix_indels(calls, piles)


def bdgpeakcall(track: DataFrame, cutoff: float = 5, min_length: int = 200, max_gap: int = 30, cutoffs: list[float] | None = None) -> DataFrame:
    return peaks.cutoff_table(track, cutoffs, min_length, max_gap) if cutoffs else peaks.call(track, cutoff, min_length, max_gap)


def bdgbroadcall(track: DataFrame, cutoff: float = 2, weak_cutoff: float = 1, min_length: int = 200, max_gap: int = 30, weak_gap: int = 800) -> DataFrame:
    return peaks.call_broad(track, cutoff, weak_cutoff, min_length, max_gap, weak_gap)


def bdgcmp(treat: DataFrame, ctrl: DataFrame, methods: list[str], pseudocount: float = 0.0, scale: float = 1.0) -> DataFrame:
    """``(chrom, start, end, <methods>)``: all methods from one alignment."""
    c = step.align({"treat": treat, "ctrl": ctrl}).withColumn("treat", F.col("treat") * scale).withColumn("ctrl", F.col("ctrl") * scale)
    if {"ppois", "qpois"} & set(methods):
        c = qvalue.scored(c, pseudocount)
        c = qvalue.with_qscore(c) if "qpois" in methods else c
    pick = {"ppois": lambda: F.col("pscore"), "qpois": lambda: F.col("qscore")}
    cols = [(pick[m]() if m in pick else scores.score(scores.NAMES[m], F.col("treat"), F.col("ctrl"), pseudocount)).alias(m) for m in methods]
    return c.select("chrom", "start", "end", *cols)


def bdgopt(track: DataFrame, method: str, number: float = 0.0) -> DataFrame:
    return step.operate(track, method, number)


def cmbreps(replicates: list[DataFrame], method: str = "fisher") -> DataFrame:
    if method not in ("fisher", "max", "mean"):
        raise ValueError(method)
    return step.overlay(replicates, method)


def bdgdiff(t1: DataFrame, c1: DataFrame, t2: DataFrame, c2: DataFrame, cutoff: float = 3, min_length: int = 200, max_gap: int = 100, d1: float = 1.0, d2: float = 1.0) -> DataFrame:
    if max_gap >= min_length:
        raise ValueError("the gap must be smaller than the least length")
    return peaks.differential_peaks(peaks.differential(t1, c1, t2, c2, d1, d2), cutoff, min_length, max_gap)


def refinepeak(regions: DataFrame, tags: DataFrame, cutoff: float = 5.0, window: int = 200) -> DataFrame:
    return shapes.refine_by_balance(tags, regions, window, cutoff)


def hmmratac(
    frags: DataFrame, means=(50, 200, 400, 600), stddevs=(20, 20, 20, 20), em: bool = True, least: float = 0.001, bin_size: int = 10, upper: float = 20, lower: float = 10, prescan: float = 1.2, max_train: int = 1000,
    flank: int = 1000, min_length: int = 100, kind: str = "gaussian", blacklist: DataFrame | None = None, model: models.StateModel | None = None, seed: int = 10151, share: float = 0.1,
) -> dict:
    """Accessible regions by hidden states of four fragment-length signals.

    Training uses at most ``max_train`` regions (a documented bound); every candidate region is decoded.
    """
    if blacklist is not None:
        frags = intervals.exclude(frags, blacklist, "l", "r")
    frags = stage(frags, "hmm-fragments")
    if em:
        means, stddevs = models.mixture(frags, means, stddevs, share, seed=seed)
    weights = models.length_weights(tracks.length_histogram(frags), list(means), list(stddevs), least)
    signals = {k: stage(v, f"signal-{k}") for k, v in models.digested(frags, weights).items()}
    cover = stage(pileup.pileup(frags, F.col("cnt").cast("long") if "cnt" in frags.columns else None), "hmm-coverage")
    mean = step.summary(cover).first()["mean"] or 1.0
    fold = stage(step.apply(cover, lambda v: v / mean), "hmm-fold")
    length = int(tracks.totals(frags).first()["mean_length"] or 1)
    if model is None:
        rich = peaks.keep(peaks.call(fold, lower, length, flank), score=(lower, upper))
        some = intervals.merge(intervals.expand(tracks.pick(rich.select("chrom", "start", "end"), max_train, seed), flank))
        rows = models.bin_signals(signals, some, bin_size).toPandas().sort_values(["chrom", "start", "bin_end"])
        if rows.empty:
            raise ValueError("no region to train on")
        model = models.train_states(rows[models.CLASSES].to_numpy(float), rows.groupby(["chrom", "start"], sort=False).size().tolist(), kind, seed=seed)
    wide = intervals.merge(intervals.expand(peaks.call(fold, prescan, length, flank).select("chrom", "start", "end"), flank))
    post = stage(models.decode_states(models.bin_signals(signals, wide, bin_size), model), "posteriors")
    runs = stage(models.state_runs(post, bin_size), "states")
    found = models.accessible(runs, min_length)
    return {"model": model, "posteriors": post, "states": runs, "peaks": peaks.refine(fold, found.select("chrom", F.col("open_start").alias("start"), F.col("open_end").alias("end")))}
