"""From step functions to enriched intervals: gap merging, summits, broad and differential calls, cutoff tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scores import log_lr, log_lr_sym
from tidemark.operators import intervals
from tidemark.operators.ordered import islands
from tidemark.operators.step import align, weighted_mean


def runs(df: DataFrame, passing: Column, max_gap: int, keys: list[str] | None = None) -> DataFrame:
    """The passing segments with the number of their island: gaps of up to ``max_gap`` are bridged."""
    return islands(df.where(passing), keys or ["chrom"], "start", "end", max_gap)


def summits(segments: DataFrame, value: str = "value", carry: list[str] | None = None, keys: list[str] | None = None) -> DataFrame:
    """``(keys, island, start, end, summit, top, *carry)``: bounds of each island and where its value is greatest.

    Of n segments that share the greatest value the one at place (n + 1) // 2 is taken, and its midpoint. Segments are read
    twice (their islands are a written table), so a giant island meets in one task only with its ties.
    """
    keys = [*(keys or ["chrom"]), "island"]
    bounds = segments.groupBy(*keys).agg(F.min("start").alias("p_start"), F.max("end").alias("p_end"), F.max(value).alias("p_top"))
    ties = segments.join(bounds, keys).where(F.col(value) == F.col("p_top"))
    w = Window.partitionBy(*keys)
    picked = ties.withColumn("_i", F.row_number().over(w.orderBy("start"))).withColumn("_n", F.count("*").over(w)).where(F.col("_i") == F.floor((F.col("_n") + 1) / 2))
    return picked.select(*keys, F.col("p_start"), F.col("p_end"), F.floor((F.col("start") + F.col("end")) / 2).cast("long").alias("summit"), F.col("p_top").alias("top"), *(carry or [])).withColumnRenamed("p_start", "start").withColumnRenamed("p_end", "end")


def call(df: DataFrame, cutoff: float, min_length: int = 200, max_gap: int = 50, strict: bool = False, value: str = "value") -> DataFrame:
    """``(chrom, start, end, summit, score)`` of a track: islands of values at (or, if strict, above) the cutoff."""
    passing = F.col(value) > cutoff if strict else F.col(value) >= cutoff
    found = summits(runs(df, passing, max_gap), value)
    return found.where(F.col("end") - F.col("start") >= min_length).select("chrom", "start", "end", "summit", F.col("top").alias("score"))


def call_scored(cells: DataFrame, cutoffs: dict[str, float], min_length: int, max_gap: int, pseudocount: float = 1.0) -> DataFrame:
    """Narrow peaks of aligned cells ``(chrom, start, end, treat, ctrl, <scores>)``.

    A segment passes where any score is above its cutoff; the summit is where the treatment is greatest and must pass
    every cutoff, else the island falls away. ``fc`` is the ratio at the summit with the pseudocount on both sides.
    """
    passing = reduce(lambda a, b: a | b, [F.col(c) > x for c, x in cutoffs.items()])
    scores = [c for c in ("pscore", "qscore") if c in cells.columns]
    more = [c for c in cutoffs if c not in scores]
    found = summits(runs(cells, passing, max_gap), "treat", ["ctrl", *scores, *more])
    found = found.where(F.col("end") - F.col("start") >= min_length).where(reduce(lambda a, b: a & b, [F.col(c) >= x for c, x in cutoffs.items()]))
    fc = (F.col("top") + pseudocount) / (F.col("ctrl") + pseudocount)
    return found.select("chrom", "start", "end", "summit", F.col("top").alias("pileup"), fc.alias("fc"), *scores, *more)


def broad_islands(cells: DataFrame, cutoffs: dict[str, float], min_length: int, max_gap: int, means: dict[str, Column], strict: bool = True) -> DataFrame:
    """``(chrom, start, end, *means)``: islands with length-weighted means of their passing segments."""
    passing = reduce(lambda a, b: a | b, [(F.col(c) > x) if strict else (F.col(c) >= x) for c, x in cutoffs.items()])
    agg = [F.min("start").alias("start_"), F.max("end").alias("end_"), *(weighted_mean(v).alias(n) for n, v in means.items())]
    found = runs(cells, passing, max_gap).groupBy("chrom", "island").agg(*agg)
    return found.select("chrom", F.col("start_").alias("start"), F.col("end_").alias("end"), *means).where(F.col("end") - F.col("start") >= min_length)


def nest(strong: DataFrame, weak: DataFrame, means: list[str]) -> DataFrame:
    """Broad peaks: each weak region with the strong ones it holds as ``blocks`` (offset and size).

    One-base blocks mark ends that no strong region reaches; without any strong region both ends are marked and
    ``has_core`` is false. Chroms with no strong region at all fall away.
    """
    held = intervals.hosts(strong.select("chrom", "start", "end"), weak, ["start"]).where("host is not null")
    cores = held.groupBy("chrom", F.col("host.start").alias("start")).agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("cores"))
    on = weak.join(strong.select("chrom").distinct(), "chrom", "left_semi").join(cores, ["chrom", "start"], "left")
    block = lambda s, n: F.struct((s - F.col("start")).cast("long").alias("offset"), n.cast("long").alias("size"))
    one = F.lit(1)
    kind = "array<struct<offset:bigint,size:bigint>>"
    core = F.transform(F.coalesce("cores", F.array().cast("array<struct<start:bigint,end:bigint>>")), lambda x: block(x["start"], x["end"] - x["start"]))
    head = F.when(F.col("cores").isNull() | (F.element_at("cores", 1)["start"] > F.col("start")), F.array(block(F.col("start"), one))).otherwise(F.array().cast(kind))
    tail = F.when(F.col("cores").isNull() | (F.element_at("cores", -1)["end"] < F.col("end")), F.array(block(F.col("end") - 1, one))).otherwise(F.array().cast(kind))
    thick_start = F.when(F.col("cores").isNotNull(), F.element_at("cores", 1)["start"])
    thick_end = F.when(F.col("cores").isNotNull(), F.element_at("cores", -1)["end"])
    return on.select("chrom", "start", "end", thick_start.alias("thick_start"), thick_end.alias("thick_end"), F.concat(head, core, tail).alias("blocks"), F.col("cores").isNotNull().alias("has_core"), *means)


def call_broad(df: DataFrame, cutoff: float, weak_cutoff: float, min_length: int = 200, max_gap: int = 50, weak_gap: int = 400, value: str = "value") -> DataFrame:
    """Broad peaks of one track: strong islands nested in weak ones, both at or above their cutoffs."""
    if cutoff <= weak_cutoff or max_gap >= weak_gap:
        raise ValueError("the strong cutoff must be the higher, its gap the smaller")
    means = {"score": F.col(value)}
    strong = broad_islands(df, {value: cutoff}, min_length, max_gap, means, strict=False)
    weak = broad_islands(df, {value: weak_cutoff}, min_length, weak_gap, means, strict=False)
    return nest(strong, weak, ["score"])


def cutoff_table(df: DataFrame, cutoffs: list[float], min_length: int, max_gap: int, value: str = "value") -> DataFrame:
    """``(cutoff, npeaks, lpeaks, avelpeak)`` for each cutoff with a peak: segments above it, merged and measured.

    A segment is repeated for the cutoffs it passes, and all cutoffs are swept at once.
    """
    grid = F.filter(F.array(*(F.lit(float(c)) for c in cutoffs)), lambda c: c < F.col(value))
    rows = valid_segments(df).select("chrom", "start", "end", F.explode(grid).alias("cutoff"))
    found = islands(rows, ["cutoff", "chrom"], "start", "end", max_gap).groupBy("cutoff", "chrom", "island").agg((F.max("end") - F.min("start")).alias("len"))
    return found.where(F.col("len") >= min_length).groupBy("cutoff").agg(F.count("*").alias("npeaks"), F.sum("len").alias("lpeaks"), F.avg("len").alias("avelpeak"))


def valid_segments(df: DataFrame) -> DataFrame:
    return df.where("chrom is not null and end > start")


def cutoff_grid(low: float, high: float, steps: int) -> list[float]:
    """Evenly spaced cutoffs from ``low`` up to, not including, ``high``, to 3 decimals."""
    width = (high - low) / steps
    return sorted({round(low + i * width, 3) for i in range(steps)}) if width > 0 else []


def differential(t1: DataFrame, c1: DataFrame, t2: DataFrame, c2: DataFrame, depth1: float = 1.0, depth2: float = 1.0, pseudocount: float = 0.01) -> DataFrame:
    """Cells ``(chrom, start, end, llr1, llr2, llr12)``: each condition against its control, and the first against the second.

    The deeper pair of tracks is scaled down to the other's depth.
    """
    small = min(depth1, depth2)
    f1, f2 = small / depth1, small / depth2
    cells = align({"t1": t1, "c1": c1, "t2": t2, "c2": c2})
    x = lambda c, f: (F.col(c) + pseudocount) * f
    return cells.select("chrom", "start", "end", log_lr(x("t1", f1), x("c1", f1)).alias("llr1"), log_lr(x("t2", f2), x("c2", f2)).alias("llr2"), log_lr_sym(x("t1", f1), x("t2", f2)).alias("llr12"))


def differential_peaks(cells: DataFrame, cutoff: float = 3.0, min_length: int = 200, max_gap: int = 100) -> DataFrame:
    """``(category, chrom, start, end, score)`` for ``cond1``, ``cond2`` and ``common``, scored by the mean ratio between them."""
    l1, l2, l12 = F.col("llr1"), F.col("llr2"), F.col("llr12")
    rules = {
        "cond1": ((l1 >= cutoff) & (l12 >= cutoff), l12),
        "cond2": ((l2 >= cutoff) & (l12 <= -cutoff), -l12),
        "common": ((l1 >= cutoff) & (l2 >= cutoff) & (F.abs(l12) <= cutoff), F.abs(l12)),
    }
    kinds = F.filter(F.array(*(F.when(cond, F.struct(F.lit(n).alias("category"), s.alias("s"))) for n, (cond, s) in rules.items())), lambda x: x.isNotNull())
    rows = cells.select("chrom", "start", "end", F.inline(kinds))
    found = islands(rows, ["category", "chrom"], "start", "end", max_gap).groupBy("category", "chrom", "island").agg(F.min("start").alias("s0"), F.max("end").alias("e0"), weighted_mean(F.col("s")).alias("score"))
    return found.where(F.col("e0") - F.col("s0") >= min_length).select("category", "chrom", F.col("s0").alias("start"), F.col("e0").alias("end"), "score")


def refine(signal: DataFrame, regions: DataFrame) -> DataFrame:
    """``(chrom, start, end, summit, score)``: each region with the summit of the signal inside it; regions without signal fall away."""
    clipped = intervals.overlap_join(signal, regions.select("chrom", "start", "end"), ("start", "end"), ("start", "end"))
    clipped = clipped.select("chrom", F.struct(F.col("b_start").alias("a"), F.col("b_end").alias("b")).alias("island"), F.greatest("start", "b_start").alias("start"), F.least("end", "b_end").alias("end"), "value")
    return summits(clipped, "value").select("chrom", "start", "end", "summit", F.col("top").alias("score"))


def keep(peaks: DataFrame, **limits: tuple[float, float | None] | float) -> DataFrame:
    """Peaks whose columns reach a minimum, or lie in ``[low, up)``: ``keep(p, qscore=2, fc=(1, 20))``."""
    for column, x in limits.items():
        low, up = x if isinstance(x, tuple) else (x, None)
        peaks = peaks.where(F.col(column) >= low) if up is None else peaks.where((F.col(column) >= low) & (F.col(column) < up))
    return peaks
