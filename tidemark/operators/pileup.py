"""Coverage step functions from points and intervals.

A step function is a DataFrame ``(chrom, start, end, value)`` of disjoint half-open segments.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ordered import SHARD, along


def tag_intervals(tags: DataFrame, d: int, shift: int = 0, directional: bool = True) -> DataFrame:
    """``(chrom, l, r)`` of tags ``(chrom, pos, strand)``: extended downstream by ``d``, or by half of it to both sides.

    ``shift`` moves the interval along the strand. Null chrom, pos or strand: the row is left out.
    """
    if directional:
        five, three = -shift, shift + d
    else:
        five, three = d // 2 - shift, shift + d - d // 2
    p = F.col("pos").cast("long")
    rows = tags.where("chrom is not null and pos is not null and strand is not null")
    forward = F.col("strand") == 0
    return rows.select("chrom", F.when(forward, p - five).otherwise(p - three).alias("l"), F.when(forward, p + three).otherwise(p + five).alias("r"))


def clip(df: DataFrame, lengths: DataFrame | None = None, start: str = "l", end: str = "r") -> DataFrame:
    """Coordinates limited to ``[0, chrom_len]``; without a known length only to 0 and up. ``lengths``: (chrom, chrom_len)."""
    zero = F.lit(0).cast("long")
    if lengths is None:
        return df.withColumn(start, F.greatest(F.col(start), zero)).withColumn(end, F.greatest(F.col(end), zero))
    size = lengths.groupBy(F.col("chrom").alias("_chrom")).agg(F.max("chrom_len").alias("_len"))
    both = df.join(size, F.col("chrom") == F.col("_chrom"), "left")
    limit = lambda c: F.greatest(F.least(F.col(c), F.coalesce(F.col("_len"), F.lit(2147483647))), zero)
    return both.withColumn(start, limit(start)).withColumn(end, limit(end)).drop("_chrom", "_len")


def pileup(df: DataFrame, weight: Column | None = None, scale: float = 1.0, baseline: float | None = None, keys: list[str] | None = None, start: str = "l", end: str = "r", shard: int = SHARD) -> DataFrame:
    """The step function of summed weights (1 each by default) of the intervals over every key.

    Changes at one position are summed before they move; positions of no net change are no breakpoints; the stretch
    from 0 to the first breakpoint has value 0; the last segment ends where the last interval does. Values are scaled,
    then raised to ``baseline``. Intervals with a null bound or key or ``end <= start`` take no part; a null weight
    counts 0. Negative starts are kept as they are: clip before.
    """
    keys = keys or ["chrom"]
    net = _changes(df, weight, keys, start, end).groupBy(*keys, "start").agg(F.sum("_d").alias("_d")).where("_d <> 0" if weight is None else "abs(_d) > 1e-12")
    out = _segments(net, keys, {"value": F.col("_d")}, shard)
    return out.withColumn("value", _scaled(F.col("value"), scale, baseline))


def _changes(df: DataFrame, weight: Column | None, keys: list[str], start: str, end: str) -> DataFrame:
    """``(keys, start, _d)``: the weight at every interval's start and its negative at the end."""
    ok = (F.col(end) > F.col(start)) & F.col(start).isNotNull()
    for k in keys:
        ok = ok & F.col(k).isNotNull()
    w = F.lit(1).cast("long") if weight is None else F.coalesce(weight, F.lit(0))
    ends = df.where(ok).select(*keys, F.col(start).cast("long").alias("_a"), F.col(end).cast("long").alias("_b"), w.alias("_w"))
    return ends.select(*keys, F.inline(F.array(F.struct(F.col("_a").alias("start"), F.col("_w").alias("_d")), F.struct(F.col("_b").alias("start"), (-F.col("_w")).alias("_d")))))


def _segments(net: DataFrame, keys: list[str], sums: dict[str, Column], shard: int) -> DataFrame:
    """``(keys, start, end, *sums)`` between neighbouring breakpoints, and from 0 to the first one with value 0.

    ``net`` ends in an aggregation, so nothing is written: rows and shard summaries share its exchange.
    """
    run = along(net, keys, "start", sums=sums, leads={"end": F.col("start")}, lags={"_prev": F.col("start")}, shard=shard, written=False)
    body = F.when(F.col("end").isNotNull(), F.struct("start", "end", *(F.col(n).cast("double").alias(n) for n in sums)))
    lead = F.when(F.col("_prev").isNull() & (F.col("start") > 0), F.struct(F.lit(0).cast("long").alias("start"), F.col("start").alias("end"), *(F.lit(0.0).alias(n) for n in sums)))
    return run.select(*keys, F.inline(F.filter(F.array(body, lead), lambda x: x.isNotNull())))


def _scaled(value: Column, scale: float, baseline: float | None) -> Column:
    value = value * float(scale) if scale != 1.0 else value
    return value if baseline is None else F.greatest(value, F.lit(float(baseline)))


def together(tracks: dict[str, dict], how: str = "inner", shard: int = SHARD) -> DataFrame:
    """``(chrom, start, end, *names)``: the pileups of several sets of intervals, cut at the union of their breakpoints.

    What ``step.align`` gives for the ``pileup`` of each, in one pass: changes of all tracks are summed per position and
    carried along together. A track is ``{"df": intervals (chrom, l, r), "weight", "scale", "baseline"}``. ``inner`` keeps
    cells that all tracks cover, ``outer`` those that any covers, with null where a track has no segment.
    """
    names = list(tracks)
    marks = []
    for i, n in enumerate(names):
        rows = _changes(tracks[n]["df"], tracks[n].get("weight"), ["chrom"], "l", "r")
        marks.append(rows.select("chrom", "start", *((F.col("_d").cast("double") if k == i else F.lit(0.0)).alias(f"d{k}") for k in range(len(names)))))
    changed = [F.abs(F.col(f"d{i}")) > 1e-12 for i in range(len(names))]
    net = reduce(DataFrame.unionByName, marks).groupBy("chrom", "start").agg(*(F.sum(f"d{i}").alias(f"d{i}") for i in range(len(names)))).where(reduce(lambda a, b: a | b, changed))
    span = [f(F.when(changed[i], F.col("start"))).alias(f"{a}{i}") for i in range(len(names)) for f, a in ((F.min, "lo"), (F.max, "hi"))]
    spans = net.groupBy(F.col("chrom").alias("_chrom")).agg(*span)
    cells = _segments(net, ["chrom"], {f"v{i}": F.col(f"d{i}") for i in range(len(names))}, shard).join(spans, F.col("chrom") == F.col("_chrom"))
    covered = [F.coalesce((F.col("start") >= F.least(F.col(f"lo{i}"), F.lit(0))) & (F.col("end") <= F.col(f"hi{i}")), F.lit(False)) for i in range(len(names))]
    keep = reduce((lambda a, b: a & b) if how == "inner" else (lambda a, b: a | b), covered)
    values = [F.when(c, _scaled(F.round(F.col(f"v{i}"), 9), tracks[n].get("scale", 1.0), tracks[n].get("baseline"))).alias(n) for i, (n, c) in enumerate(zip(names, covered))]
    return cells.where(keep).select("chrom", "start", "end", *values)


def pileup_tags(tags: DataFrame, d: int, shift: int = 0, directional: bool = True, lengths: DataFrame | None = None, scale: float = 1.0, baseline: float | None = None) -> DataFrame:
    """Treatment pileup of tags (directional) or symmetric pileup around their positions."""
    return pileup(clip(tag_intervals(tags, d, shift, directional), lengths), scale=scale, baseline=baseline)


def both_ends(frags: DataFrame, window: int, centred: bool = True) -> DataFrame:
    """Control windows around both ends of fragments ``(chrom, l, r[, cnt])``: ``+-window/2``, clipped at 0, or from ``-window/2``."""
    half = window // 2
    more = [c for c in ("cnt",) if c in frags.columns]
    at = frags.where("chrom is not null and r > l").select("chrom", *more, F.explode(F.array(F.col("l").cast("long"), F.col("r").cast("long"))).alias("_p"))
    right = F.col("_p") + half if centred else F.col("_p") - half + window
    left = F.col("_p") - half
    return at.select("chrom", *more, (F.greatest(left, F.lit(0).cast("long")) if centred else left).alias("l"), right.alias("r"))


def local_lambda(windows: list[tuple[DataFrame, float]], floor: float) -> DataFrame:
    """Local background: the pileup of each ``(intervals, scale)``, raised to ``floor``, and their greatest value everywhere."""
    from tidemark.operators.step import rle

    if len(windows) == 1:
        return pileup(windows[0][0], scale=windows[0][1], baseline=floor)
    tracks = {f"w{i}": {"df": df, "scale": s, "baseline": floor} for i, (df, s) in enumerate(windows)}
    cells = together(tracks, "outer")
    values = [F.coalesce(F.col(n), F.lit(float(floor))) for n in tracks]
    return rle(cells.select("chrom", "start", "end", F.round(F.greatest(*values), 9).alias("value")))


def weighted_by_length(frags: DataFrame, weights: DataFrame, columns: list[str]) -> dict[str, DataFrame]:
    """One weighted pileup per weight column; ``weights`` is (len, columns), one row per fragment length. Unlisted lengths weigh 0."""
    sized = frags.withColumn("len", (F.col("r") - F.col("l")).cast("int")).join(weights, "len", "left")
    unit = F.col("cnt") if "cnt" in frags.columns else F.lit(1)
    return {c: pileup(sized, weight=F.coalesce(F.col(c), F.lit(0.0)) * unit) for c in columns}


def union_all(frames: list[DataFrame]) -> DataFrame:
    """Several inputs as one, by column name."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
