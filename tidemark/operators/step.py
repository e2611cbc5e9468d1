"""Algebra of step functions ``(chrom, start, end, value)``: alignment, overlays, run-length merging, summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import stats
from tidemark.operators.ordered import SHARD, along, equal_runs


def align(tracks: dict[str, DataFrame], how: str = "inner", value: str = "value", shard: int = SHARD) -> DataFrame:
    """``(chrom, start, end, *names)``: all tracks cut at the union of their breakpoints.

    No join: the breakpoints of all tracks are united, folded to one row per position, and every track's value is
    carried along the axis. ``inner`` keeps cells that all tracks cover (so it ends with the shortest track, and names
    missing from a track fall away); ``outer`` keeps cells that any covers, with null where a track has no segment.
    """
    marks = []
    for i, (_, t) in enumerate(tracks.items()):
        rows = t.where("chrom is not null and end > start")
        opened = F.struct(F.col("start").cast("long").alias("start"), F.lit(i).alias("t"), F.lit(1).alias("o"), F.col(value).cast("double").alias("v"))
        closed = F.struct(F.col("end").cast("long").alias("start"), F.lit(i).alias("t"), F.lit(0).alias("o"), F.lit(None).cast("double").alias("v"))
        marks.append(rows.select("chrom", F.inline(F.array(opened, closed))))
    events = reduce(DataFrame.unionByName, marks)
    per = [F.max_by(F.struct("o", "v"), F.when(F.col("t") == i, F.col("o"))).alias(f"m{i}") for i in range(len(tracks))]
    spots = events.groupBy("chrom", "start").agg(*per)
    run = along(spots, ["chrom"], "start", leads={"end": F.col("start")}, fills={f"f{i}": F.col(f"m{i}") for i in range(len(tracks))}, shard=shard, written=False)
    covered = [(F.col(f"f{i}.o") == 1) for i in range(len(tracks))]
    keep = reduce(lambda a, b: a & b, [F.coalesce(c, F.lit(False)) for c in covered]) if how == "inner" else reduce(lambda a, b: a | b, [F.coalesce(c, F.lit(False)) for c in covered])
    return run.where(F.col("end").isNotNull() & keep).select("chrom", "start", "end", *(F.col(f"f{i}.v").alias(n) for i, n in enumerate(tracks)))


def rle(df: DataFrame, columns: list[str] | None = None, tolerance: float = 0.0, shard: int = SHARD) -> DataFrame:
    """Touching neighbours of equal values (within ``tolerance``) as one segment, with the first one's values."""
    columns = columns or ["value"]
    runs = equal_runs(df.select("chrom", "start", "end", *columns), ["chrom"], "start", "end", columns, tolerance, "_run", shard)
    first = [F.min_by(c, "start").alias(c) for c in columns]
    return runs.groupBy("chrom", "_run").agg(F.min("start").alias("start"), F.max("end").alias("end"), *first).drop("_run")


# Reducers of an overlay by name; each takes the tracks' columns.
REDUCERS = {
    "max": lambda x: F.greatest(*x),
    "min": lambda x: F.least(*x),
    "mean": lambda x: reduce(lambda a, b: a + b, x) / len(x),
    "sum": lambda x: reduce(lambda a, b: a + b, x),
    "product": lambda x: reduce(lambda a, b: a * b, x),
    "subtract": lambda x: x[1] - x[0],
    "divide": lambda x: F.try_divide(x[0], x[1]),
    "fisher": lambda x: stats.fisher_log10(x),
}


def overlay(tracks: list[DataFrame], func: str = "max") -> DataFrame:
    """Several tracks reduced to one; ``subtract`` is second minus first, ``divide`` first by second (null at 0).

    Values that agree to 9 decimals are equal when neighbours merge.
    """
    names = [f"t{i}" for i in range(len(tracks))]
    if func in ("subtract", "divide") and len(tracks) != 2:
        raise ValueError(f"{func} takes two tracks")
    cells = align(dict(zip(names, tracks)))
    return rle(cells.select("chrom", "start", "end", F.round(REDUCERS[func]([F.col(n) for n in names]), 9).alias("value")))


def apply(df: DataFrame, func, column: str = "value") -> DataFrame:
    """Values mapped by a Column function."""
    return df.withColumn(column, func(F.col(column)))


#: Operations with one number on a track.
OPS = {"multiply": lambda v, k: v * k, "add": lambda v, k: v + k, "max": lambda v, k: F.greatest(v, F.lit(k)), "min": lambda v, k: F.least(v, F.lit(k))}


def operate(df: DataFrame, op: str, k: float = 0.0) -> DataFrame:
    """A track after ``multiply``, ``add``, ``max``, ``min`` with a number, or ``p2q``."""
    return p2q(df) if op == "p2q" else apply(df, lambda v: OPS[op](v, float(k)))


def below_to_baseline(df: DataFrame, cutoff: float, baseline: float = 0.0) -> DataFrame:
    """Values under the cutoff set to the baseline, then neighbours merged."""
    return rle(apply(df, lambda v: F.when(v < cutoff, F.lit(float(baseline))).otherwise(v)))


def above(df: DataFrame, cutoff: float) -> DataFrame:
    """The segments above the cutoff."""
    return df.where(F.col("value") > cutoff)


def scale_clip(df: DataFrame, scale: float, floor: float) -> DataFrame:
    return apply(df, lambda v: F.greatest(v * float(scale), F.lit(float(floor))))


def constant(df: DataFrame, value: float) -> DataFrame:
    """One segment from 0 to the track's end per chrom."""
    return df.groupBy("chrom").agg(F.max("end").alias("end")).select("chrom", F.lit(0).cast("long").alias("start"), "end", F.lit(float(value)).alias("value"))


def summary(df: DataFrame) -> DataFrame:
    """One row ``(total, bases, max, min, mean, std)``, weighted by length; nulls for an empty track."""
    n = (F.col("end") - F.col("start")).cast("double")
    moments = df.agg(F.sum(F.col("value") * n).alias("total"), F.sum(F.col("end") - F.col("start")).alias("bases"), F.max("value").alias("max"), F.min("value").alias("min"), F.sum(F.col("value") * F.col("value") * n).alias("_sq"))
    mean = F.col("total") / F.col("bases")
    return moments.select("total", "bases", "max", "min", mean.alias("mean"), F.sqrt(F.greatest(F.lit(0.0), F.col("_sq") / F.col("bases") - mean * mean)).alias("std"))


def p2q(df: DataFrame) -> DataFrame:
    """Scores less log10 of the covered length, not below 0: the rank of a score is not counted here; see ``qvalue.table``."""
    total = df.agg(F.sum(F.col("end") - F.col("start")).alias("_n"))
    return df.crossJoin(F.broadcast(total)).withColumn("value", F.greatest(F.lit(0.0), F.col("value") - F.log10("_n"))).drop("_n")  # one row


def weighted_mean(value: Column, start: str = "start", end: str = "end") -> Column:
    """Aggregate: mean by length."""
    n = F.col(end) - F.col(start)
    return F.sum(value * n) / F.sum(n)


def median_by_length(df: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, median)``: the value at half of the length, segments ordered by value."""
    from tidemark.operators.skew import weighted_percentile

    freq = df.groupBy(*keys, "value").agg(F.sum(F.col("end") - F.col("start")).alias("w"))
    return weighted_percentile(freq, keys, "value", [0.5]).select(*keys, F.col("value").alias("median"))


def sample_many(signals: dict[str, DataFrame], points: DataFrame, pos: str = "bin_end", shard: int = SHARD) -> DataFrame:
    """``points`` with one column per signal: its value at position ``pos - 1`` (the segment that covers the bin's last base); null outside.

    Distinct positions are asked once, whatever repeats there, all signals are carried along in one pass, and the answers
    are joined back; a point with a null chrom or position has null everywhere.
    """
    spots = points.where(F.col("chrom").isNotNull() & F.col(pos).isNotNull()).select("chrom", F.col(pos).cast("long").alias("_p")).distinct()
    kind = "struct<v:double,e:bigint>"
    names = list(signals)
    asked = spots.select("chrom", (F.col("_p") - 1).alias("start"), F.lit(1).alias("_k"), *(F.lit(None).cast(kind).alias(f"_g{i}") for i in range(len(names))))
    rows = [asked]
    for i, n in enumerate(names):
        seg = F.struct(F.col("value").cast("double").alias("v"), F.col("end").cast("long").alias("e"))
        rows.append(signals[n].where("end > start").select("chrom", F.col("start").cast("long").alias("start"), F.lit(0).alias("_k"), *((seg if k == i else F.lit(None).cast(kind)).alias(f"_g{k}") for k in range(len(names)))))
    run = along(reduce(DataFrame.unionByName, rows), ["chrom"], "start", ties=["_k"], fills={f"_f{i}": F.col(f"_g{i}") for i in range(len(names))}, shard=shard).where("_k = 1")
    values = run.select(F.col("chrom").alias("_c"), (F.col("start") + 1).alias("_p"), *(F.when(F.col(f"_f{i}.e") > F.col("start"), F.col(f"_f{i}.v")).alias(f"_v{i}") for i in range(len(names))))
    return points.join(values, (F.col("chrom") == F.col("_c")) & (F.col(pos) == F.col("_p")), "left").select(*points.columns, *(F.col(f"_v{i}").alias(n) for i, n in enumerate(names)))


def sample_at(signal: DataFrame, points: DataFrame, pos: str = "bin_end", shard: int = SHARD) -> DataFrame:
    """``points`` with the signal's ``value`` at position ``pos - 1``; null outside."""
    return sample_many({"value": signal}, points, pos, shard)


def elbows(table: DataFrame, threshold: float = 0.01, x: str = "cutoff", y: str = "value") -> DataFrame:
    """Rows of a cutoff table where the slope changes by more than ``threshold`` (a table of at most some hundred rows)."""
    w = Window.orderBy(x)
    slope = table.withColumn("_d", F.col(y) - F.lag(y).over(w))
    return slope.withColumn("_c", F.abs(F.col("_d") - F.lag("_d").over(w))).where(F.col("_c") > threshold).drop("_d", "_c")
