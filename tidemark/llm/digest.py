"""Percentiles from mergeable centroid digests, with a certified rank error."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.plans.tables import stage

QUANTILES = (0.05, 0.25, 0.5, 0.75, 0.95, 0.99)
#: Clusters of a digest (at most DELTA + 1 centroids); a cluster at quantile q holds about pi * sqrt(q (1-q)) / DELTA of the rows.
DELTA = 200
#: Rows of one leaf digest; larger groups are split into leaves by a hash of the ident.
LEAF_ROWS = 200_000
#: So many leaf digests at most are merged in one step.
FAN_IN = 64


def bound(q: Column, delta: int = DELTA) -> Column:
    """The rank error, as a share of the rows, that ``percentiles`` keeps: the size of a cluster at quantile q."""
    return math.pi * F.sqrt(q * (1 - q)) / delta


def _cluster(q: Column, delta: int) -> Column:
    """The quantile-dependent size function k1: narrow clusters at both ends, wide ones in the middle."""
    return F.floor((F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 2 * q - 1))) / math.pi + 0.5) * delta).cast("int")


def merge(centroids: DataFrame, keys: list[str], delta: int = DELTA) -> DataFrame:
    """Centroids ``(keys, m, w, lo, hi)`` of several digests re-clustered into one digest per ``keys``."""
    by = Window.partitionBy(*keys).orderBy("m", "w", "lo", "hi")
    total = F.sum("w").over(Window.partitionBy(*keys))
    mid = (F.sum("w").over(by.rowsBetween(Window.unboundedPreceding, 0)) - F.col("w") / 2) / total
    return (
        centroids.withColumn("c", _cluster(mid, delta))
        .groupBy(*keys, "c")
        .agg((F.sum(F.col("m") * F.col("w")) / F.sum("w")).alias("m"), F.sum("w").alias("w"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        .drop("c")
    )


def _spread(rows: DataFrame, per_key: DataFrame, keys: list[str], n: str, ident: str, leaf_rows: int) -> DataFrame:
    """``rows`` beside the one row of ``per_key`` of their key, which holds the key's size ``n``.

    A key of more than ``leaf_rows`` rows is salted and its row repeated per salt, so a hot key spreads over tasks.
    """
    sized = per_key.withColumn("salts", F.ceil(F.col(n) / leaf_rows).cast("long"))
    large = sized.where(F.col("salts") > 1).select(*keys, "salts")
    salt = F.coalesce(F.pmod(F.xxhash64(ident), F.col("salts")), F.lit(0).cast("long"))
    salted = rows.join(large, keys, "left").withColumn("salt", salt).drop("salts")
    return salted.join(sized.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1))).drop("salts"), [*keys, "salt"]).drop("salt")


def digests(values: DataFrame, keys: list[str], leaf_keys: list[str], ident: str = "i", delta: int = DELTA, leaf_rows: int = LEAF_ROWS, fan_in: int = FAN_IN) -> DataFrame:
    """A digest ``(keys, leaf_keys, m, w, lo, hi)`` per group from rows ``(keys, leaf_keys, ident, v)``; read ``values`` from a written table.

    A group of more than ``leaf_rows`` rows is cut into leaves by a hash of the ident, so no task sorts a hot group; its
    leaves are then merged by re-clustering, at most ``fan_in`` in a step.
    """
    group = [*keys, *leaf_keys]
    sizes = values.groupBy(*group).agg(F.count("*").alias("n")).where(F.col("n") > leaf_rows)
    large = sizes.select(*group, F.ceil(F.col("n") / leaf_rows).cast("long").alias("leaves"))
    most = large.agg(F.max("leaves").alias("x")).first()["x"] or 1
    cells = values.select(*group, ident, F.col("v").alias("m"), F.lit(1).cast("long").alias("w"), F.col("v").alias("lo"), F.col("v").alias("hi"))
    if most == 1:
        return merge(cells.drop(ident), group, delta)
    split = cells.join(large, group, "left").withColumn("leaf", F.pmod(F.xxhash64(ident), F.coalesce("leaves", F.lit(1).cast("long"))))
    level = stage(merge(split.withColumn("cut", F.col("leaves").isNotNull()).drop("leaves", ident), [*group, "leaf", "cut"], delta), "digest-leaves")
    whole, parts = level.where("not cut").drop("leaf", "cut"), level.where("cut").drop("cut")
    while most > 1:
        parts = merge(parts.withColumn("leaf", F.floor(F.col("leaf") / fan_in)), [*group, "leaf"], delta)
        most = -(-most // fan_in)
    return whole.unionByName(parts.drop("leaf"))


def _ranked(digest: DataFrame, keys: list[str]) -> DataFrame:
    """Centroids with the rows up to and with each, and the digest's size ``n``."""
    by = Window.partitionBy(*keys).orderBy("m", "w", "lo", "hi")
    upto = F.sum("w").over(by.rowsBetween(Window.unboundedPreceding, 0))
    return digest.withColumn("upto", upto).withColumn("n", F.sum("w").over(Window.partitionBy(*keys)))


def _inside(need: Column) -> tuple[Column, Column]:
    """Whether a centroid holds rank ``need``, and the value there: its own, or interpolated between its bounds."""
    into = (need - (F.col("upto") - F.col("w"))) / F.col("w")  # (0, 1] in the cluster that holds the wanted rank
    near = F.when(into <= 0.5, F.col("lo") + (F.col("m") - F.col("lo")) * 2 * into).otherwise(F.col("m") + (F.col("hi") - F.col("m")) * (2 * into - 1))
    return (into > 0) & (into <= 1), F.when(F.col("w") == 1, F.col("m")).otherwise(near)


def _need(q: Column, n: Column) -> Column:
    """The rank of a percentile, from 1."""
    return F.greatest(F.lit(1.0), F.ceil(q * n).cast("double"))


def estimate(digest: DataFrame, keys: list[str], qs: tuple[float, ...] = QUANTILES) -> DataFrame:
    """``(keys, n, q, value)``: a single-row cluster gives its value, a wider one is interpolated between its bounds."""
    holds, value = _inside(_need(F.col("q"), F.col("n")))
    return _ranked(digest, keys).select("*", F.explode(F.array(*map(F.lit, qs))).alias("q")).where(holds).select(*keys, "n", "q", value.alias("value"))


def _error(below: Column, upto: Column) -> Column:
    """Distance of the wanted rank ``q*n`` to the ranks that a value takes, as a share of ``n``."""
    want = F.col("q") * F.col("n")
    return F.greatest(F.lit(0.0), below - want, want - upto) / F.col("n")


def certify(values: DataFrame, estimates: DataFrame, keys: list[str], ident: str = "i", leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """``(keys, n, q, value, below, upto, rank_error)``: a second pass counts the rows below and up to each estimate.

    The error is 0 where the estimate is an exact percentile. Hot keys spread over tasks; counts fold before they move.
    """
    wide = estimates.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("q", "value"))).alias("e"), F.max("n").alias("n"))
    joined = _spread(values.select(*keys, ident, "v"), wide, keys, "n", ident, leaf_rows)
    # Bucket of the row among the sorted estimates: how many lie below it, and how many at or below.
    over = F.size(F.filter("e", lambda x: x["value"] < F.col("v")))
    level = F.size(F.filter("e", lambda x: x["value"] <= F.col("v")))
    hist = joined.groupBy(*keys, over.alias("over"), level.alias("level")).agg(F.count("*").alias("c"))
    per = hist.groupBy(*keys).agg(F.collect_list(F.struct("over", "level", "c")).alias("h"))
    flat = estimates.join(per, keys)
    pos = F.col("at")
    # Estimates of a key may come out of order where clusters overlap; the buckets count them by value.
    flat = flat.withColumn("at", F.row_number().over(Window.partitionBy(*keys).orderBy("value", "q")))
    add = lambda acc, x: acc + x["c"]
    zero = F.lit(0).cast("long")
    # A row is below estimate number `at` if fewer than `at` estimates lie at or below it.
    below = F.aggregate(F.filter("h", lambda x: x["level"] < pos), zero, add)
    upto = F.aggregate(F.filter("h", lambda x: x["over"] < pos), zero, add)
    counted = flat.select(*keys, "n", "q", "value", below.alias("below"), upto.alias("upto"))
    return counted.withColumn("rank_error", _error(F.col("below"), F.col("upto")))


def resolve(values: DataFrame, certified: DataFrame, keys: list[str], ident: str = "i", delta: int = DELTA, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """``certified`` with every estimate within ``bound``: those beyond it are narrowed down by digests of the rows between
    the two counted values around the wanted rank, and counted again, until none is left.

    A bracket excludes its ends, so each round leaves fewer values in it.
    """
    by = [*keys, "q"]
    done, known, beyond = certified, certified, F.col("rank_error") > bound(F.col("q"), delta)
    while not (wrong := done.where(beyond)).isEmpty():
        probes = known.select(*keys, F.col("value").alias("x"), F.col("below").alias("x_below"), F.col("upto").alias("x_upto"))
        need = _need(F.col("q"), F.col("n"))
        under, above = F.col("x_upto") < need, F.col("x_below") >= need
        ends = wrong.select(*by, "n").join(probes, keys).groupBy(*by, "n").agg(F.max(F.when(under, F.col("x"))).alias("a"), F.min(F.when(above, F.col("x"))).alias("b"), F.coalesce(F.max(F.when(under, F.col("x_upto"))), F.lit(0)).alias("base"))
        brackets = ends.groupBy(*keys).agg(F.max("n").alias("n"), F.collect_list(F.struct("q", "a", "b", "base")).alias("e"))
        near = _spread(values.select(*keys, ident, "v"), brackets, keys, "n", ident, leaf_rows)
        near = near.select(*keys, ident, "v", "n", F.inline("e")).where((F.col("a").isNull() | (F.col("v") > F.col("a"))) & (F.col("b").isNull() | (F.col("v") < F.col("b"))))
        near = stage(near, "digest-near")
        inner = _ranked(merge(digests(near, by, [], ident, delta, leaf_rows), by, delta), by).drop("n")
        holds, value = _inside(_need(F.col("q"), F.col("n")) - F.col("base"))
        again = inner.join(ends, by).where(holds).select(*by, value.alias("value"))
        counted = near.join(again, by).groupBy(*by, "n", "base", "value").agg(F.count_if(F.col("v") < F.col("value")).alias("c"), F.count_if(F.col("v") <= F.col("value")).alias("d"))
        counted = counted.select(*keys, "n", "q", "value", (F.col("base") + F.col("c")).alias("below"), (F.col("base") + F.col("d")).alias("upto"))
        counted = stage(counted.withColumn("rank_error", _error(F.col("below"), F.col("upto"))), "digest-resolved")
        done = done.join(counted.select(*by), by, "left_anti").unionByName(counted)
        known = known.unionByName(counted)
    return done


def usable(df: DataFrame, group: str, metrics: list[str], ident: str, day: str) -> DataFrame:
    """``(g, metric, day, i, v)``: each ident once under its first day, without null, NaN, infinite and negative values.

    Null groups and null idents take no part; a null day counts as 1970-01-01. Rows that repeat an ident with other
    values count as the one with the smallest values (in the order of ``metrics``).
    """
    rows = df.where(F.col(group).isNotNull() & F.col(ident).isNotNull())
    cols = [F.col(m).cast("double").alias(f"m{k}") for k, m in enumerate(metrics)]
    rows = rows.select(F.col(group).alias("g"), F.col(ident).alias("i"), F.coalesce(F.to_date(F.col(day)), F.to_date(F.lit("1970-01-01"))).alias("day"), *cols)
    names = [f"m{k}" for k in range(len(metrics))]
    once = rows.groupBy("i", "g", *names).agg(F.min("day").alias("day"))
    pairs = F.array(*(F.struct(F.lit(m).alias("metric"), F.col(f"m{k}").alias("v")) for k, m in enumerate(metrics)))
    long = once.select("g", "i", "day", F.inline(pairs)).withColumn("v", F.col("v") + F.lit(0.0))
    return long.where(F.col("v").isNotNull() & ~F.isnan("v") & (F.col("v") >= 0) & (F.col("v") < float("inf")))


def daily_digests(df: DataFrame, group: str, metrics: list[str], ident: str, day: str, delta: int = DELTA) -> DataFrame:
    """``(group, metric, day, m, w, lo, hi)``: one digest a day, to be kept and merged over any days."""
    return digests(stage(usable(df, group, metrics, ident, day), "digest-values"), ["g", "metric"], ["day"], delta=delta).withColumnRenamed("g", group)


def percentiles(df: DataFrame, group: str, metrics: list[str], ident: str, day: str, qs: tuple[float, ...] = QUANTILES, delta: int = DELTA, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """``(group, metric, n, q, value, rank_error)``: day digests merged per group, estimated, counted and, where beyond the bound, narrowed down.

    Every ``rank_error`` is counted and at most ``pi * sqrt(q (1-q)) / delta``, over however many days and leaves, whose
    overlapping clusters alone would not keep it. Of a day at most ``delta + 1`` rows of a key meet. Empty tables give no rows.
    """
    values = stage(usable(df, group, metrics, ident, day), "digest-values")
    keys = ["g", "metric"]
    days = digests(values, keys, ["day"], delta=delta, leaf_rows=leaf_rows)
    found = stage(estimate(merge(days, keys, delta), keys, qs), "digest-estimates")
    counted = stage(certify(values, found, keys, leaf_rows=leaf_rows), "digest-counted")
    return resolve(values, counted, keys, delta=delta, leaf_rows=leaf_rows).drop("below", "upto").withColumnRenamed("g", group)
