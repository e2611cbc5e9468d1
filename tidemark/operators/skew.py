"""Per-key profiles that stay balanced when a few keys hold most rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Positions per shard of the sweep. One shard holds at most SHARD x (distinct lengths) compressed rows.
SHARD = 1 << 14


def value_frequencies(df: DataFrame, keys: list[str | Column], values: list[str | Column], ident: str | Column | None = None) -> DataFrame:
    """Rows of ``(keys, values, w)``: how often each value occurs under each key.

    Grouping by key *and* value before key spreads a hot key over as many tasks as it has values, and the map-side
    combine folds a hot value to one row per task. With ``ident``, rows that repeat an ident under the same key and
    value count once and rows without ident are left out; a null key or value is a value like any other.
    """
    cols = [F.col(c) if isinstance(c, str) else c for c in (*keys, *values)]
    names = [f"k{i}" for i in range(len(keys))] + [f"v{i}" for i in range(len(values))]
    rows = df.select(*(c.alias(n) for c, n in zip(cols, names)), *([(F.col(ident) if isinstance(ident, str) else ident).alias("ident")] if ident is not None else []))
    if ident is not None:
        rows = rows.where("ident is not null").distinct()
    return rows.groupBy(*names).agg(F.count("*").alias("w"))


def weighted_distinct(freq: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, n, n_distinct)`` from value frequencies; each frequency row is one distinct value."""
    return freq.groupBy(*keys).agg(F.sum("w").alias("n"), F.count("*").alias("n_distinct"))


def weighted_mode(freq: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``(keys, mode, w)``: the most frequent value of each key, the smallest of equally frequent ones."""
    best = F.max(F.struct("w", F.struct((-F.col(value)).alias("neg")).alias("o"))).alias("b")
    return freq.where(F.col(value).isNotNull()).groupBy(*keys).agg(best).select(*keys, (-F.col("b.o.neg")).alias("mode"), F.col("b.w").alias("w"))


def weighted_percentile(freq: DataFrame, keys: list[str], value: str, qs: list[float], shards: int = 256) -> DataFrame:
    """``(keys, q, value)``: exact inverse-CDF percentiles (smallest value with cumulative weight >= q*n).

    A hot key is split into ``shards`` value ranges of its own span; only shard totals meet in one task per key, and
    each percentile is then looked up in the one shard that holds it. Nulls take no part; an empty input gives no rows.
    """
    rows = freq.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v"), "w")
    span = rows.groupBy(*keys).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    on = [F.col(f"r.{k}").eqNullSafe(F.col(f"s.{k}")) for k in keys]
    width = (F.col("_hi") - F.col("_lo")) / shards
    placed = rows.alias("r").join(span.alias("s"), on).select(*(F.col(f"r.{k}") for k in keys), "_v", "w", F.when(width > 0, F.least(F.floor((F.col("_v") - F.col("_lo")) / width), F.lit(shards - 1))).otherwise(0).cast("int").alias("_s"))
    totals = placed.groupBy(*keys, "_s").agg(F.sum("w").alias("_t"))
    over = Window.partitionBy(*keys).orderBy("_s")
    base = totals.select(*keys, "_s", F.coalesce(F.sum("_t").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"), "_t", F.sum("_t").over(Window.partitionBy(*keys)).alias("_n"))
    want = base.select("*", F.explode(F.array(*map(F.lit, qs))).alias("q")).withColumn("_need", F.greatest(F.lit(1), F.ceil(F.col("q") * F.col("_n"))))
    want = want.where((F.col("_need") > F.col("_b")) & (F.col("_need") <= F.col("_b") + F.col("_t")))
    local = placed.withColumn("_c", F.sum("w").over(Window.partitionBy(*keys, "_s").orderBy("_v")))
    on = [F.col(f"p.{k}").eqNullSafe(F.col(f"t.{k}")) for k in keys] + [F.col("p._s") == F.col("t._s")]
    hit = local.alias("p").join(want.alias("t"), on).where(F.col("_b") + F.col("_c") >= F.col("_need"))
    return hit.groupBy(*(F.col(f"p.{k}").alias(k) for k in keys), "q").agg(F.min("_v").alias("value"))


def key_profile(df: DataFrame, key: str = "chrom", lo: str = "l", hi: str = "r", ident: str = "frag_id", shard: int = SHARD) -> DataFrame:
    """``(key, n_frag, n_loc, max_depth)``: size, distinct intervals and greatest depth of every key.

    Valid rows have key, lo, hi and ident, and ``hi > lo``; each ident counts once. Rows are compressed to one row per
    (key, lo, hi) first; the depth is a prefix sum of net changes inside fixed position shards, and only one total per
    shard meets in a task per key. Keys without a valid row do not appear; an empty table gives no rows.
    """
    rows = df.where(F.col(key).isNotNull() & F.col(lo).isNotNull() & (F.col(hi) > F.col(lo)))
    locs = value_frequencies(rows, [key], [F.col(lo).cast("long"), F.col(hi).cast("long")], ident)
    at = lambda c: F.floor(F.col(c) / shard).cast("long").alias("shard")
    zero = F.lit(0).cast("long")
    events = locs.select(
        "k0",
        F.inline(F.array(
            F.struct(at("v0"), F.col("v0").alias("pos"), F.col("w").alias("w_in"), zero.alias("w_out"), F.lit(1).cast("long").alias("n")),
            F.struct(at("v1"), F.col("v1").alias("pos"), zero.alias("w_in"), F.col("w").alias("w_out"), zero.alias("n")),
        )),
    )
    events = events.repartition("k0", "shard").groupBy("k0", "shard", "pos").agg(F.sum("w_in").alias("w_in"), F.sum("w_out").alias("w_out"), F.sum("n").alias("n"))
    run = F.sum(F.col("w_in") - F.col("w_out")).over(Window.partitionBy("k0", "shard").orderBy("pos"))
    shards = events.withColumn("run", run).groupBy("k0", "shard").agg(
        F.sum(F.col("w_in") - F.col("w_out")).alias("net"), F.max("run").alias("top"), F.sum("w_in").alias("w"), F.sum("n").alias("n")
    )
    before = F.coalesce(F.sum("net").over(Window.partitionBy("k0").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), zero)
    return shards.withColumn("depth", before + F.col("top")).groupBy(F.col("k0").alias(key)).agg(
        F.sum("w").alias("n_frag"), F.sum("n").alias("n_loc"), F.max("depth").alias("max_depth")
    )
