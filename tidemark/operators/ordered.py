"""Ordered computations along an axis that stay balanced on hot keys: local windows in shards, carries across them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.plans.tables import stage

#: Axis units per shard. A task holds at most one shard's rows of a key; shard summaries meet per key.
SHARD = 1 << 16


def _shard(pos: str, shard: int) -> Column:
    return F.floor(F.col(pos) / shard).cast("long").alias("_s")


def _beside(rows: DataFrame, summary: DataFrame, keys: list[str], carry: list[Column]) -> DataFrame:
    """Rows with the carries of their shard; null keys match."""
    named = summary.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col("_s").alias("_ks"), *carry)
    on = F.col("_s") == F.col("_ks")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return rows.join(named, on)


def along(
    df: DataFrame,
    keys: list[str],
    pos: str,
    *,
    ties: list[str] | None = None,
    sums: dict[str, Column] | None = None,
    lags: dict[str, Column] | None = None,
    leads: dict[str, Column] | None = None,
    reach: dict[str, Column] | None = None,
    fills: dict[str, Column] | None = None,
    shard: int = SHARD,
    written: bool = True,
) -> DataFrame:
    """``df`` with columns computed along ``pos`` within ``keys``.

    ``sums`` are running sums up to the row, ``lags``/``leads`` the previous and next row's value, ``reach`` the greatest
    value of all rows before, ``fills`` the last non-null value up to the row. Each is a window inside (keys, shard of
    pos), combined with a carry from a window over one summary row per shard. Rows with a null key form a key of their
    own; rows of equal ``pos`` share a shard and are ordered by ``ties``.

    Rows and summaries both read the input, so it is written before; with ``written=False`` it is not: for an input that
    is a written table, or that ends in an aggregation all of whose columns are used, whose exchange Spark reuses.
    """
    sums, lags, leads, reach, fills = sums or {}, lags or {}, leads or {}, reach or {}, fills or {}
    order = [pos, *(ties or [])]
    ins = {f"_in_{n}": c for part in (sums, lags, leads, reach, fills) for n, c in part.items()}
    base = df.select("*", _shard(pos, shard), *(c.alias(n) for n, c in ins.items()))
    base = stage(base, "along") if written else base
    w = Window.partitionBy(*keys, "_s").orderBy(*order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    local = {n: F.sum(f"_in_{n}").over(upto) for n in sums}
    local |= {n: F.lag(F.struct(f"_in_{n}")).over(w) for n in lags} | {n: F.lead(F.struct(f"_in_{n}")).over(w) for n in leads}
    local |= {n: F.max(f"_in_{n}").over(before) for n in reach} | {n: F.last(f"_in_{n}", True).over(upto) for n in fills}
    spot = F.struct(*order)
    totals = [F.sum(f"_in_{n}").alias(f"_t_{n}") for n in sums] + [F.max(f"_in_{n}").alias(f"_t_{n}") for n in reach]
    totals += [F.max_by(F.struct(f"_in_{n}"), spot).alias(f"_t_{n}") for n in lags] + [F.min_by(F.struct(f"_in_{n}"), spot).alias(f"_t_{n}") for n in leads]
    totals += [F.max_by(f"_in_{n}", F.when(F.col(f"_in_{n}").isNotNull(), spot)).alias(f"_t_{n}") for n in fills]
    wk = Window.partitionBy(*keys).orderBy("_s")
    prior = wk.rowsBetween(Window.unboundedPreceding, -1)
    summary = base.groupBy(*keys, "_s").agg(*(totals or [F.count("*").alias("_n")]))
    carry = [F.sum(f"_t_{n}").over(prior).alias(f"_c_{n}") for n in sums] + [F.max(f"_t_{n}").over(prior).alias(f"_c_{n}") for n in reach]
    carry += [F.lag(f"_t_{n}").over(wk).alias(f"_c_{n}") for n in lags] + [F.lead(f"_t_{n}").over(wk).alias(f"_c_{n}") for n in leads]
    carry += [F.last(f"_t_{n}", True).over(prior).alias(f"_c_{n}") for n in fills]
    both = _beside(base.select("*", *(c.alias(f"_l_{n}") for n, c in local.items())), summary, keys, carry)
    out = {n: F.col(f"_l_{n}") + F.coalesce(F.col(f"_c_{n}"), F.lit(0)) for n in sums}
    out |= {n: F.coalesce(f"_l_{n}", f"_c_{n}")[f"_in_{n}"] for n in (*lags, *leads)}
    out |= {n: F.greatest(f"_l_{n}", f"_c_{n}") for n in reach} | {n: F.coalesce(f"_l_{n}", f"_c_{n}") for n in fills}
    return both.select(*(F.col(c) for c in df.columns if c not in out), *(c.alias(n) for n, c in out.items()))


def islands(df: DataFrame, keys: list[str], start: str, end: str, max_gap: int = 0, name: str = "island", shard: int = SHARD, written: bool = True) -> DataFrame:
    """``df`` with the island of each row: it joins the island before it if it starts at most ``max_gap`` after its reach.

    Rows may overlap or nest. An island is named by its start, which no other island of the key has.

    One pass: inside a shard a row opens an island as far as the shard's own rows tell. It truly does if it also starts
    beyond the reach of all shards before; the last of the openers up to a row is the greatest, so it alone is compared.
    """
    w = Window.partitionBy(*keys, "_s").orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(reach.isNull() | (F.col(start) - reach > max_gap), F.col(start))
    local = df.select("*", _shard(start, shard)).withColumn("_own", opens).withColumn("_at", F.max("_own").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_own")
    local = stage(local, "islands") if written else local
    prior = Window.partitionBy(*keys).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    summary = local.groupBy(*keys, "_s").agg(F.max(end).alias("_r"), F.max("_at").alias("_l")).withColumn("_reach", F.max("_r").over(prior))
    alone = lambda c: F.col("_reach").isNull() | (F.col(c) - F.col("_reach") > max_gap)
    both = _beside(local, summary, keys, [F.col("_reach"), F.last(F.when(alone("_l"), F.col("_l")), True).over(prior).alias("_open")])
    return both.select(*df.columns, F.when(alone("_at"), F.col("_at")).otherwise(F.col("_open")).alias(name))


def equal_runs(df: DataFrame, keys: list[str], start: str, end: str, columns: list[str], tolerance: float = 0.0, name: str = "run", shard: int = SHARD, written: bool = True) -> DataFrame:
    """``df`` of disjoint rows with the run of each: it joins the row before it if that one ends where it starts and has
    equal ``columns`` (nulls are equal; numbers within ``tolerance``). A run is named by its start.

    One pass: only the first row of a shard is compared with the row that the shard before ends with.
    """
    w = Window.partitionBy(*keys, "_s").orderBy(start)
    row = lambda *more: F.struct(*more, *(F.col(c).alias(f"v{i}") for i, c in enumerate(columns)))

    def joins(prev: Column, at: Column, values: list[Column]) -> Column:
        same = prev["e"] == at
        for i, v in enumerate(values):
            same = same & (F.abs(prev[f"v{i}"] - v) <= tolerance if tolerance else prev[f"v{i}"].eqNullSafe(v))
        return F.coalesce(same, F.lit(False))

    prev = F.lag(row(F.col(end).alias("e"))).over(w)
    local = df.select("*", _shard(start, shard)).withColumn("_prev", prev)
    local = local.withColumn("_own", F.when(~joins(F.col("_prev"), F.col(start), [F.col(c) for c in columns]), F.col(start))).withColumn("_at", F.max("_own").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_prev", "_own")
    local = stage(local, "runs") if written else local
    wk = Window.partitionBy(*keys).orderBy("_s")
    ends = local.groupBy(*keys, "_s").agg(F.min_by(row(F.col(start).alias("s")), start).alias("_f"), F.max_by(row(F.col(end).alias("e")), start).alias("_z"), F.max("_at").alias("_l"))
    goes_on = joins(F.lag("_z").over(wk), F.col("_f.s"), [F.col(f"_f.v{i}") for i in range(len(columns))])
    summary = ends.withColumn("_on", goes_on).withColumn("_open", F.when(~F.col("_on") | (F.col("_l") > F.col("_f.s")), F.col("_l")))
    carry = [F.col("_f.s").alias("_first"), F.col("_on"), F.last("_open", True).over(wk.rowsBetween(Window.unboundedPreceding, -1)).alias("_before")]
    both = _beside(local, summary, keys, carry)
    return both.select(*df.columns, F.when(F.col("_on") & (F.col("_at") == F.col("_first")), F.col("_before")).otherwise(F.col("_at")).alias(name))
