"""Continuous periods and gaps of intervals per entity, by two-level merging."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Shards of the axis. An entity's boundary rows (at most three a shard) are all that meets in one task.
SHARDS = 1 << 12
_EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"
#: Types an axis may have: how they become whole numbers, and back.
AXES = {
    "tinyint": ("cast({c} as bigint)", "cast({c} as tinyint)"),
    "smallint": ("cast({c} as bigint)", "cast({c} as smallint)"),
    "int": ("cast({c} as bigint)", "cast({c} as int)"),
    "bigint": ("{c}", "{c}"),
    "date": ("cast(unix_date({c}) as bigint)", "date_from_unix_date(cast({c} as int))"),
    "timestamp": ("unix_micros({c})", "timestamp_micros({c})"),
    "timestamp_ntz": (f"timestampdiff(MICROSECOND, {_EPOCH}, {{c}})", f"{_EPOCH} + make_dt_interval(0, 0, 0, cast({{c}} div 1000000 as decimal(18, 0))) + make_dt_interval(0, 0, 0, cast({{c}} % 1000000 as decimal(18, 0)) / 1000000)"),
}


def periods_and_gaps(df: DataFrame, entity: list[str], start: str, end: str, shard: int | None = None) -> DataFrame:
    """``(entity, kind, seg_start, seg_end)`` with kind ``period`` or ``gap``; the ends have the type of ``start``.

    The axis may be of whole numbers, dates or timestamps. Rows with a null entity column, start or end, or ``end <=
    start``, take no part. Intervals that overlap or touch join; repeated rows change nothing; a lone interval is a
    period; an empty table gives no rows.

    Without ``shard`` its width is the greater of the axis in ``SHARDS`` parts and the mean interval, from one pass over
    the two columns: so all rows together have at most two pieces each on average, and one at most ``SHARDS`` + 1.

    1. Clip every interval to position shards and keep the longest piece of each (entity, shard, start): at most one
       row per start position, folded before the shuffle.
    2. Merge inside each shard. Segments that touch no shard edge and lie between others are final, as are the gaps
       inside a shard.
    3. Only the first, the last and the edge-touching segments of each shard meet per entity, where they are joined
       across edges and the gaps between shards come out.
    """
    keys = [f"e{i}" for i in range(len(entity))]
    kinds = [dict(df.dtypes)[c] for c in (start, end)]
    if not set(kinds) <= set(AXES):
        raise TypeError(f"no axis of type {kinds}: {', '.join(AXES)} are")
    number = [F.expr(AXES[t][0].format(c=f"`{c}`")) for t, c in zip(kinds, (start, end))]
    rows = df.select(*(F.col(c).alias(k) for c, k in zip(entity, keys)), number[0].alias("s"), number[1].alias("e"))
    ok = F.col("e") > F.col("s")
    for k in keys:
        ok = ok & F.col(k).isNotNull()
    if shard is None:
        a = rows.where(ok).agg(F.min("s").alias("lo"), F.max("e").alias("hi"), F.avg((F.col("e") - F.col("s")).cast("double")).alias("mean")).first()
        shard = 1 if a["lo"] is None else max(1, -(-(a["hi"] - a["lo"]) // SHARDS), math.ceil(a["mean"]))
    size = F.lit(shard).cast("long")
    cell = lambda c: F.expr(f"({c} - pmod({c}, {shard}L)) div {shard}L")  # noqa: E731  whole numbers: doubles would lose microseconds
    first, last = cell("s"), cell("(e - 1)")
    pieces = (
        rows.where(ok)
        .select("*", F.explode(F.sequence(first, last)).alias("sh"))
        .select(*keys, "sh", F.greatest("s", F.col("sh") * size).alias("s"), F.least("e", (F.col("sh") + 1) * size).alias("e"))
        .groupBy(*keys, "sh", "s")
        .agg(F.max("e").alias("e"))
    )
    w = Window.partitionBy(*keys, "sh").orderBy("s")
    reach = F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1))
    merged = (
        pieces.repartition(*keys, "sh")
        .withColumn("reach", reach)
        .withColumn("isle", F.sum(F.when(F.col("s") <= F.col("reach"), 0).otherwise(1)).over(w))
        .groupBy(*keys, "sh", "isle")
        .agg(F.min("s").alias("s"), F.max("e").alias("e"))
        .withColumn("prev", F.lag("e").over(w))
        .withColumn("next", F.lead("s").over(w))
    )
    edge = F.col("prev").isNull() | F.col("next").isNull() | (F.col("s") == F.col("sh") * size) | (F.col("e") == (F.col("sh") + 1) * size)
    seg = lambda kind, s, e: F.struct(F.lit(kind).alias("kind"), s.alias("seg_start"), e.alias("seg_end"))
    inner = merged.select(*keys, F.inline(F.filter(F.array(F.when(~edge, seg("period", F.col("s"), F.col("e"))), F.when(F.col("next").isNotNull(), seg("gap", F.col("e"), F.col("next")))), lambda x: x.isNotNull())))
    we = Window.partitionBy(*keys).orderBy("s")
    before = F.max("e").over(we.rowsBetween(Window.unboundedPreceding, -1))
    edges = (
        merged.where(edge)
        .select(*keys, "s", "e", F.col("next").isNull().alias("closes"))
        .withColumn("before", before)
        .withColumn("follows", F.lead("s").over(we))
        .withColumn("isle", F.sum(F.when(F.col("s") <= F.col("before"), 0).otherwise(1)).over(we))
    )
    joined = edges.groupBy(*keys, "isle").agg(F.min("s").alias("s"), F.max("e").alias("e"), F.max(F.when(F.col("closes") & (F.col("follows") > F.col("e")), F.col("follows"))).alias("follows"))
    outer = joined.select(*keys, F.inline(F.filter(F.array(seg("period", F.col("s"), F.col("e")), F.when(F.col("follows").isNotNull(), seg("gap", F.col("e"), F.col("follows")))), lambda x: x.isNotNull())))
    back = [F.expr(AXES[kinds[0]][1].format(c=c)).alias(c) for c in ("seg_start", "seg_end")]
    return inner.unionByName(outer).select(*(F.col(k).alias(c) for c, k in zip(entity, keys)), "kind", *back)
