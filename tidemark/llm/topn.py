"""The N best items of every group, by descending score bands."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.plans.tables import stage

#: Score quantiles at which a band ends: the first holds the top 2 %, the second the next 18 %, the last the rest.
BANDS = (0.98, 0.80)
#: A group is split into so many parts by a hash of the ident where Spark does not keep each task's best before the shuffle.
SALTS = 512


def top_n_per_group(df: DataFrame, group: str, score: str, ident: str, n: int = 10, bands: tuple[float, ...] = BANDS) -> DataFrame:
    """``(group, ident, score, rank)``: the ``n`` highest scores of each non-null group, equal scores by smaller ident.

    Bands are ranges of the score, cut at quantiles of the whole column and processed from the top. Groups that have
    ``n`` items after a band are anti-joined away, so a huge group ends in the first band while small ones fall through
    to the last; the ranks of a band are exact, ties included. A hot group never meets in one task: every task keeps its
    own ``n`` best of a group before the shuffle where Spark pushes the rank filter below it (``n`` up to
    ``spark.sql.optimizer.windowGroupLimitThreshold``); for greater ``n`` each of ``SALTS`` parts of a group is ranked
    first, and at most ``SALTS * n`` of its rows meet.

    Null group, null, NaN and infinite scores take no part; a row repeated with equal ident and score counts once; a
    null ident ranks last among equal scores. An empty table gives no rows.
    """
    finite = F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")) & (F.abs(F.col(score).cast("double")) != float("inf"))
    rows = df.where(F.col(group).isNotNull() & finite).select(F.col(group).alias("g"), F.col(ident).alias("i"), (F.col(score).cast("double") + F.lit(0.0)).alias("s"))
    edges = rows.agg(F.percentile_approx("s", list(bands), 1000).alias("q")).first()["q"]
    edges = sorted(set(edges or []), reverse=True)
    order = [F.col("s").desc(), F.col("i").asc_nulls_last()]
    w = Window.partitionBy("g").orderBy(*order)
    pushed = n <= int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000"))
    kept = None
    for k in range(len(edges) + 1):
        band = rows
        if k:
            band = band.where(F.col("s") < edges[k - 1])
        if k < len(edges):
            band = band.where(F.col("s") >= edges[k])
        if kept is not None:
            filled = kept.groupBy("g").agg(F.count("*").alias("have")).where(F.col("have") >= n).select("g")
            band = band.join(filled, "g", "left_anti")
        if not pushed:  # equal rows share a part, so dense ranks are right in each
            parts = Window.partitionBy("g", "salt").orderBy(*order)
            band = band.withColumn("salt", F.pmod(F.xxhash64("i"), F.lit(SALTS))).withColumn("r", F.dense_rank().over(parts)).where(F.col("r") <= n).select("g", "i", "s").distinct()
        best = band.withColumn("r", F.dense_rank().over(w)).where(F.col("r") <= n).select("g", "i", "s").distinct()
        best = best if k == len(edges) else stage(best, f"topn-band{k}")
        kept = best if kept is None else kept.unionByName(best)
    return kept.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).select(F.col("g").alias(group), F.col("i").alias(ident), F.col("s").alias(score), "rank")
