"""False-discovery rates over base pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import stats
from tidemark.plans.tables import stage

#: Scores are compared as whole numbers of this unit.
UNIT = 100_000


def scored(df: DataFrame, pseudocount: float = 0.0, treat: str = "treat", ctrl: str = "ctrl") -> DataFrame:
    """``df`` with ``pscore``: computed once per distinct (trunc(treat), ctrl) and joined back.

    A null score where the background is not positive. The distinct pairs are few against the segments, and the tail is
    the costly part.
    """
    k, lam = (F.col(treat) + pseudocount).cast("long"), F.col(ctrl) + pseudocount
    base = stage(df.withColumn("_k", k).withColumn("_lam", lam), "scored-cells")
    cores = df.sparkSession.sparkContext.defaultParallelism
    pairs = base.select("_k", "_lam").where("_k is not null and _lam is not null").distinct().repartition(cores)
    pairs = stage(pairs.withColumn("pscore", stats.pscore(F.col("_k"), F.col("_lam"))), "scored-pairs")
    return base.join(pairs, ["_k", "_lam"], "left").drop("_k", "_lam")


def scored_pq(df: DataFrame, pseudocount: float = 0.0, treat: str = "treat", ctrl: str = "ctrl") -> DataFrame:
    """``df`` with ``pscore`` and ``qscore``, as ``with_qscore(scored(df))`` has them, with one join; written are the cells and their distinct pairs.

    The table of scores is built from the distinct pairs and their summed lengths, not from the segments.
    """
    k, lam = (F.col(treat) + pseudocount).cast("long"), F.col(ctrl) + pseudocount
    base = stage(df.withColumn("_k", k).withColumn("_lam", lam), "scored-cells")
    pairs = base.where("_k is not null and _lam is not null").groupBy("_k", "_lam").agg(F.sum(F.col("end") - F.col("start")).alias("_n"))
    # The tail is costly and the pairs are few bytes: spread over all cores, computed once and written.
    cores = df.sparkSession.sparkContext.defaultParallelism
    pairs = stage(pairs.repartition(cores).withColumn("pscore", stats.pscore(F.col("_k"), F.col("_lam"))), "scored-pairs")
    q = table(pairs.select(F.lit(0).cast("long").alias("start"), F.col("_n").alias("end"), "pscore"))
    both = with_qscore(pairs, lookup=q).select("_k", "_lam", "pscore", "qscore")
    return base.join(both, ["_k", "_lam"], "left").drop("_k", "_lam")


def table(df: DataFrame, column: str = "pscore") -> DataFrame:
    """``(p, bases, rank, q)``: Benjamini-Hochberg over base pairs, from the highest score down.

    The rank of a score is 1 plus the length of all higher ones; q = p + log10(rank) - log10(total), made monotone by a
    running minimum and not below 0. Distinct scores are bounded by their 5 decimals (one row each), so one ordered
    window over them is enough. Null scores take no part.
    """
    hist = df.where(F.col(column).isNotNull()).groupBy(F.round(F.col(column) * UNIT).cast("long").alias("_u")).agg(F.sum(F.col("end") - F.col("start")).alias("bases"))
    down = Window.orderBy(F.col("_u").desc())
    rank = 1 + F.coalesce(F.sum("bases").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("bases").over(Window.partitionBy())
    p = F.col("_u") / UNIT
    raw = hist.withColumn("rank", rank).withColumn("_q", p + F.log10("rank") - F.log10(total))
    q = F.greatest(F.lit(0.0), F.min("_q").over(down.rowsBetween(Window.unboundedPreceding, 0)))
    return raw.select(p.alias("p"), "bases", "rank", q.alias("q"), "_u")


def with_qscore(df: DataFrame, column: str = "pscore", lookup: DataFrame | None = None) -> DataFrame:
    """``df`` with ``qscore`` looked up by its p-score."""
    df = df if lookup is not None else stage(df, "cells-with-pscore")
    t = (lookup if lookup is not None else table(df, column)).select("_u", F.col("q").alias("qscore"))
    return df.withColumn("_u", F.round(F.col(column) * UNIT).cast("long")).join(t, "_u", "left").drop("_u")
