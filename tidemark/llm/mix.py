"""Mixing sources to target weights by capped water-filling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.encode import count_tokens
from tidemark.plans.tables import stage

#: Hash ranges per source in which the fractional repetition is cut; the range at the cut is ordered exactly.
RANGES = 4096
#: Up to so many targets their rows (one each) are broadcast; beyond, Spark chooses the join by size.
FEW = 10_000


def water_fill(weights: dict[str, float], caps: dict[str, float], total: float) -> dict[str, float]:
    """Allotment per source: shares of ``total`` by weight, clamped at the caps, the excess handed on in proportion.

    Sources that would exceed their cap are clamped together, and the rest of the total is shared among the others by
    their weights, until none exceeds. If every source ends clamped, less than ``total`` is allotted.
    """
    out = {s: 0.0 for s in weights}
    active, left = {s for s, w in weights.items() if w > 0 and caps.get(s, 0) > 0}, total
    while active and left > 0:
        mass = sum(weights[s] for s in active)
        over = {s for s in active if weights[s] / mass * left >= caps[s]}
        if not over:
            for s in active:
                out[s] = weights[s] / mass * left
            break
        for s in over:
            out[s] = float(caps[s])
        left -= sum(caps[s] for s in over)
        active -= over
    return out


def mix(docs: DataFrame, targets: DataFrame, ident: str = "doc_id", source: str = "source", text: str = "text", total: int | None = None, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Two tables: the mixture ``(ident, source, n_tokens, copies)`` and the shares per target.

    ``total`` is the wanted size in tokens; without it, all tokens of the sources that have a target. A source whose
    allotment is ``e`` times its size gets each document ``floor(e)`` times and, by a seeded hash order, a part of them
    once more until the fraction is filled without passing it; no document is used more than ``max_repeats`` times.

    Documents without source or target take no part; a target without documents has share 0, its weight goes to the
    others. Null, zero and negative weights and repeats count as 0; of repeated targets the greatest values hold. Texts
    of no tokens come out with their copies and add nothing. Targets are a configuration of a few rows: they and one
    size each are all that the driver sees.
    """
    spark = docs.sparkSession
    goal = targets.where(F.col("source").isNotNull()).groupBy("source").agg(F.max(F.coalesce("target_weight", F.lit(0.0))).alias("w"), F.max(F.coalesce("max_repeats", F.lit(0))).alias("m"))
    goals = {r["source"]: (max(0.0, r["w"]), max(0, r["m"])) for r in goal.collect()}
    near = F.broadcast if len(goals) <= FEW else lambda df: df
    named = spark.createDataFrame([(s,) for s in sorted(goals)], "_target string")
    part = docs.join(near(named), F.col(source) == F.col("_target"), "left_semi")
    # The hash comes from the id alone, so that a document keeps its place whatever else is in the corpus.
    sized = stage(count_tokens(part, [ident, source], text).select(F.col(ident).alias("i"), F.col(source).alias("s"), F.col("n_tokens").alias("n"), F.xxhash64(F.lit(seed), F.col(ident)).alias("u")), "mix-sizes")
    sizes = {r["s"]: r["n"] for r in sized.groupBy("s").agg(F.sum("n").alias("n")).collect()}
    caps = {s: goals[s][1] * sizes.get(s, 0) for s in goals}
    allot = water_fill({s: w for s, (w, _) in goals.items()}, caps, sum(sizes.values()) if total is None else total)
    plan = []
    for s, (w, m) in sorted(goals.items()):
        size = sizes.get(s, 0)
        epochs = min(float(m), allot[s] / size) if size else 0.0
        whole = int(epochs + 1e-9)
        plan.append((s, w, m, size, allot[s], whole, 0.0 if whole >= m else max(0.0, allot[s] - whole * size)))
    table = spark.createDataFrame(plan, "s string, target_weight double, max_repeats int, available_tokens long, allotted_tokens double, whole int, rest double")
    few = near(table.select("s", "whole", "rest"))

    rows = sized.join(few, "s").withColumn("range", F.pmod(F.shiftrightunsigned("u", 40), F.lit(RANGES)).cast("int"))
    hist = rows.groupBy("s", "range").agg(F.sum("n").alias("t"), F.first("rest").alias("rest"))
    upto = F.sum("t").over(Window.partitionBy("s").orderBy("range"))
    cut = hist.withColumn("upto", upto).where((F.col("upto") > F.col("rest")) & (F.col("upto") - F.col("t") <= F.col("rest")) & (F.col("t") > 0))
    cut = cut.select("s", F.col("range").alias("cut"), (F.col("upto") - F.col("t")).alias("base"))
    placed = rows.join(near(cut), "s", "left")  # one row per target at most
    edge = placed.where(F.col("range") == F.col("cut"))
    order = F.sum("n").over(Window.partitionBy("s").orderBy("u", "i").rowsBetween(Window.unboundedPreceding, 0))
    edge = edge.withColumn("extra", ((F.col("rest") > 0) & (F.col("base") + order <= F.col("rest"))).cast("int"))
    clear = placed.where(F.col("cut").isNull() | (F.col("range") != F.col("cut"))).withColumn("extra", ((F.col("rest") > 0) & (F.col("cut").isNull() | (F.col("range") < F.col("cut")))).cast("int"))
    used = clear.unionByName(edge).select("i", "s", "n", (F.col("whole") + F.col("extra")).alias("copies")).where(F.col("copies") > 0)
    mixture = used.select(F.col("i").alias(ident), F.col("s").alias(source), F.col("n").alias("n_tokens"), "copies")

    taken = used.groupBy("s").agg(F.sum(F.col("n") * F.col("copies")).alias("tokens"), F.max("copies").alias("most_copies"))
    both = table.join(taken, "s", "left").withColumn("tokens", F.coalesce("tokens", F.lit(0).cast("long")))
    whole_mix = F.sum("tokens").over(Window.partitionBy())
    shares = both.select(
        F.col("s").alias(source), "target_weight", F.when(whole_mix > 0, F.col("tokens") / whole_mix).otherwise(0.0).alias("share"), "max_repeats", F.coalesce("most_copies", F.lit(0)).alias("most_copies"), "available_tokens", F.round("allotted_tokens").cast("long").alias("allotted_tokens"), "tokens"
    )
    return mixture, shares
