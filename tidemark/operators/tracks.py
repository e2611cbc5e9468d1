"""Tag and fragment tracks: duplicates, sampling, totals, lengths, subsets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Hash ranges per group of the exact sample; the range at the cut is ordered.
RANGES = 1024


def limit_duplicates(df: DataFrame, keys: list[str], most: int, keep_extra: bool = False) -> DataFrame:
    """At most ``most`` rows of each key, as rows of the key columns.

    Rows of one key are equal, so they are counted and repeated: a hot key folds before it moves. With ``keep_extra``
    also ``n_before``, its number of rows. Null keys count as equal.
    """
    n = df.groupBy(*keys).agg(F.count("*").alias("n_before"))
    out = n.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.col("n_before"), F.lit(int(most)).cast("long")))).alias("_i")).drop("_i")
    return out if keep_extra else out.drop("n_before")


def totals(frags: DataFrame) -> DataFrame:
    """One row ``(total, length, mean_length)``: fragments (by ``cnt`` where there is one), their summed and mean length."""
    w = F.col("cnt").cast("long") if "cnt" in frags.columns else F.lit(1).cast("long")
    n = (F.col("r") - F.col("l")).cast("long") * w
    return frags.where("r > l and chrom is not null").agg(F.sum(w).alias("total"), F.sum(n).alias("length")).withColumn("mean_length", F.try_divide(F.col("length"), F.col("total")))


def length_histogram(frags: DataFrame, weighted: bool = False) -> DataFrame:
    """``(len, n)``: fragments of each length, counted by ``cnt`` if ``weighted``."""
    n = F.sum(F.col("cnt").cast("long")) if weighted else F.count("*")
    return frags.where("r > l and chrom is not null").groupBy((F.col("r") - F.col("l")).cast("int").alias("len")).agg(n.alias("n"))


def subset(frags: DataFrame, barcodes: DataFrame) -> DataFrame:
    """Fragments of the listed barcodes; a null barcode is in no list."""
    return frags.join(barcodes.select("barcode").distinct(), "barcode", "left_semi")


def cap_counts(frags: DataFrame, most: int | None = None) -> DataFrame:
    """Counts limited to 65535 and to ``most``."""
    cap = min(65535, most) if most else 65535
    return frags.withColumn("cnt", F.least(F.col("cnt"), F.lit(cap)))


def sample(df: DataFrame, groups: list[str], share: float, columns: list[str] | None = None, seed: int = 0) -> DataFrame:
    """Exactly ``floor(round(n * share, 5))`` rows of every group of n, by a seeded hash order of ``columns``.

    The group's rows are counted per hash range; ranges below the cut are taken whole, and only the range at the cut is
    ordered, so no task orders a hot group. Equal rows of a group are interchangeable. Deterministic for a seed.
    """
    cols = columns or df.columns
    rows = df.withColumn("_u", F.xxhash64(F.lit(seed), *cols)).withColumn("_g", F.pmod(F.shiftrightunsigned("_u", 33), F.lit(RANGES)).cast("int"))
    hist = rows.groupBy(*groups, "_g").agg(F.count("*").alias("_t"))
    w = Window.partitionBy(*groups)
    want = F.floor(F.round(F.sum("_t").over(w) * float(share), 5)).cast("long")
    upto = F.sum("_t").over(w.orderBy("_g").rowsBetween(Window.unboundedPreceding, 0))
    plan = hist.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(groups)), F.col("_g").alias("_r"), F.least(F.greatest(want - (upto - F.col("_t")), F.lit(0)), F.col("_t")).alias("_take"), F.col("_t").alias("_of"))
    on = F.col("_g") == F.col("_r")
    for i, k in enumerate(groups):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    placed = rows.join(plan.where("_take > 0"), on)
    whole = placed.where("_take = _of")
    part = placed.where("_take < _of").withColumn("_rn", F.row_number().over(Window.partitionBy(*groups, "_g").orderBy("_u", *cols))).where("_rn <= _take")
    return whole.select(*df.columns).unionByName(part.select(*df.columns))


def sample_number(df: DataFrame, groups: list[str], n: int, columns: list[str] | None = None, seed: int = 0) -> DataFrame:
    """About ``n`` rows: the share ``n / total`` of every group, rounded down. All rows if there are no more than ``n``."""
    total = df.count()
    return df if total <= n else sample(df, groups, n / total, columns, seed)


def pick(peaks: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """``n`` rows by a seeded hash order: each task keeps its own ``n`` first."""
    return peaks.orderBy(F.xxhash64(F.lit(seed), *peaks.columns), *peaks.columns).limit(n)


def top_two(df: DataFrame, groups: list[str], item: str) -> DataFrame:
    """``(groups, item, n, rank)``: the two most frequent items of each group, of equal counts the smaller item."""
    n = df.groupBy(*groups, item).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*groups).orderBy(F.col("n").desc(), F.col(item).asc())
    return n.withColumn("rank", F.row_number().over(w)).where("rank <= 2")


def subpeak_letters(i):
    """a..z, then aa, ab, ...: the letters of subpeak number ``i`` (a Column, from 0)."""
    letter = lambda x: F.char(F.lit(97) + x)
    return F.when(i < 26, letter(i)).otherwise(F.concat(letter(F.floor(i / 26) - 1), letter(i % 26)))
