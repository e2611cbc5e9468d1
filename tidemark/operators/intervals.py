"""Interval algebra: overlap joins, anti-joins, intersection, merging, binning, counting per entity and region.

Intervals are half-open ``[start, end)`` with a ``chrom``. Rows with a null chrom or bound, or ``end <= start``, take no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ordered import SHARD, along, islands
from tidemark.operators.step import align

#: Bin width of the overlap join for the shortest intervals; each class of longer ones has bins of STEP times the width.
BIN, STEP, CLASSES = 1 << 12, 16, 6


def valid(df: DataFrame, start: str = "start", end: str = "end") -> DataFrame:
    return df.where(F.col("chrom").isNotNull() & F.col(start).isNotNull() & (F.col(end) > F.col(start)))


def merge(regions: DataFrame, start: str = "start", end: str = "end") -> DataFrame:
    """Overlapping and touching regions as one; a nested region does not shorten its host."""
    rows = valid(regions, start, end).groupBy("chrom", F.col(start).cast("long").alias("start")).agg(F.max(F.col(end).cast("long")).alias("end"))
    return islands(rows, ["chrom"], "start", "end").groupBy("chrom", "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def expand(regions: DataFrame, k: int) -> DataFrame:
    return regions.withColumn("start", F.greatest(F.col("start") - k, F.lit(0))).withColumn("end", F.col("end") + k)


def total_length(regions: DataFrame) -> DataFrame:
    """One row: the number of positions covered; 0 for no region."""
    return merge(regions).agg(F.coalesce(F.sum(F.col("end") - F.col("start")), F.lit(0)).cast("long").alias("total_length"))


def intersect(left: DataFrame, right: DataFrame, missing: str = "keep") -> DataFrame:
    """Positions covered by both sets, as maximal regions. With ``keep``, chroms without a right region keep their left ones."""
    a, b = merge(left), merge(right)
    one = F.lit(1.0).alias("value")
    cells = align({"a": a.select("*", one), "b": b.select("*", one)}).select("chrom", "start", "end")
    if missing == "keep":
        cells = cells.unionByName(a.join(b.select("chrom").distinct(), "chrom", "left_anti"))
    return cells


def jaccard(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row ``(common, united, jaccard)`` in positions; null where nothing is covered."""
    common = total_length(intersect(left, right, "drop")).select(F.col("total_length").alias("common"))
    united = total_length(left.select("chrom", "start", "end").unionByName(right.select("chrom", "start", "end"))).select(F.col("total_length").alias("united"))
    return common.crossJoin(united).select("*", F.try_divide(F.col("common"), F.col("united")).alias("jaccard"))  # one row each


def _hits(df: DataFrame, regions: DataFrame, start: str, end: str, shard: int) -> DataFrame:
    """The distinct ``(_hc, _hs, _he)`` of ``df`` that overlap a region.

    Regions are merged, so of all that begin before an interval's end the last one reaches farthest: it alone decides. It
    is carried along the axis, without join or pairs. Only distinct intervals are asked, however many rows share one.
    """
    spots = valid(df, start, end).select("chrom", F.col(start).cast("long").alias("_hs"), F.col(end).cast("long").alias("_p")).distinct()
    none = F.lit(None).cast("long")
    told = merge(regions).select("chrom", none.alias("_hs"), F.col("start").alias("_p"), F.lit(1).alias("_k"), F.col("end").alias("_e"))
    both = spots.select("*", F.lit(0).alias("_k"), none.alias("_e")).unionByName(told)
    run = along(both, ["chrom"], "_p", ties=["_k"], fills={"_f": F.col("_e")}, shard=shard)
    return run.where((F.col("_k") == 0) & (F.col("_f") > F.col("_hs"))).select(F.col("chrom").alias("_hc"), "_hs", F.col("_p").alias("_he"))


def _is_hit(start: str, end: str):
    return (F.col("chrom") == F.col("_hc")) & (F.col(start) == F.col("_hs")) & (F.col(end) == F.col("_he"))


def flag_overlap(df: DataFrame, regions: DataFrame, start: str = "start", end: str = "end", name: str = "overlaps", shard: int = SHARD) -> DataFrame:
    """``df`` with a boolean: does the row overlap any region? Rows that are no intervals overlap nothing.

    The rows themselves move once, to the answer of their interval; a hot interval is a skewed join key, which AQE splits.
    """
    hits = _hits(df, regions, start, end, shard)
    return df.join(hits, _is_hit(start, end), "left").select(*df.columns, F.col("_hc").isNotNull().alias(name))


def exclude(df: DataFrame, regions: DataFrame, start: str = "start", end: str = "end", shard: int = SHARD) -> DataFrame:
    """The rows that overlap no region (all columns, repeated rows kept)."""
    return df.join(_hits(df, regions, start, end, shard), _is_hit(start, end), "left_anti")


def within(df: DataFrame, regions: DataFrame, start: str = "start", end: str = "end", shard: int = SHARD) -> DataFrame:
    """The rows that overlap a region."""
    return df.join(_hits(df, regions, start, end, shard), _is_hit(start, end), "left_semi")


def hosts(inner: DataFrame, outer: DataFrame, columns: list[str], shard: int = SHARD) -> DataFrame:
    """Rows of ``inner`` with ``host``: a struct of ``columns`` of the disjoint ``outer`` region that holds them; null without.

    Distinct starts are asked once; whether the region reaches far enough is decided row by row.
    """
    spots = inner.where("chrom is not null and start is not null").select("chrom", F.col("start").cast("long").alias("_p")).distinct().withColumn("_k", F.lit(1))
    told = outer.select("chrom", F.col("start").cast("long").alias("_p"), F.lit(0).alias("_k"), F.struct(*columns, F.col("end").alias("_end")).alias("_h"))
    run = along(spots.unionByName(told, allowMissingColumns=True), ["chrom"], "_p", ties=["_k"], fills={"_f": F.col("_h")}, shard=shard).where("_k = 1")
    answers = run.select(F.col("chrom").alias("_hc"), F.col("_p").alias("_hs"), "_f")
    host = F.when(F.col("_f._end") >= F.col("end"), F.struct(*(F.col(f"_f.{c}").alias(c) for c in columns)))
    return inner.join(answers, (F.col("chrom") == F.col("_hc")) & (F.col("start") == F.col("_hs")), "left").select(*inner.columns, host.alias("host"))


def overlap_join(a: DataFrame, b: DataFrame, a_cols: tuple[str, str] = ("l", "r"), b_cols: tuple[str, str] = ("start", "end"), size: int = BIN) -> DataFrame:
    """All pairs of overlapping rows: ``a``'s columns, then ``b``'s with the prefix ``b_``.

    An interval's class is the least one whose bins are as wide as it is long. A pair meets in the bins of the longer
    one's class, of which either touches two at most, and comes out only in the bin of its later start, so none repeats;
    no interval is cut into many pieces, however long. ``a`` goes only to classes that ``b`` has (at most ``CLASSES``
    numbers, asked of ``b`` first). A dense bin is a skewed join key, which AQE splits. Fold repeated intervals of a hot
    stretch before (``skew.value_frequencies``) where only counts matter.
    """
    (al, ar), (bl, br) = a_cols, b_cols
    width = lambda k: F.lit(float(size)) * F.pow(F.lit(float(STEP)), k)

    def level(l: str, r: str) -> Column:
        out = F.lit(CLASSES - 1)
        for k in range(CLASSES - 2, -1, -1):
            out = F.when(F.col(r) - F.col(l) <= size * STEP**k, k).otherwise(out)
        return out

    def placed(df: DataFrame, l: str, r: str, levels: Column, tag: str) -> DataFrame:
        own = df.withColumn(f"{tag}own", level(l, r)).select("*", F.explode(levels).alias(f"{tag}lv"))
        bins = F.sequence(F.floor(F.col(l) / width(F.col(f"{tag}lv"))), F.floor((F.col(r) - 1) / width(F.col(f"{tag}lv"))))
        return own.select("*", F.explode(bins).alias(f"{tag}bin"))

    right = valid(b, bl, br).select(*(F.col(c).alias(f"b_{c}") for c in b.columns))
    found = sorted(right.agg(F.collect_set(level(f"b_{bl}", f"b_{br}")).alias("x")).first()["x"])
    own = F.col("_own")
    to = F.filter(F.array(*map(F.lit, range(CLASSES))), lambda k: ((k == own) & F.lit(bool(found)) & (own >= (found or [0])[0])) | ((k > own) & k.isin(found))) if found else F.array().cast("array<int>")
    left = placed(valid(a, al, ar), al, ar, to, "_")
    right = placed(right, f"b_{bl}", f"b_{br}", F.sequence(F.col("b__own"), F.lit(CLASSES - 1)), "b__")
    on = (F.col("chrom") == F.col("b_chrom")) & (F.col("_lv") == F.col("b__lv")) & (F.col("_bin") == F.col("b__bin")) & (F.col(al) < F.col(f"b_{br}")) & (F.col(ar) > F.col(f"b_{bl}"))
    meet = (F.col("_own") == F.col("_lv")) | (F.col("b__own") == F.col("_lv"))
    owner = F.floor(F.greatest(F.col(al), F.col(f"b_{bl}")) / width(F.col("_lv"))) == F.col("_bin")
    return left.join(right, on & meet & owner).drop("_bin", "b__bin", "_lv", "b__lv", "_own", "b__own", "b_chrom")


def points_in_windows(points: DataFrame, windows: DataFrame, w: int = 0, pos: str = "pos", size: int = BIN) -> DataFrame:
    """Pairs of a point and every window with ``start - w <= pos <= end + w``."""
    spots = points.withColumn("_l", F.col(pos).cast("long")).withColumn("_r", F.col(pos).cast("long") + 1)
    wide = windows.withColumn("_s", F.col("start").cast("long") - w).withColumn("_e", F.col("end").cast("long") + w + 1)
    return overlap_join(spots, wide, ("_l", "_r"), ("_s", "_e"), size).drop("_l", "_r", "b__s", "b__e")


def counts_by_entity(frags: DataFrame, regions: DataFrame, entity: str = "barcode", count: str = "cnt", size: int = BIN) -> DataFrame:
    """``(entity, chrom, start, end, cnt)``: summed counts of each entity's intervals over each merged region.

    Equal intervals of an entity fold before the join, and sums fold before they move. Null entities and counts take no part.
    """
    rows = valid(frags, "l", "r").where(F.col(entity).isNotNull() & F.col(count).isNotNull())
    folded = rows.groupBy("chrom", "l", "r", F.col(entity).alias("_who")).agg(F.sum(F.col(count).cast("long")).alias("_n"))
    pairs = overlap_join(folded, merge(regions), size=size)
    return pairs.groupBy(F.col("_who").alias(entity), "chrom", F.col("b_start").alias("start"), F.col("b_end").alias("end")).agg(F.sum("_n").alias("cnt"))


def bins(regions: DataFrame, size: int) -> DataFrame:
    """``(chrom, region, bin_end)``: bins of ``size`` aligned to multiples of it, from the region's start to its end."""
    first, last = F.floor(F.col("start") / size) * size, F.floor(F.col("end") / size) * size
    rows = valid(regions).where(last > first)
    return rows.select("chrom", F.struct("start", "end").alias("region"), F.explode(F.sequence(first + size, last, F.lit(size).cast("long"))).alias("bin_end"))


def batches(regions: DataFrame, n: int) -> DataFrame:
    """Regions with a batch number: ``n`` regions each in order of chrom and start.

    Only the number of regions per chrom is ordered over all chroms; inside a chrom the order is sharded.
    """
    from pyspark.sql import Window

    one = along(regions, ["chrom"], "start", ties=["end"], sums={"_rn": F.lit(1).cast("long")})
    sizes = regions.groupBy("chrom").agg(F.count("*").alias("_n"))
    base = sizes.select(F.col("chrom").alias("_c"), F.coalesce(F.sum("_n").over(Window.orderBy("chrom").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"))
    return one.join(base, F.col("chrom").eqNullSafe(F.col("_c"))).withColumn("batch", F.floor((F.col("_b") + F.col("_rn") - 1) / n).cast("long")).drop("_rn", "_b", "_c")
