"""Queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import digest, encode, mix, residue, topn
from tidemark.plans.tables import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return topn.top_n_per_group(table(spark, d, "peaks"), "chrom", "score", "peak_id", 10).select("chrom", "peak_id")


def p4_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return digest.percentiles(table(spark, d, "peaks"), "chrom", ["pileup", "fc"], "peak_id", "loaded_at")


def p4_daily_digests(spark: SparkSession, d: str) -> DataFrame:
    return digest.daily_digests(table(spark, d, "peaks"), "chrom", ["pileup", "fc"], "peak_id", "loaded_at")


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode.encode(table(spark, d, "documents"))


def p6_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """The texts again, decoded from their ids."""
    return encode.decode(encode.encode(table(spark, d, "documents")))


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    return mix.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return mix.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1]


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.residue(table(spark, d, "documents")).select("doc_id")


def p8_validation(spark: SparkSession, d: str) -> DataFrame:
    return residue.validation(table(spark, d, "documents"))


P1_SQL = """
WITH p AS (SELECT DISTINCT chrom, peak_id, score FROM peaks WHERE chrom IS NOT NULL AND score IS NOT NULL AND NOT isnan(score) AND NOT isinf(score)),
r AS (SELECT chrom, peak_id, row_number() OVER (PARTITION BY chrom ORDER BY score DESC, peak_id) AS n FROM p)
SELECT chrom, peak_id FROM r WHERE n <= 10
"""

P6_ROUND_TRIP_SQL = "SELECT doc_id, coalesce(text, '') AS text FROM documents"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p4_percentiles, p4_daily_digests, p6_ids, p6_round_trip, p7_mix, p7_shares, p8_found, p8_validation)}


def oracle_sql() -> dict[str, str]:
    return {"p1_found": P1_SQL, "p6_round_trip": P6_ROUND_TRIP_SQL}
