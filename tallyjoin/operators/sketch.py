"""Approximate distinct counts: a bitmap sketch kept for parity, and HLL++ for production."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyjoin.functions.scalars import HASH_FACTOR, MASK32, count_trailing_zeros, lowest_bit, next_pow2

# log2 of the number of bitmaps, and the Flajolet-Martin correction.
LOG_BITMAPS = 12
PHI = 0.77351


def bitmap_estimate(df: DataFrame, key: str) -> DataFrame:
    """raw, estimate and the table size (a power of two) of the distinct non-null keys.

    Bitmaps merge by OR, so partial aggregation sends at most 4096 rows from each task.
    """
    hashed = df.where(F.col(key).isNotNull()).select((F.col(key).cast("bigint") * F.lit(HASH_FACTOR)).alias("h"))
    bit = lowest_bit(F.shiftright("h", LOG_BITMAPS)).bitwiseAND(F.lit(MASK32))
    maps = hashed.groupBy(F.col("h").bitwiseAND(F.lit(2**LOG_BITMAPS - 1)).alias("p")).agg(F.bit_or(bit).alias("bm"))
    run = count_trailing_zeros(F.bitwise_not("bm").bitwiseAND(F.lit(MASK32)))
    level = F.call_function("shiftleft", F.lit(1).cast("bigint"), run)
    raw = (F.coalesce(F.sum(level), F.lit(0)) + F.lit(2**LOG_BITMAPS) - F.count(F.lit(1))).cast("bigint")
    out = maps.agg(raw.alias("raw")).withColumn("estimate", F.floor(F.col("raw") / F.lit(PHI)).cast("bigint"))
    return out.withColumn("table_size", next_pow2("estimate").cast("bigint"))


def approx_distinct(df: DataFrame, key: str, rsd: float = 0.05) -> DataFrame:
    return df.agg(F.approx_count_distinct(key, rsd).alias("approx_distinct"))
