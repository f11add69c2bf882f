"""Parquet and in-memory scans of the two logical tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyjoin.schema import ITEMS, ORDERS


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def load_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``part`` as items: prices in whole cents."""
    price = F.round(F.col("p_retailprice") * 100).cast("bigint")
    return load(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), price.alias("price"))


def load_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` as orders: a supplier is a store."""
    return load(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("item_id"), F.col("l_suppkey").alias("store_id"), F.col("l_quantity").cast("bigint").alias("quantity")
    )


def items_from_rows(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, ITEMS)


def orders_from_rows(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, ORDERS)


def range_slices(n: int, parts: int) -> list[tuple[int, int]]:
    """Positions [begin, end) of each of ``parts`` contiguous slices; the last takes the remainder."""
    if parts < 1 or n < 0:
        raise ValueError("parts must be positive and n not negative")
    step = n // parts
    return [(k * step, n if k == parts - 1 else (k + 1) * step) for k in range(parts)]


def sliced_scan(spark: SparkSession, n: int, parts: int) -> DataFrame:
    """Row positions 0..n-1 in ``parts`` contiguous partitions, with each row's partition."""
    return spark.range(0, n, 1, parts).select("id", F.spark_partition_id().alias("slice"))
