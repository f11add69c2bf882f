"""Beyond parity: the same join in other shapes, and ranking on top of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyjoin.operators.joins import join_orders, with_value


def unmatched_orders(items: DataFrame, orders: DataFrame) -> DataFrame:
    return orders.join(items, orders["item_id"] == items["id"], "left_anti")


def matched_items(items: DataFrame, orders: DataFrame) -> DataFrame:
    return items.join(orders, items["id"] == orders["item_id"], "left_semi")


def outer_store_value(items: DataFrame, orders: DataFrame) -> DataFrame:
    """Per store: all orders, matched orders and their value (0 if none matches)."""
    joined = with_value(join_orders(items, orders, how="left"))
    return joined.groupBy("store_id").agg(
        F.count(F.lit(1)).alias("n_orders"), F.count("price").alias("n_matched"), F.coalesce(F.sum("value"), F.lit(0)).alias("sum_value")
    )


def top_items_per_store(items: DataFrame, orders: DataFrame, k: int = 3) -> DataFrame:
    """The k items of the highest value in each store, ties to the smaller item. Aggregated before it is ranked."""
    totals = with_value(join_orders(items, orders)).groupBy("store_id", "item_id").agg(F.sum("value").alias("sum_value"))
    order = Window.partitionBy("store_id").orderBy(F.desc("sum_value"), "item_id")
    return totals.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def store_rollup(items: DataFrame, orders: DataFrame) -> DataFrame:
    """Value per store and in total; the total's store is NULL and its level 1."""
    return (
        with_value(join_orders(items, orders))
        .rollup("store_id")
        .agg(F.sum("value").alias("sum_value"), F.count(F.lit(1)).alias("n"), F.grouping("store_id").cast("int").alias("level"))
    )
