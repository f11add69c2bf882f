"""Inner equi-join of orders to items under a chosen physical strategy.

``auto`` leaves the choice to Catalyst and AQE and is what production code should use. ``broadcast_hash`` and
``broadcast_nl`` ship the items to every executor, so they refuse above a bound: by the plan's own statistics, and only where
these are above it, by a count of the items. Inner nested loops go over blocks of neighbouring keys, so that only pairs of blocks
whose keys overlap are compared row by row; any other join under ``broadcast_nl`` looks at every pair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyjoin.functions.scalars import order_value, order_value_exact
from tallyjoin.schema import require_columns

STRATEGIES = ("auto", "broadcast_hash", "shuffle_hash", "sort_merge", "broadcast_nl", "cartesian")
#: Bytes of items that may be broadcast, and of a row of them (two numbers); the hash table takes about twice as much.
MAX_BROADCAST_BYTES, ROW_BYTES = 128 << 20, 16
#: Rows of a block, and blocks of a group of them, as a power of two; partitions of the blocks that a cartesian product repeats.
BLOCK_BITS, REPEATED = 7, 4


def dedupe_first(items: DataFrame, position: str | None = None) -> DataFrame:
    """One row per id: the first by ``position``, or else the one of the lowest price."""
    order = [F.col(position)] if position else []
    order += [F.col(c) for c in items.columns if c not in ("id", position)]
    ranked = items.withColumn("_rn", F.row_number().over(Window.partitionBy("id").orderBy(*order)))
    return ranked.where("_rn = 1").drop("_rn")


def duplicate_ids(items: DataFrame) -> DataFrame:
    """Ids that break the primary key, with their counts."""
    return items.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def _within(rows: int, limit: int, what: str) -> None:
    if rows > limit:
        raise ValueError(f"{what}: {rows} is over the limit of {limit}; use strategy 'auto' or 'sort_merge'")


def _broadcastable(items: DataFrame, packed: DataFrame | None = None) -> DataFrame:
    """``items``, or their blocks, marked for broadcast, or ValueError. Statistics cost no job; tables without any have a huge size there."""
    if int(str(items._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) > MAX_BROADCAST_BYTES:
        _within(items.count() * ROW_BYTES, MAX_BROADCAST_BYTES, "bytes of items to broadcast")
    return F.broadcast(items if packed is None else packed)


def _blocks(df: DataFrame, key: str) -> DataFrame:
    """All rows with a ``key``, packed in blocks: number, least and greatest key, rows. Every column sorts, so equal input gives equal blocks."""
    order = [F.col(key)] + [F.col(f"`{c}`") for c, kind in df.dtypes if c != key and "map<" not in kind and kind != "variant"]
    near = df.where(F.col(key).isNotNull()).repartitionByRange(*order).sortWithinPartitions(*order)
    rows = near.select(F.struct("*").alias("_row"), F.shiftright(F.monotonically_increasing_id(), BLOCK_BITS).alias("_block"))
    ends = F.min(F.col("_row")[key]).alias("_low"), F.max(F.col("_row")[key]).alias("_high")
    return rows.groupBy("_block").agg(*ends, F.collect_list("_row").alias("_rows"))


def _broadcast_loop(items: DataFrame, orders: DataFrame) -> DataFrame:
    """Each order against all groups of blocks of items, the blocks of those that may hold its key, and the items of these."""
    ends = F.min("_low").alias("_least"), F.max("_high").alias("_greatest")
    groups = _blocks(items, "id").groupBy(F.shiftright("_block", BLOCK_BITS)).agg(*ends, F.collect_list(F.struct("_low", "_high", "_rows")).alias("_blocks"))
    groups = _broadcastable(items, groups.select("_least", "_greatest", "_blocks"))
    near = orders.join(groups, orders["item_id"].between(groups["_least"], groups["_greatest"])).select(orders["*"], F.explode("_blocks").alias("_near"))
    near = near.where(F.col("item_id").between(F.col("_near._low"), F.col("_near._high")))
    return near.select("*", F.explode("_near._rows").alias("_item")).where("item_id = _item.id").select("*", "_item.price").drop("_near", "_item")


def _cartesian_loop(items: DataFrame, orders: DataFrame) -> DataFrame:
    """Blocks of orders against all blocks of items, each order of a block against each item of those that may hold its key."""
    few = _blocks(items, "id").select(F.col("_low").alias("_least"), F.col("_high").alias("_greatest"), F.col("_rows").alias("_items")).repartition(REPEATED)
    many = _blocks(orders, "item_id")
    near = many.join(few.hint("shuffle_replicate_nl"), (many["_low"] <= few["_greatest"]) & (many["_high"] >= few["_least"]))
    pairs = near.select(F.explode("_rows").alias("_order"), "_items").select("_order", F.explode("_items").alias("_item"))
    return pairs.where("_order.item_id = _item.id").select("_order.*", "_item.price")


def join_orders(
    items: DataFrame,
    orders: DataFrame,
    strategy: str = "auto",
    first_match: bool = False,
    position: str | None = None,
    how: str = "inner",
) -> DataFrame:
    """All columns of ``orders`` with ``price`` of the matching item.

    NULL keys never match; key 0 is an ordinary key. With ``first_match`` an order meets one item at most.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}; one of {STRATEGIES}")
    require_columns(items, ["id", "price"], "items")
    require_columns(orders, ["item_id", "quantity"], "orders")
    items = dedupe_first(items, position).select("id", "price") if first_match else items.select("id", "price")
    equal: Column = orders["item_id"] == items["id"]
    if strategy == "broadcast_nl" and how == "inner":
        return _broadcast_loop(items, orders)
    if strategy == "cartesian" and how == "inner":
        return _cartesian_loop(items, orders)
    if strategy in ("broadcast_hash", "broadcast_nl"):
        if strategy == "broadcast_nl":
            # The two bounds say the same as equality but hide the key, so no hash plan is possible.
            equal = (orders["item_id"] >= items["id"]) & (orders["item_id"] <= items["id"])
        items = _broadcastable(items)
    elif strategy != "auto":
        items = items.hint({"shuffle_hash": "shuffle_hash", "sort_merge": "merge", "cartesian": "shuffle_replicate_nl"}[strategy])
    return orders.join(items, equal, how).drop("id")


def with_value(joined: DataFrame, exact: bool = False) -> DataFrame:
    """The joined rows with ``value`` = price * quantity."""
    return joined.withColumn("value", (order_value_exact if exact else order_value)("price", "quantity"))
