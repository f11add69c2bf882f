"""The two queries of the engine."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tallyjoin.operators.aggregates import avg_of_group_avgs, global_avg
from tallyjoin.operators.joins import join_orders, with_value
from tallyjoin.schema import require_columns


def q1(items: DataFrame, orders: DataFrame, strategy: str = "auto", exact: bool = False, first_match: bool = False, position: str | None = None) -> DataFrame:
    """Truncated average of price * quantity over all matching orders; NULL when none matches."""
    joined = join_orders(items, orders.select("item_id", "quantity"), strategy, first_match, position)
    return global_avg(with_value(joined, exact), exact=exact)


def q2(items: DataFrame, orders: DataFrame, strategy: str = "auto", exact: bool = False, first_match: bool = False, position: str | None = None) -> DataFrame:
    """Truncated average, over the stores, of each store's truncated average."""
    require_columns(orders, ["store_id"], "orders")
    joined = join_orders(items, orders.select("item_id", "store_id", "quantity"), strategy, first_match, position)
    return avg_of_group_avgs(with_value(joined, exact), "store_id", exact=exact)


def operators_of(df: DataFrame) -> list[str]:
    """Names of the physical operators; after an action, those of the final adaptive plan."""
    import re

    return re.findall(r"[+\-:] \*?(?:\(\d+\) )?([A-Z]\w+)", "+- " + df._jdf.queryExecution().executedPlan().toString())
