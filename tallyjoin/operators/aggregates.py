"""Truncating integer averages, global, per group and of group averages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyjoin.functions.scalars import div_exact, int_div


def _avg(column: str, exact: bool) -> Column:
    return (div_exact if exact else int_div)(F.sum(column), F.count(F.lit(1)))


def global_sum_count(df: DataFrame, column: str = "value") -> DataFrame:
    return df.agg(F.sum(column).alias("sum_value"), F.count(F.lit(1)).alias("n"))


def global_avg(df: DataFrame, column: str = "value", exact: bool = False, name: str = "avg_value") -> DataFrame:
    return df.agg(_avg(column, exact).alias(name))


def group_sum_count(df: DataFrame, key: str, column: str = "value") -> DataFrame:
    return df.groupBy(key).agg(F.sum(column).alias("sum_value"), F.count(F.lit(1)).alias("n"))


def group_avg(df: DataFrame, key: str, column: str = "value", exact: bool = False) -> DataFrame:
    """One truncated average per key. Partial aggregation absorbs hot keys before the shuffle."""
    return df.groupBy(key).agg(_avg(column, exact).alias("avg_value"))


def avg_of_group_avgs(df: DataFrame, key: str, column: str = "value", exact: bool = False) -> DataFrame:
    """Every group weighs 1 and both averages truncate."""
    return global_avg(group_avg(df, key, column, exact), "avg_value", exact)


def group_count(df: DataFrame, key: str) -> DataFrame:
    """Exact number of groups; NULL is a group."""
    return df.groupBy(key).agg(F.lit(1).alias("_one")).agg(F.count(F.lit(1)).alias("n_groups"))
