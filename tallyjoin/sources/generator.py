"""Deterministic synthetic items and orders with selectivity and heavy-hitter controls.

Only integer arithmetic, so another engine can repeat every row from its position. Distributions are our own:
ids are spread by a multiplicative bijection of 31 bits, values are uniform.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PRIME = 2**31 - 1


# Names, order and defaults of the parameters are those of the command line that users know.
@dataclass(frozen=True)
class Workload:
    inner_tuples: int = 1_000
    inner_selectivity: float = 1.0
    inner_val_max: int = 10_000_000
    outer_tuples: int = 1_000_000
    outer_selectivity: float = 1.0
    outer_val_max: int = 1_000
    groups: int = 0
    hh_groups: int = 0
    hh_probability: float = 0.0
    threads: int = 1

    def validate(self) -> "Workload":
        """``self``, or ValueError. groups = 0 means orders without a store column."""
        rules = {
            "inner_selectivity must be in (0.1, 1]": 0.1 < self.inner_selectivity <= 1,
            "outer_selectivity must be in (0.1, 1]": 0.1 < self.outer_selectivity <= 1,
            "inner_tuples must be 1..2**30": 0 < self.inner_tuples <= 2**30,
            "outer_tuples must be positive": self.outer_tuples > 0,
            "values must be in 0..2**32-1": 0 <= self.inner_val_max < 2**32 and 0 <= self.outer_val_max < 2**32,
            "orders must be able to name every matching item": self.outer_tuples * self.outer_selectivity >= self.inner_tuples * self.inner_selectivity,
            "groups must be 0..outer_tuples": 0 <= self.groups <= self.outer_tuples,
            "hh_groups must be 0..groups": 0 <= self.hh_groups <= self.groups,
            "hh_probability must be in [0, 1]": 0 <= self.hh_probability <= 1,
            "threads must be positive": self.threads > 0,
        }
        for rule, holds in rules.items():
            if not holds:
                raise ValueError(rule)
        return self


def _mix(position: Column, salt: int) -> Column:
    """A value in 0..2**31-2 that looks unrelated to the position; products stay under 2**62."""
    x = (position % PRIME + salt) % PRIME
    for factor in (48271, 1_103_515_245, 69_621):
        x = (x * factor + salt) % PRIME
        x = x.bitwiseXOR(F.shiftright(x, 13)) % PRIME
    return x


def _span(x: Column, size: int) -> Column:
    return F.call_function("div", x * F.lit(size).cast("bigint"), F.lit(PRIME).cast("bigint"))


def generate(spark: SparkSession, load: Workload) -> tuple[DataFrame, DataFrame]:
    """(items, orders). Item ids are 1..2n odd or even apart: shared ids are odd, those of one side only are even."""
    load.validate()
    shared = max(1, round(load.inner_tuples * load.inner_selectivity))
    matching = max(shared, round(load.outer_tuples * load.outer_selectivity))
    parts = max(load.threads, -(-load.outer_tuples // 4_000_000))
    row = F.col("id")
    key = F.when(row < shared, row * 2 + 1).otherwise(row * 2 + 2)
    items = spark.range(0, load.inner_tuples, 1, load.threads).select(key.alias("id"), _span(_mix(row, 11), load.inner_val_max + 1).alias("price"))
    hit = F.when(row < shared, row).otherwise(_span(_mix(row, 23), shared)) * 2 + 1
    miss = (_span(_mix(row, 29), load.inner_tuples) + load.inner_tuples) * 2 + 2
    orders = spark.range(0, load.outer_tuples, 1, parts).select(
        F.when(row < matching, hit).otherwise(miss).alias("item_id"),
        *([_store(row, load).alias("store_id")] if load.groups else []),
        _span(_mix(row, 31), load.outer_val_max + 1).alias("quantity"),
    )
    return items, orders


def _store(row: Column, load: Workload) -> Column:
    """Every store once, then a heavy hitter with the given probability, else any store."""
    any_store = _span(_mix(row, 41), load.groups) + 1
    if load.hh_groups:
        heavy = _mix(row, 37) < F.lit(int(load.hh_probability * PRIME)).cast("bigint")
        any_store = F.when(heavy, _span(_mix(row, 43), load.hh_groups) + 1).otherwise(any_store)
    return F.when(row < load.groups, row + 1).otherwise(any_store)
