"""Logical schemas and the one check that guards the API boundary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

ITEMS = T.StructType([T.StructField("id", T.LongType()), T.StructField("price", T.LongType())])
ORDERS = T.StructType([T.StructField(c, T.LongType()) for c in ("item_id", "store_id", "quantity")])
# Columns of the experiments' CSV in their order.
EXPERIMENT = T.StructType(
    [
        T.StructField(name, kind())
        for name, kind in (
            ("inner_tuples", T.LongType),
            ("inner_selectivity", T.DoubleType),
            ("inner_val_max", T.LongType),
            ("outer_tuples", T.LongType),
            ("outer_selectivity", T.DoubleType),
            ("outer_val_max", T.LongType),
            ("groups", T.LongType),
            ("hh_groups", T.LongType),
            ("hh_probability", T.DoubleType),
            ("threads", T.IntegerType),
            ("repeat", T.IntegerType),
            ("run_ns", T.LongType),
        )
    ]
)


def require_columns(df: DataFrame, columns: list[str], table: str) -> DataFrame:
    """``df`` itself, or ValueError when one of ``columns`` is missing or not integral."""
    kinds = dict(df.dtypes)
    for column in columns:
        if column not in kinds:
            raise ValueError(f"{table} has no column {column!r}; it has {sorted(kinds)}")
        if kinds[column] not in ("tinyint", "smallint", "int", "bigint") and not kinds[column].startswith("decimal("):
            raise ValueError(f"{table}.{column} is {kinds[column]}, not integral")
    return df
