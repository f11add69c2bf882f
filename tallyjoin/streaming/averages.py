"""Stream-static forms of the queries: new orders arrive as files, items are a static table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tallyjoin.functions.scalars import int_div
from tallyjoin.operators.aggregates import group_sum_count
from tallyjoin.operators.joins import join_orders, with_value
from tallyjoin.schema import ORDERS


def read_order_stream(spark: SparkSession, directory: str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(ORDERS).option("maxFilesPerTrigger", files_per_trigger).parquet(directory)


def running_store_totals(items: DataFrame, orders: DataFrame) -> DataFrame:
    """Sum and count per store; state is one small row per store."""
    return group_sum_count(with_value(join_orders(items, orders)), "store_id")


def start_store_averages(items: DataFrame, orders: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Keeps ``out`` (Parquet) at the present average of every store; each batch replaces it whole."""
    import pyspark.sql.functions as F

    def write(batch: DataFrame, _: int) -> None:
        batch.select("store_id", "n", int_div(F.col("sum_value"), F.col("n")).alias("avg_value")).write.mode("overwrite").parquet(out)

    stream = running_store_totals(items, orders).writeStream.outputMode("complete").foreachBatch(write)
    return stream.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
