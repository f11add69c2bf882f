"""Experiment rows: append as CSV, read back, report."""

from __future__ import annotations

import csv
import logging

from pyspark.sql import DataFrame, SparkSession

from tallyjoin.schema import EXPERIMENT

log = logging.getLogger("tallyjoin")


def append_rows(path: str, rows: list[tuple]) -> None:
    """Append driver-side rows to one headerless file; selectivities keep one decimal."""
    with open(path, "a", newline="") as out:
        csv.writer(out).writerows([f"{x:.1f}" if isinstance(x, float) else x for x in row] for row in rows)


def append_frame(df: DataFrame, directory: str) -> None:
    df.write.mode("append").csv(directory)


def read_experiments(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(EXPERIMENT).csv(path)


def with_commas(n: int) -> str:
    return f"{n:,}"


def report(**figures) -> None:
    for name, value in figures.items():
        log.info("%s: %s", name, with_commas(value) if isinstance(value, int) else value)
