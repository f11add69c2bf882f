"""Generate a workload, run a query repeatedly, check every answer, record the times.

    python -m tallyjoin.plans.harness [inner_tuples [inner_selectivity ...]] --query q1 --csv out.csv
"""

from __future__ import annotations

import argparse
import time
from dataclasses import astuple, fields
from statistics import median

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tallyjoin.plans.averages import q1, q2
from tallyjoin.session import local_session
from tallyjoin.sources.generator import Workload, generate
from tallyjoin.sources.sinks import append_rows, report


def expected_answer(items, orders, query: str) -> int | None:
    """By another route than the query's: summed per item first, averaged in Python's integers."""
    keys = ["item_id"] + (["store_id"] if query == "q2" else [])
    sums = orders.groupBy(*keys).agg(F.sum(F.col("quantity").cast("decimal(20,0)")).alias("q"), F.count(F.lit(1)).alias("n"))
    priced = sums.join(items, sums["item_id"] == items["id"], "left_semi").join(items.hint("merge"), F.col("item_id") == F.col("id"))
    group = priced.groupBy(*keys[1:]).agg(F.sum(F.col("q") * F.col("price").cast("decimal(10,0)")).alias("s"), F.sum("n").alias("n"))
    total = count = 0
    for row in group.toLocalIterator():
        if row["n"]:
            total, count = (total + int(row["s"]) // row["n"], count + 1) if query == "q2" else (int(row["s"]), row["n"])
    return total // count if count else None


def run(spark: SparkSession, load: Workload, query: str = "q1", strategy: str = "auto", repeats: int = 5, csv: str | None = None) -> list[int]:
    """Nanoseconds of each repetition. An answer that differs from the expected one raises."""
    if query == "q2" and not load.groups:
        raise ValueError("q2 needs groups > 0")
    items, orders = (df.cache() for df in generate(spark, load))
    try:
        expected, times = expected_answer(items, orders, query), []
        for repeat in range(1, repeats + 1):
            began = time.perf_counter_ns()
            answer = (q1 if query == "q1" else q2)(items, orders, strategy).collect()[0][0]
            times.append(time.perf_counter_ns() - began)
            if answer != expected:
                raise AssertionError(f"{query} gave {answer}, not {expected}")
            if csv:
                append_rows(csv, [(*astuple(load), repeat, times[-1])])
        report(query=query, answer=answer, median_ns=int(median(times)))
        return times
    finally:
        items.unpersist()
        orders.unpersist()


def parse(argv: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser()
    for field in fields(Workload):
        parser.add_argument(field.name, nargs="?", type=type(field.default), default=field.default)
    parser.add_argument("--query", choices=("q1", "q2"), default="q1")
    parser.add_argument("--strategy", default="auto")
    parser.add_argument("--repeats", type=int, default=5)
    parser.add_argument("--csv")
    return parser.parse_args(argv)


def main(argv: list[str] | None = None) -> None:
    args = vars(parse(argv))
    load = Workload(**{f.name: args.pop(f.name) for f in fields(Workload)}).validate()
    print([t / 1e9 for t in run(local_session(load.threads), load, **args)])


if __name__ == "__main__":
    main()
