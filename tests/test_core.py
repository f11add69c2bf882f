import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tallyjoin import STRATEGIES, q1, q2
from tallyjoin.functions import scalars as S
from tallyjoin.operators.joins import duplicate_ids, join_orders
from tallyjoin.plans.averages import operators_of
from tallyjoin.plans.harness import parse, run
from tallyjoin.plans.registry import CORE
from tallyjoin.sources.generator import Workload, generate
from tallyjoin.sources.sinks import read_experiments
from tallyjoin.sources.tables import items_from_rows, load_items, load_orders, orders_from_rows, range_slices, sliced_scan

SF = "/root/testdata/sf0.001"
EDGE = {
    "tiny": ([(1, 10), (2, 7)], [(1, 1, 3), (2, 1, 2), (1, 2, 5)], 31, 36),
    "unmatched": ([(1, 10)], [(1, 1, 3), (9, 1, 4)], 30, 30),
    "empty_match": ([(1, 10)], [(9, 1, 4)], None, None),
    "empty_tables": ([], [], None, None),
    "key_zero": ([(0, 10), (1, 20)], [(0, 0, 1), (1, 1, 1)], 15, 15),
    "dup_id": ([(1, 10), (1, 30)], [(1, 1, 1)], 20, 20),
    "trunc_twice": ([(1, 1)], [(1, 1, 1), (1, 1, 2), (1, 2, 2), (1, 2, 3)], 2, 1),
    "weighting": ([(1, 1)], [(1, 1, 10)] * 3 + [(1, 2, 50)], 20, 30),
    "null_key": ([(1, 10)], [(None, 1, 3), (1, None, 2)], 20, 20),
}


def oracle(sql, d=SF):
    con = duckdb.connect()
    for t in ("part", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{d}/{t}.parquet')")
    con.execute(sql)
    names = [x[0] for x in con.description]
    return names, con.fetchall()


@pytest.mark.parametrize("name", [n for n, (_, sql) in CORE.items() if sql])
def test_against_oracle(spark, name):
    query, sql = CORE[name]
    df = query(spark, SF)
    names, rows = oracle(sql)
    assert sorted(df.columns) == sorted(names)
    key = lambda row: tuple((x is None, x) for x in row)
    assert sorted(map(tuple, df.select(*names).collect()), key=key) == sorted(rows, key=key)


@pytest.mark.parametrize("name", EDGE)
@pytest.mark.parametrize("exact", [False, True])
def test_edges(spark, name, exact):
    items, orders, one, two = EDGE[name]
    i, o = items_from_rows(spark, items), orders_from_rows(spark, orders)
    assert q1(i, o, exact=exact).collect()[0][0] == one
    assert q2(i, o, exact=exact).collect()[0][0] == two


def test_u32_max(spark):
    big = 2**32 - 1
    i, o = items_from_rows(spark, [(1, big)]), orders_from_rows(spark, [(1, 1, big)])
    assert int(q1(i, o, exact=True).collect()[0][0]) == big * big == int(q2(i, o, exact=True).collect()[0][0])
    with pytest.raises(Exception, match="OVERFLOW"):
        q1(i, o).collect()


def test_first_match_and_duplicates(spark):
    i, o = items_from_rows(spark, [(1, 10), (1, 30)]), orders_from_rows(spark, [(1, 1, 1)])
    assert q1(i, o, first_match=True).collect()[0][0] == 10
    assert [tuple(r) for r in duplicate_ids(i).collect()] == [(1, 2)]


PLANS = {"broadcast_hash": "BroadcastHashJoin", "shuffle_hash": "ShuffledHashJoin", "sort_merge": "SortMergeJoin", "broadcast_nl": "BroadcastNestedLoopJoin", "cartesian": "CartesianProduct"}


@pytest.mark.parametrize("strategy", STRATEGIES)
def test_strategies_agree_and_plan_as_named(spark, strategy):
    items, orders = load_items(spark, SF).where("id < 100"), load_orders(spark, SF)
    df = q1(items, orders, strategy)
    assert df.collect()[0][0] == 2325224
    if strategy in PLANS:
        assert PLANS[strategy] in operators_of(df)


def _many(spark):
    """Over 20 billion pairs: three items of the id 7 with over 1,000 orders, negative, NULL and unmatched keys."""
    items = spark.range(-500, 150_000).select("id", (F.col("id") * 3 + 5).alias("price")).unionByName(items_from_rows(spark, [(7, 1), (7, 1), (None, 9)]))
    keys = spark.range(0, 140_000).select(F.col("id").alias("item_id")).unionByName(spark.range(1_000).select(F.lit(7).cast("bigint").alias("item_id")))
    keys = keys.unionByName(spark.createDataFrame([(None,), (-500,), (-501,), (900_000,), (7,)], "item_id long"))
    return items, keys.select("item_id", (F.col("item_id") % 11).alias("store_id"), (F.col("item_id") % 50).alias("quantity"))


@pytest.mark.parametrize("strategy", ["broadcast_nl", "cartesian"])
def test_nested_loops_do_the_whole_job(spark, strategy):
    items, orders = _many(spark)
    assert items.count() * orders.count() > 20_000_000_000
    want, got = join_orders(items, orders, "sort_merge"), join_orders(items, orders, strategy)
    assert got.columns == want.columns and got.count() == want.count() == 139_999 + 3 * 1_002 + 1
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    assert PLANS[strategy] in operators_of(got)


def test_first_match_by_nested_loop_does_the_whole_job(spark):
    items, orders = _many(spark)
    first = [join_orders(items, orders, strategy, first_match=True) for strategy in ("sort_merge", "broadcast_nl")]
    assert [df.count() for df in first] == [139_999 + 1_002 + 1] * 2
    assert first[0].exceptAll(first[1]).isEmpty() and first[1].exceptAll(first[0]).isEmpty()
    assert {r["price"] for r in first[1].where("item_id = 7").collect()} == {1}


@pytest.mark.parametrize("parts", [1, 3, 8])
def test_partitions_do_not_matter(spark, parts):
    items, orders = load_items(spark, SF), load_orders(spark, SF).repartition(parts)
    assert q1(items, orders).collect()[0][0] == 2308641
    assert q2(items, orders).collect()[0][0] == 2308834


def test_scan_reads_only_what_it_needs(spark):
    plan = q1(load_items(spark, SF), load_orders(spark, SF))._jdf.queryExecution().executedPlan().toString()
    assert "l_suppkey" not in plan and "PushedFilters: [IsNotNull(l_partkey)]" in plan


def test_bad_input(spark):
    items, orders = items_from_rows(spark, []), orders_from_rows(spark, [])
    for bad in (lambda: join_orders(items, orders, "magic"), lambda: q1(items.drop("price"), orders), lambda: Workload(groups=-1).validate(), lambda: Workload(outer_tuples=1).validate()):
        with pytest.raises(ValueError):
            bad()


@settings(max_examples=8, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), min_size=1, max_size=30))
def test_scalars(spark, keys):
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    got = df.select("k", S.mult_hash("k", 13), S.count_trailing_zeros("k"), S.next_pow2("k"), S.hash_table_buckets("k")).collect()
    for k, h, z, p, b in got:
        assert h == ((k * 0x9E3779B1) & 0xFFFFFFFF) >> 19
        assert z == (32 if k == 0 else (k & -k).bit_length() - 1)
        assert p == (k if k & (k - 1) == 0 else 1 << k.bit_length())
        assert b * 67 >= k * 100 and (b == 1 or b // 2 * 67 < k * 100)


def test_generator(spark):
    load = Workload(inner_tuples=200, inner_selectivity=0.5, outer_tuples=5000, outer_selectivity=0.5, groups=50, hh_groups=2, hh_probability=0.5)
    items, orders = generate(spark, load)
    assert items.count() == 200 == items.select("id").distinct().count() and orders.count() == 5000
    assert orders.join(items, F.col("id") == F.col("item_id"), "left_semi").count() == 2500
    assert items.join(orders, F.col("id") == F.col("item_id"), "left_semi").count() == 100
    assert orders.select("store_id").distinct().count() == 50
    assert 0.4 < orders.where("store_id <= 2").count() / 5000 < 0.65
    for a, b in zip(generate(spark, load), (items, orders)):
        assert a.exceptAll(b).count() == 0


def test_harness_and_csv(spark, tmp_path):
    out = str(tmp_path / "runs.csv")
    load = Workload(inner_tuples=100, outer_tuples=3000, groups=10)
    for query in ("q1", "q2"):
        assert len(run(spark, load, query, repeats=2, csv=out)) == 2
    rows = read_experiments(spark, out).collect()
    assert [r["repeat"] for r in rows] == [1, 2, 1, 2] and all(r["run_ns"] > 0 and r["groups"] == 10 for r in rows)
    assert parse(["5", "0.5"]).inner_selectivity == 0.5


def test_slices(spark):
    assert range_slices(10, 3) == [(0, 3), (3, 6), (6, 10)]
    assert {r["slice"] for r in sliced_scan(spark, 10, 3).collect()} == {0, 1, 2}


def test_stream(spark, tmp_path):
    from tallyjoin.streaming.averages import read_order_stream, start_store_averages

    src, out = str(tmp_path / "orders"), str(tmp_path / "out")
    load_orders(spark, SF).repartition(3).write.parquet(src)
    start_store_averages(load_items(spark, SF), read_order_stream(spark, src, 1), out, str(tmp_path / "ck")).awaitTermination()
    got = {r["store_id"]: r["avg_value"] for r in spark.read.parquet(out).collect()}
    assert got == {r["store_id"]: r["avg_value"] for r in CORE["agg_store_avg"][0](spark, SF).collect()}


def test_entry(spark):
    assert entry.entry(spark).collect()[0][0] == 2308641
    assert set(entry.oracle_sql()) <= set(entry.queries())
