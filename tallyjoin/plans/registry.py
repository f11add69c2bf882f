"""Every core query under its name, with the SQL of an independent engine that must agree."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyjoin.functions import scalars as S
from tallyjoin.operators import aggregates as A
from tallyjoin.operators import extras as X
from tallyjoin.operators.joins import dedupe_first, join_orders, with_value
from tallyjoin.operators.sketch import approx_distinct, bitmap_estimate
from tallyjoin.plans.averages import q1, q2
from tallyjoin.sources.generator import PRIME, Workload, generate
from tallyjoin.sources.tables import load, load_items, load_orders

Query = Callable[[SparkSession, str], DataFrame]

ITEMS_SQL = "SELECT p_partkey AS id, CAST(ROUND(p_retailprice * 100) AS BIGINT) AS price FROM part"
ORDERS_SQL = "SELECT l_partkey AS item_id, l_suppkey AS store_id, CAST(l_quantity AS BIGINT) AS quantity FROM lineitem"
WITH = f"WITH items AS ({ITEMS_SQL}), orders AS ({ORDERS_SQL})"
JOINED = f"{WITH}, j AS (SELECT o.*, i.price, i.price * o.quantity AS value FROM orders o JOIN items i ON i.id = o.item_id)"


def _q1_sql(where: str = "TRUE") -> str:
    return f"{JOINED} SELECT CAST(SUM(value) // NULLIF(COUNT(*), 0) AS BIGINT) AS avg_value FROM j WHERE {where}"


def _q2_sql(where: str = "TRUE", store: str = "store_id") -> str:
    return (
        f"{JOINED}, g AS (SELECT {store} AS s, SUM(value) // COUNT(*) AS a FROM j WHERE {where} GROUP BY 1) "
        "SELECT CAST(SUM(a) // NULLIF(COUNT(*), 0) AS BIGINT) AS avg_value FROM g"
    )


def _tables(f: Callable[[DataFrame, DataFrame], DataFrame]) -> Query:
    return lambda spark, d: f(load_items(spark, d), load_orders(spark, d))


def _values(f: Callable[[DataFrame], DataFrame]) -> Query:
    return _tables(lambda i, o: f(with_value(join_orders(i, o))))


def _on_part(column: Callable[[], object], name: str) -> Query:
    return lambda spark, d: load(spark, d, "part").select("p_partkey", column().alias(name))


def _heavy(spark: SparkSession, d: str) -> DataFrame:
    store = F.when(F.col("l_orderkey") % 2 == 0, F.lit(1).cast("bigint")).otherwise(F.col("l_suppkey"))
    orders = load(spark, d, "lineitem").select(F.col("l_partkey").alias("item_id"), store.alias("store_id"), F.col("l_quantity").cast("bigint").alias("quantity"))
    return q2(load_items(spark, d), orders)


def _half(df: DataFrame, key: str) -> DataFrame:
    """Selectivity of a half: all rows stay, but odd keys are moved to where the other side has none."""
    return df.withColumn(key, F.when(F.col(key).bitwiseAND(1) == 0, F.col(key)).otherwise(F.col(key) + 2_000_000_000))


#: items x orders of the generated workload.
GENERATED = Workload(inner_tuples=1_000, inner_selectivity=0.5, outer_tuples=50_000, outer_selectivity=0.5, groups=100, hh_groups=5, hh_probability=0.5)


def _mix_sql(position: str, salt: int) -> str:
    """The generator's arithmetic as SQL."""
    x = f"(({position} % {PRIME} + {salt}) % {PRIME})"
    for factor in (48271, 1_103_515_245, 69_621):
        x = f"(({x} * {factor} + {salt}) % {PRIME})"
        x = f"(xor({x}, {x} >> 13) % {PRIME})"
    return x


def _generated_sql(load: Workload) -> str:
    """The tables of generate(), row by row from their positions."""
    shared = max(1, round(load.inner_tuples * load.inner_selectivity))
    matching = max(shared, round(load.outer_tuples * load.outer_selectivity))
    span = lambda salt, size: f"(({_mix_sql('i', salt)} * {size}) // {PRIME})"
    store = f"CASE WHEN i < {load.groups} THEN i + 1 WHEN {_mix_sql('i', 37)} < {int(load.hh_probability * PRIME)} THEN {span(43, load.hh_groups)} + 1 ELSE {span(41, load.groups)} + 1 END"
    hit = f"(CASE WHEN i < {shared} THEN i ELSE {span(23, shared)} END) * 2 + 1"
    return (
        f"WITH items AS (SELECT i * 2 + CASE WHEN i < {shared} THEN 1 ELSE 2 END AS id, {span(11, load.inner_val_max + 1)} AS price FROM range({load.inner_tuples}) t(i)), "
        f"orders AS (SELECT CASE WHEN i < {matching} THEN {hit} ELSE ({span(29, load.inner_tuples)} + {load.inner_tuples}) * 2 + 2 END AS item_id, {store} AS store_id, "
        f"{span(31, load.outer_val_max + 1)} AS quantity FROM range({load.outer_tuples}) t(i)), "
        "j AS (SELECT store_id, price * quantity AS value FROM orders JOIN items ON id = item_id)"
    )


def _approx_bound(spark: SparkSession, d: str) -> DataFrame:
    """The exact number of stores, and whether the estimate is within four standard errors of it."""
    orders, rsd = load_orders(spark, d), 0.05
    both = orders.agg(F.count_distinct("store_id").alias("exact"), F.approx_count_distinct("store_id", rsd).alias("estimate"))
    return both.select("exact", (F.abs(F.col("estimate") - F.col("exact")) <= F.col("exact") * 4 * rsd).alias("within"))


def _first_match(items: DataFrame, orders: DataFrame, strategy: str = "auto") -> DataFrame:
    """Each item twice, at two prices; only the row at the first position may match."""
    twice = items.select("id", "price", F.lit(0).alias("pos")).unionByName(items.select("id", (F.col("price") + 7).alias("price"), F.lit(1).alias("pos")))
    return join_orders(twice, orders, strategy, first_match=True, position="pos")


JOIN_COLUMNS = "item_id, store_id, quantity, price"
JOIN_SQL = f"{JOINED} SELECT {JOIN_COLUMNS} FROM j"
HASH = "(({x} * 2654435761) & 4294967295)"
SKETCH_SQL = """WITH h AS (SELECT l_suppkey * 2654435761 AS h FROM lineitem WHERE l_suppkey IS NOT NULL),
b AS (SELECT h & 4095 AS p, bit_or(((h >> 12) & (-(h >> 12))) & 4294967295) AS bm FROM h GROUP BY 1),
u AS (SELECT (4294967295 - bm) AS free FROM b),
z AS (SELECT CASE WHEN free = 0 THEN 32 ELSE bit_count((free & (-free)) - 1)::INT END AS run FROM u),
r AS (SELECT CAST(COALESCE(SUM(1::BIGINT << run), 0) + 4096 - COUNT(*) AS BIGINT) AS raw FROM z),
e AS (SELECT raw, CAST(FLOOR(raw / 0.77351) AS BIGINT) AS estimate FROM r)
SELECT raw, estimate, CASE WHEN estimate & (estimate - 1) = 0 THEN estimate ELSE 1::BIGINT << length(bin(estimate))::INT END AS table_size FROM e"""
U32 = 4_294_967_295


def _exact(spark: SparkSession, d: str) -> DataFrame:
    """Prices and quantities moved to the top of the unsigned 32-bit domain."""
    items = load_items(spark, d).select("id", (F.lit(U32) - F.col("price")).alias("price"))
    orders = load_orders(spark, d).select("item_id", "store_id", (F.lit(U32) - F.col("quantity")).alias("quantity"))
    return q1(items, orders, exact=True).select(F.col("avg_value").cast("string").alias("avg_value"))


CORE: dict[str, tuple[Query, str | None]] = {
    "scan_items": (lambda s, d: load_items(s, d), ITEMS_SQL),
    "scan_orders": (lambda s, d: load_orders(s, d), ORDERS_SQL),
    "project_order_value": (_values(lambda v: v.select("item_id", "value")), f"{JOINED} SELECT item_id, value FROM j"),
    "join_auto": (_tables(join_orders), JOIN_SQL),
    "join_broadcast_hash": (_tables(lambda i, o: join_orders(i, o, "broadcast_hash")), JOIN_SQL),
    "join_shuffle_hash": (_tables(lambda i, o: join_orders(i, o, "shuffle_hash")), JOIN_SQL),
    "join_sort_merge": (_tables(lambda i, o: join_orders(i, o, "sort_merge")), JOIN_SQL),
    "join_broadcast_nl": (_tables(lambda i, o: join_orders(i, o, "broadcast_nl")), JOIN_SQL),
    "join_cartesian": (_tables(lambda i, o: join_orders(i, o, "cartesian")), JOIN_SQL),
    "join_first_match": (_tables(_first_match), JOIN_SQL),
    "join_first_match_hash": (_tables(lambda i, o: _first_match(i, o, "broadcast_hash")), JOIN_SQL),
    "join_first_match_nl": (_tables(lambda i, o: _first_match(i, o, "broadcast_nl")), JOIN_SQL),
    "agg_global_sum_count": (_values(A.global_sum_count), f"{JOINED} SELECT CAST(SUM(value) AS BIGINT) AS sum_value, COUNT(*) AS n FROM j"),
    "q1_avg_order_value": (_tables(q1), _q1_sql()),
    "q1_outer_half": (_tables(lambda i, o: q1(_half(i, "id"), o)), _q1_sql("item_id % 2 = 0")),
    "q1_inner_half": (_tables(lambda i, o: q1(i, _half(o, "item_id"))), _q1_sql("item_id % 2 = 0")),
    "q1_empty": (_tables(lambda i, o: q1(i.where("id < 0"), o)), _q1_sql("item_id < 0")),
    "q1_exact_decimal": (
        _exact,
        f"{JOINED} SELECT CAST(SUM(({U32}::HUGEINT - price) * ({U32}::HUGEINT - quantity)) // COUNT(*) AS VARCHAR) AS avg_value FROM j",
    ),
    "agg_store_sum_count": (
        _values(lambda v: A.group_sum_count(v, "store_id")),
        f"{JOINED} SELECT store_id, CAST(SUM(value) AS BIGINT) AS sum_value, COUNT(*) AS n FROM j GROUP BY 1",
    ),
    "agg_store_avg": (_values(lambda v: A.group_avg(v, "store_id")), f"{JOINED} SELECT store_id, CAST(SUM(value) // COUNT(*) AS BIGINT) AS avg_value FROM j GROUP BY 1"),
    "q2_avg_of_store_avgs": (_tables(q2), _q2_sql()),
    "q2_group_count": (_values(lambda v: A.group_count(v, "store_id")), f"{JOINED} SELECT COUNT(*) AS n_groups FROM (SELECT store_id FROM j GROUP BY 1)"),
    "q2_outer_half": (_tables(lambda i, o: q2(_half(i, "id"), o)), _q2_sql("item_id % 2 = 0")),
    "q2_heavy_hitters": (
        _heavy,
        f"WITH items AS ({ITEMS_SQL}), g AS (SELECT CASE WHEN l_orderkey % 2 = 0 THEN 1 ELSE l_suppkey END AS s, "
        "SUM(price * CAST(l_quantity AS BIGINT)) // COUNT(*) AS a FROM lineitem JOIN items ON id = l_partkey GROUP BY 1) "
        "SELECT CAST(SUM(a) // COUNT(*) AS BIGINT) AS avg_value FROM g",
    ),
    "mult_hash": (_on_part(lambda: S.mult_hash("p_partkey", 13), "bucket"), f"SELECT p_partkey, {HASH.format(x='p_partkey')} >> 19 AS bucket FROM part"),
    "ctz": (
        _on_part(lambda: S.count_trailing_zeros("p_partkey").cast("int"), "zeros"),
        "SELECT p_partkey, CASE WHEN p_partkey = 0 THEN 32 ELSE bit_count((p_partkey & (-p_partkey)) - 1)::INT END AS zeros FROM part",
    ),
    "lowest_bit": (_on_part(lambda: S.lowest_bit("p_partkey"), "bit"), "SELECT p_partkey, p_partkey & (-p_partkey) AS bit FROM part"),
    "next_pow2": (
        _on_part(lambda: S.next_pow2("p_partkey"), "pow2"),
        "SELECT p_partkey, CASE WHEN p_partkey & (p_partkey - 1) = 0 THEN p_partkey ELSE 1::BIGINT << length(bin(p_partkey))::INT END AS pow2 FROM part",
    ),
    "hash_table_buckets": (
        _on_part(lambda: S.hash_table_buckets("p_partkey"), "buckets"),
        "WITH t AS (SELECT p_partkey, greatest((p_partkey * 100 + 66) // 67, 1) AS x FROM part) SELECT p_partkey, CASE WHEN x & (x - 1) = 0 THEN x ELSE 1::BIGINT << length(bin(x))::INT END AS buckets FROM t",
    ),
    "format_commas": (_on_part(lambda: S.commas(F.col("p_partkey") * 1237), "text"), "SELECT p_partkey, format('{:,}', p_partkey * 1237) AS text FROM part"),
    "pcsa_store_estimate": (lambda s, d: bitmap_estimate(load_orders(s, d), "store_id"), SKETCH_SQL),
    "approx_distinct_stores": (lambda s, d: approx_distinct(load_orders(s, d), "store_id"), None),
    "approx_distinct_bound": (_approx_bound, "SELECT COUNT(DISTINCT l_suppkey) AS exact, TRUE AS within FROM lineitem"),
    "generated_q1": (lambda s, d: q1(*generate(s, GENERATED)), f"{_generated_sql(GENERATED)} SELECT CAST(SUM(value) // COUNT(*) AS BIGINT) AS avg_value FROM j"),
    "generated_q2": (
        lambda s, d: q2(*generate(s, GENERATED)),
        f"{_generated_sql(GENERATED)}, g AS (SELECT store_id, SUM(value) // COUNT(*) AS a FROM j GROUP BY 1) SELECT CAST(SUM(a) // COUNT(*) AS BIGINT) AS avg_value FROM g",
    ),
    "unmatched_orders": (_tables(lambda i, o: X.unmatched_orders(_half(i, "id"), o)), f"{WITH} SELECT * FROM orders WHERE item_id % 2 <> 0"),
    "matched_items": (_tables(lambda i, o: X.matched_items(i, o)), f"{WITH} SELECT * FROM items WHERE id IN (SELECT item_id FROM orders)"),
    "outer_store_value": (
        _tables(lambda i, o: X.outer_store_value(_half(i, "id"), o)),
        f"{WITH} SELECT store_id, COUNT(*) AS n_orders, COUNT(price) AS n_matched, CAST(COALESCE(SUM(price * quantity), 0) AS BIGINT) AS sum_value "
        "FROM orders LEFT JOIN (SELECT * FROM items WHERE id % 2 = 0) i ON id = item_id GROUP BY 1",
    ),
    "top_items_per_store": (
        _tables(X.top_items_per_store),
        f"{JOINED}, t AS (SELECT store_id, item_id, CAST(SUM(value) AS BIGINT) AS sum_value FROM j GROUP BY 1, 2), "
        "r AS (SELECT *, CAST(row_number() OVER (PARTITION BY store_id ORDER BY sum_value DESC, item_id) AS INT) AS rank FROM t) SELECT * FROM r WHERE rank <= 3",
    ),
    "store_rollup": (
        _tables(X.store_rollup),
        f"{JOINED} SELECT store_id, CAST(SUM(value) AS BIGINT) AS sum_value, COUNT(*) AS n, CAST(GROUPING(store_id) AS INT) AS level FROM j GROUP BY ROLLUP (store_id)",
    ),
}
