"""Approximate nearest neighbours by an inverted multi-index.

Each half of a vector is quantised by a codebook of its own, so K + K centroids make K * K cells. A query walks the pairs of
centroids in order of summed distance with a heap until its cells hold enough entries; these are ranked by the exact distance
in double precision. How many are enough is measured: a bounded number of queries is answered exactly by one scan, and the
number is the quantile, over their true neighbours, of the entries that the walk meets up to the neighbour's cell, and k + 1
at least, so that each query gets k rows where there are as many. Equal vectors are one entry with their smallest ids (k + 1 of them: no query can need more). Codebooks
are fitted on a bounded sample; every row is indexed.

Cells lie in groups of GROUP entries at most, in the order of their numbers; a larger cell is dealt over several groups. A query
goes once to each group that holds a cell of its walk, with the list of these cells, and a group that many queries look at is given
out several times. So a task holds a bounded part of the entries and of the queries, whatever one cell holds.

Vectors take no part that are null, zero, of another length than most, or hold a null or a value that is not finite; nor do rows
without an id. A row that repeats another's id and vector is the same row. Ties in distance go to the smaller id.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyjoin.llm.arrow import tidied
from tallyjoin.llm.common import cut, small_batches

#: Vectors that fit the codebooks; bounds of K; rounds of k-means; entries of a group and queries that it meets in one task.
SAMPLE, LEAST_K, MOST_K, ROUNDS, GROUP, SALT = 20_000, 4, 512, 12, 4_096, 2_000
#: Pairs whose exact distance is known that a task holds before it keeps the best of them.
PENDING = 100_000
#: Queries whose exact neighbours tell how many entries a query has to look at, and the recall that is asked for.
TRIALS, RECALL = 200, 0.97
KEY = ("k1", "k2")


def valid(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding and a 128-bit key of the vector, for the rows that take part."""
    good = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    df = vectors.select("vec_id", "embedding").where(F.col("vec_id").isNotNull() & F.forall("embedding", good) & F.exists("embedding", lambda x: x != 0))
    sizes = df.groupBy(F.size("embedding").alias("dim")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dim").limit(1).collect()
    df = df.where(F.size("embedding") == (sizes[0]["dim"] if sizes else 0))
    # Adding 0 makes one of the two zeros.
    plain = F.transform("embedding", lambda x: x + F.lit(0.0).cast("float"))
    return df.select("vec_id", "embedding", F.xxhash64(plain).alias("k1"), F.xxhash64(F.lit(1), plain).alias("k2"))


def distinct_vectors(rows: DataFrame, k: int) -> DataFrame:
    """k1, k2, embedding and the k + 1 smallest ids of each vector. Ranks are limited in each task before the shuffle."""
    rank = F.dense_rank().over(Window.partitionBy(*KEY).orderBy("vec_id"))
    few = rows.withColumn("_r", rank).where(F.col("_r") <= k + 1)
    return few.groupBy(*KEY).agg(F.first("embedding").alias("embedding"), F.array_sort(F.collect_set("vec_id")).alias("ids"))


def matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] - 2 * a @ b.T + (b * b).sum(1)[None], 0)


def codebook(x: np.ndarray, k: int, seed: int = 7) -> np.ndarray:
    """k-means; a centroid that loses all its points moves to the point worst served."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(ROUNDS):
        d = squared(x, centres)
        own = d.argmin(1)
        n = np.bincount(own, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], x[d.min(1).argmax()])
    return centres


def walk(first: np.ndarray, second: np.ndarray, sizes: np.ndarray, wanted: int) -> list[int]:
    """Cells (i * K2 + j) in order of first[i] + second[j] until they hold ``wanted`` entries; empty cells are passed over."""
    a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    heap, out, held = [(first[a[0]] + second[b[0]], 0, 0)], [], 0
    while heap and held < wanted:
        _, i, j = heapq.heappop(heap)
        cell = int(a[i]) * len(second) + int(b[j])
        if sizes[cell]:
            out.append(cell)
            held += int(sizes[cell])
        if j + 1 < len(b):
            heapq.heappush(heap, (first[a[i]] + second[b[j + 1]], i, j + 1))
        if j == 0 and i + 1 < len(a):
            heapq.heappush(heap, (first[a[i + 1]] + second[b[0]], i + 1, 0))
    return out


def assign(entries: DataFrame, books: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """``entries`` with the cell of each vector."""
    shared, names = entries.sparkSession.sparkContext.broadcast(books), entries.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = shared.value
        for batch in batches:
            x = matrix(batch.column(names.index("embedding")))
            if len(x):
                cell = squared(x[:, : one.shape[1]], one).argmin(1) * len(two) + squared(x[:, one.shape[1] :], two).argmin(1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32))], names=[*names, "cell"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in entries.schema.fields)
    return entries.mapInArrow(tidied(run), schema + ", cell int")


def layout(sizes: np.ndarray, limit: int = GROUP) -> tuple[np.ndarray, np.ndarray]:
    """(first group of each cell, number of its groups): cells side by side share a group while they fit, larger ones have several."""
    first, pieces = np.zeros(len(sizes), np.int32), np.maximum(1, -(-sizes // limit)).astype(np.int32)
    group = held = 0
    for cell, size in enumerate(sizes.tolist()):
        if held and held + size > limit:
            group, held = group + 1, 0
        first[cell], held = group, held + size
        if size > limit:
            group, held = group + int(pieces[cell]), 0
    return first, pieces


def probes(queries: DataFrame, books: tuple[np.ndarray, np.ndarray], sizes: np.ndarray, groups: tuple[np.ndarray, np.ndarray], wanted: int) -> DataFrame:
    """k1, k2, embedding, group, cells: the cells that each query looks at, by group."""
    shared = queries.sparkSession.sparkContext.broadcast((*books, sizes, *groups))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two, sizes, first, pieces = shared.value
        for batch in batches:
            x = matrix(batch.column(2))
            if not len(x):
                continue
            a, b = squared(x[:, : one.shape[1]], one), squared(x[:, one.shape[1] :], two)
            row, group, cell = [], [], []
            for k, (p, q) in enumerate(zip(a, b)):
                cells = np.array(walk(p, q, sizes, wanted), np.int32)
                many = pieces[cells]
                row.append(np.full(many.sum(), k))
                group.append(np.repeat(first[cells] - np.cumsum(many) + many, many) + np.arange(many.sum()))
                cell.append(np.repeat(cells, many))
            row, group, cell = (np.concatenate(v) for v in (row, group, cell))
            order = np.lexsort((cell, group, row))
            row, group, cell = row[order], group[order], cell[order]
            begin = np.flatnonzero(np.append(True, (np.diff(row) != 0) | (np.diff(group) != 0)))
            lists = pa.ListArray.from_arrays(pa.array(np.append(begin, len(cell)).astype(np.int32)), pa.array(cell.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(pa.array(row[begin])) for k in range(3)), pa.array(group[begin].astype(np.int32)), lists], names=["k1", "k2", "embedding", "group", "cells"])

    return queries.select("k1", "k2", "embedding").mapInArrow(tidied(run), "k1 bigint, k2 bigint, embedding array<float>, group int, cells array<int>")


def _best(found: list[tuple[np.ndarray, np.ndarray]], k: int) -> tuple[np.ndarray, np.ndarray]:
    d, ids = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
    order = np.lexsort((ids, d))[:k]
    return d[order], ids[order]


class Nearest:
    """The k + 1 nearest entries that some queries have met so far.

    A product of matrices gives all distances of a cell's queries and entries but for rounding; only pairs that may be among
    the best by these are measured exactly.
    """

    def __init__(self, keys: np.ndarray, x: np.ndarray, cells: list[list[int]], k: int):
        self.keys, self.x, self.k = keys, x, k
        self.norms, self.limit = (x * x).sum(1), np.full(len(x), np.inf)
        flat = np.array([c for own in cells for c in own], np.int64)
        of = np.repeat(np.arange(len(x)), [len(c) for c in cells])
        order = np.argsort(flat, kind="stable")
        self.cells, self.of = flat[order], of[order]
        self.held = [(np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))]

    def meet(self, cell: int, y: np.ndarray, ids: pa.ListArray) -> None:
        asks = self.of[slice(*np.searchsorted(self.cells, [cell, cell + 1]))]
        if not len(asks):
            return
        norms = (y * y).sum(1)
        d = self.norms[asks][:, None] - 2 * self.x[asks] @ y.T + norms[None]
        rounding = 1e-12 * (self.norms[asks] + norms.max())
        if len(y) > self.k:
            self.limit[asks] = np.minimum(self.limit[asks], np.partition(d, self.k, axis=1)[:, self.k] + rounding)
        a, b = np.nonzero(d <= (self.limit[asks] + rounding)[:, None])
        exact = np.sqrt(((y[b] - self.x[asks[a]]) ** 2).sum(1))
        offsets, flat = ids.offsets.to_numpy().astype(np.int64), ids.values.to_numpy()
        many = np.diff(offsets)[b]
        at = np.repeat(offsets[b] - np.cumsum(many) + many, many) + np.arange(many.sum())
        self.held.append((np.repeat(asks[a], many), np.repeat(exact, many), flat[at]))
        if sum(len(h[0]) for h in self.held[1:]) > PENDING:
            self.keep_best()

    def keep_best(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        of, d, ids = (np.concatenate(v) for v in zip(*self.held))
        order = np.lexsort((ids, d, of))
        of, d, ids = of[order], d[order], ids[order]
        first = np.flatnonzero(np.append(True, np.diff(of) != 0)) if len(of) else np.zeros(0, np.int64)
        rank = np.arange(len(of)) - np.repeat(first, np.diff(np.append(first, len(of))))
        last = rank == self.k
        self.limit[of[last]] = np.minimum(self.limit[of[last]], d[last] ** 2)
        kept = rank <= self.k
        self.held = [(of[kept], d[kept], ids[kept])]
        return self.held[0]

    def batch(self) -> pa.RecordBatch:
        of, d, ids = self.keep_best()
        return pa.RecordBatch.from_arrays([pa.array(self.keys[of, 0]), pa.array(self.keys[of, 1]), pa.array(ids), pa.array(d)], names=["k1", "k2", "vec_id", "score"])


def scan_groups(probes_: DataFrame, index: DataFrame, k: int) -> DataFrame:
    """k1, k2, vec_id, score: for each query and group the k + 1 nearest. Entries of a group stream past its queries."""
    asked = probes_.groupBy("group").agg(F.ceil(F.count(F.lit(1)) / SALT).cast("int").alias("shares"))
    left = probes_.join(asked, "group").select("group", F.pmod(F.xxhash64(*KEY), "shares").cast("int").alias("salt"), F.lit(-1).alias("cell"), "k1", "k2", "embedding", F.array().cast("array<bigint>").alias("ids"), "cells")
    right = index.join(asked, "group").select("group", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("salt"), "cell", "k1", "k2", "embedding", "ids", F.array().cast("array<int>").alias("cells"))
    rows = left.unionByName(right).repartition("group", "salt").sortWithinPartitions("group", "salt", "cell")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, asks, best = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            group, salt, cell = (batch.column(c).to_numpy() for c in range(3))
            cuts = np.flatnonzero((np.diff(group) != 0) | (np.diff(salt) != 0) | (np.diff(cell) != 0)) + 1
            for begin, end in zip([0, *cuts], [*cuts, len(cell)]):
                part, spot = batch.slice(begin, end - begin), (group[begin], salt[begin])
                if spot != here:
                    if best:
                        yield best.batch()
                    here, asks, best = spot, [], None
                x = matrix(part.column(5))
                if cell[begin] < 0:
                    asks.append((np.stack([part.column(c).to_numpy() for c in (3, 4)], axis=1), x, part.column(7).to_pylist()))
                elif asks:
                    if best is None:
                        keys, points, cells = zip(*asks)
                        best = Nearest(np.concatenate(keys), np.concatenate(points), [c for part in cells for c in part], k)
                    best.meet(int(cell[begin]), x, part.column(6))
        if best:
            yield best.batch()

    return rows.mapInArrow(tidied(run), "k1 bigint, k2 bigint, vec_id bigint, score double")


def calibrate(index: DataFrame, queries: DataFrame, books: tuple[np.ndarray, np.ndarray], sizes: np.ndarray, k: int) -> int:
    """Entries to look at for RECALL: TRIALS queries are compared with every entry, and each true neighbour's place is found."""
    trial = matrix(queries.select("embedding").orderBy("k1", "k2").limit(TRIALS).toArrow()["embedding"])
    if not len(trial):
        return 1
    shared = index.sparkSession.sparkContext.broadcast(trial)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trial = shared.value
        best = [(np.zeros(0), np.zeros(0, np.int64))] * len(trial)
        for batch in batches:
            x = matrix(batch.column(0))
            if len(x):
                cell, d = batch.column(1).to_numpy().astype(np.int64), squared(trial, x)
                best = [_best([b, (row, cell)], k + 1) for b, row in zip(best, d)]
        at = np.repeat(np.arange(len(trial)), [len(d) for d, _ in best]).astype(np.int32)
        d, cell = (np.concatenate(x) for x in zip(*best))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(d), pa.array(cell)], names=["trial", "d", "cell"])

    found = index.select("embedding", "cell").mapInArrow(tidied(run), "trial int, d double, cell bigint")
    order = Window.partitionBy("trial").orderBy("d", "cell")
    true = found.withColumn("_r", F.row_number().over(order)).where((F.col("_r") > 1) & (F.col("_r") <= k + 1)).select("trial", "cell").collect()
    one, two = books
    a, b = squared(trial[:, : one.shape[1]], one), squared(trial[:, one.shape[1] :], two)
    places = []
    for t in range(len(trial)):
        cells = np.array(walk(a[t], b[t], sizes, int(sizes.sum())))
        before = dict(zip(cells.tolist(), (np.cumsum(sizes[cells]) - sizes[cells]).tolist()))
        places += [before[r["cell"]] + 1 for r in true if r["trial"] == t]
    return int(np.quantile(places, RECALL, method="higher")) if places else 1


def nearest(vectors: DataFrame, is_query: Column, k: int = 10, wanted: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of each row that ``is_query`` (of vec_id) marks, among all other rows.

    ``wanted``: entries that a query looks at; measured if not given.
    """
    spark = vectors.sparkSession
    small_batches(spark, 2048)
    rows = valid(vectors.withColumn("vec_id", F.col("vec_id").cast("bigint")))
    entries = cut(distinct_vectors(rows, k))
    sample = entries.select("embedding").orderBy("k1", "k2").limit(SAMPLE).toArrow()["embedding"]
    n = entries.count()
    if not n:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    x = matrix(sample)
    half = (x.shape[1] + 1) // 2
    size = int(np.clip(np.sqrt(n / 32), LEAST_K, MOST_K))
    books = (codebook(x[:, :half], size), codebook(x[:, half:], size) if half < x.shape[1] else np.zeros((1, 0)))
    index = cut(assign(entries, books))
    sizes = np.zeros(len(books[0]) * len(books[1]), np.int64)
    for r in index.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect():
        sizes[r["cell"]] = r["n"]
    asking = cut(rows.where(is_query).select("vec_id", *KEY).distinct().withColumnRenamed("vec_id", "query_id"))
    queries = index.join(asking.select(*KEY).distinct(), list(KEY), "left_semi")
    wanted = max(wanted or calibrate(index, queries, books, sizes, k), k + 1)
    groups = layout(sizes)
    # At most MOST_K ** 2 rows.
    where = spark.createDataFrame(pa.table({"cell": np.arange(len(sizes), dtype=np.int32), "first": groups[0], "pieces": groups[1]}))
    dealt = index.join(F.broadcast(where), "cell").withColumn("group", (F.col("first") + F.pmod(F.xxhash64(*KEY), "pieces")).cast("int"))
    found = scan_groups(probes(queries, books, sizes, groups, wanted), dealt, k)
    order = Window.partitionBy(*KEY).orderBy("score", "vec_id")
    best = found.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k + 1)
    mine = asking.join(best, list(KEY)).where("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id", *KEY).orderBy("score", "vec_id"))
    return mine.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
