"""N-gram Jaccard join by parity sketches, and the groups that its links make.

A text's set is hashed into a sparse parity sketch: each shingle flips one cell, so two sketches differ in no more cells than
the sets differ in shingles. For sets of sizes a and b that link, the difference is at most d = (1-t)/(1+t) (a+b). A sketch is
cut into more than d chunks, the same cut for all sets of a size band (and for those just below it), so linked sets agree on
a chunk that is not empty. Each set offers its d+1 fullest chunks in an order that depends on the chunk alone; two linked
sets share one of these (prefix principle), or both are so small that they offer a marker. Chunks are joined by a 64-bit
fingerprint; a dense sketch of 512 bits then prunes pairs by Hamming distance; whole texts are compared at last.

Pairs inside a group need no test: candidates are tested against one centre of their bucket first, groups are formed, and
only pairs of a bucket that are still apart are tested one by one. Copies of a set count as one node.

Nulls: a null or empty text has no set and is a group of its own. Repeated rows are copies. Two sets are taken as equal when
64-bit digests agree.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyjoin.llm.arrow import blocks, texts, tidied
from tallyjoin.llm.common import bounded, cut, discard, release, shared_folder, small_batches

#: Words of a shingle and the similarity of a link, in hundredths.
WORDS, PERCENT = 4, 85
#: 64-bit words of the dense sketch; members that share one copy of a centre; ids that may be broadcast.
DENSE, SALT, ID_ROWS = 8, 2000, 2_000_000
#: Rounds of tests against centres before all pairs still apart are tested: how many centres a node is held against in each,
#: and how many of a node's buckets and of a bucket's centres are looked at for them.
STARS, STAR_KEYS, STAR_CENTRES = (2, 2), 6, 4
#: Edges whose components one task finds: 16 bytes each, and a few times that while it works.
EDGE_ROWS = 1_000_000
#: Earlier keys that a row carries in the last round; rows of a bucket that one task is given at most.
PRIOR_KEYS, HOT = 16, 20_000

U = np.uint64
_K = [U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F), U(0x165667B19E3779F9), U(0xD6E8FEB86659FD93), U(0xA0761D6478BD642F)]
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(32))) * _K[0]
    x = (x ^ (x >> U(29))) * _K[1]
    return x ^ (x >> U(32))


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64."""
    base = 0x5851F42D4C957F2D
    down = np.full(n, U(pow(base, -1, 1 << 64)))
    up = np.full(n, U(base))
    up[0] = down[0] = U(1)
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


_SYMBOLS = mix(np.arange(1, 257, dtype=np.uint64))


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, offsets of texts in words); words are runs of other bytes than ASCII white space, A-Z lower-cased."""
    data = _LOWER[data]
    n = len(data)
    word = ~_SPACE[data]
    fresh = np.zeros(n + 1, bool)
    fresh[offsets] = True
    before = np.append(False, word[:-1]) if n else np.zeros(0, bool)
    starts = np.flatnonzero(word & (~before | fresh[:n]))
    after = np.append(word[1:], False) if n else np.zeros(0, bool)
    ends = np.flatnonzero(word & (~after | fresh[1:])) + 1
    up, down = _powers(1 << max(20, int(n).bit_length()))
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_SYMBOLS[data] * up[:n], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts]), np.searchsorted(starts, offsets)


def shingle_sets(column: pa.Array, words: int = WORDS) -> list[np.ndarray]:
    """The sorted different shingles of each text, as 64-bit hashes."""
    hashes, at = word_hashes(*texts(column))
    m = max(0, len(hashes) - words + 1)
    runs = np.zeros(m, np.uint64)
    for k in range(words):
        runs += hashes[k : k + m] * _K[k % 5] * U(2 * (k // 5) + 1)
    runs = mix(runs + U(words))
    out = []
    for begin, end in zip(at[:-1], at[1:]):
        if end - begin >= words:
            out.append(np.unique(runs[begin : end - words + 1]))
        else:
            own = hashes[begin:end]
            whole = sum((int(h) * int(_K[k % 5]) * (2 * (k // 5) + 1) for k, h in enumerate(own)), int(end - begin)) & (1 << 64) - 1
            out.append(mix(np.array([whole], np.uint64)) if end > begin else np.zeros(0, np.uint64))
    return out


def difference_bound(n: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """The largest symmetric difference between a set of size n and one that it links with."""
    return (100 - percent) * (n + 100 * n // percent) // (100 + percent)


def chunk_keys(sets: list[np.ndarray], percent: int = PERCENT) -> list[np.ndarray]:
    """For each set the fingerprints of the chunks it offers, in its own size band and the next where a partner may be there."""
    out: list[list[np.ndarray]] = [[] for _ in sets]
    sizes = np.array([len(s) for s in sets], np.int64)
    bounds = difference_bound(sizes, percent)
    for step in (0, 1):
        bands = np.array([int(n).bit_length() - 1 for n in sizes], np.int64) + step
        use = np.flatnonzero((bounds > 0) & ((step == 0) | (100 * sizes // percent >= 1 << np.maximum(bands, 0))))
        if not len(use):
            continue
        h, own = np.concatenate([sets[i] for i in use]), np.repeat(np.arange(len(use)), sizes[use])
        chunks = (2 * (1 << bands[use]) * min(1.0, 1.15 * 0.01 * (100 - percent) / (0.01 * percent)) + 8).astype(np.uint64)
        chunk = ((h >> U(32)) * chunks[own]) >> U(32)
        # Sets are sorted, so a chunk's shingles are side by side.
        first = np.flatnonzero(np.append(True, (chunk[1:] != chunk[:-1]) | (own[1:] != own[:-1])))
        # Each cell (chunk, low half of the hash) has a random number; their XOR depends on the cells of odd count alone.
        print_ = np.bitwise_xor.reduceat(mix((h & U(0xFFFFFFFF)) + (chunk << U(32)) * U(3)), first)
        key = mix(print_ ^ mix(chunk[first] + U(1 << 40) * bands[use][own[first]].astype(np.uint64)))
        fill, doc = np.diff(np.append(first, len(h))), own[first]
        order = np.lexsort((key, -fill, doc))
        key, doc = key[order], doc[order]
        begin = np.searchsorted(doc, np.arange(len(use)))
        end = np.append(begin[1:], len(doc))
        for k, i in enumerate(use):
            out[i].append(key[begin[k] : end[k]][: bounds[i] + 1])
            if end[k] - begin[k] <= bounds[i]:
                out[i].append(mix(np.array([bands[i]], np.uint64) + U(1 << 50)))
    return [np.concatenate(o) if o else np.zeros(0, np.uint64) for o in out]


def dense_sketch(s: np.ndarray) -> np.ndarray:
    """Parity of the shingles in each of 64 * DENSE cells."""
    odd = np.bincount((s % U(64 * DENSE)).astype(np.int64), minlength=64 * DENSE) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def node_of(s: np.ndarray) -> int:
    return int.from_bytes(hashlib.sha1(s.tobytes()).digest()[:8], "big", signed=True)


def sketch(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, hash of the text, n, node (null without a set), keys and cells of the sketch (null if the task gave that node's before)."""
    small_batches(docs.sparkSession)
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told: set[int] = set()
        for block in blocks(batches):
            sets = shingle_sets(block.column(1), words)
            nodes = [node_of(s) if len(s) else None for s in sets]
            lead = []
            for node in nodes:
                lead.append(node is not None and node not in told)
                told.add(node)
            some = [k for k, x in enumerate(lead) if x]
            keys: list = [None] * len(sets)
            for k, found in zip(some, chunk_keys([sets[k] for k in some], percent)):
                keys[k] = found.view(np.int64)
            cells = [dense_sketch(s) if x else None for s, x in zip(sets, lead)]
            yield pa.RecordBatch.from_arrays(
                [block.column(0), block.column(2), pa.array([len(s) for s in sets], pa.int64()), pa.array(nodes, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(cells, pa.list_(pa.int64()))],
                names=["doc_id", "hash", "n", "node", "keys", "cells"],
            )

    return docs.select("doc_id", "text", F.xxhash64("text").alias("hash")).mapInArrow(tidied(run), f"doc_id {id_type}, hash bigint, n bigint, node bigint, keys array<bigint>, cells array<bigint>")


def stored(df: DataFrame, folder: str, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again."""
    df.write.parquet(f"{folder}/{name}")
    return df.sparkSession.read.parquet(f"{folder}/{name}")


def distance(a: str, b: str) -> Column:
    """Hamming distance of the dense sketches."""
    cells = [F.bit_count(F.get(f"{a}.cells", F.lit(k)).bitwiseXOR(F.get(f"{b}.cells", F.lit(k)))) for k in range(DENSE)]
    return reduce(lambda x, y: x + y, cells)


def close(a: str, b: str, percent: int = PERCENT) -> Column:
    """Whether sizes and Hamming distance allow a link of the sketches a and b (n and cells)."""
    na, nb = F.col(f"{a}.n"), F.col(f"{b}.n")
    size = F.least(na, nb) * 100 >= F.greatest(na, nb) * percent
    return size & (distance(a, b) * (100 + percent) <= (na + nb) * (100 - percent))


def verified(pairs: DataFrame, node_texts: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, centre) whose texts link. Members stream past their centre's text; a large star has several copies of it."""
    small_batches(pairs.sparkSession)
    members = pairs.groupBy("centre").agg(F.count(F.lit(1)).alias("members"))
    dealt = pairs.join(members, "centre").withColumn("salt", F.pmod(F.xxhash64("a"), F.ceil(F.col("members") / SALT)).cast("int"))
    members = dealt.select("centre", "salt", F.lit(1).alias("role"), F.col("a").alias("node"))
    centres = dealt.select("centre", "salt").distinct().select("centre", "salt", F.lit(0).alias("role"), F.col("centre").alias("node"))
    rows = centres.unionByName(members).join(node_texts, "node").select("centre", "salt", "role", "node", "text")
    rows = rows.repartition("centre", "salt").sortWithinPartitions("centre", "salt", "role", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, own = None, None
        for block in blocks(batches):
            a, c = [], []
            sets = shingle_sets(block.column(4), words)
            for centre, salt, role, node, s in zip(*(block.column(k).to_pylist() for k in range(4)), sets):
                if node_of(s) != node:
                    continue  # another text of a repeated id
                if role == 0:
                    here, own = (centre, salt), s
                elif here == (centre, salt):
                    both = len(np.intersect1d(own, s, assume_unique=True))
                    if 100 * both >= percent * (len(own) + len(s) - both):
                        a.append(node)
                        c.append(centre)
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(c, pa.int64())], names=["a", "centre"])

    return rows.mapInArrow(tidied(run), "a bigint, centre bigint")


def least_labels(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, label) for every node of the edges (a, b) that is not the smallest of its component: label is the smallest."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = ends[: len(a)], ends[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low, high = np.minimum(root[u], root[v]), np.maximum(root[u], root[v])
        apart = low < high
        if not apart.any():
            hangs = root < np.arange(len(nodes))
            return nodes[hangs], nodes[root[hangs]]
        # Each root hangs from its least neighbouring root, then every node from the root above it.
        np.minimum.at(root, high[apart], low[apart])
        u, v = u[apart], v[apart]
        while (root[root] != root).any():
            root = root[root]


def connected(edges: DataFrame, rows: int = EDGE_ROWS) -> DataFrame:
    """(node, label) for every node of ``edges`` (a, b) that is not the smallest of its component: label is the smallest.

    Up to ``rows`` edges are joined up in one task, which needs no rounds of shuffles; more of them by the whole cluster.
    """
    if edges.limit(rows + 1).count() > rows:
        return _by_stars(edges)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
        if held:
            found = least_labels(*(np.concatenate(side) for side in zip(*held)))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], names=["node", "label"])

    return cut(edges.select("a", "b").repartition(1).mapInArrow(tidied(run), "node bigint, label bigint"))


def _by_stars(edges: DataFrame) -> DataFrame:
    """connected() for any number of edges.

    Large-star and small-star steps, each written out; their number grows with the logarithm of a component's size.
    """
    tree = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while True:
        both = tree.unionByName(tree.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.withColumn("m", F.least(F.min("v").over(_by("u")), "u")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        low = large.withColumn("m", F.min("v").over(_by("u")))
        # Each node hangs from its least neighbour, and so do the others.
        tree = cut(low.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct())
        release(edges.sparkSession)
        # Done when every node hangs from one root and no root hangs from another.
        ends = tree.select("u", F.lit(1).alias("hangs"), F.lit(0).alias("root")).unionByName(tree.select(F.col("v").alias("u"), F.lit(0).alias("hangs"), F.lit(1).alias("root")))
        if ends.groupBy("u").agg(F.sum("hangs").alias("h"), F.max("root").alias("r")).where("h > 1 OR h = 1 AND r = 1").isEmpty():
            return tree.withColumnsRenamed({"u": "node", "v": "label"})


def link_components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, hash of the text, n_shingles, node, component_id and group for each row of ``docs``.

    component_id: the smallest doc_id reachable by links; group: a node, the same for all rows that links connect.
    """
    spark = docs.sparkSession
    folder = shared_folder(spark)
    rows = stored(sketch(docs, words, percent), folder, "sketches")
    leads = rows.where(F.col("keys").isNotNull())
    offered = leads.where(F.size("keys") > 0).select(F.explode("keys").alias("key"), "node")
    # Nearly all keys are offered once: first keys alone are counted, and nodes (a copy may have been told by several tasks) for the rest.
    again = offered.groupBy("key").agg(F.count(F.lit(1)).alias("times")).where("times > 1").select("key")
    kept = stored(offered.join(bounded(stored(again, folder, "again"), ID_ROWS), "key", "left_semi").distinct(), folder, "kept")
    sizes = cut(kept.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1"))
    buckets = stored(kept.join(bounded(sizes.select("key"), ID_ROWS), "key", "left_semi"), folder, "buckets")
    for name in ("again", "kept"):
        discard(spark, f"{folder}/{name}")
    release(spark)
    hot = bounded(sizes.where(F.col("size") > HOT).select("key", F.ceil(F.col("size") / HOT).cast("int").alias("parts")), ID_ROWS)
    involved = buckets.select("node").distinct()
    sketches = cut(leads.join(involved, "node", "left_semi").groupBy("node").agg(F.first("n").alias("n"), F.first("cells").alias("cells")))
    least = rows.where(F.col("node").isNotNull()).groupBy("node").agg(F.min("doc_id").alias("own"), F.min(_first_row()).alias("row"))
    chosen = cut(least.join(involved, "node", "left_semi").select("node", F.col("row.doc_id").alias("_id"), F.col("row.hash").alias("_hash")))

    edges, tested, labels = None, None, None
    for turn in range(len(STARS) + 1):
        parts = buckets
        if labels is not None:
            parts = parts.join(labels, "node", "left").select("key", "node", F.coalesce("label", "node").alias("label"))
            span = parts.groupBy("key").agg(F.min("label").alias("l"), F.max("label").alias("h")).where("l < h").select("key")
            parts = cut(parts.join(span, "key", "left_semi"))
            release(spark)
        else:
            parts = parts.withColumn("label", F.col("node"))
        pairs = _against_centres(parts, hot, turn) if turn < len(STARS) else _apart(parts, sketches, percent)
        if tested is not None:
            pairs = pairs.join(tested, ["a", "centre"], "left_anti")
        a, b = sketches.alias("a"), sketches.alias("b")
        near = pairs.alias("p").join(a, F.col("p.a") == F.col("a.node")).join(b, F.col("p.centre") == F.col("b.node")).where(close("a", "b", percent))
        near = near.select("p.a", "p.centre", distance("a", "b").alias("d"))
        if turn < len(STARS):
            nearest = _by("a").orderBy("d", "centre")
            near = near.withColumn("k", F.row_number().over(nearest)).where(F.col("k") <= STARS[turn])
        pairs = cut(near.select("a", "centre"))
        release(spark)
        if pairs.isEmpty():
            continue
        needed = pairs.select("a").union(pairs.select("centre")).distinct().withColumnRenamed("a", "node")
        ids = bounded(chosen.join(needed, "node", "left_semi"), ID_ROWS)
        texts_ = docs.select("doc_id", "text", F.xxhash64("text").alias("hash"))
        texts_ = texts_.join(ids, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("hash") == F.col("_hash")))
        found = cut(verified(pairs, texts_.select("node", "text").dropDuplicates(["node"]), words, percent))
        release(spark)
        tested = pairs if tested is None else tested.unionByName(pairs)
        edges = found if edges is None else edges.unionByName(found)
        labels = connected(edges.select("a", F.col("centre").alias("b")))
        release(spark)

    least = least.select("node", "own")
    if labels is not None:
        linked = labels.unionByName(labels.select(F.col("label").alias("node"), "label").distinct())
        group = linked.join(least, "node").groupBy("label").agg(F.min("own").alias("component_id"))
        linked = linked.join(group, "label")
        least = least.join(linked, "node", "left").select("node", F.coalesce("component_id", "own").alias("component_id"), F.coalesce("label", "node").alias("group"))
    else:
        least = least.select("node", F.col("own").alias("component_id"), F.col("node").alias("group"))
    out = rows.select("doc_id", "hash", F.col("n").alias("n_shingles"), "node").join(least, "node", "left")
    return out.select("doc_id", "hash", "n_shingles", "node", F.coalesce("component_id", "doc_id").alias("component_id"), "group")


def _first_row() -> Column:
    """A row as what its order hangs on: least id first, no id last, then the hash of the text."""
    return F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"), F.col("hash").alias("hash"))


def _by(key: str):
    from pyspark.sql import Window

    return Window.partitionBy(key)


def _against_centres(parts: DataFrame, hot: DataFrame, turn: int) -> DataFrame:
    """(a, centre): nodes with the centres of some of their buckets that they are apart from.

    Centres of a bucket are its least nodes in an order that changes with the turn. Which buckets are looked at is no matter
    of correctness, as all pairs still apart are tested at last. Both ranks are limited in each task before they are shuffled,
    and the nodes of a ``hot`` bucket are dealt over copies of its centres.
    """
    some = _by("node").orderBy(F.xxhash64("key", F.lit(turn)), "key")
    probes = parts.withColumn("k", F.row_number().over(some)).where(F.col("k") <= STAR_KEYS).drop("k")
    order = _by("key").orderBy(F.xxhash64("node", F.lit(turn)), "node")
    centres = parts.withColumn("k", F.row_number().over(order)).where(F.col("k") <= STAR_CENTRES)
    centres = centres.select("key", F.col("node").alias("centre"), F.col("label").alias("other"))
    copies = F.coalesce("parts", F.lit(1))
    probes = probes.join(hot, "key", "left").withColumn("salt", F.pmod(F.xxhash64("node"), copies).cast("int")).drop("parts")
    centres = centres.join(hot, "key", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), copies - 1))).drop("parts")
    return probes.join(centres, ["key", "salt"]).where("label <> other").select(F.col("node").alias("a"), "centre").distinct()


def _apart(parts: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """(a, centre): all pairs of a bucket whose groups differ; sizes and sketches are compared inside the join.

    Pairs of one group never meet: the groups of a bucket are numbered, and two numbers meet only at the highest bit in which
    they differ, one on either side of the join. A pair that shares many buckets is to come out of few: at each it is passed
    over if the keys just before, of which either node carries some, have one in common. At the least common key nothing before
    is common, so no pair is lost.
    """
    labels = parts.select("key", "label").distinct()
    ranked = labels.withColumn("rank", F.row_number().over(_by("key").orderBy("label")) - 1)
    ranked = ranked.join(labels.groupBy("key").agg(F.count(F.lit(1)).alias("groups")), "key")
    before = _by("node").orderBy("key").rowsBetween(-PRIOR_KEYS, -1)
    # The narrow join comes first: prior keys and sketches are added by node, side by side, and shuffled once.
    held = parts.join(ranked, ["key", "label"]).drop("label").withColumn("prior", F.collect_list("key").over(before)).join(sketches, "node")
    held = held.withColumn("bit", F.explode(F.sequence(F.lit(0), F.length(F.bin(F.col("groups") - 1)) - 1)))
    held = held.withColumn("above", F.expr("shiftright(rank, bit + 1)")).withColumn("side", F.expr("shiftright(rank, bit) & 1"))
    # The least number that could stand against side 0; where no group has it, nothing does.
    held = held.where("side = 1 OR shiftleft(2 * above + 1, bit) < groups").drop("rank", "groups")
    a, b = held.where("side = 0").alias("a"), held.where("side = 1").alias("b")
    meet = (F.col("a.key") == F.col("b.key")) & (F.col("a.bit") == F.col("b.bit")) & (F.col("a.above") == F.col("b.above"))
    once = ~F.arrays_overlap("a.prior", "b.prior")
    found = a.join(b, meet & close("a", "b", percent) & once)
    return found.select(F.greatest("a.node", "b.node").alias("a"), F.least("a.node", "b.node").alias("centre")).distinct()


def components_query(docs: DataFrame) -> DataFrame:
    return link_components(docs).select("doc_id", "n_shingles", "component_id")


def keep_one(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one row of each group: that of the smallest id, where ids repeat of the smallest hash of the text, a row
    without an id only where none has one. Texts without a set all stay."""
    marked = cut(link_components(docs.select("doc_id", "text"), words, percent).where(F.col("node").isNotNull()).select("doc_id", "hash", "group"))
    pair = F.col("doc_id").alias("_id"), F.col("hash").alias("_hash")
    chosen = cut(marked.groupBy("group").agg(F.min(_first_row()).alias("row")).select(F.col("row.doc_id").alias("_id"), F.col("row.hash").alias("_hash")))
    is_chosen = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("hash") == F.col("_hash"))
    dropped = bounded(cut(marked.join(chosen, is_chosen, "left_anti").select(*pair).distinct()), ID_ROWS)
    of = lambda other: docs["doc_id"].eqNullSafe(other["_id"]) & (F.xxhash64(docs["text"]) == other["_hash"])
    out = docs.join(dropped, of(dropped), "left_anti")
    twice = cut(marked.groupBy(*pair).count().where("count > 1").join(chosen.withColumnsRenamed({"_id": "doc_id", "_hash": "hash"}), is_chosen, "left_semi"))
    if twice.isEmpty():
        return out
    return out.join(twice, of(twice), "left_anti").unionByName(out.join(twice, of(twice), "left_semi").dropDuplicates(["doc_id", "text"]))
