"""Sharding by a hierarchical weighted hash tree: region, then rack, then shard.

At every level each child draws ln(u) / weight with u hashed from the key and the child; the largest draw wins. A draw
depends on that child alone, so a changed weight moves rows only into or out of its subtree. A new shard gets a subtree of
its own, hence it takes rows and no other shard does.

Nulls: a null key draws as the empty text, a null text has 0 bytes and crc32 0. Equal keys share a shard; repeated rows get
slots of their own. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bits of a draw: as many as a double holds exactly.
BITS = 53
#: Blocks of a shard that get their slots side by side.
BLOCKS = 256


@dataclass(frozen=True)
class Tree:
    """weights[region][rack][shard]; shards are numbered in that order."""

    weights: tuple[tuple[tuple[float, ...], ...], ...]

    @staticmethod
    def even(regions: int, racks: int, shards: int) -> "Tree":
        return Tree((((1.0,) * shards,) * racks,) * regions)

    def grown(self, weight: float = 1.0) -> "Tree":
        return Tree(self.weights + (((weight,),),))

    @property
    def shards(self) -> int:
        return sum(len(rack) for region in self.weights for rack in region)


def _total(node) -> float:
    return float(sum(map(_total, node))) if isinstance(node, Sequence) else float(node)


def _array(node) -> Column:
    return F.array(*map(_array, node)) if isinstance(node, Sequence) else F.lit(node)


def _winner(key: Column, path: Column, weights: Column) -> Column:
    """Index of the child with the largest draw; a child of no weight never wins against one of any."""

    def draw(weight: Column, child: Column) -> Column:
        hashed = F.xxhash64(key, path, child).bitwiseAND(F.lit(2**BITS - 1))
        straw = F.ln((hashed + F.lit(0.5)) / F.lit(float(2**BITS))) / weight
        return F.struct(F.when(weight > 0, straw).otherwise(F.lit(float("-inf"))).alias("draw"), child.alias("child"))

    return F.array_max(F.transform(weights, draw))["child"]


def place(df: DataFrame, tree: Tree, key: Column, name: str) -> DataFrame:
    """``df`` with the shard of each row in column ``name``."""
    if _total(tree.weights) <= 0:
        raise ValueError("a tree without weight can't be drawn from")
    key, first, at = key.cast("string"), [], 0
    for region in tree.weights:
        first.append([])
        for rack in region:
            first[-1].append(at)
            at += len(rack)
    child = lambda node, *path: child(F.get(node, path[0]), *path[1:]) if path else node
    region, rack = F.col("_region"), F.col("_rack")
    df = df.withColumn("_region", _winner(key, F.lit(""), _array([_total(r) for r in tree.weights])))
    df = df.withColumn("_rack", _winner(key, F.concat(region.cast("string"), F.lit("/")), child(_array([[_total(k) for k in r] for r in tree.weights]), region)))
    path = F.concat(region.cast("string"), F.lit("/"), rack.cast("string"), F.lit("/"))
    leaf = _winner(key, path, child(_array([[[float(x) for x in k] for k in r] for r in tree.weights]), region, rack))
    return df.withColumn(name, (leaf + child(_array(first), region, rack)).cast("int")).drop("_region", "_rack")


def slots(df: DataFrame, shard: str, order: list[str], shards: int, blocks: int = BLOCKS) -> DataFrame:
    """``df`` with a gapless ``slot`` from 0 in each shard.

    Rows are numbered inside blocks of a shard, so no task sorts a whole shard; the offsets of the blocks are at most
    shards * blocks rows, which is the bound of the broadcast.
    """
    df = df.withColumn("_block", F.pmod(F.xxhash64(*order), F.lit(blocks)))
    sizes = df.groupBy(shard, "_block").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(shard).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(shard, "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(shard, "_block").orderBy(*order)
    numbered = df.withColumn("_row", F.row_number().over(inside))
    if shards * blocks <= 1_000_000:
        offsets = F.broadcast(offsets)
    return numbered.join(offsets, [shard, "_block"]).withColumn("slot", (F.col("_row") - 1 + F.col("_offset")).cast("bigint")).drop("_row", "_offset", "_block")


def shard_documents(docs: DataFrame, tree: Tree) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot and grown_shard (with one more shard)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    df = docs.select("doc_id", (F.octet_length(text) + 16).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    df = place(place(df, tree, key, "shard"), tree.grown(), key, "grown_shard")
    return slots(df, "shard", ["doc_id", "text_crc32", "size"], tree.shards)
