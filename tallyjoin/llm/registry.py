"""Queries of the subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyjoin.llm import oracles
from tallyjoin.llm.bpe import token_digest
from tallyjoin.llm.common import table
from tallyjoin.llm.decontaminate import contamination_digest
from tallyjoin.llm.hash_tree import Tree, shard_documents
from tallyjoin.llm.language import language_query
from tallyjoin.llm.licenses import license_digest
from tallyjoin.llm.multi_index import nearest
from tallyjoin.llm.parity_join import components_query
from tallyjoin.llm.quality import quality_query
from tallyjoin.llm.secrets import secret_digest
from tallyjoin.llm.toxicity import toxicity_query


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_query(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination_digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components_query(table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_query(table(spark, sf_dir, "documents"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return token_digest(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_digest(table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_query(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_digest(table(spark, sf_dir, "documents"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """40 shards of equal weight: 4 regions of 2 racks of 5."""
    df = shard_documents(table(spark, sf_dir, "documents"), Tree.even(4, 2, 5))
    return df.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("slot").cast("bigint").alias("slot"), "grown_shard")


def license_scan_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op6 that SQL can express."""
    return op6_license_scan(spark, sf_dir).drop("labels", "score")


def secret_scan_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op9 that SQL can express."""
    return op9_secret_scan(spark, sf_dir).drop("spans")


_ALL = (op1_toxicity, op2_decontamination, op3_ngram_jaccard, op4_language_id, op5_byte_bpe, op6_license_scan, op7_quality, op8_nearest_neighbours, op9_secret_scan, op10_sharding)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (*_ALL, license_scan_base, secret_scan_base)}
ORACLES: dict[str, str] = dict(oracles.ORACLES)
