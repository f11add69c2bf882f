"""A training corpus from raw documents, in five stages; each is written as Parquet and read again as the next one's input."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyjoin.llm import bpe, decontaminate, parity_join, quality, secrets
from tallyjoin.llm.common import discard, shared_folder, table

#: Near-duplicate texts: words of a shingle, similarity in hundredths.
WORDS, PERCENT = 5, 80
RANKS = "byte_bpe_multi_50k.tiktoken"


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts whose perplexity is above the fence of their language."""
    return quality.filter_quality(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of linked ones."""
    return parity_join.keep_one(docs, WORDS, PERCENT)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops contaminated documents."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks secrets in the texts; all documents stay."""
    return secrets.redact(docs)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (little-endian unsigned 32-bit integers), their number, and the text decoded from them.

    These four columns are the stage's own: input columns ``n_tokens``, ``ids`` and ``decoded`` (in any case) are replaced or go."""
    path = public_tokenizers.path(RANKS)
    keep = tuple(c for c in docs.columns if c.lower() not in ("text", "n_tokens", "ids", "decoded"))
    df = bpe.round_trip(docs, path, public_tokenizers.PATTERN, keep)
    return df.select(*keep, F.expr("octet_length(ids) div 4").cast("bigint").alias("n_tokens"), "ids", F.col("decoded").cast("string").alias("text"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("secret_scan", secret_scan),
    ("byte_bpe", byte_bpe),
]
#: Perplexity models, groups by links and merges are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage wrote is deleted once the next one has written its own."""
    docs, folder, before = table(spark, sf_dir, "documents"), shared_folder(spark), None
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}_{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            discard(spark, before)
        before = path
    return docs
