"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts n-grams per language in every training text (map-side sums, then one row per language and bucket). The matrix
of log-probabilities has a size fixed by the number of languages and buckets, and is broadcast; texts are scored in
numpy by adding up the rows of their n-grams.

A null text, or one without letters, is 'und' with score 0; so is every text when nothing was learned. Rows with a null
language teach nothing. Ties go to the language that sorts first; repeated rows are predicted each, an empty table gives no rows.
Very long texts are scored in strips. The matrix has MATRIX bytes at most: where many languages would exceed that, n-grams share
fewer buckets; over LANGUAGES different values of lang are refused, as they can't be languages.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyjoin.llm.arrow import blocks, sums, texts, tidied
from tallyjoin.llm.common import fold, small_batches

#: Orders of n-grams, bits of a bucket's number for each, and the smoothing count.
ORDERS, BITS, SMOOTH = (1, 2, 3), 16, 0.5
#: Bounds: bytes of the matrix, languages, and n-grams that are scored at once.
MATRIX, LANGUAGES, STRIP = 1 << 26, 4096, 1 << 19
SPACE = 32
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For each code point its lower-case form, or a space if it is no letter."""
    out = np.full(0x110000, SPACE, np.uint32)
    for c in range(0x110000):
        char = chr(c)
        if char.isalpha():
            low = char.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def characters(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(letters and spaces as code points, offsets)."""
    data, offsets = texts(column)
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    before = np.append(0, np.cumsum((data & 0xC0) != 0x80))
    return _letters()[points], before[offsets]


def bits_for(languages: int) -> int:
    """Bits of a bucket's number: as many as the matrix's bound allows."""
    return max(4, min(BITS, (MATRIX // (8 * len(ORDERS) * max(1, languages))).bit_length() - 1))


def buckets(points: np.ndarray, order: int, bits: int = BITS) -> np.ndarray:
    """The bucket of the n-gram that starts at each place."""
    n = len(points) - order + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    wide, mixed = points.astype(np.uint64), np.zeros(n, np.uint64)
    for k in range(order):
        mixed = (mixed ^ wide[k : k + n]) * _FACTORS[k]
        mixed ^= mixed >> np.uint64(29)
    return ((mixed * _FACTORS[0]) >> np.uint64(64 - bits)).astype(np.int64) + (ORDERS.index(order) << bits)


def count_ngrams(docs: DataFrame, languages: list[str]) -> DataFrame:
    """language (its index), bucket, n over all rows of ``docs`` (text, lang)."""
    index, bits = {x: k for k, x in enumerate(languages)}, bits_for(len(languages))
    size = len(ORDERS) << bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(index), size), np.int64)
        for block in blocks(batches):
            points, offsets = characters(block.column(0))
            starts, ends = offsets[:-1], offsets[1:]
            lang = np.array([index[x] for x in block.column(1).to_pylist()], np.int64)
            own = np.repeat(lang, ends - starts)
            last = np.repeat(ends, ends - starts)
            for order in ORDERS:
                b = buckets(points, order, bits)
                inside = np.arange(len(b)) + order <= last[: len(b)]
                b, of = b[inside], own[: len(b)][inside]
                for k in np.unique(lang):
                    total[k] += np.bincount(b[of == k], minlength=size)
        k, b = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(total[k, b])], names=["language", "bucket", "n"])

    small_batches(docs.sparkSession)
    counts = docs.select("text", "lang").mapInArrow(tidied(run), "language int, bucket int, n bigint")
    return counts.groupBy("language", "bucket").agg(F.sum("n").alias("n"))


def train(docs: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(languages, log-probabilities [buckets of all orders, languages], log-priors) from text and lang of all rows of ``docs``."""
    docs = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    priors = {r["lang"]: r["n"] for r in docs.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(LANGUAGES + 1).collect()}
    if len(priors) > LANGUAGES:
        raise ValueError(f"lang has over {LANGUAGES} different values")
    languages = sorted(priors)
    if not languages:
        return [], np.zeros((len(ORDERS) << BITS, 0)), np.zeros(0)
    rows = count_ngrams(docs, languages).toArrow()
    bits = bits_for(len(languages))
    counts = np.full((len(ORDERS) << bits, len(languages)), SMOOTH)
    counts[rows["bucket"].to_numpy(), rows["language"].to_numpy()] += rows["n"].to_numpy()
    per_order = counts.reshape(len(ORDERS), 1 << bits, -1)
    logs = np.log(per_order / per_order.sum(axis=1, keepdims=True)).reshape(counts.shape)
    prior = np.array([priors[x] for x in languages], float)
    return languages, logs, np.log(prior / prior.sum())


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray]) -> DataFrame:
    """doc_id, lang_pred, score: the posterior of the predicted language."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages, logs, prior = shared.value
        for block in blocks(batches):
            points, offsets = characters(block.column(1))
            starts, ends = offsets[:-1], offsets[1:]
            lettered = sums((points != SPACE).astype(np.int64), starts, ends) > 0
            best, score = np.zeros(block.num_rows, np.int64), np.zeros(block.num_rows)
            if languages:
                likelihood = np.tile(prior, (block.num_rows, 1))
                bits, strip = bits_for(len(languages)), max(1 << 12, STRIP * 4 // len(languages))
                for order in ORDERS:
                    bucket, last = buckets(points, order, bits), np.maximum(starts, ends - order + 1)
                    for at in range(0, len(bucket), strip):
                        inside = lambda x: np.clip(x, at, at + strip) - at  # noqa: B023, E731
                        likelihood += sums(logs[bucket[at : at + strip]], inside(starts), inside(last))
                best = likelihood.argmax(axis=1)
                score = 1 / np.exp(likelihood - likelihood.max(axis=1, keepdims=True)).sum(axis=1)
            known = lettered & bool(languages)
            names = np.array([*languages, "und"], object)[np.where(known, best, len(languages))]
            yield pa.RecordBatch.from_arrays([block.column(0), pa.array(names, pa.string()), pa.array(np.where(known, score, 0.0))], names=["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(tidied(run), f"doc_id {id_type}, lang_pred string, score double")


def language_query(docs: DataFrame, parts: int = 4, held: int = 2) -> DataFrame:
    """Learns from the rows outside the held-out fold and predicts every row."""
    model = train(docs.where(fold(F.col("doc_id"), parts) != held))
    return predict(docs, model).select("doc_id", (fold(F.col("doc_id"), parts) == held).alias("held_out"), "lang_pred", "score")
