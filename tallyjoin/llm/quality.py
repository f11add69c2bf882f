"""Quality by the perplexity of an interpolated modified Kneser-Ney n-gram model of trusted text.

Symbols are bytes (digits alike), an n-gram is a number of 8 bits a symbol. Counts of all trusted texts are summed by n-gram
in shards; lower orders count left neighbours; discounts come from the counts of counts. Every n-gram that any text of the
corpus holds is then joined with the sharded counts and gets its probability. These probabilities go to the texts by
broadcast while they are few; beyond that bound the commonest still do, and only the rest go by a join on (text, n-gram). Both
give the same perplexities.

A text is rejected when its log-perplexity is above the fence of its language, plus what chance allows so short a text. A fence
is made of two: one from quantiles of the language's trusted texts which the model was not trained on, and one from the lower half
of all its own different texts, never below that of all languages and the wider the fewer they are. The first counts the more the
more texts it has, so no language is judged by another's fence, and a language of a few texts is kept whole. Null and empty texts
have no perplexity and are kept; without trusted texts everything is kept; an empty table gives no rows. Repeated rows are scored
each. A null language is a language of its own. Very long texts are read in blocks of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyjoin.llm.arrow import blocks, sums, texts, tidied
from tallyjoin.llm.common import bounded, cut, fold, small_batches

#: Length of n-grams; symbols; n-grams whose probabilities may be broadcast (12 bytes each); labels that may be.
ORDER, SYMBOLS, TABLE_ROWS, LABEL_ROWS = 5, 256, 4_000_000, 2_000_000
#: The fence is HIGH + REACH * (HIGH - MIDDLE), of quantiles of trusted log-perplexities.
MIDDLE, HIGH, REACH = 0.5, 0.99, 1.0
#: From all texts of a language, trusted or not, it is MIDDLE + LOW_REACH * (MIDDLE - LOW): junk is in the upper half.
LOW, LOW_REACH = 0.05, 2.0
#: One trusted text of so many, by crc32 of the id, is for the fences; at FEW of them both fences of a language count alike, and
#: of FEW texts the width of its own fence is double; a text of n bytes may be higher by CHANCE / sqrt(n).
FOLDS, FEW, CHANCE = 5, 50, 3.0

_SAME = np.arange(256, dtype=np.uint8)
_SAME[ord("0") : ord("9") + 1] = ord("0")
_SAME[[9, 10, 13]] = 32


def codes(column: pa.Array, order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """(n-grams of all texts, offsets): one for each byte, with zero bytes before a text's first."""
    data, offsets = texts(column)
    sizes, pad = np.diff(offsets), order - 1
    padded = np.zeros(len(data) + pad * len(sizes), np.int64)
    own = np.arange(len(data)) + pad * np.repeat(np.arange(1, len(sizes) + 1), sizes)
    padded[own] = _SAME[data]
    out = np.zeros(len(data), np.int64)
    for k in range(order):
        out |= padded[own - k] << (8 * k)
    return out, offsets


class Table:
    """Open addressing of int64 keys to floats, built and probed by whole arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(2 * len(keys)).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.float32)
        self.any = keys[0] if len(keys) else -1
        slot, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = self.keys[slot[left]] == -1
            self.keys[slot[left[free]]] = keys[left[free]]
            mine = self.keys[slot[left]] == keys[left]
            self.values[slot[left[mine]]] = values[left[mine]]
            left = left[~mine]
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def has(self, keys: np.ndarray) -> np.ndarray:
        """Whether each key is present."""
        slot, there = self._slot(keys), np.zeros(len(keys), bool)
        left = np.arange(len(keys))
        while len(left):
            here = self.keys[slot[left]]
            there[left] = here == keys[left]
            left = left[~there[left] & (here != -1)]
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)
        return there

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Values of keys that are all present."""
        slot = self._slot(keys)
        left = np.flatnonzero(self.keys[slot] != keys)
        while len(left):
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)
            left = left[self.keys[slot[left]] != keys[left]]
        return self.values[slot]


def count_codes(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """code, n over all texts: summed in each task, then by code."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            code, at = np.unique(np.concatenate([c for c, _ in held]), return_inverse=True)
            return code, np.bincount(at, np.concatenate([n for _, n in held])).astype(np.int64)

        for block in blocks(batches):
            held.append(np.unique(codes(block.column(0), order)[0], return_counts=True))
            if sum(len(c) for c, _ in held) > 2_000_000:
                held = [merged()]
        if held:
            code, n = merged()
            for k in range(0, len(code), 65536):
                yield pa.RecordBatch.from_arrays([pa.array(code[k : k + 65536]), pa.array(n[k : k + 65536])], names=["code", "n"])

    return docs.where(F.octet_length("text") > 0).select("text").mapInArrow(tidied(run), "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n"))


def _discounts(counts: DataFrame) -> tuple[float, float, float]:
    """D1, D2, D3+ of modified Kneser-Ney from the numbers of n-grams seen once to four times."""
    by = {r["n"]: r["k"] for r in counts.where("n <= 4").groupBy("n").agg(F.count(F.lit(1)).alias("k")).collect()}
    n = [by.get(k, 0) for k in range(1, 5)]
    if not all(n):
        return 0.5, 1.0, 1.5
    y = n[0] / (n[0] + 2 * n[1])
    return tuple(min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.01), k - 0.01) for k in (1, 2, 3))


def _off(n: Column, d: tuple[float, float, float]) -> Column:
    return F.when(n == 1, d[0]).when(n == 2, d[1]).otherwise(F.lit(d[2]))


def model_tables(counts: DataFrame, order: int = ORDER) -> list[tuple[DataFrame, DataFrame]]:
    """For each order from 1: (code, p of its last symbol after the others) and (context, back): weight of the lower order."""
    by_order = [counts]
    for k in range(order - 1, 0, -1):
        by_order.append(cut(by_order[-1].groupBy(F.col("code").bitwiseAND(F.lit((1 << 8 * k) - 1)).alias("code")).agg(F.count(F.lit(1)).alias("n"))))
    tables: list[tuple[DataFrame, DataFrame]] = []
    for k, grams in enumerate(reversed(by_order), 1):
        d = _discounts(grams)
        grams = grams.withColumn("context", F.shiftright("code", 8))
        back = cut(grams.groupBy("context").agg(F.sum("n").alias("total"), (F.sum(_off(F.col("n"), d)) / F.sum("n")).alias("back")))
        seen = grams.join(back, "context")
        if k == 1:
            lower = F.lit(1.0 / SYMBOLS)
        else:
            under = tables[-1][0].withColumnsRenamed({"code": "suffix", "p": "lower"})
            seen = seen.withColumn("suffix", F.col("code").bitwiseAND(F.lit((1 << 8 * (k - 1)) - 1))).join(under, "suffix")
            lower = F.col("lower")
        p = (F.col("n") - _off(F.col("n"), d)) / F.col("total") + F.col("back") * lower
        tables.append((cut(seen.select("code", p.alias("p"))), back.select("context", "back")))
    return tables


def costs(wanted: DataFrame, tables: list[tuple[DataFrame, DataFrame]]) -> DataFrame:
    """The columns of ``wanted`` (code and others) and cost = -ln p of each code, by joins with the sharded tables, lowest order first."""
    order, df, p, others = len(tables), wanted, F.lit(1.0 / SYMBOLS), wanted.columns
    for k, (seen, back) in enumerate(tables, 1):
        part = F.col("code").bitwiseAND(F.lit((1 << 8 * k) - 1)) if k < order else F.col("code")
        df = df.withColumns({"p": p, "part": part, "context": F.shiftright(part, 8)})
        df = df.join(seen.withColumnsRenamed({"code": "part", "p": "own"}), "part", "left").join(back, "context", "left")
        p = F.coalesce(F.col("own"), F.coalesce(F.col("back"), F.lit(1.0)) * F.col("p"))
        df = df.select(*others, p.alias("q"))
        p = F.col("q")
    return df.select(*others, (-F.log("q")).cast("float").alias("cost"))


def perplexities(docs: DataFrame, table: DataFrame, most: int = TABLE_ROWS, order: int = ORDER) -> DataFrame:
    """The columns of ``docs`` but text, and n_bytes and log_ppl (null without bytes).

    ``table``: code, cost and n (how often it stands in the corpus) of every code met."""
    spark = docs.sparkSession
    small_batches(spark)
    keep = [c for c in docs.columns if c != "text"]
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name != "text"]
    if table.limit(most + 1).count() > most:
        return _by_join(docs, table, most, keep, order)
    rows = table.select("code", "cost").toArrow()
    shared = spark.sparkContext.broadcast((rows["code"].to_numpy(), rows["cost"].to_numpy()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = None
        for block in blocks(batches):
            found = found or Table(*shared.value)
            code, offsets = codes(block.column(len(keep)), order)
            total, n = sums(found.find(code).astype(np.float64), offsets[:-1], offsets[1:]), np.diff(offsets)
            mean = pa.array(total / np.maximum(n, 1), mask=n == 0)
            yield pa.RecordBatch.from_arrays([*block.columns[:-1], pa.array(n), mean], names=[*keep, "n_bytes", "log_ppl"])

    return docs.select(*keep, "text").mapInArrow(tidied(run), ", ".join([*fields, "n_bytes bigint", "log_ppl double"]))


def _common(table: DataFrame, most: int) -> tuple[int, np.ndarray, np.ndarray]:
    """The least count from which on at most ``most`` codes are as common, a power of two, and these codes with their costs."""
    by_bits = {r["b"]: r["k"] for r in table.groupBy(F.length(F.bin("n")).alias("b")).agg(F.count(F.lit(1)).alias("k")).collect()}
    least, held = 64, 0
    while least > 1 and held + by_bits.get(least - 1, 0) <= most:
        least -= 1
        held += by_bits.get(least, 0)
    rows = table.where(F.length(F.bin("n")) >= least).select("code", "cost").toArrow()
    return 1 << (least - 1), rows["code"].to_numpy(), rows["cost"].to_numpy()


def _by_join(docs: DataFrame, table: DataFrame, most: int, keep: list[str], order: int) -> DataFrame:
    """The same where the table is too large: the commonest codes are broadcast and added up at once, for the others rows (text,
    n-gram, times) meet the rest of the table in a shuffled join. So no code of the join stands in a large share of all texts."""
    least, codes_, costs_ = _common(table, most)
    rest = table.where(F.col("n") < least).select("code", "cost")
    shared = docs.sparkSession.sparkContext.broadcast((codes_, costs_))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = None
        for block in blocks(batches, limit=1 << 17):
            found = found or Table(*shared.value)
            code, offsets = codes(block.column(1), order)
            of = np.repeat(np.arange(block.num_rows), np.diff(offsets))
            pairs = np.lexsort((code, of))
            code, of = code[pairs], of[pairs]
            first = np.flatnonzero(np.append(True, (np.diff(code) != 0) | (np.diff(of) != 0))) if len(code) else np.zeros(0, np.int64)
            times = np.diff(np.append(first, len(code)))
            code, of = code[first], of[first]
            there = found.has(code)
            cost = np.where(there, found.find(np.where(there, code, found.any)), 0.0) if there.any() else np.zeros(len(code))
            n = np.bincount(of[there], times[there], block.num_rows)
            total = np.bincount(of[there], times[there] * cost[there], block.num_rows)
            # One row for what is known, under a code of its own that meets nothing, and one for each code that is not.
            own = -2 - np.abs(block.column(2).to_numpy() >> 1)
            ids = block.column(0).take(pa.array(np.concatenate([np.arange(block.num_rows), of[~there]])))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(np.concatenate([own, code[~there]])), pa.array(np.concatenate([n, times[~there]]).astype(np.int64)), pa.array(np.concatenate([total, np.zeros((~there).sum())]))],
                names=["_row", "code", "times", "known"],
            )

    # The hash of a text stands for it: equal texts have equal perplexities.
    hashed = docs.withColumn("_row", F.sha1("text"))
    different = hashed.where(F.octet_length("text") > 0).select("_row", "text", F.xxhash64("text").alias("hash")).dropDuplicates(["_row"])
    grams = different.mapInArrow(tidied(run), "_row string, code bigint, times bigint, known double")
    cost = F.col("known") + F.when(F.col("cost").isNull(), 0.0).otherwise(F.col("times") * F.col("cost").cast("double"))
    each = grams.join(rest, "code", "left").groupBy("_row").agg(F.sum(cost).alias("_sum"), F.sum("times").alias("_n"))
    return hashed.join(each, "_row", "left").select(*keep, F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes"), (F.col("_sum") / F.col("_n")).alias("log_ppl"))


def judge(docs: DataFrame, labels: DataFrame, most: int = TABLE_ROWS) -> DataFrame:
    """The columns of ``docs`` but text, and n_bytes, log_ppl, fence (null if none) and keep."""
    trusted = bounded(labels.where("quality > 0").select(F.col("doc_id").alias("_id")).distinct(), LABEL_ROWS)
    held = fold(F.col("doc_id"), FOLDS) == FOLDS - 1
    counts = cut(count_codes(docs.where(~held).join(trusted, F.col("doc_id") == F.col("_id"), "left_semi")))
    wanted = cut(count_codes(docs))
    table = cut(costs(wanted, model_tables(counts)))
    extra = [c for c in docs.columns if c != "text"]
    scored = cut(perplexities(docs.select(*extra, "text"), table, most))
    known = scored.where(held).join(trusted, F.col("doc_id") == F.col("_id"), "left_semi").where("log_ppl IS NOT NULL")
    chance = CHANCE / F.sqrt(F.greatest("n_bytes", F.lit(1)))
    at = lambda *q: F.percentile_approx(F.col("log_ppl") - chance, [*q], F.lit(10_000)).alias("q")
    n = F.count(F.lit(1)).alias("_n")
    overall = known.agg(at(MIDDLE, HIGH)).collect()[0]["q"]
    if overall is None:
        return scored.select(*extra, "n_bytes", "log_ppl", F.lit(None).cast("double").alias("fence"), F.lit(True).alias("keep"))
    middle, high = overall
    trusted_fence = known.groupBy(F.col("lang").alias("_lang")).agg(at(MIDDLE, HIGH), n)
    trusted_fence = trusted_fence.select("_lang", (F.col("q")[1] + REACH * (F.col("q")[1] - F.col("q")[0])).alias("_trusted"), F.pow("_n", F.lit(2)).alias("_w"))
    # Copies count once, else a text that is most of a language would leave no width.
    texts_ = scored.where("log_ppl IS NOT NULL").select(F.col("lang").alias("_lang"), "n_bytes", "log_ppl").distinct().groupBy("_lang").agg(at(LOW, MIDDLE), n)
    width = F.greatest(LOW_REACH * (F.col("q")[1] - F.col("q")[0]), F.lit((1 + REACH) * (high - middle))) * (1 + FEW / F.col("_n"))
    own_fence = texts_.select(F.col("_lang").alias("_own_lang"), F.greatest(F.col("q")[1] + width, F.lit(high + REACH * (high - middle))).alias("_all"))
    both = own_fence.join(trusted_fence, F.col("_own_lang").eqNullSafe(F.col("_lang")), "left")
    share = F.coalesce(F.col("_w"), F.lit(0.0)) / (F.coalesce(F.col("_w"), F.lit(0.0)) + FEW**2)
    by_lang = cut(both.select(F.col("_own_lang").alias("_lang"), (share * F.coalesce("_trusted", "_all") + (1 - share) * F.col("_all")).alias("_own")))
    df = scored.join(bounded(by_lang, 100_000), F.col("lang").eqNullSafe(F.col("_lang")), "left")
    df = df.withColumn("fence", F.col("_own") + chance)
    return df.select(*extra, "n_bytes", "log_ppl", "fence", F.coalesce(F.col("log_ppl") <= F.col("fence"), F.lit(True)).alias("keep"))


def filter_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with the same columns. A row is known by its id and text."""
    marked = docs.select("doc_id", "lang", F.xxhash64("text").alias("_hash"), "text")
    bad = judge(marked, labels).where(~F.col("keep")).select(F.col("doc_id").alias("_id"), F.col("_hash").alias("_text")).distinct()
    bad = bounded(cut(bad), LABEL_ROWS)
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["_id"]) & (F.xxhash64(docs["text"]) == bad["_text"]), "left_anti")


def quality_query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    df = judge(docs.select("doc_id", "lang", "text"), labels)
    return df.select("doc_id", "n_bytes", F.exp("log_ppl").alias("perplexity"), F.exp("fence").alias("threshold"), "keep")
