"""Toxicity by maximal scoring segments.

Each word's score is its log-odds of standing in toxic rather than other labelled texts, under Dirichlet priors; words without
significant odds cost a little. A linear-time scan finds all maximal scoring segments of a text. Their scores are calibrated
by the extreme-value law of the best segment of harmless texts, P(best > s) = 1 - exp(-K n exp(-lambda s)) for n words, which
makes long texts no more suspect than short ones. A text's evidence is the sum of -ln E over its significant segments; a
logistic curve turns it into a score.

Every significant word counts, however many there are: their odds are broadcast up to ODDS_ROWS, and met by a join on the word
beyond that; both give the same passages.

Null and empty texts have no segment and get the score of no evidence; an empty table gives no rows. Without labels of both
classes every score is 0. Repeated rows are scored each; a label that stands twice for an id counts once for each pair. Very long
texts are read once, word by word; segments of equal score are told apart by their place.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyjoin.llm.arrow import blocks, tidied
from tallyjoin.llm.common import LOWER, UPPER, bounded, cut, fold, small_batches, words_of

#: Weight of the prior in texts, the least odds and significance of a word that counts, cost of any other word.
PRIOR, LEAST_ODDS, LEAST_Z, COST = 5.0, 1.5, 3.0, 0.05
#: Bounds: words whose odds may be broadcast (about 150 bytes each); labelled rows that fit the calibration; labels that may be broadcast.
ODDS_ROWS, CALIBRATION_ROWS, LABEL_ROWS = 500_000, 20_000, 2_000_000
#: A segment counts when so many as good are expected in a harmless text.
SIGNIFICANT = 1.0

_TABLE = bytearray(b" " * 128 + bytes(range(128, 256)))
for _a, _b in zip(UPPER + LOWER + "0123456789", LOWER + LOWER + "0123456789"):
    _TABLE[ord(_a)] = ord(_b)
_TABLE = bytes(_TABLE)


@dataclass(frozen=True)
class Model:
    """odds: word -> log-odds, or a table (word, odds) where there are too many."""

    odds: dict[bytes, float] | DataFrame
    rate: float = 1.0
    scale: float = 1.0
    slope: float = 0.0
    shift: float = -np.inf

    def score(self, evidence: np.ndarray) -> np.ndarray:
        if self.shift == -np.inf:
            return np.zeros(len(evidence))
        return 1 / (1 + np.exp(-np.clip(self.slope * np.sqrt(evidence) + self.shift, -500, 500)))

    def expected(self, score: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Segments so good that a harmless text of n words has on average."""
        return self.scale * np.maximum(n, 1) * np.exp(-self.rate * score)


def segments(hits: list[tuple[int, float]], cost: float = COST) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score) of a text with these scored words; every other word costs ``cost``.

    The scan keeps candidates with the running total at their left and right end, and merges a new one with the nearest
    candidate that starts lower, if that one ends lower too; each candidate is pushed and merged once.
    """
    stack: list[tuple[int, int, float, float]] = []
    total, seen = 0.0, 0
    for at, odds in hits:
        total -= cost * (at - seen)
        begin, left, right = at, total, total + odds
        total, seen = right, at + 1
        while stack:
            # Candidates that start no lower can never be merged to the left of this one.
            k = len(stack) - 1
            while k >= 0 and stack[k][2] >= left:
                k -= 1
            if k < 0 or stack[k][3] >= right:
                break
            begin, left = stack[k][0], stack[k][2]
            del stack[k:]
        stack.append((begin, at + 1, left, right))
    return [(b, e, right - left) for b, e, left, right in stack]


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text, toxic. Labels are broadcast only while they are few; the join shuffles otherwise."""
    known = labels.where(F.col("toxic").isNotNull()).select(F.col("doc_id").alias("_id"), (F.col("toxic") > 0).cast("int").alias("toxic"))
    return docs.select("doc_id", "text").join(bounded(known, LABEL_ROWS), F.col("doc_id") == F.col("_id")).drop("_id")


def word_odds(train: DataFrame) -> DataFrame:
    """word and log-odds of the words that are significantly more common in toxic texts; counts are of texts, over all of ``train``."""
    words = train.select(F.explode(F.array_distinct(words_of(F.col("text")))).alias("word"), "toxic")
    counts = words.groupBy("word").agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b"))
    totals = train.select("toxic", F.size(F.array_distinct(words_of(F.col("text")))).alias("n")).groupBy("toxic").agg(F.sum("n").alias("n"))
    by = {r["toxic"]: float(r["n"] or 0) for r in totals.collect()}
    toxic, other = by.get(1, 0.0), by.get(0, 0.0)
    if not toxic or not other:
        return counts.select("word", F.lit(0.0).alias("odds")).where("false")
    share = toxic / (toxic + other)
    a, b = F.col("a") + PRIOR * share, F.col("b") + PRIOR * (1 - share)
    odds = F.log(a / toxic) - F.log(b / other)
    z = odds / F.sqrt(1 / a + 1 / b)
    return counts.where("a > 1").select("word", odds.alias("odds"), z.alias("z")).where((F.col("odds") > LEAST_ODDS) & (F.col("z") > LEAST_Z)).select("word", "odds")


def held_odds(table: DataFrame, most: int) -> dict[bytes, float] | DataFrame:
    """The odds as a dictionary if there are at most ``most``, else the table itself."""
    if table.limit(most + 1).count() > most:
        return table
    return {r["word"].encode(): r["odds"] for r in table.collect()}


PASSAGE = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("expected", pa.float64())]))


def _found(model: Model, hits: list[tuple[int, float]], n: int) -> tuple[list[dict], float]:
    """The passages of a text of ``n`` words with these scored words, and its evidence."""
    best = segments(hits) if hits else []
    expected = [float(model.expected(np.float64(s), n)) for _, _, s in best]
    found = [{"start": b, "end": e, "score": s, "expected": x} for (b, e, s), x in zip(best, expected)]
    return found, sum(-np.log(max(x, 1e-300)) for x in expected if x < SIGNIFICANT)


def passages(docs: DataFrame, model: Model) -> DataFrame:
    """The columns of ``docs`` but text, and n_words, passages (start and end word, score, expected number), evidence."""
    spark = docs.sparkSession
    small_batches(spark)
    keep = [c for c in docs.columns if c != "text"]
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name != "text"]
    made = ["n_words bigint", "passages array<struct<start:int,end:int,score:double,expected:double>>", "evidence double"]
    if isinstance(model.odds, DataFrame):
        return _by_join(docs, model, keep, made)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        odds = model.odds
        for block in blocks(batches):
            sizes, found, evidence = [], [], []
            for text in block.column(len(keep)).cast(pa.binary()).to_pylist():
                words = (text or b"").translate(_TABLE).split()
                mine = _found(model, [(k, odds[w]) for k, w in enumerate(words) if w in odds], len(words))
                sizes.append(len(words))
                found.append(mine[0])
                evidence.append(mine[1])
            yield pa.RecordBatch.from_arrays([*block.columns[:-1], pa.array(sizes, pa.int64()), pa.array(found, PASSAGE), pa.array(evidence, pa.float64())], names=[*keep, "n_words", "passages", "evidence"])

    return docs.select(*keep, "text").mapInArrow(tidied(run), ", ".join([*fields, *made]))


def _by_join(docs: DataFrame, model: Model, keep: list[str], made: list[str]) -> DataFrame:
    """The same by a join of words with the table of odds; only scored words come back to their text, known by its hash."""
    plain = replace(model, odds={})
    hashed = docs.withColumn("_row", F.sha1(F.coalesce("text", F.lit(""))))
    words = hashed.dropDuplicates(["_row"]).select("_row", words_of(F.col("text")).alias("words"))
    met = words.select("_row", F.posexplode("words").alias("at", "word")).join(model.odds, "word")
    hits = met.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("at", "odds"))).alias("hits"))
    texts = words.select("_row", F.size("words").cast("bigint").alias("n")).join(hits, "_row", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column(1).to_pylist()
            mine = [_found(plain, [(h["at"], h["odds"]) for h in hits or []], size) for size, hits in zip(n, batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([f for f, _ in mine], PASSAGE), pa.array([e for _, e in mine], pa.float64())], names=["_row", "n_words", "passages", "evidence"])

    scored = texts.mapInArrow(tidied(run), ", ".join(["_row string", *made]))
    return hashed.select("_row", *keep).join(scored, "_row").select(*keep, "n_words", "passages", "evidence")


def _extreme_law(best: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """(lambda, K) of highest likelihood; for each lambda the best K is known in closed form."""
    n = np.maximum(n, 1).astype(float)

    def fit(rate: float) -> tuple[float, float]:
        tail = n * np.exp(-rate * best)
        scale = len(best) / tail.sum()
        return len(best) * np.log(rate * scale) + np.log(tail).sum() - len(best), scale

    rates = np.geomspace(0.02, 5, 120)
    rate = max(rates, key=lambda r: fit(r)[0])
    return float(rate), float(fit(rate)[1])


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
    """(slope, shift) by Newton steps with a small ridge; the slope is not negative."""
    a, w = np.stack([x, np.ones(len(x))], axis=1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(2), a.T @ (y - p) - ridge * w)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return max(0.0, float(w[0])), float(w[1])


def train(docs: DataFrame, labels: DataFrame, most: int = ODDS_ROWS) -> Model:
    """Word odds from all labelled rows; calibration from those of CALIBRATION_ROWS ids at most, in an order by hash."""
    rows = labelled(docs, labels)
    odds = held_odds(cut(word_odds(rows)), most)
    if not odds:
        return Model({})
    sample = rows.select(F.col("doc_id").alias("_id")).distinct().orderBy(F.xxhash64("_id"), "_id").limit(CALIBRATION_ROWS)
    # One text of an id and label, however often the id stands there.
    of_ids = rows.join(F.broadcast(sample), F.col("doc_id") == F.col("_id")).groupBy("doc_id", "toxic")
    some = of_ids.agg(F.min(F.struct(F.xxhash64("text"), "text")).alias("least")).select("toxic", F.col("least.text").alias("text"))
    plain = passages(some, Model(odds)).select("toxic", "n_words", F.transform("passages", lambda p: p["score"]).alias("scores")).toArrow()
    toxic, n = plain["toxic"].to_numpy(), plain["n_words"].to_numpy()
    scores = [np.array(s, float) for s in plain["scores"].to_pylist()]
    if not len(n) or toxic.min() == toxic.max():
        return Model({})
    best = np.array([s.max() if len(s) else 0.0 for s in scores])
    rate, scale = _extreme_law(best[toxic == 0], n[toxic == 0])
    model = Model(odds, rate, scale)
    expected = [model.expected(s, k) for s, k in zip(scores, n)]
    evidence = np.array([-np.log(np.maximum(e[e < SIGNIFICANT], 1e-300)).sum() for e in expected])
    slope, shift = _logistic(np.sqrt(evidence), toxic.astype(float))
    return replace(model, slope=slope, shift=shift)


def score_toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, predicted, passages."""
    df = passages(docs.select("doc_id", "text"), model)
    if model.shift == -np.inf:
        score = F.lit(0.0)
    else:
        score = 1 / (1 + F.exp(-(F.lit(model.slope) * F.sqrt("evidence") + F.lit(model.shift))))
    return df.select("doc_id", score.alias("score"), (score >= 0.5).cast("int").alias("predicted"), "passages")


def toxicity_query(docs: DataFrame, labels: DataFrame, parts: int = 5, held: int = 0, most: int = ODDS_ROWS) -> DataFrame:
    """Learns from the labels outside the held-out fold and scores every row."""
    model = train(docs, labels.where(fold(F.col("doc_id"), parts) != held), most)
    return score_toxicity(docs, model).select("doc_id", (fold(F.col("doc_id"), parts) == held).alias("held_out"), "score", "predicted")
