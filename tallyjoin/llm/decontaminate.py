"""Benchmark decontamination by a distributed positional inverted index, in DataFrame operations only.

1. Count, over the whole corpus, the texts of every term that a benchmark item uses.
2. In each window of an item take its two rarest terms; only these terms' postings (text, position) are stored.
3. Shift each posting by the term's place in the item: both terms of a window must meet on one shifted place (phrase), or
   within a slop of each other (proximity: a word inserted, dropped or put for another between or beside them).
4. Read the texts again and verify whole windows at the places of phrases.

Postings are written once, for phrases and proximity. Where there are too many anchors to broadcast, texts and anchors meet by
term in a join that is split where a term is very common.

Rows are told apart by id and hash of the text, so repeated ids are safe. Null ids are a value like others. Null and empty
texts have no words and no hits; items without words have no window; a null item id counts as the empty id. Of terms as rare as
each other the first in the item is the anchor. Empty tables give no rows or no hits.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyjoin.llm.common import bounded, cut, words_of

#: Words of a window; anchors of a window; rows of the benchmark's tables and of candidates that may be broadcast.
WINDOW, ANCHORS = 13, 2
#: Words by which the terms of a proximity match may be off their places.
SLOP = 2
TERM_ROWS, CANDIDATE_ROWS = 200_000, 40_000


@dataclass
class Index:
    """items: key, id, words, windows (start, length, anchors). anchors: term, key, at. postings: doc_id, hash, key, at, shifted."""

    items: DataFrame
    anchors: DataFrame
    postings: DataFrame


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.xxhash64("text").alias("hash"), words_of(F.col("text")).alias("words"))


def benchmark_items(bench: DataFrame) -> DataFrame:
    """key, id and words of each different item that has words."""
    items = bench.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("id"), words_of(F.col("text")).alias("words"))
    return items.where(F.size("words") > 0).distinct().withColumn("key", F.sha1(F.concat_ws(" ", "id", F.array_join("words", " "))))


def term_counts(docs: DataFrame, items: DataFrame) -> DataFrame:
    """term, n: texts of the corpus that hold each term of the items; terms of no text are left out.

    Terms are 64-bit hashes in the index: should two share one, a list is longer, and the verification drops what is wrong.
    """
    terms = bounded(items.select(F.explode("words").alias("term")).select(F.xxhash64("term").alias("term")).distinct(), TERM_ROWS)
    found = _rows(docs).select(F.explode(F.array_distinct("words")).alias("term")).select(F.xxhash64("term").alias("term"))
    return found.join(terms, "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("n"))


def build_index(docs: DataFrame, bench: DataFrame, window: int = WINDOW) -> Index:
    items = cut(benchmark_items(bench))
    counts = cut(term_counts(docs, items))
    at = items.select("key", F.posexplode("words").alias("at", "term")).withColumn("term", F.xxhash64("term")).join(counts, "term", "left")
    ranks = at.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("at", F.coalesce("n", F.lit(0)).alias("n")))).alias("ranks"))
    length = F.least(F.size("words"), F.lit(window))

    def one(start: Column) -> Column:
        terms = F.transform(F.slice("ranks", start + 1, length), lambda x: F.struct(x["n"].alias("n"), x["at"].alias("at")))
        rarest = F.slice(F.array_sort(terms), 1, ANCHORS)
        return F.struct(start.alias("start"), length.alias("length"), F.array_min(terms)["n"].alias("n"), F.transform(rarest, lambda x: x["at"]).alias("anchors"))

    windows = F.filter(F.transform(F.sequence(F.lit(0), F.size("words") - length), one), lambda w: w["n"] > 0)
    items = cut(items.join(ranks, "key").withColumn("windows", windows).where(F.size("windows") > 0).select("key", "id", "words", "windows"))
    used = F.array_distinct(F.flatten(F.transform("windows", lambda w: w["anchors"])))
    anchors = items.select("key", "words", F.explode(used).alias("at")).select("key", "at", F.xxhash64(F.get("words", F.col("at"))).alias("term"))
    found = _rows(docs).select("doc_id", "hash", F.posexplode("words").alias("pos", "term")).withColumn("term", F.xxhash64("term"))
    postings = found.join(bounded(anchors, TERM_ROWS), "term").select("doc_id", "hash", "key", "at", (F.col("pos") - F.col("at")).alias("shifted"))
    return Index(items, anchors, cut(postings))


def phrase_candidates(index: Index) -> DataFrame:
    """doc_id, hash, key, shifted, windows: windows whose rarest terms stand at their places in the text."""
    lists = index.postings.groupBy("doc_id", "hash", "key", "shifted").agg(F.collect_set("at").alias("present"))
    met = lists.join(bounded(index.items, TERM_ROWS // 10), "key")
    held = F.filter("windows", lambda w: F.size(F.array_intersect(w["anchors"], F.col("present"))) == F.size(w["anchors"]))
    met = met.withColumn("windows", F.transform(held, lambda w: F.struct((F.col("shifted") + w["start"]).alias("start"), w["start"].alias("from"), w["length"].alias("length"))))
    met = met.withColumn("windows", F.filter("windows", lambda w: w["start"] >= 0))
    return met.where(F.size("windows") > 0).select("doc_id", "hash", "id", "words", "windows")


def proximity_matches(index: Index, slop: int) -> DataFrame:
    """doc_id, hash, id: the rarest terms of some window stand within ``slop`` words of their relative places.

    Places are dealt into strips of slop + 1, each posting into its own and the next, so a strip holds every pair.
    """
    strip = F.floor(F.col("shifted") / F.lit(slop + 1))
    dealt = index.postings.withColumn("strip", F.explode(F.array(strip, strip + 1)))
    lists = dealt.groupBy("doc_id", "hash", "key", "strip").agg(F.collect_set(F.struct("at", "shifted")).alias("seen"))
    met = lists.join(bounded(index.items, TERM_ROWS // 10), "key")

    def near(w: Column) -> Column:
        of = lambda k: F.filter("seen", lambda s: s["at"] == F.get(w["anchors"], F.lit(k)))
        pair = F.exists(of(0), lambda a: F.exists(of(1), lambda b: F.abs(a["shifted"] - b["shifted"]) <= slop))
        return F.when(F.size(w["anchors"]) < 2, F.size(of(0)) > 0).otherwise(pair)

    return met.where(F.exists("windows", near)).select("doc_id", "hash", "id").distinct()


def contamination(docs: DataFrame, bench: DataFrame, window: int = WINDOW, slop: int | None = None) -> DataFrame:
    """A row for each row of ``docs``: the row itself, doc_id, n_words, n_hit, items (sorted ids) and hits, by exact windows; with
    a ``slop`` also near: sorted ids of the items with a proximity match, exact ones among them."""
    index = build_index(docs, bench, window)
    found = phrase_candidates(index).select("doc_id", "hash", F.struct("id", "words", "windows").alias("place"), F.lit(None).cast("string").alias("near"))
    if slop is not None:
        found = found.unionByName(proximity_matches(index, slop).select("doc_id", "hash", F.lit(None).alias("place"), F.col("id").alias("near")))
    per_text = cut(found.groupBy("doc_id", "hash").agg(F.collect_list("place").alias("places"), F.array_sort(F.collect_set("near")).alias("near")))
    per_text = per_text.withColumnsRenamed({"doc_id": "_id", "hash": "_hash"})
    rows = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", F.xxhash64("text").alias("hash"), words_of(F.col("text")).alias("words"))
    df = rows.join(bounded(per_text, CANDIDATE_ROWS), rows["doc_id"].eqNullSafe(F.col("_id")) & (rows["hash"] == F.col("_hash")), "left")

    def verified(place: Column) -> Column:
        same = lambda w: F.slice("words", w["start"] + 1, w["length"]) == F.slice(place["words"], w["from"] + 1, w["length"])
        return F.transform(F.filter(place["windows"], same), lambda w: F.struct(w["start"].alias("start"), (w["start"] + w["length"]).alias("end"), place["id"].alias("id")))

    hits = F.when(F.col("places").isNull(), F.array().cast("array<struct<start:int,end:int,id:string>>")).otherwise(F.array_sort(F.flatten(F.transform("places", verified))))
    df = df.select("row", "doc_id", F.size("words").cast("bigint").alias("n_words"), hits.alias("hits"), F.coalesce("near", F.array().cast("array<string>")).alias("near"))
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    add = lambda acc, h: F.struct((acc["n"] + F.greatest(F.lit(0), h["end"] - F.greatest(h["start"], acc["end"]))).alias("n"), F.greatest(acc["end"], h["end"]).alias("end"))
    ids = F.array_sort(F.array_distinct(F.transform("hits", lambda h: h["id"])))
    return df.select("row", "doc_id", "n_words", F.aggregate("hits", start, add, lambda acc: acc["n"]).cast("bigint").alias("n_hit"), ids.alias("items"), "hits", "near")


def is_contaminated(n_words: Column, n_hit: Column) -> Column:
    """At least a twentieth of the words is hit."""
    return (n_hit > 0) & (n_hit * 20 >= n_words)


def decontaminate(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with the same columns."""
    return contamination(docs, bench).where(~is_contaminated(F.col("n_words"), F.col("n_hit"))).select("row.*")


def contamination_digest(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """The figures of the contract from contamination(), and n_near: items with a proximity match."""
    df = contamination(docs.select("doc_id", "text"), bench, slop=SLOP)
    return df.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        is_contaminated(F.col("n_words"), F.col("n_hit")).alias("contaminated"),
        F.size("near").cast("bigint").alias("n_near"),
    )
