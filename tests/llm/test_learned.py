import base64
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tallyjoin.llm import bpe, common, language, multi_index, parity_join, quality, registry, toxicity

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, texts):
    return spark.createDataFrame([(k, t, "en", None, None) for k, t in texts], DOCS)


def test_segments_are_all_maximal():
    def brute(values):
        """Ruzzo and Tompa's definition, by recursion on the best segment."""
        if not values:
            return []
        best = max(((sum(values[i:j]), -(j - i), -i, i, j) for i in range(len(values)) for j in range(i + 1, len(values) + 1)))
        if best[0] <= 1e-12:
            return []
        i, j = best[3], best[4]
        left, right = brute(values[:i]), brute(values[j:])
        return left + [(i, j, best[0])] + [(a + j, b + j, s) for a, b, s in right]

    rng = random.Random(3)
    for _ in range(200):
        values = [rng.choice([-1.0, -1.0, 0.7, 1.9, 2.3]) for _ in range(rng.randint(0, 14))]
        got = toxicity.segments([(k, v) for k, v in enumerate(values) if v > 0], 1.0)
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in brute(values)]
        assert [s for *_, s in got] == pytest.approx([s for *_, s in brute(values)])


def test_toxicity(spark):
    rng = random.Random(1)
    plain = [f"w{k}" for k in range(50)]
    rows, labels = [], []
    for k in range(600):
        words = [rng.choice(plain) for _ in range(rng.randint(5, 60))]
        bad = k % 5 == 0
        if bad:
            words[2:2] = ["vile", "Nasty"]
        rows.append((k, " ".join(words)))
        labels.append((k, 1, int(bad)))
    rows += [(9000, None), (9001, ""), (9001, ""), (None, "vile nasty")]
    labels = spark.createDataFrame(labels + [(None, 1, 1), (9001, None, None)], "doc_id long, quality int, toxic int")
    out = toxicity.toxicity_query(frame(spark, rows), labels).collect()
    assert len(out) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in out)
    assert all(r["held_out"] == (zlib.crc32(str("" if r["doc_id"] is None else r["doc_id"]).encode()) % 5 == 0) for r in out)
    known = [r for r in out if r["doc_id"] is not None and r["doc_id"] < 600 and r["held_out"]]
    assert sum(r["predicted"] == (r["doc_id"] % 5 == 0) for r in known) >= 0.97 * len(known)
    joined = toxicity.toxicity_query(frame(spark, rows), labels, most=1).collect()
    plain = lambda rows: sorted(((r["doc_id"], r["held_out"], round(r["score"], 9), r["predicted"]) for r in rows), key=str)
    assert plain(joined) == plain(out)
    none = toxicity.toxicity_query(frame(spark, rows), labels.where("false")).collect()
    assert {r["score"] for r in none} == {0.0}
    assert toxicity.toxicity_query(frame(spark, []), labels).collect() == []


def test_toxicity_brute_force(spark):
    """Odds counted, segments found and evidence summed by plain loops; long texts, repeated rows and ties."""
    rng = random.Random(6)
    rows = [(k, " ".join(rng.choice("abcdefgh") for _ in range(12)) + (" vile Nasty vile" if k % 3 == 0 else "")) for k in range(200)]
    labels = spark.createDataFrame([(k, 1, int(k % 3 == 0)) for k in range(200)], "doc_id long, quality int, toxic int")
    docs = frame(spark, rows + [(900, "a b " * 30_000 + "vile nasty"), (901, "vile"), (901, "vile"), (902, "vile a vile")])
    model = toxicity.train(docs, labels)
    sets = [({w for w in re.findall("[a-z]+", t.lower())}, k % 3 == 0) for k, t in rows]
    total = [sum(len(s) for s, bad in sets if bad == x) for x in (False, True)]
    share = total[1] / sum(total)
    for word in {w for s, _ in sets for w in s}:
        a = sum(word in s for s, bad in sets if bad) + toxicity.PRIOR * share
        b = sum(word in s for s, bad in sets if not bad) + toxicity.PRIOR * (1 - share)
        odds = math.log(a / total[1]) - math.log(b / total[0])
        kept = odds > toxicity.LEAST_ODDS and odds / math.sqrt(1 / a + 1 / b) > toxicity.LEAST_Z
        assert (model.odds.get(word.encode()) == pytest.approx(odds)) if kept else word.encode() not in model.odds
    got = toxicity.passages(docs.select("doc_id", "text"), model).collect()
    texts = dict(rows) | {900: "a b " * 30_000 + "vile nasty", 901: "vile", 902: "vile a vile"}
    assert len(got) == 204 and set(model.odds) == {b"vile", b"nasty"}
    for r in got:
        words = re.findall("[a-z]+", texts[r["doc_id"]].lower())
        hits = [(k, model.odds[w.encode()]) for k, w in enumerate(words) if w.encode() in model.odds]
        expected = [model.scale * len(words) * math.exp(-model.rate * s) for *_, s in toxicity.segments(hits)]
        assert r["n_words"] == len(words) and r["evidence"] == pytest.approx(sum(-math.log(x) for x in expected if x < toxicity.SIGNIFICANT))


def test_language_brute_force(spark, monkeypatch):
    """The posterior by plain loops over n-grams; strips, ties, repeated rows, no rows; fewer buckets for many languages."""
    monkeypatch.setattr(language, "STRIP", 1 << 12)
    rng = random.Random(12)
    alphabets = {"aa": "abcde ", "bb": "cdefg ", "cc": "éñabü "}
    rows = [(k, "".join(rng.choice(alphabets[x]) for _ in range(rng.randint(1, 60))), x) for k in range(90) for x in [rng.choice(list(alphabets))]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(docs)
    count = {x: {} for x in alphabets}
    gram = lambda t, o: [t[i : i + o] for i in range(len(t) - o + 1)]
    for _, t, x in rows:
        for o in language.ORDERS:
            for g in gram(t, o):
                count[x][g] = count[x].get(g, 0) + 1
    totals = {(x, o): sum(n for g, n in count[x].items() if len(g) == o) + language.SMOOTH * (1 << language.BITS) for x in alphabets for o in language.ORDERS}
    ask = rows[:40] + [(1000, "".join(rng.choice("abcdeñ ") for _ in range(20_000)), None), (1001, "z", None), (1001, "z", None)]
    got = language.predict(spark.createDataFrame(ask, "doc_id long, text string, lang string"), model).collect()
    assert len(got) == len(ask)
    by = {r["doc_id"]: r for r in got}
    for k, t, _ in ask:
        logs = {x: math.log(sum(r[2] == x for r in rows) / len(rows)) + sum(math.log((count[x].get(g, 0) + language.SMOOTH) / totals[x, o]) for o in language.ORDERS for g in gram(t, o)) for x in alphabets}
        best = max(sorted(logs), key=logs.get)
        if any(c.isalpha() for c in t):
            assert by[k]["lang_pred"] == best and by[k]["score"] == pytest.approx(1 / sum(math.exp(v - logs[best]) for v in logs.values()), abs=1e-6)
    assert language.predict(docs.where("false"), model).collect() == []
    assert language.bits_for(4) == language.BITS and all(3 * 8 * n << language.bits_for(n) <= max(language.MATRIX, 24 * 16 * n) for n in (1, 50, 500, 4096))


def test_language(spark):
    docs = common.table(spark, "/root/testdata/sf0.01", "documents")
    out = language.language_query(docs).join(docs.select("doc_id", "lang"), "doc_id")
    share = out.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).collect()[0][0]
    assert share > 0.97
    odd = [(0, None), (1, ""), (2, "123 !!"), (None, "the the"), (3, "é")]
    got = {r["doc_id"]: r for r in language.language_query(frame(spark, odd)).collect()}
    assert [got[k]["lang_pred"] for k in (0, 1, 2)] == ["und"] * 3 and all(0 <= r["score"] <= 1 for r in got.values())
    untaught = frame(spark, odd).withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in language.language_query(untaught).collect()} == {"und"}


def test_bpe_as_the_library(spark):
    import public_tokenizers
    import tiktoken

    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    want = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(2)
    texts = ["".join(rng.choice("ab cdeé'st\n 1!ーñ𝒳") for _ in range(rng.randint(0, 40))) for _ in range(300)] + [None, "", "a" * 3000, "<|endoftext|>", " \t\n x"]
    df = frame(spark, list(enumerate(texts)))
    rows = bpe.round_trip(df, path, pattern).collect()
    assert len(rows) == len(texts)
    for r in rows:
        text = texts[r["doc_id"]] or ""
        assert np.frombuffer(r["ids"], "<u4").tolist() == want.encode_ordinary(text) and bytes(r["decoded"]) == text.encode()
    again = bpe.decode(bpe.encode(df, path, pattern), path).collect()
    assert sorted(again) == sorted(rows)


def test_merges_whose_ranks_go_down():
    """A merge that makes a lower rank possible must give way to it at once."""
    ranks = {bytes([b]): b for b in range(256)}
    ranks |= {b"ab": 300, b"abc": 299, b"bc": 301, b"ca": 298, b"aa": 302}

    def one(piece):
        parts = [bytes([b]) for b in piece]
        while True:
            at = min(((ranks.get(parts[k] + parts[k + 1], 1 << 30), k) for k in range(len(parts) - 1)), default=(1 << 30, 0))
            if at[0] == 1 << 30:
                return [ranks[p] for p in parts]
            parts[at[1] : at[1] + 2] = [parts[at[1]] + parts[at[1] + 1]]

    v, rng = bpe.Vocabulary(ranks), random.Random(5)
    pieces = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 12))).encode() for _ in range(500)]
    ids, offsets = v.replay(pieces)
    assert [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:])] == [one(p) for p in pieces]


def groups_brute(rows, words, percent):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + words]) for i in range(len(w) - words + 1)} or ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least.setdefault(find(i), []).append(d)
    return sorted((d, len(sets[i]), min((x for x in least[find(i)] if x is not None), default=d)) for i, (d, _) in enumerate(rows))


@pytest.mark.parametrize("words,percent", [(4, 85), (5, 80)])
def test_jaccard_join_brute_force(spark, words, percent):
    rng, rows = random.Random(7), []
    for base in range(12):
        text = [f"x{rng.randint(0, 400)}" for _ in range(rng.choice([3, 7, 20, 60, 150]))]
        for _ in range(12):
            near = list(text)
            for _ in range(rng.randint(0, 4)):
                near[rng.randrange(len(near))] = f"y{rng.randint(0, 9)}"
            rows.append((len(rows), " ".join(near)))
    rows += [(500, None), (501, ""), (502, " \n"), (503, "One two"), (504, "one TWO"), (505, "one two three"), (506, rows[3][1]), (506, rows[3][1]), (507, "é" * 9000), (508, "a " * 5000), (509, "A\ta " * 2500)]
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in parity_join.link_components(frame(spark, rows), words, percent).collect())
    assert got == groups_brute(rows, words, percent)
    kept = parity_join.keep_one(frame(spark, rows), words, percent)
    assert kept.columns == frame(spark, rows).columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({d for d, n, c in got if d == c})


def test_components_of_few_edges_take_few_jobs(spark):
    rng = random.Random(5)
    edges = [(k, k + 1) for k in range(-150, 150)] + [(10**15, -(10**14) - k) for k in range(200)] + [(rng.randrange(1000, 3000), rng.randrange(1000, 3000)) for _ in range(900)] + [(5, 5), (-7, -7), (7000, 7000)]
    least = {}

    def root(x):
        while least.setdefault(x, x) != x:
            x = least[x]
        return x

    for a, b in edges:
        low, high = sorted((root(a), root(b)))
        least[high] = low
    want = {(x, root(x)) for x in least if root(x) != x}
    df, context = spark.createDataFrame(edges, "a long, b long").repartition(7).checkpoint(), spark.sparkContext
    jobs = {}
    for ways in ({}, {"rows": len(edges)}, {"rows": len(edges) - 1}):
        context.setJobGroup(f"components {ways}", "")
        got = [tuple(r) for r in parity_join.connected(df, **ways).collect()]
        assert len(got) == len(set(got)) and set(got) == want
        jobs[str(ways)] = len(context.statusTracker().getJobIdsForGroup(f"components {ways}"))
        assert ways.get("rows") == len(edges) - 1 or jobs[str(ways)] <= 6, jobs
    context.setLocalProperty("spark.jobGroup.id", None)
    assert parity_join.connected(df.limit(0)).isEmpty()


def test_keep_one_where_ids_repeat_or_lack(spark):
    """Groups are told apart by their links, not by ids: each keeps exactly one row."""
    rng = random.Random(9)

    def near(n, seed):
        base = [f"{seed}x{k}" for k in range(60)]
        return [" ".join([*base[:-1], f"y{k}"]) for k in range(n)]

    groups = [[(None, t) for t in near(20, "a")], [(7, t) for t in near(5, "b")], [(7, t) for t in near(4, "c")], [(8, t) for t in near(1, "d") * 3] + [(None, near(1, "d")[0])], [(9, near(2, "e")[0]), (10, near(2, "e")[1])]]
    groups.append([(None, t) for t in near(1, "f") * 2000])
    rows = [r for g in groups for r in g] + [(None, None), (None, None), (11, ""), (11, "")]
    rng.shuffle(rows)
    kept = [(r["doc_id"], r["text"]) for r in parity_join.keep_one(frame(spark, rows), 5, 80).collect()]
    for g in groups:
        mine = [r for r in kept if r in g]
        assert len(mine) == 1, g[0]
        assert mine[0][0] == min((d for d, _ in g if d is not None), default=None)
    assert len(kept) == len(groups) + 4


def test_jaccard_hot_buckets(spark, monkeypatch):
    """Buckets are dealt over several tasks, and groups in them are numbered."""
    monkeypatch.setattr(parity_join, "HOT", 5)
    monkeypatch.setattr(parity_join, "STARS", (1,))
    monkeypatch.setattr(parity_join, "STAR_CENTRES", 1)
    rng = random.Random(11)
    base = [f"x{k}" for k in range(80)]
    rows = []
    for k in range(90):
        own = list(base)
        for _ in range(rng.randint(0, 6)):
            own[rng.randrange(80)] = f"y{rng.randint(0, 5)}"
        rows.append((k, " ".join(own)))
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in parity_join.link_components(frame(spark, rows), 4, 85).collect())
    assert got == groups_brute(rows, 4, 85)


def test_jaccard_join_nothing(spark):
    assert parity_join.components_query(frame(spark, [])).collect() == []
    assert [tuple(r) for r in parity_join.components_query(frame(spark, [(None, "a b c d e")])).collect()] == [(None, 2, None)]


def test_perplexity_is_a_distribution(spark):
    rng = random.Random(4)
    rows = [(k, "".join(rng.choice("abcde ") for _ in range(60))) for k in range(80)]
    tables = quality.model_tables(quality.count_codes(frame(spark, rows), 3), 3)
    for context in (0x6161, 0x7878, 0x0061):
        wanted = spark.createDataFrame([(context << 8 | b,) for b in range(256)], "code long")
        total = sum(math.exp(-r["cost"]) for r in quality.costs(wanted, tables).collect())
        assert total == pytest.approx(1, abs=1e-4)


def test_quality(spark):
    docs, labels = (common.table(spark, "/root/testdata/sf0.01", t) for t in ("documents", "labels"))
    docs = docs.unionByName(frame(spark, [(90_000, None), (90_001, ""), (None, "the")]))
    a = quality.quality_query(docs, labels).cache()
    assert a.count() == docs.count()
    marked = a.join(labels, "doc_id")
    assert marked.where("quality = 1 AND NOT keep").count() <= 3 and marked.where("quality = 0 AND NOT keep").count() >= 40
    assert a.where("doc_id IN (90000, 90001) AND keep AND perplexity IS NULL").count() == 2
    kept = quality.filter_quality(docs, labels)
    assert kept.columns == docs.columns and kept.count() == a.where("keep").count()
    assert quality.quality_query(docs, labels.where("false")).where("NOT keep").count() == 0


def test_quality_of_a_rare_language(spark):
    docs, labels = (common.table(spark, "/root/testdata/sf0.01", t) for t in ("documents", "labels"))
    docs = docs.unionByName(docs.where("lang = 'es'").limit(20).withColumns({"doc_id": F.col("doc_id") + 90_000, "lang": F.lit("xx")}))
    out = quality.quality_query(docs, labels.join(docs.where("lang = 'es'"), "doc_id", "left_anti")).join(docs.select("doc_id", "lang"), "doc_id").join(labels, "doc_id", "left").cache()
    clean, junk = (out.where(f"lang = 'es' AND quality = {q}") for q in (1, 0))
    assert clean.count() > 20 and clean.where("NOT keep").count() == 0 and junk.where("NOT keep").count() > 0
    assert out.where("lang = 'xx'").count() == 20 and out.where("lang = 'xx' AND NOT keep").count() == 0


def test_quality_by_broadcast_and_by_join(spark):
    docs = common.table(spark, SF, "documents").select("doc_id", "lang", "text").limit(40).unionByName(frame(spark, [(1, None), (2, "")]).select("doc_id", "lang", "text"))
    table = quality.count_codes(docs).select("code", "n", (F.col("n") / 7).cast("float").alias("cost"))
    rows = [sorted(quality.perplexities(docs, table, most).select("doc_id", "n_bytes", F.round("log_ppl", 6)).collect()[:], key=str) for most in (10**6, 1, 2000)]
    assert rows[0] == rows[1] == rows[2]


def kneser_ney(trusted, order=5):
    """p(last byte | bytes before) of interpolated modified Kneser-Ney, by recursion over plain dictionaries."""
    same = bytes(48 if 48 <= b <= 57 else 32 if b in (9, 10, 13) else b for b in range(256))
    grams = [{} for _ in range(order + 1)]
    for t in trusted:
        t = b"\0" * (order - 1) + t.encode().translate(same)
        for i in range(order - 1, len(t)):
            g = t[i - order + 1 : i + 1]
            grams[order][g] = grams[order].get(g, 0) + 1
    for k in range(order - 1, 0, -1):
        for g in grams[k + 1]:
            grams[k][g[1:]] = grams[k].get(g[1:], 0) + 1
    off = [None]
    for k in range(1, order + 1):
        n = [sum(v == x for v in grams[k].values()) for x in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1]) if all(n) else 0
        off.append([min(max(x - (x + 1) * y * n[x] / n[x - 1], 0.01), x - 0.01) for x in (1, 2, 3)] if all(n) else [0.5, 1.0, 1.5])
    seen = [{} for _ in range(order + 1)]
    for k in range(1, order + 1):
        for g, n in grams[k].items():
            seen[k].setdefault(g[:-1], []).append(n)

    def p(g):
        if not g:
            return 1 / 256
        k, ns = len(g), seen[len(g)].get(g[:-1])
        if not ns:
            return p(g[1:])
        cut = lambda n: off[k][min(n, 3) - 1]
        n = grams[k].get(g, 0)
        return ((n - cut(n)) if n else 0) / sum(ns) + sum(map(cut, ns)) / sum(ns) * p(g[1:])

    def log_ppl(t):
        t = b"\0" * (order - 1) + t.encode().translate(same)
        return -sum(math.log(p(t[i - order + 1 : i + 1])) for i in range(order - 1, len(t))) / (len(t) - order + 1)

    return log_ppl


def test_perplexity_brute_force(spark):
    rng = random.Random(8)
    text = lambda: "".join(rng.choice("abcde é1\n") for _ in range(rng.randint(1, 90)))
    rows = [(k, text()) for k in range(150)] + [(900, "é" * 3000)]
    labels = spark.createDataFrame([(k, 1, 0) for k in range(0, 150, 2)], "doc_id long, quality int, toxic int")
    want = kneser_ney([t for k, t in rows if k % 2 == 0 and k < 150 and zlib.crc32(str(k).encode()) % quality.FOLDS != quality.FOLDS - 1])
    got = {r["doc_id"]: r["log_ppl"] for r in quality.judge(frame(spark, rows).select("doc_id", "lang", "text"), labels).collect()}
    for k, t in rows:
        assert got[k] == pytest.approx(want(t), abs=1e-5)
    assert quality.quality_query(frame(spark, []), labels).collect() == []


def test_nearest_recall(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(8, 16))
    x = (centres[rng.integers(0, 8, 3000)] + rng.normal(size=(3000, 16)) * 0.5).astype(np.float32)
    x[500:1500] = x[500]
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    odd = [(5000, None), (5100, [0.0] * 16), (5200, [float("nan")] + [1.0] * 15), (5300, [None] + [1.0] * 15), (5400, [1.0]), (None, [1.0] * 16), (2999, x[2999].tolist())]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>")
    got = {}
    for r in multi_index.nearest(df, F.col("vec_id") % 100 == 0).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    assert set(got) == set(range(0, 3000, 100)) and all(sorted(g) == list(range(1, 11)) for g in got.values())
    y, hits = x.astype(np.float64), 0
    for q, found in got.items():
        d = np.sqrt(((y - y[q]) ** 2).sum(1))
        want = [k for k in np.lexsort((np.arange(3000), d)) if k != q][:10]
        hits += len({v for v, _ in found.values()} & set(map(int, want)))
        assert all(s == pytest.approx(d[v], abs=1e-12) for v, s in found.values())
        if 500 <= q < 1500:
            assert [found[k][0] for k in range(1, 11)] == want
    assert hits >= 0.9 * 10 * len(got)
    few = multi_index.nearest(df.where("vec_id IN (0, 100, 101)"), F.col("vec_id") % 100 == 0).collect()
    assert sorted((r["query_id"], r["rank"]) for r in few) == [(0, 1), (0, 2), (100, 1), (100, 2)]
    assert multi_index.nearest(df.where("false"), F.col("vec_id") % 100 == 0).collect() == []


def test_nearest_where_one_entry_seems_enough(spark):
    x = np.random.default_rng(6).normal(size=(40, 8)).astype(np.float32)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = multi_index.nearest(df, F.col("vec_id") % 10 == 0, wanted=1).groupBy("query_id").count().collect()
    assert len(got) == 4 and {r["count"] for r in got} == {10}


def test_nearest_in_hot_cells_and_groups(spark, monkeypatch):
    """Small groups and shares, a cell of most rows, ties, repeated rows: all is found where every entry is looked at."""
    monkeypatch.setattr(multi_index, "SALT", 3)
    monkeypatch.setattr(multi_index, "PENDING", 50)
    layout = multi_index.layout
    monkeypatch.setattr(multi_index, "layout", lambda sizes: layout(sizes, 16))
    x = np.random.default_rng(7).integers(-2, 3, (400, 6)).astype(np.float32) + np.float32(0.5)
    x[:250] = x[0] + np.random.default_rng(8).integers(0, 2, (250, 6)).astype(np.float32) * np.float32(1e-3)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)] + [(5, x[5].tolist())], "vec_id long, embedding array<float>")
    got = {}
    for r in multi_index.nearest(df, F.col("vec_id") % 10 == 0, wanted=1000).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    y = x.astype(np.float64)
    assert len(got) == 40
    for q, found in got.items():
        d = np.sqrt(((y - y[q]) ** 2).sum(1))
        want = [int(k) for k in np.lexsort((np.arange(400), d)) if k != q][:10]
        assert [(r, v) for r, v, _ in sorted(found)] == list(enumerate(want, 1)) and all(s == d[v] for _, v, s in found)


def test_groups_of_cells():
    rng = np.random.default_rng(2)
    sizes = rng.integers(0, 20, 300)
    sizes[[5, 17, 299]] = 100, 33, 64
    first, pieces = multi_index.layout(sizes, 32)
    held, large = {}, set()
    for cell, size in enumerate(sizes):
        own = range(first[cell], first[cell] + pieces[cell])
        assert pieces[cell] == max(1, -(-size // 32)) and not large & set(own)
        if size > 32:
            large |= set(own)
            assert not large & set(held)
        else:
            held[int(first[cell])] = held.get(int(first[cell]), 0) + size
    assert max(held.values()) <= 32


def test_walk_is_in_order():
    rng = np.random.default_rng(1)
    a, b, sizes = rng.random(6), rng.random(5), rng.integers(0, 3, 30)
    cells = multi_index.walk(a, b, sizes, 10**6)
    want = sorted((i * 5 + j for i in range(6) for j in range(5) if sizes[i * 5 + j]), key=lambda c: a[c // 5] + b[c % 5])
    assert cells == want


def test_pipeline(spark):
    out = corpus_pipeline.run(spark, SF)
    docs = common.table(spark, SF, "documents")
    assert 0 < out.count() < docs.count() and {"doc_id", "text", "ids", "n_tokens"} <= set(out.columns)
    assert out.where(F.col("text").rlike('token = "[0-9a-f]{40}')).count() == 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "ngram_jaccard_join", "benchmark_decontamination", "secret_scan", "byte_bpe"]


def test_stages_keep_clashing_columns(spark):
    docs = frame(spark, [(k, f"some text number {k} token=abcdefgh") for k in range(5)]).withColumns({c: F.lit(1) for c in ("spans", "words", "hash", "_id", "node", "score", "row")})
    for _, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.count() > 0
    last = docs.withColumns({"N_tokens": F.lit(-1), "ids": F.lit("x"), "decoded": F.lit(2)})
    out = corpus_pipeline.STAGES[4][1](spark, last, SF)
    assert sorted(out.columns) == sorted([*docs.columns, "n_tokens", "ids"])
    assert all(r["n_tokens"] == len(r["ids"]) // 4 > 0 and r["text"].startswith("some text") for r in out.collect())


def test_pipeline_of_empty_and_null_texts(spark, tmp_path):
    labels, bench = (common.table(spark, SF, t) for t in ("labels", "benchmark"))
    for name, rows in (("none", []), ("nulls", [(1, None), (2, ""), (None, None), (None, "a few words"), (3, "a few words"), (3, "a few words")])):
        at = str(tmp_path / name)
        frame(spark, rows).write.parquet(f"{at}/documents.parquet")
        labels.write.parquet(f"{at}/labels.parquet")
        bench.write.parquet(f"{at}/benchmark.parquet")
        got = sorted(((r["doc_id"], r["text"], r["n_tokens"]) for r in corpus_pipeline.run(spark, at).collect()), key=str)
        assert [(d, n) for d, _, n in got] == ([] if not rows else [(1, 0), (2, 0), (3, 3), (None, 0)])


def test_all_registered():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in registry.QUERIES) == list(range(1, 11))
