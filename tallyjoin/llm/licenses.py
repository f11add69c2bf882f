"""Licence scans by a positional rare-token index.

Templates and the base phrases are indexed by word and position: of a phrase all words, of a template the words of its mandatory
phrases and its ANCHORS rarest by IDF over the whole corpus. In a text that holds the rarest mandatory word of any template, each
indexed word votes for the places where its templates would then begin; sorted votes that agree on a place are a base phrase if
they are all its words, and a candidate of a template otherwise, which is a label if its mandatory phrases stand in the text word
for word. The IDF ranks words and weighs them in the score, and excludes none. JVM expressions only; after the document
frequencies (at most one row for each licence word) everything is local to a row, and its cost grows with n log n of the votes.

Null and empty texts have no words and no label; an empty table gives none. Repeated rows get the same result each. A text with
several notices, however long, gets all their labels; equal IDFs rank by the word.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyjoin.llm.common import words_of


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    mandatory: tuple[str, ...]

    @property
    def words(self) -> list[str]:
        return re.findall("[a-z0-9]+", self.text.lower())


# The phrases and labels of the contract, and the words in which licences are stated and their notices written.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
TEMPLATES = (
    Template("mit", "released under the mit license", ("mit license",)),
    Template("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this software", ("permission is hereby granted", "free of charge")),
    Template("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2 0",)),
    Template("gpl-2.0", "licensed under the gnu general public license version 2", ("gnu general public license version 2",)),
    Template("gpl-3.0", "licensed under the gnu general public license version 3", ("gnu general public license version 3",)),
    Template("lgpl", "licensed under the gnu lesser general public license", ("lesser general public license",)),
    Template("agpl", "licensed under the gnu affero general public license", ("affero general public license",)),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ("redistribution and use in source and binary forms",)),
    Template("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    Template("epl", "made available under the terms of the eclipse public license", ("eclipse public license",)),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose", ("permission to use copy modify and or distribute",)),
    Template("unlicense", "this is free and unencumbered software released into the public domain", ("unencumbered software", "public domain")),
    Template("cc-by", "licensed under cc by 4 0", ("cc by 4 0",)),
    Template("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    Template("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    Template("cc0", "licensed under cc0 1 0 universal", ("cc0 1 0",)),
    Template(
        "mit-text",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without "
        "restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom "
        "the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions "
        "of the Software. The Software is provided as is, without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a "
        "particular purpose and noninfringement. In no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort "
        "or otherwise, arising from, out of or in connection with the Software or the use or other dealings in the Software.",
        ("to deal in the software without restriction",),
    ),
    Template(
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission "
        "notice appear in all copies. The software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability "
        "and fitness. In no event shall the author be liable for any special, direct, indirect, or consequential damages or any damages whatsoever resulting from loss of use, data or profits, "
        "whether in an action of contract, negligence or other tortious action, arising out of or in connection with the use or performance of this software.",
        ("with or without fee is hereby granted", "disclaims all warranties"),
    ),
    Template(
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must "
        "retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of "
        "conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        ("redistributions of source code must retain the above copyright notice",),
    ),
    Template(
        "apache-2.0",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at http www apache org licenses LICENSE 2 0. Unless required by applicable law or "
        "agreed to in writing, software distributed under the License is distributed on an as is basis, without warranties or conditions of any kind, either express or implied. See the License "
        "for the specific language governing permissions and limitations under the License.",
        ("apache org licenses license 2 0",),
    ),
    Template(
        "gpl-2.0",
        "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your "
        "option) any later version.",
        ("gnu general public license as published by the free software foundation either version 2 of the license",),
    ),
    Template(
        "gpl-3.0",
        "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version.",
        ("gnu general public license as published by the free software foundation either version 3 of the license",),
    ),
    Template(
        "mpl-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",
        ("if a copy of the mpl was not distributed with this file",),
    ),
    Template(
        "unlicense",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or "
        "non-commercial, and by any means.",
        ("anyone is free to copy modify publish use compile sell or distribute this software",),
    ),
)
#: Rarest words of a template that are indexed with its mandatory ones; agreeing words of a candidate; words an edit may shift it.
ANCHORS, AGREEING, SLACK = 3, 2, 1


def document_frequencies(words: DataFrame, templates: tuple[Template, ...]) -> tuple[int, dict[str, int]]:
    """Number of texts, and of texts with each licence word, over the whole corpus; ``words`` has column words."""
    vocabulary = sorted({w for t in templates for w in t.words})
    held = F.array_intersect("words", F.expr(_strings(vocabulary)))
    counts = {r["word"]: r["n"] for r in words.select(F.explode(F.concat(held, F.array(F.lit(" ")))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = counts.pop(" ", 0)
    return total, {w: counts.get(w, 0) for w in vocabulary}


def _strings(values) -> str:
    return "array(" + ", ".join(f"'{x}'" for x in values) + ")"


@dataclass(frozen=True)
class Index:
    """postings: word -> (template, position, IDF); templates beyond ``labels`` are the base phrases. keys: a word that a text must
    hold to have any template or phrase. mass: IDF of all indexed words of a template."""

    postings: dict[str, list[tuple[int, int, float]]]
    keys: list[str]
    mass: list[float]


def build_index(templates: tuple[Template, ...], total: int, counts: dict[str, int]) -> Index:
    idf = {w: math.log((1 + total) / (1 + n)) + 1.0 for w, n in counts.items()}
    rarest = lambda words: sorted(set(words), key=lambda w: (-idf.get(w, 0.0), w))
    postings: dict[str, list[tuple[int, int, float]]] = {}
    mass = []
    for k, template in enumerate(templates):
        anchors = {*" ".join(template.mandatory).split(), *rarest(template.words)[:ANCHORS]}
        for at, word in enumerate(template.words):
            if word in anchors:
                postings.setdefault(word, []).append((k, at, idf[word]))
        mass.append(sum(idf[w] for w in template.words if w in anchors))
    for k, (phrase, _) in enumerate(BASE, len(templates)):
        for at, word in enumerate(phrase.split()):
            postings.setdefault(word, []).append((k, at, 0.0))
    keys = {rarest(" ".join(t.mandatory).split())[0] for t in templates} | {rarest(phrase.split())[0] for phrase, _ in BASE}
    return Index(postings, sorted(keys), mass)


def scan_licenses(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """doc_id, words' number, places of base phrases by start, the method's labels with the share of a template's IDF found in line."""
    df = docs.select("doc_id", words_of(F.col("text")).alias("words"))
    index = build_index(templates, *document_frequencies(df, templates))
    df = df.withColumn("_some", F.arrays_overlap("words", F.expr(_strings(index.keys))))
    posting = lambda x: f"named_struct('t', {x[0]}, 'p', {x[1]}, 'idf', {x[2]!r}D)"
    post = "map(" + ", ".join(f"'{w}', array({', '.join(map(posting, xs))})" for w, xs in sorted(index.postings.items())) + ")"
    hits = f"array_compact(transform(words, (w, i) -> if(array_contains({_strings(sorted(index.postings))}, w), i, NULL)))"
    votes = f"transform({hits}, i -> transform(try_element_at({post}, get(words, i)), x -> named_struct('t', x.t, 'at', i - x.p, 'p', x.p, 'idf', x.idf)))"
    df = df.withColumn("_votes", F.expr(f"CASE WHEN _some THEN array_sort(flatten({votes})) ELSE array() END"))

    def places(k: int, phrase: str, label: str) -> str:
        """A word votes once for a place, so as many votes as the phrase has words are the whole phrase."""
        n = len(phrase.split())
        whole = f"zip_with(_votes, slice(_votes, {n}, size(_votes)), (a, b) -> if(a.t = {k} AND b.t = {k} AND a.at = b.at, a.at, NULL))"
        return f"transform(array_compact({whole}), at -> named_struct('start', at, 'label', '{label}'))"

    base = ", ".join(places(k, phrase, label) for k, (phrase, label) in enumerate(BASE, len(templates)))
    df = df.withColumn("places", F.expr(f"CASE WHEN size(_votes) > 0 THEN array_sort(concat({base})) ELSE cast(array() AS array<struct<start:int,label:string>>) END"))
    df = df.withColumn("_padded", F.when(F.size("_votes") > 0, F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" "))))

    def found(k: int, t: Template) -> Column:
        """The largest share of the template's IDF that agrees on one place, 0 where too few words do or a phrase is missing."""
        same = f"v.at - acc.at <= {SLACK}"
        mass, n = f"if({same}, acc.mass, 0D) + v.idf", f"if({same}, acc.n, 0) + 1"
        step = f"(acc, v) -> named_struct('at', if({same}, acc.at, v.at), 'mass', {mass}, 'n', {n}, 'best', greatest(acc.best, if({n} >= {AGREEING}, {mass}, 0D)))"
        share = F.expr(f"aggregate(filter(_votes, v -> v.t = {k}), named_struct('at', -1000000000, 'mass', 0D, 'n', 0, 'best', 0D), {step}, acc -> least(acc.best / {index.mass[k]!r}D, 1D))")
        whole = reduce(lambda a, b: a & b, (F.contains("_padded", F.lit(f" {x} ")) for x in t.mandatory))
        return F.struct(F.lit(t.label).alias("label"), F.when(whole, share).otherwise(F.lit(0.0)).alias("share"))

    labels = F.filter(F.array(*[found(k, t) for k, t in enumerate(templates)]), lambda x: x["share"] > 0)
    empty = F.array().cast("array<struct<label:string,share:double>>")
    return df.select("doc_id", F.size("words").cast("bigint").alias("n_words"), "places", F.when(F.size("_votes") > 0, labels).otherwise(empty).alias("found"))


def license_digest(docs: DataFrame) -> DataFrame:
    """The figures of the contract from scan_licenses(). score: 1 with a base phrase, else the best template's share."""
    df = scan_licenses(docs)
    start = lambda f: f(F.transform("places", lambda x: x["start"])).cast("bigint")
    base = F.array_distinct(F.transform("places", lambda x: x["label"]))
    both = F.array_distinct(F.concat(base, F.transform("found", lambda x: x["label"])))
    score = F.when(F.size("places") > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max(F.transform("found", lambda x: x["share"])), F.lit(0.0)))
    return df.select(
        "doc_id",
        "n_words",
        F.size("places").cast("bigint").alias("n_base"),
        start(F.array_min).alias("first_word"),
        start(F.array_max).alias("last_word"),
        F.array_join(F.array_sort(base), ",").alias("base_labels"),
        F.array_join(F.array_sort(both), ",").alias("labels"),
        score.alias("score"),
    )
