"""License scan by diagonal voting (operator 6).

Every text is lower-cased (A-Z) and cut into words; hashes of all runs of GRAM words are joined to the positions at
which licence templates have them. Each match votes for its diagonal (place in the text minus place in the template).
Votes of a diagonal that are GAP words apart at most make a segment; segments of one vote only are taken for stray. Segments that
follow each other, in the text and in the template, on diagonals at most NEIGHBOUR apart are merged, which bridges inserted or
missing words.

A merged span is verified: the template's words that it covers, counted once each, make up COVER of the template; the words of
the text between them that are not the template's are no more than the rest; and every run of words that tells this licence from
others (in brackets in the template: names, versions, clauses) stands in it unbroken. Of spans that overlap, the one that
covers most words counts. Beside this, places of fixed base phrases are counted.

Templates are few and fixed, so their table may be broadcast; votes are made by one pass that never groups
a text's words. Defined results: null and empty texts have no words and no labels; a row counts for itself even if it
is repeated; equal labels appear once; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, Rolling, mix, small_batches, steps, stored, texts_of, trimmed, words_of

GRAM, NEIGHBOUR, GAP, COVER = 3, 3, 8, 0.75

# Base phrases, and notices of public licences as they are commonly written.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
TEMPLATES = {
    "mit": [
        "released [under the mit license]",
        "permission is hereby granted free of charge to any person obtaining a copy of this software [and associated documentation files the software to deal in the software without restriction] including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
        "[the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software]",
    ],
    "isc": ["[permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted] provided that the above copyright notice and this permission notice appear in all copies"],
    "apache-2": [
        "licensed under the [apache license version 2 0]",
        "[you may not use this file except in compliance with the license] you may obtain a copy of the license at",
    ],
    "bsd": ["[redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met]"],
    "bsd-3": ["neither the name of the copyright holder nor the names of its contributors [may be used to endorse or promote products derived from this software without specific prior written permission]"],
    "mpl-2": ["this source code form is subject to the terms of the [mozilla public license v 2 0]", "licensed under the [mozilla public license version 2 0]"],
    "epl-2": ["this program and the accompanying materials are made available under the terms of the [eclipse public license 2 0]"],
    "unlicense": ["[this is free and unencumbered software released into the public domain]", "anyone is free to copy modify publish use compile sell or distribute this software [either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means]"],
    "zlib": ["[this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software]"],
    "boost": ["distributed under the [boost software license version 1 0]"],
    "cc0": ["[cc0 1 0 universal] public domain dedication", "to the extent possible under law the author has [waived all copyright and related or neighboring rights] to this work"],
}
_GNU = {"gpl": "general", "lgpl": "lesser general", "agpl": "affero general"}
_VERSIONS = {"gpl": ("2", "3"), "lgpl": ("2 1", "3"), "agpl": ("3",)}
for _code, _name in _GNU.items():
    for _v in _VERSIONS[_code]:
        TEMPLATES[f"{_code}-{_v.replace(' ', '.')}"] = [
            f"this work is licensed under the [gnu {_name} public license version {_v}]",
            f"is free software you can redistribute it and or modify it under the terms of [the gnu {_name} public license as published by the free software foundation either version {_v} of the license] or at your option any later version",
        ]
_CREATIVE = {"by": "attribution", "by-sa": "attribution sharealike", "by-nc": "attribution noncommercial", "by-nd": "attribution noderivatives", "by-nc-sa": "attribution noncommercial sharealike", "by-nc-nd": "attribution noncommercial noderivatives"}
for _code, _name in _CREATIVE.items():
    TEMPLATES[f"cc-{_code}"] = [
        f"licensed under [cc {_code.replace('-', ' ')} 4 0]",
        f"this work is licensed under a [creative commons {_name} 4 0] international license",
        f"this work is licensed under a [creative commons {_name} 3 0] unported license",
    ]

#: Bytes that are in no word: ASCII without digits and a-z (after lower-casing).
PARTS = np.ones(256, bool)
PARTS[48:58] = PARTS[97:123] = PARTS[128:] = False

_ROLL = Rolling(606)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word of lower-cased texts, and the text it is in."""
    start, end, text = words_of(raw, at, PARTS)
    return mix(_ROLL.ranges(_ROLL.prefix(raw), start, end) + (end - start).astype(np.uint64)), text


def rolled(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k words."""
    n = len(words) - k + 1
    out = np.zeros(max(n, 0), np.uint64)
    for j in range(k):
        if n > 0:
            out = out * _STEP + words[j : j + n]
    return mix(out)


def _hashes_of(phrase: str) -> np.ndarray:
    raw = LOWER[np.frombuffer(phrase.encode(), np.uint8)]
    return word_hashes(raw, np.array([0, len(raw)]))[0]


def _scan(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    base = [(_hashes_of(p), label) for p, label in BASE.items()]
    task, count = TaskContext.get().partitionId() if TaskContext.get() else 0, 0
    for batch in rows:
        raw, at = texts_of(batch.column(1))
        for lo, hi in steps(at):
            part, own = LOWER[raw[at[lo] : at[hi]]], at[lo : hi + 1] - at[lo]
            words, text = word_hashes(part, own)
            n = np.bincount(text, minlength=hi - lo)
            from_word = np.concatenate([[0], np.cumsum(n)])
            first, last, found = np.full(hi - lo, -1), np.full(hi - lo, -1), np.zeros(hi - lo, np.int64)
            labels: list[set[str]] = [set() for _ in range(hi - lo)]
            for phrase, label in base:
                m = len(words) - len(phrase) + 1
                hit = np.flatnonzero(words[: max(m, 0)] == phrase[0])
                for j in range(1, len(phrase)):
                    hit = hit[words[hit + j] == phrase[j]]
                hit = hit[text[hit] == text[hit + len(phrase) - 1]]
                for i in hit:
                    t, p = text[i], i - from_word[text[i]]
                    found[t] += 1
                    first[t] = p if first[t] < 0 else min(first[t], p)
                    last[t] = max(last[t], p)
                    labels[t].add(label)
            g = rolled(words, GRAM).view(np.int64)
            whole = text[: len(g)] == text[GRAM - 1 :] if len(g) else np.zeros(0, bool)
            starts = np.concatenate([[0], np.cumsum(np.bincount(text[: len(g)][whole], minlength=hi - lo))]).astype(np.int32)
            yield pa.record_batch({
                "row": pa.array((task << 40) + count + np.arange(lo, hi)), "doc_id": batch.column(0).slice(lo, hi - lo), "n_words": pa.array(n), "n_base": pa.array(found),
                "first_word": pa.array(first, mask=first < 0), "last_word": pa.array(last, mask=last < 0), "base": pa.array([sorted(x) for x in labels], pa.list_(pa.string())),
                "grams": pa.ListArray.from_arrays(pa.array(starts), pa.array(g[whole])),
            })
        count += batch.num_rows


def parsed(template: str) -> tuple[str, list[int]]:
    """The plain words of a template, and the places of its runs of GRAM words that lie in brackets."""
    words, core, inside = [], [], None
    for word in template.split():
        if word.startswith("["):
            inside = len(words)
        words.append(word.strip("[]"))
        if word.endswith("]"):
            core += range(inside, len(words) - GRAM + 1)
            inside = None
    return " ".join(words), core


def templates(spark) -> DataFrame:
    """A row for each run of words of each template; runs that a template holds twice can't tell a diagonal and are left out."""
    rows, k = [], 0
    for label, texts in TEMPLATES.items():
        for text in texts:
            plain, core = parsed(text)
            words = _hashes_of(plain)
            grams = rolled(words, GRAM).view(np.int64).tolist()
            core = [i for i in core if grams.count(grams[i]) == 1]
            rows += [(h, k, label, len(words), core, i) for i, h in enumerate(grams) if grams.count(h) == 1]
            k += 1
    return spark.createDataFrame(rows, "gram long, template int, label string, length int, core array<int>, at int")


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, and the verified spans."""
    spark = docs.sparkSession
    small_batches(spark)
    kind = docs.schema["doc_id"].dataType.simpleString()
    own = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base"]
    read = docs.select("doc_id", "text").mapInArrow(trimmed(_scan), f"row long, doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base array<string>, grams array<long>")
    # The -1 stands for the document itself, so that its row lives on without votes.
    grams = read.select("row", *own, F.posexplode(F.concat(F.array(F.lit(0).cast("long")), F.col("grams"))).alias("p", "gram")).withColumn("p", F.col("p") - 1)
    known = F.broadcast(templates(spark).withColumnRenamed("gram", "of"))
    both = grams.join(known, (F.col("gram") == F.col("of")) & (F.col("p") >= 0), "left").filter((F.col("p") < 0) | F.col("template").isNotNull())
    both = stored(both.drop("gram", "of"), "votes")
    found = verified(both.filter("p >= 0").select("row", "template", "label", "length", "core", "p", "at"))
    out = both.filter("p < 0").select("row", *own).join(found, "row", "left")
    return out.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.concat_ws(",", "base").alias("base_labels"),
        F.concat_ws(",", F.array_sort(F.array_union("base", F.coalesce(F.col("spans.label"), F.array().cast("array<string>"))))).alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("cover", F.lit(0.0))).alias("score"), F.coalesce("spans", F.array().cast(found.schema["spans"].dataType)).alias("spans"))


def verified(votes: DataFrame) -> DataFrame:
    """row, spans and the largest cover of any, from votes (row, template, label, length, core, p, at)."""
    line = ["row", "template", "diagonal"]
    votes = votes.withColumn("diagonal", F.col("p") - F.col("at"))
    before = F.lag("p").over(Window.partitionBy(*line).orderBy("p"))
    numbered = votes.withColumn("new", (F.col("p") - F.coalesce(before, F.lit(-GAP - 1)) > GAP).cast("int"))
    numbered = numbered.withColumn("segment", F.sum("new").over(Window.partitionBy(*line).orderBy("p")))
    segments = numbered.groupBy(*line, "segment").agg(
        F.first("label").alias("label"), F.first("length").alias("length"), F.first("core").alias("core"), F.count("*").alias("votes"), F.min("p").alias("p0"), F.max("p").alias("p1"),
        F.min("at").alias("a0"), F.max("at").alias("a1"), F.collect_set("at").alias("ats")).filter((F.col("votes") > 1) | (F.col("length") <= GRAM + 1))

    w = Window.partitionBy("row", "template").orderBy("p0", "p1", "diagonal")
    lag = lambda c: F.lag(c).over(w)
    apart = lag("p0").isNull() | (F.col("p0") - lag("p1") > GAP + GRAM) | (F.abs(F.col("diagonal") - lag("diagonal")) > NEIGHBOUR) | (F.col("a0") <= lag("a0"))
    merged = segments.withColumn("group", F.sum(apart.cast("int")).over(w)).groupBy("row", "template", "group").agg(
        F.first("label").alias("label"), F.first("length").alias("length"), F.first("core").alias("core"), F.sum("votes").alias("votes"), F.min("p0").alias("p0"),
        (F.max("p1") + GRAM).alias("p1"), F.array_distinct(F.flatten(F.collect_list("ats"))).alias("ats"))
    words = F.size(F.array_distinct(F.flatten(F.transform("ats", lambda a: F.sequence(a, a + GRAM - 1)))))
    rows = merged.withColumn("words", words).withColumn("cover", F.col("words") / F.col("length"))
    spare = F.col("length") * (1 - COVER)
    good = (F.col("cover") >= COVER) & (F.col("p1") - F.col("p0") - F.col("words") <= spare) & (F.size(F.array_intersect("core", "ats")) == F.size("core"))
    rows = rows.withColumn("good", good)

    # Spans that overlap, one after another, are settled together.
    fine = rows.filter("good").withColumn("end", F.max("p1").over(Window.partitionBy("row").orderBy("p0", "template").rowsBetween(Window.unboundedPreceding, -1)))
    fine = fine.withColumn("knot", F.sum((F.col("end").isNull() | (F.col("p0") >= F.col("end"))).cast("int")).over(Window.partitionBy("row").orderBy("p0", "template")))
    knots = fine.groupBy("row", "knot").agg(F.collect_list(F.struct("words", "cover", F.negative("template").alias("first"), "label", "p0", "p1", "votes")).alias("all"))
    beats = lambda x: lambda y: (y["p0"] < x["p1"]) & (x["p0"] < y["p1"]) & (F.struct(y["words"], y["cover"], y["first"]) > F.struct(x["words"], x["cover"], x["first"]))
    won = knots.select("row", F.explode(F.filter("all", lambda x: ~F.exists("all", beats(x)))).alias("x"))
    spans = won.groupBy("row").agg(F.array_sort(F.collect_list(F.struct(F.col("x.label").alias("label"), F.col("x.p0").alias("from_word"), F.col("x.p1").alias("to_word"), F.col("x.votes").alias("votes"), F.col("x.cover").alias("cover")))).alias("spans"))
    return rows.groupBy("row").agg(F.least(F.lit(1.0), F.max("cover")).alias("cover")).join(spans, "row", "left")
