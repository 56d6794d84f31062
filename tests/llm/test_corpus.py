"""The corpus operators against brute force, and their defined results on edge cases."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathomline.llm import licenses, minhash, mixing, packing, quality, repeats, sharding, suffixes, toxicity, urls, vectors
from fathomline.llm.graphs import components, tops

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, place string, `set` int, given int, spans int, kept int"


def corpus() -> list[tuple]:
    r = random.Random(4)
    word = lambda: "".join(r.choice(["an", "er", "th", "on", "re", "in", "é"]) for _ in range(r.randint(1, 4)))
    prose = lambda n: " ".join(word() + ("\n" if r.random() < 0.05 else "") for _ in range(n))
    texts: list[str | None] = [prose(r.randint(60, 200)) for _ in range(24)]
    texts += [texts[0], texts[0], texts[1]]  # copies
    for k in (2, 2, 3, 3, 4):  # near copies
        w = texts[k].split(" ")
        w[r.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    passage = prose(90)
    texts += [f"{prose(30)} {passage} {prose(30)}" for _ in range(4)] + [passage, passage[20:]]
    texts += [None, "", " \n ", "one", "one two", "one two", "the The THE", "x" * 1500, "ab" * 900, "Released under the MIT License.", "Released, under the MIT!! License " * 3]
    texts += [f"{prose(30)}\nLicensed under the Apache License, Version 2.0.\n{prose(20)}", "this work is licensed under the gnu general public license version 3", "cc by nc cc-by-nc CC BY NC 4.0"]
    texts += [prose(60) + " | " + "### *** $$$ " * 60, "same line here\n" * 80, prose(9000)]
    rows = [(i, t, r.choice(["en", "fr", None]), r.choice(["a", "a", "b", None]), len(t or ""), "clash", i, 1, 2, 3) for i, t in enumerate(texts)]
    return rows + [rows[5], (None, texts[6], "en", "a", 3, "clash", 0, 0, 0, 0)]  # a repeated row and a null id


ROWS = corpus()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


# --- 1 -------------------------------------------------------------------------------------------------------------

def removed(texts: list[bytes], length: int) -> list[tuple]:
    n = Counter(t[k : k + length] for t in texts for k in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - length + 1):
            if n[t[k : k + length]] > 1:
                gone[k : k + length] = True
        left = bytes(np.frombuffer(t, np.uint8)[~gone])
        out.append((len(t), int(gone.sum()), int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(t) else 0, hashlib.sha256(left).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [2, 256])
def test_suffix_array_dedup(docs, hot, monkeypatch):
    monkeypatch.setattr(repeats, "HOT_RUNS", hot)
    got = Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in repeats.removals(docs, 60, 30).collect())
    want = Counter((r[0], *x) for r, x in zip(ROWS, removed([(r[1] or "").encode() for r in ROWS], 60)))
    assert got == want


def test_suffix_array_remove_keeps_columns(docs, nothing):
    out = repeats.remove(docs)
    assert out.columns == docs.columns and out.count() == len(ROWS)
    assert all(r["n_chars"] == len(r["text"]) and r["place"] == "clash" for r in out.collect())
    assert repeats.removals(nothing).count() == 0 and repeats.remove(nothing).count() == 0


def doubled(t: np.ndarray) -> np.ndarray:
    """Suffixes in order, by ranks of prefixes twice as long each turn."""
    n = len(t)
    rank, k = np.unique(t, return_inverse=True)[1].astype(np.int64), 1
    while True:
        after = np.zeros(n, np.int64)
        after[: n - k] = rank[k:] + 1
        key = rank * (n + 2) + after
        order = np.argsort(key, kind="stable")
        new = np.zeros(n, np.int64)
        new[order[1:]] = np.cumsum(key[order[1:]] != key[order[:-1]])
        if new[order[-1]] == n - 1 or k >= n:
            return order
        rank, k = new, 2 * k


def test_induced_sorting_and_prefixes():
    r = np.random.default_rng(0)
    short = [r.integers(1, 1 + r.integers(1, 5), r.integers(0, 40)) for _ in range(400)] + [np.tile(r.integers(1, 4, 9), 60) for _ in range(20)]
    for t in (*short, r.integers(1, 3, 5000), np.tile([1, 2], 2500), np.ones(3000, int), np.concatenate([np.tile(r.integers(1, 9, 700), 5), r.integers(1, 9, 900)])):
        t = np.append(t, 0)
        sa = suffixes.suffix_array(t)
        assert (sa == doubled(t)).all()
        lcp = suffixes.common_prefixes(t, sa)
        for k in r.integers(1, len(sa), 60) if len(sa) > 1 else ():
            a, b, n = sa[k], sa[k - 1], 0
            while a + n < len(t) and b + n < len(t) and t[a + n] == t[b + n]:
                n += 1
            assert lcp[a] == n


def test_near_copies_are_sorted_in_few_steps(monkeypatch):
    r = np.random.default_rng(1)
    texts = r.integers(2, 40, (60, 500))
    copies = np.repeat(texts, 5, 0)
    copies[np.arange(len(copies)), r.integers(0, 500, len(copies))] = 41  # each is edited in one place
    t = np.append(np.hstack([copies, np.ones((len(copies), 1), int)]).ravel(), 0)
    steps, put = [], suffixes._scatter
    monkeypatch.setattr(suffixes, "_scatter", lambda *a: (steps.append(1), put(*a)))
    assert (suffixes.suffix_array(t) == doubled(t)).all()
    assert len(steps) < 1000


# --- 2 -------------------------------------------------------------------------------------------------------------

URLS = [
    "http://a.example.org/es/1", "https://EXAMPLE.org/en/12?x=/es/", "http://example.org/en/2", "http://b.com/fr/1", "http://b.com/de/1#y", "http://b.com", "x://org/", "http://org", "no scheme", None, "",
    "http://spam-farm.example.net/en/1", "http://www.spam-farm.example.net/x?http://a.org/", "http://notspam-farm.example.net/", "a://b://c/d", "http://xexample.org/es/1", "http://q.com/DE/", "http://h.com?u=/de/",
]


def verdict(url: str | None) -> tuple:
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        m = re.match(r"[^/?#]*", rest)
        host, path = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in m[0]), re.match(r"[^?#]*", rest[m.end() :])[0]
    fits = [(len(h + p), h + p, v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    listed = any(host == x or host.endswith("." + x) for x in urls.LISTED)
    best = max(fits) if fits else (0, None, "block" if listed else "allow")
    return host, path, best[1], best[2]


def test_url_filter(spark):
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(URLS)], "page_id long, url string, host string, rule string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge(pages).collect()}
    assert got == {i: verdict(u) for i, u in enumerate(URLS)}
    assert urls.judge(pages.limit(0)).count() == 0


def test_cascade_is_exact_and_has_levels(spark, monkeypatch):
    monkeypatch.setattr(urls, "BITS_A_KEY", 2)  # many false positives
    universe = spark.createDataFrame([(f"h{i}.net",) for i in range(3000)], "key string")
    listed = spark.createDataFrame([(f"h{i}.net",) for i in range(0, 3000, 7)] + [("elsewhere.org",)], "key string")
    c = urls.build(universe, listed)
    assert len(c.levels) > 2
    got = {r["key"] for r in universe.filter(c.holds(F.col("key"))).collect()}
    assert got == {f"h{i}.net" for i in range(0, 3000, 7)}


def test_too_large_a_cascade_joins(spark, monkeypatch):
    monkeypatch.setattr(urls, "MAX_BITS", 1)
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(URLS)], "page_id long, url string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge(pages).collect()}
    assert got == {i: verdict(u) for i, u in enumerate(URLS)}


# --- 3 -------------------------------------------------------------------------------------------------------------

@pytest.mark.parametrize("block", [64, 2048])
def test_vectors(spark, block, monkeypatch):
    monkeypatch.setattr(vectors, "LIST_ROWS", 40)
    monkeypatch.setattr(vectors, "BLOCK", block)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 16)).astype(np.float32)
    for k in range(0, 200, 5):
        x[k + 1] = x[k] + rng.normal(size=16) * 0.12
        x[k + 2] = x[k + 1] + rng.normal(size=16) * 0.12
    x[300:310] = x[299]
    rows: list = [(int(i), [float(v) for v in e]) for i, e in enumerate(x)]
    odd = [None, [], [0.0] * 16, [float("nan")] + [1.0] * 15, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15, [1.0] * 3]
    rows += [(1000 + k, e) for k, e in enumerate(odd[:-1])] + [rows[7], (700, odd[-1]), (701, [2.0, 2.0, 2.0]), (702, [-1.0, 1.0, 1.0])]
    rows += [(710 + k, [float(v) for v in e[:8]]) for k, e in enumerate(x[:30])] + [(750, rows[0][1][:8])]  # other lengths
    odd = odd[:-1]
    keep = [i for i, (v, e) in enumerate(rows) if v < 1000]
    unit = lambda i: np.array(rows[i][1], float) / np.linalg.norm(np.array(rows[i][1], float))
    near = np.array([[a != b and len(rows[a][1]) == len(rows[b][1]) and unit(a) @ unit(b) >= 0.95 for b in keep] for a in keep])
    comp = np.array([rows[i][0] for i in keep])
    for _ in range(40):
        comp = np.minimum(comp, np.where(near, comp[None], 10**9).min(1))
    want = Counter((rows[i][0], int(near[k].sum()), int(comp[k])) for k, i in enumerate(keep)) + Counter((1000 + k, 0, 1000 + k) for k in range(len(odd)))
    df = spark.createDataFrame([(v, e, 1, 2) for v, e in rows], "vec_id long, embedding array<float>, `list` int, n int")
    out = vectors.near_duplicates(df).collect()
    got = Counter((r["vec_id"], r["n_links"], r["component_id"]) for r in out)
    linked = sum(n * c for (_, n, _), c in got.items())
    assert linked >= 0.9 * near.sum() and got == want
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in out)
    assert vectors.near_duplicates(df.limit(0)).count() == 0


def test_vectors_of_doubles_that_overflow(spark):
    rows = [(1, [1e200, 1e200]), (2, [1.0, 1.0]), (3, [1e-200, 1e-200]), (4, [1e200, -1e200]), (None, [1.0, 1.0]), (5, [4.0])]
    out = vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert Counter((r["vec_id"], r["n_links"], r["component_id"]) for r in out) == Counter([(1, 3, 1), (2, 3, 1), (3, 3, 1), (4, 0, 4), (None, 3, 1), (5, 0, 5)])


def test_vectors_recall_with_many_lists(spark, monkeypatch):
    """1,200 lists, fewer probes than lists within reach, links planted at cosines of .95 to .96: recall is 0.9 at least."""
    monkeypatch.setattr(vectors, "LIST_ROWS", 5)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(6000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for k in range(0, 3000, 2):
        c, way = rng.uniform(0.9501, 0.96), rng.normal(size=32)
        way -= (way @ x[k]) * x[k]
        x[k + 1] = c * x[k] + np.sqrt(1 - c * c) * way / np.linalg.norm(way)
    lists = []
    real = vectors.train
    monkeypatch.setattr(vectors, "train", lambda y, k: lists.append(k) or real(y, k))
    df = spark.createDataFrame([(i, [float(v) for v in e]) for i, e in enumerate(x)], "vec_id long, embedding array<double>")
    got = sum(r["n_links"] for r in vectors.near_duplicates(df).collect())
    near = x @ x.T >= 0.95
    want = int(near.sum()) - 6000
    assert lists[0] >= 1000 and vectors.probes(lists[0]) < lists[0] / 20 and want >= 3000
    assert 0.9 * want <= got <= want


# --- 4 -------------------------------------------------------------------------------------------------------------

def test_toxicity_on_held_out_documents(spark):
    r = random.Random(9)
    bad = ["idiotx", "scumx", "morony"]
    rows, labels = [], []
    for i in range(900):
        toxic = i % 4 == 0
        w = [f"w{r.randrange(400)}" for _ in range(40)]
        if toxic:
            for _ in range(2):
                w[r.randrange(40)] = r.choice(bad)
        rows.append((i, " ".join(w), i % 2))
        labels.append((i, int(toxic)))
    rows += [(2000, None, 0), (2001, "", 0), (None, "w1", 0)]
    labels += [(3000, 1), (2001, None), (None, 1)]
    out = toxicity.toxicity(spark.createDataFrame(rows, "doc_id long, text string, score int"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = {x["doc_id"]: x for x in out.collect()}
    assert len(got) == 903 and all(0 <= x["score"] <= 1 and x["predicted"] == int(x["score"] >= 0.7) for x in got.values())
    test = [i for i in range(900) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert [i for i in range(900) if got[i]["held_out"]] == test
    hit = [got[i]["predicted"] for i in test if i % 4 == 0]
    assert np.mean(hit) > 0.9 and not any(got[i]["predicted"] for i in test if i % 4)
    none = toxicity.toxicity(spark.createDataFrame(rows[:3], "doc_id long, text string, score int"), spark.createDataFrame([], "doc_id long, toxic int"))
    assert {x["score"] for x in none.collect()} == {0.5}


# --- 5 -------------------------------------------------------------------------------------------------------------

def test_packing_round_trip(docs, nothing, monkeypatch):
    import tokenizers

    monkeypatch.setattr(packing, "_RARE", re.compile("changed"))  # so that both tokenizers are used
    t = tokenizers.Tokenizer.from_file(packing.default_tokens()[0])
    t.encode_special_tokens = True
    want: Counter = Counter()
    for i, text, *_ in ROWS:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        at = packing.cut(len(ids))
        want.update((i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(at, at[1:])))
    out = packing.best_fit_packing(docs).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out) == want
    check_sequences(out)
    assert packing.best_fit_packing(nothing).count() == 0


def check_sequences(rows) -> int:
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for x in by.values():
        at = 0
        for offset, length in sorted(x):
            assert offset == at
            at += length
        assert at <= 2048
    return len(by)


def test_repacking_over_partitions(spark):
    r = random.Random(3)
    lengths = [r.choice([r.randint(1, 2048), r.randint(1, 600), 1025, 700]) for _ in range(4000)]
    df = spark.createDataFrame(list(enumerate(lengths)), "doc_id long, length long")
    rows = packing.pack(df, partition_rows=150).collect()
    assert sorted((x["doc_id"], x["length"]) for x in rows) == list(enumerate(lengths))
    n, alone, bound = check_sequences(rows), len(packing.best_fit_decreasing(np.array(lengths))), packing.lower_bound(np.array(lengths))
    assert bound <= alone and n <= alone * 1.01 + 1


def test_lower_bounds():
    assert packing.lower_bound(np.array([1025] * 7)) == 7
    assert packing.lower_bound(np.array([700] * 6)) == 3
    assert packing.lower_bound(np.array([1024, 1024, 1])) == 2
    assert packing.lower_bound(np.array([], int)) == 0
    r = np.random.default_rng(1)
    for _ in range(50):
        x = r.integers(1, 2049, r.integers(1, 60))
        assert packing.lower_bound(x) <= len(packing.best_fit_decreasing(x))


# --- 6 -------------------------------------------------------------------------------------------------------------

def test_license_scan(docs, nothing):
    want: Counter = Counter()
    for i, text, *_ in ROWS:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        at, labels = [], set()
        for phrase, label in licenses.BASE.items():
            p = phrase.split()
            hits = [k for k in range(len(w) - len(p) + 1) if w[k : k + len(p)] == p]
            at += hits
            labels |= {label} if hits else set()
        want[(i, len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels)))] += 1
    out = licenses.scan(docs).collect()
    assert Counter((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in out) == want
    assert all(set(r["base_labels"].split(",")) - {""} <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1 for r in out)
    gpl = [r for r in out if r["labels"] == "gpl-3"]
    assert len(gpl) == 1 and gpl[0]["spans"][0]["from_word"] == 0 and gpl[0]["spans"][0]["to_word"] == gpl[0]["n_words"]
    assert licenses.scan(nothing).count() == 0


def test_license_with_a_word_put_in(spark):
    t = licenses.parsed(licenses.TEMPLATES["gpl-3"][1])[0].split()
    broken = " ".join([*t[:12], "really", *t[12:]])
    half = " ".join(t[: len(t) // 2])
    out = {r["doc_id"]: r["labels"] for r in licenses.scan(spark.createDataFrame([(1, broken), (2, half)], "doc_id long, text string")).collect()}
    assert out == {1: "gpl-3", 2: ""}


NOTICES = {
    "this work is licensed under a creative commons attribution noncommercial 4 0 international license": "cc-by-nc",
    "This work is licensed under a Creative Commons Attribution 4.0 International License.": "cc-by",
    "this work is licensed under a creative commons attribution sharealike 4 0 international license": "cc-by-sa",
    "this work is licensed under a creative commons attribution noncommercial sharealike 3 0 unported license": "cc-by-nc-sa",
    "this work is licensed under the gnu general public license version 2": "gpl-2",
    "this work is licensed under the gnu general public license version 3": "gpl-3",
    "this work is licensed under the gnu general public license version 4": "",
    "this work is licensed under the gnu lesser general public license version 3": "lgpl-3",
    "it is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version": "agpl-3",
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.": "isc",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions": "mit",
    "licensed under the apache license version 2 0": "apache-2",
    "licensed under the gnu license version 2": "",
    "licensed under cc by sa 4.0": "cc-by-sa",
    "licensed under cc by 4.0": "cc-by",
    "licensed under cc by 5.0": "",
    "we have not licensed under any of the terms of the license version 2 of the apache": "",
}


def brute_labels(text: str) -> set[str]:
    """By the definition, with lists: segments of diagonals, merged, verified, and the best of those that overlap."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    spans, number, g = [], 0, licenses.GRAM
    for label, all_ in licenses.TEMPLATES.items():
        for t in all_:
            plain, core = licenses.parsed(t)
            own = plain.split()
            grams = [tuple(own[i : i + g]) for i in range(len(own) - g + 1)]
            once = {x: i for i, x in enumerate(grams) if grams.count(x) == 1}
            core = {i for i in core if grams[i] in once}
            lines = defaultdict(list)
            for p in range(len(words) - g + 1):
                if tuple(words[p : p + g]) in once:
                    lines[p - once[tuple(words[p : p + g])]].append(p)
            segments = []
            for d, ps in lines.items():
                cut = [0, *(i for i in range(1, len(ps)) if ps[i] - ps[i - 1] > licenses.GAP), len(ps)]
                segments += [(ps[a], ps[b - 1], d, ps[a:b]) for a, b in zip(cut, cut[1:]) if b - a > 1 or len(own) <= g + 1]
            groups: list[list] = []
            for x in sorted(segments):
                y = groups[-1][-1] if groups else None
                if y and x[0] - y[1] <= licenses.GAP + g and abs(x[2] - y[2]) <= licenses.NEIGHBOUR and x[0] - x[2] > y[0] - y[2]:
                    groups[-1].append(x)
                else:
                    groups.append([x])
            for group in groups:
                at = {p - d for _, _, d, ps in group for p in ps}
                lo, hi, n = min(x[0] for x in group), max(x[1] for x in group) + g, len({a + j for a in at for j in range(g)})
                if n >= licenses.COVER * len(own) and hi - lo - n <= len(own) * (1 - licenses.COVER) and core <= at:
                    spans.append((n, n / len(own), -number, label, lo, hi))
            number += 1
    return {x[3] for x in spans if not any(y[4] < x[5] and x[4] < y[5] and y[:3] > x[:3] for y in spans)}


def test_license_labels_are_brute_force(spark, docs):
    r = random.Random(12)
    stray = "under the terms of the license you may not use this copy of the software version 2 0 of the license is hereby".split()
    texts = list(NOTICES)
    texts += [" ".join(r.choices(stray, k=300)) + " " + t + " " + " ".join(r.choices(stray, k=300)) for t in NOTICES]
    for t in [licenses.parsed(x)[0] for all_ in licenses.TEMPLATES.values() for x in all_]:
        w = t.split()
        texts += [t, " ".join(w[: len(w) * 2 // 3]), " ".join(x for x in w if r.random() > 0.1), " ".join(y for x in w for y in ([x, "word"] if r.random() < 0.1 else [x]))]
    texts += [" ".join(r.sample(texts, 6)) for _ in range(40)] + ["", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {x["doc_id"]: x for x in licenses.scan(df).collect()}
    for i, t in enumerate(texts):
        want = brute_labels(t or "") | (set(out[i]["base_labels"].split(",")) - {""})
        assert out[i]["labels"] == ",".join(sorted(want)), t
    assert [out[i]["labels"] for i in range(len(NOTICES))] == list(NOTICES.values())
    assert all(set(NOTICES[t].split(",")) - {""} <= set(out[len(NOTICES) + i]["labels"].split(",")) for i, t in enumerate(NOTICES))


# --- 7 -------------------------------------------------------------------------------------------------------------

def test_sharding(spark, docs, nothing):
    out = sharding.shard(docs, 5).collect()
    enc = lambda t: (t or "").encode()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in out) == Counter((i, len(enc(t)) + 16, zlib.crc32(enc(t))) for i, t, *_ in ROWS)
    by = defaultdict(list)
    for r in out:
        by[r["shard"]].append(r["slot"])
    assert set(by) <= set(range(5)) and all(sorted(s) == list(range(len(s))) for s in by.values())
    assert sharding.shard(nothing, 5).count() == 0
    many = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("hot text")).otherwise(F.repeat(F.lit("ab"), (F.col("id") % 50).cast("int"))).alias("text"))
    sizes = [r["b"] for r in sharding.shard(many, 40).groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert len(sizes) == 40 and max(sizes) < 1.02 * min(sizes)


# --- 8 -------------------------------------------------------------------------------------------------------------

def raked(cells: dict, goals: list[dict]) -> dict:
    """Factors by the definition, one cell after another."""
    total = sum(cells.values())
    w = {k: m / total for k, m in cells.items() if m > 0}
    for _ in range(200):
        for d, goal in enumerate(goals):
            have: dict = defaultdict(float)
            for k, x in w.items():
                have[k[d]] += x
            w = {k: x * goal[k[d]] / have[k[d]] for k, x in w.items()}
    return {k: w[k] * total / m if m > 0 else 0.0 for k, m in cells.items()}


def test_raking_is_brute_force_and_meets_every_marginal():
    r = random.Random(1)
    cells = {(s, k, t): float(r.randint(0, 900)) for s in "abc" for k in "xy" for t in "pqr" if r.random() < 0.9}
    goals = mixing.marginals(cells, {"source": {"a": 0.5, "gone": 0.2}, "lang": {"x": 0.3, "y": 0.7}})
    assert goals[0]["a"] == pytest.approx(0.5) and "gone" not in goals[0] and goals[1] == {"x": pytest.approx(0.3), "y": pytest.approx(0.7)}
    f, want = mixing.rake(cells, goals), raked(cells, goals)
    assert all(f[k] == pytest.approx(want[k], abs=1e-4) for k in cells)
    total = sum(cells.values())
    for d, goal in enumerate(goals):
        have = defaultdict(float)
        for k, m in cells.items():
            have[k[d]] += f[k] * m / total
        assert all(abs(have[v] - g) < 1e-4 for v, g in goal.items())


@pytest.mark.parametrize("targets", [None, {"lang": {"en": 0.5, "fr": 0.4}, "source": {"a": 0.6}}])
def test_mixing(docs, nothing, targets):
    """Chances are those of raked cells, on the driver and as DataFrames; the draw is as large as they say."""
    out = mixing.weigh(docs, targets).collect()
    assert Counter((r["doc_id"], r["source"], r["lang"], r["tokens"]) for r in out) == Counter((i, s or "", x or "", len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for i, t, x, s, *_ in ROWS)
    cells: dict = defaultdict(float)
    for r in out:
        cells[r["source"], r["lang"], r["topic"]] += r["tokens"]
    want = raked(cells, mixing.marginals(cells, targets))
    top = max(want[k] for k in cells if cells[k] >= mixing.LEAST_CELL * sum(cells.values()))
    for r in out:
        assert r["chance"] == pytest.approx(min(1.0, want[r["source"], r["lang"], r["topic"]] / top), abs=1e-3)
    frames = {(r["source"], r["lang"], r["topic"]): r["chance"] for r in mixing.weigh(docs, targets, 0).collect()}
    assert all(r["chance"] == pytest.approx(frames[r["source"], r["lang"], r["topic"]], abs=1e-6) for r in out)
    kept = mixing.sample(docs, targets)
    assert kept.columns == docs.columns and Counter(r["doc_id"] for r in kept.collect()) == Counter(r["doc_id"] for r in out if r["drawn"])
    assert mixing.weigh(nothing, targets).count() == 0 and mixing.sample(nothing).count() == 0


def test_mixing_draws_by_chance_and_reports(spark):
    """A tiny cell of a source and a language of its own doesn't thin out the others."""
    r = random.Random(5)
    words = [["the", "river", "stone", "walks"], ["one", "house", "green", "sings"]]
    rows = [(i, " ".join(r.choices(r.choice(words), k=50)), x, "big" if i % 3 else "small") for i in range(4000) for x in ["en" if i % 4 else "fr"]]
    rows += [(9000, "river stone", "zz", "lone"), (None, None, None, None), (9001, "", "en", "big")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    targets = {"lang": {"en": 0.5}}
    out = mixing.weigh(df, targets).cache()
    share = {(x["dimension"], x["value"]): x for x in mixing.reached(out, targets).collect()}
    assert share["lang", "en"]["target"] == pytest.approx(0.5) and share["lang", "en"]["expected"] == pytest.approx(0.5, abs=0.01)
    assert share["lang", "en"]["drawn"] == pytest.approx(0.5, abs=0.04)
    french = [x["drawn"] for x in out.collect() if x["lang"] == "fr"]
    assert np.mean(french) > 0.6 and [x["drawn"] for x in out.collect() if x["doc_id"] == 9000] == [True]


def test_topics_part_the_corpus(spark):
    r = random.Random(6)
    sets = [[f"{c}{k}" for k in range(30)] for c in "abcd"]
    df = spark.createDataFrame([(i, " ".join(r.choices(sets[i % 4], k=60)), "en", "s") for i in range(400)], "doc_id long, text string, lang string, source string")
    topic = {x["doc_id"]: x["topic"] for x in mixing.weigh(df).collect()}
    for t in set(topic.values()):
        assert len({i % 4 for i in topic if topic[i] == t}) == 1


# --- 9 -------------------------------------------------------------------------------------------------------------

def facts(text: str | None) -> tuple:
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = Counter(zip(w, w[1:], w[2:]))
    hit = {k + j for k, g in enumerate(zip(w, w[1:], w[2:])) if n[g] > 1 for j in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit)


def test_quality_facts(docs, nothing):
    out = quality.score(docs).collect()
    want: Counter = Counter()
    for i, text, *_ in ROWS:
        f = facts(text)
        want[(i, *f, f[0] < 50 or 100 * f[4] > 50 * f[0])] += 1
    assert Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in out) == want
    assert not any(r["kept"] and r["base_failed"] for r in out)
    kept = quality.keep(docs)
    assert kept.columns == docs.columns and Counter(r["doc_id"] for r in kept.collect()) == Counter(r["doc_id"] for r in out if r["kept"])
    assert quality.score(nothing).count() == 0 and quality.keep(nothing).count() == 0


def test_gibberish_is_rejected_and_prose_kept(spark):
    r = random.Random(2)
    prose = lambda: " ".join(r.choice(["the", "house", "green", "walks", "under", "stone", "river", "and", "of", "morning"]) for _ in range(90 + r.randrange(90)))
    rows = [(i, prose(), "en") for i in range(300)] + [(900 + i, " ".join("".join(r.choice("qxzjkvwy0917") for _ in range(7)) for _ in range(90)), "en") for i in range(6)]
    out = {x["doc_id"]: x["kept"] for x in quality.score(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    # words are drawn at random, so many windows of three repeat only in long texts; those are a base rule of their own
    assert not any(out[900 + i] for i in range(6)) and sum(out[i] for i in range(300)) > 250


# --- 10 ------------------------------------------------------------------------------------------------------------

def grouped(rows: list[tuple], k: int) -> Counter:
    sets = []
    for i, text, *_ in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode())
        sets.append(set(zip(*[w[j:] for j in range(k)])) if len(w) >= k else {tuple(w)} if w else set())
    comp = list(range(len(rows)))
    find = lambda x: x if comp[x] == x else find(comp[x])
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                comp[find(a)] = find(b)
    low: dict = {}
    for x, (i, *_) in enumerate(rows):
        if i is not None:
            low[find(x)] = min(low.get(find(x), 1 << 60), i)
    return Counter((i, len(sets[x]), None if i is None else (low[find(x)] if sets[x] else i)) for x, (i, *_) in enumerate(rows))


def one_of_each(rows: list[tuple], k: int) -> list[tuple]:
    """Of each group the row of the smallest doc_id, null last; all rows without words."""
    numbered = [(x, *r[1:]) for x, r in enumerate(rows)]
    group = {x: g for x, _, g in grouped(numbered, k).elements()}
    order = sorted(range(len(rows)), key=lambda x: (rows[x][0] is None, rows[x][0] or 0, x))
    first: dict = {}
    for x in order:
        first.setdefault(group[x], x)
    return [(rows[x][0], rows[x][1] or "") for x in first.values()]


def test_minhash_keeps_by_row(spark, tmp_path):
    """A doc_id with two texts keeps the only copy of each; whole copies of a row leave one; the same for rows of files."""
    a, b, c = ("one two three four five six seven eight", "red green blue white black grey pink", "a b c d e f g")
    rows = [(1, a), (2, a), (2, b), (3, c), (3, c), (3, c), (None, c), (None, "x y z"), (4, None), (4, ""), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    df.write.parquet(str(tmp_path / "docs.parquet"))
    for docs in (df, spark.read.parquet(str(tmp_path / "docs.parquet"))):
        got = Counter((r["doc_id"], r["text"]) for r in minhash.keep(docs).collect())
        assert got == Counter([(1, a), (2, b), (3, c), (None, "x y z"), (4, None), (4, ""), (None, None)])


def test_minhash(docs, nothing):
    out = minhash.classes(docs).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in out) == grouped(ROWS, 4)
    assert all(r["kept"] == (r["doc_id"] is None or r["doc_id"] == r["component_id"]) for r in out)
    kept = minhash.keep(docs, 4)
    assert kept.columns == docs.columns and sorted((r["doc_id"], r["text"] or "") for r in kept.collect()) == sorted(one_of_each(ROWS, 4))
    assert minhash.classes(nothing).count() == 0 and minhash.keep(nothing).count() == 0


def test_minhash_chains_and_edits(spark):
    r = random.Random(5)
    base = [f"w{r.randrange(9999)}" for _ in range(140)]
    rows: list[tuple] = []
    for i in range(150):  # independent edits of one text, about as far from it as a link allows
        w = base[:]
        for _ in range(r.randint(1, 7)):
            w[r.randrange(len(w))] = f"e{r.randrange(99999)}"
        rows.append((i, " ".join(w)))
    for i in range(20):  # a chain
        w = [f"c{k}" for k in range(i * 4, i * 4 + 100)]
        rows.append((500 + i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter((x["doc_id"], x["n_shingles"], x["component_id"]) for x in minhash.classes(df).collect()) == grouped(rows, 4)


def test_components(spark):
    r = random.Random(8)
    edges = [(k, k + 1) for k in range(40)] + [(100 + r.randrange(60), 100 + r.randrange(60)) for _ in range(50)] + [(300, k) for k in range(301, 340)]
    comp = {x: x for e in edges for x in e}
    for _ in range(60):
        for a, b in edges:
            comp[a] = comp[b] = min(comp[a], comp[b])
    got = {x["node"]: x["root"] for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: v for k, v in comp.items() if any(k in e and e[0] != e[1] for e in edges)}


def test_tops_of_a_forest(spark):
    r = random.Random(9)
    parent = {k: r.randrange(k) for k in range(30, 300)} | {k: k - 1 for k in range(301, 340)}

    def top(k):
        return top(parent[k]) if k in parent else k

    got = {x["node"]: x["root"] for x in tops(spark.createDataFrame(list(parent.items()), "a long, b long")).collect()}
    assert got == {k: top(k) for k in parent}
    assert tops(spark.createDataFrame([], "a long, b long")).count() == 0 == components(spark.createDataFrame([], "a long, b long")).count()


def test_stored_tables_can_be_forgotten(spark):
    from fathomline.llm import common

    common.forget(spark)
    df = common.stored(spark.range(5), "x")
    assert df.count() == 5 and common.forget(spark) == 1 and common.forget(spark) == 0
