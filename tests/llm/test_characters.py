"""The character model of op9 against brute force, and junk in other scripts than Latin."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathomline.llm import characters, quality

K = characters.ORDER


def told(texts):
    """Counts by length of gram: of occurrences for K, of different characters before it for shorter ones."""
    plain = lambda t: "".join("�" if c <= "\x01" else chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    top = Counter(("\x01" * K + p)[i + 1 : i + 1 + K] for p in map(plain, texts) for i in range(len(p)))
    counts = {K: top}
    for k in range(K - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    return counts


def fits(text):
    """Whether a text counts for the model."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return len(words) >= 50 and 20 * len(re.findall(r"[#*$%&|<>]", text)) <= len(words)


def brute(texts, folds):
    alphabet = len(told(texts)[1])
    whole = [told([t for t, g in zip(texts, folds) if g == f and fits(t)]) for f in (0, 1)]
    cut, after = [{}, {}], [{}, {}]
    for f in (0, 1):
        for k, c in whole[f].items():
            n = [sum(v == i for v in c.values()) for i in (1, 2, 3, 4)]
            y = n[0] / (n[0] + 2 * n[1]) if n[0] and n[1] else 0.5
            cut[f][k] = [0.0] + [min(i, max(0.1, i - (i + 1) * y * n[i] / n[i - 1])) if n[i - 1] else 0.5 * i for i in (1, 2, 3)]
            after[f][k] = defaultdict(list)
            for g, v in c.items():
                after[f][k][g[:-1]].append(v)

    def p(g, f):
        if not g:
            return 1 / alphabet
        k, seen = len(g), after[f][len(g)].get(g[:-1])
        if not seen:
            return p(g[1:], f)
        v, d = whole[f][k].get(g, 0), cut[f][k]
        return (v - d[min(v, 3)] + sum(d[min(x, 3)] for x in seen) * p(g[1:], f)) / sum(seen)

    out = []
    for text, f in zip(texts, folds):
        own = told([text])[K]
        out.append(-sum(n * math.log(p(g, 1 - f)) for g, n in own.items()) / sum(own.values()) if own else None)
    return out


def prose(r, parts, n):
    return " ".join("".join(r.choice(parts) for _ in range(r.randint(1, 4))) for _ in range(n))


@pytest.mark.parametrize("size, ways", [(1, 2), (16 << 20, 256)])
def test_log_perplexity_is_brute_force(spark, monkeypatch, size, ways):
    """In blocks of one row, with counts merged two at a time, and in large blocks."""
    monkeypatch.setattr(characters, "BLOCK_BYTES", size)
    monkeypatch.setattr(characters, "WAYS", ways)
    r = random.Random(ways)
    rows = [("ru", prose(r, ["на", "то", "ени", "ст", "ка"], 60)) for _ in range(7)] + [("en", prose(r, ["an", "er", "Th", "é", "7"], 60)) for _ in range(7)]
    rows += [("zh", " ".join(r.choice("天地玄黃宇宙洪荒日月") for _ in range(55))) for _ in range(4)] + [("en", None), ("en", ""), ("en", "\x00\x01a"), rows[0], rows[0], ("solo", "a")]
    rows += [("en", prose(r, ["an", "|"], 80)), ("en", prose(r, ["an", "zz"], 20)), ("ru", prose(r, ["на", "* "], 70))]
    df = spark.createDataFrame([(i, t, x) for i, (x, t) in enumerate(rows)], "doc_id long, text string, lang string").repartition(3).cache()
    folds = {x["i"]: x["fold"] for x in quality.held(df, ["doc_id"], 64).select(F.col("given.doc_id").alias("i"), "fold").collect()}
    got = {x["doc_id"]: x["log_perplexity"] for x in quality.score(df).collect()}
    for lang in {x for x, _ in rows}:
        ids = [i for i, (x, _) in enumerate(rows) if x == lang]
        for i, want in zip(ids, brute([rows[i][1] or "" for i in ids], [folds[i] for i in ids])):
            assert got[i] is None if want is None else abs(got[i] - want) < 0.5 / characters.STEPS + 1e-6, (lang, rows[i])


def test_the_model_grows_with_the_corpus(spark):
    """Each text has characters of its own, so the model has as many grams."""

    def size(n):
        texts = [(i, " ".join(chr(0x4E00 + 40 * i + j) for j in range(40)), "zh") for i in range(n)]
        asked = quality.held(spark.createDataFrame(texts, "doc_id long, text string, lang string"), ["doc_id"], 64)
        asked = asked.select("_block", "model", "fold", "text").mapInArrow(characters._requests(16), characters.ASKED_ROWS)
        return sum(len(characters.unboxed(bytes(x["data"]), *characters.HASHES)[0]) for x in characters.model_of(asked).collect())

    assert (size(50), size(500)) == (50 * 79, 500 * 79)


def test_blocks_that_several_tasks_read(spark, tmp_path, monkeypatch):
    """Row groups of one block in splits of their own give the same as the whole file in one."""
    r = random.Random(11)
    rows = [(i, prose(r, ["an", "er", "th", "é"], 60), "en") for i in range(400)]
    where = str(tmp_path / "docs.parquet")
    spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1).write.option("parquet.block.size", 8192).option("parquet.page.size", 1024).parquet(where)
    both = []
    for size in ("128m", "8k"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        both.append({x["doc_id"]: x["log_perplexity"] for x in quality.score(spark.read.parquet(where)).collect()})
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert spark.read.parquet(where).count() == 400 and both[0] == pytest.approx(both[1], abs=1e-6)


def test_discounts_leave_a_distribution():
    """Over all characters that may follow a context, a model's probabilities sum to one."""
    r = np.random.default_rng(0)
    n, below = r.integers(0, 6, 40), r.dirichlet(np.ones(40))
    p = characters.level(np.zeros(40, int), n, [int((n == i).sum()) for i in (1, 2, 3, 4)], below)
    assert abs(p.sum() - 1) < 1e-12 and (p > 0).all()


def test_parts_and_hashes_by_hand():
    grams = np.array([[1, 1, 97, 98, 99], [97, 97, 97, 98, 100]], np.uint32)
    assert len(set(characters.part_of(grams, 1 << 20).tolist())) == 1 and len(set(characters.hashed(grams).tolist())) == 2
    data = characters.boxed(grams, np.array([1, 3], np.uint8))
    assert [x.tolist() for x in characters.unboxed(data, *characters.ASKED)] == [grams.tolist(), [1, 3]]


def test_languages_without_prose_have_no_band(spark):
    r = random.Random(3)
    text = " ".join(f"w{r.randrange(999)} ***" for _ in range(60))
    assert [x["kept"] for x in quality.score(spark.createDataFrame([(1, text, None)], "doc_id long, text string, lang string")).collect()] == [True]


def test_symbols_among_prose_are_rejected(spark):
    r = random.Random(7)
    word = lambda: "".join(r.choice(["an", "er", "th", "on", "re"]) for _ in range(r.randint(1, 4)))
    rows = [(i, " ".join(word() + (" ###" if i % 4 == 0 else "") for _ in range(120)), "en") for i in range(200)]
    out = {x["doc_id"]: x["kept"] for x in quality.score(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert not any(out[i] for i in range(0, 200, 4)) and sum(out[i] for i in range(200) if i % 4) > 140


def test_junk_letters_outside_ascii_are_rejected(spark):
    r = random.Random(6)
    words = ["дом", "река", "камень", "утро", "зелёный", "идёт", "под", "и", "но", "город"]
    rows = [(i, " ".join(r.choice(words) for _ in range(110)), "ru") for i in range(200)]
    junk = [(900 + i, " ".join("".join(r.choice("щъыэюжфцхё") for _ in w) for w in rows[i][1].split()), "ru") for i in range(6)]
    out = {x["doc_id"]: x["kept"] for x in quality.score(spark.createDataFrame(rows + junk, "doc_id long, text string, lang string")).collect()}
    assert not any(out[900 + i] for i in range(6)) and sum(out[i] for i in range(200)) > 160


def test_distinct_with_more_characters_than_pack():
    r = np.random.default_rng(1)
    grams = r.integers(2, 9000, (20000, 3)).astype(np.uint32)
    one, back = characters.distinct(grams)
    assert (one[back] == grams).all() and [tuple(x) for x in one] == sorted({tuple(x) for x in grams.tolist()})
