"""Operators 11 to 13 against brute force, and their defined results on edge cases."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathomline.llm import fingerprints, negatives, phrases
from fathomline.llm.common import Rolling, texts_of

SCHEMA = "doc_id long, text string, lang string, source string, part int, tail boolean, `key` string, n int, a int"


def corpus() -> list[tuple]:
    r = random.Random(8)
    vocabulary = [f"{a}{b}" for a in ("an", "ER", "th", "on", "é", "re") for b in ("in", "t", "ou", "")]
    prose = lambda n: "".join(r.choice(vocabulary) + r.choice([" ", " ", " ", " ", "  ", "\t", ". ", ",", "\n", "! "]) for _ in range(n))
    texts: list[str | None] = [prose(r.randint(1, 300)) for _ in range(40)]
    texts += [texts[0], texts[0], texts[1], None, "", " ", ".;\n", "one", "a", "é", "aa aa aa aa aa aa aa aa aa aa aa aa aa aa aa", "to be or not " * 30, "x" * 3000, prose(6000)]
    rows = [(i * 3, t, r.choice(["en", "en", "fr", "", None, "und"]), "s", 1, True, "clash", 2, 3) for i, t in enumerate(texts)]
    return rows + [rows[5], rows[5], (None, texts[6], "en", "s", 0, False, "", 0, 0), (rows[7][0], "another text of a known id", None, None, None, None, None, None, None), (-4, "below\nnought", "fr", "", 0, True, "", 0, 0)]


ROWS = corpus()


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("mining") / "documents.parquet")
    spark.createDataFrame(ROWS, SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


# --- 11 ------------------------------------------------------------------------------------------------------------

LOWER = {c: c + 32 for c in range(65, 91)}


def mined(rows, least: int, longest: int, share: int, top: int) -> list[tuple]:
    f: dict[str, Counter] = defaultdict(Counter)
    for row in rows:
        for piece in re.split("[.,;:!?\x0a-\x0d]", (row[1] or "").translate(LOWER)):
            w = re.findall("[^ \t]+", piece)
            for m in range(1, longest + 1):
                f[row[2] if row[2] is not None else "und"].update(tuple(w[k : k + m]) for k in range(len(w) - m + 1))
    out = []
    for lang, count in f.items():
        n = sum(c for p, c in count.items() if len(p) == 1)
        likely = {p: a for p, a in count.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in likely.items():
            score, k = min((1000000 * a * a // (count[p[:k]] * count[p[k:]]), k) for k in range(1, len(p)))
            if not any(len(q) > len(p) and 100 * b >= share * a and any(q[s : s + len(p)] == p for s in range(len(q))) for q, b in likely.items()):
                rows.append((-score, -a, " ".join(p).encode(), count[p[:k]], count[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, l, r, n, -s) for i, (s, a, p, l, r) in enumerate(sorted(rows)[:top])]
    return out


@pytest.mark.parametrize("least,longest,top,dense,size", [(10, 3, 2000, 32, 4 << 20), (3, 3, 7, 32, 2000), (4, 5, 2000, 4, 3000), (2, 2, 50, 10**9, 500), (10, 3, 2000, 1, 4 << 20)])
def test_phrases_equal_brute_force(docs, monkeypatch, least, longest, top, dense, size):
    monkeypatch.setattr(phrases, "SHARD_BYTES", size)
    monkeypatch.setattr(phrases, "DENSE", dense)
    out = [tuple(r) for r in phrases.collocations(docs, least, longest, 50, top).collect()]
    assert Counter(out) == Counter(mined(ROWS, least, longest, 50, top)) and len(out) > 3


def test_phrases_with_shared_cells_and_hashes(docs, monkeypatch):
    monkeypatch.setattr(phrases, "CELL_BITS", 4)  # hardly any pair is cut before it is counted
    assert Counter(tuple(r) for r in phrases.collocations(docs, 10, 3).collect()) == Counter(mined(ROWS, 10, 3, 50, 2000))


def test_phrases_of_nothing(nothing, docs):
    assert phrases.collocations(nothing).count() == 0
    assert phrases.collocations(docs.filter("text is null or trim(text) = ''")).count() == 0


def test_scores_past_64_bits(spark):
    """1000000 * a * a and l * r of counts near 10**12 keep every digit."""
    a, l, r = 987654321987, 999999999989, 987654321999
    got = spark.range(1).select(F.expr(f"(1000000BD * CAST({a}L AS DECIMAL(15, 0)) * CAST({a}L AS DECIMAL(15, 0))) div (CAST({l}L AS DECIMAL(15, 0)) * CAST({r}L AS DECIMAL(15, 0)))")).first()[0]
    assert got == 1000000 * a * a // (l * r)


# --- 12 ------------------------------------------------------------------------------------------------------------

def pieces(text: str) -> Counter:
    """The same paragraphs as the operator's, with plain words and the operator's hash of a word."""
    roll, out = Rolling(1200), Counter()
    for line in text.split("\n"):
        open_ = []
        for m in re.finditer("[^ \t\x0b-\x0d]+", line):
            open_.append((m.start(), m.end()))
            raw = np.frombuffer(m.group().encode(), np.uint8)
            if fingerprints.mix(roll.ranges(roll.prefix(raw), np.array([0]), np.array([len(raw)])))[0] & fingerprints.CUT == 0:
                out[line[open_[0][0] : open_[-1][1]]] += 1
                open_ = []
        if open_:
            out[line[open_[0][0] : open_[-1][1]]] += 1
    return out


def alike(a: str, b: str) -> float:
    x, y = pieces(a), pieces(b)
    both = sum((x | y).values())
    return sum((x & y).values()) / both if both else 1.0


def test_fingerprints_equal_brute_force(docs):
    got = fingerprints.edited(docs).collect()
    assert len(got) == len(ROWS)
    rows = sorted(ROWS, key=lambda r: (r[0] is None, -(r[0] or 0)))
    texts = [r[1] or "" for r in rows]
    once = Counter(r[0] for r in ROWS)
    by_id = {r["doc_id"]: r for r in got}
    compared = 0
    for k, (row, text) in enumerate(zip(rows, texts)):
        if once[row[0]] > 1 or once[rows[(k + 1) % len(rows)][0]] > 1:
            continue  # which of the repeated rows comes next depends on how they are stored
        half = len(text) // 2
        edited = text[: len(text) - half] + texts[(k + 1) % len(texts)][:half]
        r = by_id[row[0]]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert math.isclose(r["near_edited"], alike(text, edited), abs_tol=1e-12) and math.isclose(r["near_next"], alike(text, texts[(k + 1) % len(texts)]), abs_tol=1e-12)
        compared += 1
    assert compared > len(ROWS) - 15
    by_text, prints = defaultdict(set), {r["fingerprint"] for r in got}
    for r in got:
        if once[r["doc_id"]] == 1:
            by_text[next(x[1] for x in ROWS if x[0] == r["doc_id"]) or ""].add(r["fingerprint"])
    assert all(len(v) == 1 for v in by_text.values()) and len(prints) > len(by_text) - 4
    assert max(r["cells_next"] for r in got) > fingerprints.CELLS  # some took retries


def test_fingerprints_over_many_and_few_ranges(docs, spark, monkeypatch):
    want = Counter(tuple(r) for r in fingerprints.edited(docs.dropDuplicates(["doc_id"])).collect())
    monkeypatch.setattr(fingerprints, "STEP_CELLS", 100)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    for n in ("1", "23"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        try:
            assert Counter(tuple(r) for r in fingerprints.edited(docs.dropDuplicates(["doc_id"])).collect()) == want
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", before)


def test_differences_recover_the_digests(spark):
    r = random.Random(1)
    texts = [" ".join(f"w{r.randrange(500)}" for _ in range(n)) for n in (0, 3, 50, 4000, 4000)]
    rows = [(i, a, a[: len(a) // 3] + " new " + a[len(a) // 2 :] if i < 4 else texts[3]) for i, a in enumerate(texts)] + [(9, None, None), (10, "same", "same")]
    out = {x["id"]: x for x in fingerprints.differences(spark.createDataFrame(rows, "id int, old string, new string"), "id").collect()}
    roll = Rolling(1200)
    for i, a, b in rows:
        own = []
        for t in (a, b):
            raw, at = texts_of(fingerprints.pa.array([t], fingerprints.pa.string()))
            own.append(set(fingerprints.paragraphs(raw, at, roll)[1].view(np.int64).tolist()))
        assert set(out[i]["only_old"]) == own[0] - own[1] and set(out[i]["only_new"]) == own[1] - own[0]
        assert math.isclose(out[i]["likeness"], alike(a or "", b or ""), abs_tol=1e-12)
    made = fingerprints.fingerprint(spark.createDataFrame(rows, "id int, text string, new string")).collect()
    assert [x["id"] for x in made] == [x[0] for x in rows] and made[5]["n_paragraphs"] == 0 and made[5]["fingerprint"] == made[0]["fingerprint"]


def test_fingerprints_of_nothing_and_one(nothing, docs):
    assert fingerprints.edited(nothing).count() == 0
    one = fingerprints.edited(docs.filter("doc_id = 9")).collect()
    text = next(r[1] for r in ROWS if r[0] == 9)
    assert len(one) == 1 and one[0]["near_next"] == 1.0
    assert one[0]["edited_sha256"] == hashlib.sha256((text[: len(text) - len(text) // 2] + text[: len(text) // 2]).encode()).hexdigest()


# --- 13 ------------------------------------------------------------------------------------------------------------

def vectors(n: int = 900, dim: int = 24) -> list[tuple]:
    r = np.random.default_rng(5)
    centres = r.normal(size=(6, dim))
    rows = []
    for k in range(n):
        label = int(r.integers(6))
        x = centres[label] + r.normal(size=dim) * 0.5
        rows.append((k, (x / np.linalg.norm(x)).astype(np.float32).tolist(), label if r.random() < 0.9 else int(r.integers(6)), "clash", k, 0, 0))
    rows += [(n + k, rows[3][1], k % 6, "", 0, 0, 0) for k in range(60)]  # a hot vector
    rows += [(2000, None, 1, "", 0, 0, 0), (2050, rows[0][1], None, "", 0, 0, 0), (2100, [0.0] * dim, 2, "", 0, 0, 0), (2150, [None] + rows[1][1][1:], 1, "", 0, 0, 0), (2200, [math.nan] * dim, 1, "", 0, 0, 0), (2250, [math.inf] + [0.0] * (dim - 1), 1, "", 0, 0, 0)]
    rows += [(2300, [], 1, "", 0, 0, 0), (2301, [], 1, "", 0, 0, 0), (2302, [], 2, "", 0, 0, 0), (None, rows[4][1], rows[4][2], "", 0, 0, 0), (-50, rows[5][1], -3, "", 0, 0, 0), (2400, [1e30] * dim, 1, "", 0, 0, 0)]
    rows += [(3000 + k, r.normal(size=3).astype(np.float32).tolist(), k % 2, "", 0, 0, 0) for k in range(120)]
    return rows + [rows[50], rows[50], rows[61]]


def hard(rows) -> Counter:
    own = []
    for i, e, label, *_ in rows:
        if label is None or e is None or any(x is None or not math.isfinite(x) for x in e):
            continue
        q = [math.floor(256 * float(np.float32(x))) for x in e]
        if sum(x * x for x in q) < 2**62:
            own.append((i, math.fmod(label + 1, 10) if i is not None and i % 7 == 0 else label, q))
    out = Counter()
    last = lambda i: (i is None, i or 0)
    for k, (i, label, q) in enumerate(own):
        if i is None or i % 50:
            continue
        met = sorted(((-sum(x * y for x, y in zip(q, p)), last(j), lab == label) for m, (j, lab, p) in enumerate(own) if m != k and len(p) == len(q)), key=lambda x: x[:2])
        for score, j, _ in [x for x in met if x[2]][:5]:
            fit = [x for x in met if not x[2] and 50 * -score <= 100 * -x[0] <= 95 * -score][:3]
            out.update((i, None if j[0] else j[1], rank + 1, None if x[1][0] else x[1][1], -score, -x[0]) for rank, x in enumerate(fit))
    return out


@pytest.mark.parametrize("block,slice_,step", [(1024, 16384, 1024), (4, 100, 32), (1, 7, 5)])
def test_negatives_equal_brute_force(spark, tmp_path, monkeypatch, block, slice_, step):
    for name, value in (("BLOCK", block), ("SLICE", slice_), ("STEP", step)):
        monkeypatch.setattr(negatives, name, value)
    rows = vectors() if block > 1 else vectors()[:160] + vectors()[-20:]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, q string, place int, dim int, slice int").repartition(3).write.parquet(str(tmp_path / "e"))
    out = negatives.mine(negatives.relabelled(spark.read.parquet(str(tmp_path / "e"))))
    got = Counter(tuple(r) for r in out.collect())
    assert got == hard(rows) and len(got) > 20


def test_negatives_of_nothing(spark):
    assert negatives.mine(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_few_pairs_survive():
    """The rotation does its work: of clustered vectors most pairs are discarded before the last components."""
    r = np.random.default_rng(2)
    centres = r.normal(size=(20, 64)) * 60
    q = np.floor(centres[r.integers(20, size=2000)] + r.normal(size=(2000, 64)) * 8).astype(np.int64)
    turn = np.ascontiguousarray(np.linalg.eigh((q.T @ q).astype(float))[1][:, ::-1])
    a, x = negatives.Side(q[:50], turn), negatives.Side(q, turn)
    score = q[:50] @ q.T
    low = np.sort(score, axis=1)[:, -5].astype(float)
    partial = a.y[:, : a.ends[0]] @ x.y[:, : a.ends[0]].T
    i, j, s = negatives.survivors(a, x, np.ones(score.shape, bool), low, np.full(50, np.inf), partial)
    assert set(zip(i.tolist(), j.tolist())) == set(zip(*(k.tolist() for k in np.nonzero(score >= low[:, None])))) and (score[i, j] == s).all()
    assert (partial + np.outer(a.rest[:, 0], x.rest[:, 0]) >= low[:, None]).mean() < 0.3
