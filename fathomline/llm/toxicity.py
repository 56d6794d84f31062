"""Toxicity scores by FTRL-proximal logistic regression (operator 4).

Features are hashed words, pairs of neighbouring words and pairs with one word between (skip-grams), each counted once a
text. Per-coordinate rates and L1 make weights sparse; they fit in BUCKETS numbers whatever the corpus, and are broadcast.
The model is fitted on at most about TRAIN_ROWS labelled documents, drawn by a hash of doc_id.

Defined results: null and empty texts get the score of the bias alone; labels that are null or whose document is missing
are ignored; repeated rows are scored alike; an empty table gives an empty result; without labels every score is 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, U64, Rolling, mix, small_batches, steps, texts_of, trimmed, words_of
from .licenses import PARTS

BUCKETS = 1 << 18
TRAIN_ROWS, EPOCHS = 20_000, 10
ALPHA, BETA, L1, L2 = 2.0, 1.0, 3.0, 0.0
THRESHOLD = 0.7

_ROLL = Rolling(404)


def features(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all features of the texts, and the text of each; a feature may come more than once."""
    raw = LOWER[raw]
    start, end, text = words_of(raw, at, PARTS)
    w = mix(_ROLL.ranges(_ROLL.prefix(raw), start, end) + (end - start).astype(U64))
    found, owner = [w], [text]
    for gap in (1, 2):
        if len(w) > gap:
            same = text[gap:] == text[:-gap]
            found.append(mix(w[:-gap] * U64(2 * gap + 1) + mix(w[gap:] ^ U64(gap)))[same])
            owner.append(text[gap:][same])
    return (np.concatenate(found) % U64(BUCKETS)).astype(np.int32), np.concatenate(owner)


def _lists(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in rows:
        raw, at = texts_of(batch.column(0))
        for lo, hi in steps(at):
            bucket, text = features(raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo])
            key = np.unique(text.astype(np.int64) * BUCKETS + bucket)
            ends = np.searchsorted(key, np.arange(hi - lo + 1) * BUCKETS).astype(np.int32)
            yield pa.record_batch({"toxic": batch.column(1).slice(lo, hi - lo), "turn": batch.column(2).slice(lo, hi - lo), "features": pa.ListArray.from_arrays(pa.array(ends), pa.array((key % BUCKETS).astype(np.int32)))})


def ftrl(rows: list[tuple[np.ndarray, int]], epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """Weights of the buckets and the bias, from (buckets, label) in the order given."""
    z, n = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)

    def weights(at):
        s = z[at]
        return np.where(np.abs(s) <= L1, 0.0, -(s - np.sign(s) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    for _ in range(epochs):
        for at, y in rows:
            at = np.append(at, BUCKETS)
            w = weights(at)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA * w
            n[at] += g * g
    w = weights(np.arange(BUCKETS + 1))
    return w[:BUCKETS], float(w[BUCKETS])


def _fit(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = []
    for batch in rows:
        lists, label, turn = batch.column(2), batch.column(0).to_numpy(), batch.column(1).to_numpy()
        ends, flat = np.frombuffer(lists.buffers()[1], np.int32)[lists.offset : lists.offset + len(lists) + 1], lists.flatten().to_numpy()
        held += [(turn[i], flat[a - ends[0] : b - ends[0]].copy(), int(label[i])) for i, (a, b) in enumerate(zip(ends, ends[1:]))]
    if held:
        held.sort(key=lambda x: (x[0], x[2], len(x[1])))
        w, bias = ftrl([x[1:] for x in held])
        at = np.flatnonzero(w)
        yield pa.record_batch({"bucket": pa.array(np.append(at, BUCKETS).astype(np.int32)), "weight": pa.array(np.append(w[at], bias))})


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> tuple[np.ndarray, float]:
    """The model, from labelled rows that are not held out."""
    use = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).select("doc_id", F.when(F.col("toxic") == 1, 1).otherwise(0).alias("toxic"), F.xxhash64("doc_id").alias("turn"))
    share = min(1.0, train_rows / max(1, use.count()))
    use = use.filter(F.pmod("turn", F.lit(1 << 30)) < int(share * (1 << 30)))
    lists = docs.select("doc_id", "text").join(F.broadcast(use), "doc_id").select("text", "toxic", "turn").mapInArrow(trimmed(_lists), "toxic int, turn long, features array<int>")
    weights, bias = np.zeros(BUCKETS), 0.0
    for r in lists.repartition(1).mapInArrow(trimmed(_fit), "bucket int, weight double").collect():  # BUCKETS + 1 rows at most
        if r["bucket"] == BUCKETS:
            bias = r["weight"]
        else:
            weights[r["bucket"]] = r["weight"]
    return weights, bias


def score(docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """doc_id, score of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = shared.value
        for batch in rows:
            raw, at = texts_of(batch.column(1))
            total = np.full(batch.num_rows, bias)
            for lo, hi in steps(at):
                bucket, text = features(raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo])
                live = weights[bucket] != 0
                key = np.unique(text[live].astype(np.int64) * BUCKETS + bucket[live])
                np.add.at(total, lo + key // BUCKETS, weights[key % BUCKETS])
            yield pa.record_batch({"doc_id": batch.column(0), "score": pa.array(1 / (1 + np.exp(-np.clip(total, -35, 35))))})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(trimmed(run), f"doc_id {kind}, score double")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    small_batches(docs.sparkSession)
    scored = score(docs, fit(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
