"""Mixing sources to target weights by iterative proportional fitting (operator 8).

Tokens (words) are summed by source, language and topic; weights of these cells are raked until they meet the target share of
every source, language and topic. A document is then drawn with its cell's chance: the factor between its cell's raked
weight and its tokens, scaled so that the largest factor of a cell with LEAST_CELL of all tokens is 1. Smaller cells, whose factors
may be larger, are drawn whole, so that a tiny cell doesn't thin out all others; `reached` tells what that and a target that
can't be met leave open. The draw is a hash of doc_id, text and a seed, so it can be repeated.

Targets are shares by value for each dimension; values without a target share what the others leave, as their tokens to a power
(POWERS: 1 leaves the mix as it is, 0 makes all alike). A target of a value that no token has goes to the others.

Topics are those of the corpus: all its documents train TOPICS centres on hashed word counts, weighted by
how few documents have the word; every document belongs to the nearest centre, whole texts counted.

Cells are sums, as many as there are combinations: up to MAX_CELLS they are raked on the driver; beyond that,
by rounds of DataFrame sums, with the same result (the tests compare both).

Defined results: null source or lang is a value of its own (''); a null or empty text has no tokens, changes no sums, has the
topic '', and is drawn with the chance of its cell, 0 if that has no tokens; repeated rows are drawn alike; an empty table gives an
empty result; other columns are kept by `sample`, and a column named as one of this operator's own hinders nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, Rolling, mix, small_batches, steps, stored, texts_of, words_of
from .vectors import TURNS, nearest

MAX_CELLS, ROUNDS, TOLERANCE, LEAST_CELL = 100_000, 200, 1e-6, 1e-3
POWERS = {"source": 0.9, "lang": 0.95, "topic": 0.98}
SEED = 8
TOPICS, FEATURES = 8, 512
#: Shares by dimension and value; none are asked for by default.
Targets = dict[str, dict[str, float]]

_ROLL = Rolling(808)
_DIMS = list(POWERS)


def counts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Of each text, how many words fall on each feature, and its words."""
    raw, at = texts_of(column)
    n = len(at) - 1
    out, words = np.zeros((n, FEATURES), np.int64), np.zeros(n, np.int64)
    for lo, hi in steps(at):
        part, own = LOWER[raw[at[lo] : at[hi]]], at[lo : hi + 1] - at[lo]
        start, end, text = words_of(part, own)
        h = mix(_ROLL.ranges(_ROLL.prefix(part), start, end) + (end - start).astype(np.uint64)) % np.uint64(FEATURES)
        out[lo:hi] = np.bincount(text * FEATURES + h.astype(np.int64), minlength=(hi - lo) * FEATURES).reshape(hi - lo, FEATURES)
        words[lo:hi] = np.bincount(text, minlength=hi - lo)
    return out, words


def points(counts: np.ndarray, weight: np.ndarray) -> np.ndarray:
    x = np.log1p(counts) * weight
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def topics(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Weights of the features, and the centres of the topics: a few hundred KB, whatever the corpus.

    All documents with words count. Their points are stored as bytes; first centres are drawn among them with a chance by the squared distance from those before
    (by a hash of the counts), then TURNS rounds of means. Sums are of whole numbers, so they don't depend on how documents are dealt.
    """

    def count(rows):
        for batch in rows:
            c, words = counts_of(batch.column(0))
            c = np.minimum(c, 65535).astype("<u2")[words > 0]
            yield pa.record_batch({"counts": pa.array([r.tobytes() for r in c], pa.binary())})

    def summed(of):
        def run(rows):
            n, sums = np.zeros(TOPICS, np.int64), np.zeros((TOPICS, FEATURES), np.int64)
            for batch in rows:
                if batch.num_rows:
                    of(np.frombuffer(b"".join(batch.column(0).to_pylist()), "<u2").reshape(-1, FEATURES), n, sums)
            yield pa.record_batch({"topic": pa.array(np.arange(TOPICS)), "n": pa.array(n), "sums": pa.array([r.tobytes() for r in sums], pa.binary())})

        got = table.mapInArrow(run, "topic long, n long, sums binary").toArrow()  # TOPICS rows a task
        n, sums = np.zeros(TOPICS, np.int64), np.zeros((TOPICS, FEATURES), np.int64)
        for k, m, x in zip(*(got[c].to_pylist() for c in ("topic", "n", "sums"))):
            n[k] += m
            sums[k] += np.frombuffer(x, np.int64)
        return n, sums

    def having(c, n, sums):
        n[0] += len(c)
        sums[0] += (c > 0).sum(0)

    table = stored(docs.select("text").mapInArrow(count, "counts binary"), "counts")
    n, have = summed(having)
    weight = np.log((1 + n[0]) / (1 + have[0])) + 1e-3
    if not n[0]:
        return weight, np.zeros((1, FEATURES))

    def far(centres):
        """The document with the least -log(u) / squared distance: a draw with a chance by that distance."""

        def run(rows):
            best = (np.inf, b"")
            for batch in rows:
                if batch.num_rows:
                    raw = batch.column(0).to_pylist()
                    c = np.frombuffer(b"".join(raw), "<u2").reshape(-1, FEATURES)
                    d = np.ones(len(c)) if not len(centres) else np.maximum(2 - 2 * (points(c, weight) @ centres.T).max(1), 0.0)
                    u = (mix(c.astype(np.uint64) @ odd) >> np.uint64(11)).astype(float) + 1
                    key = np.where(d > 1e-9, -np.log(u / 2.0**53) / np.maximum(d, 1e-9), np.inf)
                    i = int(np.lexsort((u, key))[0])
                    best = min(best, (float(key[i]), raw[i]))
            if best[1]:
                yield pa.record_batch({"key": pa.array([best[0]]), "counts": pa.array([best[1]], pa.binary())})

        odd = mix(np.arange(1, FEATURES + 1, dtype=np.uint64) * np.uint64(2 * len(centres) + 1)) | np.uint64(1)
        found = min(((r["key"], bytes(r["counts"])) for r in table.mapInArrow(run, "key double, counts binary").filter("key < double('infinity')").collect()), default=None)  # a row a task
        return points(np.frombuffer(found[1], "<u2").reshape(1, -1), weight) if found else None

    centres = np.zeros((0, FEATURES))
    while len(centres) < TOPICS:
        one = far(centres)
        if one is None:
            break
        centres = np.concatenate([centres, one])
    for _ in range(TURNS):

        def moved(c, n, sums, centres=centres):
            x = points(c, weight)
            near = nearest(x, centres)
            whole = np.rint(x * 2.0**24).astype(np.int64)
            for k in range(len(centres)):
                n[k] += (near == k).sum()
                sums[k] += whole[near == k].sum(0)

        n, sums = summed(moved)
        new = centres.copy()
        new[n[: len(new)] > 0] = (sums / 2.0**24 / np.maximum(n, 1)[:, None])[: len(new)][n[: len(new)] > 0]
        if np.array_equal(new, centres):
            break
        centres = new
    return weight, centres


def _measure(shared):
    """topic and tokens of texts."""

    def run(column: pa.Array) -> pa.Array:
        weight, centres = shared.value
        counts, words = counts_of(column)
        near = nearest(points(counts, weight), centres)
        names = np.where(words > 0, np.array([f"topic{k}" for k in range(len(centres))], object)[near], "")
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(words)], ["topic", "tokens"])

    # Not deterministic for the optimiser alone: it would run once more for each filter that it pushes below.
    return F.arrow_udf(run, "topic string, tokens long").asNondeterministic()


def wanted(mass: dict[str, float], power: float, given: dict[str, float]) -> dict[str, float]:
    """The target share of each value with tokens."""
    given = {v: s for v, s in given.items() if mass.get(v, 0) > 0}
    rest = {v: m**power for v, m in mass.items() if m > 0 and v not in given}
    left, total = max(0.0, 1 - sum(given.values())), sum(rest.values())
    out = given | {v: left * x / total for v, x in rest.items()}
    whole = sum(out.values()) or 1.0
    return {v: s / whole for v, s in out.items()}


def marginals(cells: dict[tuple[str, ...], float], targets: Targets | None = None) -> list[dict[str, float]]:
    out = []
    for d, (name, power) in enumerate(POWERS.items()):
        mass: dict[str, float] = {}
        for k, m in cells.items():
            mass[k[d]] = mass.get(k[d], 0.0) + m
        out.append(wanted(mass, power, (targets or {}).get(name, {})))
    return out


def rake(cells: dict[tuple[str, ...], float], goals: list[dict[str, float]], rounds: int = ROUNDS) -> dict[tuple[str, ...], float]:
    """A factor for each cell, so that factor * tokens meets the goal of every value in every dimension."""
    keys = [k for k, m in cells.items() if m > 0]
    if not keys:
        return dict.fromkeys(cells, 0.0)
    mass = np.array([cells[k] for k in keys], float)
    share = mass / mass.sum()
    codes, aims = [], []
    for d, goal in enumerate(goals):
        number = {v: i for i, v in enumerate(sorted(goal))}
        codes.append(np.array([number[k[d]] for k in keys]))
        aims.append(np.array([goal[v] for v in sorted(goal)]))
    weight = share.copy()
    for _ in range(rounds):
        off = 0.0
        for code, aim in zip(codes, aims):
            have = np.bincount(code, weights=weight, minlength=len(aim))
            off = max(off, float(np.abs(have - aim).max()))
            weight = weight * np.divide(aim, have, out=np.ones(len(aim)), where=have > 0)[code]
        if off < TOLERANCE:
            break
    return dict.fromkeys(cells, 0.0) | dict(zip(keys, (weight / share).tolist()))


def _raked_frame(sums: DataFrame, targets: Targets | None, rounds: int) -> DataFrame:
    """As rake, for more cells than the driver should hold."""
    spark = sums.sparkSession
    sums = sums.filter("tokens > 0")
    total = sums.agg(F.sum("tokens")).first()[0] or 1
    cells = sums.withColumn("w", F.col("tokens") / total)
    goals = {}
    for d, power in POWERS.items():
        given = spark.createDataFrame(list((targets or {}).get(d, {}).items()), f"{d} string, given double")
        g = sums.groupBy(d).agg(F.pow(F.sum("tokens"), F.lit(power)).alias("rest")).join(given, d, "left")
        free, fixed = g.agg(F.sum(F.when(F.col("given").isNull(), F.col("rest"))), F.sum("given")).first()
        left = max(0.0, 1 - (fixed or 0.0))
        goal = F.coalesce("given", F.lit(left) * F.col("rest") / (free or 1.0))
        whole = (fixed or 0.0) + (left if free else 0.0)
        goals[d] = stored(g.select(d, (goal / (whole or 1.0)).alias("g")), f"goal-{d}")
    for turn in range(rounds):
        off = 0.0
        for d in _DIMS:
            have = stored(cells.groupBy(d).agg(F.sum("w").alias("h")).join(goals[d], d), f"have-{d}-{turn}")
            off = max(off, have.agg(F.max(F.abs(F.col("h") - F.col("g")))).first()[0] or 0.0)
            cells = cells.join(have, d).withColumn("w", F.col("w") * F.coalesce(F.try_divide("g", "h"), F.lit(1.0))).drop("g", "h")
        cells = stored(cells, f"cells-{turn}")
        if off < TOLERANCE:
            break
    return cells.select(*_DIMS, F.coalesce(F.try_divide(F.col("w") * total, F.col("tokens")), F.lit(0.0)).alias("factor"), "tokens")


def chances(sums: DataFrame, targets: Targets | None = None, max_cells: int = MAX_CELLS) -> DataFrame:
    """source, lang, topic, factor, chance of each cell, from its tokens."""
    spark = sums.sparkSession
    if sums.count() <= max_cells:
        cells = {tuple(r[d] for d in _DIMS): float(r["tokens"]) for r in sums.collect()}
        found = rake(cells, marginals(cells, targets))
        factors = spark.createDataFrame([(*k, f, cells[k]) for k, f in found.items()], "source string, lang string, topic string, factor double, tokens double")
    else:
        factors = stored(_raked_frame(sums, targets, ROUNDS), "factors")
    total = factors.agg(F.sum("tokens")).first()[0] or 1
    most, all_ = factors.agg(F.max(F.when(F.col("tokens") >= LEAST_CELL * total, F.col("factor"))), F.max("factor")).first()
    return stored(factors.select(*_DIMS, "factor", F.least(F.lit(1.0), F.col("factor") / ((most or all_) or 1.0)).alias("chance")), "chances")


def _value(c: str):
    return F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)


def _draw():
    place = F.xxhash64("doc_id", F.coalesce(F.col("text"), F.lit("")))
    return F.pmod(F.xxhash64("doc_id", place, F.lit(SEED)), F.lit(1 << 40)) / float(1 << 40)


def _measured(docs: DataFrame):
    """The measuring function, and the tokens of each cell with every document's own row."""
    small_batches(docs.sparkSession)
    measure = _measure(docs.sparkSession.sparkContext.broadcast(topics(docs)))
    rows = docs.select("doc_id", _draw().alias("draw"), _value("source"), _value("lang"), measure("text").alias("m")).select("doc_id", "draw", "source", "lang", "m.*")
    return measure, stored(rows, "tokens")


def _sums(rows: DataFrame) -> DataFrame:
    return stored(rows.groupBy(*_DIMS).agg(F.sum("tokens").alias("tokens")), "cells")


def weigh(docs: DataFrame, targets: Targets | None = None, max_cells: int = MAX_CELLS) -> DataFrame:
    """doc_id, source, lang, topic, tokens, factor, chance, drawn of every document."""
    _, rows = _measured(docs)
    # No hint: Spark broadcasts the stored cells if they are small, by its own limit, and splits a hot cell otherwise.
    out = rows.join(chances(_sums(rows), targets, max_cells), _DIMS, "left")
    return out.select("doc_id", *_DIMS, "tokens", F.coalesce("factor", F.lit(0.0)).alias("factor"), F.coalesce("chance", F.lit(0.0)).alias("chance")
                      , (F.col("draw") < F.coalesce("chance", F.lit(0.0))).alias("drawn"))


def sample(docs: DataFrame, targets: Targets | None = None) -> DataFrame:
    """The drawn documents, with their own columns; no text is shuffled while the cells are small."""
    measure, rows = _measured(docs)
    cell = F.struct(_value("source"), _value("lang"), measure("text").alias("m"))
    given = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("given"), _draw().alias("draw"), cell.alias("cell"))
    keys = given.select("given", "draw", F.col("cell.source").alias("source"), F.col("cell.lang").alias("lang"), F.col("cell.m.topic").alias("topic"))
    drawn = keys.join(chances(_sums(rows), targets), _DIMS).filter(F.col("draw") < F.col("chance"))
    return drawn.select(*[F.col("given")[c].alias(c) for c in docs.columns])


def reached(weighed: DataFrame, targets: Targets | None = None) -> DataFrame:
    """dimension, value, target, expected (share of tokens by the chances) and drawn (share of the drawn tokens), from `weigh`."""
    rows = None
    for d, power in POWERS.items():
        given = weighed.sparkSession.createDataFrame(list((targets or {}).get(d, {}).items()), "value string, given double")
        by = weighed.groupBy(F.col(d).alias("value")).agg(
            F.sum("tokens").alias("t"), F.sum(F.col("tokens") * F.col("chance")).alias("e"), F.sum(F.when(F.col("drawn"), F.col("tokens")).otherwise(0)).alias("d")).filter("t > 0")
        by = stored(by.join(given, "value", "left").withColumn("rest", F.when(F.col("given").isNull(), F.pow("t", F.lit(power)))), f"reached-{d}")
        t = by.agg(F.sum("rest").alias("free"), F.coalesce(F.sum("given"), F.lit(0.0)).alias("fixed"), F.sum("e").alias("es"), F.sum("d").alias("ds"))
        left = F.greatest(F.lit(0.0), 1 - F.col("fixed"))
        whole = F.col("fixed") + F.when(F.col("free") > 0, left).otherwise(0.0)
        goal = F.coalesce("given", left * F.col("rest") / F.col("free")) / whole
        one = by.crossJoin(t).select(F.lit(d).alias("dimension"), "value", goal.alias("target"), F.try_divide("e", "es").alias("expected"), F.try_divide("d", "ds").alias("drawn"))
        rows = one if rows is None else rows.unionByName(one)
    return rows
