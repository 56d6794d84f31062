"""Hard negatives of anchors, by an orthogonal PCA rotation and early discarding (operator 13).

Rows are rotated by the eigenvectors of their second moments, summed over all rows, so that leading components hold most of
every inner product. Anchors meet all rows in blocks: for a block, products of the leading components are accumulated step
by step, the rest is bounded by the norms of the components still to come (with slack for rounding), and pairs that cannot
reach a place any more are discarded. What survives is verified by the integer product itself, so the result is exact and
doesn't depend on the rotation. A first pass finds each anchor's best rows of its label, a second one the rows of other labels
in the window below each of them.

Each block of anchors meets each slice of rows in a task of its own: BLOCK anchors, SLICE rows at most on average, told apart
by a hash of the row's place, so no label, id or vector decides how rows are dealt. A task returns its best few rows of each anchor.

Defined results: rows with a null label, a null vector, or null or non-finite components take no part, nor do those whose
squared integer norm passes 2**62, as their scores need not fit a long. Vectors of different lengths don't meet: each length has a rotation of its own
(the driver holds a matrix for each length). Empty vectors have scores of 0. Rows without a vec_id are no anchors and come last
among ties. Repeated rows are rows of their own: an anchor's copy may be its positive. Other columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import PLACE, placed, small_batches, spare2, stored, trimmed

#: Anchors in a block, rows in a slice, rows that one step of a task takes.
BLOCK, SLICE, STEP = 1024, 16384, 1024
#: A window is taken as this share of the norms wider than computed, for rounding.
SLACK = 1e-9
#: Surviving pairs verified at once.
PAIRS = 1 << 17

_INF = np.iinfo(np.int64).max


def valid(rows: DataFrame) -> DataFrame:
    """vec_id, label, dim, q (the integer components as bytes), place: rows that take part."""
    small_batches(rows.sparkSession)
    values = placed(rows, "vec_id", "label", "embedding").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("e"), "__place")
    values = values.filter(F.col("label").isNotNull() & F.col("e").isNotNull())

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            e = batch.column(2)
            at = e.offsets.to_numpy().astype(np.int64)
            x = np.floor(256.0 * e.values.to_numpy(zero_copy_only=False).astype(np.float64))  # null gives nan
            x, at = x[at[0] : at[-1]], at - at[0]
            with np.errstate(over="ignore", invalid="ignore"):
                square = np.add.reduceat(np.append(x * x, 0.0), np.minimum(at[:-1], len(x))) * (np.diff(at) > 0) if len(at) > 1 else np.zeros(0)
            keep = np.flatnonzero(np.where(np.diff(at) > 0, square, 0.0) < 2.0**62)  # false for nan and infinite ones
            q = [x[at[k] : at[k + 1]].astype("<i8").tobytes() for k in keep]
            took = pa.array(keep)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(took), batch.column(1).take(took), pa.array(np.diff(at)[keep], pa.int32()), pa.array(q, pa.binary()), batch.column(3).take(took)], names=["vec_id", "label", "dim", "q", "place"]
            )

    return values.mapInArrow(trimmed(run), f"vec_id bigint, label bigint, dim int, q binary, place {PLACE}")


def _matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i8").reshape(len(column), dim)


def rotations(rows: DataFrame) -> dict[int, np.ndarray]:
    """For each length of vector, the eigenvectors of the second moments of all rows, as columns, the heaviest first."""

    def run(batches: Iterator[pa.RecordBatch]):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            dims = batch.column(0).to_numpy()
            for dim in np.unique(dims[dims > 0]).tolist():
                x = _matrix(batch.column(1).take(pa.array(np.flatnonzero(dims == dim))), dim).astype(np.float64)
                sums[dim] = sums.get(dim, 0) + x.T @ x
        for dim, gram in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([dim] * dim, pa.int32()), pa.array(range(dim), pa.int32()), pa.array([r.tobytes() for r in gram], pa.binary())], names=["dim", "i", "row"])

    def total(table: pa.Table) -> pa.Table:
        x = np.sum([np.frombuffer(r, np.float64) for r in table.column("row").to_pylist()], axis=0)
        return pa.table({"dim": table.column("dim").slice(0, 1), "i": table.column("i").slice(0, 1), "row": pa.array([x.tobytes()], pa.binary())})

    found: dict[int, dict[int, np.ndarray]] = {}
    for dim, i, row in rows.select("dim", "q").mapInArrow(trimmed(run), "dim int, i int, row binary").groupBy("dim", "i").applyInArrow(total, "dim int, i int, row binary").toLocalIterator():
        found.setdefault(dim, {})[i] = np.frombuffer(row, np.float64)
    return {dim: np.ascontiguousarray(np.linalg.eigh(np.stack([own[i] for i in range(dim)]))[1][:, ::-1]) for dim, own in found.items()}


class Side:
    """Vectors of one block: integer components, rotated ones, and norms of what is left after each step's components."""

    def __init__(self, q: np.ndarray, turn: np.ndarray | None):
        self.q, dim = q, q.shape[1]
        self.y = q.astype(np.float64) @ turn if turn is not None else q.astype(np.float64)
        self.ends = sorted({max(1, dim // 8), max(1, dim // 4), max(1, dim // 2), dim}) if dim else [0]
        square = np.concatenate([np.zeros((len(q), 1)), np.cumsum((self.y * self.y)[:, ::-1], axis=1)], axis=1)[:, ::-1]
        self.rest = np.sqrt(square[:, self.ends])
        self.norm = np.sqrt(square[:, 0])


def product(a: Side, x: Side, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The integer inner products of some pairs."""
    parts = [np.einsum("ij,ij->i", a.q[i[lo : lo + PAIRS]], x.q[j[lo : lo + PAIRS]]) for lo in range(0, len(i), PAIRS)]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def survivors(a: Side, x: Side, fits: np.ndarray, low: np.ndarray, high: np.ndarray, partial: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs that fit, and whose score is between their anchor's low and high: (anchor, row, score)."""
    slack = SLACK * np.outer(a.norm, x.norm) + 1e-6
    rest = np.outer(a.rest[:, 0], x.rest[:, 0]) + slack
    i, j = np.nonzero(fits & (partial + rest >= low[:, None]) & (partial - rest <= high[:, None]))
    value = partial[i, j]
    for k in range(1, len(a.ends)):
        lo, hi = a.ends[k - 1], a.ends[k]
        kept = []
        for s in range(0, len(i), PAIRS):
            p, r = i[s : s + PAIRS], j[s : s + PAIRS]
            value[s : s + PAIRS] += np.einsum("ij,ij->i", a.y[p, lo:hi], x.y[r, lo:hi])
            bound = a.rest[p, k] * x.rest[r, k] + SLACK * a.norm[p] * x.norm[r] + 1e-6
            kept.append((value[s : s + PAIRS] + bound >= low[p]) & (value[s : s + PAIRS] - bound <= high[p]))
        keep = np.concatenate(kept) if kept else np.zeros(0, bool)
        i, j, value = i[keep], j[keep], value[keep]
    score = product(a, x, i, j)
    keep = (score >= low[i]) & (score <= high[i])
    return i[keep], j[keep], score[keep]


def leading(group: np.ndarray, score: np.ndarray, ties: tuple, n: int) -> np.ndarray:
    """The first n of each group: higher scores first, then by the ties, the first of them first."""
    order = np.lexsort((*ties[::-1], -score, group))
    g = group[order]
    where = np.arange(len(g))
    new = np.ones(len(g), bool)
    new[1:] = g[1:] != g[:-1]
    return order[where - np.maximum.accumulate(np.where(new, where, 0)) < n] if len(g) else order


def _columns(table: pa.Table) -> dict:
    place = table.column("place").combine_chunks()
    ids = table.column("vec_id").combine_chunks()
    return {"vec_id": ids.fill_null(_INF).to_numpy(zero_copy_only=False), "none": ids.is_null().to_numpy(zero_copy_only=False), "label": table.column("label").to_numpy(), "file": place.field("file").to_numpy(), "row": place.field("row").to_numpy()}


def _best(a: Side, own: dict, x: Side, rows: dict, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The best n rows of each anchor's label, itself left out, in this slice."""
    low = np.full(len(a.q), -np.inf)
    kept = [np.zeros(0, np.int64)] * 3
    for lo in range(0, len(x.q), STEP):
        part = _cut(x, slice(lo, lo + STEP))
        fits = own["label"][:, None] == rows["label"][None, lo : lo + STEP]
        fits &= (own["file"][:, None] != rows["file"][None, lo : lo + STEP]) | (own["row"][:, None] != rows["row"][None, lo : lo + STEP])
        partial = a.y[:, : a.ends[0]] @ part.y[:, : a.ends[0]].T
        if len(part.q) > n:  # n rows that look best give each anchor a first score to reach
            guess = np.argpartition(np.where(fits, -partial, np.inf), n - 1, axis=1)[:, :n]
            i = np.repeat(np.arange(len(a.q)), n)
            score = np.where(fits[i, guess.ravel()], product(a, part, i, guess.ravel()).astype(np.float64), -np.inf).reshape(-1, n)
            low = np.maximum(low, np.nextafter(score.min(axis=1), -np.inf))
        i, j, score = survivors(a, part, fits, low, np.full(len(a.q), np.inf), partial)
        i, j, score = (np.concatenate([u, v]) for u, v in zip(kept, (i, j + lo, score)))
        first = leading(i, score, (rows["none"][j], rows["vec_id"][j], rows["file"][j], rows["row"][j]), n)
        kept = [i[first], j[first], score[first]]
        full = np.bincount(kept[0], minlength=len(a.q)) == n
        worst = np.full(len(a.q), np.inf)
        np.minimum.at(worst, kept[0], kept[2].astype(np.float64))
        low = np.where(full, np.maximum(low, np.nextafter(worst, -np.inf)), low)
    return tuple(kept)


def _cut(x: Side, at: slice) -> Side:
    out = object.__new__(Side)
    out.q, out.y, out.rest, out.norm, out.ends = x.q[at], x.y[at], x.rest[at], x.norm[at], x.ends
    return out


def _windows(a: Side, own: dict, x: Side, rows: dict, scores: list[np.ndarray], n: int) -> list[tuple]:
    """For each place p of a positive: (p, anchor, row, score) of the first n rows of other labels in the window below its score."""
    width = max(map(len, scores), default=0)
    s = np.full((len(scores), width), np.nan)
    for k, v in enumerate(scores):
        s[k, : len(v)] = v
    exact = [np.array([int(v[p]) if p < len(v) else -1 for v in scores], np.int64) for p in range(width)]  # -1: nothing is half of it or more, and at most 0.95 of it
    floor = np.where(s >= 0, s / 2, np.inf)
    low = np.nextafter(floor.min(axis=1, initial=np.inf), -np.inf)
    high = np.nextafter(np.where(s >= 0, 0.95 * s, -np.inf).max(axis=1, initial=-np.inf), np.inf) + 1e-6
    kept = [[np.zeros(0, np.int64)] * 3 for _ in range(width)]
    for lo in range(0, len(x.q), STEP):
        part = _cut(x, slice(lo, lo + STEP))
        fits = own["label"][:, None] != rows["label"][None, lo : lo + STEP]
        i, j, score = survivors(a, part, fits, low, high, a.y[:, : a.ends[0]] @ part.y[:, : a.ends[0]].T)
        for p in range(width):
            positive = exact[p][i]
            fit = (positive >= 0) & (score >= positive - positive // 2) & (score <= positive - -(-positive // 20))  # half of it, and 0.95 of it, as integers
            u, v, w = (np.concatenate([k, m]) for k, m in zip(kept[p], (i[fit], j[fit] + lo, score[fit])))
            first = leading(u, w, (rows["none"][v], rows["vec_id"][v], rows["file"][v], rows["row"][v]), n)
            kept[p] = [u[first], v[first], w[first]]
            worst = np.full(len(a.q), np.inf)
            np.minimum.at(worst, kept[p][0], kept[p][2].astype(np.float64))
            full = np.bincount(kept[p][0], minlength=len(a.q)) == n
            floor[:, p] = np.where(full, np.maximum(floor[:, p], worst), floor[:, p])
        low = np.nextafter(floor.min(axis=1, initial=np.inf), -np.inf)
    return [(p, *k) for p, k in enumerate(kept)]


def mine(rows: DataFrame, every: int = 50, positives: int = 5, negatives: int = 3) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: see `op13_hard_negatives`."""
    spark = rows.sparkSession
    vectors = stored(valid(rows), "vectors")
    counts = {r["dim"]: (r["n"], r["a"]) for r in vectors.groupBy("dim").agg(F.count("*").alias("n"), F.count_if(F.col("vec_id") % every == 0).alias("a")).collect()}  # one a length
    turns = spark.sparkContext.broadcast(rotations(vectors))  # the square of a vector's length
    sizes = F.broadcast(spark.createDataFrame([(d, -(-n // SLICE), max(1, -(-a // BLOCK))) for d, (n, a) in counts.items()], "dim int, slices int, blocks int"))
    hashed = lambda of: F.pmod(F.xxhash64("place.file", "place.row", F.lit(of)), F.col("slices" if of == "slice" else "blocks"))
    slices = vectors.join(sizes, "dim").withColumn("slice", hashed("slice")).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    slices = slices.select(*[F.col(c).alias(c) for c in ("dim", "slice", "block", "vec_id", "label", "q", "place")])

    def blocks(anchors: DataFrame) -> DataFrame:
        dealt = anchors.join(sizes, "dim").withColumn("block", hashed("block")).withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)))
        return dealt.select(*[F.col(c).alias(c) for c in ("dim", "slice", "block", *[c for c in anchors.columns if c != "dim"])])  # new columns, as anchors and slices come from one table

    def sides(key: tuple, left: pa.Table, right: pa.Table) -> tuple:
        turn = turns.value.get(key[0].as_py())
        return *(Side(_matrix(t.column("q"), key[0].as_py()), turn) for t in (left, right)), _columns(left), _columns(right)

    def best(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return empty
        a, x, own, other = sides(key, left, right)
        i, j, score = _best(a, own, x, other, positives)
        i, j = pa.array(i), pa.array(j)
        return pa.table({"place": left.column("place").take(i), "positive_id": right.column("vec_id").take(j), "positive_place": right.column("place").take(j), "positive_score": pa.array(score, pa.int64())})

    place = pa.struct([("file", pa.int64()), ("row", pa.int64())])
    empty = pa.table({"place": pa.array([], place), "positive_id": pa.array([], pa.int64()), "positive_place": pa.array([], place), "positive_score": pa.array([], pa.int64())})
    keys = ["dim", "slice", "block"]
    anchors = vectors.filter(F.col("vec_id") % every == 0)
    found = blocks(anchors).groupBy(keys).cogroup(slices.groupBy(keys)).applyInArrow(spare2(best), f"place {PLACE}, positive_id bigint, positive_place {PLACE}, positive_score bigint")
    order = Window.partitionBy("place").orderBy(F.desc("positive_score"), F.col("positive_id").asc_nulls_last(), "positive_place")
    found = found.withColumn("p", F.row_number().over(order)).filter(F.col("p") <= positives)
    listed = F.array_sort(F.collect_list(F.struct("p", "positive_id", "positive_score")))  # at most `positives` of them
    held = stored(anchors.join(found.groupBy("place").agg(listed.alias("positives")), "place"), "anchors")

    nothing = pa.table({n: pa.array([], t) for n, t in (("place", place), ("anchor_id", pa.int64()), ("p", pa.int32()), ("positive_id", pa.int64()), ("negative_id", pa.int64()), ("negative_place", place), ("positive_score", pa.int64()), ("negative_score", pa.int64()))})

    def below(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return nothing
        a, x, own, other = sides(key, left, right)
        lists = left.column("positives").to_pylist()
        out = [nothing]
        for p, i, j, score in _windows(a, own, x, other, [np.array([z["positive_score"] for z in v], np.float64) for v in lists], negatives):
            at, to = pa.array(i), pa.array(j)
            chosen = [lists[k][p] for k in i]
            out.append(pa.table({
                "place": left.column("place").take(at), "anchor_id": left.column("vec_id").take(at), "p": pa.array([p] * len(i), pa.int32()), "positive_id": pa.array([z["positive_id"] for z in chosen], pa.int64()),
                "negative_id": right.column("vec_id").take(to), "negative_place": right.column("place").take(to), "positive_score": pa.array([z["positive_score"] for z in chosen], pa.int64()), "negative_score": pa.array(score, pa.int64()),
            }))
        return pa.concat_tables(out)

    schema = f"place {PLACE}, anchor_id bigint, p int, positive_id bigint, negative_id bigint, negative_place {PLACE}, positive_score bigint, negative_score bigint"
    pairs = blocks(held).groupBy(keys).cogroup(slices.groupBy(keys)).applyInArrow(spare2(below), schema)
    order = Window.partitionBy("place", "p").orderBy(F.desc("negative_score"), F.col("negative_id").asc_nulls_last(), "negative_place")
    return pairs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= negatives).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def relabelled(rows: DataFrame, step: int = 7, labels: int = 10) -> DataFrame:
    """Rows whose vec_id is divisible by step get the label after their own."""
    return rows.withColumn("label", F.when(F.col("vec_id") % step == 0, (F.col("label") + 1) % labels).otherwise(F.col("label")))
