"""Distances of pairs of rows (id, x), a block of rows against another in one task: the sums of `distance`, in the same order.

Rows meet in cells of ROWS_A by ROWS_B, so a task holds a few MB of distances, however many pairs there are. Pairs that these
sums don't define (null or unequal arrays, values that aren't finite, results that aren't) are handed on with their arrays and left
to the column expression, so both give the same.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROWS_A, ROWS_B, TILE, MOST_TASKS = 1024, 2048, 32768, 4096
Block = Callable[[np.ndarray, np.ndarray], np.ndarray]


def _folded(term: Callable[[np.ndarray, np.ndarray, np.ndarray], None], fold=np.add) -> Block:
    """Folds a term of two components over all components, one after another; term(x, y, out)."""

    def run(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        out, columns = np.zeros((len(x), len(y))), np.ascontiguousarray(y.T)
        step = max(1, TILE // max(1, len(y)))
        for lo in range(0, len(x), step):
            part = out[lo : lo + step]
            some = np.empty_like(part)
            for k, column in enumerate(columns):
                term(x[lo : lo + step, k, None], column, some)
                fold(part, some, out=part)
        return out

    return run


def _difference_squared(x, y, out):
    np.subtract(x, y, out=out)
    np.multiply(out, out, out=out)


def _difference(x, y, out):
    np.subtract(x, y, out=out)
    np.abs(out, out=out)


def _relative(x, y, out):
    np.subtract(x, y, out=out)
    np.multiply(out, np.log(x / y), out=out)


squared, manhattan, dot = _folded(_difference_squared), _folded(_difference), _folded(lambda x, y, out: np.multiply(x, y, out=out))
largest = _folded(_difference, np.maximum)
_divergence = _folded(_relative)


def _running(x: np.ndarray) -> np.ndarray:
    return np.add.accumulate(x, axis=1)[:, -1]


def euclidean(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(squared(x, y))


def normalised_euclidean(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    nx, ny = np.sqrt(_running(x * x)), np.sqrt(_running(y * y))
    return np.sqrt(np.maximum(0.0, 2 - 2 * dot(x, y) / (nx[:, None] * ny)))


def pearson(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    a, b = (v - _running(v)[:, None] / v.shape[1] for v in (x, y))
    return 1 - dot(a, b) / np.sqrt(_running(a * a)[:, None] * _running(b * b))


def _correlations(x: np.ndarray, y: np.ndarray):
    """For some rows of y at a time: their place, and the correlations (y, shift from 1-m to m-1, x)."""
    m = x.shape[1]
    nx, ny = _running(x * x), _running(y * y)
    padded = np.zeros((len(y), 3 * m - 2))
    padded[:, m - 1 : 2 * m - 1] = y
    shifted = np.lib.stride_tricks.sliding_window_view(padded, m, axis=1)[:, ::-1]
    step = max(1, 8 * TILE // max(1, len(x) * 2 * m))
    for lo in range(0, len(y), step):
        yield slice(lo, lo + step), shifted[lo : lo + step] @ x.T / np.sqrt(ny[lo : lo + step, None, None] * nx)


def shape_based(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    out = np.empty((len(x), len(y)))
    for at, c in _correlations(x, y):
        out[:, at] = 1 - c.max(1).T
    return out


def best_shift(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    out = np.empty((len(x), len(y)))
    for at, c in _correlations(x, y):
        shift = np.argmax(np.rint(c * 1e9), axis=1) + 1 - x.shape[1]
        out[:, at] = np.where(np.isfinite(c).all(1), shift, np.nan).T
    return out


def symmetric_divergence(bins: int = 50, e: float = 1e-8) -> Block:
    def shares(x: np.ndarray) -> np.ndarray:
        at = np.minimum(bins - 1, np.floor(x * bins))
        h = np.stack([(at == b).sum(1) for b in range(bins)], axis=1) / x.shape[1]
        return (h + e) / (1 + bins * e)

    return lambda x, y: _divergence(shares(x), shares(y))


def wasserstein(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return manhattan(np.sort(x, axis=1), np.sort(y, axis=1)) / x.shape[1]


def _arrays(table: pa.Table) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """The arrays, their lengths (0 for one with a value that is missing or not finite), all values, and the row of each value."""
    x = table["x"].combine_chunks() if table.num_rows else pa.array([], table.schema.field("x").type)
    size = np.asarray(pc.fill_null(pc.list_value_length(x), 0), np.int64)
    values = x.flatten().to_numpy(zero_copy_only=False).astype(float)
    row = np.repeat(np.arange(len(x)), size)
    size[row[~np.isfinite(values)]] = 0
    return x, size, values, row


def _distances(block: Block, left, right) -> np.ndarray:
    """The distances; NaN where the column expression has to tell."""
    (_, na, va, ra), (_, nb, vb, rb) = left, right
    out = np.full((len(na), len(nb)), np.nan)
    for n in np.intersect1d(na[na > 0], nb[nb > 0]):
        with np.errstate(all="ignore"):
            out[np.ix_(na == n, nb == n)] = block(va[na[ra] == n].reshape(-1, n), vb[nb[rb] == n].reshape(-1, n))
    out[~np.isfinite(out)] = np.nan
    return out


def _forest(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (row, column) of a spanning forest of the rows and columns that `near` links."""
    free, new, links = np.ones(near.shape[1], bool), np.ones(near.shape[0], bool), []
    for start in range(len(near)):
        todo = [start] if new[start] else []
        new[start] = False
        while todo:
            i = todo.pop()
            for j in np.flatnonzero(near[i] & free):
                free[j] = False
                links.append((i, j))
                for k in np.flatnonzero(near[:, j] & new):
                    new[k] = False
                    links.append((k, j))
                    todo.append(k)
    return tuple(np.array(links, np.int64).reshape(-1, 2).T)


def cells(queries: DataFrame, rows: DataFrame, keys: list[str], block: Block, column: Callable[[Column, Column], Column], give: str = "pairs",
          most: float | None = None, upper: bool = False) -> DataFrame:
    """keys, a, b, d of each of `queries` with every row of other id and the same keys (both: keys, id, x).

    give `pairs`: these; `sums`: for each a and each cell the sum of its distances (b null); `counts`: how many there are;
    `links`: with a column `core`, links of a spanning forest of core rows and all links of a row that isn't core with core rows.
    most: only distances up to it. upper: only a < b.
    """
    spark, core = rows.sparkSession, give == "links"
    named = [f"_k{i}" for i in range(len(keys))]
    columns = [*[F.col(k).alias(n) for k, n in zip(keys, named)], "id", "x", *(["core"] if core else [])]
    queries, rows = (df.select(*columns).dropna(subset=[*named, "id"]) for df in (queries, rows))
    sized = lambda df, size, c: df.groupBy(*named).agg(F.ceil(F.count("*") / size).cast("int").alias(c))
    if named:
        grid = sized(queries, ROWS_A, "_na").join(sized(rows, ROWS_B, "_nb"), named)
    else:
        grid = sized(queries, ROWS_A, "_na").crossJoin(sized(rows, ROWS_B, "_nb"))  # a row each
    tasks = min(MOST_TASKS, grid.agg(F.sum(F.col("_na").cast("long") * F.col("_nb"))).first()[0] or 1)
    at = lambda n: F.pmod(F.xxhash64("id", "x"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    dealt = lambda df: (df.join(grid, named) if named else df.crossJoin(F.broadcast(grid)))
    names = [*named, "_a", "_b"]
    a = dealt(queries).withColumn("_a", at("_na")).withColumn("_b", every("_nb")).drop("_na", "_nb").repartition(max(1, tasks), *names)
    b = dealt(rows).withColumn("_b", at("_nb")).withColumn("_a", every("_na")).select(*[F.col(c).alias(f"r_{c}") for c in a.columns])  # names of its own, as both may be one table
    b = b.repartition(max(1, tasks), *[f"r_{n}" for n in names])
    kinds = {f.name: f.dataType for f in a.schema.fields}
    array = T.ArrayType(T.DoubleType())
    schema = T.StructType([*[T.StructField(n, kinds[n]) for n in named], T.StructField("a", kinds["id"]), T.StructField("b", kinds["id"]), T.StructField("d", T.DoubleType()),
                           T.StructField("odd", T.BooleanType()), T.StructField("xa", array), T.StructField("xb", array)])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.rename_columns([n.removeprefix("r_") for n in right.schema.names])
        one, two = _arrays(left), _arrays(right)
        d = _distances(block, one, two)
        ia, ib = (np.asarray(t["id"].to_numpy()) for t in (left, right))
        wanted = ia[:, None] < ib if upper else ia[:, None] != ib
        odd = wanted & np.isnan(d)
        near = wanted & ~odd
        if most is not None:
            near &= np.where(odd, np.inf, d) <= most
        if core:
            ca, cb = (np.asarray(t["core"].to_numpy(zero_copy_only=False), bool) for t in (left, right))
            odd &= cb
            parts = [(*_forest(near & ca[:, None] & cb), None), (*np.nonzero(near & ~ca[:, None] & cb), None)]
        elif give == "pairs":
            parts = [(*np.nonzero(near), None)]
        else:
            has = np.flatnonzero(near.any(1))
            parts = [(has, None, (np.where(near, d, 0.0).sum(1) if give == "sums" else near.sum(1).astype(float))[has])]
        parts.append((*np.nonzero(odd), True))
        out = []
        for p, q, extra in parts:
            strange = extra is True
            if not len(p):
                continue
            value = pa.nulls(len(p), pa.float64()) if strange else pa.array(extra if extra is not None else d[p, q])
            out.append(pa.table([*[left[n].take(pa.array(p)) for n in named], left["id"].take(pa.array(p))
                                 , pa.nulls(len(p), left.schema.field("id").type) if q is None else right["id"].take(pa.array(q)), value, pa.array(np.full(len(p), strange))
                                 , *[(t[0].take(pa.array(k)) if strange else pa.nulls(len(p), t[0].type)).cast(pa.list_(pa.float64())) for t, k in ((one, p), (two, q))]], schema.names))
        if out:
            return pa.concat_tables([t.cast(out[0].schema) for t in out])
        empty = {"d": pa.float64(), "odd": pa.bool_(), "xa": pa.list_(pa.float64()), "xb": pa.list_(pa.float64())}
        kind = {n: left.schema.field(n).type for n in named} | {c: left.schema.field("id").type for c in "ab"} | empty
        return pa.table({n: pa.array([], kind[n]) for n in schema.names})

    found = a.groupBy(*names).cogroup(b.groupBy(*[f"r_{n}" for n in names])).applyInArrow(run, schema)
    found = found.withColumn("d", F.when(F.col("odd"), column(F.col("xa"), F.col("xb"))).otherwise(F.col("d")))
    if most is not None:
        found = found.filter(~F.col("odd") | (F.col("d") <= most))
    if give == "counts":
        found = found.withColumn("d", F.when(F.col("odd"), F.lit(1.0)).otherwise(F.col("d")))
    return found.select(*[F.col(n).alias(k) for k, n in zip(keys, named)], "a", "b", "d")
