"""Distances between series and alignment of their phases, on arrays and pairs (id, x)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import blocks


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def _zip(f: Callable[[Column, Column], Column]) -> Callable[[Column, Column], Column]:
    return lambda x, y: _sum(F.zip_with(x, y, f))


squared = _zip(lambda a, b: (a - b) * (a - b))
manhattan = _zip(lambda a, b: F.abs(a - b))
dot = _zip(lambda a, b: a * b)


def euclidean(x: Column, y: Column) -> Column:
    """CLU-01."""
    return F.sqrt(squared(x, y))


def normalised_euclidean(x: Column, y: Column) -> Column:
    """CLU-02: between the arrays scaled to length 1."""
    nx, ny = F.sqrt(dot(x, x)), F.sqrt(dot(y, y))
    return F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * dot(x, y) / (nx * ny)))


def _centred(x: Column) -> Column:
    m = _sum(x) / F.size(x)
    return F.transform(x, lambda v: v - m)


def pearson(x: Column, y: Column) -> Column:
    """CLU-05: 1 - correlation."""
    a, b = _centred(x), _centred(y)
    return 1 - dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def cross_correlations(x: Column, y: Column) -> Column:
    """WIN-16: normalised, zero-padded correlations for shifts 1-m to m-1."""
    m = F.size(x)
    norm = F.sqrt(dot(x, x) * dot(y, y))
    one = lambda s: F.aggregate(
        F.sequence(F.greatest(F.lit(0), s), F.least(m - 1, m - 1 + s)), F.lit(0.0), lambda a, i: a + F.get(x, i) * F.get(y, i - s)) / norm
    return F.transform(F.sequence(1 - m, m - 1), one)


def best_shift(x: Column, y: Column) -> Column:
    """WIN-16: the shift of the largest correlation, the first of equals."""
    c = F.transform(cross_correlations(x, y), lambda v: F.round(v, 9))
    return F.array_position(c, F.array_max(c)).cast("int") - F.size(x)


def shape_based(x: Column, y: Column) -> Column:
    """CLU-06: 1 - the largest correlation over shifts."""
    return 1 - F.array_max(cross_correlations(x, y))


def histogram(x: Column, bins: int = 50) -> Column:
    """AGG-19: share of values in equal bins of [0, 1); 1 itself falls in the last."""
    at = F.transform(x, lambda v: F.least(F.lit(bins - 1), F.floor(v * bins).cast("int")))
    return F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda b: F.size(F.filter(at, lambda v: v == b)) / F.size(x))


def symmetric_divergence(x: Column, y: Column, bins: int = 50, e: float = 1e-8) -> Column:
    """CLU-07: Kullback-Leibler divergence in both directions, of histograms."""
    fixed = lambda h: F.transform(h, lambda v: (v + e) / (1 + bins * e))
    return _zip(lambda p, q: (p - q) * F.log(p / q))(fixed(histogram(x, bins)), fixed(histogram(y, bins)))


def wasserstein(x: Column, y: Column) -> Column:
    """CLU-08, for arrays of one length."""
    return manhattan(F.array_sort(x), F.array_sort(y)) / F.size(x)


#: EXT-02: distances by name.
DISTANCES: dict[str, Callable[[Column, Column], Column]] = {
    "euclidean": euclidean, "normalised_euclidean": normalised_euclidean, "squared": squared, "manhattan": manhattan, "pearson": pearson,
    "shape_based": shape_based, "symmetric_divergence": symmetric_divergence, "wasserstein": wasserstein,
}

#: The same of blocks of rows; a distance without one is left to its expression.
BLOCKS: dict[str, blocks.Block] = {
    "euclidean": blocks.euclidean, "normalised_euclidean": blocks.normalised_euclidean, "squared": blocks.squared, "manhattan": blocks.manhattan, "pearson": blocks.pearson,
    "shape_based": blocks.shape_based, "symmetric_divergence": blocks.symmetric_divergence(), "wasserstein": blocks.wasserstein,
}


def register_distance(name: str, fn: Callable[[Column, Column], Column], block: blocks.Block | None = None) -> None:
    DISTANCES[name] = fn
    BLOCKS.pop(name, None)
    if block:
        BLOCKS[name] = block


def pairwise(df: DataFrame, name: str, both: bool = False) -> DataFrame:
    """JN-10, CLU-09: a, b, d of all pairs of a small set (a < b); spread over partitions by a."""
    a, b = df.select(F.col("id").alias("a"), F.col("x").alias("xa")), df.select(F.col("id").alias("b"), F.col("x").alias("xb"))
    out = a.join(b, F.col("a") < F.col("b")).select("a", "b", DISTANCES[name](F.col("xa"), F.col("xb")).alias("d"))
    return out.unionByName(out.select(F.col("b").alias("a"), F.col("a").alias("b"), "d")) if both else out


def paired(queries: DataFrame, df: DataFrame, slices: int = 64) -> DataFrame:
    """JN-10: a, xa, b, xb: each of a stated set of queries with every other row, in blocks: a slice of the rows with all queries."""
    a = queries.select(F.col("id").alias("a"), F.col("x").alias("xa"), F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("_slice"))
    b = df.select(F.col("id").alias("b"), F.col("x").alias("xb"), F.pmod(F.xxhash64("id"), F.lit(slices)).cast("int").alias("_slice")).repartition(slices, "_slice")
    return a.join(b, "_slice").filter("a <> b").drop("_slice")


def against(queries: DataFrame, df: DataFrame, name: str) -> DataFrame:
    """CLU-01 to 08: a, b, d of a stated set of queries against all rows."""
    if name in BLOCKS:
        return blocks.cells(queries, df, [], BLOCKS[name], DISTANCES[name])
    return paired(queries, df).select("a", "b", DISTANCES[name](F.col("xa"), F.col("xb")).alias("d"))


def best_shifts(queries: DataFrame, df: DataFrame) -> DataFrame:
    """WIN-16: a, b, shift of a stated set of queries against all rows."""
    return blocks.cells(queries, df, [], blocks.best_shift, lambda x, y: best_shift(x, y).cast("double")).select("a", "b", F.col("d").cast("int").alias("shift"))


def within(df: DataFrame, name: str, key: str, upper: bool = False, most: float | None = None) -> DataFrame:
    """JN-10, CLU-09: key, a, b, d of all pairs (both directions; upper: a < b) of rows with one key, as the entities of one domain are; most: only up to it."""
    if name in BLOCKS:
        return blocks.cells(df, df, [key], BLOCKS[name], DISTANCES[name], most=most, upper=upper)
    a, b = df.select(key, F.col("id").alias("a"), F.col("x").alias("xa")), df.select(key, F.col("id").alias("b"), F.col("x").alias("xb"))
    out = a.join(b, key).filter("a < b" if upper else "a <> b").select(key, "a", "b", DISTANCES[name](F.col("xa"), F.col("xb")).alias("d"))
    return out if most is None else out.filter(F.col("d") <= most)


def sums_within(df: DataFrame, name: str, key: str) -> DataFrame:
    """CLU-14: key, a, s: the sum of each row's distances to the others of its key; no table of pairs."""
    each = blocks.cells(df, df, [key], BLOCKS[name], DISTANCES[name], give="sums") if name in BLOCKS else within(df, name, key)
    return each.groupBy(key, "a").agg(F.sum("d").alias("s"))


def max_column_sum(df: DataFrame) -> DataFrame:
    """CLU-03: the matrix 1-norm of the difference of two multivariate series: the largest sum over features at one time."""
    rows = df.select("entity", "feature", "bucket_ts", "value")
    both = rows.alias("l").join(rows.alias("r"), (F.col("l.feature") == F.col("r.feature")) & (F.col("l.bucket_ts") == F.col("r.bucket_ts")) & (F.col("l.entity") < F.col("r.entity")))
    by = both.groupBy(F.col("l.entity").alias("a"), F.col("r.entity").alias("b"), F.col("l.bucket_ts").alias("t")).agg(F.sum(F.abs(F.col("l.value") - F.col("r.value"))).alias("s"))
    return by.groupBy("a", "b").agg(F.max("s").alias("d"))


def weighted_euclidean(df: DataFrame, weights: DataFrame) -> DataFrame:
    """CLU-01: sum over features of weight times distance; df: entity, feature, values of one length."""
    a, b = df.select(F.col("entity").alias("a"), "feature", F.col("values").alias("xa")), df.select(F.col("entity").alias("b"), "feature", F.col("values").alias("xb"))
    pairs = a.join(b, "feature").filter("a < b").join(weights, "feature")
    return pairs.groupBy("a", "b").agg(F.sum(F.col("w") * euclidean(F.col("xa"), F.col("xb"))).alias("d"))


def nearest_centre(df: DataFrame, centres: DataFrame, name: str = "euclidean") -> DataFrame:
    """JN-11, STR-06: the nearest of a few centres, the first of equals."""
    pairs = df.crossJoin(F.broadcast(centres.select(F.col("id").alias("center"), F.col("x").alias("c"))))
    d = pairs.select("id", "center", F.round(DISTANCES[name](F.col("x"), F.col("c")), 9).alias("d"))
    return d.groupBy("id").agg(F.min(F.struct("d", "center")).alias("m")).select("id", F.col("m.center").alias("center"), F.col("m.d").alias("d"))


def difference_function(x: Column, most: int) -> Column:
    """WIN-17: sum of squared differences at lags 0 to most - 1."""
    n = F.size(x)
    one = lambda lag: F.aggregate(F.sequence(F.lit(0), n - most - 1), F.lit(0.0), lambda a, i: a + F.pow(F.get(x, i) - F.get(x, i + lag), F.lit(2.0)))
    return F.transform(F.sequence(F.lit(0), F.lit(most - 1)), one)


def cumulative_mean_normalised(d: Column) -> Column:
    """WIN-17: d(lag) * lag / sum of d to lag; 1 at lag 0."""
    return F.transform(F.sequence(F.lit(0), F.size(d) - 1), lambda lag: F.when(lag == 0, 1.0).otherwise(F.get(d, lag) * lag / (_sum(F.slice(d, 2, F.greatest(lag, F.lit(1)))) + 1e-8)))


def feature_correlations(df: DataFrame) -> DataFrame:
    """CLU-19: correlation of each pair of features within an entity; null with under three rows or a constant feature."""
    a = df.select("entity", F.col("feature").alias("fa"), "bucket_ts", F.col("value").alias("va"))
    b = df.select("entity", F.col("feature").alias("fb"), "bucket_ts", F.col("value").alias("vb"))
    return a.join(b, ["entity", "bucket_ts"]).filter("fa < fb").groupBy("entity", "fa", "fb").agg(
        F.when((F.count("*") >= 3) & (F.stddev_pop("va") > 1e-9) & (F.stddev_pop("vb") > 1e-9), F.corr("va", "vb")).alias("r"))
