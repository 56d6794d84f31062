"""Periods of long series, phases, and the choice of features: WIN-16 to WIN-18, CLU-19 to CLU-21.

Series are rows (entity, feature, idx, value) with idx from 0; a missing index counts as 0, a null value too. A series is cut in blocks of BLOCK
points, each with the points that its largest lag reaches beyond it, so no task holds a series.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 4096


def difference_sums(series: DataFrame, length: int, most: int, block: int | None = None) -> DataFrame:
    """WIN-17: entity, feature, lag, d for lags 0 to most - 1: the sum of (x[t] - x[t + lag])**2 over t < length - most."""
    block = max(block or BLOCK, 1)
    last = length - most  # points that are compared with later ones
    home = F.floor(F.col("idx") / block)
    reach = -(-(most - 1) // block)
    rows = series.filter(F.col("idx").between(0, length - 1)).select("entity", "feature", F.col("idx").cast("long").alias("idx"), F.coalesce(F.col("value").cast("double"), F.lit(0.0)).alias("value"))
    dealt = rows.withColumn("block", F.explode(F.sequence(F.greatest(F.lit(0).cast("long"), home - reach), home)))
    dealt = dealt.filter((F.col("idx") < (F.col("block") + 1) * block + most - 1) & (F.col("block") * block < max(0, last)))

    def run(key, batches: Iterator[pa.RecordBatch]):
        start = key[2].as_py() * block
        x = np.zeros(block + most)
        for batch in batches:
            x[batch.column("idx").to_numpy() - start] = batch.column("value").to_numpy()
        n = min(block, last - start)
        sums = [float(((x[:n] - x[lag : lag + n]) ** 2).sum()) for lag in range(most)]
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.string()), pa.array([key[1].as_py()], pa.string()), pa.array([sums])], names=["entity", "feature", "d"])

    parts = dealt.groupBy("entity", "feature", "block").applyInArrow(lambda key, table: _table(run, key, table), "entity string, feature string, d array<double>")
    return parts.select("entity", "feature", F.posexplode("d").alias("lag", "d")).groupBy("entity", "feature", "lag").agg(F.sum("d").alias("d"))


def _table(run, key, table: pa.Table) -> pa.Table:
    return pa.Table.from_batches(list(run(key, table.to_batches())))


def normalised(differences: DataFrame) -> DataFrame:
    """WIN-17: entity, feature, lag, d, c: d * (lag + 1) over the sum of d up to the lag; 1 at lag 0 and where that sum is 0."""
    upto = F.sum("d").over(Window.partitionBy("entity", "feature").orderBy("lag"))  # as many rows as lags
    return differences.withColumn("c", F.when((F.col("lag") == 0) | (upto == 0), 1.0).otherwise(F.col("d") * (F.col("lag") + 1) / upto))


def periods(curves: DataFrame, length: int, least: int, threshold: float) -> DataFrame:
    """WIN-17: entity, feature, lag, cycles: the end of the first dip under the threshold from lag `least` on, and length // lag; both 0 without one.

    A dip goes on as long as the next lag, if there is one, is lower still.
    """
    ahead = F.lead("c").over(Window.partitionBy("entity", "feature").orderBy("lag"))
    ends = curves.filter(F.col("lag") >= least).withColumn("ahead", ahead).filter((F.col("c") < threshold) & (F.col("ahead").isNull() | (F.col("ahead") >= F.col("c"))))
    first = ends.groupBy("entity", "feature").agg(F.min("lag").alias("found"))
    out = curves.select("entity", "feature").distinct().join(first, ["entity", "feature"], "left")
    return out.select("entity", "feature", F.coalesce("found", F.lit(0)).cast("int").alias("lag"), F.when(F.col("found") > 0, F.floor(F.lit(length) / F.col("found"))).otherwise(0).cast("long").alias("cycles"))


def periodic_features(found: DataFrame, most: int) -> DataFrame:
    """CLU-21: feature, n of features that have a period in more than `most` entities."""
    return found.filter("cycles > 0").groupBy("feature").agg(F.count("*").alias("n")).filter(F.col("n") > most)


def curve_weights(curves: DataFrame, lag: int) -> DataFrame:
    """WIN-18: feature, w: the mean over entities of 1 / c at a lag, scaled to a sum of 1; entities whose c is 0 there are left out."""
    mean = curves.filter((F.col("lag") == lag) & (F.col("c") != 0)).groupBy("feature").agg(F.avg(1 / F.col("c")).alias("m"))
    total = mean.agg(F.sum("m").alias("total"))  # one row
    return mean.join(F.broadcast(total)).select("feature", (F.col("m") / F.col("total")).alias("w"))


# --- phases --------------------------------------------------------------------------------------------------------

def rotated(x: Column, shift: Column) -> Column:
    """x moved to the right by shift, what leaves at one end coming in at the other; shift from 1 - size to size - 1."""
    k = F.pmod(shift, F.size(x))
    return F.when(k == 0, x).otherwise(F.concat(F.slice(x, F.size(x) - k + 1, k), F.slice(x, F.lit(1), F.size(x) - k)))


def circular_shifts(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """WIN-16: keys, shift: how far y is to be rotated to be most like x, over all features together.

    pairs: keys, feature, weight, x, y (arrays of one length). Likeness at a shift is the sum over features of weight times the cosine of x and the
    rotated y; of the shifts 1 - m to m - 1 the first of the best counts. A shift and the shift m higher rotate alike, so the first
    of the best is never above 0. A feature of zeros has cosine 0.
    """

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            out = []
            for w, x, y in zip(batch.column("weight").to_pylist(), batch.column("x").to_pylist(), batch.column("y").to_pylist()):
                x, y = np.array(x, np.float64), np.array(y, np.float64)
                m = len(x)
                turn = (np.arange(m)[None, :] - np.arange(m)[:, None]) % m  # row s: y moved to the right by s
                out.append((w * (y[turn] @ x) / (np.linalg.norm(x) * np.linalg.norm(y) + 1e-9)).tolist())
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), pa.array(out, pa.list_(pa.float64()))], names=[*keys, "likeness"])

    schema = ", ".join([*(f"`{k}` {pairs.schema[k].dataType.simpleString()}" for k in keys), "likeness array<double>"])
    each = pairs.select(*keys, "weight", "x", "y").mapInArrow(run, schema).select(*keys, F.size("likeness").alias("m"), F.posexplode("likeness").alias("s", "v"))
    total = each.groupBy(*keys, "m", "s").agg(F.round(F.sum("v"), 9).alias("v"))
    shift = F.when(F.col("s") == 0, 0).otherwise(F.col("s") - F.col("m"))  # the lowest of the shifts that rotate alike
    return total.groupBy(*keys).agg(F.max_by(shift, F.struct("v", -shift)).cast("int").alias("shift"))


def aligned(series: DataFrame, weights: DataFrame, distances: DataFrame) -> DataFrame:
    """WIN-16: entity, feature, values, shift, pivot: all series rotated to the pivot, the entity with the least distance sum (the first of equals).

    series: entity, feature, values of one length; weights: feature, w; distances: a, b, d in both directions.
    """
    pivot = distances.groupBy(F.col("a").alias("pivot")).agg(F.round(F.sum("d"), 9).alias("s")).agg(F.min_by("pivot", F.struct("s", "pivot")).alias("pivot"))  # one row
    held = series.join(F.broadcast(pivot), F.col("entity") == F.col("pivot")).select("feature", F.col("values").alias("x"), "pivot").join(weights.select("feature", F.col("w").alias("weight")), "feature")
    pairs = series.join(held, "feature").select("entity", "pivot", "feature", "weight", "x", F.col("values").alias("y"))
    shifts = circular_shifts(pairs, ["entity", "pivot"])
    return series.join(shifts, "entity").select("entity", "feature", rotated(F.col("values"), F.col("shift")).alias("values"), "shift", "pivot")


# --- features that say the same ------------------------------------------------------------------------------------

def correlation_votes(correlations: DataFrame, samples: int, alike: float, most: int) -> DataFrame:
    """CLU-19: fa, fb, share: of the samples the share in which two features correlate above `alike`, where these are more than `most`.

    correlations: fa, fb, r, a row for each sample and pair.
    """
    votes = correlations.groupBy("fa", "fb").agg(F.count_if(F.col("r") > alike).alias("votes")).filter(F.col("votes") > most)
    return votes.select("fa", "fb", (F.col("votes") / samples).alias("share"))


def chosen_features(features: list[str], shares: DataFrame) -> list[tuple[str, str]]:
    """CLU-20: (feature, kept or dropped), in the order of the decisions; shares: fa, fb, share of pairs of alike features.

    Of the features still open: (1) one that is like no other is kept; (2) one like all others is dropped, if some feature isn't like all;
    (3) if all are like each other, the one least like those kept stays and the rest go (the first, if none is kept yet); else the one least
    like the open ones is kept, and of those like it the one most like those kept is dropped (the first, if none is like them). The first of equals counts.
    The table has a row for each pair of features of a domain; it is read to the driver, and the decisions follow one another there.
    """
    like = {(a, b): s for x, y, s in shares.select("fa", "fb", "share").collect() for a, b in ((x, y), (y, x))}
    near = lambda f, of: sum(like.get((f, g), 0.0) for g in of if g != f)
    open_, kept, out = list(features), [], []

    def decide(f: str, what: str) -> None:
        open_.remove(f)
        out.append((f, what))
        if what == "kept":
            kept.append(f)

    while open_:
        links = {f: sum((f, g) in like for g in open_ if g != f) for f in open_}
        lone = next((f for f in open_ if not links[f]), None)
        every = [f for f in open_ if links[f] == len(open_) - 1]
        if lone is not None:
            decide(lone, "kept")
        elif every and len(every) < len(open_):
            decide(every[0], "dropped")
        elif every:
            decide(min(open_, key=lambda f: near(f, kept)) if kept else open_[0], "kept")
            for f in list(open_):
                decide(f, "dropped")
        else:
            stays = min(open_, key=lambda f: near(f, open_))
            beside = [f for f in open_ if (stays, f) in like]
            goes = max(beside, key=lambda f: near(f, kept))
            decide(stays, "kept")
            decide(goes, "dropped")
    return out
