"""Scores to thresholds to flags, and how good they are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .relational import f1

KEYS = ["entity", "feature"]


def percentile_flags(df: DataFrame, q: float = 0.99, value: str = "value") -> DataFrame:
    """DET-01: 1 above the q-quantile of the series; any_flag: 1 if a feature of the entity is flagged at that time."""
    high = df.groupBy(*KEYS).agg(F.round(F.percentile(value, q), 6).alias("high"))
    rows = df.join(high, KEYS).withColumn("flag", (F.col(value) > F.col("high")).cast("int")).drop("high")
    return rows.withColumn("any_flag", F.max("flag").over(Window.partitionBy("entity", "bucket_ts")))


def point_adjusted(df: DataFrame, keys: list[str], order: str = "idx", pred: str = "pred", label: str = "label") -> DataFrame:
    """WIN-14: a hit anywhere in a run of true labels marks the whole run; late: rows marked that way before the first hit."""
    w = Window.partitionBy(*keys).orderBy(order)
    rows = df.withColumn("_new", ((F.col(label) == 1) & (F.coalesce(F.lag(label).over(w), F.lit(0)) == 0)).cast("int"))
    rows = rows.withColumn("_run", F.when(F.col(label) == 1, F.sum("_new").over(w)))
    run = Window.partitionBy(*keys, "_run")
    hit = (F.col(label) == 1) & (F.max(pred).over(run) == 1)
    first = F.min(F.when(F.col(pred) == 1, F.col(order))).over(run)
    return rows.withColumn("adjusted", F.when(hit, 1).otherwise(F.col(pred))).withColumn("late", (hit & (F.col(order) < first)).cast("int")).drop("_new", "_run")


def latency(adjusted: DataFrame, keys: list[str]) -> DataFrame:
    """Rows marked before the first hit, over the runs that were hit."""
    w = Window.partitionBy(*keys).orderBy("idx")
    begin = ((F.col("label") == 1) & (F.col("adjusted") == 1) & ((F.coalesce(F.lag("label").over(w), F.lit(0)) == 0))).cast("int")
    return adjusted.withColumn("_run", begin).groupBy(*keys).agg((F.sum("late") / (F.sum("_run") + 1e-4)).alias("latency"))


def best_f1_search(df: DataFrame, start: float, end: float, steps: int, keys: list[str], last_wins: bool = True) -> DataFrame:
    """DET-02: the threshold of the best point-adjusted F1 among `steps` even ones; the last of equals wins.

    A run of true labels is wholly hit at a threshold if its highest score is above it, so adjusted counts follow from run
    maxima. Each maximum (or normal score) is filed under the number of thresholds below it, and running sums of these
    counts serve all thresholds at once: one pass over the series, however many steps there are.
    """
    w = Window.partitionBy(*keys).orderBy("idx")
    rows = df.withColumn("_new", ((F.col("label") == 1) & (F.coalesce(F.lag("label").over(w), F.lit(0)) == 0)).cast("int"))
    rows = rows.withColumn("_run", F.when(F.col("label") == 1, F.sum("_new").over(w)))
    runs = rows.filter("label = 1").groupBy(*keys, "_run").agg(F.max("score").alias("top"), F.count("*").alias("p")).select(*keys, "top", "p", F.lit(0).cast("long").alias("q"))
    pieces = runs.unionByName(rows.filter("label = 0").select(*keys, F.col("score").alias("top"), F.lit(0).cast("long").alias("p"), F.lit(1).cast("long").alias("q")))
    step = (end - start) / steps
    at = lambda i: F.lit(start) + i * step
    guess = F.floor((F.col("top") - start) / step)
    under = F.when(at(guess + 1) < F.col("top"), guess + 1).when(at(guess) < F.col("top"), guess).otherwise(guess - 1)  # thresholds below the score
    counts = pieces.groupBy(*keys, F.least(F.greatest(under, F.lit(0)), F.lit(steps)).cast("long").alias("i")).agg(F.sum("p").alias("p"), F.sum("q").alias("q"))
    each = (counts.select(*keys).distinct() if keys else df.sparkSession.range(1).select()).crossJoin(F.broadcast(df.sparkSession.range(steps + 1).withColumnRenamed("id", "i")))
    down = Window.partitionBy(*keys).orderBy(F.desc("i")).rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy(*keys)
    full = each.join(counts, [*keys, "i"], "left").fillna(0, ["p", "q"])
    over = full.select(
        *keys, "i", at(F.col("i")).alias("threshold"), F.sum("p").over(down).alias("tp"), (F.sum("p").over(every) - F.sum("p").over(down)).alias("fn"),
        F.sum("q").over(down).alias("fp"), (F.sum("q").over(every) - F.sum("q").over(down)).alias("tn")).filter("i > 0")
    order = F.struct(F.round("f1", 9).alias("a"), (F.col("threshold") if last_wins else -F.col("threshold")).alias("b"))
    best = f1(over).groupBy(*keys) if keys else f1(over).groupBy()
    return best.agg(F.max_by(F.struct("threshold", "f1", "precision", "recall", "tp", "fp", "fn", "tn"), order).alias("x")).select(*keys, "x.*")


def find_epsilon(df: DataFrame, keys: list[str], buffer: int = 49, value: str = "score") -> DataFrame:
    """DET-07: the error threshold mean + z * deviation, z from 2.5 to 11.5, whose removal changes mean and deviation most.

    A threshold is out if flagged rows with their buffers are half of the series or more; without any, it is the maximum.
    """
    base = df.groupBy(*keys).agg(F.avg(value).alias("m"), F.stddev_pop(value).alias("s"), F.count("*").alias("n"), F.max(value).alias("top"))
    grid = df.sparkSession.range(5, 24).select((F.col("id") / 2).alias("z"))
    rows = df.join(base, keys).crossJoin(F.broadcast(grid)).withColumn("eps", F.col("m") + F.col("s") * F.col("z"))
    flag = (F.col(value) >= F.col("eps")).cast("int")
    near = F.max(flag).over(Window.partitionBy(*keys, "z").orderBy("idx").rangeBetween(-buffer, buffer))
    rows = rows.withColumn("near", near).withColumn("flag", flag)
    by = rows.groupBy(*keys, "z", "m", "s", "n", "eps").agg(F.sum("near").alias("hit"), F.avg(F.when(F.col("flag") == 0, F.col(value))).alias("pm"), F.stddev_pop(F.when(F.col("flag") == 0, F.col(value))).alias("ps"))
    score = ((F.col("m") - F.col("pm")) / F.col("m") + (F.col("s") - F.col("ps")) / F.col("s")) / F.col("hit")
    good = by.filter((F.col("hit") > 0) & (F.col("hit") < F.col("n") * 0.5)).withColumn("gain", F.round(score, 9))
    best = good.groupBy(*keys).agg(F.max_by("eps", F.struct("gain", "z")).alias("epsilon"))
    return base.select(*keys, "top").join(best, keys, "left").select(*keys, F.coalesce("epsilon", "top").alias("epsilon"))


def threshold_sweep(df: DataFrame, keys: list[str], steps: int = 400) -> DataFrame:
    """WIN-24: F1 where the scores above each of `steps` ranks are taken for anomalies.

    By ranks: the rows above a rank and the true ones among them are running sums, so no step rereads the series.
    """
    w = Window.partitionBy(*keys).orderBy("score", "idx")
    every = Window.partitionBy(*keys)
    ranked = df.withColumn("rank", F.row_number().over(w)).withColumn("n", F.count("*").over(every)).withColumn("pos", F.sum("label").over(every)).withColumn("below", F.sum("label").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    step = ranked.select(*keys, "n", "pos", F.col("rank").alias("cut"), "below").unionByName(ranked.groupBy(*keys).agg(F.max("n").alias("n"), F.max("pos").alias("pos")).withColumn("cut", F.lit(0)).withColumn("below", F.lit(0).cast("long")))
    # step i predicts ranks over i * n / steps: cut is the largest rank not over it
    i0, i1 = F.ceil(F.col("cut") * steps / F.col("n")), F.ceil((F.col("cut") + 1) * steps / F.col("n")) - 1
    out = step.withColumn("i0", i0).withColumn("i1", F.least(i1, F.lit(steps - 1))).filter("i0 <= i1").withColumn("step", F.explode(F.sequence("i0", "i1")))
    tp, predicted = F.col("pos") - F.col("below"), F.col("n") - F.col("cut")
    return out.select(*keys, "step", (F.when(predicted + F.col("pos") == 0, 0.0).otherwise(2 * tp / (predicted + F.col("pos")))).alias("f1"))


def auc(df: DataFrame, keys: list[str]) -> DataFrame:
    """DET-08: area under the ROC curve, by mean ranks."""
    w = Window.partitionBy(*keys)
    n_eq = F.count("*").over(Window.partitionBy(*keys, "score"))
    rank = F.rank().over(w.orderBy("score")) + (n_eq - 1) / 2
    r = df.withColumn("r", rank).groupBy(*keys).agg(F.sum(F.when(F.col("label") == 1, F.col("r"))).alias("s"), F.sum("label").alias("p"), F.count("*").alias("n"))
    return r.select(*keys, ((F.col("s") - F.col("p") * (F.col("p") + 1) / 2) / (F.col("p") * (F.col("n") - F.col("p")))).alias("auc"))


def top_feature_sums(df: DataFrame, k: int) -> DataFrame:
    """DET-08, RNK-04: sum of the k largest feature errors at each time."""
    rank = F.row_number().over(Window.partitionBy("entity", "bucket_ts").orderBy(F.desc("value"), "feature"))
    return df.withColumn("r", rank).filter(F.col("r") <= k).groupBy("entity", "bucket_ts").agg(F.sum("value").alias("score"))


def contamination_flags(df: DataFrame, keys: list[str], contamination: float) -> DataFrame:
    """DET-09."""
    high = df.groupBy(*keys).agg(F.round(F.percentile("score", 1 - contamination), 6).alias("high"))
    return df.join(high, keys).withColumn("pred", (F.col("score") > F.col("high")).cast("int")).drop("high")


def blended(g: Column, d: Column, share: float = 0.95) -> Column:
    """DET-10."""
    return share * g + (1 - share) * d


def adaptive_choice(df: DataFrame, steps: int = 100) -> DataFrame:
    """DET-11: per entity model A if its summed score is at most a limit, else B; the limit of best overall F1, the first of equals.

    df: entity, total, and tp/fp/fn of models a and b.
    """
    span = df.agg(F.min("total").alias("lo"), F.max("total").alias("hi"))
    grid = df.sparkSession.range(steps + 1).crossJoin(span).select("id", (F.col("lo") + F.col("id") * (F.col("hi") - F.col("lo")) / steps).alias("limit"))
    pick = lambda c: F.sum(F.when(F.col("total") <= F.col("limit"), F.col(f"{c}_a")).otherwise(F.col(f"{c}_b"))).alias(c)
    by = f1(df.crossJoin(F.broadcast(grid)).groupBy("id", "limit").agg(pick("tp"), pick("fp"), pick("fn")))
    return by.groupBy().agg(F.max_by(F.struct("id", "limit", "f1"), F.struct(F.round("f1", 9).alias("a"), (-F.col("id")).alias("b"))).alias("x")).select("x.*")


def k_sigma_bounds(train: DataFrame, test: DataFrame, k: float = 3.0) -> DataFrame:
    """DET-12: rows outside mean +- k deviations of the training rows of their series."""
    fit = train.groupBy(*KEYS).agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"))
    return test.join(fit, KEYS).filter((F.col("value") > F.col("m") + k * F.col("s")) | (F.col("value") < F.col("m") - k * F.col("s"))).select(*test.columns)


def anomaly_listing(flags: DataFrame) -> DataFrame:
    """DET-13: entity and time with the names of the flagged features."""
    return flags.filter("flag = 1").groupBy("entity", "bucket_ts").agg(F.array_sort(F.collect_list("feature")).alias("features"))


def robust_scaled(df: DataFrame, value: str = "value") -> DataFrame:
    """DET-16: (value - median) / (1 + interquartile range) of the series."""
    fit = df.groupBy(*KEYS).agg(F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"))
    return df.join(fit, KEYS).withColumn("scaled", (F.col(value) - F.col("q")[1]) / (1 + F.col("q")[2] - F.col("q")[0])).drop("q")


def mean_over_features(df: DataFrame, value: str = "scaled") -> DataFrame:
    """DET-14g: one score for each entity and time."""
    return df.groupBy("entity", "bucket_ts").agg(F.avg(value).alias("score"))


def without_baseline_extremes(df: DataFrame, share: float = 0.05) -> DataFrame:
    """DET-17: where the squared distance from the baseline is among the smallest or largest, only the baseline stays."""
    w = Window.partitionBy(*KEYS)
    rows = df.withColumn("_d", F.round(F.pow(F.col("value") - F.col("baseline"), F.lit(2.0)), 6))
    rows = rows.withColumn("_lo", F.row_number().over(w.orderBy("_d", "bucket_ts"))).withColumn("_hi", F.row_number().over(w.orderBy(F.desc("_d"), "bucket_ts"))).withColumn("_n", F.floor(F.count("*").over(w) * share / 2))
    return rows.withColumn("clean", F.when((F.col("_lo") <= F.col("_n")) | (F.col("_hi") <= F.col("_n")), F.col("baseline")).otherwise(F.col("value"))).drop("_d", "_lo", "_hi", "_n")


def range_scaled(df: DataFrame, keys: list[str], top: float = 1000.0) -> DataFrame:
    """DET-18."""
    w = Window.partitionBy(*keys)
    low, high = F.min("score").over(w), F.max("score").over(w)
    return df.withColumn("scaled", (F.col("score") - low) / F.when(high == low, 1.0).otherwise(high - low) * top)


def boundary_suppressed(df: DataFrame, boundaries: list[int], reach: int = 19) -> DataFrame:
    """WIN-25: scores within reach of a boundary between channels become 0, then each channel goes to [0, 1]."""
    near = F.lit(False)
    for b in boundaries:
        near = near | F.col("idx").between(b - reach, b + reach)
    rows = df.withColumn("score", F.when(near, 0.0).otherwise(F.col("score")))
    return range_scaled(rows, ["entity"], 1.0)


def expanded(df: DataFrame, keys: list[str], reach: int = 49, gap: int = 1) -> DataFrame:
    """WIN-26: groups of flagged rows with their surroundings, parted where indices are more than gap apart: first and last row."""
    w = Window.partitionBy(*keys).orderBy("idx")
    rows = df.withColumn("near", F.max("flag").over(w.rangeBetween(-reach, reach))).filter("near = 1")
    rows = rows.withColumn("_new", (F.coalesce(F.col("idx") - F.lag("idx").over(w), F.lit(gap + 1)) > gap).cast("int")).withColumn("group", F.sum("_new").over(w))
    return rows.groupBy(*keys, "group").agg(F.min("idx").alias("first"), F.max("idx").alias("last"))


def error_spread(df: DataFrame, keys: list[str], share: float = 0.1) -> DataFrame:
    """AGG-14: median, interquartile range, quantile difference and trimmed mean of absolute errors."""
    e = F.abs(F.col("predicted") - F.col("actual"))
    w = Window.partitionBy(*keys)
    rows = df.withColumn("e", F.round(e, 6)).withColumn("r", F.row_number().over(w.orderBy("e", "idx"))).withColumn("n", F.count("*").over(w))
    cut = F.floor(F.col("n") * share)
    inside = (F.col("r") > cut) & (F.col("r") <= F.col("n") - cut)
    q = lambda p: F.percentile("e", p)
    return rows.groupBy(*keys).agg(q(0.5).alias("median"), (q(0.75) - q(0.25)).alias("iqr"), (q(1 - share) - q(share)).alias("spread"), F.avg(F.when(inside, F.col("e"))).alias("trimmed"))
