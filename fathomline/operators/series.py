"""Projections, filters and windows on long series (entity, feature, bucket_ts, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ["entity", "feature"]


def _by(keys=None, order="bucket_ts"):
    return Window.partitionBy(*(keys or KEYS)).orderBy(order)


# --- projections and alignment -------------------------------------------------------------------------------------

def bucket_index(ts: Column, start: Column, size: int) -> Column:
    """PRJ-04: index of the bucket a time is in."""
    return F.floor((ts - start) / size)


def checked_bucket_index(df: DataFrame, start: int, size: int, buckets: int) -> DataFrame:
    """PRJ-04 with an error for times outside the buckets."""
    i = bucket_index(F.col("ts"), F.lit(start), size)
    return df.withColumn("idx", F.when((i >= 0) & (i < buckets), i).otherwise(F.raise_error(F.concat(F.lit("time outside the buckets: "), F.col("ts").cast("string"))).cast("long")))


def pack(df: DataFrame) -> DataFrame:
    """PRJ-01/03: a row per series, values in order of time."""
    return df.groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.struct("bucket_ts", "value"))).alias("x")).select(*KEYS, F.col("x.bucket_ts").alias("ts"), F.col("x.value").alias("values"))


def unpack(df: DataFrame) -> DataFrame:
    """PRJ-02: the rows of packed series, with their index."""
    return df.select(*KEYS, F.posexplode("values").alias("idx", "value"))


def pivot_features(df: DataFrame, features: list[str]) -> DataFrame:
    """PRJ-03: a row per entity and time, a column per feature."""
    return df.groupBy("entity", "bucket_ts").pivot("feature", features).agg(F.first("value"))


def index_to_time(df: DataFrame, start: int, size: int, buckets: int, align: str = "tail", window: int = 1) -> DataFrame:
    """PRJ-05/06/07: time of the idx-th of a series' results.

    tail: results end where the buckets end; head: they begin where the buckets begin; window: result i belongs to the last
    bucket of the i-th window.
    """
    n = F.count("*").over(Window.partitionBy(*KEYS))
    offset = {"tail": F.lit(buckets) - n, "head": F.lit(0), "window": F.lit(window - 1)}[align]
    return df.withColumn("bucket_ts", (F.lit(start) + (offset + F.col("idx")) * size).cast("long"))


def inferred_bucket(df: DataFrame, default: int = 60) -> DataFrame:
    """PRJ-08: smallest gap of each series."""
    gaps = df.withColumn("gap", F.col("bucket_ts") - F.lag("bucket_ts").over(_by()))
    return gaps.groupBy(*KEYS).agg(F.coalesce(F.min("gap"), F.lit(default)).alias("bucket"))


def padded_templates(known: DataFrame, n: int) -> DataFrame:
    """PRJ-09: templates 0 to n-1, unknown ones named so."""
    ids = known.sparkSession.range(n).select(F.col("id").cast("int").alias("template_id"))
    return ids.join(known, "template_id", "left").select("template_id", F.coalesce("text", F.format_string("<UNKNOWN_PATTERN_%d>", "template_id")).alias("text"))


def padded_entities(df: DataFrame, n: int, by: list[str]) -> DataFrame:
    """PRJ-10: entities 0 to n-1 for each time (and feature); missing ones are 0."""
    grid = df.select(*by).distinct().select(*by, F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("entity_no"))
    return grid.join(df, ["entity_no", *by], "left").select(*by, "entity_no", F.coalesce("value", F.lit(0.0)).alias("value"))


def dense(df: DataFrame, fill: float = 0.0) -> DataFrame:
    """Every series has a row at every bucket that any has; missing values are `fill`."""
    buckets = df.agg(F.array_sort(F.collect_set("bucket_ts")).alias("all"))  # one row: the buckets of the time covered
    grid = df.select("entity", "feature").distinct().crossJoin(buckets).select("entity", "feature", F.explode("all").alias("bucket_ts"))
    return grid.join(df, ["entity", "feature", "bucket_ts"], "left").withColumn("value", F.coalesce("value", F.lit(fill)))


def repeated_entities(df: DataFrame, n: int) -> DataFrame:
    """PRJ-10: one entity's rows repeated for n entities."""
    return df.select(F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("entity_no"), "*")


def common_tail(a: DataFrame, b: DataFrame, key: str = "entity") -> DataFrame:
    """PRJ-11: the last rows of a, as many as both have for a key."""
    n = b.groupBy(key).agg(F.count("*").alias("nb"))
    w = Window.partitionBy(key)
    last = F.row_number().over(w.orderBy(F.desc("bucket_ts")))
    return a.withColumn("r", last).withColumn("na", F.count("*").over(w)).join(n, key).filter(F.col("r") <= F.least("na", "nb")).drop("r", "na", "nb")


def segments(df: DataFrame, length: int) -> DataFrame:
    """PRJ-12: number of the segment of `length` rows each row is in."""
    return df.withColumn("segment", F.floor((F.row_number().over(_by()) - 1) / length))


def sliding_split(df: DataFrame, width: int, step: int) -> DataFrame:
    """PRJ-13: windows of width rows, every step rows, that end before the last row."""
    w = _by()
    rows = df.withColumn("i", F.row_number().over(w) - 1).withColumn("n", F.count("*").over(Window.partitionBy(*KEYS)))
    rows = rows.withColumn("values", F.collect_list("value").over(w.rowsBetween(0, width - 1)))
    return rows.filter((F.col("i") % step == 0) & (F.col("i") + width < F.col("n") - 1)).select(*KEYS, F.col("i").alias("start"), "values")


def clamped_slice(df: DataFrame, start: int, end: int) -> DataFrame:
    """PRJ-14, FLT-01: rows of a closed range of time."""
    return df.filter(F.col("bucket_ts").between(start, end))


def half_open(df: DataFrame, date: str, span: str, ts: str = "ts", zone_hours: int = 8) -> DataFrame:
    """FLT-02: rows within HHMM_HHMM of a local day, the end excluded."""
    day = F.unix_timestamp(F.lit(date), "yyyy-MM-dd") - zone_hours * 3600
    a, b = span.split("_")
    at = lambda x: day + int(x[:2]) * 3600 + int(x[2:]) * 60
    return df.filter((F.col(ts) >= at(a)) & (F.col(ts) < at(b)))


def frequent(df: DataFrame, keys: list[str], least: int) -> DataFrame:
    """FLT-07: rows whose keys come `least` times or more."""
    return df.withColumn("n", F.count("*").over(Window.partitionBy(*keys))).filter(F.col("n") >= least)


def with_fallback(df: DataFrame, count: str, group: list[str], wanted: int = 2) -> DataFrame:
    """FLT-08: rows counted `wanted` times or more, or, in a group that has none, all."""
    top = F.max(count).over(Window.partitionBy(*group))
    return df.withColumn("_top", top).filter(F.col(count) >= F.when(F.col("_top") >= wanted, wanted).otherwise(1)).drop("_top")


def value_audit(df: DataFrame) -> DataFrame:
    """FLT-11: not-a-number, infinite and largest values by feature."""
    inf = F.abs("value") == float("inf")
    return df.groupBy("feature").agg(F.count("*").alias("n"), F.sum(F.isnan("value").cast("long")).alias("nans"), F.sum(inf.cast("long")).alias("infs"), F.max(F.when(~inf & ~F.isnan("value"), F.abs("value"))).alias("largest"))


def shape_audit(a: DataFrame, b: DataFrame) -> DataFrame:
    """FLT-12: series whose lengths differ between two sets."""
    size = lambda d, c: d.groupBy(*KEYS).agg(F.count("*").alias(c))
    return size(a, "na").join(size(b, "nb"), KEYS, "full_outer").select(*KEYS, F.coalesce("na", F.lit(0)).alias("na"), F.coalesce("nb", F.lit(0)).alias("nb")).filter("na <> nb")


# --- windows -------------------------------------------------------------------------------------------------------

def trailing_mean(df: DataFrame, width: int = 5) -> DataFrame:
    """WIN-01."""
    return df.withColumn("smooth", F.avg("value").over(_by().rowsBetween(1 - width, 0)))


def trailing_median(df: DataFrame, width: int = 12) -> DataFrame:
    """WIN-02."""
    return df.withColumn("smooth", F.percentile("value", 0.5).over(_by().rowsBetween(1 - width, 0)))


def interpolated(df: DataFrame) -> DataFrame:
    """WIN-03: missing values on the line between neighbours, the nearest at the ends, 0 if there is none."""
    w = _by()
    have = lambda c: F.when(F.col("value").isNotNull(), F.col(c))
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    out = df.withColumn("t0", F.last(have("bucket_ts"), True).over(back)).withColumn("v0", F.last("value", True).over(back))
    out = out.withColumn("t1", F.first(have("bucket_ts"), True).over(ahead)).withColumn("v1", F.first("value", True).over(ahead))
    line = F.col("v0") + (F.col("v1") - F.col("v0")) * (F.col("bucket_ts") - F.col("t0")) / F.nullif(F.col("t1") - F.col("t0"), F.lit(0))
    return out.withColumn("filled", F.coalesce("value", line, "v0", "v1", F.lit(0.0))).drop("t0", "v0", "t1", "v1")


def without_deviants(df: DataFrame, share: float = 0.05) -> DataFrame:
    """WIN-04: the share of values farthest from the mean become 0 (none if the share is less than one row)."""
    w = Window.partitionBy(*KEYS)
    far = F.round(F.abs(F.col("value") - F.avg("value").over(w)), 6)
    rows = df.withColumn("far", far).withColumn("r", F.row_number().over(w.orderBy(F.desc("far"), "bucket_ts")))
    return rows.withColumn("clean", F.when(F.col("r") <= F.floor(F.count("*").over(w) * share), 0.0).otherwise(F.col("value"))).drop("far", "r")


def without_extremes(df: DataFrame, share: float = 0.05) -> DataFrame:
    """WIN-05: the smallest and the largest values become 0."""
    w = Window.partitionBy(*KEYS)
    n = F.floor(F.count("*").over(w) * share / 2)
    low, high = F.row_number().over(w.orderBy("value", "bucket_ts")), F.row_number().over(w.orderBy(F.desc("value"), "bucket_ts"))
    return df.withColumn("lo", low).withColumn("hi", high).withColumn("n", n).withColumn("clean", F.when((F.col("lo") <= F.col("n")) | (F.col("hi") <= F.col("n")), 0.0).otherwise(F.col("value"))).drop("lo", "hi", "n")


def scaled(df: DataFrame, mode: str = "standardize") -> DataFrame:
    """WIN-06: each series to mean 0 and deviation 1, or to [0, 1]."""
    w = Window.partitionBy(*KEYS)
    if mode == "standardize":
        sd = F.stddev_pop("value").over(w)
        return df.withColumn("scaled", (F.col("value") - F.avg("value").over(w)) / F.when(sd < 1e-12, 1.0).otherwise(sd))
    low, high = F.min("value").over(w), F.max("value").over(w)
    return df.withColumn("scaled", (F.col("value") - low) / F.when(high == low, 1.0).otherwise(high - low))


def minmax_fit_apply(train: DataFrame, test: DataFrame) -> DataFrame:
    """WIN-07: test to [-1, 1] by the training range of its feature, clipped."""
    fit = train.groupBy("feature").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    x = (F.col("value") - F.col("lo")) / F.when(F.col("hi") == F.col("lo"), 1.0).otherwise(F.col("hi") - F.col("lo")) * 2 - 1
    return test.join(fit, "feature").withColumn("scaled", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x))).drop("lo", "hi")


def meanstd_fit_apply(train: DataFrame, test: DataFrame, k: float = 2.0) -> DataFrame:
    """WIN-08: fit, clip to k deviations, fit anew; test is clipped and scaled by the second fit."""
    one = train.groupBy("feature").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"))
    clip = F.greatest(F.col("m") - k * F.col("s"), F.least(F.col("m") + k * F.col("s"), F.col("value")))
    two = train.join(one, "feature").withColumn("value", clip).groupBy("feature").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s0"))
    two = two.withColumn("s", F.when(F.col("s0") < 1e-12, 1e-3).otherwise(F.col("s0"))).drop("s0")
    return test.join(two, "feature").withColumn("scaled", (clip - F.col("m")) / F.col("s")).drop("m", "s")


def model_windows(df: DataFrame, width: int = 13) -> DataFrame:
    """WIN-09: every full window of width rows, at its last row."""
    return df.withColumn("window", F.collect_list("value").over(_by().rowsBetween(1 - width, 0))).filter(F.size("window") == width)


def wrapped_windows(df: DataFrame, width: int = 13) -> DataFrame:
    """WIN-10: as many windows as rows; the first ones begin with the series' last rows."""
    w = Window.partitionBy(*KEYS)
    tail = df.withColumn("r", F.row_number().over(w.orderBy(F.desc("bucket_ts")))).filter(F.col("r") < width)
    rows = tail.select(*KEYS, "bucket_ts", "value", (-F.col("r")).alias("turn")).unionByName(df.select(*KEYS, "bucket_ts", "value", F.lit(0).alias("turn")))
    return rows.withColumn("window", F.collect_list("value").over(w.orderBy("turn", "bucket_ts").rowsBetween(1 - width, 0))).filter((F.col("turn") == 0) & (F.size("window") == width)).drop("turn")


def padded_windows(df: DataFrame, width: int = 4) -> DataFrame:
    """WIN-11: as many windows as rows; missing rows before the first repeat it."""
    w = _by()
    first = F.first("value").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("window", F.array(*[F.coalesce(F.lag("value", k).over(w), first) for k in range(width - 1, -1, -1)]))


def forecast_windows(df: DataFrame, width: int = 5, stride: int = 2) -> DataFrame:
    """WIN-12: width rows of history and the value that follows."""
    w = _by()
    rows = df.withColumn("history", F.collect_list("value").over(w.rowsBetween(-width, -1))).withColumn("i", F.row_number().over(w) - 1)
    return rows.filter((F.size("history") == width) & ((F.col("i") - width) % stride == 0)).select(*KEYS, "bucket_ts", "history", F.col("value").alias("target"))


def largest_gaps(df: DataFrame, keys: list[str], n: int = 10) -> DataFrame:
    """WIN-13: the n largest gaps between neighbours in time."""
    w = Window.partitionBy(*keys).orderBy("ts", "event_id")
    gaps = df.withColumn("gap", F.col("ts") - F.lag("ts").over(w)).filter("gap is not null")
    return gaps.orderBy(F.desc("gap"), "ts", "event_id").limit(n)


def slot(ts: Column, seconds: int = 1800) -> Column:
    """WIN-19: start of the half hour; right at UTC+8 too, since 8 hours are whole half hours."""
    return (F.floor(ts / seconds) * seconds).cast("long")


def transplanted(ts: Column, midnight: int, zone_hours: int = 8) -> Column:
    """WIN-20: same local time of day, on the day that begins at midnight."""
    return (F.lit(midnight) + F.pmod(ts + zone_hours * 3600, F.lit(86400))).cast("long")


def index_slice(df: DataFrame, start: Column, n: int) -> DataFrame:
    """WIN-22: n rows from an index on."""
    rows = df.withColumn("idx", F.row_number().over(_by()) - 1)
    return rows.filter((F.col("idx") >= start) & (F.col("idx") < start + n))


def backward_mean(df: DataFrame, depth: int) -> DataFrame:
    """WIN-23: mean of the last depth rows, where there are as many."""
    w = _by()
    rows = df.withColumn("mean", F.avg("value").over(w.rowsBetween(1 - depth, 0))).withColumn("i", F.row_number().over(w))
    return rows.filter(F.col("i") >= depth).drop("i")
