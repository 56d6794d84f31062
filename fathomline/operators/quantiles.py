"""AGG-12: exact quantiles of any number of values under a key, by radix selection.

Doubles are mapped to whole numbers of the same order. A pass counts, for each key and each rank sought, the next DIGIT bits of the values that
agree with what is known of the rank's value so far; the digit in which the rank falls is known then. So 64 / DIGIT passes find every
value, however many there are and however they lie; a key has 2**DIGIT counts at most, which are summed before they are shuffled.

Up to FEW rows under a key, Spark's own percentile does (it holds a key's different values); the results are the same.
Defined results: nulls don't count, NaN counts as the largest value, -0.0 as 0.0; a key without values has no row.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType

from ..storage import stored

DIGIT, FEW = 16, 1_000_000


@F.pandas_udf(LongType())
def ordered(x: pd.Series) -> pd.Series:
    """Whole numbers in the order of doubles."""
    bits = (x.to_numpy(np.float64) + 0.0).view(np.int64)
    return pd.Series(np.where(bits < 0, bits ^ np.int64(0x7FFFFFFFFFFFFFFF), bits))


@F.pandas_udf(DoubleType())
def unordered(x: pd.Series) -> pd.Series:
    bits = x.to_numpy(np.int64)
    return pd.Series(np.where(bits < 0, bits ^ np.int64(0x7FFFFFFFFFFFFFFF), bits).view(np.float64))


def selected(df: DataFrame, keys: list[str], value: str, shares: list) -> DataFrame:
    """keys, share, at, low, high: the two values between which each quantile lies, and how far (at) from the lower one.

    A share may also be a function of the number of values that gives a rank from 0; its share is null then.
    """
    rows = stored(df.filter(F.col(value).isNotNull()).select(*keys, ordered(F.col(value).cast("double")).alias("_v")), "ordered")
    counts = rows.groupBy(*keys).agg(F.count("*").alias("_n"))
    ranks = [F.struct(F.lit(None if callable(s) else float(s)).cast("double").alias("share"), (s(F.col("_n")) if callable(s) else (F.col("_n") - 1) * F.lit(float(s))).cast("double").alias("place")) for s in shares]
    wanted = counts.withColumn("_s", F.explode(F.array(*ranks))).select(*keys, "_s.share", "_s.place").withColumn("at", F.col("place") - F.floor("place"))
    sides = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.floor("place").alias("rank")), F.struct(F.lit(1).alias("side"), F.ceil("place").alias("rank")))).alias("x")
    targets = stored(wanted.select(*keys, "share", "at", sides).select(*keys, "share", "at", "x.side", "x.rank", F.lit(0).cast("long").alias("_head")), "targets")
    for shift in range(64 - DIGIT, -1, -DIGIT):
        # What is known: the bits above this digit. The highest digit keeps its sign.
        head = F.shiftright("_v", shift + DIGIT) if shift + DIGIT < 64 else F.lit(0).cast("long")
        digit = F.shiftright("_v", shift)
        known = targets.select(*keys, "_head").distinct()
        digits = rows.select(*keys, head.alias("_head"), digit.alias("_digit")).join(known, [*keys, "_head"], "left_semi") if shift + DIGIT < 64 else rows.select(*keys, head.alias("_head"), digit.alias("_digit"))
        summed = digits.groupBy(*keys, "_head", "_digit").agg(F.count("*").alias("_c"))
        upto = F.sum("_c").over(Window.partitionBy(*keys, "_head").orderBy("_digit"))  # 2**DIGIT rows at most
        summed = summed.withColumn("_upto", upto)
        hit = targets.join(summed, [*keys, "_head"]).filter((F.col("rank") < F.col("_upto")) & (F.col("rank") >= F.col("_upto") - F.col("_c")))
        targets = stored(hit.select(*keys, "share", "at", "side", (F.col("rank") - (F.col("_upto") - F.col("_c"))).alias("rank"), F.col("_digit").alias("_head")), "targets")
    value_of = lambda side: F.max(F.when(F.col("side") == side, F.col("_x")))
    return targets.withColumn("_x", unordered("_head")).groupBy(*keys, "share", "at").agg(value_of(0).alias("low"), value_of(1).alias("high"))


def quantiles(df: DataFrame, keys: list[str], value: str, shares: list[float], few: int = FEW) -> DataFrame:
    """keys, share, q: exact quantiles, linear between two values."""
    most = df.groupBy(*keys).agg(F.count(value).alias("n")).agg(F.max("n")).first()[0] or 0
    if most <= few:
        listed = F.percentile(F.col(value).cast("double"), F.array(*[F.lit(float(s)) for s in shares]))
        return df.groupBy(*keys).agg(listed.alias("q")).filter("q is not null").select(*keys, F.explode(F.arrays_zip(F.array(*[F.lit(float(s)) for s in shares]).alias("share"), "q")).alias("x")).select(*keys, "x.share", "x.q")
    mixed = F.when(F.col("low") == F.col("high"), F.col("low")).otherwise((1 - F.col("at")) * F.col("low") + F.col("at") * F.col("high"))
    return selected(df, keys, value, shares).select(*keys, "share", mixed.alias("q"))
