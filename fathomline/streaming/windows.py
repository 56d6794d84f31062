"""Windows, duplicates and assignment on streams; each works on a batch as well."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bucketed(df: DataFrame, width: str = "15 minutes", late: str | None = None) -> DataFrame:
    """STR-03: events and their value by kind and tumbling bucket."""
    rows = df.withWatermark("ts", late) if late else df
    g = rows.groupBy("event_type", F.window("ts", width)).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return g.select("event_type", F.unix_timestamp("window.start").alias("bucket_ts"), "n", "total")


def sliding(df: DataFrame, width: str = "13 minutes", step: str = "1 minute", late: str | None = None) -> DataFrame:
    """STR-04."""
    rows = df.withWatermark("ts", late) if late else df
    g = rows.groupBy("event_type", F.window("ts", width, step)).agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
    return g.select("event_type", F.unix_timestamp("window.start").alias("start_ts"), "n", "mean")


def sessions(df: DataFrame, gap: str, keys: list[str], late: str | None = None) -> DataFrame:
    """STR-05: runs of events with gaps under `gap`. As density clusters of min_samples 1, but a gap of exactly `gap` parts them."""
    rows = df.withWatermark("ts", late) if late else df
    g = rows.groupBy(*keys, F.session_window("ts", gap)).agg(F.count("*").alias("n"))
    return g.select(*keys, F.unix_timestamp("session_window.start").alias("start_ts"), "n")


def deduplicated(df: DataFrame, keys: list[str], late: str) -> DataFrame:
    """Repeated events within the watermark."""
    return df.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def assigned(stream: DataFrame, centres: DataFrame) -> DataFrame:
    """STR-06: each arriving vector (id, x) with its nearest stored centre, the first of equals.

    Centres are few and fixed, so they are one array that every row carries through; no state is kept.
    """
    from ..operators.distance import euclidean

    table = centres.groupBy().agg(F.array_sort(F.collect_list(F.struct("id", "x"))).alias("centres"))
    d = F.transform("centres", lambda c: F.struct(F.round(euclidean(F.col("x"), c["x"]), 9).alias("d"), c["id"].alias("center")))
    return stream.crossJoin(F.broadcast(table)).select("id", F.array_min(d).alias("m")).select("id", F.col("m.center").alias("center"), F.round("m.d", 6).alias("d"))


def drained(stream: DataFrame, folder: str) -> DataFrame:
    """Runs a stream over all that is there and returns what it wrote."""
    base = f"{folder.rstrip('/')}/fathomline-stream/{uuid.uuid4().hex}"
    query = stream.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{base}/out")
