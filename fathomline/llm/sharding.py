"""Shards of near equal size by sampled splitters (operator 7).

Records are ordered by a key (a hash of the text, so equal texts lie together). A sample whose chance is in
proportion to size gives quantile boundaries; records are dealt into ranges between them; ranges that turn out
overfull, as one large group of equal texts makes them, are subdivided by a hash of doc_id and the row's place; single
records larger than a range are units of their own. Units, a bounded number whatever the input, are then given to shards,
largest first. The law that holds is `bytes`: shards have near equal bytes, up to what one record allows.

Groups of equal texts lie in one range, and so in one shard, unless the range is overfull or a text alone is larger than a range:
then its rows, those of smaller groups in the same range too, are spread over shards, as the law comes first.

Defined results: null text has size 16; repeated rows, also those of one doc_id or none, are records of their own with slots of
their own, spread like others; ties in key are broken by that hash; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import bisect
import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import placed, stored

OVERHEAD = 16
#: Ranges for each shard, at least; and the most rows a range should hold.
RANGES, RANGE_ROWS = 24, 1_000_000
OVERFULL = 1.5


def splitters(keys: list[tuple[int, float]], ranges: int) -> list[int]:
    """Quantile boundaries of a weighted sample."""
    keys = sorted(keys)
    if not keys:
        return []
    total = np.cumsum([w for _, w in keys])
    at = np.searchsorted(total, total[-1] * np.arange(1, ranges) / ranges)
    return sorted({keys[min(i, len(keys) - 1)][0] for i in at})


def shard(docs: DataFrame, shards: int = 40) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for all documents."""
    text = F.coalesce(F.col("text"), F.lit(""))
    tie = F.xxhash64("doc_id", "__place.file", "__place.row", F.lit(7))
    rows = stored(
        placed(docs, "doc_id", "text").select("doc_id", (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("key"), tie.alias("tie")), "sizes"
    )
    total, n = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    ranges = max(RANGES * shards, -(-n // RANGE_ROWS))
    target = max(1, total / ranges)
    draw = F.pmod(F.xxhash64("key", "tie", F.lit(11)), F.lit(1 << 30)) / float(1 << 30)
    chance = F.least(F.lit(1.0), F.col("size") * 8.0 / target)  # 8 for each range, by size
    sample = rows.filter(draw < chance).select("key", (F.col("size") / chance).alias("w"))
    cuts = splitters([(r["key"], r["w"]) for r in sample.toLocalIterator()], ranges)  # about 8 * ranges rows

    @F.pandas_udf("int")
    def range_of(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        edges = np.array(cuts, np.int64)
        for keys in it:
            yield pd.Series(np.searchsorted(edges, keys.to_numpy(), "right").astype(np.int32))

    large = F.col("size") >= target * OVERFULL  # at most `ranges` rows
    rows = rows.withColumn("range", F.when(large, F.lit(-1)).otherwise(range_of("key")))
    held = rows.filter(~large).groupBy("range").agg(F.sum("size").alias("bytes"))
    split = {r["range"]: int(r["bytes"] / target) + 1 for r in held.collect() if r["bytes"] > OVERFULL * target}
    parts = docs.sparkSession.createDataFrame([*split.items(), (-2, 1)], "range int, parts int")  # at most `ranges` rows
    buckets = F.lit(max(1, 4 * ranges))
    unit = F.when(F.col("range") == -1, F.struct(F.lit(-1).alias("r"), F.pmod(F.col("tie"), buckets).alias("p"))).otherwise(F.struct(F.col("range").alias("r"), F.pmod(F.col("tie"), F.coalesce(F.col("parts"), F.lit(1)).cast("long")).alias("p")))
    rows = stored(rows.join(F.broadcast(parts), "range", "left").withColumn("unit", unit).drop("parts", "range"), "ranges")
    units = rows.groupBy("unit").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).collect()  # a few for each range
    heap, given = [(0, s, 0) for s in range(shards)], []
    for u in sorted(units, key=lambda u: (-u["bytes"], u["unit"])):
        size, s, start = heapq.heappop(heap)
        given.append((*u["unit"], s, start))
        heapq.heappush(heap, (size + u["bytes"], s, start + u["rows"]))
    homes = docs.sparkSession.createDataFrame([((r, p), s, start) for r, p, s, start in given], "unit struct<r:int,p:long>, shard int, start long")
    slot = F.row_number().over(Window.partitionBy("unit").orderBy("key", "tie", "doc_id")) - 1
    return rows.withColumn("slot", slot).join(F.broadcast(homes), "unit").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("slot") + F.col("start")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
