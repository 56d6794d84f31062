"""Joins, aggregations, ranking and set operations that have a shape of their own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stored

#: Of range joins: right rows in a packed row, and tasks that share a time cell.
PACKED, DEALT = 1024, 8


def with_stats(df: DataFrame, stats: DataFrame, keys: list[str]) -> DataFrame:
    """JN-01: left join of counts; missing ones are 0."""
    return df.join(stats, keys, "left").fillna(0)


def lookup(df: DataFrame, dim: DataFrame, key: str, value: str, default: Column) -> DataFrame:
    """JN-03: text of an id from a small dimension, or a default."""
    return df.join(dim, key, "left").withColumn(value, F.coalesce(value, default))


def associated(single: DataFrame, multi: DataFrame, keys: list[str]) -> DataFrame:
    """JN-04: for each row of multi, the single-dimension rows of its keys as a list, and their number."""
    lists = single.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("feature", "value"))).alias("details"), F.count("*").alias("n"))
    return multi.join(lists, keys, "left").withColumn("n", F.coalesce("n", F.lit(0)))


def range_join(left: DataFrame, right: DataFrame, before: int, after: int, lts: str, rts: str) -> DataFrame:
    """JN-05: right rows within [t - before, t + after] of a left row, by an equi-join on time cells.

    A window meets five or six cells; no nested loop. The right rows of a cell are packed, PACKED neighbours in time to a row,
    so a left row meets few rows and unpacks them. Small inputs may give many pairs: rows are dealt to as many tasks as the
    session has shuffle partitions, a cell to up to DEALT of them, and sizes of inputs don't bring the tasks together.
    """
    cell, own = max(1, -(-(before + after) // 4)), right.columns
    tasks = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    a = left.withColumn("_cell", F.explode(F.sequence(F.floor((F.col(lts) - before) / cell), F.floor((F.col(lts) + after) / cell))))
    a = a.withColumn("_deal", F.pmod(F.xxhash64(*left.columns), F.lit(DEALT)).cast("int"))
    b = right.repartitionByRange(rts, *own).sortWithinPartitions(rts, *own)
    b = b.withColumn("_pack", F.floor(F.monotonically_increasing_id() / PACKED)).withColumn("_cell", F.floor(F.col(rts) / cell))
    b = b.groupBy("_cell", "_pack").agg(F.collect_list(F.struct(*own)).alias("_rows"))  # PACKED at most
    b = b.withColumn("_deal", F.explode(F.sequence(F.lit(0), F.lit(DEALT - 1))))
    pairs = a.repartition(tasks, "_cell", "_deal").join(b.repartition(tasks, "_cell", "_deal"), ["_cell", "_deal"])
    return pairs.select(*left.columns, F.inline("_rows")).filter(F.col(rts).between(F.col(lts) - before, F.col(lts) + after))


def range_counts(left: DataFrame, right: DataFrame, before: int, after: int, lts: str, rts: str, by: str, first: str) -> DataFrame:
    """JN-05, counted: left's columns, by, n and first (the least time) of the right rows within [t - before, t + after] of each left row; no pairs.

    Times are whole numbers. Equal times of either side are one row; windows are split at cells as long as they are, so the part in each cell is a difference of
    running counts from its first or to its last row, and a window's first row is in its first cell that has one. Work grows with
    the rows of both sides, each `by` of right being met by each time of left.
    """
    cell = max(1, before + after)
    kinds = right.filter(F.col(rts).isNotNull()).groupBy(F.col(by).alias("_by"), F.col(rts).alias("_at")).agg(F.count("*").alias("_n"))
    times = left.filter(F.col(lts).isNotNull()).select(F.col(lts).alias("_t")).distinct().crossJoin(F.broadcast(kinds.select("_by").distinct()))  # a row for each kind
    lo, hi = F.col("_t") - before, F.col("_t") + after
    parts = times.withColumn("_cell", F.explode(F.sequence(F.floor(lo / cell), F.floor(hi / cell))))
    parts = parts.select("_by", "_cell", "_t", F.greatest(lo, F.col("_cell") * cell).alias("_lo"), F.least(hi, (F.col("_cell") + 1) * cell - 1).alias("_hi"))
    ends = parts.select("_by", "_cell", "_t", F.explode(F.array(F.struct(F.col("_lo").alias("_at"), F.lit(-1).alias("_end")), F.struct(F.col("_hi").alias("_at"), F.lit(1).alias("_end")))).alias("_x"))
    ends = ends.select("_by", "_cell", "_t", "_x._at", "_x._end", F.lit(None).cast("long").alias("_n"))
    rows = kinds.select("_by", F.floor(F.col("_at") / cell).alias("_cell"), F.lit(None).cast("long").alias("_t"), "_at", F.lit(0).alias("_end"), "_n").unionByName(ends)
    w = Window.partitionBy("_by", "_cell").orderBy("_at", "_end")  # the beginning of a window before the rows of its time, its end after them
    back = Window.partitionBy("_by", "_cell").orderBy(F.desc("_at"), F.desc("_end"))  # a frame that only grows, as one that shrinks is read anew for each row
    seen = rows.withColumn("_run", F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)))
    seen = seen.withColumn("_next", F.min(F.when(F.col("_end") == 0, F.col("_at"))).over(back.rowsBetween(Window.unboundedPreceding, 0)))
    part = seen.filter("_end <> 0").groupBy("_by", "_t", "_cell").agg(F.sum(F.col("_end") * F.col("_run")).alias("n"), F.min(F.when(F.col("_end") == -1, F.col("_next"))).alias("_first"))
    found = part.filter("n > 0").groupBy("_by", "_t").agg(F.sum("n").alias("n"), F.min("_first").alias(first))
    return left.join(found.withColumnRenamed("_t", lts).withColumnRenamed("_by", by), lts)


def nearest_clean_slot(faults: DataFrame, clean: DataFrame, by: list[str]) -> DataFrame:
    """JN-06: for each fault the clean slot of its component that is nearest to its own, the earlier of equals; faults without one are left out.

    clean: by, slot; the slots of a component are a day's at most, so they are one array.
    """
    free = clean.groupBy(*by).agg(F.collect_set("slot").alias("free"))
    far = F.transform("free", lambda s: F.struct(F.abs(F.col("slot") - s).alias("far"), s.alias("clean_slot")))
    return faults.join(free, by).withColumn("clean_slot", F.array_min(far)["clean_slot"]).drop("free")


def free_slots(taken: DataFrame, by: list[str], slots: int) -> DataFrame:
    """JN-07: by, slot: the slots 0 to slots - 1 that hold none of the rows of a component."""
    used = taken.groupBy(*by).agg(F.collect_set(F.col("slot").cast("long")).alias("used"))  # `slots` at most
    return used.select(*by, F.explode(F.array_except(F.sequence(F.lit(0).cast("long"), F.lit(slots - 1).cast("long")), "used")).alias("slot"))


def numbered(df: DataFrame, by: str, name: str, then: list | None = None, ranges: int | None = None) -> DataFrame:
    """JN-14, RNK-02: the place of each row in the order by a column (nulls last), and then by other columns; from 1.

    Rows are dealt into ranges of the whole order, as many as the session has shuffle partitions, numbered in each, and moved by the rows of the
    ranges before. The other columns split a value that many rows share, so ranges are even unless rows are equal in all of them.
    """
    order = [F.asc_nulls_last(by), *(then or [])]
    ranges = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = stored(df.repartitionByRange(ranges, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    size = rows.groupBy("_range").agg(F.count("*").alias("n"))  # a row for each range
    before = F.coalesce(F.sum("n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return rows.join(size.select("_range", before.alias("_before")), "_range").withColumn(name, own + F.col("_before")).drop("_range", "_before")


def aligned(a: DataFrame, b: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """JN-08: the rows of both whose key both have."""
    return a.join(b.select(key).distinct(), key, "left_semi"), b.join(a.select(key).distinct(), key, "left_semi")


def calls(spans: DataFrame) -> DataFrame:
    """JN-09: parent and child components of each call that crosses components."""
    p = spans.select("trace_id", F.col("span_id").alias("parent_id"), F.col("cmdb_id").alias("src"))
    c = spans.select("trace_id", "parent_id", F.col("span_id").alias("child"), F.col("cmdb_id").alias("dst"))
    return c.join(p, ["trace_id", "parent_id"]).filter("src <> dst").select("trace_id", "child", "src", "dst")


def merged_scores(a: DataFrame, b: DataFrame, wa: float, wb: float, keys: list[str]) -> DataFrame:
    """JN-12, RCA-13: weighted sum of two score maps; a missing score is 0."""
    both = a.withColumnRenamed("score", "sa").join(b.withColumnRenamed("score", "sb"), keys, "full_outer")
    return both.select(*keys, (wa * F.coalesce("sa", F.lit(0.0)) + wb * F.coalesce("sb", F.lit(0.0))).alias("score"))


def top_hits(ranked: DataFrame, truth: DataFrame) -> DataFrame:
    """JN-13: whether the true cause is first, or among the first three."""
    best = ranked.filter("rank <= 3").groupBy("cluster_id").agg(F.array_sort(F.collect_list(F.struct("rank", "entity"))).alias("x")).select("cluster_id", F.col("x.entity").alias("top"))
    return best.join(truth, "cluster_id").select("cluster_id", (F.element_at("top", 1) == F.col("root_cause_entity")).cast("int").alias("hit1"), F.array_contains("top", F.col("root_cause_entity")).cast("int").alias("hit3"))


def accuracy(hits: DataFrame) -> DataFrame:
    """AGG-16."""
    return hits.agg(F.count("*").alias("n"), F.avg("hit1").alias("top1"), F.avg("hit3").alias("top3"))


def endpoint_counts(df: DataFrame) -> DataFrame:
    """AGG-02: rows an entity has as either end."""
    return df.select(F.explode(F.array("src", "dst")).alias("entity")).groupBy("entity").agg(F.count("*").alias("cnt"))


def most_common(df: DataFrame, keys: list[str], col: str, order: str) -> DataFrame:
    """AGG-04: the commonest value, the first seen of equals."""
    n = df.groupBy(*keys, col).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    return n.groupBy(*keys).agg(F.max_by(col, F.struct("n", (-F.col("first")).alias("f"), col)).alias(col))


def first_rows(df: DataFrame, keys: list[str], cols: list[str], order: str) -> DataFrame:
    """AGG-05: the first value that is not null of each column, in order."""
    return df.groupBy(*keys).agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in cols])


def attribute_counts(df: DataFrame, keys: list[str], attribute: str = "attribute") -> DataFrame:
    """AGG-07: a map from attribute to count, and how many there are."""
    n = df.groupBy(*keys, attribute).agg(F.count("*").alias("n"))
    return n.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(attribute, "n")))).alias("counts"), F.count("*").cast("int").alias("kinds"))


def confusion(df: DataFrame, pred: str = "pred", label: str = "label", keys: list[str] | None = None) -> DataFrame:
    """AGG-10: counts, precision, recall and F1 with the small terms that keep them defined."""
    c = lambda p, y: F.sum(((F.col(pred) == p) & (F.col(label) == y)).cast("long"))
    out = (df.groupBy(*keys) if keys else df.groupBy()).agg(c(1, 1).alias("tp"), c(0, 0).alias("tn"), c(1, 0).alias("fp"), c(0, 1).alias("fn"))
    return f1(out)


def f1(counts: DataFrame) -> DataFrame:
    e = 0.00001
    out = counts.withColumn("precision", F.col("tp") / (F.col("tp") + F.col("fp") + e)).withColumn("recall", F.col("tp") / (F.col("tp") + F.col("fn") + e))
    return out.withColumn("f1", 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall") + e))


def confusion_by_cluster(df: DataFrame, cluster: str) -> DataFrame:
    """AGG-11: F1 of each cluster and over all (cluster null), in one pass."""
    flagged = df.select(cluster, *[((F.col("pred") == p) & (F.col("label") == y)).cast("long").alias(n) for n, p, y in (("tp", 1, 1), ("tn", 0, 0), ("fp", 1, 0), ("fn", 0, 1))])
    return f1(flagged.groupingSets([[cluster], []], cluster).agg(*[F.sum(c).alias(c) for c in ("tp", "tn", "fp", "fn")]))


def token_stats(df: DataFrame, text: str) -> DataFrame:
    """AGG-18: words parted by white space."""
    n = F.when(F.length(F.trim(F.col(text))) == 0, 0).otherwise(F.size(F.split(F.regexp_replace(F.col(text), r"^\s+|\s+$", ""), r"\s+"))).cast("long")
    return df.select(n.alias("n")).agg(F.count("*").alias("files"), F.min("n").alias("low"), F.max("n").alias("high"), F.avg("n").alias("mean"), F.sum("n").alias("total"))


def distinct_graphs(edges: DataFrame) -> DataFrame:
    """AGG-20: distinct sets of calls over traces, and how many traces have each."""
    g = edges.groupBy("trace_id").agg(F.array_sort(F.collect_set(F.concat("src", F.lit("->"), "dst"))).alias("graph"))
    return g.groupBy("graph").agg(F.count("*").alias("traces"))


def contingency(df: DataFrame, label: str, pred: str) -> DataFrame:
    """AGG-21: counts with their share of the row and of the column."""
    n = df.groupBy(label, pred).agg(F.count("*").alias("n"))
    return n.withColumn("of_label", F.col("n") / F.sum("n").over(Window.partitionBy(label))).withColumn("of_pred", F.col("n") / F.sum("n").over(Window.partitionBy(pred)))


def pair_measures(df: DataFrame, label: str, pred: str) -> DataFrame:
    """AGG-23: Rand and adjusted Rand index, Fowlkes-Mallows, mutual information, homogeneity, completeness and V, from counts."""
    c = df.groupBy(label, pred).agg(F.count("*").alias("n"))
    two = lambda x: x * (x - 1) / 2
    cells = c.agg(F.sum(two(F.col("n"))).alias("both"), F.sum("n").alias("n"), F.sum(F.col("n") * F.log("n")).alias("hj"))
    rows = c.groupBy(label).agg(F.sum("n").alias("n")).agg(F.sum(two(F.col("n"))).alias("r"), F.sum(F.col("n") * F.log("n")).alias("hr"))
    cols = c.groupBy(pred).agg(F.sum("n").alias("n")).agg(F.sum(two(F.col("n"))).alias("c"), F.sum(F.col("n") * F.log("n")).alias("hc"))
    x = cells.crossJoin(rows).crossJoin(cols)  # one row each
    n, allp = F.col("n"), two(F.col("n"))
    x = x.withColumn("h_label", F.log(n) - F.col("hr") / n).withColumn("h_pred", F.log(n) - F.col("hc") / n).withColumn("mi", F.log(n) + (F.col("hj") - F.col("hr") - F.col("hc")) / n)
    expect = F.col("r") * F.col("c") / allp
    one = lambda top, low: F.when(F.abs(low) < 1e-12, 1.0).otherwise(top / low)
    hom, com = one(F.col("mi"), F.col("h_label")), one(F.col("mi"), F.col("h_pred"))
    return x.select(
        ((allp + 2 * F.col("both") - F.col("r") - F.col("c")) / allp).alias("rand"), ((F.col("both") - expect) / ((F.col("r") + F.col("c")) / 2 - expect)).alias("adjusted_rand"),
        (F.col("both") / F.sqrt(F.col("r") * F.col("c"))).alias("fowlkes_mallows"), one(2 * F.col("mi"), F.col("h_label") + F.col("h_pred")).alias("nmi"),
        hom.alias("homogeneity"), com.alias("completeness"), one(2 * hom * com, hom + com).alias("v_measure"))


def dedupe_first(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """RNK-05: one row per key, the first in order."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("x")).select(*keys, "x.*")


def top_per_group(df: DataFrame, keys: list[str], order: list, k: int) -> DataFrame:
    """RNK-04."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= k)
