"""Adapters: the driver's tables seen as telemetry. Each has a DataFrame form and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import signed

BUCKET = 21600


def epoch(col: str = "ts"):
    """Whole seconds of a timestamp."""
    return F.unix_timestamp(F.col(col).cast("timestamp"))


def samples(t) -> DataFrame:
    """entity, feature, bucket_ts, value: mean of the events of a service and kind in six hours."""
    return (
        t.table("events").select(F.concat(F.lit("svc_"), F.col("user_id") % 12).alias("entity"), F.col("event_type").alias("feature"), (F.floor(epoch() / BUCKET) * BUCKET).alias("bucket_ts"), "value")
        .groupBy("entity", "feature", "bucket_ts").agg(F.round(F.avg("value"), 3).alias("value"))
    )


def points(t) -> DataFrame:
    """event_id, entity, feature, ts, value: single events."""
    return t.table("events").select("event_id", F.concat(F.lit("svc_"), F.col("user_id") % 12).alias("entity"), F.col("event_type").alias("feature"), epoch().alias("ts"), "value")


def anomalies(t) -> DataFrame:
    """ts, type, entity, attribute, raw: events above the 99th percentile of their service and kind."""
    p = points(t)
    high = p.groupBy("entity", "feature").agg(F.round(F.percentile("value", 0.99), 6).alias("high"))
    kind = F.when(F.col("feature").isin("error", "click"), "metric").when(F.col("feature") == "view", "trace").otherwise("log")
    return p.join(high, ["entity", "feature"]).filter(F.col("value") > F.col("high")).select("ts", kind.alias("type"), "entity", F.col("feature").alias("attribute"), F.col("event_id").cast("string").alias("raw"))


def faults(t) -> DataFrame:
    """fault_id, level, reason, component, ts: orders seen as faults, each customer as a component."""
    ts = (F.lit(1704067200) + F.col("o_orderkey") * 7919 % 2592000).cast("long").alias("ts")
    return t.table("orders").select(
        F.col("o_orderkey").alias("fault_id"), F.col("o_orderpriority").alias("level"), F.col("o_orderstatus").alias("reason"), F.concat(F.lit("node_"), "o_custkey").alias("component"), ts)


def spans(t) -> DataFrame:
    """trace_id, span_id, parent_id, cmdb_id: the events of a user on a day, in order, as one trace."""
    p = t.table("events").select("user_id", "event_id", epoch().alias("s"), F.concat("event_type", F.lit("_"), (F.col("event_id") % 3).cast("string")).alias("cmdb_id"))
    w = Window.partitionBy("trace_id").orderBy("s", "event_id")
    return p.withColumn("trace_id", F.concat_ws(":", "user_id", F.floor(F.col("s") / 86400))).withColumn("parent_id", F.lag("event_id").over(w)).select("trace_id", F.col("event_id").alias("span_id"), "parent_id", "cmdb_id")


def edges(t) -> DataFrame:
    """src, dst: distinct calls between components."""
    s = spans(t)
    return s.alias("p").join(s.alias("c"), (F.col("p.span_id") == F.col("c.parent_id")) & (F.col("p.trace_id") == F.col("c.trace_id"))).select(F.col("p.cmdb_id").alias("src"), F.col("c.cmdb_id").alias("dst")).filter("src <> dst").distinct()


def topology(t) -> DataFrame:
    """src, dst: a small directed graph of services, with cycles."""
    k = F.col("n_nationkey")
    return t.table("nation").select(F.concat(F.lit("svc_"), k % 12).alias("src"), F.concat(F.lit("svc_"), (k * 5 + F.floor(k / 12).cast("int") + 1) % 12).alias("dst")).filter("src <> dst").distinct()


def scores(t) -> DataFrame:
    """entity, idx, score, label: documents in order, with a score and a 0/1 label, in groups."""
    d = t.table("documents").join(t.table("labels"), "doc_id")
    return d.select(F.concat(F.lit("m_"), F.col("doc_id") % 5).alias("entity"), F.col("doc_id").alias("idx"), (F.col("n_chars") % 997).cast("double").alias("score"), F.when(F.floor(F.col("doc_id") / 20) % 3 == 0, 1).otherwise(0).alias("label"))


EPS, MIN_SAMPLES = 7200, 3


def clustered(t) -> DataFrame:
    """anomalies with their cluster in time; clustered once for all that is read of them through t."""
    from ..operators.cluster import dbscan_ranges
    from ..storage import written

    if "_clustered" not in t.__dict__:
        found = dbscan_ranges(anomalies(t), EPS, MIN_SAMPLES, width=86400)
        t.__dict__["_clustered"] = (found.schema, written(found, "clustered"))
    schema, path = t.__dict__["_clustered"]
    return t.spark.read.schema(schema).parquet(path)


def incidents(t) -> DataFrame:
    """clustered without noise."""
    return clustered(t).filter("cluster_id >= 0")


def vectors(t) -> DataFrame:
    """id, label, x: the embeddings, as doubles rounded to 4 places (small negative ones to -0.0, as in SQL)."""
    return t.table("embeddings").select(F.col("vec_id").alias("id"), "label", F.transform("embedding", lambda v: signed(v.cast("double"), F.round(v.cast("double"), 4))).alias("x"))


WEEK, SUPPLY = 604800, ["quantity", "price", "discount", "tax"]


#: Lines of a part of the suppliers, on average.
PART = 24576


def supplies(t) -> DataFrame:
    """entity, model, part, ts, x: each supplier's lines by week, four features scaled by the supplier's means and deviations; suppliers in three clusters.

    Lines are shuffled once, by part (a hash of the supplier): sums, means and what is packed by part follow in the same tasks.
    """
    lines = t.table("lineitem")
    parts = max(1, lines.count() // PART)
    part = F.pmod(F.xxhash64("l_suppkey"), F.lit(parts)).cast("int")
    li = lines.select("l_suppkey", (F.floor(epoch("l_shipdate") / WEEK) * WEEK).alias("ts"), F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"), F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"))
    weeks = li.withColumn("part", part).repartition(min(parts, max(64, parts // 16)), "part").groupBy("part", "l_suppkey", "ts").agg(F.sum("quantity").alias("quantity"), *[F.avg(f).alias(f) for f in SUPPLY[1:]])
    own = Window.partitionBy("part", "l_suppkey")  # the weeks of a supplier
    scaled = F.array(*[(F.col(f) - F.avg(f).over(own)) / F.greatest(F.stddev_pop(f).over(own), F.lit(1e-3)) for f in SUPPLY])
    return weeks.select(F.concat(F.lit("sup_"), "l_suppkey").alias("entity"), F.concat(F.lit("c"), F.col("l_suppkey") % 3).alias("model"), "part", "ts", scaled.alias("x"))


ORDERED = ["lines", "quantity", "price", "discount", "tax", "total"]


def ordered(t) -> DataFrame:
    """o_orderkey and what is known of an order: lines, quantity, price, discount, tax, total."""
    li = t.table("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").cast("double").alias("lines"), F.sum("l_quantity").alias("quantity"), F.sum("l_extendedprice").alias("price"), F.avg("l_discount").alias("discount"), F.avg("l_tax").alias("tax"))
    return t.table("orders").select("o_orderkey", F.col("o_totalprice").cast("double").alias("total")).join(li, "o_orderkey")


#: name: (adapters it needs, SQL)
SQL = {
    "points": ("", "SELECT event_id, 'svc_' || (user_id % 12) AS entity, event_type AS feature, CAST(floor(epoch(ts)) AS BIGINT) AS ts, value FROM events"),
    "samples": ("", f"SELECT 'svc_' || (user_id % 12) AS entity, event_type AS feature, CAST(floor(floor(epoch(ts)) / {BUCKET}) * {BUCKET} AS BIGINT) AS bucket_ts, round(avg(value), 3) AS value FROM events GROUP BY ALL"),
    "anomalies": ("points", "SELECT ts, CASE WHEN feature IN ('error', 'click') THEN 'metric' WHEN feature = 'view' THEN 'trace' ELSE 'log' END AS type, entity, feature AS attribute, CAST(event_id AS VARCHAR) AS raw FROM points JOIN (SELECT entity, feature, round(quantile_cont(value, 0.99), 6) AS high FROM points GROUP BY ALL) USING (entity, feature) WHERE value > high"),
    "faults": ("", "SELECT o_orderkey AS fault_id, o_orderpriority AS level, o_orderstatus AS reason, 'node_' || o_custkey AS component, CAST(1704067200 + o_orderkey * 7919 % 2592000 AS BIGINT) AS ts FROM orders"),
    "spans": ("", "SELECT trace_id, event_id AS span_id, lag(event_id) OVER (PARTITION BY trace_id ORDER BY s, event_id) AS parent_id, cmdb_id FROM (SELECT concat_ws(':', user_id, CAST(floor(s / 86400) AS BIGINT)) AS trace_id, * FROM (SELECT user_id, event_id, CAST(floor(epoch(ts)) AS BIGINT) AS s, event_type || '_' || (event_id % 3) AS cmdb_id FROM events))"),
    "edges": ("spans", "SELECT DISTINCT p.cmdb_id AS src, c.cmdb_id AS dst FROM spans p JOIN spans c ON p.span_id = c.parent_id AND p.trace_id = c.trace_id WHERE p.cmdb_id <> c.cmdb_id"),
    "topology": ("", "SELECT DISTINCT * FROM (SELECT 'svc_' || (n_nationkey % 12) AS src, 'svc_' || ((n_nationkey * 5 + n_nationkey // 12 + 1) % 12) AS dst FROM nation) WHERE src <> dst"),
    "scores": ("", "SELECT 'm_' || (doc_id % 5) AS entity, doc_id AS idx, CAST(n_chars % 997 AS DOUBLE) AS score, CASE WHEN CAST(floor(doc_id / 20) AS BIGINT) % 3 = 0 THEN 1 ELSE 0 END AS label FROM documents JOIN labels USING (doc_id)"),
    "clustered": ("anomalies", f"""SELECT ts, type, entity, attribute, raw, CASE WHEN coalesce(id, near) IS NULL THEN -1 ELSE CAST(coalesce(id, near) AS BIGINT) END AS cluster_id FROM (SELECT *, min(id) OVER (ORDER BY ts RANGE BETWEEN {EPS} PRECEDING AND {EPS} FOLLOWING) AS near FROM (SELECT *, CASE WHEN core THEN sum(fresh) OVER (ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 END AS id FROM (
        SELECT *, CASE WHEN core AND (prev IS NULL OR ts - prev > {EPS}) AND coalesce(lag(ts) OVER (ORDER BY ts) < ts, true) THEN 1 ELSE 0 END AS fresh FROM (SELECT *, max(CASE WHEN core THEN ts END) OVER (ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM (
        SELECT *, count(*) OVER (ORDER BY ts RANGE BETWEEN {EPS} PRECEDING AND {EPS} FOLLOWING) >= {MIN_SAMPLES} AS core FROM anomalies)))))"""),
    "incidents": ("clustered", "SELECT * FROM clustered WHERE cluster_id >= 0"),
    "reach": ("topology", "SELECT DISTINCT src, dst FROM (WITH RECURSIVE w(src, dst) AS (SELECT src, dst FROM topology UNION SELECT w.src, t.dst FROM w JOIN topology t ON w.dst = t.src) SELECT * FROM w) WHERE src <> dst"),
    "degree": ("topology", "SELECT entity, CAST(sum(i) AS BIGINT) AS in_degree, CAST(sum(o) AS BIGINT) AS out_degree FROM (SELECT src AS entity, 0 AS i, 1 AS o FROM topology UNION ALL SELECT dst, 1, 0 FROM topology) GROUP BY 1"),
    "found": ("incidents", """SELECT cluster_id, entity, total, earliest_ts, fault FROM (SELECT *, max(total) OVER (PARTITION BY cluster_id) AS top FROM (SELECT cluster_id, entity, CAST(sum(n) AS BIGINT) AS total, min(t) AS earliest_ts, arg_max(attribute, (n, -t, attribute)) AS fault FROM (
        SELECT cluster_id, entity, attribute, count(*) AS n, min(ts) AS t FROM (SELECT i.*, s.t0 FROM incidents i JOIN (SELECT cluster_id, k[least(3, len(k))] AS t0 FROM (SELECT cluster_id, list_sort(list(DISTINCT ts)) AS k FROM incidents GROUP BY 1)) s USING (cluster_id)) WHERE ts <= t0 + 28800 GROUP BY ALL) GROUP BY ALL)) WHERE total >= CASE WHEN top >= 2 THEN 2 ELSE 1 END"""),
    "enriched": ("found reach degree", "SELECT f.*, coalesce(d.in_degree, 0) AS in_degree, coalesce(d.out_degree, 0) AS out_degree, CASE WHEN d.in_degree IS NULL THEN 0 ELSE (SELECT count(*) FROM reach r JOIN found g ON g.cluster_id = f.cluster_id AND g.entity = r.dst WHERE r.src = f.entity) + 1 END AS reachable FROM found f LEFT JOIN degree d USING (entity)"),
    "kg": ("incidents topology", """SELECT cluster_id, 'HAS_ANOMALY' AS type, 'entity:' || entity AS src, 'attribute:' || entity || '/' || attribute AS dst, ts FROM incidents
        UNION ALL SELECT DISTINCT cluster_id, 'HAS_ATTRIBUTE', 'entity:' || entity, 'attribute:' || entity || '/' || attribute, CAST(NULL AS BIGINT) FROM incidents
        UNION ALL SELECT DISTINCT cluster_id, 'MAPS_TO_FAULT', 'attribute:' || entity || '/' || attribute, 'fault:' || type, CAST(NULL AS BIGINT) FROM incidents
        UNION ALL SELECT a.cluster_id, 'TOPOLOGY_DEPENDS_ON', 'entity:' || src, 'entity:' || dst, CAST(NULL AS BIGINT) FROM topology JOIN (SELECT DISTINCT cluster_id, entity FROM incidents) a ON a.entity = src JOIN (SELECT DISTINCT cluster_id, entity FROM incidents) b ON b.entity = dst AND b.cluster_id = a.cluster_id"""),
    "near": ("kg", "SELECT DISTINCT cluster_id, a AS id, b AS other FROM (SELECT cluster_id, src AS a, dst AS b FROM kg WHERE type = 'TOPOLOGY_DEPENDS_ON' UNION ALL SELECT cluster_id, dst, src FROM kg WHERE type = 'TOPOLOGY_DEPENDS_ON')"),
    "kgf": ("kg near", """SELECT b.*, coalesce(n.neighbours, 0) AS neighbours FROM (SELECT h.cluster_id, h.src AS id, count(*) AS anomalies, min(h.ts) AS first_ts, max(h.ts) AS last_ts, round(sum(CASE substr(m.dst, 7) WHEN 'metric' THEN 0.6::DOUBLE WHEN 'trace' THEN 1.0::DOUBLE ELSE 0.2::DOUBLE END), 6) AS severity, list_sort(list(DISTINCT substr(m.dst, 7))) AS faults
        FROM kg h JOIN kg m ON m.type = 'MAPS_TO_FAULT' AND m.cluster_id = h.cluster_id AND m.src = h.dst WHERE h.type = 'HAS_ANOMALY' GROUP BY ALL) b LEFT JOIN (SELECT cluster_id, id, count(*) AS neighbours FROM near GROUP BY ALL) n USING (cluster_id, id)"""),
    "paths": ("kg near", """SELECT cluster_id, min(source) AS source, target, ts FROM (SELECT o.cluster_id, p.src AS source, o.src AS target, o.ts FROM (SELECT o.*, t.before FROM (SELECT DISTINCT cluster_id, src, ts FROM kg WHERE type = 'HAS_ANOMALY') o JOIN (SELECT cluster_id, ts, lag(ts) OVER (PARTITION BY cluster_id ORDER BY ts) AS before FROM (SELECT DISTINCT cluster_id, ts FROM kg WHERE type = 'HAS_ANOMALY')) t USING (cluster_id, ts)) o
        JOIN near n ON n.cluster_id = o.cluster_id AND n.id = o.src JOIN (SELECT DISTINCT cluster_id, src, ts FROM kg WHERE type = 'HAS_ANOMALY') p ON p.cluster_id = o.cluster_id AND p.ts = o.before AND p.src = n.other
        WHERE NOT EXISTS (SELECT 1 FROM kg q WHERE q.type = 'HAS_ANOMALY' AND q.cluster_id = o.cluster_id AND q.src = o.src AND q.ts = o.before)) GROUP BY cluster_id, target, ts"""),
    "vectors": ("", "SELECT vec_id AS id, label, list_transform(embedding, lambda v: round(CAST(v AS DOUBLE), 4)) AS x FROM embeddings"),
}
