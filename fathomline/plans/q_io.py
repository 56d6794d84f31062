"""Queries that write by a sink and read back by a source."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import rca as A
from ..operators import series as S
from ..sources import readers, sinks
from ..storage import shared_folder
from .registry import query

START = 1704067200


def _path(t, name: str) -> str:
    """A new folder in the shared one."""
    return f"{shared_folder(t.spark)}/fathomline-io/{uuid.uuid4().hex}/{name}"


@query("src_02_metadata_json", "SELECT n_regionkey, count(*) AS names FROM nation GROUP BY 1")
def _(t):
    p = _path(t, "meta")
    sinks.write_jsonl(t.nation.groupBy("n_regionkey").agg(F.collect_list("n_name").alias("columns")), p)
    return t.spark.read.schema("n_regionkey int, columns array<string>").json(p).select("n_regionkey", F.size("columns").cast("long").alias("names"))


@query("src_03_csv", "SELECT fault_id, level, reason, component, ts FROM faults", "faults")
def _(t):
    p = _path(t, "faults")
    sinks.write_csv(t.faults, p)
    return readers.csv(t.spark, p, "fault_id long, level string, reason string, component string, ts long")


@query("src_04_matrix_text", "WITH l AS (SELECT 'machine-' || (l_suppkey % 3) || '-' || l_suppkey AS machine, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) - 1 AS i, l_quantity, l_extendedprice FROM lineitem) SELECT machine, CAST(i AS INTEGER) AS idx, l_quantity AS a, l_extendedprice AS b FROM l WHERE i < (SELECT min(n) FROM (SELECT count(*) AS n FROM l GROUP BY machine))")
def _(t):
    p = _path(t, "matrix")
    order = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity")
    rows = t.lineitem.groupBy("l_suppkey").agg(F.array_sort(F.collect_list(order)).alias("x"))  # a supplier's lines, as one file is a machine's
    machine = F.concat(F.lit("machine-"), F.col("l_suppkey") % 3, F.lit("-"), "l_suppkey").alias("machine")
    body = rows.select(machine, F.array_join(F.transform("x", lambda r: F.concat_ws(",", r["l_quantity"], r["l_extendedprice"])), "\n").alias("value"))
    sinks.write_text(body, p, by=["machine"])
    back = readers.matrix_text(t.spark, p)
    return back.select("machine", "idx", F.col("values")[0].alias("a"), F.col("values")[1].alias("b"))


@query("src_05_log_templates", "SELECT CAST(row_number() OVER (ORDER BY n_regionkey, n_nationkey) - 1 AS INTEGER) AS template_id, CAST(n_regionkey AS VARCHAR) AS lang, n_name AS text FROM nation")
def _(t):
    p = _path(t, "templates")
    m = t.nation.groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("x"))
    one = m.groupBy().agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(F.col("n_regionkey").cast("string"), F.col("x.n_name"))))).alias("value"))
    one.coalesce(1).write.text(p)
    return readers.templates(t.spark, p)


@query("src_06_json_lines", "SELECT event_id, event_type FROM events WHERE event_id % 5 <> 0")
def _(t):
    p = _path(t, "lines")
    good = F.to_json(F.struct("event_id", "event_type"))
    t.events.select(F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("{oops "), good)).otherwise(good).alias("value")).write.text(p)
    return readers.json_lines(t.spark, p, "event_id long, event_type string")


@query("src_07_kg_folder", "SELECT cluster_id, CAST(count(DISTINCT entity) + count(DISTINCT entity || '/' || attribute) + count(DISTINCT type) AS BIGINT) AS nodes FROM incidents GROUP BY 1", "incidents")
def _(t):
    p = _path(t, "kg")
    docs = sinks.kg_json(A.kg_nodes(t.incidents), A.kg_edges(t.incidents, t.topology))
    sinks.write_text(docs, p, by=["cluster_id"])
    schema = "cluster_id long, nodes array<struct<id:string,label:string,name:string>>"
    back = t.spark.read.option("recursiveFileLookup", True).text(p).select(F.from_json("value", schema).alias("x"))
    return back.select("x.cluster_id", F.size("x.nodes").cast("long").alias("nodes"))


@query("src_08_partitioned_store", "SELECT ts, entity, attribute FROM anomalies WHERE ts BETWEEN 1704499200 AND 1705276800 AND type IN ('metric', 'log')", "anomalies")
def _(t):
    p = _path(t, "store")
    rows = t.anomalies.withColumn("grain", F.lit("1min")).withColumn("date", F.date_format(F.timestamp_seconds("ts"), "yyyy-MM-dd")).withColumn("category", F.col("type"))
    sinks.write_store(rows, p, ["grain", "date", "category"])
    return sinks.query_anomalies(t.spark, p, 1704499200, 1705276800, "1min", ["metric", "log"]).select("ts", "entity", "attribute")


@query("src_09_union_scan", "SELECT ts, type, entity, attribute FROM (SELECT DISTINCT ts, type, entity, attribute FROM anomalies)", "anomalies")
def _(t):
    a = t.anomalies
    parts = {k: a.filter(F.col("type") == k).drop("type", "raw") if k == "log" else a.filter(F.col("type") == k).drop("type") for k in ("metric", "trace", "log")}
    return readers.union_of(parts).select("ts", "type", "entity", "attribute").distinct()


@query("src_10_parsed_report", "SELECT DISTINCT cluster_id, entity, attribute FROM incidents", "incidents")
def _(t):
    p = _path(t, "report")
    lines = t.incidents.select("cluster_id", "entity", "attribute").distinct().groupBy("cluster_id").agg(F.array_join(F.collect_list(F.concat(F.lit("  Entity "), "entity", F.lit(" | Attribute "), "attribute")), "\n").alias("b"))
    sinks.write_text(lines.select(F.concat(F.lit("Cluster #"), "cluster_id", F.lit("\n"), "b", F.lit("\n")).alias("value")), p)
    return readers.parsed_report(t.spark, p)


@query("snk_01_parquet_store", "SELECT ts, type, entity, attribute, raw FROM anomalies", "anomalies")
def _(t):
    p = _path(t, "anomalies")
    t.anomalies.write.parquet(p)
    return t.spark.read.schema(readers.ANOMALIES).parquet(p)


@query("snk_04_kg_json", "SELECT cluster_id, count(*) AS anomalies FROM incidents GROUP BY 1", "incidents")
def _(t):
    docs = sinks.kg_json(A.kg_nodes(t.incidents), A.kg_edges(t.incidents, t.topology))
    schema = "relationships array<struct<type:string,source:string,target:string,timestamp:bigint>>"
    own = F.filter(F.from_json("value", schema)["relationships"], lambda r: r["type"] == "HAS_ANOMALY")
    return docs.select("cluster_id", F.size(own).cast("long").alias("anomalies"))


@query("snk_05_gexf", "SELECT cluster_id, count(DISTINCT entity) AS entities FROM incidents GROUP BY 1", "incidents")
def _(t):
    g = sinks.gexf(A.kg_nodes(t.incidents), A.kg_edges(t.incidents, t.topology))
    return g.select("cluster_id", F.regexp_count("value", F.lit('<node id="entity:')).cast("long").alias("entities"))


@query("snk_08_csv_table", "SELECT entity, feature, round(sum(value), 3) AS total FROM samples GROUP BY ALL", "samples")
def _(t):
    p = _path(t, "table")
    sinks.write_csv(t.samples.groupBy("entity", "feature").agg(F.round(F.sum("value"), 3).alias("total")), p)
    return readers.csv(t.spark, p, "entity string, feature string, total double")


@query("snk_09_cluster_json", "SELECT label AS cluster, count(*) AS members FROM vectors GROUP BY 1", "vectors")
def _(t):
    p = _path(t, "clusters")
    sinks.write_jsonl(t.vectors.groupBy(F.col("label").alias("cluster")).agg(F.array_sort(F.collect_list("id")).alias("members")), p)
    return t.spark.read.schema("cluster int, members array<long>").json(p).select("cluster", F.size("members").cast("long").alias("members"))


@query("snk_10_chunk_lines", "SELECT fault_id, component, [level, reason] AS symptoms FROM faults", "faults")
def _(t):
    p = _path(t, "chunks")
    sinks.write_jsonl(t.faults.select("fault_id", "component", F.array("level", "reason").alias("symptoms")), p)
    return t.spark.read.schema("fault_id long, component string, symptoms array<string>").json(p)


@query("win_21_valid_windows", "WITH taken AS (SELECT DISTINCT component, CAST(floor(ts / 1800) AS BIGINT) % 48 AS s FROM faults), g AS (SELECT c.component, i AS slot, t.s IS NULL AS clean FROM (SELECT DISTINCT component FROM faults) c CROSS JOIN range(48) r(i) LEFT JOIN taken t ON t.component = c.component AND t.s = i) SELECT component, slot FROM (SELECT *, lag(clean) OVER (PARTITION BY component ORDER BY slot) AS before FROM g) WHERE clean AND before", "faults")
def _(t):
    from ..operators.relational import free_slots

    clean = free_slots(t.faults.select("component", (F.floor(F.col("ts") / 1800) % 48).alias("slot")), ["component"], 48)
    return clean.join(clean.select("component", (F.col("slot") + 1).alias("slot")), ["component", "slot"])


@query("flt_04_around_fault_window", "SELECT fault_id, raw FROM faults f JOIN anomalies a ON a.ts BETWEEN f.ts - 60 AND f.ts + 300", "faults anomalies")
def _(t):
    from ..operators.relational import range_join

    return range_join(t.faults.select("fault_id", "ts"), t.anomalies.select("raw", F.col("ts").alias("at")), 60, 300, "ts", "at").select("fault_id", "raw")


@query("str_03_batch_buckets", "SELECT event_type, CAST(floor(epoch(ts) / 900) * 900 AS BIGINT) AS bucket_ts, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def _(t):
    from ..streaming.windows import bucketed

    return bucketed(t.events.withColumn("ts", F.col("ts").cast("timestamp")), "15 minutes").select("event_type", "bucket_ts", "n", F.round("total", 4).alias("total"))


@query("prj_01b_wide_round_trip", "SELECT entity, feature, bucket_ts, value FROM samples", "samples")
def _(t):
    s = S.pack(t.samples)
    return s.select("entity", "feature", F.explode(F.arrays_zip("ts", "values")).alias("x")).select("entity", "feature", F.col("x.ts").alias("bucket_ts"), F.col("x.values").alias("value"))
