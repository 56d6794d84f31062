"""Queries for FN operators, keyword search and text reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar as T
from ..operators import rca as A
from ..sources import sinks as K
from .registry import query

R = lambda c, n=6: F.round(c, n)


@query("fn_01_local_time", "SELECT fault_id, strftime(make_timestamp((ts + 28800) * 1000000), '%Y-%m-%d %H:%M:%S') || ' CST' AS text FROM faults", "faults")
def _(t):
    return t.faults.select("fault_id", T.local_text(F.col("ts")).alias("text"))


@query("fn_02_time_nodes", "SELECT fault_id, 'Time_' || strftime(make_timestamp((ts + 28800) * 1000000), '%Y%m%d%H%M') AS node FROM faults", "faults")
def _(t):
    return t.faults.select("fault_id", T.time_node(F.col("ts")).alias("node"))


@query("fn_03_parsed_time", "SELECT o_orderkey, CAST(epoch(o_orderdate) AS BIGINT) AS ts FROM orders")
def _(t):
    return t.orders.select("o_orderkey", T.parsed_time(F.date_format("o_orderdate", "yyyy_MM_dd HH:mm:ss")).alias("ts"))


@query("fn_04_parsed_span", "WITH s(span) AS (VALUES ('0830_1700'), ('0000_0030'), ('2330_2359')) SELECT span, CAST(substr(span, 1, 2) AS INTEGER) * 60 + CAST(substr(span, 3, 2) AS INTEGER) AS a, CAST(substr(span, 6, 2) AS INTEGER) * 60 + CAST(substr(span, 8, 2) AS INTEGER) AS b FROM s")
def _(t):
    s = t.spark.createDataFrame([("0830_1700",), ("0000_0030",), ("2330_2359",)], "span string")
    a, b = T.parsed_span(F.col("span"))
    return s.select("span", a.alias("a"), b.alias("b"))


@query("fn_05_dashed_dates", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders")
def _(t):
    return t.orders.select("o_orderkey", T.dashed(F.date_format("o_orderdate", "yyyy_MM_dd")).alias("day"))


@query("fn_06_alpha_prefix", "SELECT p_partkey, regexp_extract(p_brand, '^[a-zA-Z]+', 0) AS prefix FROM part")
def _(t):
    return t.part.select("p_partkey", T.alpha_prefix(F.col("p_brand")).alias("prefix"))


@query("fn_07_path_safe", "SELECT o_orderkey, translate(translate(o_orderpriority || '(' || o_orderstatus || ')', ' /:', '___'), '()', '') AS name FROM orders")
def _(t):
    return t.orders.select("o_orderkey", T.path_safe(F.concat("o_orderpriority", F.lit("("), "o_orderstatus", F.lit(")"))).alias("name"))


@query("fn_08_category_suffix", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_type || '_' || p_size ELSE p_type END AS suffix FROM part")
def _(t):
    name = F.concat(F.when(F.col("p_partkey") % 2 == 0, "1_min_").otherwise("x_"), "p_type", F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("_"), "p_size")).otherwise(""))
    return t.part.select("p_partkey", T.category_suffix(name).alias("suffix"))


@query("fn_08b_repaired_text", "SELECT doc_id, text FROM documents")
def _(t):
    broken = F.decode(F.encode("text", "UTF-8"), "ISO-8859-1")
    return t.documents.select("doc_id", T.repaired(broken).alias("text"))


@query("fn_09_preview", "SELECT doc_id, translate(left(text, 200), chr(10), ' ') || CASE WHEN length(text) > 200 THEN '...' ELSE '' END AS preview FROM documents")
def _(t):
    return t.documents.select("doc_id", T.preview(F.col("text")).alias("preview"))


_WORDS = ["idiot", "token", "mail", "License", "the of"]


@query("fn_10_words_within", "SELECT doc_id, list_filter(['idiot', 'token', 'mail', 'License', 'the of'], lambda w: contains(lower(text), lower(w))) AS found FROM documents")
def _(t):
    return t.documents.select("doc_id", T.words_within(F.col("text"), _WORDS).alias("found"))


@query("fn_11_json_within", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def _(t):
    text = F.concat(F.when(F.col("event_id") % 2 == 0, "Answer:\n```json\n").otherwise("It is "), "props", F.when(F.col("event_id") % 2 == 0, "\n```").otherwise(" so."))
    return t.events.select("event_id", F.get_json_object(T.json_within(text), "$.k").cast("long").alias("k"))


@query("fn_12_scored_relations", "SELECT event_id, 'k' || (event_id % 7) AS key, CAST((event_id % 10) / 10.0 AS DOUBLE) AS score FROM events UNION ALL SELECT event_id, event_type, 0.5::DOUBLE FROM events")
def _(t):
    text = F.concat(F.lit("1. {k"), (F.col("event_id") % 7).cast("string"), F.lit(" (Score: "), (F.col("event_id") % 10 / 10).cast("string"), F.lit(")}: why\n2. {"), "event_type", F.lit(" (Score: 0.5)}"))
    return t.events.select("event_id", F.explode(T.scored_relations(text)).alias("x")).select("event_id", "x.key", "x.score")


@query("fn_13_table_rows", "SELECT n_nationkey, n_name AS entity, CAST(n_regionkey / 4.0 AS DOUBLE) AS confidence FROM nation")
def _(t):
    text = F.concat(F.lit("| Entity | Confidence |\n|---|---|\n| "), "n_name", F.lit(" | "), (F.col("n_regionkey") / 4).cast("string"), F.lit(" |\n"))
    return t.nation.select("n_nationkey", F.explode(T.table_rows(text)).alias("x")).select("n_nationkey", "x.entity", "x.confidence")


@query("fn_14_template_text", "SELECT event_id, coalesce(n_name, 'Unknown template ' || (user_id % 40)) AS template FROM events LEFT JOIN nation ON n_nationkey = user_id % 40")
def _(t):
    from ..operators.relational import lookup

    dim = t.nation.select(F.col("n_nationkey").cast("long").alias("template_id"), F.col("n_name").alias("template"))
    e = t.events.select("event_id", (F.col("user_id") % 40).alias("template_id"))
    return lookup(e, dim, "template_id", "template", F.concat(F.lit("Unknown template "), "template_id")).select("event_id", "template")


@query("fn_15_cypher_escape", r"SELECT c_custkey, replace(replace(c_name || '''s ' || chr(92), chr(92), chr(92) || chr(92)), '''', chr(92) || '''') AS text FROM customer")
def _(t):
    return t.customer.select("c_custkey", T.cypher_text(F.concat("c_name", F.lit("'s \\"))).alias("text"))


@query("fn_16_short_labels", "SELECT doc_id, left(text, 20) AS label FROM documents")
def _(t):
    return t.documents.select("doc_id", T.short_label(F.col("text")).alias("label"))


@query("fn_17_half_even", "SELECT p_partkey, CAST(round_even(CAST(p_size AS DECIMAL(10, 2)) / 8, 1) AS DOUBLE) AS x FROM part")
def _(t):
    return t.part.select("p_partkey", T.half_even((F.col("p_size") / 8).cast("decimal(10,4)"), 1).cast("double").alias("x"))


@query("fn_18_floor_division", "SELECT c_custkey, CAST(floor(c_acctbal / 900) AS BIGINT) AS x FROM customer")
def _(t):
    return t.customer.select("c_custkey", T.floor_div(F.col("c_acctbal"), 900).alias("x"))


@query("fn_19_array_functions", "SELECT id, x[3:6] AS part, round(sqrt(list_sum(list_transform(x, lambda v: v * v))), 6) AS norm, round(list_sum(list_transform(list_zip(x, list_reverse(x)), lambda z: z[1] * z[2])), 6) AS dot, CAST(list_position(x, list_max(x)) - 1 AS INTEGER) AS top FROM vectors", "vectors")
def _(t):
    return t.vectors.select("id", F.slice("x", 3, 4).alias("part"), T.rounded(T.array_norm(F.col("x")), 6).alias("norm"), T.rounded(T.array_dot(F.col("x"), F.reverse("x")), 6).alias("dot"), T.arg_max(F.col("x")).alias("top"))


@query("fn_20_map_default", "SELECT s_suppkey, CASE s_nationkey WHEN 1 THEN 'one' WHEN 2 THEN 'two' ELSE 'none' END AS name FROM supplier")
def _(t):
    m = F.create_map(F.lit(1), F.lit("one"), F.lit(2), F.lit("two"))
    return t.supplier.select("s_suppkey", T.map_get(m, F.col("s_nationkey"), F.lit("none")).alias("name"))


@query("fn_21_main_entities", "WITH n(name) AS (VALUES ('Tomcat01'), ('os_sub'), ('a->b'), ('pod-1'), ('db:x'), ('Redis02')) SELECT name, NOT regexp_matches(lower(name), 'sub|->|:|-\\d+$') AS is_main FROM n")
def _(t):
    n = t.spark.createDataFrame([(x,) for x in ("Tomcat01", "os_sub", "a->b", "pod-1", "db:x", "Redis02")], "name string")
    return n.select("name", T.is_main_entity(F.col("name")).alias("is_main"))


@query("fn_22_patterns", "SELECT fault_id, level || ' | ' || reason AS pattern FROM faults", "faults")
def _(t):
    return t.faults.select("fault_id", T.pattern_of(F.col("level"), F.col("reason")).alias("pattern"))


@query("src_11_log_times", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE epoch_ms(date_trunc('milliseconds', ts)) END AS ms FROM events")
def _(t):
    line = F.concat(F.when(F.col("event_id") % 3 == 0, "INFO ").otherwise(""), F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSS"), F.lit(" started"))
    return t.events.select("event_id", T.log_time(line).alias("ms"))


@query("rca_18_keywords", r"SELECT doc_id, list_filter(['the', 'idiot', 'of', 'token'], lambda w: regexp_matches(lower(text), '(^|[^\p{L}\p{M}\p{N}_])' || w || '($|[^\p{L}\p{M}\p{N}_])')) AS found FROM documents")
def _(t):
    return t.documents.select("doc_id", A.keywords(F.col("text"), ["the", "idiot", "of", "token"]).alias("found"))


# --- reports and exports -------------------------------------------------------------------------------------------

@query("snk_02_grouped_report", "SELECT entity, attribute, string_agg(strftime(make_timestamp((ts + 28800) * 1000000), '%Y-%m-%d %H:%M:%S') || ' CST', '; ' ORDER BY ts) AS line FROM anomalies GROUP BY ALL", "anomalies")
def _(t):
    return K.report_lines(t.anomalies).select("entity", "attribute", "line")


@query("snk_03_log_query_report", "SELECT type, count(*) AS n, count(DISTINCT entity) AS entities, strftime(make_timestamp((min(ts) + 28800) * 1000000), '%Y-%m-%d %H:%M:%S') || ' CST' AS first FROM anomalies GROUP BY 1", "anomalies")
def _(t):
    from ..functions.scalar import local_text

    return t.anomalies.groupBy("type").agg(F.count("*").alias("n"), F.countDistinct("entity").alias("entities"), F.min("ts").alias("f")).select("type", "n", "entities", local_text(F.col("f")).alias("first"))


@query("snk_06_cypher_script", """SELECT cluster_id, 'MERGE (:' || label || ' {id: ''' || replace(id, '''', chr(92) || '''') || ''', name: ''' || replace(name, '''', chr(92) || '''') || '''});' AS line FROM (SELECT DISTINCT cluster_id, 'entity:' || entity AS id, 'entity' AS label, entity AS name FROM incidents)""", "incidents")
def _(t):
    return K.cypher_nodes(A.kg_nodes(t.incidents).filter("label = 'entity'"))


@query("snk_07_mermaid", "SELECT cluster_id, string_agg('  ' || substr(src, 8) || ' --> ' || substr(dst, 8), chr(10) ORDER BY src, dst) AS body FROM kg WHERE type = 'TOPOLOGY_DEPENDS_ON' GROUP BY 1", "kg")
def _(t):
    return K.mermaid(A.kg_edges(t.incidents, t.topology).filter("type = 'TOPOLOGY_DEPENDS_ON'")).select("cluster_id", "body")


@query("snk_11_multi_grain_report", "WITH s AS (SELECT cluster_id, min(ts) - 600 AS lo, max(ts) + 600 AS hi FROM clustered WHERE cluster_id >= 0 GROUP BY 1) SELECT s.cluster_id, g AS grain, type, CAST(floor(ts / g) * g AS BIGINT) AS bucket_ts, count(*) AS n FROM clustered a JOIN s ON a.ts BETWEEN s.lo AND s.hi CROSS JOIN (VALUES (60), (300), (900)) v(g) GROUP BY ALL", "clustered")
def _(t):
    return K.multi_grain(t.clustered, [60, 300, 900], 600, 600)


@query("snk_12_around_faults", "SELECT fault_id, type, count(*) AS n, min(a.ts) AS first_ts FROM faults f JOIN anomalies a ON a.ts BETWEEN f.ts - 3600 AND f.ts + 18000 GROUP BY ALL", "faults anomalies")
def _(t):
    from ..operators.relational import range_counts

    a = t.anomalies.select("type", F.col("ts").alias("at"))
    return range_counts(t.faults.select("fault_id", "ts"), a, 3600, 18000, "ts", "at", "type", "first_ts").groupBy("fault_id", "type").agg(F.sum("n").alias("n"), F.min("first_ts").alias("first_ts"))


@query("ext_08_prompt", "SELECT cluster_id, string_agg('- ' || id || ': ' || anomalies || ' anomalies, first ' || first_ts, chr(10) ORDER BY anomalies DESC, id) AS prompt FROM kgf GROUP BY 1", "kgf")
def _(t):
    return K.prompt(A.kg_features(A.kg_edges(t.incidents, t.topology)))
