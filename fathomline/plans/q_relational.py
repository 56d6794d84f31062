"""Queries for JN/AGG/SET/RNK operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import relational as X
from ..operators import series as S
from .registry import query

R = lambda c, n=6: F.round(c, n)


@query("jn_01_left_join_fill", "WITH s AS (SELECT entity, count(*) AS n FROM anomalies WHERE attribute = 'view' GROUP BY 1) SELECT e.entity, coalesce(n, 0) AS n FROM (SELECT DISTINCT entity FROM points) e LEFT JOIN s USING (entity)", "anomalies")
def _(t):
    return X.with_stats(t.points.select("entity").distinct(), t.anomalies.filter("attribute = 'view'").groupBy("entity").agg(F.count("*").alias("n")), ["entity"])


@query("jn_02_entity_stats", "WITH m AS (SELECT entity, attribute, count(*) AS n, min(ts) AS f FROM anomalies GROUP BY ALL) SELECT a.entity, a.total, a.earliest, b.attribute AS fault FROM (SELECT entity, count(*) AS total, min(ts) AS earliest FROM anomalies GROUP BY 1) a JOIN (SELECT entity, attribute, row_number() OVER (PARTITION BY entity ORDER BY n DESC, f, attribute DESC) AS r FROM m) b ON a.entity = b.entity AND b.r = 1", "anomalies")
def _(t):
    by = t.anomalies.groupBy("entity", "attribute").agg(F.count("*").alias("n"), F.min("ts").alias("f"))
    return by.groupBy("entity").agg(F.sum("n").alias("total"), F.min("f").alias("earliest"), F.max_by("attribute", F.struct("n", (-F.col("f")).alias("f"), "attribute")).alias("fault"))


@query("jn_03_dimension_lookup", "SELECT s_suppkey, s_nationkey, coalesce(n_name, 'Unknown_' || s_nationkey) AS n_name FROM supplier LEFT JOIN (SELECT * FROM nation WHERE n_nationkey < 20) ON s_nationkey = n_nationkey")
def _(t):
    dim = t.nation.filter("n_nationkey < 20").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    return X.lookup(t.supplier.select("s_suppkey", "s_nationkey"), dim, "s_nationkey", "n_name", F.concat(F.lit("Unknown_"), "s_nationkey"))


@query("jn_04_associated_lists", "WITH m AS (SELECT DISTINCT entity, bucket_ts FROM samples WHERE feature = 'view'), s AS (SELECT * FROM samples WHERE value > 80) SELECT m.entity, m.bucket_ts, count(s.value) AS n, sum(s.value) AS total FROM m LEFT JOIN s USING (entity, bucket_ts) GROUP BY ALL", "samples")
def _(t):
    s = t.samples
    out = X.associated(s.filter("value > 80"), s.filter("feature = 'view'").select("entity", "bucket_ts"), ["entity", "bucket_ts"])
    return out.select("entity", "bucket_ts", "n", F.when(F.col("n") > 0, F.aggregate("details", F.lit(0.0), lambda a, x: a + x["value"])).alias("total"))


@query("jn_05_range_join", "SELECT fault_id, event_id FROM faults f JOIN points p ON p.ts BETWEEN f.ts - 600 AND f.ts + 3000 WHERE p.feature = 'error'", "faults points")
def _(t):
    p = t.points.filter("feature = 'error'").select("event_id", F.col("ts").alias("at"))
    return X.range_join(t.faults.select("fault_id", "ts"), p, 600, 3000, "ts", "at").select("fault_id", "event_id")


@query("jn_06_nearest_clean_slot", """WITH f AS (SELECT fault_id, component, CAST(floor(ts / 1800) AS BIGINT) % 48 AS slot FROM faults), taken AS (SELECT DISTINCT component, slot FROM f), clean AS (SELECT component, s AS clean_slot FROM (SELECT DISTINCT component FROM f) CROSS JOIN range(48) r(s) WHERE (component, s) NOT IN (SELECT (component, slot) FROM taken))
SELECT fault_id, slot, clean_slot FROM (SELECT f.*, clean_slot, row_number() OVER (PARTITION BY fault_id ORDER BY abs(slot - clean_slot), clean_slot) AS r FROM f JOIN clean USING (component)) WHERE r = 1""", "faults")
def _(t):
    f = t.faults.select("fault_id", "component", (F.floor(F.col("ts") / 1800) % 48).alias("slot"))
    return X.nearest_clean_slot(f, X.free_slots(f, ["component"], 48), ["component"]).select("fault_id", "slot", "clean_slot")


@query("jn_07_slots_without_faults", "WITH f AS (SELECT DISTINCT component, CAST(floor(ts / 1800) AS BIGINT) % 48 AS slot FROM faults) SELECT g.component, g.slot FROM (SELECT component, s AS slot FROM (SELECT DISTINCT component FROM f) CROSS JOIN range(48) r(s)) g ANTI JOIN f ON f.component = g.component AND f.slot = g.slot", "faults")
def _(t):
    f = t.faults.select("component", (F.floor(F.col("ts") / 1800) % 48).alias("slot"))
    return X.free_slots(f, ["component"], 48)


@query("jn_08_aligned_entities", "SELECT entity, count(*) AS n FROM samples WHERE feature = 'view' AND entity IN (SELECT entity FROM samples WHERE feature = 'click' AND value > 180) GROUP BY 1", "samples")
def _(t):
    a, _ = X.aligned(t.samples.filter("feature = 'view'"), t.samples.filter("feature = 'click' and value > 180"), "entity")
    return a.groupBy("entity").agg(F.count("*").alias("n"))


@query("jn_09_calls", "SELECT c.trace_id, c.span_id AS child, p.cmdb_id AS src, c.cmdb_id AS dst FROM spans p JOIN spans c ON p.span_id = c.parent_id AND p.trace_id = c.trace_id WHERE p.cmdb_id <> c.cmdb_id", "spans")
def _(t):
    return X.calls(t.spans)


@query("jn_12_merged_scores", "WITH a AS (SELECT entity, CAST(count(*) AS DOUBLE) AS score FROM anomalies WHERE attribute IN ('view', 'click') GROUP BY 1), b AS (SELECT entity, CAST(count(*) AS DOUBLE) AS score FROM anomalies WHERE attribute = 'error' GROUP BY 1) SELECT entity, round(0.6 * coalesce(a.score, 0) + 0.4 * coalesce(b.score, 0), 6) AS score FROM a FULL JOIN b USING (entity)", "anomalies")
def _(t):
    n = lambda d: d.groupBy("entity").agg(F.count("*").cast("double").alias("score"))
    a = t.anomalies
    return X.merged_scores(n(a.filter("attribute in ('view', 'click')")), n(a.filter("attribute = 'error'")), 0.6, 0.4, ["entity"]).withColumn("score", R("score"))


_RANKED = "ranked AS (SELECT attribute AS cluster_id, entity, row_number() OVER (PARTITION BY attribute ORDER BY n DESC, entity) AS rank FROM (SELECT attribute, entity, count(*) AS n FROM anomalies GROUP BY ALL)), truth AS (SELECT attribute AS cluster_id, min(entity) AS root_cause_entity FROM anomalies GROUP BY 1)"


def _ranked(t):
    n = t.anomalies.groupBy(F.col("attribute").alias("cluster_id"), "entity").agg(F.count("*").alias("n"))
    ranked = n.withColumn("rank", F.row_number().over(Window.partitionBy("cluster_id").orderBy(F.desc("n"), "entity")))
    return ranked, t.anomalies.groupBy(F.col("attribute").alias("cluster_id")).agg(F.min("entity").alias("root_cause_entity"))


@query("jn_13_top_hits", f"WITH {_RANKED} SELECT cluster_id, CAST(max(CASE WHEN rank = 1 AND entity = root_cause_entity THEN 1 ELSE 0 END) AS INTEGER) AS hit1, CAST(max(CASE WHEN rank <= 3 AND entity = root_cause_entity THEN 1 ELSE 0 END) AS INTEGER) AS hit3 FROM ranked JOIN truth USING (cluster_id) GROUP BY 1", "anomalies")
def _(t):
    return X.top_hits(*_ranked(t))


@query("agg_16_accuracy", f"WITH {_RANKED}, h AS (SELECT cluster_id, max(CASE WHEN rank = 1 AND entity = root_cause_entity THEN 1 ELSE 0 END) AS h1, max(CASE WHEN rank <= 3 AND entity = root_cause_entity THEN 1 ELSE 0 END) AS h3 FROM ranked JOIN truth USING (cluster_id) GROUP BY 1) SELECT count(*) AS n, round(avg(h1), 6) AS top1, round(avg(h3), 6) AS top3 FROM h", "anomalies")
def _(t):
    return X.accuracy(X.top_hits(*_ranked(t))).select("n", R("top1").alias("top1"), R("top3").alias("top3"))


@query("jn_14_row_numbers", "SELECT f.fault_id, r.row_no FROM faults f JOIN (SELECT *, row_number() OVER (ORDER BY o_orderkey) AS row_no FROM orders) r ON r.o_orderpriority = f.level AND r.o_orderstatus = f.reason AND r.o_orderkey = f.fault_id", "faults")
def _(t):
    rows = t.orders.select(F.col("o_orderpriority").alias("level"), F.col("o_orderstatus").alias("reason"), F.col("o_orderkey").alias("fault_id"))
    return t.faults.join(X.numbered(rows, "fault_id", "row_no"), ["level", "reason", "fault_id"]).select("fault_id", "row_no")


@query("jn_15_graph_incidence", "SELECT e.src, e.dst, s.n AS src_calls, d.n AS dst_calls FROM edges e JOIN (SELECT cmdb_id, count(*) AS n FROM spans GROUP BY 1) s ON s.cmdb_id = e.src JOIN (SELECT cmdb_id, count(*) AS n FROM spans GROUP BY 1) d ON d.cmdb_id = e.dst", "edges")
def _(t):
    n = t.spans.groupBy("cmdb_id").agg(F.count("*").alias("n"))
    return t.edges.join(n.select(F.col("cmdb_id").alias("src"), F.col("n").alias("src_calls")), "src").join(n.select(F.col("cmdb_id").alias("dst"), F.col("n").alias("dst_calls")), "dst").select("src", "dst", "src_calls", "dst_calls")


@query("agg_01_counts", "SELECT entity, count(*) AS n FROM anomalies GROUP BY 1", "anomalies")
def _(t):
    return t.anomalies.groupBy("entity").agg(F.count("*").alias("n"))


@query("agg_02_endpoint_counts", "SELECT entity, count(*) AS cnt FROM (SELECT src AS entity FROM edges UNION ALL SELECT dst FROM edges) GROUP BY 1", "edges")
def _(t):
    return X.endpoint_counts(t.edges)


@query("agg_03_earliest_latest", "SELECT entity, attribute, min(ts) AS first_ts, max(ts) AS last_ts FROM anomalies GROUP BY ALL", "anomalies")
def _(t):
    return t.anomalies.groupBy("entity", "attribute").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query("agg_04_mode", "SELECT entity, attribute FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY n DESC, f, attribute DESC) AS r FROM (SELECT entity, attribute, count(*) AS n, min(ts) AS f FROM anomalies GROUP BY ALL)) WHERE r = 1", "anomalies")
def _(t):
    return X.most_common(t.anomalies, ["entity"], "attribute", "ts")


@query("agg_05_first_rows", "SELECT component, arg_min(level, fault_id) AS level, arg_min(reason, fault_id) AS reason FROM faults GROUP BY 1", "faults")
def _(t):
    return X.first_rows(t.faults, ["component"], ["level", "reason"], "fault_id")


@query("agg_06_value_counts", "SELECT level || ' | ' || reason AS pattern, count(*) AS n FROM faults GROUP BY 1 HAVING count(*) >= 2", "faults")
def _(t):
    return t.faults.groupBy(F.concat_ws(" | ", "level", "reason").alias("pattern")).agg(F.count("*").alias("n")).filter("n >= 2")


@query("agg_07_attribute_counts", "SELECT entity, string_agg(attribute || '=' || n, ',' ORDER BY attribute) AS counts, CAST(count(*) AS INTEGER) AS kinds FROM (SELECT entity, attribute, count(*) AS n FROM anomalies GROUP BY ALL) GROUP BY 1", "anomalies")
def _(t):
    out = X.attribute_counts(t.anomalies, ["entity"])
    return out.select("entity", F.array_join(F.transform(F.array_sort(F.map_entries("counts")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("counts"), "kinds")


@query("agg_08_sorted_lists", "SELECT entity, attribute, list_sort(list(ts)) AS times FROM anomalies GROUP BY ALL", "anomalies")
def _(t):
    return t.anomalies.groupBy("entity", "attribute").agg(F.array_sort(F.collect_list("ts")).alias("times"))


@query("agg_09_label_sums", "SELECT entity, CAST(sum(CASE WHEN value > 60 THEN 1 ELSE 0 END) AS BIGINT) AS flagged FROM samples GROUP BY 1", "samples")
def _(t):
    return t.samples.groupBy("entity").agg(F.sum((F.col("value") > 60).cast("int")).alias("flagged"))


_CONF = "CAST(count(*) FILTER (pred = 1 AND label = 1) AS BIGINT) AS tp, CAST(count(*) FILTER (pred = 0 AND label = 0) AS BIGINT) AS tn, CAST(count(*) FILTER (pred = 1 AND label = 0) AS BIGINT) AS fp, CAST(count(*) FILTER (pred = 0 AND label = 1) AS BIGINT) AS fn"
_F1 = "tp, tn, fp, fn, round(tp / (tp + fp + 1e-5), 6) AS precision, round(tp / (tp + fn + 1e-5), 6) AS recall, round(2 * (tp / (tp + fp + 1e-5)) * (tp / (tp + fn + 1e-5)) / (tp / (tp + fp + 1e-5) + tp / (tp + fn + 1e-5) + 1e-5), 6) AS f1"


def _f1cols():
    return ["tp", "tn", "fp", "fn", *[R(c).alias(c) for c in ("precision", "recall", "f1")]]


def predicted(t):
    return t.scores.withColumn("pred", (F.col("score") > 700).cast("int"))


@query("agg_10_confusion", f"WITH c AS (SELECT entity, {_CONF} FROM (SELECT *, CASE WHEN score > 700 THEN 1 ELSE 0 END AS pred FROM scores) GROUP BY 1) SELECT entity, {_F1} FROM c", "scores")
def _(t):
    return X.confusion(predicted(t), keys=["entity"]).select("entity", *_f1cols())


@query("agg_11_micro_and_cluster_f1", f"WITH c AS (SELECT entity, {_CONF} FROM (SELECT *, CASE WHEN score > 700 THEN 1 ELSE 0 END AS pred FROM scores) GROUP BY GROUPING SETS ((entity), ())) SELECT entity, {_F1} FROM c", "scores")
def _(t):
    return X.confusion_by_cluster(predicted(t), "entity").select("entity", *_f1cols())


@query("agg_12_percentiles", "SELECT entity, feature, round(quantile_cont(value, 0.99), 6) AS p99 FROM samples GROUP BY ALL", "samples")
def _(t):
    return t.samples.groupBy("entity", "feature").agg(R(F.percentile("value", 0.99)).alias("p99"))


@query("agg_13_mean_deviation", "SELECT entity, feature, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS deviation FROM samples GROUP BY ALL", "samples")
def _(t):
    return t.samples.groupBy("entity", "feature").agg(R(F.avg("value")).alias("mean"), R(F.stddev_pop("value")).alias("deviation"))


@query("agg_17_offset_histogram", "SELECT least(5, CAST(floor(m / 5) AS BIGINT)) AS bin, count(*) AS n FROM (SELECT floor((ts % 1800) / 60) AS m FROM faults) GROUP BY 1", "faults")
def _(t):
    return t.faults.groupBy(F.least(F.lit(5).cast("long"), F.floor(F.floor(F.col("ts") % 1800 / 60) / 5)).alias("bin")).agg(F.count("*").alias("n"))


@query("agg_18_token_stats", "SELECT count(*) AS files, min(n) AS low, max(n) AS high, round(avg(n), 6) AS mean, CAST(sum(n) AS BIGINT) AS total FROM (SELECT CAST(len(regexp_extract_all(text, '\\S+')) AS BIGINT) AS n FROM conversations)")
def _(t):
    return X.token_stats(t.conversations, "text").withColumn("mean", R("mean"))


@query("agg_20_distinct_graphs", "WITH g AS (SELECT c.trace_id, list_sort(list(DISTINCT p.cmdb_id || '->' || c.cmdb_id)) AS graph FROM spans p JOIN spans c ON p.span_id = c.parent_id AND p.trace_id = c.trace_id WHERE p.cmdb_id <> c.cmdb_id GROUP BY 1) SELECT graph, count(*) AS traces FROM g GROUP BY 1", "spans")
def _(t):
    return X.distinct_graphs(X.calls(t.spans))


@query("agg_21_contingency", "WITH c AS (SELECT label, CAST(vec_id % 4 AS BIGINT) AS pred, count(*) AS n FROM embeddings GROUP BY ALL) SELECT label, pred, n, round(n / sum(n) OVER (PARTITION BY label), 6) AS of_label, round(n / sum(n) OVER (PARTITION BY pred), 6) AS of_pred FROM c")
def _(t):
    out = X.contingency(t.embeddings.select("label", (F.col("vec_id") % 4).alias("pred")), "label", "pred")
    return out.select("label", "pred", "n", R("of_label").alias("of_label"), R("of_pred").alias("of_pred"))


@query("agg_23_cluster_agreement", """WITH c AS (SELECT label, pred, CAST(count(*) AS DOUBLE) AS n FROM (SELECT label, (label + vec_id % 3 // 2) % 7 AS pred FROM embeddings) GROUP BY ALL), j AS (SELECT sum(n * (n - 1) / 2) AS same, sum(n) AS n, sum(n * ln(n)) AS hj FROM c), r AS (SELECT sum(n * (n - 1) / 2) AS r, sum(n * ln(n)) AS hr FROM (SELECT sum(n) AS n FROM c GROUP BY label)), k AS (SELECT sum(n * (n - 1) / 2) AS c, sum(n * ln(n)) AS hc FROM (SELECT sum(n) AS n FROM c GROUP BY pred)),
x AS (SELECT *, n * (n - 1) / 2 AS allp, ln(n) - hr / n AS hl, ln(n) - hc / n AS hp, ln(n) + (hj - hr - hc) / n AS mi FROM j, r, k)
SELECT round((allp + 2 * same - r - c) / allp, 6) AS rand, round((same - r * c / allp) / ((r + c) / 2 - r * c / allp), 6) AS adjusted_rand, round(same / sqrt(r * c), 6) AS fowlkes_mallows, round(2 * mi / (hl + hp), 6) AS nmi, round(mi / hl, 6) AS homogeneity, round(mi / hp, 6) AS completeness, round(2 * (mi / hl) * (mi / hp) / (mi / hl + mi / hp), 6) AS v_measure FROM x""")
def _(t):
    e = t.embeddings.select("label", ((F.col("label") + F.floor(F.col("vec_id") % 3 / 2)) % 7).alias("pred"))
    out = X.pair_measures(e, "label", "pred")
    return out.select(*[R(c).alias(c) for c in out.columns])


@query("rnk_01_top_scores", "SELECT entity, n FROM (SELECT entity, count(*) AS n FROM anomalies GROUP BY 1) ORDER BY n DESC, entity LIMIT 5", "anomalies")
def _(t):
    return t.anomalies.groupBy("entity").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "entity").limit(5)


@query("rnk_02_multi_key_order", "SELECT entity, row_number() OVER (ORDER BY n DESC, kinds DESC, first_ts, entity) AS place FROM (SELECT entity, count(*) AS n, count(DISTINCT attribute) AS kinds, min(ts) AS first_ts FROM anomalies GROUP BY 1)", "anomalies")
def _(t):
    e = t.anomalies.groupBy("entity").agg(F.count("*").alias("n"), F.countDistinct("attribute").alias("kinds"), F.min("ts").alias("first_ts"))
    return X.numbered(e.withColumn("first", -F.col("n")), "first", "place", [F.desc("kinds"), F.asc_nulls_last("first_ts"), "entity"]).select("entity", "place")


@query("rnk_03_largest", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def _(t):
    return t.orders.select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10)


@query("rnk_04_top_features", "SELECT entity, bucket_ts, feature, value, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY entity, bucket_ts ORDER BY value DESC, feature) AS rank FROM samples) WHERE rank <= 2", "samples")
def _(t):
    return X.top_per_group(t.samples, ["entity", "bucket_ts"], [F.desc("value"), "feature"], 2)


@query("rnk_05_dedupe_first", "SELECT type, entity, attribute, hour, arg_min(raw, CAST(raw AS BIGINT)) AS raw FROM (SELECT type, entity, attribute, CAST(floor(ts / 36000) AS BIGINT) AS hour, raw FROM anomalies) GROUP BY ALL", "anomalies")
def _(t):
    a = t.anomalies.select("type", "entity", "attribute", F.floor(F.col("ts") / 36000).alias("hour"), "raw", F.col("raw").cast("long").alias("seq"))
    return X.dedupe_first(a, ["type", "entity", "attribute", "hour"], "seq").drop("seq")


@query("rnk_06_arg_min", "SELECT feature, arg_min(entity, (mean, entity)) AS entity FROM (SELECT feature, entity, round(avg(value), 6) AS mean FROM samples GROUP BY ALL) GROUP BY 1", "samples")
def _(t):
    m = t.samples.groupBy("feature", "entity").agg(R(F.avg("value")).alias("mean"))
    return m.groupBy("feature").agg(F.min_by("entity", F.struct("mean", "entity")).alias("entity"))


@query("set_01_union", "SELECT entity FROM (SELECT src AS entity FROM edges UNION ALL SELECT dst FROM edges)", "edges")
def _(t):
    return t.edges.select(F.col("src").alias("entity")).unionByName(t.edges.select(F.col("dst").alias("entity")))


@query("set_02_intersect", "SELECT src, dst FROM edges INTERSECT SELECT dst, src FROM edges", "edges")
def _(t):
    return t.edges.intersect(t.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


@query("set_03_except", "WITH f AS (SELECT DISTINCT component, CAST(floor(ts / 86400) AS BIGINT) AS day FROM faults) SELECT component, day FROM f EXCEPT SELECT component, day + 1 FROM f", "faults")
def _(t):
    f = t.faults.select("component", F.floor(F.col("ts") / 86400).alias("day")).distinct()
    return f.subtract(f.select("component", (F.col("day") + 1).alias("day")))


@query("set_04_array_union", "SELECT entity, list_sort(list(DISTINCT attribute)) AS kinds FROM anomalies GROUP BY 1", "anomalies")
def _(t):
    a = t.anomalies.groupBy("entity").agg(F.collect_set(F.when(F.col("ts") % 2 == 0, F.col("attribute"))).alias("x"), F.collect_set(F.when(F.col("ts") % 2 == 1, F.col("attribute"))).alias("y"))
    return a.select("entity", F.array_sort(F.array_union("x", "y")).alias("kinds"))
