"""Queries for thresholds with state, detectors, streams and plug-ins."""

from __future__ import annotations


from pyspark.sql import functions as F

from ..operators import blocks
from ..operators import detectors as M
from ..operators import distance as D
from ..operators import narrator as N
from ..operators import rca as A
from ..operators import spot
from ..sources import sinks as K
from ..streaming import spot as stream_spot
from ..streaming import windows as W
from ..storage import shared_folder
from .registry import query

R = lambda c, n=6: F.round(c, n)
START = 1704067200


def _folder(t) -> str:
    return shared_folder(t.spark)


def _events(t):
    """The events as a stream of files."""
    e = t.table("events")
    return t.spark.readStream.schema(e.schema).parquet(f"{t.dir}/events*.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


@query("det_03_pot_threshold")
def _(t):
    return spot.pot_threshold(t.scores, ["entity"], 1e-2, 0.9)


@query("det_03b_sequential_threshold")
def _(t):
    return spot.sequential_flags(t.scores, ["entity"], 40, 1e-2, 0.9)


@query("det_04_two_tails")
def _(t):
    return spot.sequential_flags(t.scores, ["entity"], 40, 1e-2, 0.9, both=True)


@query("det_05_drift")
def _(t):
    return spot.sequential_flags(t.scores, ["entity"], 40, 1e-2, 0.9, depth=10)


@query("det_06_two_tails_drift")
def _(t):
    return spot.sequential_flags(t.scores, ["entity"], 40, 1e-2, 0.9, both=True, depth=10)


_P = "(PARTITION BY entity, feature ORDER BY bucket_ts ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING)"


@query("det_14_pca_reconstruction")
def _(t):
    d = M.detector("pca", features=["click", "error", "purchase", "signup", "view"])
    d.fit(t.samples)
    return d.score(t.samples).withColumn("score", R("score", 4))


def _rolling_likelihood(frame: str) -> str:
    return f"SELECT entity, feature, bucket_ts, round(coalesce(0.5 * ((value - m) / s) ** 2 + ln(s) + 0.9189385332046727, 0), 4) AS score FROM (SELECT *, avg(value) OVER {frame} AS m, CASE WHEN count(*) OVER {frame} >= 4 THEN greatest(stddev_pop(value) OVER {frame}, 0.5) END AS s FROM samples)"


@query("det_14_rolling_likelihood", _rolling_likelihood(_P), "samples")
def _(t):
    return M.detector("rolling_gaussian", least=0.5).score(t.samples).select("entity", "feature", "bucket_ts", R("score", 4).alias("score"))


@query("det_14_static_likelihood", f"WITH f AS (SELECT entity, feature, avg(value) AS m, greatest(stddev_pop(value), 0.001) AS s FROM samples WHERE bucket_ts < {START + 1296000} GROUP BY ALL) SELECT entity, feature, bucket_ts, round(0.5 * ((value - m) / s) ** 2 + ln(s) + 0.9189385332046727, 5) AS score FROM samples JOIN f USING (entity, feature) WHERE bucket_ts >= {START + 1296000}", "samples")
def _(t):
    d = M.detector("static_gaussian")
    s = t.samples
    model = d.fit(s.filter(F.col("bucket_ts") < START + 1296000))
    return d.score(s.filter(F.col("bucket_ts") >= START + 1296000), model).select("entity", "feature", "bucket_ts", R("score", 5).alias("score"))


@query("det_14_rolling_error", f"SELECT entity, feature, bucket_ts, round(coalesce((value - avg(value) OVER {_P}) ** 2, 0), 4) AS score FROM samples", "samples")
def _(t):
    return M.detector("rolling_mean").score(t.samples).select("entity", "feature", "bucket_ts", R("score", 4).alias("score"))


@query("det_14_seasonal_error", "SELECT entity, feature, bucket_ts, round(coalesce((value - lag(value, 4) OVER (PARTITION BY entity, feature ORDER BY bucket_ts)) ** 2, 0), 4) AS score FROM samples", "samples")
def _(t):
    return M.detector("seasonal_naive").score(t.samples).select("entity", "feature", "bucket_ts", R("score", 4).alias("score"))


_CL = "c AS (SELECT DISTINCT entity, CAST(substr(entity, 5) AS INTEGER) % 3 AS cluster, 'svc_' || (CAST(substr(entity, 5) AS INTEGER) % 3) AS center FROM samples), m AS (SELECT cluster, feature, avg(value) AS m, greatest(stddev_pop(value), 0.001) AS s FROM samples JOIN c USING (entity) WHERE entity = center GROUP BY ALL)"


def _clusters(t):
    n = F.substring("entity", 5, 3).cast("int") % 3
    return t.samples.select("entity", n.alias("cluster"), F.concat(F.lit("svc_"), n).alias("center")).distinct()


@query("det_15_centre_models", f"WITH {_CL} SELECT entity, feature, bucket_ts, round(((value - m) / s) ** 2, 5) AS score FROM samples JOIN c USING (entity) JOIN m USING (cluster, feature)", "samples")
def _(t):
    c = _clusters(t)
    return M.score_by_cluster(t.samples, c, M.fit_by_cluster(t.samples, c)).withColumn("score", R("score", 5))


@query("det_15b_tuned_models", f"WITH {_CL} SELECT entity, feature, bucket_ts, round(((value - avg(value) OVER (PARTITION BY entity, feature)) / s) ** 2, 5) AS score FROM samples JOIN c USING (entity) JOIN m USING (cluster, feature)", "samples")
def _(t):
    c = _clusters(t)
    return M.score_by_cluster(t.samples, c, M.fit_by_cluster(t.samples, c), "tuned").withColumn("score", R("score", 5))


@query("det_19_best_checkpoints", "SELECT cluster, feature, step, loss FROM (SELECT *, row_number() OVER (PARTITION BY cluster, feature ORDER BY loss, step) AS r FROM (SELECT CAST(user_id % 3 AS INTEGER) AS cluster, event_type AS feature, event_id AS step, value AS loss FROM events)) WHERE r = 1")
def _(t):
    e = t.events.select((F.col("user_id") % 3).cast("int").alias("cluster"), F.col("event_type").alias("feature"), F.col("event_id").alias("step"), F.col("value").alias("loss"))
    return M.better_models(e)


@query("str_01_stream_threshold")
def _(t):
    s = _events(t).select(F.concat(F.lit("svc_"), F.col("user_id") % 12).alias("entity"), F.col("event_id").alias("idx"), F.col("value").alias("score"))
    return W.drained(stream_spot.sequential_flags(s, 100, 1e-3, 0.95), _folder(t))


@query("str_02_stream_drift")
def _(t):
    s = _events(t).select(F.concat(F.lit("svc_"), F.col("user_id") % 12).alias("entity"), F.col("event_id").alias("idx"), F.col("value").alias("score"))
    return W.drained(stream_spot.sequential_flags(s, 100, 1e-3, 0.95, depth=20), _folder(t))


@query("str_03_stream_buckets", "SELECT event_type, CAST(floor(epoch(ts) / 900) * 900 AS BIGINT) AS bucket_ts, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL HAVING floor(min(epoch(ts)) / 900) * 900 + 900 <= (SELECT max(epoch(ts)) - 600 FROM events)")
def _(t):
    return W.drained(W.bucketed(_events(t), "15 minutes", "10 minutes"), _folder(t)).select("event_type", "bucket_ts", "n", R("total", 4).alias("total"))


@query("str_04_sliding_windows", "SELECT event_type, CAST(s AS BIGINT) AS start_ts, count(*) AS n, round(avg(value), 5) AS mean FROM events e, LATERAL (SELECT unnest(range(CAST(floor(epoch(e.ts) / 21600) * 21600 - 64800 AS BIGINT), CAST(floor(epoch(e.ts) / 21600) * 21600 + 1 AS BIGINT), 21600)) AS s) GROUP BY ALL")
def _(t):
    e = t.events.withColumn("ts", F.col("ts").cast("timestamp"))
    return W.sliding(e, "24 hours", "6 hours").withColumn("mean", R("mean", 5))


@query("str_05_sessions", "SELECT user_id, CAST(min(s) AS BIGINT) AS start_ts, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY x, event_id) AS k FROM (SELECT user_id, event_id, x, floor(x) AS s, CASE WHEN x - lag(x) OVER (PARTITION BY user_id ORDER BY x, event_id) < 7200 THEN 0 ELSE 1 END AS new FROM (SELECT user_id, event_id, epoch(ts) AS x FROM events))) GROUP BY user_id, k")
def _(t):
    return W.sessions(t.events.withColumn("ts", F.col("ts").cast("timestamp")), "2 hours", ["user_id"])


@query("str_04b_stream_windows", "SELECT event_type, CAST(s AS BIGINT) AS start_ts, count(*) AS n, round(avg(value), 5) AS mean FROM events e, LATERAL (SELECT unnest(range(CAST(floor(epoch(e.ts) / 21600) * 21600 - 64800 AS BIGINT), CAST(floor(epoch(e.ts) / 21600) * 21600 + 1 AS BIGINT), 21600)) AS s) GROUP BY ALL HAVING CAST(s AS BIGINT) + 86400 <= (SELECT max(epoch(ts)) - 600 FROM events)")
def _(t):
    return W.drained(W.sliding(_events(t), "24 hours", "6 hours", "10 minutes"), _folder(t)).withColumn("mean", R("mean", 5))


@query("str_05b_stream_clusters", """WITH e AS (SELECT event_type AS key, event_id AS id, epoch_us(ts) // 1000 AS ms FROM events), m AS (SELECT max(ms) - 600000 AS mark FROM e),
a AS (SELECT *, count(*) OVER (PARTITION BY key ORDER BY ms RANGE BETWEEN 1200000 PRECEDING AND 1200000 FOLLOWING) >= 4 AS core FROM e),
b AS (SELECT *, max(CASE WHEN core THEN ms END) OVER (PARTITION BY key ORDER BY ms RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev, lag(ms) OVER (PARTITION BY key ORDER BY ms) AS before FROM a),
c AS (SELECT *, CASE WHEN core THEN sum(CASE WHEN core AND (prev IS NULL OR ms - prev > 1200000) AND coalesce(before < ms, true) THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY ms RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 END AS n FROM b),
d AS (SELECT *, min(n) OVER (PARTITION BY key ORDER BY ms RANGE BETWEEN 1200000 PRECEDING AND 1200000 FOLLOWING) AS near FROM c)
SELECT key, id, ms, CAST(coalesce(n, near, -1) AS BIGINT) AS cluster_id FROM d CROSS JOIN m WHERE ms + CASE WHEN core THEN 1200000 ELSE 2400000 END < mark""")
def _(t):
    from ..streaming.clusters import clusters

    return W.drained(clusters(_events(t).withColumn("id", F.col("event_id")), "event_type", 1200000, 4, "10 minutes"), _folder(t)).withColumnRenamed("at", "ms")


@query("str_06_assigned_centres", "WITH p AS (SELECT a.id AS id, b.id AS center, round(sqrt(list_sum(list_transform(list_zip(a.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))), 9) AS d FROM vectors a CROSS JOIN (SELECT * FROM vectors WHERE id IN (3, 4, 5)) b) SELECT id, center, round(d, 6) AS d FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, center) AS r FROM p) WHERE r = 1", "vectors")
def _(t):
    e = t.table("embeddings")
    s = t.spark.readStream.schema(e.schema).parquet(f"{t.dir}/embeddings*.parquet").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda v: F.round(v.cast("double"), 4)).alias("x"))
    return W.drained(W.assigned(s, t.vectors.filter("id in (3, 4, 5)").select("id", "x")), _folder(t))


@query("str_07_deduplicated_stream", "SELECT event_type, user_id % 50 AS slot, CAST(1 AS BIGINT) AS n FROM events GROUP BY ALL")
def _(t):
    s = _events(t).select("event_type", (F.col("user_id") % 50).alias("slot"), "ts")
    return W.drained(W.deduplicated(s, ["event_type", "slot"], "60 days").select("event_type", "slot", F.lit(1).cast("long").alias("n")), _folder(t))


# --- plug-ins ------------------------------------------------------------------------------------------------------

@query("ext_02_distance_by_name", "SELECT a.id AS a, b.id AS b, round(list_max(list_transform(list_zip(a.x, b.x), lambda z: abs(z[1] - z[2]))), 6) AS d FROM vectors a JOIN vectors b ON a.id % 100 = 0 AND a.id <> b.id", "vectors")
def _(t):
    D.register_distance("largest", lambda x, y: F.array_max(F.zip_with(x, y, lambda a, b: F.abs(a - b))), blocks.largest)
    return D.against(t.vectors.filter("id % 100 = 0"), t.vectors, "largest").withColumn("d", R("d"))


@query("ext_06_offline_answers", "WITH k AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY anomalies DESC, id) AS r FROM kgf) SELECT cluster_id, substr(id, 8) AS entity, round(1.0 / r, 3) AS score FROM k WHERE r <= 5", "kgf")
def _(t):
    return N.parsed_answers(N.answered(K.prompt(A.kg_features(A.kg_edges(t.incidents, t.topology)))))


@query("ext_09_domain_rules", "SELECT src, dst FROM topology WHERE NOT (src = 'svc_0' AND dst = 'svc_1') AND dst <> 'svc_2' AND src <> 'svc_3' UNION SELECT 'svc_9', 'svc_4'", "topology")
def _(t):
    return N.apply_rules(t.topology, N.domain_rules(t.spark, [("svc_0", "svc_1")], [("svc_9", "svc_4")], ["svc_2"], ["svc_3"]))


_SQ = "list_sum(list_transform(list_zip(a.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"


@query("jn_10_all_pairs", f"SELECT a.id AS a, b.id AS b, round({_SQ}, 8) AS d FROM vectors a JOIN vectors b ON a.label = b.label AND a.id < b.id", "vectors")
def _(t):
    return D.within(t.vectors, "squared", "label", upper=True).select("a", "b", R("d", 8).alias("d"))


@query("clu_09_distance_matrix", f"SELECT a.label, a.id AS a, b.id AS b, round(sqrt({_SQ}), 6) AS d FROM vectors a JOIN vectors b ON a.label = b.label AND a.id <> b.id", "vectors")
def _(t):
    return D.within(t.vectors, "euclidean", "label").withColumn("d", R("d"))


@query("agg_15_weighted_indicators", "WITH b AS (SELECT cluster_id, attribute, count(*) AS n, avg(CASE WHEN type = 'trace' THEN 1.0::DOUBLE WHEN type = 'metric' THEN 0.6::DOUBLE ELSE 0.2::DOUBLE END) AS w FROM incidents GROUP BY ALL), s AS (SELECT cluster_id, attribute, round(w * n / sum(n) OVER (PARTITION BY cluster_id), 6) AS weight FROM b) SELECT cluster_id, attribute, weight FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY weight DESC, attribute) AS r FROM s WHERE weight > 0.1) WHERE r <= 5", "incidents")
def _(t):
    return A.weighted_indicators(t.incidents, {"trace": 1.0, "metric": 0.6}, 0.2)


_P24 = _P.replace("12 PRECEDING", "24 PRECEDING")


@query("det_14_wide_likelihood", _rolling_likelihood(_P24), "samples")
def _(t):
    return M.detector("rolling_gaussian", width=24, least=0.5).score(t.samples).select("entity", "feature", "bucket_ts", R("score", 4).alias("score"))


@query("clu_22_latent")
def _(t):
    from ..operators.cluster import latent

    return latent(t.vectors, 3)


@query("ext_07_answer_cache", "SELECT cluster_id, CASE WHEN cluster_id % 2 = 0 THEN 'kept' ELSE 'asked' END AS first, CASE WHEN cluster_id % 2 = 0 THEN 'asked' ELSE 'cached' END AS second FROM (SELECT DISTINCT cluster_id FROM kgf)", "kgf")
def _(t):
    """Even clusters are known beforehand; the others are asked, and found in the cache when all are asked about again."""
    import uuid

    p = K.prompt(A.kg_features(A.kg_edges(t.incidents, t.topology))).withColumn("prompt", F.concat("prompt", F.lit("\n"), "cluster_id"))
    path = f"{shared_folder(t.spark)}/fathomline/{uuid.uuid4().hex}/answers"
    cache = p.filter("cluster_id % 2 = 0").select(F.lit("offline").alias("model"), F.sha2("prompt", 256).alias("prompt_hash"), F.lit("kept").alias("answer"))
    first = N.answered(p, cache=cache, cache_path=path)
    before = N.cache_table(t.spark, path).select("prompt_hash", F.lit(True).alias("cached"))
    second = p.select("cluster_id", F.sha2("prompt", 256).alias("prompt_hash")).join(before, "prompt_hash", "left").select("cluster_id", F.when(F.col("cached"), "cached").otherwise("asked").alias("second"))
    return first.select("cluster_id", F.when(F.col("answer") == "kept", "kept").otherwise("asked").alias("first")).join(second, "cluster_id")


@query("ext_10_chunks", "SELECT fault_id AS cluster_id, 'report' AS original_source, component, [level, reason] AS symptoms FROM faults", "faults")
def _(t):
    body = F.to_json(F.struct("component", F.array("level", "reason").alias("symptoms")))
    said = t.faults.select(F.col("fault_id").alias("cluster_id"), F.concat(F.lit("Here it is:\n```json\n"), body, F.lit("\n```\n")).alias("answer"))
    return N.chunks(said, "report")
