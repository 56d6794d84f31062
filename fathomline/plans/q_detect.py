"""Queries for DET, WIN-14 and further evaluation operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import detect as D
from ..operators import relational as X
from .q_relational import _CONF, _F1, _f1cols, predicted
from .registry import query

R = lambda c, n=6: F.round(c, n)
START = 1704067200

_PRED = "p AS (SELECT *, CASE WHEN score > 700 THEN 1 ELSE 0 END AS pred FROM scores), q AS (SELECT *, CASE WHEN label = 1 AND coalesce(lag(label) OVER (PARTITION BY entity ORDER BY idx), 0) = 0 THEN 1 ELSE 0 END AS s FROM p), r AS (SELECT *, CASE WHEN label = 1 THEN sum(s) OVER (PARTITION BY entity ORDER BY idx) END AS run FROM q), a AS (SELECT *, CASE WHEN label = 1 AND max(pred) OVER (PARTITION BY entity, run) = 1 THEN 1 ELSE pred END AS adjusted, min(CASE WHEN pred = 1 THEN idx END) OVER (PARTITION BY entity, run) AS first FROM r)"


@query("win_14_point_adjusted", f"WITH {_PRED} SELECT entity, idx, pred, CAST(adjusted AS INTEGER) AS adjusted, CAST(CASE WHEN label = 1 AND adjusted = 1 AND idx < first THEN 1 ELSE 0 END AS INTEGER) AS late FROM a", "scores")
def _(t):
    return D.point_adjusted(predicted(t), ["entity"]).select("entity", "idx", "pred", "adjusted", "late")


@query("win_14b_adjusted_f1", f"WITH {_PRED}, c AS (SELECT entity, {_CONF.replace('pred', 'adjusted')} FROM a GROUP BY 1) SELECT entity, {_F1} FROM c", "scores")
def _(t):
    return X.confusion(D.point_adjusted(predicted(t), ["entity"]), "adjusted", keys=["entity"]).select("entity", *_f1cols())


@query("win_14c_latency", f"WITH {_PRED} SELECT entity, round(sum(CASE WHEN label = 1 AND adjusted = 1 AND idx < first THEN 1 ELSE 0 END) / (sum(CASE WHEN s = 1 AND adjusted = 1 THEN 1 ELSE 0 END) + 1e-4), 6) AS latency FROM a GROUP BY 1", "scores")
def _(t):
    return D.latency(D.point_adjusted(predicted(t), ["entity"]), ["entity"]).withColumn("latency", R("latency"))


@query("det_01_percentile_flags", "WITH h AS (SELECT entity, feature, round(quantile_cont(value, 0.99), 6) AS high FROM samples GROUP BY ALL) SELECT entity, feature, bucket_ts, CAST(value > high AS INTEGER) AS flag, CAST(max(CASE WHEN value > high THEN 1 ELSE 0 END) OVER (PARTITION BY entity, bucket_ts) AS INTEGER) AS any_flag FROM samples JOIN h USING (entity, feature)", "samples")
def _(t):
    return D.percentile_flags(t.samples).select("entity", "feature", "bucket_ts", "flag", "any_flag")


@query("det_02_best_f1_search", """WITH g AS (SELECT CAST(i AS BIGINT) AS i, i * (1000.0::DOUBLE / 50) AS th FROM range(1, 51) r(i)), q AS (SELECT *, CASE WHEN label = 1 AND coalesce(lag(label) OVER (PARTITION BY entity ORDER BY idx), 0) = 0 THEN 1 ELSE 0 END AS s FROM scores), r AS (SELECT *, CASE WHEN label = 1 THEN sum(s) OVER (PARTITION BY entity ORDER BY idx) END AS run FROM q),
p AS (SELECT r.*, g.i, g.th, CASE WHEN label = 1 THEN CASE WHEN max(score) OVER (PARTITION BY entity, run, g.i) > th THEN 1 ELSE 0 END ELSE CASE WHEN score > th THEN 1 ELSE 0 END END AS pred FROM r CROSS JOIN g), c AS (SELECT entity, i, th AS threshold, """ + _CONF + " FROM p GROUP BY ALL), f AS (SELECT entity, i, threshold, " + _F1 + """, 2 * (tp / (tp + fp + 1e-5)) * (tp / (tp + fn + 1e-5)) / (tp / (tp + fp + 1e-5) + tp / (tp + fn + 1e-5) + 1e-5) AS raw FROM c)
SELECT entity, round(threshold, 6) AS threshold, f1, tp, fp, fn FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY round(raw, 9) DESC, i DESC) AS k FROM f) WHERE k = 1""", "scores")
def _(t):
    return D.best_f1_search(t.scores, 0.0, 1000.0, 50, ["entity"]).select("entity", R("threshold").alias("threshold"), R("f1").alias("f1"), "tp", "fp", "fn")


@query("det_07_find_epsilon", """WITH s AS (SELECT entity, idx, CASE WHEN idx % 53 = 7 THEN score + 4000 ELSE score END AS score FROM scores), b AS (SELECT entity, avg(score) AS m, stddev_pop(score) AS sd, count(*) AS n, max(score) AS top FROM s GROUP BY 1), x AS (SELECT s.*, m, sd, n, z / 2.0 AS z, m + sd * (z / 2.0) AS eps FROM s JOIN b USING (entity) CROSS JOIN range(5, 24) r(z)),
y AS (SELECT *, max(CASE WHEN score >= eps THEN 1 ELSE 0 END) OVER (PARTITION BY entity, z ORDER BY idx RANGE BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS near FROM x), k AS (SELECT entity, z, any_value(m) AS m, any_value(sd) AS sd, any_value(n) AS n, any_value(eps) AS eps, sum(near) AS hit, avg(score) FILTER (score < eps) AS pm, stddev_pop(score) FILTER (score < eps) AS ps FROM y GROUP BY ALL),
g AS (SELECT entity, eps, z, round(((m - pm) / m + (sd - ps) / sd) / hit, 9) AS gain FROM k WHERE hit > 0 AND hit < n * 0.5), w AS (SELECT entity, eps, row_number() OVER (PARTITION BY entity ORDER BY gain DESC, z DESC) AS r FROM g)
SELECT b.entity, round(coalesce(w.eps, b.top), 6) AS epsilon FROM b LEFT JOIN w ON b.entity = w.entity AND w.r = 1""", "scores")
def _(t):
    s = t.scores.withColumn("score", F.when(F.col("idx") % 53 == 7, F.col("score") + 4000).otherwise(F.col("score")))
    return D.find_epsilon(s, ["entity"], 5).withColumn("epsilon", R("epsilon"))


@query("win_24_threshold_sweep", """WITH k AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY score, idx) AS rank, count(*) OVER (PARTITION BY entity) AS n FROM scores), p AS (SELECT entity, i, label, CASE WHEN rank > i * n / 400.0::DOUBLE THEN 1 ELSE 0 END AS pred FROM k CROSS JOIN range(400) r(i)), c AS (SELECT entity, i, sum(pred * label) AS tp, sum(pred) AS pr, sum(label) AS po FROM p GROUP BY ALL)
SELECT entity, CAST(i AS BIGINT) AS step, round(CASE WHEN pr + po = 0 THEN 0.0 ELSE 2 * tp / (pr + po) END, 6) AS f1 FROM c""", "scores")
def _(t):
    return D.threshold_sweep(t.scores, ["entity"]).select("entity", "step", R("f1").alias("f1"))


@query("det_08_auc", "WITH r AS (SELECT entity, label, rank() OVER (PARTITION BY entity ORDER BY score) + (count(*) OVER (PARTITION BY entity, score) - 1) / 2.0 AS k FROM scores) SELECT entity, round((sum(k) FILTER (label = 1) - sum(label) * (sum(label) + 1) / 2.0) / (sum(label) * (count(*) - sum(label))), 6) AS auc FROM r GROUP BY 1", "scores")
def _(t):
    return D.auc(t.scores, ["entity"]).withColumn("auc", R("auc"))


@query("det_08b_top_feature_sums", "SELECT entity, bucket_ts, round(sum(value), 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY entity, bucket_ts ORDER BY value DESC, feature) AS r FROM samples) WHERE r <= 3 GROUP BY ALL", "samples")
def _(t):
    return D.top_feature_sums(t.samples, 3).withColumn("score", R("score"))


@query("det_09_contamination_flags", "WITH h AS (SELECT entity, round(quantile_cont(score, 0.9), 6) AS high FROM scores GROUP BY 1) SELECT entity, idx, CAST(score > high AS INTEGER) AS pred FROM scores JOIN h USING (entity)", "scores")
def _(t):
    return D.contamination_flags(t.scores, ["entity"], 0.1).select("entity", "idx", "pred")


@query("det_10_blended_score", "SELECT entity, idx, round(0.95 * score + 0.05 * (score / 2 + 1), 6) AS score FROM scores", "scores")
def _(t):
    return t.scores.select("entity", "idx", R(D.blended(F.col("score"), F.col("score") / 2 + 1)).alias("score"))


_M = "m AS (SELECT entity, sum(score) AS total, count(*) FILTER (score > 600 AND label = 1) AS tp_a, count(*) FILTER (score > 600 AND label = 0) AS fp_a, count(*) FILTER (score <= 600 AND label = 1) AS fn_a, count(*) FILTER (score > 300 AND label = 1) AS tp_b, count(*) FILTER (score > 300 AND label = 0) AS fp_b, count(*) FILTER (score <= 300 AND label = 1) AS fn_b FROM scores GROUP BY 1)"


@query("det_11_adaptive_choice", f"""WITH {_M}, g AS (SELECT i AS id, (SELECT min(total) FROM m) + i * ((SELECT max(total) FROM m) - (SELECT min(total) FROM m)) / 100 AS lim FROM range(101) r(i)), c AS (SELECT id, lim, sum(CASE WHEN total <= lim THEN tp_a ELSE tp_b END) AS tp, sum(CASE WHEN total <= lim THEN fp_a ELSE fp_b END) AS fp, sum(CASE WHEN total <= lim THEN fn_a ELSE fn_b END) AS fn FROM m CROSS JOIN g GROUP BY ALL), f AS (SELECT id, lim, 2 * (tp / (tp + fp + 1e-5)) * (tp / (tp + fn + 1e-5)) / (tp / (tp + fp + 1e-5) + tp / (tp + fn + 1e-5) + 1e-5) AS f1 FROM c)
SELECT CAST(id AS BIGINT) AS id, round(lim, 6) AS "limit", round(f1, 6) AS f1 FROM f ORDER BY round(f1, 9) DESC, id LIMIT 1""", "scores")
def _(t):
    at = lambda n, c, y, x: F.sum(((F.col("score") > c) == (n != "fn")).cast("long") * (F.col("label") == y).cast("long")).alias(f"{n}_{x}")
    m = t.scores.groupBy("entity").agg(F.sum("score").alias("total"), *[at(n, c, y, x) for x, c in (("a", 600), ("b", 300)) for n, y in (("tp", 1), ("fp", 0), ("fn", 1))])
    return D.adaptive_choice(m).select("id", R("limit").alias("limit"), R("f1").alias("f1"))


@query("det_12_k_sigma", f"WITH f AS (SELECT entity, feature, avg(value) AS m, stddev_pop(value) AS s FROM samples WHERE bucket_ts < {START + 1296000} GROUP BY ALL) SELECT entity, feature, bucket_ts, value FROM samples JOIN f USING (entity, feature) WHERE bucket_ts >= {START + 1296000} AND (value > m + 3 * s OR value < m - 3 * s)", "samples")
def _(t):
    s = t.samples
    return D.k_sigma_bounds(s.filter(F.col("bucket_ts") < START + 1296000), s.filter(F.col("bucket_ts") >= START + 1296000))


@query("det_13_anomaly_listing", "WITH h AS (SELECT entity, feature, round(quantile_cont(value, 0.95), 6) AS high FROM samples GROUP BY ALL) SELECT entity, bucket_ts, list_sort(list(feature)) AS features FROM samples JOIN h USING (entity, feature) WHERE value > high GROUP BY ALL", "samples")
def _(t):
    return D.anomaly_listing(D.percentile_flags(t.samples, 0.95))


@query("det_14_robust_mean_score", "WITH q AS (SELECT entity, feature, quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.5) AS b, quantile_cont(value, 0.75) AS c FROM samples GROUP BY ALL) SELECT entity, bucket_ts, round(avg((value - b) / (1 + c - a)), 6) AS score FROM samples JOIN q USING (entity, feature) GROUP BY ALL", "samples")
def _(t):
    return D.mean_over_features(D.robust_scaled(t.samples)).withColumn("score", R("score"))


@query("det_16_robust_scaling", "WITH q AS (SELECT entity, feature, quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.5) AS b, quantile_cont(value, 0.75) AS c FROM samples GROUP BY ALL) SELECT entity, feature, bucket_ts, round((value - b) / (1 + c - a), 6) AS scaled FROM samples JOIN q USING (entity, feature)", "samples")
def _(t):
    return D.robust_scaled(t.samples).select("entity", "feature", "bucket_ts", R("scaled").alias("scaled"))


@query("det_17_baseline_extremes", "WITH b AS (SELECT feature, bucket_ts, round(avg(value), 6) AS baseline FROM samples GROUP BY ALL), d AS (SELECT *, round((value - baseline) ** 2, 6) AS d, floor(count(*) OVER (PARTITION BY entity, feature) * 0.05 / 2) AS n FROM samples JOIN b USING (feature, bucket_ts)) SELECT entity, feature, bucket_ts, CASE WHEN row_number() OVER (PARTITION BY entity, feature ORDER BY d, bucket_ts) <= n OR row_number() OVER (PARTITION BY entity, feature ORDER BY d DESC, bucket_ts) <= n THEN baseline ELSE value END AS clean FROM d", "samples")
def _(t):
    s = t.samples
    base = s.groupBy("feature", "bucket_ts").agg(R(F.avg("value")).alias("baseline"))
    return D.without_baseline_extremes(s.join(base, ["feature", "bucket_ts"])).select("entity", "feature", "bucket_ts", "clean")


@query("det_18_range_scaling", "SELECT entity, idx, round((score - min(score) OVER w) / CASE WHEN max(score) OVER w = min(score) OVER w THEN 1 ELSE max(score) OVER w - min(score) OVER w END * 1000, 6) AS scaled FROM scores WINDOW w AS (PARTITION BY entity)", "scores")
def _(t):
    return D.range_scaled(t.scores, ["entity"]).select("entity", "idx", R("scaled").alias("scaled"))


@query("win_25_boundary_suppression", "WITH s AS (SELECT entity, idx, CASE WHEN idx BETWEEN 81 AND 119 OR idx BETWEEN 481 AND 519 THEN 0.0 ELSE score END AS score FROM scores) SELECT entity, idx, round((score - min(score) OVER w) / CASE WHEN max(score) OVER w = min(score) OVER w THEN 1 ELSE max(score) OVER w - min(score) OVER w END, 6) AS scaled FROM s WINDOW w AS (PARTITION BY entity)", "scores")
def _(t):
    return D.boundary_suppressed(t.scores, [100, 500]).select("entity", "idx", R("scaled").alias("scaled"))


@query("win_26_expanded_groups", 'WITH f AS (SELECT entity, idx, CASE WHEN score > 900 THEN 1 ELSE 0 END AS flag FROM scores), n AS (SELECT *, max(flag) OVER (PARTITION BY entity ORDER BY idx RANGE BETWEEN 49 PRECEDING AND 49 FOLLOWING) AS near FROM f), g AS (SELECT *, CASE WHEN idx - coalesce(lag(idx) OVER w, idx - 2) > 5 OR lag(idx) OVER w IS NULL THEN 1 ELSE 0 END AS s FROM n WHERE near = 1 WINDOW w AS (PARTITION BY entity ORDER BY idx)), k AS (SELECT *, sum(s) OVER (PARTITION BY entity ORDER BY idx) AS grp FROM g) SELECT entity, min(idx) AS first, max(idx) AS last FROM k GROUP BY entity, grp', "scores")
def _(t):
    s = t.scores.select("entity", (F.col("idx")).alias("idx"), (F.col("score") > 900).cast("int").alias("flag"))
    return D.expanded(s, ["entity"], 49, 5).select("entity", "first", "last")


@query("agg_14_error_spread", "WITH e AS (SELECT entity, idx, round(abs(score - 500), 6) AS e FROM scores), r AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY e, idx) AS r, count(*) OVER (PARTITION BY entity) AS n FROM e) SELECT entity, round(median(e), 6) AS median, round(quantile_cont(e, 0.75) - quantile_cont(e, 0.25), 6) AS iqr, round(quantile_cont(e, 0.9) - quantile_cont(e, 0.1), 6) AS spread, round(avg(e) FILTER (r > floor(n * 0.1) AND r <= n - floor(n * 0.1)), 6) AS trimmed FROM r GROUP BY 1", "scores")
def _(t):
    s = t.scores.select("entity", "idx", F.col("score").alias("predicted"), F.lit(500.0).alias("actual"))
    out = D.error_spread(s, ["entity"])
    return out.select("entity", *[R(c).alias(c) for c in out.columns if c != "entity"])
