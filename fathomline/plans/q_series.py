"""Queries for SRC/PRJ/FLT/WIN operators on series."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import series as S
from ..sources.testdata import epoch
from .registry import query

R = lambda c, n=6: F.round(c, n)
START, SIZE = 1704067200, 21600


@query("prj_01_pack_series", "SELECT entity, feature, list(bucket_ts ORDER BY bucket_ts) AS ts, list(value ORDER BY bucket_ts) AS values FROM samples GROUP BY ALL", "samples")
def _(t):
    return S.pack(t.samples)


@query("prj_02_unpack_series", "SELECT entity, feature, CAST(row_number() OVER (PARTITION BY entity, feature ORDER BY bucket_ts) - 1 AS INTEGER) AS idx, value FROM samples", "samples")
def _(t):
    return S.unpack(S.pack(t.samples))


@query("prj_03_pivot_features", "SELECT entity, bucket_ts, any_value(value) FILTER (feature = 'click') AS click, any_value(value) FILTER (feature = 'error') AS error, any_value(value) FILTER (feature = 'view') AS view FROM samples GROUP BY ALL", "samples")
def _(t):
    return S.pivot_features(t.samples, ["click", "error", "view"])


@query("prj_04_bucket_index", f"SELECT event_id, CAST(floor((ts - {START}) / 900.0) AS BIGINT) AS idx FROM points", "points")
def _(t):
    return S.checked_bucket_index(t.points, START, 900, 40 * 96).select("event_id", "idx")


for _align, _off in (("tail", "130 - n"), ("head", "0"), ("window", "12")):
    @query(f"prj_0{ {'tail': 5, 'head': 6, 'window': 7}[_align]}_{_align}_alignment", f"SELECT entity, feature, CAST(idx AS INTEGER) AS idx, value, CAST({START} + ({_off} + idx) * {SIZE} AS BIGINT) AS bucket_ts FROM (SELECT *, row_number() OVER (PARTITION BY entity, feature ORDER BY bucket_ts) - 1 AS idx, count(*) OVER (PARTITION BY entity, feature) AS n FROM samples)", "samples")
    def _(t, align=_align):
        return S.index_to_time(S.unpack(S.pack(t.samples)), START, SIZE, 130, align, 13)


@query("prj_08_bucket_size", "SELECT entity, feature, coalesce(min(gap), 60) AS bucket FROM (SELECT *, bucket_ts - lag(bucket_ts) OVER (PARTITION BY entity, feature ORDER BY bucket_ts) AS gap FROM samples) GROUP BY ALL", "samples")
def _(t):
    return S.inferred_bucket(t.samples)


@query("prj_09_padded_templates", "SELECT CAST(i AS INTEGER) AS template_id, coalesce(n_name, '<UNKNOWN_PATTERN_' || i || '>') AS text FROM range(40) r(i) LEFT JOIN nation ON n_nationkey = i")
def _(t):
    return S.padded_templates(t.nation.select(F.col("n_nationkey").alias("template_id"), F.col("n_name").alias("text")), 40)


@query("prj_10_padded_entities", "SELECT feature, CAST(e AS INTEGER) AS entity_no, bucket_ts, coalesce(value, 0.0) AS value FROM (SELECT DISTINCT feature, bucket_ts FROM samples) CROSS JOIN range(15) r(e) LEFT JOIN (SELECT feature, CAST(substr(entity, 5) AS INTEGER) AS e, bucket_ts, value FROM samples) USING (feature, e, bucket_ts)", "samples")
def _(t):
    return S.padded_entities(t.samples.select("feature", F.substring("entity", 5, 3).cast("int").alias("entity_no"), "bucket_ts", "value"), 15, ["feature", "bucket_ts"])


@query("prj_10b_repeated_entity", "SELECT CAST(e AS INTEGER) AS entity_no, feature, bucket_ts, value FROM range(4) r(e) CROSS JOIN (SELECT feature, bucket_ts, value FROM samples WHERE entity = 'svc_3')", "samples")
def _(t):
    return S.repeated_entities(t.samples.filter("entity = 'svc_3'").select("feature", "bucket_ts", "value"), 4)


@query("prj_11_common_tail", "WITH a AS (SELECT * FROM samples WHERE feature = 'view'), b AS (SELECT * FROM samples WHERE feature = 'click') SELECT entity, feature, bucket_ts, value FROM (SELECT a.*, row_number() OVER (PARTITION BY entity ORDER BY bucket_ts DESC) AS r, count(*) OVER (PARTITION BY entity) AS na FROM a) JOIN (SELECT entity, count(*) AS nb FROM b GROUP BY 1) USING (entity) WHERE r <= least(na, nb)", "samples")
def _(t):
    s = t.samples
    return S.common_tail(s.filter("feature = 'view'"), s.filter("feature = 'click'"))


@query("prj_12_day_segments", "SELECT entity, feature, bucket_ts, value, CAST(floor((row_number() OVER (PARTITION BY entity, feature ORDER BY bucket_ts) - 1) / 4.0) AS BIGINT) AS segment FROM samples", "samples")
def _(t):
    return S.segments(t.samples, 4)


@query("prj_13_sliding_split", "SELECT entity, feature, CAST(i AS INTEGER) AS start, values FROM (SELECT entity, feature, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY entity, feature) AS n, list(value) OVER (PARTITION BY entity, feature ORDER BY bucket_ts ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS values FROM samples WINDOW w AS (PARTITION BY entity, feature ORDER BY bucket_ts)) WHERE i % 5 = 0 AND i + 10 < n - 1", "samples")
def _(t):
    return S.sliding_split(t.samples, 10, 5)


@query("prj_14_clamped_slice", f"SELECT * FROM samples WHERE bucket_ts BETWEEN {START - 999} AND {START + 7 * 86400}", "samples")
def _(t):
    return S.clamped_slice(t.samples, START - 999, START + 7 * 86400)


@query("flt_01_time_range", "SELECT event_id, user_id, value FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-06 12:00:00'")
def _(t):
    return t.events.filter(F.col("ts").between(F.lit("2024-01-05 00:00:00").cast("timestamp_ntz"), F.lit("2024-01-06 12:00:00").cast("timestamp_ntz"))).select("event_id", "user_id", "value")


@query("flt_02_half_open_window", "SELECT * FROM points WHERE ts >= epoch(TIMESTAMP '2024-01-09 00:30:00') AND ts < epoch(TIMESTAMP '2024-01-09 09:00:00')", "points")
def _(t):
    return S.half_open(t.points, "2024-01-09", "0830_1700")


@query("flt_03_flagged_in_range", f"SELECT entity, feature, bucket_ts FROM samples WHERE value > 60 AND bucket_ts BETWEEN {START} AND {START + 864000}", "samples")
def _(t):
    return t.samples.withColumn("is_anom", (F.col("value") > 60).cast("int")).filter((F.col("is_anom") == 1) & F.col("bucket_ts").between(START, START + 864000)).select("entity", "feature", "bucket_ts")


@query("flt_05_category_list", "SELECT event_id, event_type FROM events WHERE event_type IN ('error', 'view')")
def _(t):
    return t.events.filter(F.col("event_type").isin("error", "view")).select("event_id", "event_type")


@query("flt_06_categories_with_anomalies", "SELECT event_type, count(*) AS n FROM events WHERE event_type IN (SELECT event_type FROM events WHERE value > 250) GROUP BY 1")
def _(t):
    e = t.events
    return e.join(e.filter("value > 250").select("event_type").distinct(), "event_type", "left_semi").groupBy("event_type").agg(F.count("*").alias("n"))


@query("flt_07_frequent_pairs", "SELECT ts, entity, attribute, n FROM (SELECT *, count(*) OVER (PARTITION BY entity, attribute) AS n FROM anomalies) WHERE n >= 2", "anomalies")
def _(t):
    return S.frequent(t.anomalies, ["entity", "attribute"], 2).select("ts", "entity", "attribute", "n")


@query("flt_08_threshold_with_fallback", "WITH c AS (SELECT entity, attribute, count(*) AS cnt FROM anomalies GROUP BY ALL), m AS (SELECT *, max(cnt) OVER (PARTITION BY entity) AS top FROM c) SELECT entity, attribute, cnt FROM m WHERE cnt >= CASE WHEN top >= 2 THEN 2 ELSE 1 END", "anomalies")
def _(t):
    c = t.anomalies.groupBy("entity", "attribute").agg(F.count("*").alias("cnt"))
    return S.with_fallback(c, "cnt", ["entity"])


@query("flt_11_value_audit", "SELECT feature, count(*) AS n, CAST(0 AS BIGINT) AS nans, CAST(0 AS BIGINT) AS infs, max(abs(value)) AS largest FROM samples GROUP BY 1", "samples")
def _(t):
    return S.value_audit(t.samples)


@query("flt_12_shape_audit", "WITH a AS (SELECT entity, feature, count(*) AS na FROM samples GROUP BY ALL), b AS (SELECT entity, feature, count(*) AS nb FROM samples WHERE value < 150 GROUP BY ALL) SELECT entity, feature, coalesce(na, 0) AS na, coalesce(nb, 0) AS nb FROM a FULL JOIN b USING (entity, feature) WHERE coalesce(na, 0) <> coalesce(nb, 0)", "samples")
def _(t):
    return S.shape_audit(t.samples, t.samples.filter("value < 150"))


_W = "(PARTITION BY entity, feature ORDER BY bucket_ts ROWS BETWEEN {} PRECEDING AND CURRENT ROW)"


@query("win_01_trailing_mean", f"SELECT entity, feature, bucket_ts, round(avg(value) OVER {_W.format(4)}, 6) AS smooth FROM samples", "samples")
def _(t):
    return S.trailing_mean(t.samples).select("entity", "feature", "bucket_ts", R("smooth").alias("smooth"))


@query("win_02_trailing_median", f"SELECT entity, feature, bucket_ts, round(median(value) OVER {_W.format(11)}, 6) AS smooth FROM samples", "samples")
def _(t):
    return S.trailing_median(t.samples).select("entity", "feature", "bucket_ts", R("smooth").alias("smooth"))


@query("win_03_interpolation", f"""WITH g AS (SELECT e AS entity, f AS feature, {START} + i * {SIZE} AS bucket_ts FROM (SELECT DISTINCT entity AS e, feature AS f FROM samples) CROSS JOIN range(120) r(i)), x AS (SELECT g.entity, g.feature, g.bucket_ts, s.value FROM g LEFT JOIN samples s ON s.entity = g.entity AND s.feature = g.feature AND s.bucket_ts = g.bucket_ts AND s.value < 200),
y AS (SELECT *, last_value(CASE WHEN value IS NOT NULL THEN bucket_ts END IGNORE NULLS) OVER b AS t0, last_value(value IGNORE NULLS) OVER b AS v0, first_value(CASE WHEN value IS NOT NULL THEN bucket_ts END IGNORE NULLS) OVER a AS t1, first_value(value IGNORE NULLS) OVER a AS v1 FROM x WINDOW b AS (PARTITION BY entity, feature ORDER BY bucket_ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY entity, feature ORDER BY bucket_ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT entity, feature, bucket_ts, round(coalesce(value, v0 + (v1 - v0) * (bucket_ts - t0) / nullif(t1 - t0, 0), v0, v1, 0.0), 6) AS filled FROM y""", "samples")
def _(t):
    s = t.samples
    grid = s.select("entity", "feature").distinct().select("entity", "feature", F.explode(F.sequence(F.lit(START).cast("long"), F.lit(START + 119 * SIZE).cast("long"), F.lit(SIZE).cast("long"))).alias("bucket_ts"))
    return S.interpolated(grid.join(s.filter("value < 200"), ["entity", "feature", "bucket_ts"], "left")).select("entity", "feature", "bucket_ts", R("filled").alias("filled"))


@query("win_04_deviants_to_zero", "WITH d AS (SELECT *, round(abs(value - avg(value) OVER p), 6) AS far, count(*) OVER p AS n FROM samples WINDOW p AS (PARTITION BY entity, feature)) SELECT entity, feature, bucket_ts, CASE WHEN row_number() OVER (PARTITION BY entity, feature ORDER BY far DESC, bucket_ts) <= floor(n * 0.05) THEN 0.0 ELSE value END AS clean FROM d", "samples")
def _(t):
    return S.without_deviants(t.samples).select("entity", "feature", "bucket_ts", "clean")


@query("win_05_extremes_to_zero", "SELECT entity, feature, bucket_ts, CASE WHEN row_number() OVER (PARTITION BY entity, feature ORDER BY value, bucket_ts) <= n OR row_number() OVER (PARTITION BY entity, feature ORDER BY value DESC, bucket_ts) <= n THEN 0.0 ELSE value END AS clean FROM (SELECT *, floor(count(*) OVER (PARTITION BY entity, feature) * 0.05 / 2) AS n FROM samples)", "samples")
def _(t):
    return S.without_extremes(t.samples).select("entity", "feature", "bucket_ts", "clean")


@query("win_06_standardize", "SELECT entity, feature, bucket_ts, round((value - avg(value) OVER p) / CASE WHEN stddev_pop(value) OVER p < 1e-12 THEN 1.0 ELSE stddev_pop(value) OVER p END, 6) AS scaled FROM samples WINDOW p AS (PARTITION BY entity, feature)", "samples")
def _(t):
    return S.scaled(t.samples).select("entity", "feature", "bucket_ts", R("scaled").alias("scaled"))


@query("win_06b_minmax", "SELECT entity, feature, bucket_ts, round((value - min(value) OVER p) / CASE WHEN max(value) OVER p = min(value) OVER p THEN 1.0 ELSE max(value) OVER p - min(value) OVER p END, 6) AS scaled FROM samples WINDOW p AS (PARTITION BY entity, feature)", "samples")
def _(t):
    return S.scaled(t.samples, "minmax").select("entity", "feature", "bucket_ts", R("scaled").alias("scaled"))


_SPLIT = START + 15 * 86400


@query("win_07_minmax_fit_apply", f"WITH f AS (SELECT feature, min(value) AS lo, max(value) AS hi FROM samples WHERE bucket_ts < {_SPLIT} GROUP BY 1) SELECT entity, feature, bucket_ts, round(greatest(-1.0, least(1.0, (value - lo) / CASE WHEN hi = lo THEN 1.0 ELSE hi - lo END * 2 - 1)), 6) AS scaled FROM samples JOIN f USING (feature) WHERE bucket_ts >= {_SPLIT}", "samples")
def _(t):
    s = t.samples
    return S.minmax_fit_apply(s.filter(F.col("bucket_ts") < _SPLIT), s.filter(F.col("bucket_ts") >= _SPLIT)).select("entity", "feature", "bucket_ts", R("scaled").alias("scaled"))


@query("win_08_clipped_zscore", f"""WITH tr AS (SELECT * FROM samples WHERE bucket_ts < {_SPLIT}), one AS (SELECT feature, avg(value) AS m, stddev_pop(value) AS s FROM tr GROUP BY 1),
two AS (SELECT feature, avg(v) AS m, CASE WHEN stddev_pop(v) < 1e-12 THEN 1e-3 ELSE stddev_pop(v) END AS s FROM (SELECT feature, greatest(m - 2 * s, least(m + 2 * s, value)) AS v FROM tr JOIN one USING (feature)) GROUP BY 1)
SELECT entity, feature, bucket_ts, round((greatest(m - 2 * s, least(m + 2 * s, value)) - m) / s, 6) AS scaled FROM samples JOIN two USING (feature) WHERE bucket_ts >= {_SPLIT}""", "samples")
def _(t):
    s = t.samples
    return S.meanstd_fit_apply(s.filter(F.col("bucket_ts") < _SPLIT), s.filter(F.col("bucket_ts") >= _SPLIT)).select("entity", "feature", "bucket_ts", R("scaled").alias("scaled"))


@query("win_09_model_windows", f'SELECT * FROM (SELECT entity, feature, bucket_ts, list(value) OVER {_W.format(12)} AS "window" FROM samples) WHERE len("window") = 13', "samples")
def _(t):
    return S.model_windows(t.samples).drop("value")


@query("win_10_wrapped_windows", f"""WITH tail AS (SELECT entity, feature, bucket_ts, value, row_number() OVER (PARTITION BY entity, feature ORDER BY bucket_ts DESC) AS r FROM samples), u AS (SELECT entity, feature, bucket_ts, value, -r AS turn FROM tail WHERE r < 5 UNION ALL SELECT entity, feature, bucket_ts, value, 0 FROM samples)
SELECT entity, feature, bucket_ts, "window" FROM (SELECT *, list(value) OVER (PARTITION BY entity, feature ORDER BY turn, bucket_ts ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS "window" FROM u) WHERE turn = 0 AND len("window") = 5""", "samples")
def _(t):
    return S.wrapped_windows(t.samples, 5).drop("value")


@query("win_11_padded_windows", "SELECT entity, feature, bucket_ts, [coalesce(lag(value, 3) OVER w, f), coalesce(lag(value, 2) OVER w, f), coalesce(lag(value, 1) OVER w, f), value] AS \"window\" FROM (SELECT *, first_value(value) OVER (PARTITION BY entity, feature ORDER BY bucket_ts) AS f FROM samples) WINDOW w AS (PARTITION BY entity, feature ORDER BY bucket_ts)", "samples")
def _(t):
    return S.padded_windows(t.samples).drop("value")


@query("win_12_forecast_windows", "SELECT entity, feature, bucket_ts, history, target FROM (SELECT entity, feature, bucket_ts, value AS target, row_number() OVER (PARTITION BY entity, feature ORDER BY bucket_ts) - 1 AS i, list(value) OVER (PARTITION BY entity, feature ORDER BY bucket_ts ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS history FROM samples) WHERE len(history) = 5 AND (i - 5) % 2 = 0", "samples")
def _(t):
    return S.forecast_windows(t.samples)


@query("win_13_largest_gaps", "SELECT entity, event_id, ts, gap FROM (SELECT *, ts - lag(ts) OVER (PARTITION BY entity ORDER BY ts, event_id) AS gap FROM points) WHERE gap IS NOT NULL ORDER BY gap DESC, ts, event_id LIMIT 10", "points")
def _(t):
    return S.largest_gaps(t.points, ["entity"]).select("entity", "event_id", "ts", "gap")


@query("win_15_analysis_start", "WITH d AS (SELECT entity, list_sort(list(DISTINCT ts)) AS t FROM anomalies GROUP BY 1), s AS (SELECT entity, t[least(3, len(t))] AS t0 FROM d) SELECT a.entity, a.ts, a.attribute, t0 FROM anomalies a JOIN s USING (entity) WHERE a.ts <= t0 + 28800", "anomalies")
def _(t):
    from ..operators.rca import within_analysis_window

    return within_analysis_window(t.anomalies.withColumn("cluster_id", F.col("entity")), 28800).select("entity", "ts", "attribute", "t0")


@query("win_19_half_hour_slots", "SELECT fault_id, CAST(floor(ts / 1800) * 1800 AS BIGINT) AS slot FROM faults", "faults")
def _(t):
    return t.faults.select("fault_id", S.slot(F.col("ts")).alias("slot"))


@query("win_20_transplanted_date", f"SELECT fault_id, CAST({START} + (ts + 28800) % 86400 AS BIGINT) AS normal_ts FROM faults", "faults")
def _(t):
    return t.faults.select("fault_id", S.transplanted(F.col("ts"), START).alias("normal_ts"))


@query("win_22_index_slice", "SELECT entity, feature, bucket_ts, value, CAST(idx AS INTEGER) AS idx FROM (SELECT *, row_number() OVER (PARTITION BY entity, feature ORDER BY bucket_ts) - 1 AS idx FROM samples) WHERE idx >= 7 AND idx < 37", "samples")
def _(t):
    return S.index_slice(t.samples, F.lit(7), 30)


@query("win_23_backward_mean", f"SELECT entity, feature, bucket_ts, round(m, 6) AS mean FROM (SELECT *, avg(value) OVER {_W.format(7)} AS m, row_number() OVER (PARTITION BY entity, feature ORDER BY bucket_ts) AS i FROM samples) WHERE i >= 8", "samples")
def _(t):
    return S.backward_mean(t.samples, 8).select("entity", "feature", "bucket_ts", R("mean").alias("mean"))
