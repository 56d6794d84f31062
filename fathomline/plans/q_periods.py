"""Queries of periods, phases and the choice of features."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cluster as C
from ..operators import distance as D
from ..operators import periods as P
from ..operators import quantiles as Q
from ..sources import arrays
from ..sources.testdata import BUCKET
from .registry import query

R = lambda c, n=6: F.round(c, n)
START, LENGTH, MOST, LEAST, DIP = 1704067200, 120, 40, 6, 0.9


def _series(t):
    """The buckets of 30 days by index; those without samples have no row."""
    return t.samples.select("entity", "feature", ((F.col("bucket_ts") - START) / BUCKET).cast("long").alias("idx"), "value")


def _curves(t):
    return P.normalised(P.difference_sums(_series(t), LENGTH, MOST, block=32))


_GRID = f"g AS (SELECT e.entity, e.feature, r.i, coalesce(s.value, 0) AS v FROM (SELECT DISTINCT entity, feature FROM samples) e CROSS JOIN range({LENGTH}) r(i) LEFT JOIN samples s ON s.entity = e.entity AND s.feature = e.feature AND s.bucket_ts = {START} + r.i * {BUCKET})"
_CURVES = f"""{_GRID}, d AS (SELECT a.entity, a.feature, CAST(b.i - a.i AS INTEGER) AS lag, sum((a.v - b.v) ** 2) AS d FROM g a JOIN g b ON a.entity = b.entity AND a.feature = b.feature AND b.i - a.i BETWEEN 0 AND {MOST - 1} WHERE a.i < {LENGTH - MOST} GROUP BY ALL),
c AS (SELECT entity, feature, lag, d, CASE WHEN lag = 0 OR u = 0 THEN 1.0 ELSE d * (lag + 1) / u END AS c FROM (SELECT *, sum(d) OVER (PARTITION BY entity, feature ORDER BY lag) AS u FROM d))"""
_PERIODS = f"""{_CURVES}, p AS (SELECT k.entity, k.feature, CAST(coalesce(min(lag), 0) AS INTEGER) AS lag, CAST(coalesce({LENGTH} // min(lag), 0) AS BIGINT) AS cycles FROM (SELECT DISTINCT entity, feature FROM c) k LEFT JOIN (SELECT *, lead(c) OVER (PARTITION BY entity, feature ORDER BY lag) AS ahead FROM c WHERE lag >= {LEAST}) f
ON f.entity = k.entity AND f.feature = k.feature AND f.c < {DIP} AND (f.ahead IS NULL OR f.ahead >= f.c) GROUP BY ALL)"""


@query("win_17_yin", f"WITH {_CURVES} SELECT entity, feature, lag, round(d, 6) AS d, round(c, 6) AS c FROM c", "samples")
def _(t):
    return _curves(t).select("entity", "feature", "lag", R("d").alias("d"), R("c").alias("c"))


@query("win_17b_periods", f"WITH {_PERIODS} SELECT * FROM p", "samples")
def _(t):
    return P.periods(_curves(t), LENGTH, LEAST, DIP)


@query("win_18_inverse_weights", f"WITH {_CURVES} SELECT feature, round(avg(1 / c) / sum(avg(1 / c)) OVER (), 6) AS w FROM c WHERE lag = 12 AND c <> 0 GROUP BY feature", "samples")
def _(t):
    return P.curve_weights(_curves(t), 12).withColumn("w", R("w"))


@query("clu_21_periodic_features", f"WITH {_PERIODS} SELECT feature, count(*) AS n FROM p WHERE cycles > 0 GROUP BY 1 HAVING count(*) > 3", "samples")
def _(t):
    return P.periodic_features(P.periods(_curves(t), LENGTH, LEAST, DIP), 3)


def _whole(t):
    """entity, feature, values: all buckets in order, 0 where there are no samples."""
    every = t.samples.select("entity", "feature").distinct().withColumn("idx", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(LENGTH - 1).cast("long"))))
    rows = every.join(_series(t), ["entity", "feature", "idx"], "left").select("entity", "feature", "idx", F.coalesce("value", F.lit(0.0)).alias("v"))
    return rows.groupBy("entity", "feature").agg(F.array_sort(F.collect_list(F.struct("idx", "v"))).alias("x")).select("entity", "feature", F.col("x.v").alias("values"))


_SHIFT = f"""{_GRID}, e AS (SELECT a, b, sum(w * q) AS d FROM (SELECT x.entity AS a, y.entity AS b, x.feature, 0.2::DOUBLE AS w, sqrt(sum((x.v - y.v) ** 2)) AS q FROM g x JOIN g y ON x.feature = y.feature AND x.i = y.i AND x.entity <> y.entity GROUP BY ALL) GROUP BY ALL),
pv AS (SELECT a AS centre FROM (SELECT a, round(sum(d), 9) AS s FROM e GROUP BY 1) ORDER BY s, a LIMIT 1),
n AS (SELECT entity, feature, sqrt(sum(v * v)) AS n FROM g GROUP BY ALL),
l AS (SELECT y.entity, y.feature, (x.i - y.i + {LENGTH}) % {LENGTH} AS s, sum(x.v * y.v) AS c FROM g x JOIN pv ON x.entity = pv.centre JOIN g y ON x.feature = y.feature GROUP BY ALL),
k AS (SELECT l.entity, s, round(sum(0.2::DOUBLE * c / (a.n * b.n + 1e-9)), 9) AS v FROM l JOIN n a ON a.entity = l.entity AND a.feature = l.feature CROSS JOIN pv JOIN n b ON b.entity = pv.centre AND b.feature = l.feature GROUP BY ALL),
sh AS (SELECT entity, CAST(CASE WHEN s = 0 THEN 0 ELSE s - {LENGTH} END AS INTEGER) AS shift FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY v DESC, CASE WHEN s = 0 THEN 0 ELSE s - {LENGTH} END) AS r FROM k) WHERE r = 1)"""


@query("win_16_aligned", f"WITH {_SHIFT} SELECT g.entity, g.feature, centre, shift, CAST((g.i + shift + {LENGTH}) % {LENGTH} AS INTEGER) AS place, round(v, 3) AS value FROM g JOIN sh USING (entity) CROSS JOIN pv", "samples")
def _(t):
    series = _whole(t)
    weights = series.select("feature").distinct().withColumn("w", F.lit(0.2))
    half = D.weighted_euclidean(series, weights)
    both = half.unionByName(half.select(F.col("b").alias("a"), F.col("a").alias("b"), "d"))
    return P.aligned(series, weights, both).select("entity", "feature", F.col("pivot").alias("centre"), "shift", F.posexplode("values").alias("place", "value")).withColumn("value", R("value", 3))


def _votes(t):
    entities = t.samples.select("entity").distinct().count()
    return P.correlation_votes(D.feature_correlations(t.samples), entities, 0.02, 3)


@query("clu_19b_votes", "WITH r AS (SELECT a.entity, a.feature AS fa, b.feature AS fb, CASE WHEN count(*) >= 3 AND stddev_pop(a.value) > 1e-9 AND stddev_pop(b.value) > 1e-9 THEN corr(a.value, b.value) END AS r FROM samples a JOIN samples b ON a.entity = b.entity AND a.bucket_ts = b.bucket_ts AND a.feature < b.feature GROUP BY ALL) SELECT fa, fb, round(count(*) / (SELECT count(DISTINCT entity) FROM samples), 6) AS share FROM r WHERE r > 0.02 GROUP BY ALL HAVING count(*) > 3", "samples")
def _(t):
    return _votes(t).withColumn("share", R("share"))


@query("clu_20_chosen_features")
def _(t):
    features = [r[0] for r in t.samples.select("feature").distinct().orderBy("feature").collect()]  # the features of a domain
    return t.spark.createDataFrame([(f, what, k + 1) for k, (f, what) in enumerate(P.chosen_features(features, _votes(t)))], "feature string, decision string, step int")


_SQ = "list_sum(list_transform(list_zip(a.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"


@query("ext_03_approach_by_name", f"WITH RECURSIVE p AS (SELECT a.id AS a, b.id AS b FROM vectors a JOIN vectors b ON a.label = b.label AND a.id <> b.id AND sqrt({_SQ}) <= 10.5), core AS (SELECT a AS id FROM p GROUP BY a HAVING count(*) >= 2), l AS (SELECT a, b FROM p WHERE a IN (SELECT id FROM core) AND b IN (SELECT id FROM core)), r(a, b) AS (SELECT id, id FROM core UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a), g AS (SELECT a AS id, min(b) AS label FROM r GROUP BY a) SELECT v.id, coalesce(g.label, (SELECT min(g2.label) FROM p JOIN g g2 ON g2.id = p.b WHERE p.a = v.id)) AS label FROM vectors v LEFT JOIN g ON g.id = v.id", "vectors")
def _(t):
    return C.clusters_by("dbscan_vectors", t.vectors, t.vectors.select("id"), eps=10.5, min_samples=3, key="label")


_SHARES = {0.0: "min(l_extendedprice)", 0.25: "quantile_cont(l_extendedprice, 0.25)", 0.5: "quantile_cont(l_extendedprice, 0.5)", 0.99: "quantile_cont(l_extendedprice, 0.99)", 1.0: "max(l_extendedprice)"}


@query("agg_12b_quantiles", " UNION ALL ".join(f"SELECT l_returnflag, {s}::DOUBLE AS share, round({x}, 6) AS q FROM lineitem GROUP BY 1" for s, x in _SHARES.items()))
def _(t):
    return Q.quantiles(t.lineitem, ["l_returnflag"], "l_extendedprice", list(_SHARES), few=1000).withColumn("q", R("q"))


@query("src_01_array_files", "SELECT 'vectors-' || lpad(CAST(vec_id // 200 AS VARCHAR), 6, '0') || '.npy' AS file, vec_id % 200 AS row, round(list_sum(list_transform(embedding, lambda v: CAST(v AS DOUBLE))), 4) AS total FROM embeddings")
def _(t):
    import uuid

    from ..storage import shared_folder

    path = f"{shared_folder(t.spark)}/fathomline/{uuid.uuid4().hex}/arrays"
    arrays.write_arrays(t.embeddings.withColumn("name", F.lit("vectors")), path, "name", "vec_id", "embedding", rows=200).count()
    return arrays.read_arrays(t.spark, path, rows=64).select("file", "row", R(F.aggregate("values", F.lit(0.0), lambda a, v: a + v), 4).alias("total"))
