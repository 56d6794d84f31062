"""Distances of pairs in blocks, what is summed and linked in them, and rounding as SQL does it."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathomline.functions import scalar


def test_rounded_as_sql(spark):
    import duckdb

    near = [math.nextafter((i + 0.5) / 1e6, 0) for i in range(64_000, 66_000)]
    values = [*near, *(-v for v in near), 0.0, 1.5e-6, float("nan"), float("inf")]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    got = [r.r for r in df.select("i", scalar.rounded(F.col("v"), 6).alias("r")).orderBy("i").collect()]
    want = [duckdb.execute("SELECT round(?::DOUBLE, 6)", [v]).fetchone()[0] for v in values]
    assert [str(x) for x in got] == [str(x) for x in want]
    text = [r.r for r in df.select("i", F.round("v", 6).alias("r")).orderBy("i").collect()]
    assert text[:4000] != want[:4000]  # the values are such that rounding their text differs


def _vectors(spark, n=60, seed=3):
    rng = np.random.default_rng(seed)
    odd = [None, [0.5, None, 0.25, 0.125], [0.5, 0.25], [], [0.1, 0.2, float("nan"), 0.4]]
    x = [*odd, *rng.random((n - len(odd), 4)).round(4).tolist()]
    x[20] = x[21]
    return spark.createDataFrame([(i, None if i == 9 else i % 3, v) for i, v in enumerate(x)], "id long, label int, x array<double>")


def _same(got, want):
    got, want = (sorted(map(tuple, df.collect()), key=str) for df in (got, want))
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g[:-1] == w[:-1]
        assert g[-1] == w[-1] or g[-1] == pytest.approx(w[-1], abs=1e-12, nan_ok=True), (g, w)


def _column(df, name, upper=False):
    from fathomline.operators import distance as D

    a, b = df.select("label", F.col("id").alias("a"), F.col("x").alias("xa")), df.select("label", F.col("id").alias("b"), F.col("x").alias("xb"))
    return a.join(b, "label").filter("a < b" if upper else "a <> b").select("label", "a", "b", D.DISTANCES[name](F.col("xa"), F.col("xb")).alias("d"))


@pytest.mark.parametrize("name", ["euclidean", "normalised_euclidean", "squared", "manhattan", "pearson", "shape_based", "symmetric_divergence", "wasserstein"])
def test_blocks_are_the_expressions(spark, monkeypatch, name):
    from fathomline.operators import blocks
    from fathomline.operators import distance as D

    monkeypatch.setattr(blocks, "ROWS_A", 7)
    monkeypatch.setattr(blocks, "ROWS_B", 11)
    df = _vectors(spark)
    plan = D.within(df, name, "label")._jdf.queryExecution().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "zip_with" not in plan.split("FlatMapCoGroupsInArrow")[-1]
    df = df if name in ("euclidean", "squared", "manhattan", "wasserstein") else df.filter("id > 4")  # the others divide by 0 there
    _same(D.within(df, name, "label"), _column(df, name))
    _same(D.within(df, name, "label", upper=True), _column(df, name, upper=True))
    few = df.filter("id % 10 = 7")
    _same(D.against(few, df, name), D.paired(few, df).select("a", "b", D.DISTANCES[name](F.col("xa"), F.col("xb")).alias("d")))


def test_best_shifts(spark):
    from fathomline.operators import distance as D

    df = _vectors(spark).filter("id > 4")
    few = df.filter("id % 10 = 7")
    _same(D.best_shifts(few, df), D.paired(few, df).select("a", "b", D.best_shift(F.col("xa"), F.col("xb")).alias("shift")))


def test_medoids_without_pairs(spark, monkeypatch):
    from fathomline.operators import blocks, cluster

    monkeypatch.setattr(blocks, "ROWS_A", 7)
    monkeypatch.setattr(blocks, "ROWS_B", 11)
    df = _vectors(spark).withColumnRenamed("label", "cluster").unionByName(spark.createDataFrame([(900, 77, [0.1] * 4)], "id long, cluster int, x array<double>"))
    want = cluster.medoids(_column(df.withColumnRenamed("cluster", "label"), "euclidean").drop("label"), df.select("id", "cluster"))
    far = cluster.centres(df)
    assert "NestedLoop" not in far._jdf.queryExecution().toString()
    got = far.groupBy("cluster", "center").agg(F.array_sort(F.collect_list(F.struct(F.round("d", 6).alias("distance"), "id"))).alias("x"))
    assert sorted(map(str, got.select("cluster", "center", "x.id").collect())) == sorted(map(str, want.select("cluster", "center", F.col("members").alias("id")).collect()))


@pytest.mark.parametrize("eps,least", [(0.25, 3), (0.35, 4), (5.0, 3), (0.3, 1)])
def test_dbscan_without_pairs(spark, monkeypatch, eps, least):
    from fathomline.operators import blocks, cluster

    monkeypatch.setattr(blocks, "ROWS_A", 7)
    monkeypatch.setattr(blocks, "ROWS_B", 11)
    df = _vectors(spark, 90).select("label", "id", "x")
    want = cluster.dbscan_distances(_column(df, "euclidean"), df.select("id"), eps, least)
    got = cluster.clusters_by("dbscan_vectors", df, df.select("id"), eps=eps, min_samples=least)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_links_of_a_cell_are_a_forest():
    from fathomline.operators import blocks

    a, b = blocks._forest(np.ones((300, 500), bool))
    assert len(a) == 799  # 150,000 near pairs
