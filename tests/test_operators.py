"""Operators against brute force and on edge cases."""

import math
import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fathomline.operators import cluster, detect, graph, narrator, rca, relational, series, spot
from fathomline.operators.detectors import DETECTORS, detector
from fathomline.sources import readers, sinks

QUICK = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture, HealthCheck.too_slow])


def dbscan(ts, eps, least):
    order = sorted(range(len(ts)), key=lambda i: ts[i])
    near = lambda i: [j for j in order if abs(ts[i] - ts[j]) <= eps]
    core = {i for i in order if len(near(i)) >= least}
    label, nxt = {}, 0
    for i in order:
        if i in core and i not in label:
            stack, label[i] = [i], nxt
            while stack:
                for j in near(stack.pop()):
                    if j not in label:
                        label[j] = nxt
                        if j in core:
                            stack.append(j)
            nxt += 1
    return [label.get(i, -1) for i in range(len(ts))]


@QUICK
@given(ts=st.lists(st.integers(0, 120), min_size=1, max_size=50), eps=st.integers(1, 20), least=st.integers(1, 5))
def test_dbscan_1d(spark, ts, eps, least):
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(ts)], "i int, ts long, g int")
    got = {r["i"]: r["cluster_id"] for r in cluster.dbscan_1d(df, eps, least, ["g"]).collect()}
    assert [got[i] for i in range(len(ts))] == dbscan(ts, eps, least)


@QUICK
@given(label=st.lists(st.integers(0, 1), min_size=1, max_size=40), seed=st.integers(0, 99))
def test_point_adjust(spark, label, seed):
    pred = [random.Random(seed + i).randint(0, 3) // 3 for i in range(len(label))]
    want = pred[:]
    i = 0
    while i < len(label):
        if label[i]:
            j = i
            while j < len(label) and label[j]:
                j += 1
            if any(pred[i:j]):
                want[i:j] = [1] * (j - i)
            i = j
        else:
            i += 1
    df = spark.createDataFrame([("a", k, p, y) for k, (p, y) in enumerate(zip(pred, label))], "entity string, idx long, pred int, label int")
    got = [r["adjusted"] for r in detect.point_adjusted(df, ["entity"]).orderBy("idx").collect()]
    assert got == want


@QUICK
@given(edges=st.lists(st.tuples(st.integers(0, 7), st.integers(0, 7)), min_size=1, max_size=14))
def test_descendants(spark, edges):
    out = {}
    for a, b in edges:
        out.setdefault(a, set()).add(b)
    want = set()
    for a in range(8):
        seen, stack = set(), list(out.get(a, ()))
        while stack:
            x = stack.pop()
            if x not in seen:
                seen.add(x)
                stack += out.get(x, ())
        want |= {(a, b) for b in seen if b != a}
    df = spark.createDataFrame(edges, "src int, dst int")
    assert {(r["src"], r["dst"]) for r in graph.descendants(df).collect()} == want


def test_range_join_is_inclusive(spark):
    f = spark.createDataFrame([(1, 1000)], "id int, ts long")
    a = spark.createDataFrame([(939,), (940,), (1000,), (1300,), (1301,)], "at long")
    assert sorted(r["at"] for r in relational.range_join(f, a, 60, 300, "ts", "at").collect()) == [940, 1000, 1300]


def test_range_join_is_dealt_to_many_tasks(spark):
    f = spark.range(40).selectExpr("id as fault", "1000 + id * 50 as ts").coalesce(1)
    a = spark.range(3000).selectExpr("id as event", "if(id < 1500, 1500, id) as at").coalesce(1)  # one second holds half of them
    got = relational.range_join(f, a, 60, 300, "ts", "at")
    want = sorted((f, e) for f in range(40) for e in range(3000) if 1000 + f * 50 - 60 <= (1500 if e < 1500 else e) <= 1000 + f * 50 + 300)
    assert sorted((r["fault"], r["event"]) for r in got.select("fault", "event").collect()) == want
    assert got.groupBy(F.spark_partition_id()).count().count() > 1


def test_range_counts_equal_the_join_and_make_no_pairs(spark):
    r = np.random.default_rng(3)
    f = spark.createDataFrame([(i, int(v)) for i, v in enumerate(r.integers(-500, 3000, 200))] + [(200, None), (201, 9000), (202, 7), (202, 7)], "id int, ts long")
    a = spark.createDataFrame([("xyz"[v % 3], int(v)) for v in r.integers(-300, 2500, 300)] + [("x", None), ("w", 7), (None, 40)], "type string, at long")
    for before, after in ((60, 300), (0, 0), (100, -40)):
        got = relational.range_counts(f, a, before, after, "ts", "at", "type", "first_ts").groupBy("id", "type").agg(F.sum("n").alias("n"), F.min("first_ts").alias("first_ts"))
        pairs = relational.range_join(f, a, before, after, "ts", "at").groupBy("id", "type").agg(F.count("*").alias("n"), F.min("at").alias("first_ts"))
        assert sorted(map(str, got.collect())) == sorted(map(str, pairs.collect())) and pairs.count()


def test_best_f1_last_of_equals(spark):
    df = spark.createDataFrame([("m", i, float(s), y) for i, (s, y) in enumerate([(1, 0), (9, 1), (2, 0), (9, 1)])], "entity string, idx long, score double, label int")
    best = detect.best_f1_search(df, 0.0, 10.0, 10, ["entity"]).first()
    assert best["threshold"] == pytest.approx(8.0) and best["tp"] == 2 and best["fp"] == 0
    assert detect.best_f1_search(df, 0.0, 10.0, 10, ["entity"], last_wins=False).first()["threshold"] == pytest.approx(2.0)


def test_deviants_none_for_short_series(spark):
    df = spark.createDataFrame([("a", "f", i, float(i)) for i in range(5)], "entity string, feature string, bucket_ts long, value double")
    assert [r["clean"] for r in series.without_deviants(df).orderBy("bucket_ts").collect()] == [0.0, 1.0, 2.0, 3.0, 4.0]


def test_interpolation_edges(spark):
    rows = [("a", "f", 0, None), ("a", "f", 10, 1.0), ("a", "f", 20, None), ("a", "f", 30, 3.0), ("a", "f", 40, None), ("b", "f", 0, None)]
    df = spark.createDataFrame(rows, "entity string, feature string, bucket_ts long, value double")
    assert [r["filled"] for r in series.interpolated(df).orderBy("entity", "bucket_ts").collect()] == [1.0, 1.0, 2.0, 3.0, 3.0, 0.0]


def test_constant_series_scale(spark):
    df = spark.createDataFrame([("a", "f", i, 5.0) for i in range(4)], "entity string, feature string, bucket_ts long, value double")
    assert {r["scaled"] for r in series.scaled(df).collect()} == {0.0}
    assert {r["scaled"] for r in series.scaled(df, "minmax").collect()} == {0.0}


def test_bucket_outside_is_an_error(spark):
    df = spark.createDataFrame([(10,)], "ts long")
    with pytest.raises(Exception, match="outside the buckets"):
        series.checked_bucket_index(df, 100, 60, 5).collect()


def test_gateway_is_a_word(spark):
    df = spark.createDataFrame([("config",), ("IG01",)], "e string")
    assert {r["e"]: r["l"] for r in df.select("e", graph.layer_of(F.col("e")).alias("l")).collect()} == {"config": None, "IG01": "gateway"}


def test_half_even(spark):
    df = spark.createDataFrame([(0.125,), (0.135,), (0.115,)], "x double")
    assert [r["x"] for r in rca.rounded(df, ["x"]).collect()] == [0.12, 0.14, 0.12]


def test_gpd_fit_recovers_shape():
    rng = np.random.default_rng(5)
    y = 2.0 / 0.2 * ((1 - rng.random(4000)) ** -0.2 - 1)
    shape, scale = spot.gpd_fit(y)
    assert abs(shape - 0.2) < 0.08 and abs(scale - 2.0) < 0.25
    shape, scale = spot.gpd_fit(rng.exponential(3.0, 4000))
    assert abs(shape) < 0.08 and abs(scale - 3.0) < 0.3


def test_spot_flags_jumps():
    rng = np.random.default_rng(2)
    x = rng.normal(0, 1, 600)
    s = spot.Spot(1e-4, 0.95, both=True).calibrate(x)
    assert s.step(25.0)[0] and s.step(-25.0)[0] and not s.step(0.1)[0]
    d = spot.Spot(1e-4, 0.95, depth=20).calibrate(x + np.arange(600) * 0.05)
    assert not d.step(30.5)[0] and d.step(80.0)[0]


def test_equal_peaks_do_not_break():
    assert math.isfinite(spot.Tail().calibrate([1.0] * 50).threshold)
    assert spot.Tail().calibrate([1.0, 2.0]).step(99.0)


def test_beam_has_no_cycles(spark):
    a = spark.createDataFrame([(t, ty, e, "cpu", 1) for t, ty, e in [(1, "metric", "a"), (2, "trace", "b"), (3, "log", "c"), (4, "metric", "a")]], "ts long, type string, entity string, attribute string, cluster_id long")
    e = rca.kg_edges(a, spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "src string, dst string"))
    for r in rca.beam_search(e, rca.kg_features(e)).collect():
        assert len(set(r["path"])) == len(r["path"]) == len(r["chain"]) + 1


def test_walk_keeps_its_mass(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c")], "src string, dst string")
    out = rca.random_walk(e, spark.createDataFrame([("a",)], "entity string"))
    assert sum(r["score"] for r in out.collect()) == pytest.approx(1.0)


def test_fallback_threshold(spark):
    df = spark.createDataFrame([("x", 1), ("y", 1), ("x", 3)], "g string, n int")
    assert sorted((r["g"], r["n"]) for r in series.with_fallback(df, "n", ["g"]).collect()) == [("x", 3), ("y", 1)]


def test_query_store_over_midnight(spark, tmp_path):
    rows = spark.createDataFrame([(1704153590, "metric"), (1704153610, "metric"), (1704153620, "log")], "ts long, category string")
    rows = rows.withColumn("grain", F.lit("1min")).withColumn("date", F.date_format(F.timestamp_seconds("ts"), "yyyy-MM-dd"))
    sinks.write_store(rows, str(tmp_path / "s"), ["grain", "date", "category"])
    got = sinks.query_anomalies(spark, str(tmp_path / "s"), 1704153580, 1704153615)
    assert sorted(r["ts"] for r in got.collect()) == [1704153590, 1704153610]
    assert "PartitionFilters: [" in got._jdf.queryExecution().toString()


def test_folders_by_machine_take_one_file_each_and_few_listing_tasks(spark, tmp_path):
    where, key = tmp_path / "out", "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    was, jobs = spark.conf.get(key), spark.sparkContext.statusTracker()
    df = spark.range(90).select(F.concat(F.lit("machine-"), F.col("id") % 3, F.lit("-"), "id").alias("machine"), F.when(F.col("id") == 7, "1,2\n\n3,4").otherwise("1,2\n3,4\n5,6").alias("value"))
    sinks.write_text(df, f"file://{where}", by=["machine"])
    assert len(list(where.glob("machine=*/part-*"))) == 90 and not list(where.rglob("*.crc"))
    spark.sparkContext.setJobGroup("listing", "listing")
    got = readers.matrix_text(spark, f"file://{where}")
    found = [jobs.getStageInfo(x).numTasks for j in jobs.getJobIdsForGroup("listing") for x in jobs.getJobInfo(j).stageIds]
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert found and max(found) <= readers.LISTERS < 90 and spark.conf.get(key) == was
    assert got.count() == 180 and {tuple(r["values"]) for r in got.filter("idx = 1").collect()} == {(3.0, 4.0)}


def test_matrix_text_is_cut_and_sorted(spark, tmp_path):
    (tmp_path / "machine-1-2.txt").write_text("1,2\n3,4\n5,6\n")
    (tmp_path / "machine-1-10.txt").write_text("7,8\n9,10\n")
    got = readers.matrix_text(spark, str(tmp_path)).orderBy("order", "idx").collect()
    assert [(r["machine"], r["idx"], r["values"]) for r in got] == [("machine-1-2", 0, [1, 2]), ("machine-1-2", 1, [3, 4]), ("machine-1-10", 0, [7, 8]), ("machine-1-10", 1, [9, 10])]


def test_bad_json_lines_are_left_out(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": 1}\nnot json\n{"a": 2}\n')
    assert sorted(r["a"] for r in readers.json_lines(spark, str(tmp_path), "a int").collect()) == [1, 2]


def test_numpy_file(spark, tmp_path):
    np.save(tmp_path / "t.npy", np.arange(8.0).reshape(2, 2, 2))
    df = readers.numpy_file(spark, str(tmp_path / "t.npy"), entities=["a", "b"], features=["x", "y"], start=0, size=60)
    assert df.filter("entity = 'b' and feature = 'y' and bucket_ts = 60").first()["value"] == 7.0


@pytest.mark.parametrize("name", sorted(DETECTORS))
def test_detectors(spark, name):
    rows = [("a", f, i * 60, float(i % 4 + k + (50 if i == 30 and f == "x" else 0))) for k, f in enumerate(("x", "y")) for i in range(40)]
    df = spark.createDataFrame(rows, "entity string, feature string, bucket_ts long, value double")
    d = detector(name, **({"features": ["x", "y"], "k": 1} if name == "pca" else {}))
    out = d.score(df, d.fit(df.filter("bucket_ts <> 1800")))
    assert out.count() == 80
    top = out.orderBy(F.desc("score")).first()
    assert top["bucket_ts"] in (1800, 2040)


def test_retries_back_off():
    waits, calls = [], []

    def ask(prompt):
        calls.append(prompt)
        if len(calls) < 3:
            raise RuntimeError
        return "ok"

    assert narrator.with_retries(ask, "q", sleep=waits.append) == "ok" and waits == [1.0, 2.0]


def test_answers_are_kept(spark):
    p = spark.createDataFrame([(1, "- entity:a: 3 anomalies"), (2, "- entity:b: 1 anomalies")], "cluster_id long, prompt string")
    first = narrator.answered(p)
    known = spark.createDataFrame([(1, "offline", r["prompt_hash"], "| Entity | Confidence |\n|---|---|\n| z | 0.9 |\n") for r in first.collect() if r["cluster_id"] == 1], first.schema)
    got = {(r["cluster_id"], r["entity"]) for r in narrator.parsed_answers(narrator.answered(p, cache=known)).collect()}
    assert got == {(1, "z"), (2, "b")}


def test_empty_inputs(spark):
    a = spark.createDataFrame([], "ts long, type string, entity string, attribute string, raw string, cluster_id long")
    e = spark.createDataFrame([], "src string, dst string")
    assert cluster.dbscan_1d(a.drop("cluster_id"), 60, 3, ["type"]).count() == 0
    assert rca.root_causes(a, e).count() == 0
    assert graph.descendants(e).count() == 0
