"""Periods, phases, feature choice, quantiles, clusters over cut ranges, linkage in rounds and array files, against plain versions."""

import itertools
import math
import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fathomline.operators import cluster, periods, quantiles
from fathomline.sources import arrays

from .test_operators import dbscan

QUICK = settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture, HealthCheck.too_slow])


def curve(x, most):
    d = [sum((x[t] - x[t + lag]) ** 2 for t in range(len(x) - most)) for lag in range(most)]
    return d, [1.0 if not lag or not sum(d[: lag + 1]) else d[lag] * (lag + 1) / sum(d[: lag + 1]) for lag in range(most)]


def dip(c, least, threshold):
    for lag in range(least, len(c)):
        if c[lag] < threshold:
            while lag + 1 < len(c) and c[lag + 1] < c[lag]:
                lag += 1
            return lag
    return 0


@pytest.mark.parametrize("block", [7, 64, 10000])
def test_periods_equal_a_plain_version(spark, block):
    r = np.random.default_rng(2)
    length, most = 400, 50
    series = {("a", "saw"): np.arange(length) % 25.0, ("a", "noise"): r.normal(size=length), ("b", "wave"): np.sin(np.arange(length) * 2 * np.pi / 32) + 0.1 * r.normal(size=length), ("b", "flat"): np.zeros(length), ("b", "step"): np.where(np.arange(length) < 200, 0.0, 5.0)}
    rows = [(e, f, i, float(v)) for (e, f), x in series.items() for i, v in enumerate(x) if (e, f) != ("b", "flat") or i == 0]
    rows += [("b", "wave", length + 5, 1000.0), ("b", "flat", 3, None)]
    df = spark.createDataFrame(rows, "entity string, feature string, idx long, value double").repartition(3)
    curves = periods.normalised(periods.difference_sums(df, length, most, block)).cache()
    got = {(x["entity"], x["feature"]): {} for x in curves.collect()}
    for x in curves.collect():
        got[x["entity"], x["feature"]][x["lag"]] = (x["d"], x["c"])
    found = {(x["entity"], x["feature"]): (x["lag"], x["cycles"]) for x in periods.periods(curves, length, 8, 0.3).collect()}
    for key, x in series.items():
        d, c = curve(x, most)
        assert np.allclose([got[key][k][0] for k in range(most)], d) and np.allclose([got[key][k][1] for k in range(most)], c)
        p = dip(c, 8, 0.3)
        assert found[key] == (p, length // p if p else 0)
    assert found["a", "saw"] == (25, 16) and found["b", "wave"][0] in (31, 32, 33) and found["a", "noise"] == (0, 0)
    kept = {x["feature"]: x["n"] for x in periods.periodic_features(periods.periods(curves, length, 8, 0.3), 0).collect()}
    assert kept == {f: sum(v[1] > 0 for (_, g), v in found.items() if g == f) for _, f in series if any(v[1] > 0 for (_, g), v in found.items() if g == f)}
    weights = {x["feature"]: x["w"] for x in periods.curve_weights(curves, 20).collect()}
    inverse = {f: 1 / curve(x, most)[1][20] for (_, f), x in series.items() if curve(x, most)[1][20]}
    assert weights.keys() == inverse.keys() and all(abs(weights[f] - v / sum(inverse.values())) < 1e-9 for f, v in inverse.items())


def likeness(x, y, w, s):
    turned = np.roll(y, s, axis=1)
    return round(float((w * (x * turned).sum(axis=1) / (np.linalg.norm(x, axis=1) * np.linalg.norm(turned, axis=1) + 1e-9)).sum()), 9)


def test_alignment_equals_brute_force(spark):
    r = np.random.default_rng(6)
    base, m = r.normal(size=(3, 24)), 24
    data = {f"e{k}": np.roll(base, 5 * k % 24, axis=1) + 0.05 * r.normal(size=(3, 24)) for k in range(6)} | {"flat": np.zeros((3, 24))}
    w = np.array([0.5, 0.3, 0.2])
    rows = [(e, f"f{k}", [float(v) for v in x[k]]) for e, x in data.items() for k in range(3)]
    series = spark.createDataFrame(rows, "entity string, feature string, values array<double>")
    weights = spark.createDataFrame([(f"f{k}", float(v)) for k, v in enumerate(w)], "feature string, w double")
    d = {(a, b): float((w * np.linalg.norm(data[a] - data[b], axis=1)).sum()) for a in data for b in data if a != b}
    out = periods.aligned(series, weights, spark.createDataFrame([(a, b, v) for (a, b), v in d.items()], "a string, b string, d double")).collect()
    pivot = min(data, key=lambda a: (round(sum(v for (x, _), v in d.items() if x == a), 9), a))
    assert {x["pivot"] for x in out} == {pivot} and len(out) == len(rows)
    for x in out:
        scores = [likeness(data[pivot], data[x["entity"]], w, s) for s in range(1 - m, m)]
        shift = list(range(1 - m, m))[int(np.argmax(scores))]
        assert x["shift"] == shift and np.allclose(x["values"], np.roll(data[x["entity"]][int(x["feature"][1])], shift))


def chosen(names, share):
    """The three rules on a matrix, each feature's row against the open ones."""
    n = len(names)
    like = np.zeros((n, n))
    for (a, b), v in share.items():
        like[names.index(a), names.index(b)] = like[names.index(b), names.index(a)] = v
    open_, kept, gone = list(range(n)), [], []
    while open_:
        others = {f: [g for g in open_ if g != f] for f in open_}
        lone = [f for f in open_ if not like[f, others[f]].any()]
        full = [f for f in open_ if like[f, others[f]].all()]
        if lone:
            kept.append(lone[0]); open_.remove(lone[0])  # noqa: E702
        elif full and len(full) < len(open_):
            gone.append(full[0]); open_.remove(full[0])  # noqa: E702
        elif full:
            best = min(open_, key=lambda f: like[f, kept].sum()) if kept else open_[0]
            kept.append(best)
            gone += [f for f in open_ if f != best]
            open_ = []
        else:
            i = min(open_, key=lambda f: like[f, open_].sum())
            j = max([g for g in open_ if g != i and like[i, g] > 0], key=lambda g: like[g, kept].sum())
            kept.append(i); gone.append(j); open_.remove(i); open_.remove(j)  # noqa: E702
    return {names[f] for f in kept}, {names[f] for f in gone}


def test_feature_choice_and_votes(spark):
    r = random.Random(1)
    for turn in range(8):
        names = [f"f{k}" for k in range(2 + turn)]
        share = {(a, b): r.randint(1, 9) / 10 for a, b in itertools.combinations(names, 2) if r.random() < 0.5}
        table = spark.createDataFrame([(a, b, v) for (a, b), v in share.items()], "fa string, fb string, share double")
        got = periods.chosen_features(names, table)
        assert sorted(f for f, _ in got) == names
        assert ({f for f, d in got if d == "kept"}, {f for f, d in got if d == "dropped"}) == chosen(names, share)
    votes = spark.createDataFrame([("a", "b", 0.9), ("a", "b", 0.95), ("a", "b", 0.2), ("a", "c", 0.9), ("b", "c", None)], "fa string, fb string, r double")
    assert [tuple(x) for x in periods.correlation_votes(votes, 4, 0.8, 1).collect()] == [("a", "b", 0.5)]


def test_quantiles_of_many_values_under_one_key(spark):
    n = 1_000_000
    rows = spark.range(n).select(F.lit(1).alias("k"), ((F.col("id") * 7919 % n - 300000) * 1e-3).alias("v")).unionByName(spark.createDataFrame([(2, float(v)) for v in (3, -1, 5)] + [(2, None), (3, None)], "k int, v double"))
    x = np.sort((np.arange(n) * 7919 % n - 300000) * 1e-3)
    shares = [0.0, 0.3, 0.5, 0.999, 1.0]
    got = {(r["k"], r["share"]): r["q"] for r in quantiles.quantiles(rows, ["k"], "v", shares, few=10).collect()}
    assert len(got) == 10
    for s in shares:
        assert math.isclose(got[1, s], float(np.quantile(x, s)), abs_tol=1e-9) and math.isclose(got[2, s], float(np.quantile([3, -1, 5], s)), abs_tol=1e-12)


@QUICK
@given(values=st.lists(st.one_of(st.floats(allow_nan=False, allow_infinity=False, width=64), st.sampled_from([0.0, -0.0, 5e-324, -5e-324, 1e308, -1e308])), min_size=1, max_size=30))
def test_selection_finds_any_doubles(spark, values):
    out = quantiles.selected(spark.createDataFrame([(1, v) for v in values], "k int, v double"), ["k"], "v", [0.0, 0.37, 1.0]).collect()
    for r in out:
        at = (len(values) - 1) * r["share"]
        assert r["low"] == sorted(values)[math.floor(at)] and r["high"] == sorted(values)[math.ceil(at)]


@QUICK
@given(ts=st.lists(st.integers(-200, 300), min_size=1, max_size=60), eps=st.integers(1, 12), least=st.integers(1, 5), width=st.integers(1, 60))
def test_clusters_over_cut_ranges(spark, ts, eps, least, width):
    df = spark.createDataFrame([(i, t, g) for i, t in enumerate(ts) for g in (1, None)] + [(1000, None, 1)], "i int, ts long, g int")
    got = {(r["i"], r["g"]): r["cluster_id"] for r in cluster.dbscan_ranges(df, eps, least, ["g"], width=width).collect()}
    for g in (1, None):
        assert [got[i, g] for i in range(len(ts))] == dbscan(ts, eps, least)
    assert got[1000, 1] == -1 and len(got) == 2 * len(ts) + 1


def linked(d, k):
    """One pair at a time, from the whole matrix."""
    n = len(d)
    groups = [[i] for i in range(n)]
    while len(groups) > k:
        a, b = min(itertools.combinations(range(len(groups)), 2), key=lambda p: np.mean([d[x, y] for x in groups[p[0]] for y in groups[p[1]]]))
        groups[a] += groups.pop(b)
    return sorted(map(sorted, groups))


@pytest.mark.parametrize("seed", range(4))
def test_average_linkage_equals_one_pair_at_a_time(spark, seed):
    r = np.random.default_rng(seed)
    rows, want = [], {}
    for g, n in (("x", 14), ("y", 9), ("z", 2)):
        x = r.normal(size=(n, 2)) + 3 * r.integers(0, 3, size=(n, 1))
        d = np.linalg.norm(x[:, None] - x[None], axis=2)
        rows += [(g, a, b, float(d[a, b])) for a in range(n) for b in range(n) if a != b and (seed % 2 or a < b)]
        want[g] = linked(d, 4)
    out = cluster.average_linkage(spark.createDataFrame(rows, "g string, a int, b int, d double"), 4, ["g"]).collect()
    for g, groups in want.items():
        got = {}
        for x in out:
            if x["g"] == g:
                got.setdefault(x["label"], []).append(x["id"])
        assert sorted(map(sorted, got.values())) == groups
        assert [min(got[k]) for k in sorted(got)] == sorted(min(v) for v in got.values())  # labels by smallest id


@pytest.mark.parametrize("side", [16])
def test_linkage_in_tiles_equals_that_of_pairs(spark, side):
    from fathomline.operators import distance

    r = np.random.default_rng(side)
    rows = [(g, 1000 - 3 * i, [float(v) for v in x]) for g, n in ((1, 60), (2, 9), (3, 2), (4, 1), (5, 30)) for i, x in enumerate(np.rint(4 * r.normal(size=(n, 2))) if g == 5 else r.normal(size=(n, 3)))]
    rows += [(6, i, [float(i * i)] if i < 5 else [float(i), 1.0]) for i in range(6)] + [(None, 1, [1.0]), (1, None, [1.0, 1.0, 1.0])]  # 6: unequal lengths
    df = spark.createDataFrame(rows, "g int, id long, x array<double>").cache()
    want = {tuple(x) for x in cluster.average_linkage(distance.within(df, "euclidean", "g"), 4, ["g"]).select("g", "id", "label").collect()}
    got = [tuple(x) for x in cluster.linkage_of(df, 4, "g", side=side).collect()]
    assert set(got) == want and len(got) == len(want) == 60 + 9 + 2 + 30 + 6


def test_the_query_of_linkage_makes_no_rows_of_pairs(monkeypatch):
    from fathomline.operators import distance
    from fathomline.plans.registry import QUERIES

    asked = []
    monkeypatch.setattr(distance, "within", lambda *a, **k: asked.append("pairs"))
    monkeypatch.setattr(cluster, "average_linkage", lambda *a, **k: asked.append("rows"))
    monkeypatch.setattr(cluster, "linkage_of", lambda *a, **k: asked.append("tiles"))

    class Spark:
        class read:
            parquet = staticmethod(lambda path: Rows())

    class Rows:
        select = withColumnRenamed = lambda self, *a: self

    import fathomline.plans as plans

    plans.queries()
    monkeypatch.setattr("fathomline.sources.testdata.vectors", lambda t: Rows())
    QUERIES["clu_10_average_linkage"](Spark, "x")
    assert asked == ["tiles"]


def test_components_of_long_chains(spark):
    r = random.Random(2)
    names = list(range(300))
    r.shuffle(names)
    links = [(names[i], names[i + 1]) for i in range(299) if i not in (100, 250)]
    out = {x["id"]: x["label"] for x in cluster.smallest_linked(spark.range(305), spark.createDataFrame(links, "a long, b long")).collect()}
    for part in (names[:101], names[101:251], names[251:]):
        assert {out[v] for v in part} == {min(part)}
    assert all(out[v] == v for v in range(300, 305))


def test_small_clusters_and_null_labels(spark):
    rows = [(i, lab) for i, lab in enumerate([7, 7, 7, 3, 3, 9, None, None, None])]
    out = {x["id"]: x["cluster"] for x in cluster.small_to_outliers(spark.createDataFrame(rows, "id int, label int"), 2).collect()}
    assert out == {0: 2, 1: 2, 2: 2, 3: 1, 4: 1, 5: -1, 6: -1, 7: -1, 8: -1}


def test_array_files(spark, tmp_path):
    rows = [(n, i, [float(i), i / 2]) for n in ("machine-1", "machine 2") for i in range(23)]
    done = arrays.write_arrays(spark.createDataFrame(rows, "n string, i int, v array<double>").repartition(3), f"file://{tmp_path}/a", "n", "i", "v", rows=10).collect()
    assert sorted((r["file"], r["rows"]) for r in done) == sorted((f"{n}-{p:06d}.npy", k) for n in ("machine-1", "machine_2") for p, k in ((0, 10), (1, 10), (2, 3)))
    back = arrays.read_arrays(spark, f"file://{tmp_path}/a", rows=4)
    assert back.rdd.getNumPartitions() == 2 * (3 + 3 + 1)  # slices of files
    got = sorted((r["file"], r["row"], r["values"]) for r in back.collect())
    assert got == sorted((f"{n.replace(' ', '_')}-{i // 10:06d}.npy", i % 10, v) for n, i, v in rows)
    np.save(tmp_path / "cube.npy", np.arange(24, dtype=np.int32).reshape(2, 3, 4))
    assert [r["values"] for r in arrays.read_arrays(spark, str(tmp_path / "cube.npy")).orderBy("row").collect()] == [[float(v) for v in range(12)], [float(v) for v in range(12, 24)]]
    np.save(tmp_path / "objects.npy", np.array({"a": 1}, dtype=object), allow_pickle=True)
    with pytest.raises(Exception):
        arrays.read_arrays(spark, str(tmp_path / "objects.npy")).collect()
    with pytest.raises(ValueError):
        arrays.write_arrays(spark.range(1).select(F.lit("a").alias("n"), "id", F.array(F.lit(1.0)).alias("v")), "hdfs://x/y", "n", "id", "v")
