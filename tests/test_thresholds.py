"""Sequential thresholds against a plain run of the rule, value by value, and on a stream."""

import math

import numpy as np
import pytest

from fathomline.operators import relational, spot
from fathomline.streaming import spot as stream_spot
from fathomline.streaming import windows
from pyspark.sql import functions as F


def plain(x, train, q, level, both, depth):
    """One value after another; all peaks are kept."""
    recent = list(x[train - depth : train]) if depth else []
    start = np.array([x[i] - np.mean(x[i - depth : i]) for i in range(depth, train)]) if depth else np.array(x[:train])
    sides = []
    for sign in (1, -1) if both else (1,):
        y = np.sort(sign * start)
        low = y[min(len(y) - 1, int(level * len(y)))]
        peaks = [v - low for v in sign * start if v > low]
        sides.append({"low": low, "peaks": peaks, "n": len(y), "z": spot.tail_quantile(low, np.array(peaks), len(y), q)})
    out = []
    for v in x[train:]:
        base = np.mean(recent) if depth else 0.0
        y = v - base
        alarm = any(s * y > side["z"] for s, side in zip((1, -1), sides))
        out.append((alarm, sides[0]["z"] + base, base - sides[1]["z"] if both else None))
        if not alarm:
            for s, side in zip((1, -1), sides):
                side["n"] += 1
                if s * y > side["low"]:
                    side["peaks"].append(s * y - side["low"])
                    side["z"] = spot.tail_quantile(side["low"], np.array(side["peaks"]), side["n"], q)
            if depth:
                recent = recent[1:] + [v]
    return out


def values(seed, n=900):
    r = np.random.default_rng(seed)
    x = r.normal(size=n) + np.linspace(0, 1, n)
    x[r.choice(np.arange(300, n), 12, replace=False)] += r.choice([-9, 9], 12)
    return x


@pytest.mark.parametrize("both,depth", [(False, 0), (True, 0), (False, 15), (True, 15)])
def test_flags_equal_a_plain_run(spark, both, depth):
    data = {e: values(k) for k, e in enumerate(("a", "b"))} | {"short": values(9)[:150]}
    df = spark.createDataFrame([(e, i, float(v)) for e, x in data.items() for i, v in enumerate(x)], "entity string, idx long, score double").repartition(3)
    got = {(r["entity"], r["idx"]): r for r in spot.sequential_flags(df, ["entity"], 200, 1e-3, 0.95, both, depth).collect()}
    assert len(got) == 2 * 700 and sum(r["flag"] for r in got.values()) > 10
    for e in ("a", "b"):
        for i, (alarm, high, low) in enumerate(plain(data[e], 200, 1e-3, 0.95, both, depth)):
            r = got[e, 200 + i]
            assert r["flag"] == alarm and math.isclose(r["high"], high, rel_tol=1e-5)
            assert (r["low"] is None) == (low is None) and (low is None or math.isclose(r["low"], low, rel_tol=1e-5))


def test_states_are_bounded(monkeypatch):
    monkeypatch.setattr(spot, "MOST_PEAKS", 200)
    x = np.random.default_rng(1).normal(size=20000)
    s = spot.Spot(1e-3, 0.95).calibrate(x[:1000])
    flags, high, _ = s.steps(x[1000:])
    assert len(s.up.peaks) == 200 and s.up.seen > 600 and s.up.n + flags.sum() == 20000
    assert flags.mean() < 5e-3 and 2.4 < high[-1] < 4.5
    kept = []
    for k in range(1, 20001):
        kept = spot._kept(kept, k, float(k))
    assert len(kept) == 200 and abs(np.mean(kept) - 10000) < 1500  # of all, not of the last or first


def test_fits_grow_with_the_logarithm_of_the_peaks(monkeypatch):
    monkeypatch.setattr(spot, "MOST_PEAKS", 50)
    fits, means, fit, view = [], [], spot.gpd_fit, np.lib.stride_tricks.sliding_window_view
    monkeypatch.setattr(spot, "gpd_fit", lambda y: fits.append(1) or fit(y))
    monkeypatch.setattr(np.lib.stride_tricks, "sliding_window_view", lambda *a, **k: means.append(1) or view(*a, **k))
    x = np.random.default_rng(5).normal(size=30000)
    s = spot.Spot(1e-3, 0.95, depth=10).calibrate(x[:500])
    flags, _, _ = s.steps(x[500:])
    assert s.up.seen > 1000 and len(fits) < 50 * (2 + np.log(s.up.seen / 50)) < s.up.seen / 3
    assert len(means) <= flags.sum() + 10  # moving means are taken anew after an alarm, not after each peak


@pytest.mark.parametrize("depth", [0, 10])
def test_a_stream_in_pieces_gives_what_one_run_gives(spark, tmp_path, depth):
    x = values(4)
    for part in range(4):
        spark.createDataFrame([("a", i, float(x[i])) for i in range(part * 225, part * 225 + 225)], "entity string, idx long, score double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("entity string, idx long, score double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = windows.drained(stream_spot.sequential_flags(stream, 200, 1e-3, 0.95, depth), str(tmp_path)).collect()
    want = plain(x, 200, 1e-3, 0.95, False, depth)
    assert sorted(r["idx"] for r in out) == list(range(200, 900))
    for r in out:
        alarm, high, _ = want[r["idx"] - 200]
        assert r["flag"] == alarm and math.isclose(r["high"], high, rel_tol=1e-5)


def test_one_threshold_for_a_series(spark):
    r = np.random.default_rng(3)
    data = {"a": r.exponential(size=3000), "same": np.ones(40)}
    df = spark.createDataFrame([(e, float(v)) for e, x in data.items() for v in x] + [("a", None)], "entity string, score double")
    got = {x["entity"]: x for x in spot.pot_threshold(df, ["entity"], 1e-3, 0.98).collect()}
    for e, x in data.items():
        t = spot.Tail(1e-3, 0.98).calibrate(x)
        assert (got[e]["start"], got[e]["peaks"]) == (t.start, t.seen) and math.isclose(got[e]["threshold"], t.threshold, rel_tol=1e-5)


def test_row_numbers_with_a_hot_value(spark):
    rows = [(7 if i % 3 else i, (i * 7919) % 5000) for i in range(5000)] + [(None, 1), (None, 0)]
    df = spark.createDataFrame(rows, "k long, then long").repartition(6)
    got = relational.numbered(df, "k", "place", ["then"]).collect()
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, rows[i][1]))
    assert sorted((r["place"], r["k"], r["then"]) for r in got) == [(p + 1, *rows[i]) for p, i in enumerate(order)]
    assert relational.numbered(df.filter("false"), "k", "place").count() == 0
    assert relational.numbered(df, "k", "place", [F.desc("then")]).filter("place = 1").first()["k"] == min(r[0] for r in rows if r[0] is not None)


def test_stream_clusters_equal_the_tables(spark, tmp_path):
    from fathomline.operators import cluster
    from fathomline.streaming.clusters import clusters

    r = np.random.default_rng(11)
    at = np.sort(np.concatenate([r.integers(0, 4_000_000, 260), 1_000_000 + r.integers(0, 30_000, 60), 2_500_000 + np.arange(0, 400_000, 9_000)]))
    rows = [(str(k % 2), i, int(v)) for i, v in enumerate(at) for k in (i,)]
    late = [x for x in rows if x[1] % 10 == 3]  # these come a file later, within the watermark
    parts = [[] for _ in range(8)]
    for x in rows:
        parts[min(7, x[2] // 500_000 + (x in late))].append(x)
    for part in parts:
        df = spark.createDataFrame(part, "k string, id long, ms long").withColumn("ts", F.timestamp_millis("ms"))
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k string, id long, ms long, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = {x["id"]: x["cluster_id"] for x in windows.drained(clusters(stream, "k", 20_000, 3, "600 seconds"), str(tmp_path)).collect()}
    table = spark.createDataFrame(rows, "k string, id long, ms long")
    want = {x["id"]: x["cluster_id"] for x in cluster.dbscan_1d(table, 20_000, 3, ["k"], "ms").collect()}
    mark = int(at.max()) - 600_000
    sure = {x[1] for x in rows if x[2] + 40_000 < mark}
    assert sure <= set(out) and all(want[i] == c for i, c in out.items()) and max(out.values()) > 3


def test_stream_clusters_hold_few_bytes_an_event(spark):
    """A stream's first batch waits in the state as a whole; the next one hands it on."""
    import tracemalloc

    import pandas as pd

    from fathomline.streaming.clusters import clusters
    from pyspark.sql.types import StructType

    class Stream:  # hands over the function of a group
        schema = StructType().add("k", "string")
        withWatermark = select = filter = groupBy = lambda self, *a: self
        applyInPandasWithState = lambda self, run, *a: run

    class State:
        exists, hasTimedOut, mark, get = False, False, 0, None
        getCurrentWatermarkMs = lambda self: self.mark
        setTimeoutTimestamp = lambda self, at: None

        def update(self, row):
            self.exists, self.get = True, row

    n, state, run = 200_000, State(), clusters(Stream(), "k", 1000, 3, "10 minutes")
    batches = (pd.DataFrame({"id": np.arange(k, k + 10_000), "at": np.arange(k, k + 10_000) * 7919 % n * 100}) for k in range(0, n, 10_000))
    tracemalloc.start()
    assert list(run(("a",), batches, state)) == []
    state.hasTimedOut, state.mark = True, n * 100 + 10_000
    seen = sum(len(part) for part in run(("a",), iter(()), state))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert seen == n and peak < 150 * n, peak / n
