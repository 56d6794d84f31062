"""Networks, data-parallel training and the model store."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathomline.learn import nets, training
from fathomline.learn.tape import Value

SERIES = "model string, entity string, ts long, x array<double>"


def planted(n=400, entities=("a", "b", "c"), faults=()):
    """Four features of one rhythm, and faults at some times: one feature leaves the others' rhythm, within its usual range."""
    r = np.random.default_rng(3)
    rows = []
    for k, e in enumerate(entities):
        for t in range(n):
            s, c = np.sin(2 * np.pi * (t + k) / 16), np.cos(2 * np.pi * (t + k) / 16)
            x = np.array([s, c, s * c * 2, s * s - c * c]) + r.normal(size=4) * 0.03
            if (e, t) in faults:
                x[3] = -x[3]
            rows.append(("m", e, t, [float(v) for v in x]))
    return rows


NETS = [
    nets.TwoDecoders(3, 4, 3), nets.NeighbourGraph(3, 4, 5, 2), nets.SelfConditioned(3, 2, 6), nets.AttentiveForecast(3, 4, 5), nets.RecurrentVariational(3, 4, 5, 2, 2), nets.StaticDynamic(3, 4, 5, 2, 2),
    nets.Compressed(4, 3, 2, 6), nets.Compressed(6, 3, 2, 6, True, 4),
]


@pytest.mark.parametrize("net", NETS, ids=lambda n: type(n).__name__)
@pytest.mark.parametrize("epoch", [1, 4])
def test_gradients_equal_finite_differences(net, epoch):
    r = np.random.default_rng(1)
    w, x, y = net.initial(3), r.normal(size=(5, net.width, net.features)), r.normal(size=(5, net.features))
    losses, grads = net.gradients(w, x, y, epoch)
    of = lambda v, k: float(net.objectives({n: Value(z) for n, z in net.split(v).items()}, x, y, epoch)[k][0].x)
    for k, g in enumerate(grads):
        assert abs(of(w, k) - losses[k]) < 1e-12
        moves = net.places(net.objectives({n: Value(z) for n, z in net.split(w).items()}, x, y, epoch)[k][1])
        assert not g[~moves].any()
        for i in r.choice(np.flatnonzero(moves), 60):
            step = np.zeros_like(w)
            step[i] = 1e-6
            assert abs((of(w + step, k) - of(w - step, k)) / 2e-6 - g[i]) < 1e-5 * max(1, abs(g[i]))


@pytest.fixture(scope="module")
def healthy(spark):
    return training.chunks(training.windows(spark.createDataFrame(planted(), SERIES), 6), 64).cache()


def test_loss_falls_and_seeds_repeat(spark, healthy):
    net = nets.TwoDecoders(6, 4, 3)
    state, history = training.fit(healthy, net, training.Settings(steps=12, rate=0.02))
    losses = [r["valid_loss"] for r in history.orderBy("step").collect()]
    assert len(losses) == 13 and losses[-1] < 0.8 * losses[0]
    row = state.first()
    assert row["best_loss"] == min(losses) and row["best_step"] == losses.index(min(losses))
    again, _ = training.fit(healthy.repartition(7), net, training.Settings(steps=12, rate=0.02))
    assert again.first()["weights"] == row["weights"]  # to the last bit, dealt otherwise
    other, _ = training.fit(healthy, net, training.Settings(steps=1, seed=8))
    assert other.first()["best"] != row["best"]


def test_sums_equal_one_batch(spark, healthy):
    """The sums over chunks are the gradient over all their rows at once."""
    net = nets.TwoDecoders(6, 4, 3)
    rows = [r for r in healthy.collect() if r["chunk"] % training.VALID]
    w = net.initial(7)
    x = np.concatenate([np.frombuffer(r["x"]).reshape(r["n"], 6, 4) for r in rows])
    y = np.concatenate([np.frombuffer(r["y"]).reshape(r["n"], 4) for r in rows])
    _, grads = net.gradients(w, x, y, 1)
    state, _ = training.fit(healthy, net, training.Settings(steps=1, rate=1.0))
    moments = np.frombuffer(state.first()["moments"]).reshape(2, 2, -1)
    assert np.allclose(moments[0] * 10, np.stack(grads) / len(x), atol=1e-6)


def test_frozen_layers_are_bit_equal_and_new_ones_start_afresh(spark, healthy):
    net = nets.TwoDecoders(6, 4, 3)
    state, _ = training.fit(healthy, net, training.Settings(steps=3))
    start = training.best(state)
    tuned, _ = training.fit(healthy, net, training.Settings(steps=3), start, frozen=("encoder",), anew=("inner decoders",))
    before, after = net.split(np.frombuffer(start.first()["weights"])), net.split(np.frombuffer(tuned.first()["weights"]))
    for name in before:
        assert (before[name] == after[name]).all() == (name in net.named("encoder")), name
    first, _ = training.fit(healthy, net, training.Settings(steps=0), start, anew=("g0.w",))
    fresh = net.split(net.initial(training.Settings().seed + 1))
    assert (net.split(np.frombuffer(first.first()["weights"]))["g0.w"] == fresh["g0.w"]).all()


def test_store_round_trip(spark, healthy):
    net = nets.NeighbourGraph(6, 4)
    state, _ = training.fit(training.chunks(training.windows(spark.createDataFrame(planted(60), SERIES), 6, ahead=True)), net, training.Settings(steps=2))
    store = training.layers(training.best(state), net, "v1").unionByName(training.layers(state, net, "v2")).cache()
    assert training.restored(store, net, "v1").first()["weights"] == state.first()["best"]
    assert training.restored(store, net, "v2").first()["weights"] == state.first()["weights"]
    with pytest.raises(Exception, match="other layers"):
        training.restored(store, nets.NeighbourGraph(5, 4), "v1").collect()


def top_hits(scores, faults, k):
    return len({(r["entity"], r["ts"]) for r in scores.orderBy(F.desc("s")).limit(k).collect()} & set(faults)) / len(faults)


def test_scores_beat_components_on_planted_faults(spark):
    """The fault keeps every feature in its range, and the first components see little of it."""
    faults = [("a", 57), ("a", 190), ("b", 75), ("b", 301), ("c", 120), ("c", 333), ("a", 283), ("b", 222)]
    train = training.chunks(training.windows(spark.createDataFrame(planted(), SERIES), 6), 64)
    net = nets.TwoDecoders(6, 4, 3)
    state, _ = training.fit(train, net, training.Settings(steps=35, rate=0.06, epoch=60))
    sick = training.windows(spark.createDataFrame(planted(faults=set(faults)), SERIES), 6).cache()
    scores = training.score(training.chunks(sick, 64), net, training.best(state), list("wxyz"))
    assert scores.count() == sick.count() * 4 and scores.filter("abs(score - (0.95 * first + 0.05 * second)) > 1e-12").count() == 0
    ours = top_hits(scores.groupBy("entity", "ts").agg(F.sum("score").alias("s")), faults, 8)
    x = np.array([r["x"] for r in training.windows(spark.createDataFrame(planted(), SERIES), 6).collect()])
    mean, basis = x.mean(axis=0), np.linalg.svd(x - x.mean(axis=0), full_matrices=False)[2][:3]
    rows = [(r["entity"], r["ts"], float((((np.array(r["x"]) - mean) - (np.array(r["x"]) - mean) @ basis.T @ basis)[-4:] ** 2).sum())) for r in sick.collect()]
    theirs = top_hits(spark.createDataFrame(rows, "entity string, ts long, s double"), faults, 8)
    assert ours >= theirs + 0.2


def test_neighbour_graph_recovers_planted_groups(spark):
    """Three features go on as they are, three turn round at each step; each one's neighbours are to be those that behave alike."""
    r, x, groups = np.random.default_rng(5), np.zeros((500, 6)), np.array([0, 0, 0, 1, 1, 1])
    for t in range(1, 500):
        x[t] = np.where(groups == 0, 0.95, -0.95) * x[t - 1] + r.normal(size=6) * 0.3
    rows = [("m", "e", t, [float(v) for v in x[t]]) for t in range(500)]
    table = training.chunks(training.windows(spark.createDataFrame(rows, SERIES), 2, ahead=True), 64)
    net = nets.NeighbourGraph(2, 6, 4, 3)
    state, history = training.fit(table, net, training.Settings(steps=25, rate=0.1))
    losses = [v["valid_loss"] for v in history.orderBy("step").collect()]
    assert min(losses) < 0.6 * losses[0]
    near = net.graph(net.split(np.frombuffer(state.first()["best"]))["vectors"])
    alike = (groups[:, None] == groups[None]) & ~np.eye(6, dtype=bool)
    first = net.graph(net.split(net.initial(7))["vectors"])
    assert (near & alike).sum() >= 0.8 * (near.sum() - 6) and (first & alike).sum() < 0.7 * (first.sum() - 6)


def test_self_conditioned_loss_falls(spark):
    rows = [(m, e, t, x[:2]) for m, e, t, x in planted(120)]
    table = training.chunks(training.windows(spark.createDataFrame(rows, SERIES), 4), 64)
    state, history = training.fit(table, nets.SelfConditioned(4, 2, 8), training.Settings(steps=25, rate=0.03))
    losses = [r["valid_loss"] for r in history.orderBy("step").collect()]
    assert min(losses) < 0.5 * losses[0]


@pytest.mark.parametrize("net,ahead", [(nets.AttentiveForecast(4, 4, 8), True), (nets.RecurrentVariational(4, 4, 12, 4, 1), False), (nets.StaticDynamic(4, 4, 12), False)], ids=["attentive", "variational", "static"])
def test_recurrent_networks_learn_and_see_faults(spark, net, ahead):
    faults = [("a", 56), ("b", 75), ("a", 108), ("b", 131)]  # where the fourth feature is far from 0
    make = lambda f: training.chunks(training.windows(spark.createDataFrame(planted(140, ("a", "b"), f), SERIES), 4, ahead), 64)
    state, history = training.fit(make(()), net, training.Settings(steps=25, rate=0.1))
    losses = [r["valid_loss"] for r in history.orderBy("step").collect()]
    assert min(losses) < losses[0] - 0.3 * abs(losses[0])
    scores = training.score(make(set(faults)), net, training.best(state), list("wxyz")).groupBy("entity", "ts").agg(F.sum("score").alias("s"))
    near = {(e, t + k) for e, t in faults for k in (0, 1)}  # a forecast also errs where a fault is in its history
    top = {(r["entity"], r["ts"]) for r in scores.orderBy(F.desc("s")).limit(8).collect()}
    assert len(top & near) >= 3


@pytest.mark.parametrize("convolved", [False, True])
def test_latent_values_tell_rhythms_apart(spark, convolved):
    rows = planted(120, ("a", "b")) + [("m", "c", t, [float(v) for v in np.random.default_rng(t).normal(size=4) * 0.1]) for t in range(120)]
    table = training.chunks(training.windows(spark.createDataFrame(rows, SERIES), 8), 64)
    net = nets.Compressed(8, 4, 2, 12, convolved)
    state, history = training.fit(table, net, training.Settings(steps=30, rate=0.03))
    losses = [r["valid_loss"] for r in history.orderBy("step").collect()]
    assert min(losses) < 0.7 * losses[0]
    z = {}
    for r in training.encoded(table, net, training.best(state)).collect():
        z.setdefault(r["entity"], []).append(r["z"])
    assert {k: len(v) for k, v in z.items()} == dict.fromkeys("abc", 113)
    spread = {k: float(np.std(v, axis=0).mean()) for k, v in z.items()}
    assert spread["c"] < 0.5 * min(spread["a"], spread["b"])


def test_windows_and_edge_cases(spark):
    rows = [("m", "a", t, [float(t), 0.0]) for t in range(5)] + [("m", "b", 0, [1.0, 1.0]), ("m", "a", 9, None), ("m", "a", 8, [None, 1.0]), ("m", "a", 7, [float("nan"), 1.0])]
    df = spark.createDataFrame(rows, SERIES)
    got = sorted((r["entity"], r["ts"], r["x"], r["y"]) for r in training.windows(df, 3).collect())
    assert got == [("a", t, [t - 2.0, 0.0, t - 1.0, 0.0, float(t), 0.0], [float(t), 0.0]) for t in (2, 3, 4)]
    ahead = sorted((r["ts"], r["x"], r["y"]) for r in training.windows(df, 3, ahead=True).collect())
    assert ahead == [(t, [t - 3.0, 0.0, t - 2.0, 0.0, t - 1.0, 0.0], [float(t), 0.0]) for t in (3, 4)]
    none = training.chunks(training.windows(df.filter("false"), 3))
    state, history = training.fit(none, nets.TwoDecoders(3, 2), training.Settings(steps=1))
    assert state.count() == 0 and history.count() == 0


def test_many_models_train_apart(spark):
    rows = planted(80)
    both = [("one", e, t, x) for _, e, t, x in rows] + [("two", e, t, [-v for v in x]) for _, e, t, x in rows]
    net = nets.TwoDecoders(4, 4)
    table = training.chunks(training.windows(spark.createDataFrame(both, SERIES), 4), 32).cache()
    together = {r["model"]: r["weights"] for r in training.fit(table, net, training.Settings(steps=2, batches=2))[0].collect()}
    for m in ("one", "two"):
        assert training.fit(table.filter(F.col("model") == m), net, training.Settings(steps=2, batches=2))[0].first()["weights"] == together[m]
