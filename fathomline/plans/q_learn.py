"""Queries of learned scorers, causal search and methods by name. Where there is no SQL, the tests hold the operators against plain versions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..learn import nets, training
from ..operators import causal
from ..operators import detectors as M
from ..operators import narrator as N
from ..operators import rca as A
from ..sources.testdata import ORDERED, SUPPLY
from .registry import query

R = lambda c, n=6: F.round(c, n)
WIDTH = 5


def _net(name: str, **settings):
    return nets.NETS[name](WIDTH, len(SUPPLY), **settings)


def _scored(t, net, ahead=False, steps=10, **settings):
    table = training.packed(t.supplies, WIDTH, ahead)
    state, _ = training.fit(table, net, training.Settings(steps=steps, batches=2, **settings), ahead=ahead)
    return training.score(table, net, training.best(state), SUPPLY, ahead=ahead).select("model", "entity", "ts", "feature", "score")


@query("det_14e_two_decoders")
def _(t):
    return _scored(t, _net("two_decoders"), epoch=1)  # an epoch is a round of all windows, so the decoders are trained against each other from the second one on


@query("det_14f_neighbour_graph")
def _(t):
    return _scored(t, _net("neighbour_graph"), ahead=True)


@query("det_14a_self_conditioned")
def _(t):
    return _scored(t, _net("self_conditioned"), steps=6)


@query("det_14g_attentive_forecast")
def _(t):
    return _scored(t, _net("attentive_forecast"), ahead=True, steps=6)


@query("det_14b_recurrent_variational")
def _(t):
    return _scored(t, _net("recurrent_variational"), steps=6)


@query("det_14d_static_dynamic")
def _(t):
    return _scored(t, _net("static_dynamic"), steps=6)


@query("clu_22b_auto_encoder")
def _(t):
    table = training.packed(t.supplies, WIDTH)
    net = _net("compressed", convolved=True)
    state, _ = training.fit(table, net, training.Settings(steps=8, batches=2))
    return training.encoded(table, net, training.best(state)).select("model", "entity", "ts", F.transform("z", lambda v: F.round(v, 6)).alias("z"))


def _centres(table):
    """Chunks of each cluster's centre, its first supplier; table: packed series."""
    each = table.select("model", F.posexplode("entity").alias("k", "entity"), "n", "ts", "x")
    centre = table.select("model", F.explode("entity").alias("entity")).groupBy("model").agg(F.min("entity").alias("entity"))
    own = each.join(F.broadcast(centre), ["model", "entity"], "left_semi")  # a row for each model
    before, n, k = F.aggregate(F.slice("n", 1, F.col("k")), F.lit(0), lambda a, v: a + v), F.get("n", F.col("k")), len(SUPPLY)
    series = own.select("model", "entity", F.explode(F.transform(F.sequence(before, before + n - 1), lambda i: F.struct(F.get("ts", i).alias("ts"), F.slice("x", i * k + 1, F.lit(k)).alias("x")))).alias("p"))
    return training.chunks(training.windows(series.select("model", "entity", "p.ts", "p.x"), WIDTH), 32)


@query("det_15c_fine_tuned")
def _(t):
    net = _net("two_decoders")
    table = training.packed(t.supplies, WIDTH)
    state, _ = training.fit(_centres(table), net, training.Settings(steps=6))
    return training.fine_tuned(table, net, training.Settings(steps=4), training.best(state), SUPPLY, frozen=("encoder",), anew=("inner decoders",)).select("model", "entity", "ts", "feature", "score")


@query("det_19b_model_store")
def _(t):
    from ..storage import stored

    net = _net("two_decoders")
    state, history = training.fit(_centres(training.packed(t.supplies, WIDTH)), net, training.Settings(steps=5))
    store = stored(training.layers(training.best(state), net, "best").unionByName(training.layers(state, net, "last")), "versions")
    back = training.restored(store, net, "best").join(training.best(state).withColumnRenamed("weights", "known"), "model")
    losses = history.groupBy("model").agg(F.min("valid_loss").alias("least"))
    same = back.select("model", (F.col("weights") == F.col("known")).alias("restored"))
    kept = state.join(losses, "model").select("model", "best_step", (F.col("best_loss") == F.col("least")).alias("is_least"))
    return store.join(same, "model").join(kept, "model").select("version", "model", "layer", "shape", F.size("values").alias("n"), "restored", "best_step", "is_least")


@query("rca_17_pc")
def _(t):
    return causal.pc(t.ordered, ORDERED)


def _high(t):
    """Orders with a metric in state 1 where it is over its mean by a deviation."""
    fit = t.ordered.agg(*[x for m in ORDERED for x in (F.avg(m).alias(f"{m}_m"), F.stddev_pop(m).alias(f"{m}_s"))])  # one row
    return t.ordered.join(F.broadcast(fit)).select("o_orderkey", *[(F.col(m) > F.col(f"{m}_m") + F.col(f"{m}_s")).cast("int").alias(m) for m in ORDERED])


def _network(t):
    high = _high(t)
    return high, causal.learned(causal.cells(high, {m: F.col(m) for m in ORDERED}), {m: 2 for m in ORDERED})


@query("rca_17_bayesian_network")
def _(t):
    return causal.edges_of(t.spark, _network(t)[1])


@query("rca_17_bayesian_causes")
def _(t):
    high, network = _network(t)
    return causal.bayesian_causes(network, high.filter("total = 1")).select("o_orderkey", "cause", R("probability").alias("probability"))


_P = "(PARTITION BY entity, feature ORDER BY bucket_ts ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING)"


@query("ext_01_detector_by_name", f"SELECT 'rolling_mean' AS detector, entity, feature, bucket_ts, round(coalesce((value - avg(value) OVER {_P}) ** 2, 0), 4) AS score FROM samples UNION ALL SELECT 'seasonal_naive', entity, feature, bucket_ts, round(coalesce((value - lag(value, 4) OVER (PARTITION BY entity, feature ORDER BY bucket_ts)) ** 2, 0), 4) FROM samples", "samples")
def _(t):
    each = lambda name: M.detector(name).score(t.samples).select(F.lit(name).alias("detector"), "entity", "feature", "bucket_ts", R("score", 4).alias("score"))
    return each("rolling_mean").unionByName(each("seasonal_naive"))


@query("ext_04_method_by_name")
def _(t):
    high, network = _network(t)
    N.register_method("random_walk", A.random_walk)
    N.register_method("bn", lambda evidence, net=network: causal.bayesian_causes(net, evidence).groupBy(F.col("cause").alias("entity")).agg(F.avg("probability").alias("score")))
    walk = N.METHODS["random_walk"](t.topology, t.anomalies.filter("attribute = 'view'").select("entity"))
    return walk.select(F.lit("random_walk").alias("method"), "entity", R("score").alias("score")).unionByName(N.METHODS["bn"](high.filter("total = 1")).select(F.lit("bn").alias("method"), "entity", R("score").alias("score")))


@query("ext_05_causal_method")
def _(t):
    N.register_method("pc", lambda df, metrics: causal.pc(df, metrics, alpha=0.001, deepest=2))
    graph = N.METHODS["pc"](t.ordered, ORDERED).select("src", "dst")
    return N.apply_rules(graph, N.domain_rules(t.spark, [("tax", "lines")], [], ["lines"], ["total"])).select("src", "dst")
