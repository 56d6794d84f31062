"""Root-cause ranking: candidates, their features, scores, knowledge graph and search over it."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stored
from . import graph


@dataclass(frozen=True)
class RcaConfig:
    """Weights of a domain, in one place; reports are rendered from it."""

    time: float = 0.3
    topology: float = 0.4
    count: float = 0.3
    invert_in_degree: bool = True
    window_seconds: int = 240
    start_index: int = 3
    threshold: int = 2
    components: dict[str, float] = field(default_factory=dict)
    graph_weights: tuple[float, ...] = (0.3, 0.15, 0.2, 0.15, 0.1, 0.05, 0.05)


BANK = RcaConfig()
TELECOM = RcaConfig(0.025, 0.025, 0.95, invert_in_degree=False, window_seconds=300, threshold=1, components={"db": 1.0, "docker": 0.9, "os": 0.8})


def within_analysis_window(df: DataFrame, seconds: int, index: int = 3, cluster: str = "cluster_id") -> DataFrame:
    """WIN-15: rows up to `seconds` after the index-th distinct time of their cluster (or its last)."""
    times = df.groupBy(cluster).agg(F.array_sort(F.collect_set("ts")).alias("t"))
    start = times.select(cluster, F.element_at("t", F.least(F.lit(index), F.size("t"))).alias("t0"))
    return df.join(start, cluster).filter(F.col("ts") <= F.col("t0") + seconds)


def candidates(anomalies: DataFrame, config: RcaConfig = BANK) -> DataFrame:
    """RCA-01: cluster_id, entity, earliest_ts, total, fault (the commonest attribute), with the threshold and its fallback.

    An edge a->b counts for both ends.
    """
    rows = within_analysis_window(anomalies, config.window_seconds, config.start_index)
    rows = rows.withColumn("entity", F.explode(F.split("entity", "->")))
    by = rows.groupBy("cluster_id", "entity", "attribute").agg(F.count("*").alias("n"), F.min("ts").alias("t"))
    out = by.groupBy("cluster_id", "entity").agg(F.sum("n").alias("total"), F.min("t").alias("earliest_ts"), F.max_by("attribute", F.struct("n", (-F.col("t")).alias("t"), "attribute")).alias("fault"))
    top = F.max("total").over(Window.partitionBy("cluster_id"))
    return out.withColumn("_top", top).filter(F.col("total") >= F.when(F.col("_top") >= config.threshold, config.threshold).otherwise(1)).drop("_top")


def enriched(found: DataFrame, edges: DataFrame) -> DataFrame:
    """RCA-02: degrees, and how many candidates of the same cluster are reachable (itself included)."""
    deg = graph.degrees(edges)
    reach = graph.descendants(edges)
    other = found.select("cluster_id", F.col("entity").alias("dst"))
    n = found.select("cluster_id", F.col("entity").alias("src")).join(reach, "src").join(other, ["cluster_id", "dst"], "left_semi").groupBy("cluster_id", F.col("src").alias("entity")).agg(F.count("*").alias("n"))
    out = found.join(deg, "entity", "left").join(n, ["cluster_id", "entity"], "left")
    return out.select(*found.columns, F.coalesce("in_degree", F.lit(0)).alias("in_degree"), F.coalesce("out_degree", F.lit(0)).alias("out_degree"), F.when(F.col("in_degree").isNull(), 0).otherwise(F.coalesce("n", F.lit(0)) + 1).alias("reachable"))


def _share(col: str, w) -> Column:
    return F.col(col) / F.greatest(F.max(col).over(w), F.lit(1))


def final_scores(df: DataFrame, config: RcaConfig = BANK) -> DataFrame:
    """RCA-03/04: weighted time, topology and count, ranked before rounding to two places (half to even)."""
    w = Window.partitionBy("cluster_id")
    t0, t1 = F.min("earliest_ts").over(w), F.max("earliest_ts").over(w)
    time = F.when(t0 == t1, 1.0).otherwise((t1 - F.col("earliest_ts")) / F.nullif(t1 - t0, F.lit(0)))
    inward = 1 - _share("in_degree", w) if config.invert_in_degree else _share("in_degree", w)
    rows = df.withColumn("time_score", time).withColumn("topology_score", (inward + _share("out_degree", w) + _share("reachable", w)) / 3).withColumn("count_score", _share("total", w))
    score = config.time * F.col("time_score") + config.topology * F.col("topology_score") + config.count * F.col("count_score")
    if config.components:
        weight = F.lit(0.5)
        for name, value in config.components.items():
            weight = F.when(F.col("entity").startswith(name), value).otherwise(weight)
        score = score * weight
    rows = rows.withColumn("final_score", F.round(score, 9))
    rank = F.row_number().over(w.orderBy(F.desc("final_score"), "entity"))
    return rows.withColumn("rank", rank)


def rounded(df: DataFrame, cols: list[str], places: int = 2) -> DataFrame:
    """FN-17: half to even, on decimals, as the decimal shown is what is rounded."""
    return df.withColumns({c: F.bround(F.col(c).cast("decimal(20,9)"), places).cast("double") for c in cols})


def root_causes(anomalies: DataFrame, edges: DataFrame, config: RcaConfig = BANK) -> DataFrame:
    """RCA-01 to 03 in one plan, for all clusters at once."""
    return final_scores(enriched(candidates(anomalies, config), edges), config)


def most_frequent_per_type(df: DataFrame, least: int = 4) -> DataFrame:
    """RCA-06: of each type the most frequent (entity, attribute), the first seen of equals, if frequent enough."""
    n = df.groupBy("type", "entity", "attribute").agg(F.count("*").alias("cnt"), F.min("ts").alias("first"))
    rank = F.row_number().over(Window.partitionBy("type").orderBy(F.desc("cnt"), "first", "entity", "attribute"))
    return n.filter(F.col("cnt") >= least).withColumn("r", rank).filter("r = 1").drop("r")


#: Indicators that attributes stand for, and the one for those not listed, which weighs half.
INDICATORS = {"click": "avg_rt", "error": "error_rate", "purchase": "avg_tps", "view": "avg_rt"}
DEFAULT_INDICATOR = "avg_cpu"


def indicators(df: DataFrame) -> DataFrame:
    """RCA-07, AGG-15: weight of each indicator in a cluster: mean weight times its share of the anomalies."""
    dim = df.sparkSession.createDataFrame(list(INDICATORS.items()), "attribute string, indicator string")
    rows = df.join(dim, "attribute", "left").withColumn("w", F.when(F.col("indicator").isNull(), 0.5).otherwise(1.0)).withColumn("indicator", F.coalesce("indicator", F.lit(DEFAULT_INDICATOR)))
    by = rows.groupBy("cluster_id", "indicator").agg(F.avg("w").alias("w"), F.count("*").alias("n"))
    by = by.withColumn("weight", F.col("w") * F.col("n") / F.sum("n").over(Window.partitionBy("cluster_id"))).filter("weight > 0.1")
    rank = F.row_number().over(Window.partitionBy("cluster_id").orderBy(F.desc(F.round("weight", 9)), "indicator"))
    return by.withColumn("rank", rank).filter("rank <= 5").select("cluster_id", "indicator", "weight", "rank")


# --- knowledge graph -----------------------------------------------------------------------------------------------

def kg_nodes(anomalies: DataFrame) -> DataFrame:
    """GRF-10: nodes of each cluster; ids come from what a node stands for."""
    part = lambda kind, value: anomalies.select("cluster_id", F.concat(F.lit(kind + ":"), value).alias("id"), F.lit(kind).alias("label"), value.alias("name"))
    return part("entity", F.col("entity")).union(part("attribute", F.concat_ws("/", "entity", "attribute"))).union(part("fault", F.col("type"))).distinct()


def kg_edges(anomalies: DataFrame, edges: DataFrame) -> DataFrame:
    """GRF-11: cluster_id, type, src, dst, ts of all relations; HAS_ANOMALY always leads from entity to attribute."""
    ent, att, fault = F.concat(F.lit("entity:"), "entity"), F.concat(F.lit("attribute:"), F.concat_ws("/", "entity", "attribute")), F.concat(F.lit("fault:"), "type")
    rel = lambda kind, s, d, ts=None: anomalies.select("cluster_id", F.lit(kind).alias("type"), s.alias("src"), d.alias("dst"), (F.lit(None).cast("long") if ts is None else F.col(ts)).alias("ts"))
    nodes = anomalies.select("cluster_id", "entity").distinct()
    topo = edges.join(nodes.withColumnRenamed("entity", "src"), "src").join(nodes.select(F.col("cluster_id").alias("c2"), F.col("entity").alias("dst")), "dst").filter("cluster_id = c2")
    topo = topo.select("cluster_id", F.lit("TOPOLOGY_DEPENDS_ON").alias("type"), F.concat(F.lit("entity:"), "src").alias("src"), F.concat(F.lit("entity:"), "dst").alias("dst"), F.lit(None).cast("long").alias("ts"))
    return rel("HAS_ANOMALY", ent, att, "ts").union(rel("HAS_ATTRIBUTE", ent, att).distinct()).union(rel("MAPS_TO_FAULT", att, fault).distinct()).union(topo)


#: Weight of a severity.
SEVERITY = {"critical": 1.0, "warning": 0.6, "info": 0.2}


def kg_features(edges: DataFrame) -> DataFrame:
    """RCA-08: per entity of a graph: anomalies, first and last time, severity, fault types, neighbours."""
    own = edges.filter("type = 'HAS_ANOMALY'")
    faults = edges.filter("type = 'MAPS_TO_FAULT'").select("cluster_id", F.col("src").alias("dst"), F.col("dst").alias("fault"))
    kind = F.expr("substr(fault, 7)")
    weight = F.lit(0.2)
    for name, (_, severity) in graph.DESCRIPTIONS.items():
        weight = F.when(kind == name, SEVERITY[severity]).otherwise(weight)
    base = own.join(faults, ["cluster_id", "dst"]).groupBy("cluster_id", F.col("src").alias("id")).agg(
        F.count("*").alias("anomalies"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.round(F.sum(weight), 6).alias("severity"), F.array_sort(F.collect_set(kind)).alias("faults"))
    t = edges.filter("type = 'TOPOLOGY_DEPENDS_ON'")
    near = t.select("cluster_id", F.col("src").alias("id"), F.col("dst").alias("other")).union(t.select("cluster_id", "dst", "src")).distinct().groupBy("cluster_id", "id").agg(F.count("*").alias("neighbours"))
    return base.join(near, ["cluster_id", "id"], "left").withColumn("neighbours", F.coalesce("neighbours", F.lit(0)))


def propagation(edges: DataFrame, any_earlier: bool = False) -> DataFrame:
    """RCA-09: an entity is newly anomalous while a neighbour was at the time before (or at any earlier time).

    Of several neighbours the smallest is the source.
    """
    own = edges.filter("type = 'HAS_ANOMALY'").select("cluster_id", "src", "ts").distinct()
    times = own.select("cluster_id", "ts").distinct()
    w = Window.partitionBy("cluster_id").orderBy("ts")
    times = times.withColumn("before", F.lag("ts").over(w))
    rows = own.join(times, ["cluster_id", "ts"]).withColumnRenamed("src", "id")
    prior = own.select("cluster_id", F.col("src").alias("source"), F.col("ts").alias("t"))
    t = edges.filter("type = 'TOPOLOGY_DEPENDS_ON'")
    near = t.select("cluster_id", F.col("src").alias("id"), F.col("dst").alias("source")).union(t.select("cluster_id", "dst", "src")).distinct()
    if any_earlier:
        first = own.groupBy("cluster_id", F.col("src").alias("id")).agg(F.min("ts").alias("ts"))
        seen = own.groupBy("cluster_id", F.col("src").alias("source")).agg(F.min("ts").alias("t"))
        hit = first.join(near, ["cluster_id", "id"]).join(seen, ["cluster_id", "source"]).filter("t < ts")
    else:
        again = rows.select("cluster_id", "id", "ts", "before").join(own.select("cluster_id", F.col("src").alias("id"), F.col("ts").alias("before")), ["cluster_id", "id", "before"], "left_anti")
        hit = again.filter("before is not null").join(near, ["cluster_id", "id"]).join(prior.withColumnRenamed("t", "before"), ["cluster_id", "source", "before"])
    return hit.groupBy("cluster_id", "id", "ts").agg(F.min("source").alias("source")).select("cluster_id", "source", F.col("id").alias("target"), "ts")


def kg_scores(features: DataFrame, paths: DataFrame, config: RcaConfig = BANK, clamp: bool = False) -> DataFrame:
    """RCA-10/11: weighted factors of each entity; clamp: the variant whose causal part counts in full, held to [0, 1]."""
    w = Window.partitionBy("cluster_id")
    cause = paths.groupBy("cluster_id", F.col("source").alias("id")).agg(F.least(F.count("*") * 0.1, F.lit(0.5)).alias("causal"))
    rows = features.join(cause, ["cluster_id", "id"], "left").withColumn("causal", F.coalesce("causal", F.lit(0.0)))
    t0, t1 = F.min("first_ts").over(w), F.max("first_ts").over(w)
    time = F.when(t0 == t1, 1.0).otherwise((t1 - F.col("first_ts")) / F.nullif(t1 - t0, F.lit(0)))
    of = lambda c: F.coalesce(F.col(c) / F.nullif(F.max(c).over(w), F.lit(0)), F.lit(0.0))
    a, b, c, d, e, _, g = config.graph_weights
    if clamp:
        score = F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.4 * of("anomalies") + 0.2 * time + 0.25 * of("neighbours") + 0.15 * 0.5 + 0.1 * of("severity") + F.col("causal")))
    else:
        score = a * of("anomalies") + b * time + c * of("neighbours") + d * 0.5 + e * of("severity") + g * F.col("causal")
    rows = rows.withColumn("score", F.round(score, 6))
    return rows.withColumn("rank", F.row_number().over(w.orderBy(F.desc("score"), "id")))


def kept_causes(ranked: DataFrame, floor: float = 0.1) -> DataFrame:
    """FLT-09: the best of each cluster, and others that reach the floor and have a fault type."""
    return ranked.filter((F.col("rank") == 1) | ((F.col("score") >= floor) & (F.size("faults") > 0)))


def relation_keys(edges: DataFrame) -> DataFrame:
    """RCA-14: the relations an entity has, by direction."""
    out = edges.select("cluster_id", F.col("src").alias("id"), F.concat(F.lit("out::"), "type").alias("key"))
    return out.union(edges.select("cluster_id", F.col("dst"), F.concat(F.lit("in::"), "type"))).distinct()


def expanded(edges: DataFrame) -> DataFrame:
    """RCA-14: the neighbours along each relation key, with the triplet as text."""
    t = F.concat("src", F.lit(" -"), "type", F.lit("-> "), "dst").alias("triplet")
    out = edges.select("cluster_id", F.col("src").alias("id"), F.concat(F.lit("out::"), "type").alias("key"), F.col("dst").alias("other"), t)
    return out.union(edges.select("cluster_id", F.col("dst"), F.concat(F.lit("in::"), "type"), F.col("src"), t)).distinct()


def candidate_scores(steps: DataFrame, features: DataFrame) -> DataFrame:
    """RCA-15/22: of the neighbours along a relation: 0.4 count + 0.3 severity + 1 (entity) or 0.2, normalised to sum 1."""
    f = features.select("cluster_id", F.col("id").alias("other"), "anomalies", "severity")
    rows = steps.join(f, ["cluster_id", "other"], "left")
    raw = 0.4 * F.coalesce("anomalies", F.lit(0)) + 0.3 * F.coalesce("severity", F.lit(0.0)) + F.when(F.col("other").startswith("entity:"), 1.0).otherwise(0.2)
    return normalised(rows.withColumn("raw", raw), ["cluster_id", "id", "key"], "raw").drop("anomalies", "severity", "raw")


def entity_scores(steps: DataFrame, features: DataFrame, relations: int = 3) -> DataFrame:
    """RCA-23: a pruner that judges entities at once: of each node the `relations` relation keys with the most neighbours (the first of equals), and
    scores that add up to 1 over all neighbours along them, not along each. A neighbour met along several keys counts once, by the first key.
    """
    size = steps.groupBy("cluster_id", "id", "key").agg(F.countDistinct("other").alias("n"))
    place = F.row_number().over(Window.partitionBy("cluster_id", "id").orderBy(F.desc("n"), "key"))  # a row a key
    kept = size.withColumn("r", place).filter(F.col("r") <= relations).select("cluster_id", "id", "key")
    once = steps.join(kept, ["cluster_id", "id", "key"]).groupBy("cluster_id", "id", "other").agg(F.min(F.struct("key", "triplet")).alias("x")).select("cluster_id", "id", "other", "x.key", "x.triplet")
    f = features.select("cluster_id", F.col("id").alias("other"), "anomalies", "severity")
    rows = once.join(f, ["cluster_id", "other"], "left")
    raw = 0.4 * F.coalesce("anomalies", F.lit(0)) + 0.3 * F.coalesce("severity", F.lit(0.0)) + F.when(F.col("other").startswith("entity:"), 1.0).otherwise(0.2)
    return normalised(rows.withColumn("raw", raw), ["cluster_id", "id"], "raw").drop("anomalies", "severity", "raw")


def normalised(df: DataFrame, keys: list[str], col: str) -> DataFrame:
    """RCA-22: not below 0, to a sum of 1; alike for all if they are all 0."""
    w = Window.partitionBy(*keys)
    x = F.greatest(F.col(col), F.lit(0.0))
    return df.withColumn("score", F.coalesce(F.round(x / F.nullif(F.sum(x).over(w), F.lit(0.0)), 9), 1.0 / F.count("*").over(w)))


def beam_search(edges: DataFrame, features: DataFrame, seeds: int = 5, width: int = 3, depth: int = 3, pruner=None) -> DataFrame:
    """RCA-16: from the best entities of each cluster, `depth` steps to the best neighbours not yet on the path.

    pruner: adds a score to steps; the default is candidate_scores. All clusters are searched at once, a join a step.
    """
    steps = stored((pruner or candidate_scores)(expanded(edges), features).select("cluster_id", "id", "other", "triplet", "score"), "steps")
    w = Window.partitionBy("cluster_id")
    order = [F.desc("anomalies"), F.desc("severity"), "first_ts", "id"]
    beam = features.withColumn("r", F.row_number().over(w.orderBy(*order))).filter(F.col("r") <= seeds)
    beam = stored(beam.select("cluster_id", "id", F.array("id").alias("path"), F.array().cast("array<string>").alias("chain"), F.lit(1.0).alias("weight")), "beam")
    out = beam
    for _ in range(depth):
        best = F.row_number().over(w.orderBy(F.desc("weight"), F.concat_ws("|", "path"), F.concat_ws("|", "chain")))
        step = beam.join(steps, ["cluster_id", "id"]).filter(~F.array_contains("path", F.col("other")))
        beam = step.select("cluster_id", F.col("other").alias("id"), F.concat("path", F.array("other")).alias("path"), F.concat("chain", F.array("triplet")).alias("chain"), F.round(F.col("weight") * F.col("score"), 9).alias("weight"))
        beam = stored(beam.withColumn("r", best).filter(F.col("r") <= width).drop("r"), "beam")
        out = out.union(beam)
    return out.withColumn("length", F.size("path"))


def weighted_indicators(df: DataFrame, weights: dict[str, float], other: float, least: float = 0.1, top: int = 5) -> DataFrame:
    """AGG-15: cluster_id, attribute, weight: the mean weight of an attribute's anomalies (by their type) times its share of the cluster's; those over `least`, `top` at most."""
    by_type = F.lit(other)
    for kind, w in weights.items():
        by_type = F.when(F.col("type") == kind, w).otherwise(by_type)
    each = df.groupBy("cluster_id", "attribute").agg(F.count("*").alias("n"), F.avg(by_type).alias("w"))
    whole = df.groupBy("cluster_id").agg(F.count("*").alias("all"))
    scored = each.join(whole, "cluster_id").withColumn("weight", F.round(F.col("w") * F.col("n") / F.col("all"), 6)).filter(F.col("weight") > least)
    place = F.row_number().over(Window.partitionBy("cluster_id").orderBy(F.desc("weight"), "attribute"))
    return scored.withColumn("r", place).filter(F.col("r") <= top).select("cluster_id", "attribute", "weight")


def condensed(df: DataFrame, least: int = 2) -> DataFrame:
    """RCA-21: (type, cleaned entity, attribute) with `least` distinct times in a cluster, and two of its names at most."""
    rows = df.withColumn("clean", graph.clean_name(F.col("entity")))
    g = rows.groupBy("cluster_id", "type", "clean", "attribute").agg(F.countDistinct("ts").alias("times"), F.slice(F.array_sort(F.collect_set("entity")), 1, 2).alias("names"))
    return g.filter(F.col("times") >= least)


def keywords(text: Column, words: list[str]) -> Column:
    """RCA-18: the words of a list that a text has, as whole words: no letter, mark, digit or _ of any script next to them."""
    part = r"[\p{L}\p{M}\p{N}_]"
    return F.filter(F.array(*[F.lit(x) for x in words]), lambda x: F.regexp_like(F.lower(text), F.concat(F.lit(f"(?<!{part})"), F.lower(x), F.lit(f"(?!{part})"))))


def random_walk(edges: DataFrame, start: DataFrame, restart: float = 0.15, rounds: int = 20) -> DataFrame:
    """RCA-17: random walk with restart from the start entities; mass of nodes without a way on returns to the start.

    What such nodes hold flows to a row of its own (dst null) in the same join as all else, and from there to the start, so a round is one
    job and nothing goes to the driver.
    """
    nodes = edges.select(F.col("src").alias("entity")).union(edges.select("dst")).union(start.select("entity")).distinct()
    starts = start.select("entity").distinct()
    share = starts.agg((1.0 / F.greatest(F.count("*"), F.lit(1))).alias("one"))  # one row
    base = nodes.join(starts.crossJoin(F.broadcast(share)), "entity", "left").select("entity", F.coalesce("one", F.lit(0.0)).alias("s"))
    base = stored(base, "nodes")
    out = edges.select("src", "dst").distinct()
    ways = out.join(out.groupBy("src").agg(F.count("*").alias("k")), "src").select("src", "dst", "k")
    ends = base.select(F.col("entity").alias("src")).join(out, "src", "left_anti").select("src", F.lit(None).cast(out.schema["dst"].dataType).alias("dst"), F.lit(1).cast("long").alias("k"))
    ways = stored(ways.unionByName(ends), "ways")
    rank = base.select("entity", "s", F.col("s").alias("p"))
    for _ in range(rounds):
        flow = stored(rank.join(ways, rank.entity == ways.src).groupBy("dst").agg(F.sum(F.col("p") / F.col("k")).alias("f")), "flow")
        lost = flow.filter("dst is null").agg(F.coalesce(F.sum("f"), F.lit(0.0)).alias("lost"))  # one row
        moved = base.join(flow, base.entity == flow.dst, "left").crossJoin(F.broadcast(lost))
        rank = moved.select("entity", "s", (restart * F.col("s") + (1 - restart) * (F.coalesce("f", F.lit(0.0)) + F.col("s") * F.col("lost"))).alias("p"))
    return rank.select("entity", F.col("p").alias("score"))
