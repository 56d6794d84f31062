"""Service graphs: edges, degrees, reachability, names and classes of entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .cluster import _cut


def topology(static: DataFrame, seen: DataFrame) -> DataFrame:
    """GRF-01: static edges and those seen in anomalies, with whether and when last an anomaly was seen on each."""
    a = static.select("src", "dst", F.lit(None).cast("long").alias("ts")).unionByName(seen.select("src", "dst", F.col("ts").cast("long").alias("ts")))
    return a.groupBy("src", "dst").agg((F.max("ts").isNotNull()).alias("has_anomaly"), F.max("ts").alias("anomaly_ts"))


def both_ways(edges: DataFrame) -> DataFrame:
    """GRF-02."""
    return edges.select("src", "dst").union(edges.select("dst", "src")).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """GRF-03: entity, in_degree, out_degree over distinct edges."""
    e = edges.select("src", "dst").distinct()
    ends = e.select(F.explode(F.array(F.struct(F.col("src").alias("entity"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("entity"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("x")).select("x.*")
    return ends.groupBy("entity").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))


def descendants(edges: DataFrame, most: int = 64) -> DataFrame:
    """GRF-04: src, dst of every node reachable from another; paths double in length each round, so rounds are few."""
    reach = _cut(edges.select("src", "dst").filter("src <> dst").distinct())
    count = reach.count()
    for _ in range(most):
        hop = reach.alias("a").join(reach.alias("b"), F.col("a.dst") == F.col("b.src")).select(F.col("a.src").alias("src"), F.col("b.dst").alias("dst")).filter("src <> dst")
        reach = _cut(reach.union(hop).distinct())
        now = reach.count()
        if now == count:
            return reach
        count = now
    raise RuntimeError("reachability did not settle")


def reachable_candidates(candidates: DataFrame, edges: DataFrame) -> DataFrame:
    """GRF-04: reachable candidates and itself; 0 for an entity that isn't in the graph."""
    nodes = edges.select(F.col("src").alias("entity")).union(edges.select("dst")).distinct().withColumn("here", F.lit(1))
    d = descendants(edges).join(candidates.select(F.col("entity").alias("dst")), "dst", "left_semi").groupBy(F.col("src").alias("entity")).agg(F.count("*").alias("n"))
    return candidates.select("entity").join(nodes, "entity", "left").join(d, "entity", "left").select("entity", F.when(F.col("here") == 1, F.coalesce("n", F.lit(0)) + 1).otherwise(0).alias("reachable_count"))


def full_graph(features: DataFrame) -> DataFrame:
    """GRF-12: every ordered pair of different features (a small set)."""
    a = features.select(F.col("feature").alias("src"))
    return a.join(features.select(F.col("feature").alias("dst")), F.col("src") != F.col("dst"))


def indexed_edges(edges: DataFrame, names: DataFrame) -> DataFrame:
    """GRF-12: edges by number of their nodes; those of unknown nodes are left out."""
    s, d = names.select(F.col("entity").alias("src"), F.col("idx").alias("i")), names.select(F.col("entity").alias("dst"), F.col("idx").alias("j"))
    return edges.join(s, "src").join(d, "dst").select("i", "j")


# --- names and classes ---------------------------------------------------------------------------------------------

#: Marks of service layers, first match wins; gateways by whole word, so that "config" isn't one.
LAYERS = [("service_test", "servicetest"), ("entry_point", "apache"), ("gateway", r"\big\d*\b"), ("governance", r"\bmg\d*\b"), ("business", "tomcat"), ("container", "docker"), ("database", "mysql"), ("cache", "redis")]

#: Attribute marks of fault classes.
FAULTS = [
    ("CPU fault", "cpu"), ("network delay", "latency|response_time|delay|rt$"), ("network loss", "loss|drop_rate"),
    ("db connection limit", "connection_count|max_connections|conn_limit|db_connection"), ("db close", "db_down|db_shutdown|db_status|connection_closed"),
]

#: What a fault class is and how bad.
DESCRIPTIONS = {"metric": ("Metric outside its usual range", "warning"), "trace": ("Call slower or rarer than usual", "critical"), "log": ("Log pattern more frequent than usual", "info")}


def _ladder(col: Column, rules: list[tuple[str, str]], default: str | None) -> Column:
    out = F.lit(default)
    for name, pattern in reversed(rules):
        out = F.when(F.lower(col).rlike(pattern), F.lit(name)).otherwise(out)
    return out


def layer_of(entity: Column) -> Column:
    """GRF-06."""
    return _ladder(entity, LAYERS, None)


def fault_of(attribute: Column) -> Column:
    """GRF-08."""
    return _ladder(attribute, FAULTS, "unknown")


def clean_name(entity: Column) -> Column:
    """GRF-07: without a host prefix (node-5.name), a replica number (name-0) and what follows a colon."""
    x = F.regexp_replace(entity, r"^node-\d+\.", "")
    x = F.element_at(F.split(x, ":"), 1)
    return F.regexp_replace(x, r"-\d+$", "")


def descriptions(spark) -> DataFrame:
    """GRF-09."""
    return spark.createDataFrame([(k, *v) for k, v in DESCRIPTIONS.items()], "type string, description string, severity string")
