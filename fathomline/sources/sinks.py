"""Reports and exports: text made by the plan, written by Spark's writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import cypher_text, local_text


def report_lines(anomalies: DataFrame) -> DataFrame:
    """SNK-02: entity, attribute, and the local times of their anomalies in order."""
    g = anomalies.groupBy("entity", "attribute").agg(F.array_sort(F.collect_list("ts")).alias("t"))
    return g.withColumn("line", F.array_join(F.transform("t", local_text), "; "))


def cypher_nodes(nodes: DataFrame) -> DataFrame:
    """SNK-06."""
    line = F.concat(F.lit("MERGE (:"), "label", F.lit(" {id: '"), cypher_text(F.col("id")), F.lit("', name: '"), cypher_text(F.col("name")), F.lit("'});"))
    return nodes.select("cluster_id", line.alias("line"))


def cypher_edges(edges: DataFrame) -> DataFrame:
    """SNK-06."""
    line = F.concat(F.lit("MATCH (a {id: '"), cypher_text(F.col("src")), F.lit("'}), (b {id: '"), cypher_text(F.col("dst")), F.lit("'}) MERGE (a)-[:"), "type", F.lit("]->(b);"))
    return edges.select("cluster_id", line.alias("line"))


def kg_json(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """SNK-04: cluster_id, value: one JSON document a cluster."""
    n = nodes.groupBy("cluster_id").agg(F.array_sort(F.collect_list(F.struct("id", "label", "name"))).alias("nodes"))
    e = edges.groupBy("cluster_id").agg(F.array_sort(F.collect_list(F.struct("type", F.col("src").alias("source"), F.col("dst").alias("target"), F.col("ts").alias("timestamp")))).alias("relationships"))
    return n.join(e, "cluster_id", "left").select("cluster_id", F.to_json(F.struct("cluster_id", "nodes", "relationships")).alias("value"))


def _xml(col):
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        col = F.replace(col, F.lit(raw), F.lit(safe))
    return col


def gexf(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """SNK-05: cluster_id, value: a GEXF document a cluster."""
    n = nodes.select("cluster_id", F.concat(F.lit('<node id="'), _xml(F.col("id")), F.lit('" label="'), _xml(F.col("name")), F.lit('"/>')).alias("x")).groupBy("cluster_id").agg(F.array_join(F.array_sort(F.collect_list("x")), "").alias("n"))
    e = edges.select("cluster_id", F.concat(F.lit('<edge source="'), _xml(F.col("src")), F.lit('" target="'), _xml(F.col("dst")), F.lit('" label="'), "type", F.lit('"/>')).alias("x")).groupBy("cluster_id").agg(F.array_join(F.array_sort(F.collect_list("x")), "").alias("e"))
    head = '<?xml version="1.0" encoding="UTF-8"?><gexf xmlns="http://gexf.net/1.3" version="1.3"><graph defaultedgetype="directed"><nodes>'
    return n.join(e, "cluster_id", "left").select("cluster_id", F.concat(F.lit(head), "n", F.lit("</nodes><edges>"), F.coalesce("e", F.lit("")), F.lit("</edges></graph></gexf>")).alias("value"))


def mermaid(edges: DataFrame) -> DataFrame:
    """SNK-07: cluster_id, body of a Mermaid graph of entities."""
    one = F.struct("src", "dst", F.concat(F.lit("  "), F.expr("substr(src, 8)"), F.lit(" --> "), F.expr("substr(dst, 8)")).alias("line"))
    return edges.groupBy("cluster_id").agg(F.array_join(F.array_sort(F.collect_list(one))["line"], "\n").alias("body"))


def multi_grain(anomalies: DataFrame, grains: list[int], before: int = 0, after: int = 0) -> DataFrame:
    """SNK-11: cluster_id, grain, type, bucket_ts, n: what a report of each cluster shows at several grains, from `before` seconds before its first to `after` seconds after its last anomaly.

    All clusters and grains in one plan; anomalies of other clusters within the span count too. anomalies: ts, type, cluster_id (-1: none).
    The join with spans is on cells of the widest span, so it is no nested loop.
    """
    spans = anomalies.filter("cluster_id >= 0").groupBy("cluster_id").agg((F.min("ts") - before).alias("lo"), (F.max("ts") + after).alias("hi"))
    cell = 86400
    cells = spans.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") / cell), F.floor(F.col("hi") / cell))))
    near = anomalies.select("ts", "type", F.floor(F.col("ts") / cell).alias("cell")).join(cells, "cell").filter("ts BETWEEN lo AND hi")
    each = near.select("cluster_id", "type", "ts", F.explode(F.array(*[F.lit(x) for x in grains])).alias("grain"))
    return each.groupBy("cluster_id", "grain", "type", (F.floor(F.col("ts") / F.col("grain")) * F.col("grain")).alias("bucket_ts")).agg(F.count("*").alias("n"))


def prompt(features: DataFrame) -> DataFrame:
    """EXT-08: what a cluster's graph says, as text for a language model."""
    one = F.struct((-F.col("anomalies")).alias("k"), "id", F.concat(F.lit("- "), "id", F.lit(": "), "anomalies", F.lit(" anomalies, first "), "first_ts").alias("line"))
    return features.groupBy("cluster_id").agg(F.array_join(F.array_sort(F.collect_list(one))["line"], "\n").alias("prompt"))


#: Folders by key may be as many as rows: no checksum goes with each file of a local or mounted folder, for which Hadoop would start another process.
_PLAIN = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}


def write_text(df: DataFrame, path: str, value: str = "value", by: list[str] | None = None) -> None:
    """SNK-02/04/05/06/07: one line of text a row, in folders by key."""
    writer = df.select(*(by or []), F.col(value).alias("value")).write.mode("overwrite")
    if by:
        writer = writer.options(**(_PLAIN if path.startswith(("file:", "/")) else {})).partitionBy(*by)
    writer.text(path)


def write_store(df: DataFrame, path: str, by: list[str]) -> None:
    """SNK-01, SRC-08: Parquet in folders, so that a query reads only those it names."""
    df.repartition(*by).write.mode("overwrite").partitionBy(*by).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """SNK-08."""
    df.write.mode("overwrite").option("header", True).csv(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    """SNK-09/10."""
    df.write.mode("overwrite").json(path)


def query_anomalies(spark: SparkSession, store: str, start: int, end: int, grain: str = "1min", categories: list[str] | None = None) -> DataFrame:
    """SRC-08: anomalies of a store partitioned by grain, date and category; a range may cross midnight.

    The dates that the range touches are named, so only their folders are read.
    """
    day = lambda ts: F.date_format(F.timestamp_seconds(F.lit(ts)), "yyyy-MM-dd")
    df = spark.read.parquet(store).filter((F.col("grain") == grain) & F.col("date").cast("string").between(day(start), day(end)) & F.col("ts").between(start, end))
    return df.filter(F.col("category").isin(categories)) if categories else df
