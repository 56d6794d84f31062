"""Registered queries, each with its oracle where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _load() -> None:
    from . import q_detect, q_graph, q_io, q_learn, q_models, q_periods, q_relational, q_series, q_text  # noqa: F401


def queries() -> dict:
    from .registry import QUERIES

    _load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    from .registry import ORACLES

    _load()
    return dict(ORACLES)


def flagship(spark: SparkSession, sf_dir: str, eps: int = 21600) -> DataFrame:
    """Events to anomalies, clusters in time, and ranked root causes of every cluster, in one plan."""
    from pyspark.sql import functions as F

    from ..operators import cluster, rca
    from .registry import Tables

    t = Tables(spark, sf_dir)
    incidents = cluster.dbscan_ranges(t.anomalies, eps, 3).filter("cluster_id >= 0")
    ranked = rca.root_causes(incidents, t.topology, rca.RcaConfig(window_seconds=4 * eps))
    return ranked.filter("rank = 1").select("cluster_id", "entity", "fault", "total", "earliest_ts", F.round("final_score", 6).alias("final_score"))
