"""Detectors by name: fit(series) -> model table, score(series, model) -> scores.

Built in are statistical scorers that stay in the plan; they are not equivalent to learned ones and claim no parity with them.
A learned scorer plugs in by register_detector, as a grouped map.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEYS = ["entity", "feature"]


class Detector(Protocol):
    def fit(self, series: DataFrame) -> DataFrame | None: ...

    def score(self, series: DataFrame, model: DataFrame | None) -> DataFrame: ...


def _w(width: int):
    return Window.partitionBy(*KEYS).orderBy("bucket_ts").rowsBetween(-width, -1)


class RollingMean:
    """Squared distance from the mean of the rows before (stand-in for reconstruction)."""

    def __init__(self, width: int = 12):
        self.width = width

    def fit(self, series):
        return None

    def score(self, series, model=None):
        m = F.avg("value").over(_w(self.width))
        return series.withColumn("score", F.coalesce((F.col("value") - m) * (F.col("value") - m), F.lit(0.0)))


class RollingGaussian(RollingMean):
    """Negative log likelihood under the mean and deviation (least at least) of the rows before, if there are LEAST of them, else 0."""

    LEAST = 4

    def __init__(self, width: int = 12, least: float = 1e-3):
        super().__init__(width)
        self.least = least

    def score(self, series, model=None):
        w = _w(self.width)
        m, s = F.avg("value").over(w), F.greatest(F.stddev_pop("value").over(w), F.lit(self.least))
        z = (F.col("value") - m) / s
        return series.withColumn("score", F.when(F.count("*").over(w) >= self.LEAST, 0.5 * z * z + F.log(s) + 0.9189385332046727).otherwise(0.0))


class SeasonalNaive:
    """Squared difference from the value one season ago (stand-in for a forecast)."""

    def __init__(self, lag: int = 4):
        self.lag = lag

    def fit(self, series):
        return None

    def score(self, series, model=None):
        before = F.lag("value", self.lag).over(Window.partitionBy(*KEYS).orderBy("bucket_ts"))
        return series.withColumn("score", F.coalesce((F.col("value") - before) * (F.col("value") - before), F.lit(0.0)))


class StaticGaussian:
    """Negative log likelihood under the training mean and deviation of each series."""

    def fit(self, series):
        return series.groupBy(*KEYS).agg(F.avg("value").alias("m"), F.greatest(F.stddev_pop("value"), F.lit(1e-3)).alias("s"))

    def score(self, series, model):
        z = (F.col("value") - F.col("m")) / F.col("s")
        return series.join(model, KEYS).withColumn("score", 0.5 * z * z + F.log("s") + 0.9189385332046727).drop("m", "s")


class PcaReconstruction:
    """Squared error of each feature after projection on the first components of the entity-time feature vectors."""

    def __init__(self, features: list[str], k: int = 2):
        self.features, self.k = features, k

    def _wide(self, series):
        from pyspark.ml.functions import array_to_vector

        wide = series.groupBy("entity", "bucket_ts").pivot("feature", self.features).agg(F.first("value"))
        return wide.select("entity", "bucket_ts", array_to_vector(F.array(*[F.coalesce(f, F.lit(0.0)) for f in self.features])).alias("v"), *self.features)

    def fit(self, series):
        from pyspark.ml.feature import PCA

        wide = self._wide(series)
        self.means = wide.agg(*[F.avg(F.coalesce(f, F.lit(0.0))).alias(f) for f in self.features]).first()
        self.components = PCA(k=self.k, inputCol="v", outputCol="p").fit(wide).pc.toArray()
        return None

    def score(self, series, model=None):
        wide = self._wide(series)
        x = [F.coalesce(F.col(f), F.lit(0.0)) - float(self.means[f]) for f in self.features]
        p = [sum((x[i] * float(self.components[i][j]) for i in range(1, len(x))), x[0] * float(self.components[0][j])) for j in range(self.k)]
        back = [sum((p[j] * float(self.components[i][j]) for j in range(1, self.k)), p[0] * float(self.components[i][0])) for i in range(len(x))]
        parts = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("value"), F.pow(x[i] - back[i], F.lit(2.0)).alias("score")) for i, f in enumerate(self.features)])
        return wide.select("entity", "bucket_ts", F.explode(parts).alias("x")).select("entity", "x.feature", "bucket_ts", "x.value", "x.score").filter("value is not null")


DETECTORS: dict[str, Callable[..., Detector]] = {"rolling_mean": RollingMean, "rolling_gaussian": RollingGaussian, "seasonal_naive": SeasonalNaive, "static_gaussian": StaticGaussian, "pca": PcaReconstruction}


def register_detector(name: str, make: Callable[..., Detector]) -> None:
    """EXT-01."""
    DETECTORS[name] = make


def detector(name: str, **settings) -> Detector:
    return DETECTORS[name](**settings)


def fit_by_cluster(series: DataFrame, clusters: DataFrame) -> DataFrame:
    """DET-15: a model for each cluster, from the series of its centre. clusters: entity, cluster, center."""
    centre = clusters.filter(F.col("entity") == F.col("center")).select("entity", "cluster")
    rows = series.join(centre, "entity")
    return rows.groupBy("cluster", "feature").agg(F.avg("value").alias("m"), F.greatest(F.stddev_pop("value"), F.lit(1e-3)).alias("s"), F.count("*").alias("n"))


def score_by_cluster(series: DataFrame, clusters: DataFrame, models: DataFrame, mode: str = "center") -> DataFrame:
    """DET-15: scores by the cluster's model as it is (center), or moved to the entity's own mean, its deviation kept (tuned)."""
    rows = series.join(clusters.select("entity", "cluster"), "entity").join(models, ["cluster", "feature"])
    m = F.avg("value").over(Window.partitionBy(*KEYS)) if mode == "tuned" else F.col("m")
    z = (F.col("value") - m) / F.col("s")
    return rows.withColumn("score", z * z).select(*KEYS, "bucket_ts", "score")


def better_models(models: DataFrame, by: str = "loss") -> DataFrame:
    """DET-19: of each cluster and feature the checkpoint with the least validation loss, the first of equals."""
    rest = [c for c in models.columns if c not in ("cluster", "feature")]
    return models.groupBy("cluster", "feature").agg(F.min_by(F.struct(*rest), F.struct(by, "step")).alias("x")).select("cluster", "feature", "x.*")
