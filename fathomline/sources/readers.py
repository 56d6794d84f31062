"""Readers: files of telemetry, metadata and reports as DataFrames, with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SAMPLES = "entity string, feature string, bucket_ts long, value double"
#: Tasks that list folders.
LISTERS, _LISTED = 64, "spark.sql.sources.parallelPartitionDiscovery.parallelism"
ANOMALIES = "ts long, type string, entity string, attribute string, raw string"


def dense_tensor(spark: SparkSession, array, entities: list[str], features: list[str], start: int, size: int) -> DataFrame:
    """SRC-01, PRJ-02: a (entity, time, feature) array in the driver's memory as long rows."""
    import pandas as pd

    n, t, f = array.shape
    pdf = pd.DataFrame({
        "entity": [e for e in entities for _ in range(t * f)], "feature": features * (n * t),
        "bucket_ts": [start + size * i for _ in range(n) for i in range(t) for _ in range(f)], "value": array.reshape(-1).astype(float),
    })
    return spark.createDataFrame(pdf, SAMPLES)


def numpy_file(spark: SparkSession, path: str, **shape) -> DataFrame:
    """SRC-01/02: a .npy file, read by Spark so that any store will do; objects are not unpickled."""
    import io

    import numpy as np

    content = spark.read.format("binaryFile").load(path).select("content").first()["content"]
    return dense_tensor(spark, np.load(io.BytesIO(bytes(content)), allow_pickle=False), **shape)


def csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """SRC-03."""
    return spark.read.csv(path, header=True, schema=schema)


def matrix_text(spark: SparkSession, path: str) -> DataFrame:
    """SRC-04: files (or folders of one file) named machine-g-i, of comma-parted numbers, as machine, idx, values, all cut to the shortest.

    Rows are numbered by their place in the file. Machines sort by their numbers. Folders are listed by LISTERS tasks: a task for each,
    as Spark deals them, takes longer than the listing.
    """
    was = spark.conf.get(_LISTED)
    spark.conf.set(_LISTED, str(min(LISTERS, int(was))))
    try:
        text = spark.read.schema("value string").option("recursiveFileLookup", True).text(path, wholetext=True)
    finally:
        spark.conf.set(_LISTED, was)
    lines = text.withColumn("file", F.input_file_name())
    name = F.regexp_extract("file", r".*(machine-\d+-\d+)", 1)
    files = lines.select(name.alias("machine"), F.filter(F.split("value", "\n"), lambda x: F.length(F.trim(x)) > 0).alias("lines")).filter(F.size("lines") > 0)
    rows = files.select("machine", F.posexplode("lines").alias("idx", "line"))
    n = files.groupBy("machine").agg(F.sum(F.size("lines")).alias("n")).agg(F.min("n").alias("least"))
    out = rows.crossJoin(F.broadcast(n)).filter("idx < least")  # one row
    order = F.transform(F.regexp_extract_all("machine", F.lit(r"(\d+)"), F.lit(1)), lambda x: x.cast("int"))
    return out.select("machine", order.alias("order"), "idx", F.transform(F.split("line", ","), lambda x: F.trim(x).cast("double")).alias("values"))


def json_files(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """SRC-05/07: JSON documents, one a file, with the file each came from."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path).withColumn("file", F.input_file_name())


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """SRC-06: lines that aren't JSON are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def templates(spark: SparkSession, path: str) -> DataFrame:
    """Log templates: {language: [template, ...]} as template_id (counted over languages in order), lang, text."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,array<string>>").alias("m"))
    rows = raw.select(F.explode("m").alias("lang", "texts")).select("lang", F.posexplode("texts").alias("i", "text"))
    before = rows.groupBy("lang").agg(F.count("*").alias("n")).withColumn("first", F.coalesce(F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("lang").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row a language
    return rows.join(F.broadcast(before), "lang").select((F.col("first") + F.col("i")).cast("int").alias("template_id"), "lang", "text")


def kg_folder(spark: SparkSession, path: str) -> DataFrame:
    """SRC-07: nodes of all *_kg.json files below a folder."""
    schema = "cluster_id long, nodes array<struct<id:string,label:string,name:string>>, relationships array<struct<type:string,source:string,target:string,timestamp:bigint>>"
    return spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*_kg.json").json(path)


def union_of(sources: dict[str, DataFrame]) -> DataFrame:
    """SRC-09: sources of several kinds as one table of anomalies; columns that one lacks are null."""
    out = None
    for kind, df in sources.items():
        part = df.withColumn("type", F.lit(kind))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def parsed_report(spark: SparkSession, path: str) -> DataFrame:
    """SRC-10: cluster, entity and attribute of a report of `Cluster #n` sections with `Entity a | Attribute b` lines.

    Sections are Spark's records here, so a report of any length is read in splits. What stands before the first section isn't one, as it doesn't
    begin with a number.
    """
    parts = spark.read.text(path, lineSep="Cluster #").filter(F.col("value").rlike(r"^\d+"))
    pattern = F.lit(r"Entity\s+(\S+)\s*\|\s*Attribute\s+(\S+)")
    pairs = F.arrays_zip(F.regexp_extract_all("value", pattern, F.lit(1)).alias("entity"), F.regexp_extract_all("value", pattern, F.lit(2)).alias("attribute"))
    return parts.select(F.regexp_extract("value", r"^(\d+)", 1).cast("long").alias("cluster_id"), F.explode(pairs).alias("x")).select("cluster_id", "x.entity", "x.attribute")
