"""Tables that cut a plan's lineage, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_STORED: list[str] = []
_OWN: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset, a temporary folder in local mode (tests); on a cluster an error."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if where:
        return where.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix="fathomline-"))
    return _OWN[0]


def written(df: DataFrame, name: str) -> str:
    """The path of a new table with df's rows, in the shared folder."""
    path = f"{shared_folder(df.sparkSession)}/fathomline/{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    _STORED.append(path)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read again."""
    return df.sparkSession.read.schema(df.schema).parquet(written(df, name))


def forget(spark: SparkSession, keep: int = 0) -> int:
    """Deletes the stored tables but for the first `keep`, once nothing reads them any more; how many."""
    n = 0
    while len(_STORED) > keep:
        path = spark._jvm.org.apache.hadoop.fs.Path(_STORED.pop())
        n += bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True))
    return n


def held() -> int:
    """How many tables are stored now, for `forget`."""
    return len(_STORED)
