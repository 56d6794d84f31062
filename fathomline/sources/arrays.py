"""SRC-01/02: folders of .npy files, read and written by executors, a slice of rows at a time."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "file string, row bigint, values array<double>"
#: Rows of the first axis in a slice.
SLICE = 65536


def _local(path: str) -> str | None:
    """The mounted folder that a path names, or None for other stores."""
    found = re.match(r"^(?:file:)?(?://)?(/.*)$", path)
    return found[1] if found else None


class Slice(InputPartition):
    def __init__(self, file: str, lo: int, hi: int):
        self.file, self.lo, self.hi = file, lo, hi


def _batches(file: str, array: np.ndarray, lo: int) -> Iterator[pa.RecordBatch]:
    """Rows of the first axis, the other axes flattened, in batches."""
    for at in range(0, len(array), 4096):
        x = np.ascontiguousarray(array[at : at + 4096], dtype=np.float64).reshape(len(array[at : at + 4096]), -1)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
        yield pa.RecordBatch.from_arrays([pa.array([file] * len(x)), pa.array(np.arange(lo + at, lo + at + len(x))), lists], names=["file", "row", "values"])


class NpyReader(DataSourceReader):
    def __init__(self, path: str, rows: int):
        self.path, self.rows = path, rows

    def partitions(self) -> list[Slice]:
        files = [self.path] if os.path.isfile(self.path) else sorted(os.path.join(d, f) for d, _, names in os.walk(self.path) for f in names if f.endswith(".npy"))
        out = []
        for f in files:
            n = np.load(f, mmap_mode="r", allow_pickle=False).shape[0]  # the header alone is read here
            out += [Slice(f, lo, min(n, lo + self.rows)) for lo in range(0, n, self.rows)]
        return out

    def read(self, partition: Slice) -> Iterator[pa.RecordBatch]:
        array = np.load(partition.file, mmap_mode="r", allow_pickle=False)
        yield from _batches(os.path.basename(partition.file), array[partition.lo : partition.hi], partition.lo)


class NpySource(DataSource):
    """spark.read.format("npy").option("rows", ...).load(folder): file, row, values; an array of more axes has the others flattened."""

    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> NpyReader:
        return NpyReader(_local(self.options["path"]) or self.options["path"], int(self.options.get("rows", SLICE)))


def read_arrays(spark: SparkSession, path: str, rows: int = SLICE) -> DataFrame:
    """file, row, values of a folder of .npy files; objects are not unpickled.

    In a mounted folder a task reads a slice of a file; of another store, which only Spark reads, it takes a whole file.
    """
    if _local(path):
        spark.dataSource.register(NpySource)
        return spark.read.format("npy").option("rows", rows).load(path)

    def run(batches: Iterator[pa.RecordBatch]):
        import io

        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                yield from _batches(os.path.basename(name), np.load(io.BytesIO(content), allow_pickle=False), 0)

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").option("recursiveFileLookup", True).load(path).select("path", "content").mapInArrow(run, SCHEMA)


def write_arrays(df: DataFrame, path: str, name: str, order: str, values: str, rows: int = SLICE) -> DataFrame:
    """SNK-01: a file for each name and each `rows` values of order (an index from 0): <name>-<part>.npy; returns file, rows written.

    path: a mounted folder that all executors share. A part is one task's; arrays of one part must be of one length.
    """
    folder = _local(path)
    if not folder:
        raise ValueError(f"{path} is not a mounted folder")
    parts = df.select(F.col(name).cast("string").alias("name"), F.floor(F.col(order) / rows).alias("part"), F.col(order).cast("long").alias("idx"), F.col(values).cast("array<double>").alias("x"))

    def run(key, table):
        table = table.sort_by("idx")
        x = table.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, -1)
        file = f"{re.sub(r'[^A-Za-z0-9_.-]', '_', key[0].as_py())}-{key[1].as_py():06d}.npy"
        os.makedirs(folder, exist_ok=True)
        scratch = os.path.join(folder, f".{file}.{os.getpid()}")  # a task that runs twice leaves one whole file
        with open(scratch, "wb") as out:
            np.save(out, x)
        os.replace(scratch, os.path.join(folder, file))
        return pa.table({"file": [file], "rows": pa.array([table.num_rows], pa.int64())})

    return parts.groupBy("name", "part").applyInArrow(run, "file string, rows bigint")
