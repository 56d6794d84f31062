"""Helpers shared by the corpus operators: shared storage, Arrow access, hashing of whole batches."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step holds; a longer single text is one step of its own.
STEP_BYTES = 1 << 19
#: Rows in an Arrow batch at most: whole texts pass to Python workers, so a batch should hold few.
BATCH_ROWS = 1000

U64 = np.uint64
_MUL1, _MUL2 = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; a temporary one only where that is unset (tests)."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        where = getattr(shared_dir, "own", None) or tempfile.mkdtemp(prefix="fathomline-")
        shared_dir.own = where
    return where


def stored(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: writes df as a table in the shared folder and returns it reread."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/fathomline/{uuid.uuid4().hex}/{name}"
    settle(spark)
    df.write.options(**(_LOCAL if path.startswith(("file:", "/")) else {})).option("compression", "zstd").parquet(path)
    _STORED.append(path)
    return spark.read.schema(df.schema).parquet(path)


_STORED: list[str] = []
#: Where the shared folder is a mounted one, Hadoop starts processes for each file and its checksum, to set their permissions.
_LOCAL = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}
#: Small shuffles end in few tasks, and so in few files; large ones are dealt as the session says.
_FEW = {"spark.sql.adaptive.coalescePartitions.parallelismFirst": "false", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m"}


def settle(spark: SparkSession) -> None:
    """Sets what a session left unset."""
    if spark.conf.get("spark.sql.adaptive.coalescePartitions.parallelismFirst") == "true":
        for key, value in _FEW.items():
            spark.conf.set(key, value)


def forget(spark: SparkSession) -> int:
    """Deletes the tables that this process has stored so far, once the results that read them are written; how many."""
    n = 0
    while _STORED:
        path = spark._jvm.org.apache.hadoop.fs.Path(_STORED.pop())
        n += bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True))
    return n


def small_batches(spark: SparkSession) -> None:
    """Keeps a session's Arrow batches to BATCH_ROWS, so that a worker's memory doesn't depend on how long texts are on average."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def _libc():
    try:
        return ctypes.CDLL("libc.so.6")
    except OSError:  # another C library
        return None


def trimmed(run: Callable) -> Callable:
    """A function of batches that gives memory back to the system as a task ends, since workers live on between tasks."""

    @functools.wraps(run, assigned=("__doc__",), updated=())
    def out(rows):
        try:
            yield from run(rows)
        finally:
            give_back()

    return out


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    libc = _libc()
    if libc is not None:
        libc.malloc_trim(0)


def spare(run: Callable) -> Callable:
    """A function of a group that first gives back what the group before left."""

    def out(key, table):
        give_back()
        return run(key, table)

    return out


def spare2(run: Callable) -> Callable:
    """The same for a group of two tables."""

    def out(key, left, right):
        give_back()
        return run(key, left, right)

    return out


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def placed(docs: DataFrame, *columns: str) -> DataFrame:
    """Some columns of the rows, and __place: which row of which file each is, so that equal rows can be told apart.

    Rows that aren't read from Parquet files are stored and numbered.
    """
    kept = [F.col(f"`{c}`") for c in columns]
    try:
        return docs.select(*kept, F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")).alias("__place"))
    except AnalysisException:
        number = F.struct(F.lit(0).cast("long").alias("file"), F.monotonically_increasing_id().alias("row"))
        return stored(docs.select(*kept, number.alias("__place")), "placed")


PLACE = "struct<file:bigint,row:bigint>"


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> U64(30))
    x *= _MUL1
    x ^= x >> U64(27)
    x *= _MUL2
    x ^= x >> U64(31)
    return x


def seeds(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit constants."""
    return mix(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed)) | U64(1)


def texts_of(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, where, data = column.buffers()
    at = np.frombuffer(where, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def steps(at: np.ndarray, limit: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most limit bytes together (one row at least)."""
    lo, n = 0, len(at) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + limit, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


class Rolling:
    """Polynomial hashes of any byte ranges of a buffer, from one prefix sum: equal ranges get equal hashes."""

    def __init__(self, seed: int):
        self.table = mix(seeds(256, seed))
        self.base = int(seeds(1, seed + 77)[0]) | 5
        self.inverse = pow(self.base, -1, 1 << 64)
        self.up = self.down = np.ones(1, U64)

    def prefix(self, raw: np.ndarray) -> np.ndarray:
        n = len(raw) + 1
        if len(self.up) < n:
            m = max(n, 2 * len(self.up))
            grow = lambda b: np.multiply.accumulate(np.concatenate([np.ones(1, U64), np.full(m - 1, b, U64)]))
            self.up, self.down = grow(self.base), grow(self.inverse)
        out = np.zeros(n, U64)
        np.cumsum(self.table[raw] * self.down[: n - 1], out=out[1:])
        return out

    def ranges(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (prefix[end] - prefix[start]) * self.up[start]

    def grams(self, prefix: np.ndarray, k: int) -> np.ndarray:
        """Of all k-byte strings of the buffer."""
        n = len(prefix) - k
        return (prefix[k:] - prefix[:n]) * self.up[:n] if n > 0 else np.zeros(0, U64)


#: True for the bytes that part words: space and tab to carriage return.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

#: A-Z to a-z, other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def words_of(raw: np.ndarray, at: np.ndarray, parts: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words of the texts at[0], at[1], ..., and each word's text; parts: bytes outside words."""
    n = len(raw)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    inside = ~parts[raw]
    first = np.zeros(n + 1, bool)
    first[at[:-1]] = True
    first[n] = True
    before = np.empty(n, bool)
    before[0] = True
    before[1:] = ~inside[:-1]
    start = np.flatnonzero(inside & (before | first[:n]))
    after = np.empty(n, bool)
    after[-1] = True
    after[:-1] = ~inside[1:]
    end = np.flatnonzero(inside & (after | first[1:])) + 1
    return start, end, np.searchsorted(at, start, "right") - 1
