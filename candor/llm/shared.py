"""What the operators share: the shared folder, stored tables and packed arrays."""

from __future__ import annotations

import ctypes
import functools
import inspect
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from candor import checkpoints

BATCH_BYTES = 4 << 20
SCAN_ROWS = 512  # a scan holds so many texts, and twice that while its buffer grows
ROW_GROUP = 16 << 20  # of stored tables: a task holds one row group of what it writes
#: Folders that this driver made outside any scope() and hasn't deleted
MADE: list[str] = []
_SCOPE: ContextVar[list[str] | None] = ContextVar("candor_scope", default=None)


@contextmanager
def scope() -> Iterator[list[str]]:
    """Within it, shared folders are listed in the list it gives, so that runs side by side delete only their own."""
    token = _SCOPE.set(made := [])
    try:
        yield made
    finally:
        _SCOPE.reset(token)


def shared_dir(spark: SparkSession) -> str:
    """A new folder that driver and executors share."""
    made = _SCOPE.get()
    return checkpoints.folder(spark, MADE if made is None else made)


def clean(spark: SparkSession, made: list[str] = MADE, keep: int = 0) -> None:
    """Deletes the shared folders of the list but the last `keep`. What still reads them must be written first."""
    checkpoints.clean(spark, made, keep)


def lean(f: Callable) -> Callable:
    """f for a Python worker: once it has ended, the worker gives back the memory it no longer uses.
    Workers outlive their tasks, and Arrow's and C's allocators keep what was freed."""

    def give_back() -> None:
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
            trim(0)

    if inspect.isgeneratorfunction(f):

        @functools.wraps(f)
        def stream(*a, **k):
            try:
                yield from f(*a, **k)
            finally:
                give_back()

        return stream

    @functools.wraps(f)
    def once(*a, **k):
        try:
            return f(*a, **k)
        finally:
            give_back()

    return once


def small_batches(spark: SparkSession) -> None:
    """Lets Spark send Python at most BATCH_BYTES of rows at once, and read SCAN_ROWS of a Parquet file at once, so that
    memory doesn't follow the length of texts. Lower limits that the session has stay. Results are
    computed after an operator has returned, so the settings aren't taken back."""
    conf = spark._jsparkSession.sessionState().conf()
    now = int(conf.arrowMaxBytesPerBatch())
    if now <= 0 or now > BATCH_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    if int(conf.parquetVectorizedReaderBatchSize()) > SCAN_ROWS:
        spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", str(SCAN_ROWS))


def quoted(name: str) -> Column:
    """A column by its name, whatever characters that has."""
    return F.col("`" + name.replace("`", "``") + "`")


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as a table into the shared folder and read again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}"
    df.write.option("parquet.block.size", ROW_GROUP).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def settled(df: DataFrame) -> DataFrame:
    """df if it comes straight from files or literals, where a task that runs again finds its rows in the same order;
    otherwise written first. For operators that deal rows by their place."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return stored(df, "input") if "Exchange" in plan or "ExistingRDD" in plan or "Arrow" in plan or "Python" in plan else df


FEW_KEYS = 500_000


def small_side(keys: DataFrame) -> DataFrame:
    """A stored table of keys for the smaller side of a join: broadcast if it has at most FEW_KEYS rows, of some 50
    bytes each, so that the other side, which has texts, isn't shuffled; beyond that Spark picks the join."""
    return F.broadcast(keys) if keys.count() <= FEW_KEYS else keys


def pack(a: np.ndarray) -> bytes:
    """An array as bytes: byte planes, then Zstandard. unpack() needs its dtype."""
    if not len(a):
        return b""
    planes = np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(b: bytes | None, dtype) -> np.ndarray:
    if not b:
        return np.zeros(0, dtype)
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8)
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).reshape(-1).view(dtype)


def pack_sorted(a: np.ndarray) -> bytes:
    """Ascending unsigned integers as differences, in 2, 4 or 8 bytes each."""
    if not len(a):
        return b""
    d = np.diff(a, prepend=a[:1] * 0)
    kind = next(k for k in (np.uint16, np.uint32, np.uint64) if int(d.max()) <= np.iinfo(k).max)
    return bytes([np.dtype(kind).itemsize]) + pack(d.astype(kind))


def unpack_sorted(b: bytes | None) -> np.ndarray:
    if not b:
        return np.zeros(0, np.uint64)
    kind = {2: np.uint16, 4: np.uint32, 8: np.uint64}[b[0]]
    return np.cumsum(unpack(b[1:], kind).astype(np.uint64), dtype=np.uint64)


def member(x: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Which of x are in the sorted array `of`."""
    if not len(of):
        return np.zeros(len(x), bool)
    at = np.searchsorted(of, x)
    at[at == len(of)] = 0
    return of[at] == x


def first_of_runs(*keys: np.ndarray) -> np.ndarray:
    """Start indices of the runs of equal rows in arrays that are sorted together."""
    n = len(keys[0])
    if not n:
        return np.zeros(0, np.int64)
    new = np.ones(n, bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(new)


def slices_of_runs(*keys: np.ndarray) -> list[tuple[int, int]]:
    """Start and end of each run of equal rows in arrays that are sorted together."""
    at = first_of_runs(*keys).tolist()
    return list(zip(at, [*at[1:], len(keys[0])], strict=False))
