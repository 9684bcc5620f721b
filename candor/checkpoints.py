"""Tables in the folder that driver and executors share: they cut lineage and survive lost executors."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Folders that this driver made and hasn't deleted
MADE: list[str] = []
#: Names of tables in buckets, by folder
BUCKETED: dict[str, str] = {}
_SCOPE: ContextVar[list[str] | None] = ContextVar("candor_tables", default=None)


@contextmanager
def scope() -> Iterator[list[str]]:
    """Within it, folders are noted in the list it gives, so that runs side by side delete only their own."""
    token = _SCOPE.set(made := [])
    try:
        yield made
    finally:
        _SCOPE.reset(token)


def _noted() -> list[str]:
    return MADE if _SCOPE.get() is None else _SCOPE.get()


def folder(spark: SparkSession, made: list[str] | None = None) -> str:
    """A new folder below spark.checkpoint.dir, noted in `made`, by default the scope's list or MADE. Where that is unset, a local master gets a temporary folder;
    on a cluster that is an error, as executors don't see the driver's disk."""
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if root is None:
        if not (context.master == "local" or context.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="candor-"))
        root = context.getCheckpointDir()
    made = _noted() if made is None else made
    made.append(f"{root.rstrip('/')}/candor-{uuid.uuid4().hex}")
    return made[-1]


def cut(df: DataFrame, made: list[str] | None = None) -> DataFrame:
    """df written as a table and read again. Unlike a checkpoint the table has sizes, by which the next join is planned."""
    path = folder(df.sparkSession, made)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, by: list[str], then: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
    """As cut(), in as many buckets by the columns as there are shuffle partitions: joins and groups by these leave the table where it is. `then`
    is done to what is dealt, before it is written."""
    spark, path = df.sparkSession, folder(df.sparkSession)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = path.rsplit("/", 1)[1].replace("-", "_")
    then(df.repartition(n, *by)).write.bucketBy(n, *by).sortBy(*by).option("path", path).format("parquet").saveAsTable(name)
    BUCKETED[path] = name
    return spark.table(name)


def clean(spark: SparkSession, made: list[str] = MADE, keep: int = 0) -> None:
    """Deletes the folders of the list but the last `keep`; what still reads them must be written first."""
    context = spark.sparkContext
    for path in made[: len(made) - keep]:
        if path in BUCKETED:
            spark.sql(f"DROP TABLE IF EXISTS {BUCKETED.pop(path)}")  # its files stay with it no longer than the folder
        at = context._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)
        made.remove(path)


class Loop:
    """Tables of a loop's turns: turn() deletes those of the turn before, which the present ones no longer read. close() notes
    the last ones as any others."""

    def __init__(self, spark: SparkSession):
        self.spark, self.now, self.old = spark, [], []

    def cut(self, df: DataFrame) -> DataFrame:
        return cut(df, self.now)

    def turn(self) -> None:
        clean(self.spark, self.old)
        self.old, self.now = self.now, []

    def close(self) -> None:
        _noted().extend(self.old + self.now)
