"""The folder that driver and executors share for intermediate tables, and file-system calls on the driver."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

ARROW = "spark.sql.execution.arrow."
_SCOPE: ContextVar[str | None] = ContextVar("scope", default=None)


def shared_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset, a local master gets a temporary folder; on a cluster there is no folder to guess."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="moraine-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def shared_dir(spark: SparkSession) -> str:
    """This application's part of the shared folder."""
    return f"{shared_root(spark)}/moraine-{spark.sparkContext.applicationId}"


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{_SCOPE.get() or shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """All tables that operators write inside go when it ends: write what is to stay to a path from outside."""
    path = fresh_path(spark, "scope")
    token = _SCOPE.set(path)
    try:
        yield
    finally:
        _SCOPE.reset(token)
        delete(spark, path)


def materialize(df: DataFrame, label: str, scratch: Scratch | None = None) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: cuts the lineage, survives lost executors.

    With a scratch the table is removed with it.
    """
    spark, path = df.sparkSession, fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    if scratch is not None:
        scratch.paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables that are of no use once an operator has written what its result is read from."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def drop(self, keep: int = 0) -> None:
        """Remove all but the last `keep` tables."""
        cut = len(self.paths) - keep
        for path in self.paths[:cut]:
            delete(self.spark, path)
        self.paths = self.paths[cut:]


def bounded_batches(spark: SparkSession, rows: int = 500, size: int = 32 << 20) -> SparkSession:
    """Arrow batches of at most so many rows and about so many bytes in this session: whole texts stay small in a Python worker."""
    had = int(spark.conf.get(f"{ARROW}maxRecordsPerBatch"))
    spark.conf.set(f"{ARROW}maxRecordsPerBatch", str(min(had, rows) if had > 0 else rows))
    spark.conf.set(f"{ARROW}maxBytesPerBatch", str(size))
    return spark


def hadoop_fs(spark: SparkSession, path: str):
    """(file system, Hadoop path) of a path, on the driver."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = hadoop_fs(spark, path)
    return fs.exists(p)


def delete(spark: SparkSession, path: str) -> None:
    fs, p = hadoop_fs(spark, path)
    fs.delete(p, True)


def cleanup(spark: SparkSession) -> None:
    """Remove everything that this application's operators wrote to the shared folder."""
    delete(spark, shared_dir(spark))
