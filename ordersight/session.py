"""Session-level settings shared by the operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

MAX_TASKS = 16_384
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
WRITTEN: ContextVar[list[DataFrame] | None] = ContextVar("written", default=None)  # by ``cut``, for the open ``only_result`` of this thread
TEXT_ROWS = 1000  # whole texts in an Arrow batch, which the JVM and Python hold outside the heap


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: the cluster's checkpoint folder.

    Only a local session without that setting gets a folder of its own; a cluster
    session without it is an error, because executors do not share local disks.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if spark.sparkContext.master.startswith("local"):
        folder = tempfile.mkdtemp(prefix="ordersight-")
        spark.sparkContext.setCheckpointDir(folder)
        return spark.sparkContext.getCheckpointDir().rstrip("/")
    raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")


def fresh_dir(spark: SparkSession, label: str) -> str:
    """A new, unused path below the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


@contextmanager
def text_batches(spark: SparkSession, most: int = TEXT_ROWS) -> Iterator[None]:
    """What runs inside hands texts to Python in batches of at most ``most`` rows."""
    before = spark.conf.get(ARROW_ROWS)
    rows = int(before)
    spark.conf.set(ARROW_ROWS, str(min(rows, most) if rows > 0 else most))
    try:
        yield
    finally:
        spark.conf.set(ARROW_ROWS, before)


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage through a written table in the shared folder.

    The shuffle files of the write go as soon as the table stands: nothing reads them any more.
    """
    spark = df.sparkSession
    path, before = fresh_dir(spark, "cut"), spark.conf.get(SHUFFLE_CLEANUP)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)
    written = spark.read.parquet(path)
    if (tables := WRITTEN.get()) is not None:
        tables.append(written)
    return written


def release(df: DataFrame) -> None:
    """Delete the folder of a table that was written by ``cut``; nothing may read it any more."""
    files = df.inputFiles()
    if not files:
        return
    spark = df.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def only_result(build: Callable[[], DataFrame]) -> DataFrame:
    """The table that ``build`` returns, written by ``cut``; the tables written on the way to it are deleted."""
    outer, tables = WRITTEN.get(), []
    opened = WRITTEN.set(tables)
    try:
        result = build()
    finally:
        WRITTEN.reset(opened)
    for table in tables:
        if table is not result:
            release(table)
    if outer is not None:
        outer.append(result)
    return result


def cut_for_passes(df: DataFrame) -> DataFrame:
    """``cut`` for a table read many times by CPU-heavy tasks: a small one gets a file per core."""
    written = cut(df)
    cores = df.sparkSession.sparkContext.defaultParallelism
    if written.rdd.getNumPartitions() >= cores:
        return written
    return cut(written.repartition(cores))


def in_groups(df: DataFrame, *keys: str, groups: int | None = None) -> DataFrame:
    """Shuffle by ``keys`` into a fixed number of tasks.

    Adaptive execution merges small shuffle partitions by bytes, which would run groups that are
    small but expensive one after the other; an explicit width is left alone.
    """
    width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(min(groups, max(width, MAX_TASKS)) if groups else width, *keys)
