"""Where a job may keep intermediate tables, and how it writes them."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``, else the session's warehouse folder.

    Both are on a file system that every executor reaches; no machine-local temporary folder is used.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return (named or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")


def job_scratch(spark: SparkSession) -> str:
    """The one folder that holds all intermediate tables of this application."""
    return f"{scratch_root(spark)}/seqloom/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{job_scratch(spark)}/{label}-{uuid.uuid4().hex}"


def drop_scratch(spark: SparkSession, path: str | None = None) -> None:
    """Remove one intermediate table, or all of this application's. Results must be written by then."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path or job_scratch(spark))
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def spread(scan: DataFrame) -> DataFrame:
    """Deal the rows of a table scan with fewer splits than cores to all cores.

    For costly work per row on a small input. A large input has more splits and stays as it is.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as a Parquet table and read it back.

    Used where two passes must see the same rows in the same places (range partition bounds are
    sampled, so a recomputation could move rows). The written table outlives lost executors.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    for paths in _passing.get():
        paths.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# What ``materialize`` has written within each open ``passing_tables``.
_passing: ContextVar[tuple[list[str], ...]] = ContextVar("passing", default=())


@contextmanager
def passing_tables(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Remove at the end the tables that ``materialize`` wrote meanwhile, but those written by the function given.

    What is returned from within must read none of the others.
    """
    paths: list[str] = []

    def kept(df: DataFrame, label: str) -> DataFrame:
        table = materialize(df, label)
        paths.pop()
        return table

    token = _passing.set((*_passing.get(), paths))
    try:
        yield kept
    finally:
        _passing.reset(token)
        for path in paths:
            drop_scratch(spark, path)


def discard(table: DataFrame) -> None:
    """Remove a table that ``materialize`` wrote, once nothing reads it any more."""
    drop_scratch(table.sparkSession, table.inputFiles()[0].rpartition("/")[0])
