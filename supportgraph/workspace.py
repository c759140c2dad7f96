"""Intermediate tables in the cluster's shared folder."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cache

from pyspark.sql import DataFrame, SparkSession

#: Settings of ``lean_writes``.
LEAN = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.parquet.compression.codec": "zstd"}

# Folders written inside ``removed_afterwards``, for the thread that writes them.
_folders = threading.local()


@cache
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="supportgraph-")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, else the context's checkpoint folder.

    Only a local session without either gets a temporary folder, one per process: executors on
    other machines could not read it. The session's own settings stay as they are.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    return _local_folder()


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no earlier run has used."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder at ``path``, in whatever store it lies."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies in a folder."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = target.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(target)
    return [status.getPath().getName() for status in found]


@contextmanager
def removed_afterwards(spark: SparkSession) -> Iterator[None]:
    """Delete what ``materialize`` writes inside the block once it ends well. What the block
    returns must not read it any more. After an error the folders stay, for their retention rule."""
    outer, _folders.paths = getattr(_folders, "paths", None), []
    try:
        yield
        for path in _folders.paths:
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    finally:
        _folders.paths = outer


@contextmanager
def lean_writes(spark: SparkSession) -> Iterator[None]:
    """Inside the block a job deletes what it shuffled when it ends, not when the driver next collects
    garbage, and tables are written in a closer code. Settings of the session's own are left alone."""
    wanted = {k: v for k, v in LEAN.items() if spark.conf.get(k, None) is None}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key in wanted:
            spark.conf.unset(key)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The copy cuts the lineage and outlives lost executors, so costly steps that feed several
    joins run once. Its size is known from the files, which is what Spark's own broadcast
    threshold checks: a small result is broadcast, a large one is shuffled, without a hint.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    if getattr(_folders, "paths", None) is not None:
        _folders.paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


def spread_small(table: DataFrame, key: str) -> DataFrame:
    """Deal the rows of a stored table out to all cores when its scan has fewer parts than that.

    Meant for costly work per row on a table of few files, with a key of mostly different values.
    A table that fills the cluster by itself is returned as it is: nothing large is shuffled.
    """
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table.repartition(cores, key) if table.rdd.getNumPartitions() < cores else table
