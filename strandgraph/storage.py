"""Intermediate results in the folder that driver and executors share."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: The folder that holds the package; on a cluster the package is installed, or given by --py-files.
ROOT = str(Path(__file__).resolve().parents[1])


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder where it is unset and Spark runs on this machine alone, else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="strandgraph-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def importable(spark: SparkSession) -> None:
    """Lets Python workers import this package."""
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, (env.get("PYTHONPATH"), ROOT)))


#: Folders that this process has written outside of scratch(), and the list that new ones go to.
_written: list[str] = []
_list: ContextVar[list[str]] = ContextVar("folders", default=_written)


def fresh(spark: SparkSession, name: str) -> str:
    """A new folder's path within the shared folder; what is written there stays until clear(), or the end of scratch()."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _list.get().append(path)
    return path


def materialize(df: DataFrame, name: str, options: dict[str, str] | None = None) -> DataFrame:
    """df written and read again: cuts the plan, computes shared parts once, and survives the loss of executors.

    What is written stays until clear(): the DataFrames that are returned read it.
    """
    path = fresh(df.sparkSession, name)
    df.write.options(**options or {}).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> int:
    """Removes all that materialize() has written in this process, once no result is read any more; the number of folders."""
    return _remove(spark, _written)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Removes at its end what materialize() has written within: for work whose results lie elsewhere by then."""
    folders: list[str] = []
    before = _list.set(folders)
    try:
        yield
    finally:
        _list.reset(before)
        _remove(spark, folders)


def _remove(spark: SparkSession, folders: list[str]) -> int:
    jvm = spark.sparkContext._jvm
    gone = 0
    while folders:
        path = jvm.org.apache.hadoop.fs.Path(folders.pop())
        gone += bool(path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True))
    return gone


def wide(df: DataFrame) -> DataFrame:
    """df, never to be broadcast in a join of equal keys.

    Spark takes a table's size from its files and doesn't know what explode() adds: rows that repeat ids, or are made of a few
    texts, are hundreds of times what it thinks, and the driver would hold them all.
    """
    return df.hint("merge")


#: Rows of a caller's table that are broadcast at most.
SMALL = 100_000


def small(df: DataFrame) -> DataFrame:
    """df, to be broadcast if it has at most SMALL rows; else Spark joins it as any other table."""
    from pyspark.sql import functions as F

    return F.broadcast(df) if df.limit(SMALL + 1).count() <= SMALL else df
