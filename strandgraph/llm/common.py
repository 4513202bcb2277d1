"""What several operators share: tables, the shared folder, Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from strandgraph.storage import importable, materialize  # noqa: F401

#: Rows of one Arrow batch sent to Python, so that a batch of long texts stays small.
BATCH_ROWS = 128
#: Keys of eight bytes that are broadcast at most.
BROADCAST_KEYS = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def strings(column: pa.Array) -> list[str]:
    """Texts of a batch; null becomes the empty text, bytes that are not UTF-8 the replacement character."""
    try:
        return [x or "" for x in column.to_pylist()]
    except UnicodeDecodeError:
        return [(x or b"").decode("utf-8", "replace") for x in column.cast(pa.binary()).to_pylist()]


def map_batches(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """mapInArrow with batches of BATCH_ROWS rows, in workers that can import this package.

    Spark reads the size of batches from the session when it plans the query, so it stays set there.
    """
    importable(df.sparkSession)
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return df.mapInArrow(f, schema)


def matching(rows: DataFrame, keys: DataFrame, on: str, anti: bool = False) -> DataFrame:
    """The rows whose key is among keys (anti: is not), one column of distinct values, written before.

    Up to BROADCAST_KEYS keys go to all executors and the rows stay where they are; more keys are joined by a shuffle.
    """
    few = keys.count() <= BROADCAST_KEYS
    return rows.join(F.broadcast(keys) if few else keys, on, "left_anti" if anti else "left_semi")
