"""Ranks over all rows of a group, whatever the group's size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandgraph.storage import materialize, small


def ranked(df: DataFrame, by: Sequence[str], order: Sequence[str], name: str = "i", running: dict[str, Column] | None = None) -> DataFrame:
    """df with name: each row's 0-based place in its group, and with sums over the rows before it.

    Rows are dealt by ranges of (by, order) and sorted within them, so a group of any size is spread over tasks; the
    sizes of a group's parts (one row for each group and range) then shift the places within them.
    running: column name -> expression whose sum over the earlier rows of the group is wanted.
    """
    running = running or {}
    flat = df.withColumns({f"_v_{k}": v for k, v in running.items()})
    dealt = flat.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order).withColumns({"_p": F.spark_partition_id(), "_m": F.monotonically_increasing_id()})
    dealt = materialize(dealt, "ranges")
    part = dealt.groupBy(*by, "_p").agg(F.min("_m").alias("_first"), F.count("*").alias("_n"), *[F.sum(f"_v_{k}").alias(f"_s_{k}") for k in running])
    before = Window.partitionBy(*by).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    shift = part.select(*by, "_p", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), *[F.coalesce(F.sum(f"_s_{k}").over(before), F.lit(0)).alias(f"_b_{k}") for k in running])
    shift = small(materialize(shift, "shift"))  # known before the join is planned, which would shuffle all rows else
    out = dealt.join(shift, [*by, "_p"]).withColumn(name, F.col("_before") + F.col("_m") - F.col("_first"))
    inside = Window.partitionBy(*by, "_p").orderBy("_m").rowsBetween(Window.unboundedPreceding, -1)
    out = out.withColumns({k: F.col(f"_b_{k}") + F.coalesce(F.sum(f"_v_{k}").over(inside), F.lit(0)) for k in running})
    return out.drop("_p", "_m", "_first", "_before", *[f"_{x}_{k}" for k in running for x in "vb"])
