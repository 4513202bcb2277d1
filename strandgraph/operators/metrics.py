"""Evaluation measures and descriptive statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandgraph.operators.ranks import ranked


def ratio(a: str, b: str) -> Column:
    """a / b, null where b is 0."""
    return F.expr(f"CAST({a} AS DOUBLE) / nullif({b}, 0)")


def confusion(df: DataFrame, target: str = "y", prediction: str = "prediction", by: Sequence[str] = ()) -> DataFrame:
    """Counts tp, fp, fn, tn, abstained (prediction 0) of targets and predictions in {-1, 1}, with both classes' measures.

    Precision, recall and F of each class, and the mean of the two F; null where a denominator is 0.
    """
    hit = lambda p, t: F.count_if((F.col(prediction) == p) & (F.col(target) == t))
    counts = df.groupBy(*by).agg(hit(1, 1).alias("tp"), hit(1, -1).alias("fp"), hit(-1, 1).alias("fn"), hit(-1, -1).alias("tn"), F.count_if(F.col(prediction) == 0).alias("abstained"))
    out = counts.withColumns({"p_precision": ratio("tp", "tp + fp"), "p_recall": ratio("tp", "tp + fn"), "n_precision": ratio("tn", "tn + fn"), "n_recall": ratio("tn", "tn + fp")})
    out = out.withColumns({f"{c}_f": F.expr(f"2 * {c}_precision * {c}_recall / nullif({c}_precision + {c}_recall, 0)") for c in "pn"})
    return out.withColumn("balanced_f", F.expr("(p_f + n_f) / 2"))


def class_sizes(df: DataFrame, target: str = "y") -> DataFrame:
    """(target, n) and the factor to the largest class."""
    n = df.groupBy(target).agg(F.count("*").alias("n"))
    top = n.agg(F.max("n").alias("top"))
    return n.crossJoin(F.broadcast(top)).select(target, "n", (F.col("top") / F.col("n")).alias("factor"))  # one row


def statistics(df: DataFrame, value: str, by: Sequence[str] = (), null: float | None = -1.0, orders: Sequence[float] = (0.05, 0.25, 0.5, 0.75, 0.95), weight: str | None = None) -> DataFrame:
    """num, total, mean, sd, least, most, the order statistics at floor(n * q), and mad, the median distance to the median.

    Values equal to null don't count. Order statistics come from ranks, so no group is gathered in memory. A row counts as often as
    its weight, a whole number from 1, says.
    """
    rows = df.where(F.col(value).isNotNull() & (F.lit(null is None) | (F.col(value) != F.lit(null))))
    rows = rows.select(*by, F.col(value).cast("double").alias("x"), (F.col(weight) if weight else F.lit(1)).cast("long").alias("_w"))
    if weight is None:
        base = rows.groupBy(*by).agg(F.count("*").alias("num"), F.sum("x").alias("total"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("sd"), F.min("x").alias("least"), F.max("x").alias("most"))
    else:
        sums = rows.groupBy(*by).agg(F.sum("_w").alias("num"), F.sum(F.col("x") * F.col("_w")).alias("total"), F.min("x").alias("least"), F.max("x").alias("most"))
        sums = sums.withColumn("mean", F.col("total") / F.col("num"))
        apart = (rows.join(sums, list(by)) if by else rows.crossJoin(F.broadcast(sums))).groupBy(*by).agg(F.sum(F.col("_w") * F.pow(F.col("x") - F.col("mean"), F.lit(2))).alias("_far"))
        base = (sums.join(apart, list(by)) if by else sums.crossJoin(F.broadcast(apart))).withColumn("sd", F.sqrt(F.expr("_far / nullif(num - 1, 0)"))).select(*by, "num", "total", "mean", "sd", "least", "most")
    found = _ordered(rows, base.select(*by, "num"), by, orders, "q")
    median = found.select(*by, F.col("q50").alias("_median"))
    apart = (rows.join(median, list(by)) if by else rows.crossJoin(F.broadcast(median))).select(*by, F.abs(F.col("x") - F.col("_median")).alias("x"), "_w")
    mad = _ordered(apart, base.select(*by, "num"), by, [0.5], "m").withColumnRenamed("m50", "mad")
    for more in (found, mad):
        base = base.join(more, list(by)) if by else base.crossJoin(F.broadcast(more))
    return base


def _ordered(rows: DataFrame, sizes: DataFrame, by: Sequence[str], orders: Sequence[float], name: str) -> DataFrame:
    """The values at 0-based places floor(n * q): equal values are counted first, so a place is found among distinct values."""
    counted = rows.groupBy(*by, "x").agg(F.sum("_w").alias("_c"))
    keyed = counted if by else counted.withColumn("_all", F.lit(0))
    counted = ranked(keyed, by or ["_all"], ["x"], "_i", {"_less": F.col("_c")}).withColumn("_upto", F.col("_less") + F.col("_c"))
    counted = counted.join(sizes, list(by)) if by else counted.crossJoin(F.broadcast(sizes))
    at = lambda q: F.min(F.when(F.col("_upto") > F.floor(F.col("num") * q), F.col("x")))
    return counted.groupBy(*by).agg(*[at(q).alias(f"{name}{round(100 * q)}") for q in orders])
