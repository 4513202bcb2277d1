"""Linear models over sparse features: scoring, decisions, cascades, thresholds.

Models are rows (model, level, bias, wscale, pos_thr, neg_thr), weights rows (model, level, fid, w), features rows
(instance_id, fid, val). All models are scored in one join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandgraph.operators.ranks import ranked
from strandgraph.storage import small


def margins(features: DataFrame, weights: DataFrame, models: DataFrame, instances: DataFrame | None = None, by: Sequence[str] = ("instance_id",)) -> DataFrame:
    """(by, model, level, margin) of every instance and model: the sum of w * val, times wscale, plus bias.

    instances: (by) of instances that may have no features (their margin is the bias); default those with features.
    The models table has one row for each model and level and meets every instance; it is broadcast if it is small.
    """
    key = [*by, "model", "level"]
    met = features.join(weights, "fid").groupBy(*key).agg(F.sum(F.col("val") * F.col("w")).alias("dot"))
    every = (features.select(*by).distinct() if instances is None else instances.select(*by)).crossJoin(small(models))
    return every.join(met, key, "left").select(*key, (F.coalesce("dot", F.lit(0.0)) * F.col("wscale") + F.col("bias")).alias("margin"), "pos_thr", "neg_thr")


def decision(margin: Column, positive: Column, negative: Column) -> Column:
    """1 from the positive threshold on, -1 under the negative one, else 0."""
    return F.when(margin >= positive, 1).when(margin < negative, -1).otherwise(0)


def predict(scored: DataFrame) -> DataFrame:
    """margins() with prediction."""
    return scored.withColumn("prediction", decision(F.col("margin"), F.col("pos_thr"), F.col("neg_thr")))


def cascade(scored: DataFrame, by: Sequence[str] = ("instance_id",)) -> DataFrame:
    """(by, model, level, margin, prediction) of the first level that decides; instances that none decides are left out."""
    decided = predict(scored).where("prediction <> 0")
    return decided.groupBy(*by, "model").agg(F.min(F.struct("level", "margin", "prediction")).alias("x")).select(*by, "model", "x.level", "x.margin", "x.prediction")


def score_table(scored: DataFrame, models: Sequence[str | int], prefix: str = "model_") -> DataFrame:
    """One row for each instance with a column for each model."""
    wide = scored.groupBy("instance_id").pivot("model", list(models)).agg(F.first("margin"))
    return wide.select("instance_id", *[F.col(f"`{m}`").alias(f"{prefix}{m}") for m in models])


def extremes(vertex_margins: DataFrame, share: float, by: Sequence[str] = ("instance_id", "model")) -> DataFrame:
    """The best and the worst floor(n * share / 2) vertices (1 at least) of each instance, as viewpoints for the next level."""
    n = F.greatest(F.floor(F.count("*").over(Window.partitionBy(*by)) * share / 2), F.lit(1))
    best = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("margin"), "vid"))
    worst = F.row_number().over(Window.partitionBy(*by).orderBy("margin", "vid"))
    return vertex_margins.withColumns({"_n": n, "_b": best, "_w": worst}).where("_b <= _n OR _w <= _n").select(*by, "vid", "margin", F.when(F.col("_b") <= F.col("_n"), "best").otherwise("worst").alias("side"))


def proportional_thresholds(scored: DataFrame, share: float = 0.5, by: Sequence[str] = ("model",)) -> DataFrame:
    """(by, pos_thr, neg_thr): the share of the margins on each side of 0 that stays undecided.

    With margins in order and z of n below 0, the thresholds are those at n - (n - z) * share and z * share. Without
    margins from 0 on both are the largest margin; without any below 0 both are the smallest.
    """
    placed = ranked(scored.select(*by, "margin"), by, ["margin"])
    size = scored.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(F.col("margin") < 0).alias("z"), F.min("margin").alias("low"), F.max("margin").alias("high"))
    size = size.withColumns({"at_pos": F.floor(F.col("n") - (F.col("n") - F.col("z")) * share), "at_neg": F.floor(F.col("z") * share)})
    got = placed.join(size, list(by)).where("i = at_pos OR i = at_neg OR i = 0").groupBy(*by, "n", "z", "low", "high").agg(F.max(F.when(F.col("i") == F.col("at_pos"), F.col("margin"))).alias("p"), F.max(F.when(F.col("i") == F.col("at_neg"), F.col("margin"))).alias("q"))
    edge = lambda c: F.when(F.col("z") == F.col("n"), F.col("high")).when(F.col("z") == 0, F.col("low")).otherwise(F.col(c))
    return got.select(*by, edge("p").alias("pos_thr"), edge("q").alias("neg_thr"))


def performance_thresholds(scored: DataFrame, least_f: float = 0.5, step: float = 0.001, by: Sequence[str] = ("model",)) -> DataFrame:
    """(by, share, pos_thr, neg_thr, balanced_f): the largest share, in steps down from 1, whose decisions reach least_f.

    scored has y. The grid has 1 / step rows; counts of decisions come from ranks, so no margin meets the grid itself.
    """
    steps = round(1 / step)
    below = {"p_below": (F.col("y") == 1).cast("long"), "n_below": (F.col("y") == -1).cast("long")}
    placed = ranked(scored.select(*by, "margin", "y"), by, ["margin"], running=below)
    size = scored.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(F.col("margin") < 0).alias("z"), F.count_if(F.col("y") == 1).alias("p"), F.count_if(F.col("y") == -1).alias("m"))
    grid = scored.sparkSession.range(1, steps + 1).select((F.col("id") / steps).alias("share"))
    grid = size.crossJoin(F.broadcast(grid)).withColumns({"at_pos": F.least(F.floor(F.col("n") - (F.col("n") - F.col("z")) * F.col("share")), F.col("n") - 1), "at_neg": F.floor(F.col("z") * F.col("share"))})
    at = lambda c, t: placed.select(*by, F.col("i").alias(c), F.col("margin").alias(t), F.col("p_below").alias(f"{t}_p"), F.col("n_below").alias(f"{t}_n"))
    got = grid.join(at("at_pos", "pos_thr"), [*by, "at_pos"]).join(at("at_neg", "neg_thr"), [*by, "at_neg"])
    got = got.withColumns({"tp": F.expr("p - pos_thr_p"), "fp": F.expr("m - pos_thr_n"), "fn": F.expr("neg_thr_p"), "tn": F.expr("neg_thr_n")})
    got = got.withColumn("balanced_f", F.expr("(2e0 * tp / nullif(2 * tp + fp + fn, 0) + 2e0 * tn / nullif(2 * tn + fp + fn, 0)) / 2"))
    best = got.where(F.col("balanced_f") >= least_f).groupBy(*by).agg(F.max(F.struct("share", "pos_thr", "neg_thr", "balanced_f")).alias("x"))
    return best.select(*by, "x.*")


def model_norms(weights: DataFrame, models: DataFrame) -> DataFrame:
    """(model, level, norm, good): length of the weights, and whether there is any."""
    norm = weights.groupBy("model", "level").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("_w"))
    return models.join(norm, ["model", "level"], "left").select("model", "level", (F.coalesce("_w", F.lit(0.0)) * F.col("wscale")).alias("norm"), (F.coalesce("_w", F.lit(0.0)) != 0).alias("good"))
