"""Whole actions on graphs: train, predict, validate, explain."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandgraph.operators import features, metrics, model, train
from strandgraph.operators.train import Options
from strandgraph.storage import materialize


def featurise(v: DataFrame, e: DataFrame, options: Options = Options()) -> list[DataFrame]:
    """The features of each level of the options, written once: training and scoring read them several times."""
    return [materialize(features.graph_vectors(v, e, r, d, options.bits, options.kind), "features") for r, d in options.levels]


def fit(v: DataFrame, e: DataFrame, targets: DataFrame, options: Options = Options(), name: str = "model") -> tuple[DataFrame, DataFrame]:
    """(models, weights) of a cascade with one level for each (radius, distance) of the options.

    targets (instance_id, y) with y of -1, 1, or 0 where unknown: those take part by self-training of a single level.
    """
    levels = featurise(v, e, options)
    if len(levels) == 1 and not targets.where("y = 0").isEmpty():
        weights = train.self_training(levels[0], targets, options).withColumn("level", F.lit(0))
        limits = weights.select("model", "level").distinct().withColumns({"pos_thr": F.lit(0.0), "neg_thr": F.lit(0.0)})
    else:
        weights, limits = train.cascade_train(levels, targets, options)
    weights = materialize(weights, "weights")
    sizes = F.create_map(*[F.lit(x) for k, (r, d) in enumerate(options.levels) for x in (k, r * 1000 + d)])[F.col("level")]
    bias = weights.where("fid = -1").select("level", F.col("w").alias("bias"))
    models = limits.join(bias, "level").select(F.lit(name).alias("model"), "level", F.lit(options.bits).alias("bits"), F.floor(sizes / 1000).cast("int").alias("radius"), (sizes % 1000).cast("int").alias("distance"), "pos_thr", "neg_thr", "bias", F.lit(1.0).alias("wscale"))
    return models, weights.where("fid >= 0").select(F.lit(name).alias("model"), "level", "fid", "w")


def score(v: DataFrame, e: DataFrame, models: DataFrame, weights: DataFrame, options: Options = Options()) -> DataFrame:
    """(instance_id, model, level, margin, prediction) of each graph at the first level that decides."""
    instances = v.select(F.col("graph_id").alias("instance_id")).distinct()
    out = None
    for k, table in enumerate(featurise(v, e, options)):
        here = model.margins(table, weights.where(F.col("level") == k), models.where(F.col("level") == k), instances)
        out = here if out is None else out.unionByName(here)
    return model.cascade(out)


def explain(v: DataFrame, e: DataFrame, models: DataFrame, weights: DataFrame, options: Options = Options(), level: int | None = None) -> DataFrame:
    """(instance_id, vid, model, level, margin) of each vertex at every level (or one); in doubled graphs a vertex and its twin are one."""
    scored = None
    for k, (r, d) in enumerate(options.levels):
        if level in (None, k):
            vec = features.vertex_vectors(v, e, r, d, options.bits)
            here = model.margins(vec, weights.where(F.col("level") == k), models.where(F.col("level") == k), by=("instance_id", "vid"))
            scored = here if scored is None else scored.unionByName(here)
    if not options.directed:
        return scored.select("instance_id", "vid", "model", "level", "margin")
    half = v.groupBy(F.col("graph_id").alias("instance_id")).agg((F.max("vid") / 2).cast("int").alias("_h"))
    own = F.when(F.col("vid") > F.col("_h"), F.col("vid") - F.col("_h")).otherwise(F.col("vid"))
    return scored.join(half, "instance_id").select("instance_id", own.alias("vid"), "model", "level", "margin").groupBy("instance_id", "vid", "model", "level").agg(F.sum("margin").alias("margin"))


def validate(v: DataFrame, e: DataFrame, targets: DataFrame, options: Options = Options()) -> tuple[DataFrame, DataFrame]:
    """(rows, measures) of a cross-validation of the first level."""
    rows = materialize(train.cross_validation(featurise(v, e, options)[0], targets, options), "validation")
    return rows, metrics.confusion(rows)


def curve(v: DataFrame, e: DataFrame, targets: DataFrame, options: Options = Options()) -> DataFrame:
    """The measures at each point of a learning curve."""
    rows = train.learning_curve(featurise(v, e, options)[0], targets, options)
    return metrics.confusion(rows.withColumn("prediction", F.when(F.col("margin") >= 0, 1).otherwise(-1)), by=["point"])
