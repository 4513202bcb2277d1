"""Queries of scoring, training and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandgraph.functions import hashing
from strandgraph.functions import residues as R
from strandgraph.functions import vectors as V
from strandgraph.operators import encode, features, graph, metrics, model, train
from strandgraph.plans import inputs as I
from strandgraph.plans.inputs import MODELS, table
from strandgraph.storage import materialize, small

QUERIES, SQL = {}, {}


def _scored(spark, d):
    w, m = I.weights(spark)
    return model.margins(I.vectors(spark, d), w, m)


def margins(spark, d):
    """The flagship: every peptide scored by every model in one pass over the features."""
    return model.predict(_scored(spark, d)).select("instance_id", "model", F.round("margin", 6).alias("margin"), "prediction")


QUERIES["q_margin_all_models"] = margins
SQL["q_margin_all_models"] = I.query(*I.MARGINS, final="SELECT instance_id, model, round(margin, 6) AS margin, CASE WHEN margin >= 0 THEN 1 ELSE -1 END AS prediction FROM scored")


def pivot(spark, d):
    return model.score_table(_scored(spark, d).withColumn("margin", F.round("margin", 6)), list(range(MODELS)))


QUERIES["q_score_pivot"] = pivot
SQL["q_score_pivot"] = I.query(*I.MARGINS, final="SELECT instance_id, " + ", ".join(f"max(round(margin, 6)) FILTER (model = {m}) AS model_{m}" for m in range(MODELS)) + " FROM scored GROUP BY 1")


def cascade(spark, d):
    """Models 0 to 2 as levels of one cascade; the first two abstain around 0."""
    s = _scored(spark, d).where("model < 3")
    s = s.select("instance_id", F.lit(0).alias("model"), F.col("model").alias("level"), "margin", F.when(F.col("model") < 2, 0.3).otherwise(0.0).alias("pos_thr"), F.when(F.col("model") < 2, -0.3).otherwise(0.0).alias("neg_thr"))
    return model.cascade(s).select("instance_id", "level", F.round("margin", 6).alias("margin"), "prediction")


QUERIES["q_cascade_predict"] = cascade
SQL["q_cascade_predict"] = I.query(
    *I.MARGINS,
    "p AS (SELECT instance_id, model AS level, margin, CASE WHEN margin >= CASE WHEN model < 2 THEN 0.3 ELSE 0 END THEN 1 WHEN margin < CASE WHEN model < 2 THEN -0.3 ELSE 0 END THEN -1 ELSE 0 END AS prediction FROM scored WHERE model < 3)",
    final="SELECT instance_id, level, round(margin, 6) AS margin, prediction FROM p WHERE prediction <> 0 QUALIFY row_number() OVER (PARTITION BY instance_id ORDER BY level) = 1",
)


def _vertex(spark, d):
    """Of each vertex and its reversed twin, the margin of the features that begin at either."""
    p = I.peptides(spark, d)
    v, e = encode.directed(encode.vertices(p), encode.edges(p))
    vec = features.vertex_vectors(v, e, 0, 1)
    w, m = I.weights(spark)
    scored = model.margins(vec, w.where("model = 0"), m.where("model = 0"), by=("instance_id", "vid"))
    return scored.select("instance_id", ((F.col("vid") - 1) % 60 + 1).cast("int").alias("vid"), "model", "margin").groupBy("instance_id", "model", "vid").agg(F.round(F.sum("margin"), 6).alias("margin"))


VERTEX = (
    *I.GRAPHS, *I.distances_sql(1), I.CODES0,
    "pv AS (SELECT p.graph_id || '|' || p.src AS graph_id, p.d, a.code AS a, b.code AS b FROM dist p JOIN code0 a ON a.graph_id = p.graph_id AND a.vid = p.src JOIN code0 b ON b.graph_id = p.graph_id AND b.vid = p.dst)",
    I.histogram_sql().split(", one AS (", 1)[1].join(["one AS (", ""]).replace("FROM pair", "FROM pv"), I.vectors_sql(),
    f"sv AS (SELECT instance_id, sum(val * {I.WEIGHT.replace('m * 104729', '0')}) AS margin FROM vec GROUP BY 1)",
    "vm AS (SELECT split_part(instance_id, '|', 1) AS instance_id, 0 AS model, (CAST(split_part(instance_id, '|', 2) AS INTEGER) - 1) % 60 + 1 AS vid, round(sum(margin), 6) AS margin FROM sv GROUP BY 1, 3)",
)
QUERIES["q_vertex_margin"] = _vertex
SQL["q_vertex_margin"] = I.query(*VERTEX, final="SELECT instance_id, model, CAST(vid AS INTEGER) AS vid, margin FROM vm")
QUERIES["q_extreme_vertices"] = lambda spark, d: model.extremes(_vertex(spark, d), 0.1)
SQL["q_extreme_vertices"] = I.query(
    *VERTEX,
    "r AS (SELECT *, greatest(floor(count(*) OVER (PARTITION BY instance_id) * 0.05), 1) AS n, row_number() OVER (PARTITION BY instance_id ORDER BY margin DESC, vid) AS b, row_number() OVER (PARTITION BY instance_id ORDER BY margin, vid) AS w FROM vm)",
    final="SELECT instance_id, model, CAST(vid AS INTEGER) AS vid, margin, CASE WHEN b <= n THEN 'best' ELSE 'worst' END AS side FROM r WHERE b <= n OR w <= n",
)


def _letter_margin(spark, d):
    """Documents scored by a made-up model over shares of letters, with their targets."""
    w = spark.range(65, 91).select(F.lit(0).alias("model"), F.lit(0).alias("level"), F.col("id").alias("fid"), (((F.col("id") * 7919) % 2001 - 1000) / 1000).alias("w"))
    m = spark.range(1).select(F.lit(0).alias("model"), F.lit(0).alias("level"), F.lit(0.0).alias("bias"), F.lit(1.0).alias("wscale"), F.lit(0.0).alias("pos_thr"), F.lit(0.0).alias("neg_thr"))
    scored = model.margins(I.letters(spark, d), w, m, I.targets(spark, d)).select("instance_id", "model", F.round(F.col("margin") + 1e-9, 6).alias("margin"))  # shares make exact halves
    return scored.join(I.targets(spark, d), "instance_id")


LETTER_MARGIN = (I.SEQ, I.TGT, I.LETTERS, "lm AS (SELECT instance_id, y, round(coalesce(m, 0) + 1e-9, 6) AS margin FROM tgt LEFT JOIN (SELECT instance_id, sum(val * ((fid * 7919) % 2001 - 1000) / 1e3) AS m FROM letters GROUP BY 1) USING (instance_id))")
RANKED = "z AS (SELECT count(*) AS n, count(*) FILTER (margin < 0) AS z, min(margin) AS low, max(margin) AS high, count(*) FILTER (y = 1) AS p, count(*) FILTER (y = -1) AS m FROM lm), r AS (SELECT *, row_number() OVER (ORDER BY margin) - 1 AS i FROM lm)"
QUERIES["q_threshold_proportional"] = lambda spark, d: model.proportional_thresholds(_letter_margin(spark, d), 0.5)
SQL["q_threshold_proportional"] = I.query(
    *LETTER_MARGIN, RANKED,
    final="SELECT 0 AS model, CASE WHEN z = n THEN high WHEN z = 0 THEN low ELSE (SELECT margin FROM r WHERE i = CAST(floor(n - (n - z) * 0.5) AS BIGINT)) END AS pos_thr, CASE WHEN z = n THEN high WHEN z = 0 THEN low ELSE (SELECT margin FROM r WHERE i = CAST(floor(z * 0.5) AS BIGINT)) END AS neg_thr FROM z",
)


def performance(spark, d):
    """Distinct margins only, so that ranks don't hang on ties."""
    rows = _letter_margin(spark, d).where("y <> 0").groupBy("model", "margin").agg(F.min("y").alias("y"))
    return model.performance_thresholds(rows, 0.3).select("model", F.round("share", 6).alias("share"), "pos_thr", "neg_thr", F.round("balanced_f", 6).alias("balanced_f"))


QUERIES["q_threshold_performance"] = performance
SQL["q_threshold_performance"] = I.query(
    *LETTER_MARGIN[:-1], LETTER_MARGIN[-1].replace("lm AS (", "lm0 AS ("), "lm AS (SELECT margin, min(y) AS y FROM lm0 WHERE y <> 0 GROUP BY margin)", RANKED,
    "g AS (SELECT s / 1e3 AS share FROM (SELECT unnest(range(1, 1001)) AS s))",
    "t AS (SELECT share, a.margin AS pos_thr, b.margin AS neg_thr, p, m FROM g, z JOIN r a ON a.i = least(CAST(floor(n - (n - z) * share) AS BIGINT), n - 1) JOIN r b ON b.i = CAST(floor(z * share) AS BIGINT))",
    "f AS (SELECT t.*, count(*) FILTER (y = 1 AND margin >= pos_thr) AS tp, count(*) FILTER (y = -1 AND margin >= pos_thr) AS fp, count(*) FILTER (y = 1 AND margin < neg_thr) AS fn, count(*) FILTER (y = -1 AND margin < neg_thr) AS tn FROM t, lm GROUP BY ALL)",
    "x AS (SELECT share, pos_thr, neg_thr, (2e0 * tp / nullif(2 * tp + fp + fn, 0) + 2e0 * tn / nullif(2 * tn + fp + fn, 0)) / 2 AS balanced_f FROM f)",
    final="SELECT 0 AS model, round(share, 6) AS share, pos_thr, neg_thr, round(balanced_f, 6) AS balanced_f FROM x WHERE balanced_f >= 0.3 ORDER BY share DESC LIMIT 1",
)


def confusion(spark, d):
    out = metrics.confusion(I.labelled(spark, d))
    return out.select(*[F.round(c, 6).alias(c) if k == "double" else F.col(c) for c, k in out.dtypes])


QUERIES["q_confusion_metrics"] = confusion
SQL["q_confusion_metrics"] = """WITH l AS (SELECT 2 * quality - 1 AS y, 1 - 2 * toxic AS p FROM labels),
    c AS (SELECT count(*) FILTER (p = 1 AND y = 1) AS tp, count(*) FILTER (p = 1 AND y = -1) AS fp, count(*) FILTER (p = -1 AND y = 1) AS fn, count(*) FILTER (p = -1 AND y = -1) AS tn, count(*) FILTER (p = 0) AS abstained FROM l),
    r AS (SELECT *, tp / nullif(tp + fp, 0) AS pp, tp / nullif(tp + fn, 0) AS pr, tn / nullif(tn + fn, 0) AS np, tn / nullif(tn + fp, 0) AS nr FROM c), f AS (SELECT *, 2 * pp * pr / nullif(pp + pr, 0) AS pf, 2 * np * nr / nullif(np + nr, 0) AS nf FROM r)
    SELECT tp, fp, fn, tn, abstained, round(pp, 6) AS p_precision, round(pr, 6) AS p_recall, round(np, 6) AS n_precision, round(nr, 6) AS n_recall, round(pf, 6) AS p_f, round(nf, 6) AS n_f, round((pf + nf) / 2, 6) AS balanced_f FROM f"""

KEY = "((doc_id % 1000003) * 7921 + 104729) % 1000003"
QUERIES["q_class_balance"] = lambda spark, d: train.balanced(I.labelled(spark, d))
SQL["q_class_balance"] = f"""WITH l AS (SELECT doc_id AS instance_id, 2 * quality - 1 AS y, row_number() OVER (PARTITION BY quality ORDER BY {KEY}, doc_id) - 1 AS i FROM labels), s AS (SELECT count(*) FILTER (y > 0) AS p, count(*) FILTER (y < 0) AS m FROM l),
    o AS (SELECT *, CASE WHEN y > 0 THEN p ELSE m END AS own, CASE WHEN y > 0 THEN m ELSE p END AS other FROM l, s),
    c AS (SELECT *, CASE WHEN own < other THEN other // own + CASE WHEN i < other % own THEN 1 ELSE 0 END ELSE 1 END AS copies FROM o)
    SELECT instance_id, y, CAST(copy_no AS INTEGER) AS copy_no, 2 * (copy_no * own + i) + CASE WHEN y > 0 THEN 0 ELSE 1 END AS slot FROM (SELECT *, unnest(range(0, copies)) AS copy_no FROM c)"""
QUERIES["q_class_sizes"] = lambda spark, d: metrics.class_sizes(I.targets(spark, d)).withColumn("factor", F.round("factor", 6))
SQL["q_class_sizes"] = I.query(I.TGT, final="SELECT y, n, round(max(n) OVER () / n, 6) AS factor FROM (SELECT y, count(*) AS n FROM tgt GROUP BY y)")
QUERIES["q_stratified_folds"] = lambda spark, d: train.folds(I.targets(spark, d), 10)
SQL["q_stratified_folds"] = I.query(I.TGT, final=f"SELECT instance_id, y, CASE WHEN y <> 0 THEN CAST(row_number() OVER (PARTITION BY y ORDER BY {KEY.replace('doc_id', 'instance_id')}, instance_id) % 10 AS INTEGER) END AS fold FROM tgt")
QUERIES["q_learning_curve_splits"] = lambda spark, d: train.curve_splits(I.labelled(spark, d), 10)
SQL["q_learning_curve_splits"] = f"""WITH r AS (SELECT doc_id AS instance_id, row_number() OVER (ORDER BY {KEY}, doc_id) - 1 AS i, count(*) OVER () AS n FROM labels), p AS (SELECT *, CAST(unnest(range(1, 10)) AS INTEGER) AS point FROM r)
    SELECT instance_id, point, CASE WHEN i < n // 10 THEN 'test' ELSE 'train' END AS part FROM p WHERE i < n * (point + 1) // 10"""
QUERIES["q_self_training_round"] = lambda spark, d: train.self_training_round(_letter_margin(spark, d).where("y = 0").select("instance_id", "margin"), 0.4)
SQL["q_self_training_round"] = I.query(
    *LETTER_MARGIN,
    "s AS (SELECT instance_id, margin, CASE WHEN margin > 0 THEN 1 ELSE -1 END AS side FROM lm WHERE y = 0)",
    "k AS (SELECT *, row_number() OVER (PARTITION BY side ORDER BY margin) - 1 AS i, count(*) OVER (PARTITION BY side) AS n FROM s)",
    "t AS (SELECT side, min(margin) AS hold FROM k WHERE i = CAST(floor((n - 1) * CASE WHEN side > 0 THEN 0.6 ELSE 0.4 END) AS BIGINT) GROUP BY side)",
    final="SELECT instance_id, side AS y FROM s JOIN t USING (side) WHERE side > 0 AND margin >= hold OR side < 0 AND margin <= hold",
)

#: Documents as dense lists of the shares of A to Z.
DENSE = "dense AS (SELECT instance_id, [" + ", ".join(f"coalesce(sum(val) FILTER (fid = {k}), 0)" for k in range(65, 91)) + "] AS x FROM letters GROUP BY 1)"


def sgd_sql(name: str, items: str, by: str = "model", epochs: int = 10, lam: float = 1e-4) -> tuple[str, ...]:
    """{name} (by, w, b): linear models by the plain loop over items (by, instance_id, y, slot, x), step by step.

    Hinge loss: the weights shrink, then move towards an item on the wrong side of its margin; the first count of steps
    is that of the trainer.
    """
    first = 1 / ((1 / lam**0.5) ** 0.5 * lam)
    rate = f"(1e0 / ({lam!r} * ({first!r} + step)))"
    shrink = f"(1 - {rate} * {lam!r})"
    move = f"CASE WHEN y * (list_dot_product(w, x) * {shrink} + b) < 1 THEN {rate} * y ELSE 0e0 END"
    return (
        f"{name}_i AS MATERIALIZED (SELECT {by}, x, y, row_number() OVER (PARTITION BY {by} ORDER BY slot, instance_id) - 1 AS i, count(*) OVER (PARTITION BY {by}) AS n FROM ({items}))",
        f"{name}_w AS (SELECT DISTINCT {by}, CAST(0 AS BIGINT) AS step, n, list_transform(range(26), lambda k: 0e0) AS w, 0e0 AS b FROM {name}_i UNION ALL SELECT {by}, step + 1, n, list_transform(range(1, 27), lambda k: w[k] * shrink + move * x[k]), b + 0.01 * move "
        f"FROM (SELECT r.{by}, step, r.n, w, b, x, {shrink} AS shrink, {move} AS move FROM {name}_w r JOIN {name}_i i ON i.{by} = r.{by} AND i.i = r.step % r.n WHERE step < {epochs} * r.n))",
        f"{name} AS (SELECT {by}, w, b FROM {name}_w WHERE step = {epochs} * n)",
    )


SLOT = KEY.replace("doc_id", "instance_id")
QUERIES["q_sgd_train_cv"] = lambda spark, d: train.cross_validation(I.letters(spark, d), I.targets(spark, d), train.Options()).select("instance_id", "fold", "y", "prediction", F.round("margin", 6).alias("margin"))
SQL["q_sgd_train_cv"] = I.query(
    I.SEQ, I.TGT, I.LETTERS, DENSE,
    f"fo AS (SELECT instance_id, y, x, {SLOT} AS slot, CAST(row_number() OVER (PARTITION BY y ORDER BY {SLOT}, instance_id) % 10 AS INTEGER) AS fold FROM tgt LEFT JOIN dense USING (instance_id) WHERE y <> 0)",
    *sgd_sql("cv", "SELECT CAST(held AS INTEGER) AS held, instance_id, y, slot, x FROM fo, (SELECT unnest(range(0, 10)) AS held) WHERE fold <> held AND x IS NOT NULL", "held"),
    "m AS (SELECT instance_id, fold, y, coalesce(list_dot_product(w, x), 0) + b AS margin FROM fo JOIN cv ON held = fold)",
    final="SELECT instance_id, fold, y, CASE WHEN margin >= 0 THEN 1 ELSE -1 END AS prediction, round(margin, 6) AS margin FROM m",
)
QUERIES["q_learning_curve"] = lambda spark, d: train.learning_curve(I.letters(spark, d), I.targets(spark, d), train.Options()).select("point", "instance_id", "y", F.round("margin", 6).alias("margin"))
SQL["q_learning_curve"] = I.query(
    I.SEQ, I.TGT, I.LETTERS, DENSE,
    f"pl AS (SELECT instance_id, y, x, {SLOT} AS slot, row_number() OVER (ORDER BY {SLOT}, instance_id) - 1 AS i, count(*) OVER () AS n FROM tgt LEFT JOIN dense USING (instance_id) WHERE y <> 0)",
    "pt AS (SELECT *, CAST(unnest(range(1, 10)) AS INTEGER) AS point FROM pl)",
    *sgd_sql("lc", "SELECT point, instance_id, y, slot, x FROM pt WHERE i >= n // 10 AND i < n * (point + 1) // 10 AND x IS NOT NULL", "point"),
    final="SELECT pt.point, instance_id, y, round(coalesce(list_dot_product(w, x), 0) + b, 6) AS margin FROM pt JOIN lc USING (point) WHERE i < n // 10",
)
QUERIES["q_self_training"] = lambda spark, d: train.self_training(I.letters(spark, d), I.targets(spark, d), train.Options(quantile=0.3)).select("model", "fid", F.round("w", 6).alias("w"))


def _self_training_sql(rounds: int = 3, quantile: float = 0.3) -> str:
    """Each round learns from the labelled and from those unlabelled that the round before was sure of."""
    parts = [f"al AS (SELECT instance_id, y, x, {SLOT} AS slot FROM tgt LEFT JOIN dense USING (instance_id))"]
    more = "SELECT 0 AS model, instance_id, y, slot, x FROM al WHERE y <> 0 AND x IS NOT NULL"
    for k in range(rounds):
        parts += sgd_sql(f"st{k}", more)
        parts += [
            f"fr{k} AS (SELECT instance_id, slot, x, coalesce(list_dot_product(w, x), 0) + b AS margin FROM al, st{k} WHERE y = 0)",
            f"ra{k} AS (SELECT *, CASE WHEN margin > 0 THEN 1 ELSE -1 END AS side, row_number() OVER (PARTITION BY margin > 0 ORDER BY margin) - 1 AS i, count(*) OVER (PARTITION BY margin > 0) AS n FROM fr{k})",
            f"li{k} AS (SELECT side, min(margin) AS hold FROM ra{k} WHERE i = CAST(floor((n - 1) * CASE WHEN side > 0 THEN {1 - quantile} ELSE {quantile} END) AS BIGINT) GROUP BY side)",
            f"su{k} AS (SELECT instance_id, side AS y, slot, x FROM ra{k} JOIN li{k} USING (side) WHERE side > 0 AND margin >= hold OR side < 0 AND margin <= hold)",
        ]
        more = f"SELECT 0 AS model, instance_id, y, slot, x FROM al WHERE y <> 0 AND x IS NOT NULL UNION ALL SELECT 0, instance_id, y, slot, x FROM su{k} WHERE x IS NOT NULL"
    last = f"st{rounds - 1}"
    return I.query(I.SEQ, I.TGT, I.LETTERS, DENSE, *parts, final=f"SELECT 0 AS model, CAST(k + 64 AS BIGINT) AS fid, round(w[k], 6) AS w FROM {last}, (SELECT unnest(range(1, 27)) AS k) WHERE w[k] <> 0 UNION ALL SELECT 0, -1, round(b, 6) FROM {last}")


SQL["q_self_training"] = _self_training_sql()


def cascade_training(spark, d):
    """Weights and thresholds (fid -2 and -3) of two levels, the second learned from what the first leaves undecided."""
    found, limits = train.cascade_train([I.letters(spark, d)] * 2, I.targets(spark, d), train.Options())
    marks = limits.select("level", F.explode(F.array(F.struct(F.lit(-2).alias("fid"), F.col("pos_thr").alias("w")), F.struct(F.lit(-3).alias("fid"), F.col("neg_thr").alias("w")))).alias("x"))
    rows = found.select("level", "fid", "w").unionByName(marks.select("level", F.col("x.fid").cast("long").alias("fid"), F.col("x.w").alias("w")))
    return rows.select("level", "fid", F.round("w", 6).alias("w"))


def balance_sql(name: str, source: str) -> tuple[str, ...]:
    """{name}: the rows of source (instance_id, y, x) in balanced copies with slot."""
    return (
        f"{name}_k AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY {SLOT}, instance_id) - 1 AS i FROM {source}), {name}_s AS (SELECT count(*) FILTER (y > 0) AS p, count(*) FILTER (y < 0) AS m FROM {source})",
        f"{name}_o AS (SELECT *, CASE WHEN y > 0 THEN p ELSE m END AS own, CASE WHEN y > 0 THEN m ELSE p END AS other FROM {name}_k, {name}_s)",
        f"{name}_c AS (SELECT *, CASE WHEN own < other THEN other // own + CASE WHEN i < other % own THEN 1 ELSE 0 END ELSE 1 END AS copies FROM {name}_o)",
        f"{name} AS (SELECT 0 AS model, instance_id, y, x, 2 * (copy_no * own + i) + CASE WHEN y > 0 THEN 0 ELSE 1 END AS slot FROM (SELECT *, unnest(range(0, copies)) AS copy_no FROM {name}_c))",
    )


QUERIES["q_cascade_train"] = cascade_training
SQL["q_cascade_train"] = I.query(
    I.SEQ, I.TGT, I.LETTERS, DENSE, "l0 AS (SELECT instance_id, y, x FROM tgt LEFT JOIN dense USING (instance_id) WHERE y <> 0)",
    *balance_sql("b0", "l0"), *sgd_sql("c0", "SELECT * FROM b0 WHERE x IS NOT NULL"),
    "m0 AS (SELECT instance_id, y, x, coalesce(list_dot_product(w, x), 0) + b AS margin FROM l0, c0)",
    "z0 AS (SELECT count(*) AS n, count(*) FILTER (margin < 0) AS z, min(margin) AS low, max(margin) AS high FROM m0), r0 AS (SELECT margin, row_number() OVER (ORDER BY margin) - 1 AS i FROM m0)",
    "t0 AS (SELECT CASE WHEN z = n THEN high WHEN z = 0 THEN low ELSE (SELECT margin FROM r0 WHERE i = CAST(floor(n - (n - z) * 0.5) AS BIGINT)) END AS p, CASE WHEN z = n THEN high WHEN z = 0 THEN low ELSE (SELECT margin FROM r0 WHERE i = CAST(floor(z * 0.5) AS BIGINT)) END AS q FROM z0)",
    "l1 AS (SELECT instance_id, y, x FROM m0, t0 WHERE margin < p AND margin >= q)", *balance_sql("b1", "l1"), *sgd_sql("c1", "SELECT * FROM b1 WHERE x IS NOT NULL"),
    "w AS (SELECT 0 AS level, w, b FROM c0 UNION ALL SELECT 1, w, b FROM c1)",
    final="SELECT level, CAST(k + 64 AS BIGINT) AS fid, round(w[k], 6) AS w FROM w, (SELECT unnest(range(1, 27)) AS k) WHERE w[k] <> 0 UNION ALL SELECT level, -1, round(b, 6) FROM w UNION ALL SELECT 0, -2, round(p, 6) FROM t0 UNION ALL SELECT 0, -3, round(q, 6) FROM t0 UNION ALL SELECT 1, unnest([-2, -3]), 0e0",
)
QUERIES["q_one_class_negatives"] = lambda spark, d: train.one_class_negatives(I.letters(spark, d)).select("instance_id", "fid", F.round("val", 6).alias("val"))


SQL["q_one_class_negatives"] = I.query(
    I.SEQ, I.LETTERS, "pl AS (SELECT *, row_number() OVER (PARTITION BY instance_id ORDER BY fid) AS i FROM letters)",
    "dl AS (SELECT *, ((instance_id * 131 + i * 17) % 1000003 * 7921 + 104729) % 1000003 AS h FROM pl)",
    "dn AS (SELECT i, fid, val, row_number() OVER (PARTITION BY i ORDER BY h, instance_id) AS place FROM dl), tk AS (SELECT i, instance_id, row_number() OVER (PARTITION BY i ORDER BY instance_id) AS place FROM dl)",
    final="SELECT -instance_id - 1 AS instance_id, fid, round(max(val), 6) AS val FROM tk JOIN dn USING (i, place) GROUP BY 1, 2",
)


def losses(spark, d):
    """All losses and slopes over the margins of labelled documents."""
    rows = _letter_margin(spark, d).where("y <> 0").withColumn("z", F.col("y") * F.col("margin") * 10)
    kinds = ("log", "log_margin", "smooth_hinge", "squared_hinge", "hinge")
    return rows.select("instance_id", *[F.round(f(F.col("z"), k), 6).alias(f"{n}_{k}") for k in kinds for n, f in (("loss", R.loss), ("slope", R.loss_slope))])


QUERIES["q_losses"] = losses
SQL["q_losses"] = I.query(
    *LETTER_MARGIN, "zz AS (SELECT instance_id, y * margin * 10 AS z FROM lm WHERE y <> 0)",
    final="""SELECT instance_id, round(CASE WHEN z > 18 THEN exp(-z) WHEN z < -18 THEN -z ELSE ln(1 + exp(-z)) END, 6) AS loss_log, round(CASE WHEN z > 18 THEN exp(-z) WHEN z < -18 THEN 1 ELSE 1 / (exp(z) + 1) END, 6) AS slope_log,
    round(CASE WHEN z > 18 THEN exp(1 - z) WHEN z < -18 THEN 1 - z ELSE ln(1 + exp(1 - z)) END, 6) AS loss_log_margin, round(CASE WHEN z > 18 THEN exp(1 - z) WHEN z < -18 THEN 1 ELSE 1 / (exp(z - 1) + 1) END, 6) AS slope_log_margin,
    round(CASE WHEN z < 0 THEN 0.5 - z WHEN z < 1 THEN 0.5 * (1 - z) * (1 - z) ELSE 0 END, 6) AS loss_smooth_hinge, round(CASE WHEN z < 0 THEN 1e0 WHEN z < 1 THEN 1 - z ELSE 0 END, 6) AS slope_smooth_hinge,
    round(CASE WHEN z < 1 THEN 0.5 * (1 - z) * (1 - z) ELSE 0 END, 6) AS loss_squared_hinge, round(CASE WHEN z < 1 THEN 1 - z ELSE 0 END, 6) AS slope_squared_hinge,
    round(CASE WHEN z < 1 THEN 1 - z ELSE 0 END, 6) AS loss_hinge, CASE WHEN z < 1 THEN 1e0 ELSE 0e0 END AS slope_hinge FROM zz""",
)


def sparse_combine(spark, d):
    """Each document's letters minus half of the shares over all documents' language."""
    own = materialize(I.letters(spark, d), "letters")
    docs = I.table(spark, d, "documents").select(F.col("doc_id").alias("instance_id"), "lang")
    mean = materialize(own.join(docs, "instance_id").groupBy("lang", "fid").agg(F.avg("val").alias("val")), "mean")
    # A language has more rows than one task should sort: its few means go to the documents, not both to one place.
    other = docs.join(small(mean), "lang").select("instance_id", "fid", "val")
    return V.sparse_combine(own, 1.0, other, -0.5).select("instance_id", "fid", F.round("val", 6).alias("val"))


QUERIES["q_sparse_combine"] = sparse_combine
SQL["q_sparse_combine"] = I.query(
    I.SEQ, I.LETTERS, "mean AS (SELECT lang, fid, avg(val) AS val FROM letters JOIN seqs ON id = instance_id GROUP BY 1, 2)",
    final="SELECT instance_id, fid, round(sum(val), 6) AS val FROM (SELECT * FROM letters UNION ALL SELECT id, fid, -0.5 * val FROM seqs JOIN mean USING (lang)) GROUP BY 1, 2 HAVING sum(val) <> 0",
)
QUERIES["q_sparse_dot"] = lambda spark, d: V.sparse_dot(I.letters(spark, d), I.letters(spark, d).where("fid % 2 = 1")).select("instance_id", F.round("dot", 6).alias("dot"))
SQL["q_sparse_dot"] = I.query(I.SEQ, I.LETTERS, final="SELECT instance_id, round(coalesce(sum(val * val) FILTER (fid % 2 = 1), 0), 6) AS dot FROM letters GROUP BY 1")


def sparse_pairs(spark, d):
    """Single components, ranges, thresholds and products of packed letter shares, in thousandths."""
    p = V.pack(I.letters(spark, d).withColumn("val", F.round(F.col("val") * 1000)), "instance_id")
    ramp = F.transform(F.sequence(F.lit(0), F.lit(127)), lambda i: i / 100)
    x, without = F.col("pairs"), V.with_component(F.col("pairs"), 69, 0.0)
    return p.select(
        "instance_id", V.component(x, F.lit(69)).alias("e"), F.size(without).alias("others"), F.size(V.with_component(without, 3, 1.5)).alias("more"), F.size(V.between(x, 70, 80)).alias("middle"),
        F.size(V.trimmed(x, 50.0)).alias("common"), F.round(V.sparse_dense_dot(x, ramp), 6).alias("dot"), F.round(V.sparse_dense_dot(x, F.slice(ramp, 1, 75)), 6).alias("short"),
    )


QUERIES["q_sparse_pairs"] = sparse_pairs
SQL["q_sparse_pairs"] = I.query(
    I.SEQ, I.LETTERS, "sh AS (SELECT instance_id, fid, round(val * 1000) AS val FROM letters WHERE round(val * 1000) <> 0)",
    final="SELECT instance_id, coalesce(sum(val) FILTER (fid = 69), 0) AS e, CAST(count(*) FILTER (fid <> 69) AS INTEGER) AS others, CAST(count(*) FILTER (fid <> 69) + 1 AS INTEGER) AS more, CAST(count(*) FILTER (fid BETWEEN 70 AND 80) AS INTEGER) AS middle, CAST(count(*) FILTER (val >= 50) AS INTEGER) AS common, round(sum(val * fid / 1e2), 6) AS dot, round(coalesce(sum(val * fid / 1e2) FILTER (fid < 75), 0), 6) AS short FROM sh GROUP BY 1",
)


def average_direction(spark, d):
    """The mean of the first three components of each ten embeddings, zero where they cancel."""
    e = table(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 10).alias("g"), F.transform(F.slice("embedding", 1, 3), lambda x: x.cast("double")).alias("x"))
    mean = e.groupBy("g").agg(V.average_direction(F.collect_list("x")).alias("m"))
    return mean.select("g", *[F.round(F.col("m")[k], 6).alias(f"x{k}") for k in range(3)])


QUERIES["q_average_direction"] = average_direction
SQL["q_average_direction"] = """WITH e AS (SELECT vec_id // 10 AS g, CAST(embedding[1] AS DOUBLE) AS a, CAST(embedding[2] AS DOUBLE) AS b, CAST(embedding[3] AS DOUBLE) AS c FROM embeddings),
    m AS (SELECT g, avg(a) AS a, avg(b) AS b, avg(c) AS c, max(a * a + b * b + c * c) AS most FROM e GROUP BY 1), z AS (SELECT *, CASE WHEN a * a + b * b + c * c >= 0.05 * most AND most > 0 THEN 1 ELSE 0 END AS ok FROM m)
    SELECT g, CASE WHEN ok = 1 THEN round(a, 6) ELSE 0e0 END AS x0, CASE WHEN ok = 1 THEN round(b, 6) ELSE 0e0 END AS x1, CASE WHEN ok = 1 THEN round(c, 6) ELSE 0e0 END AS x2 FROM z"""


def labels(spark, d):
    """Values cast where they can be, labels joined, rolling hashes and order of pairs of parts and lines."""
    parts = table(spark, d, "part")
    code = F.split_part("p_type", F.lit(" "), F.lit(1))
    low, high = R.ordered_pair(F.col("p_brand"), F.col("p_type"))
    mixed = F.when(F.col("p_partkey") % 3 == 0, F.col("p_size").cast("string")).otherwise(code)
    out = parts.select("p_partkey", R.cast_or_null(mixed, "int").alias("number"), graph.joined_label(F.array("p_brand", "p_type")).alias("hard"), graph.joined_label(F.array("p_brand", "p_type"), True).alias("soft"), low.alias("low"), high.alias("high"), hashing.rolling_hash_string("p_type").alias("rolling"))
    return out


QUERIES["q_label_functions"] = labels
SQL["q_label_functions"] = f"""WITH RECURSIVE t AS (SELECT DISTINCT p_type AS text FROM part),
    r AS (SELECT text, 0 AS i, CAST(0 AS HUGEINT) AS h, CAST({hashing.ROLL_A} AS HUGEINT) AS a FROM t UNION ALL SELECT text, i + 1, (h * a + ascii(substr(text, i + 1, 1))) % 4294967296, (a * {hashing.ROLL_B}) % 4294967296 FROM r WHERE i < len(text))
    SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN CAST(p_size AS INTEGER) END AS number, p_brand || '.' || p_type AS hard, p_brand AS soft, least(p_brand, p_type) AS low, greatest(p_brand, p_type) AS high, CAST(h % 2147483648 AS BIGINT) AS rolling FROM part JOIN r ON text = p_type AND i = len(text)"""


def norms(spark, d):
    """Lengths of models of the languages' letters, and of one that has none."""
    docs = I.sequences(spark, d).select(F.col("id").alias("instance_id"), "lang")
    n = I.letters(spark, d).join(docs, "instance_id").groupBy(F.col("lang").alias("model"), "fid").agg(F.avg("val").alias("w")).withColumn("level", F.lit(0))
    heads = n.select("model", "level").distinct().unionByName(spark.createDataFrame([("none", 0)], "model string, level int")).withColumn("wscale", F.lit(2.0))
    return model.model_norms(n, heads).select("model", "level", F.round("norm", 6).alias("norm"), "good")


QUERIES["q_model_norms"] = norms
SQL["q_model_norms"] = I.query(
    I.SEQ, I.LETTERS, "w AS (SELECT lang, fid, avg(val) AS w FROM letters JOIN seqs ON id = instance_id GROUP BY 1, 2)",
    final="SELECT lang AS model, 0 AS level, round(2 * sqrt(sum(w * w)), 6) AS norm, true AS good FROM w GROUP BY 1 UNION ALL SELECT 'none', 0, 0e0, false",
)
QUERIES["q_out_edges"] = lambda spark, d: graph.out_edge(table(spark, d, "lineitem").select((F.col("l_orderkey") % 100).alias("graph_id"), (F.col("l_suppkey") % 20).alias("src"), (F.col("l_partkey") % 20).alias("dst"), F.concat("l_returnflag", "l_linestatus").alias("label")))
SQL["q_out_edges"] = "SELECT l_orderkey % 100 AS graph_id, l_suppkey % 20 AS src, l_partkey % 20 AS dst, min(l_returnflag || l_linestatus) AS label FROM lineitem GROUP BY 1, 2, 3"


def dense(spark, d):
    """Arithmetic of dense vectors over embeddings."""
    e = I.table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    r = V.combine(V.resize(F.col("x"), 8), 2.0, V.add_constant(V.resize(F.reverse("x"), 8), 1.0), -0.5)
    return e.select("vec_id", F.round(V.dot(r, V.resize(F.col("x"), 8)), 6).alias("dot"), F.round(V.squared_norm(V.direction(F.col("x"))), 6).alias("one"))


QUERIES["q_dense_arithmetic"] = dense
SQL["q_dense_arithmetic"] = """WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings), r AS (SELECT vec_id, x, list_reverse(x) AS y FROM e)
    SELECT vec_id, round(list_sum([(2 * x[i] - 0.5 * (y[i] + 1)) * x[i] FOR i IN range(1, 9)]), 6) AS dot, 1e0 AS one FROM r"""
