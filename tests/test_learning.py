"""Scoring, training, evaluation and similarity on small inputs, against plain loops and known values."""

from __future__ import annotations

import hashlib

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandgraph import storage
from strandgraph.functions import vectors as V
from strandgraph.functions.residues import cast_or_null, loss, loss_slope, ordered_pair
from strandgraph.operators import metrics, model, similarity, train
from strandgraph.plans import inputs, search


def _features(spark, x):
    return spark.createDataFrame([(i, j, float(v)) for i, row in enumerate(x) for j, v in enumerate(row) if v], "instance_id long, fid long, val double")


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(120, 5))
    y = np.where(x[:, 0] + 0.5 * x[:, 1] > 0, 1, -1)
    targets = spark.createDataFrame([(i, int(v)) for i, v in enumerate(y)], "instance_id long, y int")
    return x, y, _features(spark, x).cache(), targets.cache()


@pytest.mark.parametrize("counts,want", [((12011, 0, 13, 4269), (0.999459, 0.99848, 0.998969)), ((3988, 0, 20, 1423), (0.997499, 0.993022, 0.995260))])
def test_known_measures(spark, counts, want):
    pairs = spark.createDataFrame([(1, 1, counts[0]), (-1, 1, counts[1]), (1, -1, counts[2]), (-1, -1, counts[3])], "y int, prediction int, n int")
    row = metrics.confusion(pairs.select("y", "prediction", F.explode(F.sequence(F.lit(1), "n")).alias("k")) if counts[1] else pairs.where("n > 0").select("y", "prediction", F.explode(F.expr("sequence(1, n)")).alias("k"))).first()
    assert (row.tp, row.fp, row.fn, row.tn) == counts
    assert (row.p_f, row.n_f, row.balanced_f) == pytest.approx(want, abs=1e-6)


def test_measures_without_a_class(spark):
    row = metrics.confusion(spark.createDataFrame([(1, 1), (1, 0)], "y int, prediction int")).first()
    assert row.abstained == 1 and row.p_precision == 1 and row.n_f is None and row.balanced_f is None


def test_statistics(spark):
    values = [4.0, -1.0, 1.0, 9.0, 3.0, 3.0, None]
    row = metrics.statistics(spark.createDataFrame([(v,) for v in values], "v double"), "v").first()
    kept = sorted(v for v in values if v not in (None, -1.0))
    assert (row.num, row.total, row.least, row.most, row.q50, row.q75) == (5, 20.0, 1.0, 9.0, kept[2], kept[3])
    assert row.sd == pytest.approx(np.std(kept, ddof=1)) and row.mad == sorted(abs(v - kept[2]) for v in kept)[2]


def test_losses_match_their_slopes(spark):
    z = [x / 7 for x in range(-30, 31)]
    rows = spark.createDataFrame([(v,) for v in z], "z double")
    for kind in ("log", "log_margin", "smooth_hinge", "squared_hinge", "hinge"):
        a = rows.select(loss(F.col("z"), kind), loss(F.col("z") + 1e-6, kind), loss_slope(F.col("z") + 5e-7, kind)).collect()
        assert all(p - q == pytest.approx(1e-6 * s, abs=1e-9) for p, q, s in a), kind
    with pytest.raises(ValueError):
        loss(F.col("z"), "other")


def test_descent_against_a_plain_loop(spark, points):
    x, y, feats, targets = points
    opts = train.Options(epochs=2)
    w, bias, _ = train.descend([np.arange(5)] * 120, list(x), y.astype(float), np.arange(120), 5, opts)
    v, b, t = np.zeros(5), 0.0, math.sqrt(1 / math.sqrt(opts.lam))
    t = 1 / (t * opts.lam)
    for _ in range(2):
        for i in range(120):
            rate = 1 / (opts.lam * t)
            v *= 1 - rate * opts.lam
            if y[i] * (v @ x[i] + b) < 1:
                v, b = v + rate * y[i] * x[i], b + 0.01 * rate * y[i]
            t += 1
    assert np.allclose(w, v) and bias == pytest.approx(b)
    table = train.sgd(feats, targets.select(F.lit(0).alias("model"), "instance_id", "y", F.col("instance_id").alias("slot")), options=opts)
    got = {r.fid: r.w for r in table.collect()}
    assert [got[k] for k in range(5)] == pytest.approx(list(v)) and got[-1] == pytest.approx(b)


def test_regulariser_evens_out_the_weights_of_a_vertex(points):
    _, _, feats, targets = points
    rows = targets.select(F.lit(0).alias("model"), "instance_id", "y", F.col("instance_id").alias("slot"))
    parts = feats.where("fid < 2").withColumn("vid", F.lit(1)).unionByName(feats.where("fid = 2").withColumn("vid", F.lit(2)))
    plain = {r.fid: r.w for r in train.sgd(feats, rows, options=train.Options(epochs=4)).collect()}
    drawn = {r.fid: r.w for r in train.sgd(feats, rows, options=train.Options(epochs=4, regulariser=1e-3), parts=parts).collect()}
    assert plain != drawn and drawn.keys() == plain.keys() and all(abs(v) < 1e4 for v in drawn.values())


def test_cross_validation_and_curve_learn(points):
    _, _, feats, targets = points
    cv = train.cross_validation(feats, targets, train.Options(folds=4, epochs=5)).collect()
    assert len(cv) == 120 and sum(r.y == r.prediction for r in cv) > 105
    sizes = [sum(r.fold == f and r.y == c for r in cv) for c in (1, -1) for f in range(4)]
    assert max(sizes[:4]) - min(sizes[:4]) <= 1 and max(sizes[4:]) - min(sizes[4:]) <= 1
    curve = train.learning_curve(feats, targets, train.Options(points=4, epochs=5)).collect()
    assert {r.point for r in curve} == {1, 2, 3} and len(curve) == 3 * 30
    assert sum((r.margin >= 0) == (r.y > 0) for r in curve if r.point == 3) >= 26


@pytest.mark.parametrize("apart", [1, train.SHUFFLE, 911])
def test_folds_and_copies_are_those_of_folds_and_balanced(spark, apart, monkeypatch):
    """Also for ids whose keys are all the same; rows are dealt out once, and only the sizes of parts are written."""
    rows = spark.range(900).selectExpr(f"id * {apart} AS instance_id", "CAST(IF(id % 7 < 2 OR id > 800, 1, -1) AS INT) AS y")
    wrote = []
    monkeypatch.setattr(train, "materialize", lambda df, name: wrote.append(name) or storage.materialize(df, name))
    got = {r.instance_id: (r.fold, r.copies) for r in train.folds_and_copies(rows, 4, seed=3).collect()}
    assert wrote == ["parts"]
    fold = {r.instance_id: r.fold for r in train.folds(rows, 4, seed=3).collect()}
    copies = {r.instance_id: r["count"] for r in train.balanced(rows, seed=3).groupBy("instance_id").count().collect()}
    assert got == {i: (fold[i], copies[i]) for i in fold} and len(got) == 900


def test_balance(spark):
    rows = spark.createDataFrame([(i, 1 if i < 7 else -1) for i in range(10)] + [(99, 0)], "instance_id long, y int")
    got = train.balanced(rows).collect()
    assert sum(r.y > 0 for r in got) == sum(r.y < 0 for r in got) == 7 and sorted(r.slot for r in got) == list(range(14))
    assert all((r.y > 0) == (r.slot % 2 == 0) for r in got)


def test_cascade_training_leaves_the_undecided(points):
    _, _, feats, targets = points
    w, limits = train.cascade_train([feats, feats], targets, train.Options(epochs=3))
    rows = {r.level: r for r in limits.collect()}
    assert rows[0].neg_thr < 0 < rows[0].pos_thr and rows[1].pos_thr == rows[1].neg_thr == 0
    assert {r.level for r in w.select("level").distinct().collect()} == {0, 1}


def test_self_training_and_negatives(points):
    _, y, feats, targets = points
    some = targets.withColumn("y", F.when(F.col("instance_id") % 4 == 0, F.col("y")).otherwise(0))
    w = {r.fid: r.w for r in train.self_training(feats, some, train.Options(rounds=2, quantile=0.5, epochs=4)).collect()}
    assert w[0] > abs(w[3]) and w[0] > 0
    made = train.one_class_negatives(feats).collect()
    real = {(r.fid, r.val) for r in feats.collect()}
    assert all(r.instance_id < 0 and (r.fid, r.val) in real for r in made) and len({r.instance_id for r in made}) == 120
    for wrong in ({"action": "NO"}, {"only_positive": True, "only_negative": True}, {"folds": 1}):
        with pytest.raises(ValueError):
            train.Options(**wrong)


def test_averaged_descent_over_shards(spark, points):
    x, y, feats, targets = points
    opts = train.Options(epochs=30, lam=0.05)
    rows = targets.select(F.lit("m").alias("model"), "instance_id", "y", F.col("instance_id").alias("slot"))
    got = {r.fid: r.w for r in train.sgd(feats, rows, options=opts, shard=30).collect()}
    cost = lambda w, b: opts.lam / 2 * w @ w + np.maximum(0, 1 - y * (x @ w + b)).mean()
    w, b, best = np.zeros(5), 0.0, np.inf
    for t in range(1, 20_000):  # the optimum, by subgradients of the whole cost
        off = y * (x @ w + b) < 1
        w, b = w - (opts.lam * w - (y[off, None] * x[off]).sum(0) / 120) / (opts.lam * t), b + y[off].sum() / 120 / (100 * opts.lam * t)
        best = min(best, cost(w, b))
    assert cost(np.array([got[k] for k in range(5)]), got[-1]) < 1.05 * best
    with pytest.raises(Exception, match="no target"):
        train.sgd(feats, rows.withColumn("y", F.lit(0)), options=opts)
    plain = {r.fid: r.w for r in train.sgd(feats, rows, options=opts).collect()}
    assert plain.keys() == got.keys() and plain != got
    with pytest.raises(ValueError):
        old, train.LARGEST = train.LARGEST, 4
        try:
            train.sgd(feats, rows, options=opts)
        finally:
            train.LARGEST = old


def test_averages_weigh_shards_by_their_items(spark):
    r = np.random.default_rng(8)
    x, y = r.normal(size=(50, 3)), np.where(r.random(50) < 0.5, 1, -1)
    feats = spark.createDataFrame([(i, k, float(v)) for i, row in enumerate(x) for k, v in enumerate(row) if k < 2 or i % 7 == 0], "instance_id long, fid long, val double")
    rows = spark.createDataFrame([(m, "a", i, int(y[i]), 49 - i) for m in (1, 2) for i in range(50) if m == 1 or i < 9], "m int, n string, instance_id long, y int, slot int")
    opts = train.Options(epochs=3)
    got = {}
    for v in train.sgd(feats, rows, ["m", "n"], opts, shard=20).collect():
        got.setdefault((v.m, v.n), {})[v.fid] = v.w
    place = {i: s for i, s in rows.where("m = 1").select("instance_id", F.pmod(F.xxhash64("instance_id", F.lit(opts.seed)), F.lit(3))).collect()}
    for model, items, shards in ((1, range(50), 3), (2, range(9), 1)):
        w, b = np.zeros(3), 0.0
        for epoch in range(3):
            parts = []
            for s in range(shards):
                mine = [i for i in reversed(items) if shards == 1 or place[i] == s]
                d = train.Descent(w.copy(), b, epoch * len(items) / shards, opts)
                for i in mine:
                    kept = np.array([0, 1, 2] if i % 7 == 0 else [0, 1])
                    d.step(kept, x[i][kept], float(y[i]))
                parts.append((len(mine), d.fold(), d.bias))
            w, b = sum(n * v for n, v, _ in parts) / len(items), sum(n * c for n, _, c in parts) / len(items)
        assert [got[model, "a"][k] for k in range(3)] == pytest.approx(list(w)) and got[model, "a"][-1] == pytest.approx(b)


def test_scoring_decisions_and_cascade(spark):
    feats = spark.createDataFrame([(1, 5, 2.0), (2, 6, 1.0)], "instance_id long, fid long, val double")
    weights = spark.createDataFrame([("m", 0, 5, 0.5), ("m", 1, 6, -3.0)], "model string, level int, fid long, w double")
    models = spark.createDataFrame([("m", 0, 0.1, 1.0, 0.5, -0.5), ("m", 1, 0.1, 2.0, 0.0, 0.0)], "model string, level int, bias double, wscale double, pos_thr double, neg_thr double")
    every = spark.createDataFrame([(1,), (2,), (3,)], "instance_id long")
    scored = model.margins(feats, weights, models, every)
    assert {(r.instance_id, r.level): r.margin for r in scored.collect()} == pytest.approx({(1, 0): 1.1, (2, 0): 0.1, (3, 0): 0.1, (1, 1): 0.1, (2, 1): -5.9, (3, 1): 0.1})
    assert {r.instance_id: (r.level, r.prediction) for r in model.cascade(scored).collect()} == {1: (0, 1), 2: (1, -1), 3: (1, 1)}
    assert {(r.level, r.norm, r.good) for r in model.model_norms(weights, models).collect()} == {(0, 0.5, True), (1, 6.0, True)}
    wide = model.score_table(scored.where("level = 0"), ["m"]).collect()
    assert {r.instance_id: round(r.model_m, 3) for r in wide} == {1: 1.1, 2: 0.1, 3: 0.1}


def test_thresholds_at_the_edges(spark):
    one = lambda *x: spark.createDataFrame([("m", float(v), 1 if v > 0 else -1) for v in x], "model string, margin double, y int")
    assert model.proportional_thresholds(one(-2, -1)).first()[1:] == (-1.0, -1.0)
    assert model.proportional_thresholds(one(1, 2, 3)).first()[1:] == (1.0, 1.0)
    assert model.proportional_thresholds(one(-2, -1, 1, 2)).first()[1:] == (2.0, -1.0)
    row = model.performance_thresholds(one(-2, -1, 1, 2), 0.9).first()
    assert row.balanced_f == 1 and row.share <= 1


def test_dense_and_sparse_vectors(spark):
    r = spark.createDataFrame([([1.0, 2.0, 2.0], [2.0, 0.0, 1.0], [0.0, 1.0, 0.0])], "a array<double>, b array<double>, m array<double>").select(
        V.dot(F.col("a"), F.col("b")), V.squared_norm(F.col("a")), V.add(F.col("a"), F.col("b"), 2.0), V.add_masked(F.col("a"), F.col("b"), F.col("m")), V.resize(F.col("a"), 5), V.resize(F.col("a"), 2),
        V.direction(F.col("a")), V.agreement(F.col("a"), F.col("b")), V.combine(F.col("a"), 2.0, F.col("b"), -1.0), V.add_constant(F.col("a"), 1.0), V.average_direction(F.array("a", "b")), ordered_pair(F.lit(2), F.lit(1))[0], cast_or_null(F.lit("x"), "int"),
    ).first()
    assert tuple(r) == (4.0, 9.0, [5.0, 2.0, 4.0], [1.0, 2.0, 2.0], [1.0, 2.0, 2.0, 0.0, 0.0], [1.0, 2.0], [1 / 3, 2 / 3, 2 / 3], 3, [0.0, 4.0, 3.0], [2.0, 3.0, 3.0], [1.5, 1.0, 1.5], 1, None)
    feats = spark.createDataFrame([(1, 4, 2.0), (1, 2, 1.0), (1, 9, 0.0)], "instance_id long, fid long, val double")
    packed = V.pack(feats, "instance_id")
    row = packed.select(V.component(F.col("pairs"), F.lit(4)), V.component(F.col("pairs"), F.lit(5)), F.size(V.with_component(F.col("pairs"), 5, 1.0)), F.size(V.with_component(F.col("pairs"), 4, 0.0)), F.size(V.between(F.col("pairs"), 3, 9)), F.size(V.trimmed(F.col("pairs"), 1.5)), V.sparse_dense_dot(F.col("pairs"), F.array(*map(F.lit, [0.0, 0.0, 3.0, 0.0, 5.0])))).first()
    assert tuple(row) == (2.0, 0.0, 3, 1, 1, 1, 13.0)
    assert V.unpack(packed, "instance_id").count() == 2


def test_set_density_takes_every_pair_of_members(spark, tmp_path):
    x = np.random.default_rng(5).normal(size=(150, 8))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    rows.write.parquet(str(tmp_path / "embeddings.parquet"))
    full, want = np.round(x @ x.T, 6), {}
    for i in range(150):
        near = np.lexsort((np.arange(150), -full[i]))[:5]
        want[i] = np.mean([full[a, b] for a in near for b in near if a != b])
    got = search.set_density(spark, str(tmp_path)).collect()
    assert {r.u: r.density for r in got} == pytest.approx(want, abs=1e-7)


def test_lsh_candidates_are_all_pairs_of_two_common_bins(spark, tmp_path):
    texts = [("a", "ACDEFGHIKLMNPQRSTVWYACWWLLKK"), ("b", "GGGGGGGGGGGGGGGGGGGG"), ("c", "ACDEFGHIKLGGGGGGGGGG")]
    spark.createDataFrame(texts, "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    bins = {}
    for r in similarity.signatures(inputs.vectors(spark, str(tmp_path)), 30).collect():
        bins.setdefault(r.instance_id, set()).add((r.k, r.minhash))
    want = {(u, v): len(bins[u] & bins[v]) for u in bins for v in bins if len(bins[u] & bins[v]) >= 2}
    assert any(n < 15 for n in want.values())
    assert {(r.u, r.v): r.shared for r in search.QUERIES["q_lsh_candidates"](spark, str(tmp_path)).collect()} == want


def test_neighbours_and_density(spark, points):
    x, _, feats, _ = points
    k = np.round(x @ x.T, 6)
    want = {u: [int(v) for v in np.lexsort((np.arange(120), -k[u]))[:4]] for u in range(120)}
    got = {}
    for r in similarity.true_neighbours(feats, 4).orderBy("u", "rank").collect():
        got.setdefault(r.u, []).append(r.v)
    assert got == want
    dense = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "vec_id long, embedding array<double>")
    near = similarity.dense_neighbours(dense, dense, 4, block=32).cache()
    again = {}
    for r in near.orderBy("u", "rank").collect():
        again.setdefault(r.u, []).append(r.v)
    assert again == want
    density = {r.vec_id: r.density for r in similarity.dense_density(dense).collect()}
    full = x @ x.T
    assert density == pytest.approx({i: (full[i].sum() - full[i, i]) / 119 for i in range(120)})
    alone = similarity.dense_density(dense.limit(1)).first()
    assert alone.density is None
    local = similarity.neighbourhood_density(near)
    order = sorted(local.collect(), key=lambda r: (-round(r.density, 6), r.u))
    taken, seen = [], set()
    for r in order:
        if len(taken) < 5 and not seen & set(want[r.u]):
            taken.append(r.u)
            seen |= set(want[r.u])
    assert [r.centre for r in similarity.density_centres(near, local, 5, 0).orderBy("rank").collect()] == taken
    assert similarity.clusters(similarity.density_centres(near, local, 5, 0), near).count() == 4 * len(taken)
    assert similarity.sampled_centres(local.withColumn("density", F.abs("density")), 5).count() == 5


@pytest.mark.parametrize("sample,growth", [(4, 2), (4, 100), (7, 3)])
def test_greedy_centres_against_a_plain_loop(spark, sample, growth):
    r = np.random.default_rng(3)
    x, density = r.normal(size=(90, 5)), r.random(90).round(2)
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    known = spark.createDataFrame([(i, float(d)) for i, d in enumerate(density)] + [(90, None)], "u long, density double")
    restarts, seed = 6, 9
    orders = spark.range(90).withColumn("start", F.explode(F.sequence(F.lit(0), F.lit(restarts - 1)))).select("id", "start", F.xxhash64("id", "start", F.lit(seed)).alias("h")).collect()
    alike = lambda ids: np.mean([x[a] @ x[b] for a in ids for b in ids])
    best = None
    for k in range(restarts):
        order = [o.id for o in sorted((o for o in orders if o.start == k), key=lambda o: (o.h, o.id))]
        ids = order[:sample]
        for i in order[sample:]:
            worst = min(ids, key=lambda j: (density[j], j))
            if density[i] > density[worst]:
                other = [j for j in ids if j != worst] + [i]
                draw = (int.from_bytes(hashlib.blake2b(f"{seed} {i} {k}".encode(), digest_size=8).digest()) >> 11) / (1 << 53)
                if draw < 1 - (k + 1) / restarts or alike(other) < alike(ids):
                    ids = other
        if best is None or alike(ids) < alike(best) and density[ids].sum() > density[best].sum():
            best = ids
    got = similarity.greedy_centres(known, vectors, sample, restarts, seed, growth).orderBy("rank").collect()
    assert [g.centre for g in got] == sorted(best, key=lambda j: (-density[j], j))


def test_density_centres_in_small_batches(spark):
    near = spark.createDataFrame([(u, v) for u in range(40) for v in (u, (u + 1) % 40)], "u long, v long")
    density = spark.createDataFrame([(u, 1.0 - u / 100) for u in range(40)], "u long, density double")
    for batch in (1, 3, 1000):
        got = similarity.density_centres(near, density, 6, 0, batch=batch).orderBy("rank").collect()
        assert [g.centre for g in got] == [0, 2, 4, 6, 8, 10]
    assert similarity.density_centres(near, density, 100, 0, 0.5).count() == 10


def test_one_class_negatives_in_any_ratio(spark):
    feats = spark.createDataFrame([(i, f, float(f)) for i in range(200) for f in range(3 + i % 2)], "instance_id long, fid long, val double")
    for ratio, least, most in ((0.25, 30, 70), (1.0, 200, 200), (2.5, 480, 520), (3.0, 600, 600)):
        made = train.one_class_negatives(feats, ratio)
        assert least <= made.select("instance_id").distinct().count() <= most and made.where("instance_id >= 0").count() == 0


def test_bins_and_candidates(spark):
    feats = spark.createDataFrame([(i, f, 1.0) for i, fs in enumerate([(1, 2, 3), (1, 2, 3), (7, 8, 9), (2, 3, 50)]) for f in fs], "instance_id long, fid long, val double")
    sig = similarity.signatures(feats, 20)
    assert sig.count() == 80
    shared = {(r.u, r.v): r.shared for r in similarity.shared_bins(sig).collect()}
    assert shared[0, 1] == shared[0, 0] == 20 and (0, 2) not in shared
    assert {(r.u, r.v): r.shared for r in similarity.shared_features(feats).collect()}[0, 3] == 2
    near = similarity.approximate_neighbours(feats, 2, 20).where("u = 0").orderBy("rank").collect()
    assert [r.v for r in near] == [0, 1]
    labels = spark.createDataFrame([(0, "b"), (1, "a"), (2, "a"), (3, "c")], "instance_id long, label string")
    assert {r.u: r.prediction for r in similarity.vote(similarity.true_neighbours(feats, 2), labels).collect()}[0] == "a"


def test_dataset_splits_against_a_plain_loop(spark):
    r = np.random.default_rng(4)
    x, label = r.normal(size=(80, 4)).round(1), r.integers(0, 10, 80)
    rows = [(i, v.tolist(), None if i % 11 == 0 else 1 if label[i] < 2 else -1) for i, v in enumerate(x)]
    train_set = spark.createDataFrame(rows + [(900, None, 1)], "vec_id long, embedding array<double>, y int").repartition(5)
    tests = train_set.where("vec_id % 2 = 1").drop("y").unionByName(spark.createDataFrame([(901, None)], "vec_id long, embedding array<double>"))
    k = np.round(x @ x.T, 6)
    want = []
    for c in sorted((i for i in range(80) if i % 2), key=lambda i: (-i % 13, i)):
        order = np.lexsort((np.arange(80), -k[c]))
        run, p, m = None, 0, 0
        for place, v in enumerate(order, 1):
            p, m = p + (rows[v][2] == 1), m + (rows[v][2] == -1)
            if p < 1.5 * m and 1.5 * p > m:
                run = place, float(k[c][v]), p, m
        near = [i for i in range(1, 80, 2) if run and k[c][i] >= run[1]]
        if run and run[0] > 6 and len(near) > 6:
            want.append((c, len(want) + 1, *run, len(near)))
    assert 5 < len(want) < 40 and len({w[2] for w in want}) > 3
    for centres, batch in ((5, 2), (5, 100), (100, 3)):
        got = similarity.dataset_splits(train_set, tests, ["pmod(-vec_id, 13)"], centres, 6, batch=batch)
        assert sorted(map(tuple, got.collect()), key=lambda g: g[1]) == want[:centres]
    ids = {}
    for g in similarity.split_ids(got, train_set, tests).collect():
        ids.setdefault((g.centre, g.part), set()).add(g.id)
    assert ids == {(w[0], part): {i for i in range(start, 80, step) if k[w[0]][i] >= w[3]} for w in want for part, start, step in (("train", 0, 1), ("test", 1, 2))}
    assert similarity.dataset_splits(train_set, tests, ["vec_id"], 5, 1000).count() == 0 and similarity.dataset_splits(train_set, tests.limit(0), ["vec_id"]).count() == 0


def test_density_centres_against_the_walk(spark):
    r = np.random.default_rng(6)
    near = {u: {u, *map(int, r.integers(0, 150, 4)), *([7] if u % 3 == 0 else [])} for u in range(150)}
    density = r.random(150).round(2)
    lists = spark.createDataFrame([(u, v) for u, vs in near.items() for v in vs], "u long, v long")
    known = spark.createDataFrame([(u, float(d)) for u, d in enumerate(density)] + [(500, None), (501, 2.0)], "u long, density double")
    for sample, overlap, batch, few in ((12, 0, 10, 200), (12, 1, 40, 0), (1000, 2, 1000, 100)):
        taken, seen = [], set()
        for u in sorted(range(150), key=lambda u: (-density[u], u)):
            if len(taken) < sample and len(seen & near[u]) <= overlap:
                taken.append(u)
                seen |= near[u]
        got = similarity.density_centres(lists, known, sample, overlap, batch=batch, few=few).orderBy("rank").collect()
        assert [(g.centre, g.rank) for g in got] == [(u, i + 1) for i, u in enumerate(taken)]


def test_sums_of_vectors(spark):
    rows = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, -2.0]), (3, None)], "vec_id long, embedding array<double>").repartition(3)
    assert similarity.vector_sum(rows).first()[:] == (2, [4.0, 0.0])
    assert {r.vec_id: r.similarity for r in similarity.similarity_to_set(rows, rows.where("vec_id = 2")).collect()} == {1: -1.0, 2: 13.0}
    assert similarity.similarity_to_set(rows, rows.limit(0)).count() == 0 and similarity.vector_sum(rows.limit(0)).count() == 0


@pytest.mark.parametrize("size", [3, 1000])
def test_meetings_of_long_lists(spark, size):
    r = np.random.default_rng(2)
    rows = [(int(k), int(i), float(k * 100 + i)) for k, n in ((1, 40), (2, 5), (3, 1)) for i in r.permutation(60)[:n]] + [(None, 1, 0.0)]
    met = similarity.meetings(spark.createDataFrame(rows, "k long, id long, v double"), ["k"], "id", "v", size).collect()
    of = {k: sorted(i for kk, i, _ in rows if kk == k) for k in (1, 2, 3)}
    want = sorted((k, a, b) for k, ids in of.items() for x, a in enumerate(ids) for b in ids[x:])
    assert sorted((m.k, m.u, m.v) for m in met) == want
    assert all(m.x == m.k * 100 + m.u and m.y == m.k * 100 + m.v for m in met)


def test_long_lists_are_spread(spark):
    rows = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), "id")
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    for k, v in zip(old, ("8", "false", "-1"), strict=True):
        spark.conf.set(k, v)
    try:
        met = similarity.meetings(rows, ["k"], "id", size=50)
        sizes = sorted(r["count"] for r in met.groupBy(F.spark_partition_id().alias("p")).count().collect())
        assert len(sizes) == 8 and sum(sizes) == 1000 * 1001 // 2 + 2000 and sizes[-1] < 2 * sizes[4]
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


@pytest.mark.parametrize("threshold", [0.3, 0.9, 2.0])
def test_kernels_above_a_threshold(spark, threshold):
    r = np.random.default_rng(7)
    rows = [(i, int(f), float(r.normal() if f % 2 else r.random())) for i in range(60) for f in {0, *map(int, r.zipf(1.5, 6) % 40)}] + [(99, 1, 0.0)]
    feats = spark.createDataFrame(rows, "instance_id long, fid long, val double")
    x = np.zeros((100, 40))
    for i, f, v in rows:
        x[i, f] = v
    k = np.round(x @ x.T, 6)
    got = {(g.u, g.v): g.k for g in similarity.kernel_above(feats, threshold).collect()}
    assert got == {(u, v): k[u, v] for u in range(100) for v in range(u, 100) if k[u, v] >= threshold}
    with pytest.raises(ValueError):
        similarity.kernel_above(feats, 0.0)


def test_cells_spare_queries_what_cannot_be_near(spark):
    r = np.random.default_rng(1)
    centres = r.normal(size=(12, 6)) * 10
    x = (centres[r.integers(0, 12, 300)] + r.normal(size=(300, 6)) * 0.3).round(3)
    x[7] = x[8] = x[9]
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(999, None)], "vec_id long, embedding array<double>")
    k = np.round(x @ x.T, 6)
    for cells, block, most in ((12, 50, 0.5), (40, 7, 0.5), (1, 1000, 1.0)):
        got = {}
        for g in similarity.dense_neighbours(vectors, vectors, 5, block=block, cells=cells).collect():
            got.setdefault(g.u, {})[g.rank] = (g.v, g.k)
        assert got == {u: {n + 1: (int(v), k[u, v]) for n, v in enumerate(np.lexsort((np.arange(300), -k[u]))[:5])} for u in range(300)}
        parted = similarity.Cells(vectors.where("embedding IS NOT NULL").withColumnsRenamed({"vec_id": "id", "embedding": "v"}), block, cells)
        kth = np.sort(k, 1)[:, -5]
        asked = spark.createDataFrame([(i, v.tolist(), float(kth[i])) for i, v in enumerate(x)], "qid long, qv array<double>, least double")
        met = sum(parted.sizes[v.cell] for own in (True, False) for v in parted.visits(asked, own).collect())
        assert met <= most * 300 * 300
    assert similarity.dense_neighbours(vectors, vectors.limit(0), 5).count() == 0


def test_least_hashes_shuffle_features_once(spark):
    """The hashes of an instance are made after the one shuffle, not thirty rows for each feature before it (q_minhash_signature, q_bin_sizes)."""
    feats = spark.createDataFrame([(i, f) for i in range(20) for f in (i, i + 1, i % 3, i)], "instance_id long, fid long")
    made = similarity.signatures(feats, 30)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.index("Generate") < plan.index("Exchange")
    assert made.count() == 600


def test_statistics_of_weighted_values(spark):
    """A value counts as often as its weight says: what the values one by one give (q_bin_statistics)."""
    values = [(1.5, 3), (2.0, 1), (7.0, 5), (9.25, 2)]
    one = spark.createDataFrame([(v,) for v, n in values for _ in range(n)], "x double")
    got = metrics.statistics(spark.createDataFrame(values, "x double, n long"), "x", weight="n").first().asDict()
    want = metrics.statistics(one, "x").first().asDict()
    assert got == pytest.approx(want)


def test_runs_go_on_from_one_another(spark):
    """A model of many runs is the plain loop's, item by item (q_sgd_train_cv and q_learning_curve beyond 100,000 items)."""
    rng = np.random.default_rng(3)
    x, y = rng.random((95, 4)), rng.choice([-1, 1], 95)
    feats = spark.createDataFrame([(i, f, float(x[i, f])) for i in range(95) for f in range(4)], "instance_id long, fid long, val double")
    rows = spark.createDataFrame([(m, i, int(y[i]), (i * 37) % 95) for m, n in ((0, 95), (1, 41)) for i in range(n)], "model int, instance_id long, y int, slot int")
    got = {(r.model, r.fid): r.w for r in train.sgd(feats, rows, options=train.Options(epochs=3), run=20).collect()}
    for m, n in ((0, 95), (1, 41)):
        order = np.array(sorted(range(n), key=lambda i: (i * 37) % 95))
        w, b, _ = train.descend([np.arange(4)] * n, list(x[:n]), y[:n], order, 4, train.Options(epochs=3))
        assert [got[m, f] for f in range(4)] == pytest.approx(list(w)) and got[m, -1] == pytest.approx(b)


def test_visits_hand_on_no_more_rows_than_came_in(spark):
    """A query's visits go cell by cell, its vector in the input's precision (q_knn_vote: batches times cells in a worker)."""
    rng = np.random.default_rng(1)
    made = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=3).astype(np.float32)]) for i in range(60)], "vec_id long, embedding array<float>")
    parted = similarity.Cells(made.withColumnsRenamed({"vec_id": "id", "embedding": "v"}), 10, 6)
    asked = made.selectExpr("vec_id AS qid", "embedding AS qv", "CAST(NULL AS DOUBLE) AS least").coalesce(1)
    visits = parted.visits(asked, False)
    assert visits.schema["qv"].dataType.simpleString() == "array<float>"
    cells = [r.cell for r in visits.collect()]
    assert cells == sorted(cells) and len(cells) == 5 * 60
    rows = {r.vec_id: np.array(r.embedding, float) for r in made.collect()}
    for g in similarity.dense_neighbours(made, made, 4, block=10, cells=6).groupBy("u").agg(F.sort_array(F.collect_list(F.struct("rank", "v"))).alias("n")).collect():
        assert [n.v for n in g.n] == sorted(rows, key=lambda v: (-round(rows[g.u] @ rows[v], 6), v))[:4]


def test_copies_of_sets_meet_as_one(spark):
    """Candidates of equal sets are found once: what all pairs of shared bins give, trimmed (q_data_filter, q_approx_knn)."""
    rows = [(i, f) for i in range(90) for f in range(i % 7, i % 7 + 4)] + [(90, 2), (90, 40)]
    feats = spark.createDataFrame(rows, "instance_id long, fid long").withColumn("val", F.lit(0.5))
    key = lambda df: sorted(tuple(r) for r in df.select("u", "v", "shared", "place").collect())
    assert key(similarity.nearest_bins(feats, 6, 12)) == key(similarity.trimmed(similarity.shared_bins(similarity.signatures(feats, 12)), 6, 1))
    assert similarity.alike(feats).select("class").distinct().count() == 8

@pytest.mark.parametrize("side", [7, 1000])
def test_pairs_in_blocks_are_those_of_the_join(spark, side):
    """q_kernel_matrix, q_lsh_candidates: pairs of common lists make no row for each shared feature; results as by the join."""
    rng = np.random.default_rng(3)
    rows = [(f"g{i}", int(f), float(v)) for i in range(40) for f, v in zip(rng.choice(12, 5), rng.normal(size=5), strict=True)]  # repeated ones too
    rows += [("alone", 99, 0.5), ("zero", 3, 0.0)]
    feats = spark.createDataFrame(rows, "instance_id string, fid long, val double")
    want = similarity.meetings(feats, ["fid"], "instance_id", "val").groupBy("u", "v").agg(F.sum(F.col("x") * F.col("y")).alias("k"), F.count("*").alias("n")).collect()
    got = similarity.in_blocks(feats.select("instance_id", F.col("fid").alias("f"), F.col("val").alias("x")), "instance_id", 2, side).collect()
    assert {(r.u, r.v): r.shared for r in got} == {(r.u, r.v): r.n for r in want if r.n >= 2} and len(got) == len({(r.u, r.v) for r in got})
    kernels = {(r.u, r.v): r.k for r in want}
    assert all(abs(kernels[r.u, r.v] - r.k) < 1e-12 for r in got)
    assert similarity.crowded(feats, ["fid"], "instance_id")
    plan = similarity.kernel(feats)._jdf.queryExecution().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "Join" not in plan
    assert similarity.in_blocks(feats.select("instance_id", F.col("fid").alias("f"), F.col("val").alias("x")), "instance_id", 2, side).agg(F.count("u")).first()[0] == len(got)


def test_two_shared_features_are_found_by_pairs_of_features(spark):
    """q_inverted_index_candidates: no row is made for pairs that share one feature; long sets and repeated rows as by the join."""
    rng = np.random.default_rng(5)
    sets = {i: rng.choice(60, int(n), replace=False).tolist() for i, n in enumerate(rng.integers(1, 8, 60))}
    sets |= {100: list(range(40)), 101: list(range(20, 50)), 102: sets[5], 103: [200]}
    feats = spark.createDataFrame([(i, int(f)) for i, fs in sets.items() for f in [*fs, fs[0]]], "instance_id long, fid long")
    got = similarity.shared_features(feats)
    want = {(a, b): len(set(x) & set(y)) for a, x in sets.items() for b, y in sets.items() if len(set(x) & set(y)) >= 2}
    rows = got.collect()
    assert {(r.u, r.v): r.shared for r in rows} == want and len(rows) == len(want)
    apart = spark.createDataFrame([(i, f) for i in range(300) for f in (7, 1000 + i)], "instance_id long, fid long")  # 44,850 pairs share one
    met = []
    kept, similarity.meetings = similarity.meetings, lambda *a, **k: met.append(kept(*a, **k)) or met[-1]
    try:
        assert similarity.shared_features(apart).count() == 300
    finally:
        similarity.meetings = kept
    assert sum(m.count() for m in met) == 0


def test_vectors_are_copied_no_oftener_with_more_cells(spark):
    """q_true_knn and those that use it: 40 cells without structure, and what is shuffled to other cells is six copies at most."""
    rng = np.random.default_rng(11)
    x = rng.normal(size=(400, 6)).astype(np.float32)
    made = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    kept, seen = similarity.Cells.sweep, []
    similarity.Cells.sweep = lambda self, homes, k: seen.append((homes, self)) or kept(self, homes, k)
    try:
        got = {(r.u, r.rank): r.v for r in similarity.dense_neighbours(made, made, 4, block=10, cells=40).collect()}
    finally:
        similarity.Cells.sweep = kept
    exact = np.round(x.astype(float) @ x.astype(float).T, 6)
    assert got == {(u, i + 1): int(v) for u in range(400) for i, v in enumerate(np.lexsort((np.arange(400), -exact[u]))[:4])}
    (homes, parted), = seen
    assert len(parted.parts) > 20 and parted.deal(homes).count() <= 400 * 2 * similarity.TASKS
    assert similarity.dense_neighbours(made.limit(0), made, 4, block=100, cells=4).count() == 0


@pytest.mark.parametrize("kind,lam", [("hinge", 1e-4), ("hinge", 2.0), ("squared_hinge", 0.05), ("smooth_hinge", 1e-4), ("log", 1e-2), ("log_margin", 1e-4)])
def test_blocks_learn_as_single_steps_do(points, kind, lam):
    x, y, _, _ = points
    one, many = (train.Descent(np.zeros(5), 0.0, 0.0, train.Options(loss=kind, lam=lam)) for _ in range(2))
    for n in (120, 1, 0, 15, 33):
        for i in range(n):
            one.step(np.arange(5), x[i], float(y[i]))
        many.learn(x[:n], y[:n].astype(float))
        assert many.fold() == pytest.approx(one.fold(), rel=1e-9) and many.bias == pytest.approx(one.bias, rel=1e-9) and many.t == pytest.approx(one.t)


def test_letters_are_counted_in_one_pass(spark):
    shares = inputs.letters(spark, "/root/testdata/sf0.001")
    assert shares._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1
    assert all(r.total == pytest.approx(1) and r.n <= 26 for r in shares.groupBy("instance_id").agg(F.sum("val").alias("total"), F.count("*").alias("n")).collect())


def test_copies_have_equal_margins(spark):
    """Sums in the order of features, so that a threshold takes all copies of an instance or none (q_cascade_train, q_self_training)."""
    rng = np.random.default_rng(5)
    x = rng.random(12)
    rows = [(i, int(f), float(x[f])) for i in range(60) for f in rng.permutation(12)]
    feats = spark.createDataFrame(rows, "instance_id long, fid long, val double")
    weights = spark.createDataFrame([(0, f, float(w)) for f, w in zip(range(-1, 12), rng.normal(size=13), strict=True)], "model int, fid long, w double")
    tests = feats.select(F.lit(0).alias("model"), "instance_id").distinct()
    got = train.trained_margins(feats, weights, tests, ["model"], train.packed(feats)).collect()
    assert len(got) == 60 and len({r.margin for r in got}) == 1
