"""Encoding, distances, codes and features of one small graph with known values."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from strandgraph.functions.hashing import ap_hash, ap_hash_array, ap_hash_string, block_hash, block_hash_string, feature_mask, hash_values, rolling_hash, rolling_hash_string
from strandgraph.operators import encode, features, graph, whole
from strandgraph.plans import graphs as plans

GOLDEN = {"": 715827882, "X": 715827858, "r.X": 1444599106, "PCN": 1337354793, "PCA": 1138916586, "PHVL": 850634036, "X:X-": 467710813, "d:0 r:0": 841642360, "d:1 r:1": 657134757}


@pytest.fixture(scope="module")
def peptide(spark):
    return spark.createDataFrame([("seq_1-1-15", "EEPLIPPPLPPRKKF")], "peptide_id string, seq string")


@pytest.fixture(scope="module")
def doubled(peptide):
    v, e = encode.directed(encode.vertices(peptide), encode.edges(peptide))
    return v.cache(), e.cache()


def test_hashes_have_known_values(spark):
    rows = spark.createDataFrame([(k,) for k in GOLDEN], "s string").select("s", ap_hash_string("s").alias("h"), rolling_hash_string("s").alias("r")).collect()
    assert {r.s: r.h for r in rows} == GOLDEN == {k: ap_hash(k) for k in GOLDEN}
    assert {r.s: r.r for r in rows} == {k: rolling_hash(k) for k in GOLDEN}
    lists = spark.createDataFrame([([1, 2, 3], 1, 2, 3)], "a array<long>, x long, y long, z long")
    row = hash_values(lists, "h", ["x", "y", "z"]).select("h", ap_hash_array("a").alias("g")).first()
    assert row.h == row.g == 1986736075 == ap_hash([1, 2, 3])
    assert ap_hash([1, 2, 3], feature_mask(14) & 0x7FFF) == 12235


def test_block_hash_of_strings(spark):
    texts = ["", "a", "ab", "abc", "abcd", "abcde", "é ß", "some longer text 123"]
    rows = spark.createDataFrame([(t,) for t in [*texts, None]], "t string").select("t", block_hash_string("t", 5).alias("h")).collect()
    assert {r.t: r.h for r in rows} == {**{t: block_hash(t.encode(), 5) for t in texts}, None: None}
    assert block_hash(b"") == 0 and block_hash(b"a", 1) != block_hash(b"a", 2)


def test_feature_id_of_a_single_code():
    selector = ap_hash([ap_hash("X")])
    assert selector == 238609360
    assert ap_hash([ap_hash("d:0 r:0"), selector, 1, 1, 0]) == 665804664
    assert 665804664 & feature_mask(14) == 24440


def test_sizes(peptide, doubled):
    assert graph.sizes(encode.vertices(peptide), encode.edges(peptide)).first()[1:] == (60, 59)
    assert graph.sizes(*doubled).first()[1:] == (120, 118)
    assert graph.check(*doubled).count() == 0
    assert graph.sizes(encode.vertices(peptide), encode.undirected(encode.edges(peptide))).first()[2] == 118


def test_features_have_known_numbers_and_weights(doubled):
    h = features.hard(features.pairs(*doubled, 0, 1), 0, 1)
    counts = {r.block: r["count"] for r in h.groupBy("block").count().collect()}
    assert counts == {ap_hash("d:0 r:0"): 30, ap_hash("d:1 r:0"): 32}
    vals = [r.val for r in features.vectors(h).collect()]
    assert len(vals) == 62 and sum(x * x for x in vals) == pytest.approx(1)
    assert sorted({round(x, 6) for x in vals}) == [0.125, 0.129099]
    zero = [r.val for r in features.graph_vectors(*doubled, 0, 0).collect()]
    assert len(zero) == 30 and zero[0] == pytest.approx(1 / math.sqrt(30))


def test_counts_without_normalisation(doubled):
    h = features.hard(features.pairs(*doubled, 0, 1), 0, 1)
    raw = features.vectors(h, normalise=False).agg(F.sum("val")).first()[0]
    assert raw == 120 + 2 * 118
    assert features.vectors(h, min_kernel=True, bits=30).count() == 120 + 2 * 118


def _brute_code(vertices, edges, root, radius):
    """The code of radius 2 or more, by plain breadth-first search."""

    def walk(start, allowed, bound):
        dist, now = {start: 0}, [start]
        for d in range(1, bound + 1):
            now = [b for a in now for x, b, _ in edges if x == a and b in allowed and b not in dist]
            dist |= {b: d for b in now}
            now = list(dict.fromkeys(now))
        return dist

    inside = set(walk(root, set(vertices), radius))
    codes = {}
    for i in inside:
        d = walk(i, inside, 2 * radius)
        codes[i] = ap_hash(sorted(ap_hash(f"{d.get(j, -1)}{vertices[j]}") for j in inside))
    return ap_hash(sorted(ap_hash([min(codes[a], codes[b]), max(codes[a], codes[b]), ap_hash(label)]) for a, b, label in edges if a in inside and b in inside))


@pytest.mark.parametrize("both_ways", [False, True])
def test_larger_codes_against_search(spark, both_ways):
    p = spark.createDataFrame([("a", "EPLAK"), ("b", "KF")], "peptide_id string, seq string")
    v, e = encode.vertices(p, ("any", "charge")), encode.edges(p, ("any", "charge"))
    if both_ways:
        e = encode.undirected(e)
    got = {(r.graph_id, r.vid): r.code for r in features.codes(v, e, 2).collect()}
    labels, arcs = {}, {}
    for r in v.collect():
        labels.setdefault(r.graph_id, {})[r.vid] = r.label
    for r in e.collect():
        arcs.setdefault(r.graph_id, []).append((r.src, r.dst, r.label))
    assert got == {(g, i): _brute_code(labels[g], arcs[g], i, 2) for g in labels for i in labels[g]}
    close = {(r.graph_id, r.vid): r.code for r in features.codes(v, e, 2, approximate=True).collect()}
    assert close.keys() == got.keys()


def test_whole_graphs_and_joins_agree(spark, monkeypatch):
    p = spark.createDataFrame([("a", "EPLAK"), ("b", "KF")], "peptide_id string, seq string")
    v, e = encode.vertices(p, ("any", "charge")), encode.undirected(encode.edges(p, ("any", "charge")))
    marked = v.withColumn("viewpoint", F.col("vid") % 2 == 0)
    made = lambda: {
        "codes": sorted(features.all_codes(v, e, 3).collect()),
        "approximate": sorted(features.codes(v, e, 2, approximate=True).collect()),
        "raw": sorted(features.codes(graph.mark_viewpoints(marked), e, 2, raw=marked).collect()),
        "paths": sorted(features.path_codes(v, e, 2, 1).collect()),
    }
    together = made()
    assert together["raw"] == sorted((r.graph_id, r.vid, r.code) for r in together["codes"] if r.r == 2)  # marks stop at radius 1
    monkeypatch.setattr(whole, "LARGEST", 10)  # the longer peptide's graph goes by joins
    assert whole.large(v, e).count() == 1 and made() == together
    monkeypatch.setattr(whole, "KEPT", 3)
    monkeypatch.setattr(whole, "ROWS", 3)  # rows are handed on in the midst of a graph
    monkeypatch.setattr(whole, "LARGEST", 10**6)
    assert made() == together


def test_kinds_of_features_run(spark):
    p = spark.createDataFrame([("a", "EPLA")], "peptide_id string, seq string")
    v, e = encode.vertices(p, ("any", "charge")).cache(), encode.edges(p, ("any", "charge")).cache()
    v = v.withColumn("viewpoint", F.col("vid") % 3 == 0).withColumn("coord", F.array(F.col("vid") * 1.0, F.col("layer") * 1.0, F.lit(0.5)))
    for kind in features.KINDS:
        rows = features.graph_vectors(v, e, 1, 1, kind=kind, bits=20).collect()
        assert rows and all(r.val > 0 for r in rows), kind
        if kind in ("hard", "alias", "gapped", "viewpoint", "approximate", "directional"):
            assert sum(r.val**2 for r in rows) == pytest.approx(1), kind
    with pytest.raises(ValueError):
        features.graph_vectors(v, e, kind="mixed")


def test_paths_and_subgraphs(spark):
    v = spark.createDataFrame([("g", i, x) for i, x in enumerate("ABCD")], "graph_id string, vid int, label string")
    e = encode.undirected(spark.createDataFrame([("g", 0, 1, ""), ("g", 1, 2, ""), ("g", 2, 3, "s")], "graph_id string, src int, dst int, label string"))
    d = graph.distances(v, e, 3)
    assert d.where("d = 3").count() == 2 and d.count() == 16
    on = {r.vid for r in graph.path_vertices(d, 2).where("src = 0 AND dst = 2").collect()}
    assert on == {0, 1, 2}
    assert {r.vid for r in graph.thick_path_vertices(d, 2, 1).where("src = 0 AND dst = 2").collect()} == {0, 1, 2, 3}
    assert [r.label for r in graph.stems(v, e).orderBy("vid").collect()] == ["A", "B", "S", "S"]
    dead = graph.kill(v, "B")
    assert graph.distances(dead, e, 3).where("src = 0 AND dst > 0").count() == 0
    nodes, kept = graph.induced(v, e, graph.ball(d, 1).where("root = 3"))
    assert {(r.vid, r.idx) for r in nodes.collect()} == {(2, 0), (3, 1)} and kept.count() == 2
    assert graph.distance_or_missing(dead.select("graph_id", F.lit(0).alias("src"), F.col("vid").alias("dst")), graph.distances(dead, e, 3)).where("d = -1").count() == 3


def test_gap_rule(spark):
    p = spark.createDataFrame([("a", "E-L")], "peptide_id string, seq string")
    v = {(r.vid, r.label) for r in encode.vertices(p, ("any", "charge", "identity"), "D").collect()}
    assert v == {(1, "D1"), (2, "D2"), (3, "D3"), (4, "DCA"), (5, "GAP"), (6, "DCN"), (7, "DAE"), (9, "DAL")}
    arcs = {(r.src, r.dst) for r in encode.edges(p, ("any", "charge", "identity"), "D").collect()}
    assert arcs == {(1, 2), (2, 3), (1, 4), (2, 5), (3, 6), (4, 7), (6, 9)}
    with pytest.raises(ValueError):
        encode.vertices(p, ("charge",))


def test_train_score_and_explain(spark):
    """Peptides with K or with E are told apart, and the telling residues have the largest margins."""
    from strandgraph import api
    from strandgraph.operators.train import Options

    rows = [(f"g{i}", ("AGK" if i % 2 else "AGE") + "LV"[i % 3 % 2] * (1 + i % 2), 1 if i % 2 else -1) for i in range(16)]
    p = spark.createDataFrame(rows, "peptide_id string, seq string, y int")
    v, e = encode.directed(encode.vertices(p), encode.edges(p))
    v, e = v.cache(), e.cache()
    targets = p.select(F.xxhash64("peptide_id").alias("instance_id"), "y")
    v2, e2 = v.withColumn("graph_id", F.xxhash64("graph_id")), e.withColumn("graph_id", F.xxhash64("graph_id"))
    options = Options(levels=((0, 1),), epochs=4)
    models, weights = api.fit(v2, e2, targets, options)
    models, weights = models.cache(), weights.cache()
    got = api.score(v2, e2, models, weights, options).join(targets, "instance_id")
    assert got.count() == 16 and got.where("prediction <> y").count() == 0
    parts = api.explain(v2, e2, models, weights, options).groupBy("instance_id", "level").agg(F.count("*").alias("n"))
    assert parts.join(v2.groupBy(F.col("graph_id").alias("instance_id")).agg((F.count("*") / 2).alias("m")), "instance_id").where("n <> m").count() == 0
    rows, measures = api.validate(v2, e2, targets, Options(levels=((0, 0),), folds=2, epochs=3))
    assert rows.count() == 16 and measures.first().balanced_f > 0.9


def test_costlier_codes_cover_every_peptide(spark, tmp_path):
    rows = [("a", "ACDEFGHIKLMNPQRSTVWYAC"), ("b", "acdefghiklmnpqr"), ("c", "too short")]
    spark.createDataFrame(rows, "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(0, "ALGERIA")], "n_nationkey long, n_name string").write.parquet(str(tmp_path / "nation.parquet"))
    ids = {"a-1-15", "a-6-20", "b-1-15"}
    for name in ("q_radius2_codes", "q_approximate_codes"):
        codes = {}
        for r in plans.QUERIES[name](spark, str(tmp_path)).collect():
            codes.setdefault(r.graph_id, {})[r.vid] = r.code
        assert set(codes) == ids and all(sorted(c) == list(range(1, 61)) for c in codes.values())
        assert codes["a-1-15"] == codes["b-1-15"] != codes["a-6-20"]
    assert {r.instance_id for r in plans.QUERIES["q_path_features"](spark, str(tmp_path)).collect()} == ids


def test_stars_go_by_joins(spark):
    star = lambda name, n: ([(name, i, "x") for i in range(n)], [(name, a, b, "") for i in range(1, n) for a, b in ((0, i), (i, 0))])
    (v1, e1), (v2, e2) = star("small", 50), star("wide", 2500)
    v = spark.createDataFrame(v1 + v2, "graph_id string, vid int, label string")
    e = spark.createDataFrame(e1 + e2, "graph_id string, src int, dst int, label string")
    assert [r.graph_id for r in whole.large(v, e, 2).collect()] == ["wide"]
    assert whole.large(v, e, 1).count() == 1 and whole.large(v, e.limit(0), 2).count() == 0


def test_tables_of_vertices_and_pairs_are_not_broadcast(spark, doubled):
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" not in plan(features.pairs(*doubled, 2, 2))


def test_sets_of_a_composite_are_written_one_by_one(spark, doubled):
    plan = features.composite_vectors(*doubled, shapes={"abstract": (0, 2)})._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("parquet") == 6
