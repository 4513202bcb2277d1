"""Queries of graphs and their features. Graphs are those of the peptides of benchmark, unless said otherwise."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from strandgraph.functions import vectors as V
from strandgraph.functions.hashing import BLOCK_M, ap_hash_string, block_hash_string
from strandgraph.operators import encode, features, graph
from strandgraph.plans import inputs as I
from strandgraph.plans.inputs import table
from strandgraph.sources import writers

QUERIES, SQL = {}, {}
V0 = (*I.PEP, *I.encode_sql())

QUERIES["q_encode_vertices"] = lambda spark, d: encode.vertices(I.peptides(spark, d)).select("graph_id", "vid", "label")
SQL["q_encode_vertices"] = I.query(*V0, final="SELECT graph_id, vid, label FROM v1")
QUERIES["q_encode_edges"] = lambda spark, d: encode.edges(I.peptides(spark, d)).select("graph_id", "src", "dst")
SQL["q_encode_edges"] = I.query(*V0, final="SELECT graph_id, src, dst FROM e1")


def _aligned(spark, d):
    items = table(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("peptide_id"), F.upper(F.regexp_replace(F.regexp_replace("text", "[ \n]", "-"), "[^a-zA-Z-]", "")).alias("seq"))
    return items


def gap_layers(spark, d):
    """Whole texts as alignments, blanks as gaps, in all layers of a domain."""
    v = encode.vertices(_aligned(spark, d), encode.LAYERS, "D")
    return v.groupBy("graph_id", "layer", F.when(F.col("layer") == 0, "D").otherwise(F.col("label")).alias("label")).agg(F.count("*").alias("n"), F.min("vid").alias("first_vid"), F.sum("vid").alias("vids"))


QUERIES["q_domain_gap_layers"] = gap_layers
SQL["q_domain_gap_layers"] = I.query(
    "al AS (SELECT CAST(item_id AS VARCHAR) AS graph_id, upper(regexp_replace(regexp_replace(text, '[ \n]', '-', 'g'), '[^a-zA-Z-]', '', 'g')) AS seq FROM benchmark)",
    "s AS (SELECT graph_id, len(seq) AS n, p, substr(seq, CAST(p AS INT), 1) AS aa, CAST(l AS INTEGER) AS layer FROM (SELECT *, unnest(range(1, len(seq) + 1)) AS p FROM al), (SELECT unnest(range(0, 5)) AS l))",
    f"x AS (SELECT graph_id, layer, CAST(layer * n + p AS INTEGER) AS vid, CASE WHEN layer = 0 THEN 'D' WHEN aa = '-' THEN 'GAP' WHEN layer = 1 THEN {I.POL.format('D')} WHEN layer = 2 THEN {I.CHA.format('D')} WHEN layer = 3 THEN {I.HYD.format('D')} ELSE 'DA' || aa END AS label FROM s WHERE aa <> '-' OR layer <= 1)",
    final="SELECT graph_id, layer, label, count(*) AS n, min(vid) AS first_vid, CAST(sum(vid) AS BIGINT) AS vids FROM x GROUP BY ALL",
)


def doubling(spark, d):
    v, e = I.graphs(spark, d)
    twins = v.groupBy("graph_id").agg(F.count_if(F.col("label").startswith("r.")).alias("twins"))
    return graph.sizes(v, e).join(twins, "graph_id")


QUERIES["q_directed_doubling"] = doubling
SQL["q_directed_doubling"] = I.query(*I.GRAPHS, final="SELECT graph_id, n_vertices, n_edges, twins FROM (SELECT graph_id, count(*) AS n_vertices, count(*) FILTER (label LIKE 'r.%') AS twins FROM v GROUP BY 1) JOIN (SELECT graph_id, count(*) AS n_edges FROM e GROUP BY 1) USING (graph_id)")
QUERIES["q_undirected_closure"] = lambda spark, d: encode.undirected(encode.edges(I.peptides(spark, d))).groupBy("graph_id", "src").agg(F.count("*").alias("degree"))
SQL["q_undirected_closure"] = I.query(*V0, final="SELECT graph_id, src, count(*) AS degree FROM (SELECT graph_id, src FROM e1 UNION ALL SELECT graph_id, dst FROM e1) GROUP BY 1, 2")


def check(spark, d):
    """Conversations as graphs of turns, each linked to the next number: the last turn's edge goes nowhere."""
    turns = table(spark, d, "conversations").select(F.col("conv_id").alias("graph_id"), F.col("turn").cast("int").alias("vid"), F.col("role").alias("label"))
    return graph.check(turns, turns.select("graph_id", F.col("vid").alias("src"), (F.col("vid") + 1).alias("dst"), F.lit("").alias("label")))


QUERIES["q_graph_check"] = check
SQL["q_graph_check"] = """WITH v AS (SELECT conv_id AS graph_id, CAST(turn AS INTEGER) AS vid FROM conversations)
    SELECT DISTINCT graph_id, 'edge without vertex' AS problem FROM (SELECT graph_id, vid + 1 AS vid FROM v EXCEPT SELECT graph_id, vid FROM v) UNION ALL SELECT DISTINCT graph_id, 'repeated vertex' FROM (SELECT graph_id FROM v GROUP BY graph_id, vid HAVING count(*) > 1)"""


def killed(spark, d):
    p = I.peptides(spark, d)
    v, e = graph.kill(encode.vertices(p), "PCN"), encode.edges(p)
    return graph.sizes(graph.alive(v), graph.alive_edges(v, e))


QUERIES["q_kill_vertices"] = killed
SQL["q_kill_vertices"] = I.query(
    *V0,
    "a AS (SELECT graph_id, vid FROM v1 WHERE label <> 'PCN')",
    "k AS (SELECT graph_id, count(*) AS n FROM e1 WHERE (graph_id, src) IN (SELECT graph_id, vid FROM a) AND (graph_id, dst) IN (SELECT graph_id, vid FROM a) GROUP BY 1)",
    final="SELECT graph_id, n_vertices, coalesce(n, 0) AS n_edges FROM (SELECT graph_id, count(*) AS n_vertices FROM a GROUP BY 1) LEFT JOIN k USING (graph_id)",
)


def label_hashes(spark, d):
    part = table(spark, d, "part")
    names = part.select(F.col("p_name").alias("label")).union(part.select("p_type")).union(part.select("p_brand")).distinct()
    return names.select("label", ap_hash_string("label").alias("code"), ap_hash_string("label", 32767).alias("masked"))


QUERIES["q_ap_hash_labels"] = label_hashes
SQL["q_ap_hash_labels"] = f"SELECT label, {I.ap_text('label')} AS code, {I.ap_text('label', 32767)} AS masked FROM (SELECT p_name AS label FROM part UNION SELECT p_type FROM part UNION SELECT p_brand FROM part)"


def block_hashes(spark, d):
    part = table(spark, d, "part")
    names = part.select(F.col("p_name").alias("label")).union(part.select("p_type")).union(part.select("p_brand")).distinct()
    return names.select("label", block_hash_string("label", 7).alias("code"))


QUERIES["q_block_hash_labels"] = block_hashes
_word = "ascii(substr(label, CAST(4 * i + 1 AS INT), 1)) + (ascii(substr(label, CAST(4 * i + 2 AS INT), 1)) << 8) + (ascii(substr(label, CAST(4 * i + 3 AS INT), 1)) << 16) + (CAST(ascii(substr(label, CAST(4 * i + 4 AS INT), 1)) AS BIGINT) << 24)"
_m = lambda x: f"(({x} * {BLOCK_M}) & 4294967295)"
SQL["q_block_hash_labels"] = f"""WITH l AS (SELECT p_name AS label FROM part UNION SELECT p_type FROM part UNION SELECT p_brand FROM part),
    w AS (SELECT label, strlen(label) AS n, list_transform(range(0, strlen(label) // 4), lambda i: CAST({_word} AS BIGINT)) AS words, strlen(label) // 4 AS i FROM l),
    h AS (SELECT label, n, list_reduce(list_transform(words, lambda k: {_m('xor(' + _m('k') + ', ' + _m('k') + ' >> 24)')}), lambda h, k: xor({_m('h')}, k), CAST(xor(7, n) AS BIGINT)) AS h,
          CASE n % 4 WHEN 0 THEN NULL WHEN 1 THEN ascii(right(label, 1)) WHEN 2 THEN ascii(substr(label, n - 1, 1)) + (ascii(right(label, 1)) << 8) ELSE ascii(substr(label, n - 2, 1)) + (ascii(substr(label, n - 1, 1)) << 8) + (ascii(right(label, 1)) << 16) END AS rest FROM w),
    t AS (SELECT label, CASE WHEN rest IS NULL THEN h ELSE {_m('xor(h, CAST(rest AS BIGINT))')} END AS h FROM h),
    e AS (SELECT label, {_m('xor(h, h >> 13)')} AS h FROM t) SELECT label, xor(h, h >> 15) AS code FROM e"""


def bounded(spark, d):
    return graph.distances(*I.graphs(spark, d), 2)


QUERIES["q_bounded_distances"] = bounded
SQL["q_bounded_distances"] = I.query(*I.GRAPHS, *I.distances_sql(2), final="SELECT * FROM dist")


def shells(spark, d):
    p = I.peptides(spark, d)
    dist = graph.distances(encode.vertices(p), encode.undirected(encode.edges(p)), 2)
    ball = graph.ball(dist, 1).groupBy("graph_id").agg(F.count("*").alias("ball"))
    return graph.at_distance(dist, 2).groupBy("graph_id").agg(F.count("*").alias("shell")).join(ball, "graph_id")


UNDIRECTED = (*V0, "u AS (SELECT graph_id, src, dst, label FROM e1 UNION ALL SELECT graph_id, dst, src, label FROM e1)", *I.distances_sql(2, "v1", "u"))
QUERIES["q_distance_shells"] = shells
SQL["q_distance_shells"] = I.query(*UNDIRECTED, final="SELECT graph_id, count(*) FILTER (d = 2) AS shell, count(*) FILTER (d <= 1) AS ball FROM dist GROUP BY 1")


def path_union(spark, d):
    p = I.peptides(spark, d)
    dist = graph.distances(encode.vertices(p), encode.undirected(encode.edges(p)), 2)
    thin = graph.path_vertices(dist, 2).groupBy("graph_id").agg(F.count("*").alias("on_path"))
    return thin.join(graph.thick_path_vertices(dist, 2, 1).groupBy("graph_id").agg(F.count("*").alias("around_path")), "graph_id")


QUERIES["q_shortest_path_union"] = path_union
SQL["q_shortest_path_union"] = I.query(
    *UNDIRECTED,
    "p AS (SELECT DISTINCT a.graph_id, a.src, a.dst, x.dst AS vid FROM dist a JOIN dist x ON x.graph_id = a.graph_id AND x.src = a.src JOIN dist y ON y.graph_id = a.graph_id AND y.src = a.dst AND y.dst = x.dst WHERE a.d = 2 AND x.d + y.d = 2)",
    "t AS (SELECT DISTINCT p.graph_id, p.src, p.dst, b.dst AS vid FROM p JOIN dist b ON b.graph_id = p.graph_id AND b.src = p.vid WHERE b.d <= 1)",
    final="SELECT graph_id, on_path, around_path FROM (SELECT graph_id, count(*) AS on_path FROM p GROUP BY 1) JOIN (SELECT graph_id, count(*) AS around_path FROM t GROUP BY 1) USING (graph_id)",
)


def subgraphs(spark, d):
    p = I.peptides(spark, d)
    v, e = encode.vertices(p), encode.edges(p)
    nodes, kept = graph.induced(v, e, graph.ball(graph.distances(v, encode.undirected(e), 2), 2))
    n = nodes.groupBy("graph_id", "root").agg(F.count("*").alias("n_vertices"), F.max("idx").alias("last"))
    return n.join(kept.groupBy("graph_id", "root").agg(F.count("*").alias("n_edges")), ["graph_id", "root"], "left").fillna(0, ["n_edges"])


QUERIES["q_induced_subgraph"] = subgraphs
SQL["q_induced_subgraph"] = I.query(
    *UNDIRECTED,
    "n AS (SELECT graph_id, src AS root, count(*) AS n_vertices, CAST(count(*) - 1 AS INTEGER) AS last FROM dist GROUP BY 1, 2)",
    "k AS (SELECT a.graph_id, a.src AS root, count(*) AS n_edges FROM e1 JOIN dist a ON a.graph_id = e1.graph_id AND a.dst = e1.src JOIN dist b ON b.graph_id = e1.graph_id AND b.dst = e1.dst AND b.src = a.src GROUP BY 1, 2)",
    final="SELECT graph_id, root, n_vertices, last, coalesce(n_edges, 0) AS n_edges FROM n LEFT JOIN k USING (graph_id, root)",
)

QUERIES["q_radius0_codes"] = lambda spark, d: features.radius0(I.graphs(spark, d)[0])
SQL["q_radius0_codes"] = I.query(*I.GRAPHS, I.CODES0, final="SELECT graph_id, vid, code FROM code0")
QUERIES["q_radius1_codes"] = lambda spark, d: features.radius1(*I.graphs(spark, d))
SQL["q_radius1_codes"] = I.query(*I.GRAPHS, I.CODES1, final="SELECT graph_id, vid, code FROM code1")


def _each(spark, d, made):
    """made(vertices, edges) of the peptides' undirected graphs by graph_id: once for each distinct sequence, joined back."""
    p = I.peptides(spark, d).select("peptide_id", "seq")
    distinct = p.select("seq").distinct().select(F.col("seq").alias("peptide_id"), "seq")
    found = made(encode.vertices(distinct), encode.undirected(encode.edges(distinct)))
    return p.join(found, F.col("seq") == F.col("graph_id")).drop("seq", "graph_id").withColumnRenamed("peptide_id", "graph_id")


def path_features(spark, d):
    found = _each(spark, d, lambda v, e: features.graph_vectors(v, e, 0, 2, kind="path").withColumnRenamed("instance_id", "graph_id"))
    return found.select(F.col("graph_id").alias("instance_id"), "fid", F.round("val", 6).alias("val"))


QUERIES["q_radius2_codes"] = lambda spark, d: _each(spark, d, lambda v, e: features.codes(v, e, 2))
QUERIES["q_approximate_codes"] = lambda spark, d: _each(spark, d, lambda v, e: features.codes(v, e, 2, approximate=True))
QUERIES["q_path_features"] = path_features
#: Undirected graphs of the different sequences, and the peptides' names for them.
ONCE = (*I.PEP, "one AS (SELECT DISTINCT seq, seq AS name FROM pep)", *I.encode_sql("one", "name"), "u AS (SELECT graph_id, src, dst, label FROM e1 UNION ALL SELECT graph_id, dst, src, label FROM e1)")
BALL = "ball AS (SELECT graph_id, src AS root, dst AS vid FROM dist WHERE d <= 2)"
NAMED = "SELECT peptide_id AS graph_id, root AS vid, code FROM k_code JOIN pep ON seq = graph_id"
SQL["q_radius2_codes"] = I.query(*ONCE, *I.distances_sql(2, "v1", "u"), BALL, *I.subgraphs_sql("k", "ball", 4, "v1", "u"), final=NAMED)
SQL["q_approximate_codes"] = I.query(*ONCE, *I.distances_sql(4, "v1", "u"), BALL, *I.subgraphs_sql("k", "ball", 4, "v1", "u", "dist"), final=NAMED)
_paths = "p{0} AS (SELECT DISTINCT a.graph_id, a.src || '>' || a.dst AS root, x.dst AS vid FROM dist a JOIN dist x ON x.graph_id = a.graph_id AND x.src = a.src JOIN dist y ON y.graph_id = a.graph_id AND y.src = a.dst AND y.dst = x.dst WHERE a.d = {0} AND x.d + y.d = {0})"
_of_paths = " UNION ALL ".join(f"SELECT graph_id, {I.ap_text(f'{chr(39)}dt:{d} t:0{chr(39)}')} AS block, code AS selector FROM k{d}_code" for d in (1, 2))
SQL["q_path_features"] = I.query(
    *ONCE, *I.distances_sql(2, "v1", "u"), _paths.format(1), _paths.format(2), *I.subgraphs_sql("k1", "p1", 1, "v1", "u"), *I.subgraphs_sql("k2", "p2", 2, "v1", "u"),
    f"hist AS (SELECT graph_id, block, selector, CAST(1 AS BIGINT) AS predicate, CAST(1 AS BIGINT) AS bin, CAST(count(*) AS DOUBLE) AS cnt FROM ({_of_paths}) GROUP BY ALL)", I.vectors_sql(),
    final="SELECT peptide_id AS instance_id, fid, round(val, 6) AS val FROM vec JOIN pep ON seq = instance_id",
)


def _renamed(sql: str, suffix: str, names: str) -> str:
    """sql with the names of its tables changed."""
    return re.sub(rf"\b({names})\b", rf"\g<1>{suffix}", sql)


def soft_paths(spark, d):
    found = _each(spark, d, lambda v, e: features.graph_vectors(v, e, 0, 2, kind="soft path").withColumnRenamed("instance_id", "graph_id"))
    return found.select(F.col("graph_id").alias("instance_id"), "fid", F.round("val", 6).alias("val"))


QUERIES["q_soft_path_features"] = soft_paths
CONTENT = f"content AS (SELECT graph_id, vid, p AS predicate, b AS bin FROM {{0}} JOIN (SELECT label, {I.ap_text(chr(39) + 'pred:' + chr(39) + ' || label')} AS p, {I.ap_text(chr(39) + 'bin:0_v:' + chr(39) + ' || label')} AS b FROM (SELECT DISTINCT label FROM {{0}})) USING (label))"
_soft_paths = " UNION ALL ".join(f"SELECT graph_id, src, dst, vid, {I.ap_text(f'{chr(39)}dt:{d} t:0{chr(39)}')} AS block FROM q{d}" for d in (1, 2))
_path_ends = "q{0} AS (SELECT DISTINCT a.graph_id, a.src, a.dst, x.dst AS vid FROM dist a JOIN dist x ON x.graph_id = a.graph_id AND x.src = a.src JOIN dist y ON y.graph_id = a.graph_id AND y.src = a.dst AND y.dst = x.dst WHERE a.d = {0} AND x.d + y.d = {0})"
SQL["q_soft_path_features"] = I.query(
    *ONCE, *I.distances_sql(2, "v1", "u"), _path_ends.format(1), _path_ends.format(2), I.CODES0.replace(" v ", " v1 ").replace("FROM v)", "FROM v1)"), CONTENT.format("v1"),
    f"sp AS ({_soft_paths})",
    "hist AS (SELECT sp.graph_id, block, a.code + b.code AS selector, predicate, bin, CAST(count(*) AS DOUBLE) AS cnt FROM sp JOIN code0 a ON a.graph_id = sp.graph_id AND a.vid = sp.src JOIN code0 b ON b.graph_id = sp.graph_id AND b.vid = sp.dst JOIN content c ON c.graph_id = sp.graph_id AND c.vid = sp.vid GROUP BY ALL)",
    I.vectors_sql(), final="SELECT peptide_id AS instance_id, fid, round(val, 6) AS val FROM vec JOIN pep ON seq = instance_id",
)


def approximate_soft(spark, d):
    return _rounded(features.graph_vectors(*I.graphs(spark, d), 1, 1, kind="approximate soft"))


QUERIES["q_approximate_soft_features"] = approximate_soft
_soft_block = f"CASE r * 10 + d {' '.join(f'WHEN {10 * r + d} THEN {I.ap_text(chr(39) + f'd:{d} r:{r}' + chr(39))}' for r in (0, 1) for d in (0, 1))} END"
SQL["q_approximate_soft_features"] = I.query(
    *I.GRAPHS, *I.distances_sql(1), I.CODES0, CONTENT.format("v"),
    "pair AS (SELECT p.*, r, a.code AS a, b.code AS b FROM dist p JOIN code0 a ON a.graph_id = p.graph_id AND a.vid = p.src JOIN code0 b ON b.graph_id = p.graph_id AND b.vid = p.dst, (SELECT unnest([0, 1]) AS r))",
    f"sel AS (SELECT graph_id, src, dst, r, d, {_soft_block} AS block, CASE WHEN d = 0 THEN {I.ap('[a]')} ELSE {I.ap('[least(a, b), greatest(a, b)]')} END AS selector FROM pair)",
    "ends AS (SELECT graph_id, r, block, selector, src AS vid FROM sel UNION ALL SELECT graph_id, r, block, selector, dst FROM sel WHERE d > 0)",
    "hist AS (SELECT e.graph_id, block, selector, predicate, bin, CAST(count(*) AS DOUBLE) AS cnt FROM ends e JOIN dist n ON n.graph_id = e.graph_id AND n.src = e.vid AND n.d <= e.r JOIN content c ON c.graph_id = e.graph_id AND c.vid = n.dst GROUP BY ALL)",
    I.vectors_sql(), final="SELECT instance_id, fid, round(val, 6) AS val FROM vec",
)


#: Radius and distance of the models' published runs.
RADIUS, DISTANCE = 3, 5


def published(spark, d):
    """Vectors of the peptides' directed graphs at the published radius and distance, made once for each sequence."""
    p = I.peptides(spark, d).select("peptide_id", "seq")
    distinct = p.select("seq").distinct().select(F.col("seq").alias("peptide_id"), "seq")
    made = features.graph_vectors(*encode.directed(encode.vertices(distinct), encode.edges(distinct)), RADIUS, DISTANCE)
    return p.join(made, F.col("seq") == F.col("instance_id")).select(F.col("peptide_id").alias("instance_id"), "fid", F.round("val", 6).alias("val"))


QUERIES["q_features_r3_d5"] = published
_ball = lambda r: f"ball{r} AS (SELECT graph_id, src AS root, dst AS vid FROM dist WHERE d <= {r})"
_each_code = " UNION ALL ".join(["SELECT graph_id, vid, 0 AS r, code FROM code0", "SELECT graph_id, vid, 1, code FROM code1", *[f"SELECT graph_id, root, {r}, code FROM k{r}_code" for r in range(2, RADIUS + 1)]])
_block = f"CASE r * 10 + d {' '.join(f'WHEN {10 * r + d} THEN {I.ap_text(chr(39) + f'd:{d} r:{r}' + chr(39))}' for r in range(RADIUS + 1) for d in range(DISTANCE + 1))} END"
SQL["q_features_r3_d5"] = I.query(
    *I.PEP, "one AS (SELECT DISTINCT seq, seq AS name FROM pep)", *I.encode_sql("one", "name"), *I.DOUBLED, *I.distances_sql(DISTANCE), I.CODES0, I.CODES1,
    *[x for r in range(2, RADIUS + 1) for x in (_ball(r), *I.subgraphs_sql(f"k{r}", f"ball{r}", 2 * r))], f"coded AS ({_each_code})",
    "pair AS (SELECT graph_id, r, d, least(a.code, b.code) AS low, greatest(a.code, b.code) AS high, count(*) AS n FROM dist p JOIN coded a USING (graph_id) JOIN coded b USING (graph_id, r) WHERE a.vid = p.src AND b.vid = p.dst GROUP BY ALL)",
    "uses AS (SELECT DISTINCT r, d, low, high FROM pair)",
    f"keyed AS (SELECT r, d, low, high, {_block} AS block, CASE WHEN d = 0 THEN {I.ap('[low]')} ELSE {I.ap('[low, high]')} END AS selector FROM uses)",
    "hist AS (SELECT graph_id, block, selector, CAST(1 AS BIGINT) AS predicate, CAST(1 AS BIGINT) AS bin, CAST(sum(CASE WHEN d = 0 THEN n ELSE 2 * n END) AS DOUBLE) AS cnt FROM pair JOIN keyed USING (r, d, low, high) GROUP BY ALL)",
    I.vectors_sql(), final="SELECT peptide_id AS instance_id, fid, round(val, 6) AS val FROM vec JOIN pep ON seq = instance_id",
)


def pair_features(spark, d):
    v, e = I.graphs(spark, d)
    return features.pairs(v, e, 0, 1).groupBy("graph_id", "d", F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")).agg(F.count("*").alias("n"))


BASE = (*I.GRAPHS, *I.distances_sql(1), I.CODES0)
QUERIES["q_pair_features"] = pair_features
SQL["q_pair_features"] = I.query(*BASE, I.histogram_sql(), final="SELECT graph_id, d, least(a, b) AS low, greatest(a, b) AS high, count(*) AS n FROM pair GROUP BY ALL")


def _rounded(df):
    return df.select("instance_id", "fid", F.round("val", 6).alias("val"))


QUERIES["q_features_normalised"] = lambda spark, d: _rounded(I.vectors(spark, d))
SQL["q_features_normalised"] = I.query(*I.FEATURES, final="SELECT instance_id, fid, round(val, 6) AS val FROM vec")
QUERIES["q_features_unnormalised"] = lambda spark, d: _rounded(features.graph_vectors(*I.graphs(spark, d), 0, 1, normalise=False))
SQL["q_features_unnormalised"] = I.query(*BASE, I.histogram_sql(), I.vectors_sql("counts"), final="SELECT instance_id, fid, round(val, 6) AS val FROM vec")
QUERIES["q_min_kernel"] = lambda spark, d: _rounded(features.graph_vectors(*I.graphs(spark, d), 0, 1, min_kernel=True))
SQL["q_min_kernel"] = I.query(*BASE, I.histogram_sql(), I.vectors_sql("min"), final="SELECT instance_id, fid, round(val, 6) AS val FROM vec")


def collisions(spark, d):
    return features.collisions(features.hard(features.pairs(*I.graphs(spark, d), 0, 1), 0, 1), 7)


QUERIES["q_feature_collisions"] = collisions
SQL["q_feature_collisions"] = I.query(*BASE, I.histogram_sql(), final=f"SELECT graph_id AS instance_id, {I.ap('[block, selector, predicate, bin, 0]', 255)} AS fid, count(*) AS n FROM hist GROUP BY 1, 2 HAVING count(*) > 1")

for _kind in ("alias", "gapped"):
    QUERIES[f"q_{_kind}_features"] = lambda spark, d, kind=_kind: _rounded(features.graph_vectors(*I.graphs(spark, d), 0, 1, kind=kind))
    SQL[f"q_{_kind}_features"] = I.query(*BASE, I.histogram_sql(kind=_kind), I.vectors_sql(), final="SELECT instance_id, fid, round(val, 6) AS val FROM vec")


def viewpoint(spark, d):
    """Every vertex of the backbone is a viewpoint."""
    v, e = I.graphs(spark, d)
    return _rounded(features.graph_vectors(v.withColumn("viewpoint", F.col("layer") == 0), e, 0, 1, kind="viewpoint"))


QUERIES["q_viewpoint_features"] = viewpoint
_marked = [x.replace("v AS (", "v0 AS (", 1) if x.startswith("v AS (") else x for x in I.GRAPHS]
SQL["q_viewpoint_features"] = I.query(
    *_marked,
    "v AS (SELECT graph_id, vid, CASE WHEN label IN ('X', 'r.X') THEN 'viewpoint.' || label ELSE label END AS label FROM v0)",
    *I.distances_sql(1), I.CODES0, I.histogram_sql(first="p.src IN (SELECT vid FROM v w WHERE w.graph_id = p.graph_id AND w.label LIKE 'viewpoint%')"), I.vectors_sql(),
    final="SELECT instance_id, fid, round(val, 6) AS val FROM vec",
)


def soft(spark, d):
    return _rounded(features.graph_vectors(*I.graphs(spark, d), 0, 1, kind="soft"))


QUERIES["q_soft_features"] = soft
SQL["q_soft_features"] = I.query(
    *BASE, I.histogram_sql().replace("hist AS (", "hard AS (").rsplit(", hard AS (", 1)[0],
    f"content AS (SELECT graph_id, vid, p AS predicate, b AS bin FROM v JOIN (SELECT label, {I.ap_text(chr(39) + 'pred:' + chr(39) + ' || label')} AS p, {I.ap_text(chr(39) + 'bin:0_v:' + chr(39) + ' || label')} AS b FROM (SELECT DISTINCT label FROM v)) USING (label))",
    f"sel AS (SELECT graph_id, src, dst, d, CASE d WHEN 0 THEN {I.ap_text(chr(39) + 'd:0 r:0' + chr(39))} ELSE {I.ap_text(chr(39) + 'd:1 r:0' + chr(39))} END AS block, CASE WHEN d = 0 THEN {I.ap('[a]')} ELSE {I.ap('[least(a, b), greatest(a, b)]')} END AS selector FROM pair)",
    "ends AS (SELECT graph_id, block, selector, src AS vid FROM sel UNION ALL SELECT graph_id, block, selector, dst FROM sel WHERE d > 0)",
    "hist AS (SELECT graph_id, block, selector, predicate, bin, CAST(count(*) AS DOUBLE) AS cnt FROM ends JOIN content USING (graph_id, vid) GROUP BY ALL)",
    I.vectors_sql(),
    final="SELECT instance_id, fid, round(val, 6) AS val FROM vec",
)


def relabelled(spark, d):
    """Nucleotide letters of whole texts: abstract, purine and pyrimidine, and stem labels (every fifth edge a stem)."""
    from strandgraph.functions.residues import purine_pyrimidine

    names = table(spark, d, "part").select(F.col("p_partkey").alias("peptide_id"), F.upper(F.regexp_replace("p_name", "[^a-zA-Z]", "")).alias("seq"))
    v = encode.vertices(names, ("any", "identity")).where("layer = 1").withColumn("label", F.expr("substring(label, 3)"))
    e = v.where("pos % 5 = 0").select("graph_id", F.col("vid").alias("src"), (F.col("vid") + 1).alias("dst"), F.lit("s").alias("label"))
    kinds = graph.abstract(v).withColumn("kind", F.lit("abstract")).unionByName(v.withColumn("label", purine_pyrimidine(F.col("label"))).withColumn("kind", F.lit("pp"))).unionByName(graph.stems(v, e).withColumn("kind", F.lit("stem")))
    return kinds.groupBy("kind", "label").agg(F.count("*").alias("n"))


QUERIES["q_abstract_pp_stem_relabel"] = relabelled
SQL["q_abstract_pp_stem_relabel"] = """WITH s AS (SELECT p_partkey AS g, upper(regexp_replace(p_name, '[^a-zA-Z]', '', 'g')) AS seq FROM part),
    v AS (SELECT g, p, substr(seq, CAST(p AS INT), 1) AS c, len(seq) AS n FROM (SELECT *, unnest(range(1, len(seq) + 1)) AS p FROM s))
    SELECT kind, label, count(*) AS n FROM (SELECT 'abstract' AS kind, '0' AS label FROM v UNION ALL SELECT 'pp', CASE WHEN c IN ('A', 'G') THEN 'R' WHEN c IN ('C', 'T', 'U') THEN 'Y' ELSE c END FROM v
    UNION ALL SELECT 'stem', CASE WHEN p % 5 = 0 OR (p > 1 AND p % 5 = 1) THEN 'S' ELSE c END FROM v) GROUP BY ALL"""


def directions(spark, d):
    """Agreement of the first three and the next three components of each vector."""
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    return e.select("vec_id", V.agreement(F.slice("x", 1, 3), F.slice("x", 4, 3)).alias("agreement"), F.round(V.squared_norm(F.slice("x", 1, 3)), 6).alias("norm"))


QUERIES["q_direction_agreement"] = directions
SQL["q_direction_agreement"] = """WITH x AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), n AS (SELECT vec_id, v[1] * v[1] + v[2] * v[2] + v[3] * v[3] AS m, v[4] * v[4] + v[5] * v[5] + v[6] * v[6] AS n, v[1] * v[4] + v[2] * v[5] + v[3] * v[6] AS p FROM x)
    SELECT vec_id, CASE WHEN m = 0 AND n = 0 THEN 1 WHEN m = 0 OR n = 0 THEN 2 WHEN p / sqrt(m * n) > 0.5 THEN 3 WHEN p / sqrt(m * n) < -0.5 THEN 4 ELSE 5 END AS agreement, round(m, 6) AS norm FROM n"""


def exports(spark, d):
    """Graphs of the peptides in two text forms."""
    p = I.peptides(spark, d)
    v, e = encode.vertices(p), encode.edges(p)
    return writers.export(v, e, "gspan").withColumn("form", F.lit("gspan")).unionByName(writers.export(v, encode.undirected(e), "csv").withColumn("form", F.lit("csv")))


QUERIES["q_edge_export"] = exports
SQL["q_edge_export"] = I.query(
    *V0,
    "l AS (SELECT graph_id, 1 AS o, vid AS a, 0 AS b, 'v ' || vid || ' ' || label AS t FROM v1 UNION ALL SELECT graph_id, 2, src, dst, 'e ' || src || ' ' || dst FROM e1)",
    "c AS (SELECT e1.graph_id, e1.dst AS a, e1.src AS b, e1.dst || ',' || x.label || ',' || e1.src || ',' || y.label || ',' AS t FROM e1 JOIN v1 x ON x.graph_id = e1.graph_id AND x.vid = e1.dst JOIN v1 y ON y.graph_id = e1.graph_id AND y.vid = e1.src)",
    final="SELECT graph_id, 't # ' || graph_id || chr(10) || string_agg(t, chr(10) ORDER BY o, a, b) AS value, 'gspan' AS form FROM l GROUP BY 1 UNION ALL SELECT graph_id, string_agg(t, chr(10) ORDER BY a, b), 'csv' FROM c GROUP BY 1",
)


def composite(spark, d):
    """All six sets, made once for each distinct sequence; the one without labels reaches further."""
    p = I.peptides(spark, d).select("peptide_id", "seq")
    distinct = p.select("seq").distinct().select(F.col("seq").alias("peptide_id"), "seq")
    made = features.composite_vectors(*encode.directed(encode.vertices(distinct), encode.edges(distinct)), shapes={"abstract": (0, 3)})
    return p.join(made, F.col("seq") == F.col("instance_id")).select(F.col("peptide_id").alias("instance_id"), "fid", F.round("val", 8).alias("val"))


QUERIES["q_composite_features"] = composite
_tables = "pair|one|hist|vec|code0|sel|ends|content|hard"
_soft_parts = [x for x in (
    I.histogram_sql().rsplit(", one AS (", 1)[0], CONTENT.format("v"),
    f"sel AS (SELECT graph_id, src, dst, d, CASE d WHEN 0 THEN {I.ap_text(chr(39) + 'd:0 r:0' + chr(39))} ELSE {I.ap_text(chr(39) + 'd:1 r:0' + chr(39))} END AS block, CASE WHEN d = 0 THEN {I.ap('[a]')} ELSE {I.ap('[least(a, b), greatest(a, b)]')} END AS selector FROM pair)",
    "ends AS (SELECT graph_id, block, selector, src AS vid FROM sel UNION ALL SELECT graph_id, block, selector, dst FROM sel WHERE d > 0)",
    "hist AS (SELECT graph_id, block, selector, predicate, bin, CAST(count(*) AS DOUBLE) AS cnt FROM ends JOIN content USING (graph_id, vid) GROUP BY ALL)", I.vectors_sql(),
)]
#: No label is one of a nucleotide alone and no edge is a stem, so these two sets are the plain one again.
SQL["q_composite_features"] = I.query(
    *I.GRAPHS, *I.distances_sql(1), *I.distances_sql(3, name="far"), I.CODES0, *[_renamed(x, "_a", "pair|one|hist|vec") for x in (I.histogram_sql(), I.vectors_sql())],
    *[_renamed(x, "_g", "pair|one|hist|vec") for x in (I.histogram_sql(kind="gapped"), I.vectors_sql())],
    f"code0_x AS (SELECT graph_id, vid, {I.ap_text(chr(39) + '0' + chr(39))} AS code FROM v)", *[_renamed(x, "_x", "pair|one|hist|vec|code0").replace("FROM dist p", "FROM far p") for x in (I.histogram_sql(3), I.vectors_sql())],
    "code0_s AS (SELECT * FROM code0)", *[_renamed(x, "_s", _tables) for x in _soft_parts],
    "t AS (SELECT instance_id, fid, sum(val) AS val FROM (SELECT instance_id, fid, 3 * val AS val FROM vec_a UNION ALL SELECT * FROM vec_g UNION ALL SELECT * FROM vec_x UNION ALL SELECT * FROM vec_s) GROUP BY 1, 2)",
    final="SELECT instance_id, fid, round(val / sum(val * val) OVER (PARTITION BY instance_id), 8) AS val FROM t",
)
QUERIES["q_label_colours"] = lambda spark, d: graph.colours(I.graphs(spark, d)[0])
SQL["q_label_colours"] = I.query(*I.GRAPHS, final="SELECT label, CAST((dense_rank() OVER (ORDER BY label) - 1) % 26 AS INTEGER) AS colour FROM (SELECT DISTINCT label FROM v)")
