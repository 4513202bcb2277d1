"""Hashed sparse features of graphs: pairs of rooted neighbourhoods at a distance.

A neighbourhood of radius r around a vertex has a code; a feature is a pair of codes of vertices at distance d (one code
for d = 0) within the block of (r, d). The counts of features make a histogram (graph_id, block, selector, predicate, bin,
cnt), which vectors() turns into (instance_id, fid, val). Codes of radius 0 and 1 hash strings of labels, larger ones the
distances within the neighbourhood. String hashes are made once for each distinct string and joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandgraph.functions import vectors as V
from strandgraph.functions.hashing import ap_hash, ap_hash_array, ap_hash_string, feature_mask, hash_values
from strandgraph.operators import graph as G
from strandgraph.operators import whole as W
from strandgraph.storage import materialize, wide


def _hashed(df: DataFrame, text: str, name: str) -> DataFrame:
    """df with name: the hash of column text, made once for each distinct text."""
    return df.join(df.select(text).distinct().withColumn(name, ap_hash_string(text)), text)


def radius0(v: DataFrame) -> DataFrame:
    """(graph_id, vid, code): the hash of the label."""
    return _hashed(v.select("graph_id", "vid", "label"), "label", "code").select("graph_id", "vid", "code")


def _children(v: DataFrame, e: DataFrame) -> DataFrame:
    """(graph_id, vid, child, text): out-neighbours with "label-edge label"."""
    to = v.select("graph_id", F.col("vid").alias("dst"), F.col("label").alias("_to"))
    return G.alive_edges(v, e).join(wide(to), ["graph_id", "dst"]).select("graph_id", F.col("src").alias("vid"), F.col("dst").alias("child"), F.concat("_to", F.lit("-"), "label").alias("text"))


def radius1(v: DataFrame, e: DataFrame) -> DataFrame:
    """(graph_id, vid, code): the hash of the label and the sorted out-neighbours."""
    around = _children(v, e).groupBy("graph_id", "vid").agg(F.array_join(F.array_sort(F.collect_list("text")), ".").alias("around"))
    text = v.join(around, ["graph_id", "vid"], "left").select("graph_id", "vid", F.concat("label", F.lit(":"), F.coalesce("around", F.lit(""))).alias("text"))
    return _hashed(text, "text", "code").select("graph_id", "vid", "code")


def subgraph_codes(members: DataFrame, v: DataFrame, e: DataFrame, bound: int, host: DataFrame | None = None) -> DataFrame:
    """(graph_id, root, code) of the subgraphs of members (graph_id, root, vid).

    Each vertex is coded by its distances (at most bound, else -1) to all others and their labels, each edge by its ends'
    codes and its label, the subgraph by its edges. The root has no special place. host: distances to use instead of
    those within the subgraph.
    """
    nodes, kept = G.induced(v, e, members)
    local = F.concat_ws("|", "graph_id", F.col("root").cast("string"))
    nodes = materialize(nodes.select(local.alias("graph_id"), F.col("graph_id").alias("_g"), F.col("root").alias("_r"), "vid", "label"), "nodes")
    kept = materialize(kept.select(local.alias("graph_id"), "src", "dst", "label"), "arcs")
    others = nodes.select("graph_id", F.col("vid").alias("dst"), F.col("label").alias("_to"))
    pairs = nodes.select("graph_id", "_g", F.col("vid").alias("src")).join(others, "graph_id")
    if host is None:
        dist = G.distances(nodes.select("graph_id", "vid"), kept, bound)
        pairs = pairs.join(dist, ["graph_id", "src", "dst"], "left")
    else:
        pairs = pairs.join(host.where(F.col("d") <= bound).withColumnRenamed("graph_id", "_g"), ["_g", "src", "dst"], "left")
    text = pairs.select("graph_id", "src", F.concat(F.coalesce("d", F.lit(-1)).cast("string"), "_to").alias("text"))
    codes = _hashed(materialize(text, "text"), "text", "h").groupBy("graph_id", "src").agg(F.array_sort(F.collect_list("h")).alias("hs"))
    codes = materialize(codes.select("graph_id", F.col("src").alias("vid"), ap_hash_array("hs").alias("code")), "codes")
    ends = kept.join(codes.select("graph_id", F.col("vid").alias("src"), F.col("code").alias("a")), ["graph_id", "src"]).join(codes.select("graph_id", F.col("vid").alias("dst"), F.col("code").alias("b")), ["graph_id", "dst"])
    ends = _hashed(ends.withColumnRenamed("label", "text"), "text", "l")
    coded = hash_values(ends, "h", ["least(a, b)", "greatest(a, b)", "l"]).groupBy("graph_id").agg(F.array_sort(F.collect_list("h")).alias("hs"))
    names = nodes.select("graph_id", "_g", "_r").distinct()
    none = F.lit(ap_hash([]))
    return names.join(coded, "graph_id", "left").select(F.col("_g").alias("graph_id"), F.col("_r").alias("root"), F.coalesce(ap_hash_array("hs"), none).alias("code"))


def codes(v: DataFrame, e: DataFrame, radius: int, dist: DataFrame | None = None, approximate: bool = False, raw: DataFrame | None = None) -> DataFrame:
    """(graph_id, vid, code) of one radius.

    From radius 2 on, the neighbourhoods' labels are those of raw (default v), since marks of viewpoints stay out of
    them; approximate takes distances of the whole graph instead of the neighbourhood's own.
    """
    if radius < 2:
        return radius0(v) if radius == 0 else radius1(v, e)
    return _wide_codes(v, e, [radius], approximate, raw, dist).select("graph_id", "vid", "code")


def _wide_codes(v: DataFrame, e: DataFrame, radii: list[int], approximate: bool = False, raw: DataFrame | None = None, dist: DataFrame | None = None) -> DataFrame:
    """(graph_id, vid, r, code) of radii from 2 on: graph by graph, by joins for graphs too large for one place."""
    large = materialize(W.large(v, e, max(radii) * (2 if approximate else 1)), "large")
    if large.isEmpty():
        return W.codes(v, e, radii, raw, approximate)
    small = lambda rows: rows.join(large, "graph_id", "left_anti")
    out = W.codes(small(v), small(e), radii, raw, approximate)
    v, e = (rows.join(large, "graph_id", "left_semi") for rows in (v, e))
    for radius in radii:
        near = G.distances(v, e, 2 * radius) if dist is None or approximate else dist.join(large, "graph_id", "left_semi")
        found = subgraph_codes(G.ball(near, radius), v if raw is None else raw, e, 2 * radius, near if approximate else None)
        out = out.unionByName(found.withColumnRenamed("root", "vid").withColumn("r", F.lit(radius)))
    return out


def all_codes(v: DataFrame, e: DataFrame, radius: int, approximate: bool = False, raw: DataFrame | None = None) -> DataFrame:
    """(graph_id, vid, r, code) of every radius up to the given one."""
    out = _union([codes(v, e, r).withColumn("r", F.lit(r)) for r in range(min(radius, 1) + 1)])
    return out.unionByName(_wide_codes(v, e, list(range(2, radius + 1)), approximate, raw)) if radius > 1 else out


def _kernel_points(v: DataFrame, viewpoints: bool) -> tuple[DataFrame, DataFrame]:
    """(graph_id, vid) of all usable vertices, and of those that may come first."""
    usable = G.alive(v)
    if "kernel_point" in v.columns:
        usable = usable.where("kernel_point")
    first = usable.where("viewpoint") if viewpoints and "viewpoint" in v.columns else usable
    return usable.select("graph_id", "vid"), first.select("graph_id", "vid")


def pairs(v: DataFrame, e: DataFrame, radius: int, distance: int, viewpoints: bool = False, coded: DataFrame | None = None, dist: DataFrame | None = None, raw: DataFrame | None = None) -> DataFrame:
    """(graph_id, r, d, src, dst, a, b): codes a and b of the vertices of each pair, for all r <= radius, d <= distance.

    raw: vertices without marks, whose labels count from radius 2 on.
    """
    usable, first = _kernel_points(v, viewpoints)
    dist = G.distances(v, e, max(radius, distance)) if dist is None else dist
    if radius + distance > 1:
        dist = materialize(dist, "distances")
    if coded is None:
        coded = all_codes(v, e, radius, raw=raw)
    if radius > 1:
        coded = materialize(coded, "codes")
    near = dist.where(F.col("d") <= distance)
    if {"kernel_point", "viewpoint"} & set(v.columns):  # else distances and codes are of usable vertices alone
        near = near.join(wide(first.withColumnRenamed("vid", "src")), ["graph_id", "src"], "left_semi").join(wide(usable.withColumnRenamed("vid", "dst")), ["graph_id", "dst"], "left_semi")
    near = near.join(wide(coded.select("graph_id", F.col("vid").alias("src"), "r", F.col("code").alias("a"))), ["graph_id", "src"])
    return near.join(wide(coded.select("graph_id", F.col("vid").alias("dst"), "r", F.col("code").alias("b"))), ["graph_id", "dst", "r"])


def _blocks(radius: int, distance: int, text: bool = True) -> Column:
    """The key of the block (r, d), from a list of constants."""
    key = lambda r, d: ap_hash(f"d:{d} r:{r}") if text else ap_hash([d, r])
    table = [x for r in range(radius + 1) for d in range(distance + 1) for x in (F.lit(1000 * r + d), F.lit(key(r, d)))]
    return F.create_map(*table)[F.col("r") * 1000 + F.col("d")].cast("long")


HARD = {"predicate": 1, "bin": 1}


def _histogram(df: DataFrame, count: Column) -> DataFrame:
    """One predicate and bin for each selector; occurrences are counted before anything else."""
    out = df.groupBy("graph_id", "block", "selector").agg(F.sum(count).cast("double").alias("cnt"))
    return out.select("graph_id", "block", "selector", F.lit(1).cast("long").alias("predicate"), F.lit(1).cast("long").alias("bin"), "cnt")


def hard(p: DataFrame, radius: int, distance: int) -> DataFrame:
    """The histogram of pairs: unordered pairs of codes, the code alone at distance 0; a pair counts 2."""
    one = hash_values(p.where("d = 0"), "selector", ["a"])
    two = hash_values(p.where("d > 0"), "selector", ["least(a, b)", "greatest(a, b)"])
    both = one.unionByName(two).withColumn("block", _blocks(radius, distance))
    return _histogram(both, F.when(F.col("d") == 0, 1).otherwise(2))


def alias(p: DataFrame, radius: int, distance: int) -> DataFrame:
    """Ordered pairs of codes, and besides the second code alone in blocks of their own."""
    pair = hash_values(p, "selector", ["a", "b"]).withColumn("block", _blocks(radius, distance, text=False))
    alone = hash_values(hash_values(p, "selector", ["b"]), "block", [1, "d", "r"])
    return _histogram(pair, F.lit(2)).unionByName(_histogram(alone, F.lit(1)))


def gapped(p: DataFrame) -> DataFrame:
    """Unordered pairs in blocks of the radius alone; of all distances of a graph the largest with pairs remains."""
    top = p.groupBy("graph_id", "r").agg(F.max("d").alias("d"))
    last = hash_values(p.join(top, ["graph_id", "r", "d"], "left_semi"), "selector", ["least(a, b)", "greatest(a, b)"])
    return _histogram(hash_values(last, "block", ["r"]), F.lit(2))


def directional(p: DataFrame, directions: DataFrame, radius: int, distance: int) -> DataFrame:
    """Ordered pairs with the agreement of the roots' directions (graph_id, vid, r, direction)."""
    p = p.join(directions.select("graph_id", "r", F.col("vid").alias("src"), F.col("direction").alias("u")), ["graph_id", "r", "src"])
    p = p.join(directions.select("graph_id", "r", F.col("vid").alias("dst"), F.col("direction").alias("w")), ["graph_id", "r", "dst"])
    p = p.withColumn("agree", V.agreement(F.col("u"), F.col("w")))
    return _histogram(hash_values(p, "selector", ["a", "b", "agree"]).withColumn("block", _blocks(radius, distance, text=False)), F.lit(2))


def root_directions(v: DataFrame, dist: DataFrame, radius: int) -> DataFrame:
    """(graph_id, vid, r, direction) for r <= radius from vertices with coord (array of 3): the mean from the ball to its root."""
    out = None
    at = v.select("graph_id", F.col("vid").alias("src"), F.col("coord").alias("p"))
    to = v.select("graph_id", F.col("vid").alias("dst"), F.col("coord").alias("q"))
    for r in range(radius + 1):
        around = dist.where(F.col("d").between(1, r)).join(to, ["graph_id", "dst"]).join(at, ["graph_id", "src"])
        seen = around.groupBy("graph_id", "src").agg(F.collect_list(F.zip_with("p", "q", lambda x, y: x - y)).alias("seen"))
        mean = at.join(seen, ["graph_id", "src"], "left").select("graph_id", F.col("src").alias("vid"), F.lit(r).alias("r"), V.average_direction(F.coalesce("seen", F.array().cast("array<array<double>>"))).alias("direction"))
        out = mean if out is None else out.unionByName(mean)
    return out


def soft_attributes(v: DataFrame, e: DataFrame, dist: DataFrame, radius: int, approximate: bool = False) -> DataFrame:
    """(graph_id, vid, predicate, bin, cnt): attributes of the neighbourhood of each vertex, for one radius.

    Vertices have attrs (array of strings; default the label alone) and nums (array of numbers, default none). Radius 0:
    the vertex; 1: the root, its label with "+r", and the out-neighbours; larger, or approximate: the ball.
    """
    if "attrs" not in v.columns:
        v = v.withColumn("attrs", F.array("label"))
    if "nums" not in v.columns:
        v = v.withColumn("nums", F.array().cast("array<double>"))
    node = v.select("graph_id", F.col("vid").alias("dst"), "label", "attrs", "nums")
    itself = node.select("graph_id", F.col("dst").alias("vid"), "label", "attrs", "nums")
    if radius == 0:
        seen = itself
    elif radius == 1 and not approximate:
        near = G.alive_edges(v, e).select("graph_id", F.col("src").alias("vid"), "dst").join(wide(node), ["graph_id", "dst"]).select("graph_id", "vid", "label", "attrs", "nums")
        seen = near.unionByName(itself.withColumn("label", F.concat("label", F.lit("+r"))))
    else:
        near = dist.where(F.col("d") <= radius).select("graph_id", F.col("src").alias("vid"), "dst", "d").join(wide(node), ["graph_id", "dst"])
        seen = near.select("graph_id", "vid", "label", "attrs", "nums")
    text = seen.select("graph_id", "vid", "label", F.posexplode("attrs").alias("k", "x"))
    text = text.select("graph_id", "vid", F.concat(F.lit("pred:"), "label").alias("p"), F.concat(F.lit("bin:"), F.col("k").cast("string"), F.lit("_v:"), "x").alias("b"), F.lit(1.0).alias("cnt"))
    number = seen.select("graph_id", "vid", "label", F.posexplode("nums").alias("k", "x"))
    number = number.select("graph_id", "vid", F.concat(F.lit("numpred:"), "label").alias("p"), F.concat(F.lit("numbin:"), F.col("k").cast("string")).alias("b"), F.col("x").cast("double").alias("cnt"))
    both = _hashed(_hashed(text.unionByName(number), "p", "predicate"), "b", "bin")
    return both.groupBy("graph_id", "vid", "predicate", "bin").agg(F.sum("cnt").alias("cnt"))


def soft(v: DataFrame, e: DataFrame, radius: int, distance: int, viewpoints: bool = False, approximate: bool = False) -> DataFrame:
    """The histogram of soft matching: selectors from labels, contents from both ends' attributes (approximate: of the balls)."""
    dist = G.distances(v, e, max(radius, distance))
    zero = radius0(v)
    coded, content = None, None
    for r in range(radius + 1):
        c, a = zero.withColumn("r", F.lit(r)), soft_attributes(v, e, dist, r, approximate).withColumn("r", F.lit(r))
        coded, content = (c, a) if coded is None else (coded.unionByName(c), content.unionByName(a))
    p = pairs(v, e, radius, distance, viewpoints, coded, dist)
    one = hash_values(p.where("d = 0"), "selector", ["a"])
    two = hash_values(p.where("d > 0"), "selector", ["least(a, b)", "greatest(a, b)"])
    both = one.unionByName(two).withColumn("block", _blocks(radius, distance))
    ends = both.select("graph_id", "r", "block", "selector", F.col("src").alias("vid")).unionAll(both.where("d > 0").select("graph_id", "r", "block", "selector", F.col("dst").alias("vid")))
    met = ends.join(wide(content), ["graph_id", "r", "vid"])
    return met.groupBy("graph_id", "block", "selector", "predicate", "bin").agg(F.sum("cnt").alias("cnt"))


def _path_blocks(distance: int, thickness: int) -> Column:
    """The key of the block of paths of length d and thickness t."""
    table = [x for d in range(1, distance + 1) for t in range(thickness + 1) for x in (F.lit(1000 * t + d), F.lit(ap_hash(f"dt:{d} t:{t}")))]
    return F.create_map(*table)[F.col("t") * 1000 + F.col("d")].cast("long")


def path_codes(v: DataFrame, e: DataFrame, distance: int, thickness: int = 0) -> DataFrame:
    """(graph_id, d, t, src, dst, code) of the union of shortest paths of each pair, thickened by balls."""
    large = materialize(W.large(v, e, max(distance, thickness, 1)), "large")
    if large.isEmpty():
        return W.path_codes(v, e, distance, thickness)
    small = lambda rows: rows.join(large, "graph_id", "left_anti")
    out = W.path_codes(small(v), small(e), distance, thickness)
    v, e = (rows.join(large, "graph_id", "left_semi") for rows in (v, e))
    dist = G.distances(v, e, max(distance, thickness, 1))
    for d in range(1, distance + 1):
        for t in range(thickness + 1):
            members = G.thick_path_vertices(dist, d, t).select("graph_id", F.concat_ws(">", F.col("src").cast("string"), F.col("dst").cast("string")).alias("root"), "vid")
            found = subgraph_codes(members, v, e, d + 2 * t)
            ends = [F.substring_index("root", ">", k).cast(v.schema["vid"].dataType) for k in (1, -1)]
            out = out.unionByName(found.select("graph_id", F.lit(d).alias("d"), F.lit(t).alias("t"), ends[0].alias("src"), ends[1].alias("dst"), "code"))
    return out


def paths(v: DataFrame, e: DataFrame, distance: int, thickness: int = 0, match: str = "hard") -> DataFrame:
    """The histogram of thickened shortest paths, for each length from 1 and thickness from 0.

    Hard: selectors are the paths' codes. Soft: selectors are the sum of the codes of both ends' labels, contents the
    attributes of all vertices of the path.
    """
    if match == "hard":
        found = path_codes(v, e, distance, thickness).withColumnRenamed("code", "selector")
        return _histogram(found.withColumn("block", _path_blocks(distance, thickness)), F.lit(1))
    if match != "soft":
        raise ValueError(f"unknown match: {match}; known: hard, soft")
    dist = materialize(G.distances(v, e, max(distance, thickness, 1)), "distances")
    members = _union([G.thick_path_vertices(dist, d, t).withColumns({"d": F.lit(d), "t": F.lit(t)}) for d in range(1, distance + 1) for t in range(thickness + 1)])
    members = members.withColumn("block", _path_blocks(distance, thickness))
    zero = radius0(v)
    for end in ("src", "dst"):
        members = members.join(zero.select("graph_id", F.col("vid").alias(end), F.col("code").alias(f"_{end}")), ["graph_id", end])
    met = members.withColumn("selector", (F.col("_src") + F.col("_dst")).bitwiseAND(F.lit(4294967295))).join(soft_attributes(v, e, dist, 0), ["graph_id", "vid"])
    return met.groupBy("graph_id", "block", "selector", "predicate", "bin").agg(F.sum("cnt").alias("cnt"))


def vectors(histogram: DataFrame, bits: int = 14, normalise: bool = True, min_kernel: bool = False) -> DataFrame:
    """(instance_id, fid, val) of a histogram.

    Normalised values are cnt / sqrt(blocks of the graph * selectors of the block * predicates of the selector * sum of
    squares in the predicate); the min-kernel has one feature of value 1 for each unit of a count. Features that collide
    overwrite: the largest value remains. Zeros are left out.
    """
    mask, h = feature_mask(bits), histogram
    if min_kernel:
        h = h.withColumn("z", F.explode(F.expr("sequence(0, CAST(ceil(cnt) AS INT) - 1)"))).withColumn("val", F.lit(1.0))
    elif normalise:
        # One shuffle by graph and one sort serve all windows: rows that begin a block, selector or predicate are counted.
        h = h.repartition("graph_id")
        keys = ["graph_id", "block", "selector", "predicate", "bin"]
        begins = lambda k: (F.row_number().over(Window.partitionBy(*keys[:k]).orderBy(*keys[k:])) == 1).cast("int")
        h = h.withColumns({"_p": begins(4), "_s": begins(3), "_b": begins(2)})
        total = lambda c, k: F.sum(c).over(Window.partitionBy(*keys[:k]))
        h = h.withColumns({"ss": total(F.col("cnt") * F.col("cnt"), 4), "n2": total("_p", 3), "n1": total("_s", 2), "n0": total("_b", 1)})
        h = h.withColumns({"val": F.expr("cnt / sqrt(n0 * n1 * n2 * ss)"), "z": F.lit(0)}).drop("_p", "_s", "_b")
    else:
        h = h.withColumns({"val": F.col("cnt"), "z": F.lit(0)})
    h = hash_values(h, "fid", ["block", "selector", "predicate", "bin", "z"], mask)
    return h.groupBy(F.col("graph_id").alias("instance_id"), "fid").agg(F.max("val").alias("val")).where("val <> 0")


def collisions(histogram: DataFrame, bits: int = 14) -> DataFrame:
    """(instance_id, fid, n): feature ids that more than one feature of a graph has."""
    h = hash_values(histogram, "fid", ["block", "selector", "predicate", "bin", 0], feature_mask(bits))
    return h.groupBy(F.col("graph_id").alias("instance_id"), "fid").agg(F.count("*").alias("n")).where("n > 1")


def graph_vectors(v: DataFrame, e: DataFrame, radius: int = 0, distance: int = 1, bits: int = 14, kind: str = "hard", normalise: bool = True, min_kernel: bool = False) -> DataFrame:
    """Vectors by the named kind of features."""
    if kind not in KINDS:
        raise ValueError(f"unknown kind of features: {kind}; known: {sorted(KINDS)}")
    return vectors(KINDS[kind](v, e, radius, distance), bits, normalise, min_kernel)


KINDS = {
    "hard": lambda v, e, r, d: hard(pairs(v, e, r, d), r, d),
    "soft": soft,
    "alias": lambda v, e, r, d: alias(pairs(v, e, r, d), r, d),
    "gapped": lambda v, e, r, d: gapped(pairs(v, e, r, d)),
    "viewpoint": lambda v, e, r, d: hard(pairs(G.mark_viewpoints(v), e, r, d, viewpoints=True, raw=v), r, d),
    "path": lambda v, e, r, d: paths(v, e, d),
    "soft path": lambda v, e, r, d: paths(v, e, d, match="soft"),
    "approximate soft": lambda v, e, r, d: soft(v, e, r, d, approximate=True),
    "approximate": lambda v, e, r, d: hard(pairs(v, e, r, d, coded=all_codes(v, e, r, approximate=True)), r, d),
    "directional": lambda v, e, r, d: directional(pairs(v, e, r, d), root_directions(v, G.distances(v, e, max(r, 1)), r), r, d),
}


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for x in frames[1:]:
        out = out.unionByName(x)
    return out


def composite(parts: list[DataFrame]) -> DataFrame:
    """Vectors added up, then divided by their inner product with themselves: one shuffle by instance for both."""
    total = _union(parts).repartition("instance_id").groupBy("instance_id", "fid").agg(F.sum("val").alias("val"))
    norm = F.sum(F.col("val") * F.col("val")).over(Window.partitionBy("instance_id"))
    return total.select("instance_id", "fid", (F.col("val") / norm).alias("val"))


#: Radius and distance of the sets of a composite that have their own.
SHAPES = {"abstract": (2, 100)}


def composite_vectors(v: DataFrame, e: DataFrame, radius: int = 0, distance: int = 1, bits: int = 14, kinds: tuple[str, ...] = ("hard", "abstract", "stem", "pp", "soft", "gapped"), shapes: dict[str, tuple[int, int]] = SHAPES) -> DataFrame:
    """Vectors of several feature sets as one: of the graph as it is and of its relabelled forms, by the named kinds.

    shapes: (radius, distance) of the kinds that have their own; the others take radius and distance. The graphs and each set
    are written out: every set reads the graphs many times, and one plan of all sets takes longer to make than to run.
    """
    from strandgraph.functions.residues import purine_pyrimidine

    v, e = materialize(v, "vertices"), materialize(e, "edges")
    forms = {"abstract": lambda: G.abstract(v), "stem": lambda: G.stems(v, e), "pp": lambda: v.withColumn("label", purine_pyrimidine(F.col("label")))}
    return composite([materialize(graph_vectors(forms[k]() if k in forms else v, e, *shapes.get(k, (radius, distance)), bits, "hard" if k in forms else k), "set") for k in kinds])


def vertex_vectors(v: DataFrame, e: DataFrame, radius: int, distance: int, bits: int = 14) -> DataFrame:
    """(instance_id, vid, fid, val): the vector of each vertex, of the pairs in which it comes first."""
    p = pairs(v, e, radius, distance)
    own = p.withColumn("graph_id", F.concat_ws("|", "graph_id", F.col("src").cast("string")))
    found = vectors(hard(own, radius, distance), bits)
    owner = F.expr("substring(instance_id, 1, length(instance_id) - length(substring_index(instance_id, '|', -1)) - 1)")
    return found.select(owner.alias("instance_id"), F.substring_index("instance_id", "|", -1).cast("int").alias("vid"), "fid", "val")
