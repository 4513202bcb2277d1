"""Operators over sets of graphs: vertices (graph_id, vid, label, ...) and edges (graph_id, src, dst, label).

Everything is keyed by graph_id, so graphs are worked on side by side; traversals are unrolled to their bound. Optional
Boolean columns of vertices are dead, kernel_point and viewpoint.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandgraph.storage import materialize, wide

KEY = ["graph_id", "vid"]


def alive(v: DataFrame) -> DataFrame:
    return v.where("NOT dead") if "dead" in v.columns else v


def alive_edges(v: DataFrame, e: DataFrame) -> DataFrame:
    """Edges whose ends are both alive."""
    if "dead" not in v.columns:
        return e
    live = wide(alive(v).select("graph_id", "vid"))
    return e.join(live.withColumnRenamed("vid", "src"), ["graph_id", "src"], "left_semi").join(live.withColumnRenamed("vid", "dst"), ["graph_id", "dst"], "left_semi")


def kill(v: DataFrame, label: str) -> DataFrame:
    """Vertices of the label marked dead."""
    dead = F.col("label") == label
    return v.withColumn("dead", F.col("dead") | dead if "dead" in v.columns else dead)


def distances(v: DataFrame, e: DataFrame, bound: int) -> DataFrame:
    """(graph_id, src, dst, d): distances of at most bound over alive vertices, by one join for each step.

    From the second step on each step is written out, since the next ones read it several times.
    """
    steps = alive_edges(v, e).select("graph_id", F.col("src").alias("dst"), F.col("dst").alias("to")).distinct()
    if bound > 1:
        steps = materialize(steps, "steps")
    frontier = alive(v).select("graph_id", F.col("vid").alias("src"), F.col("vid").alias("dst"), F.lit(0).alias("d"))
    reached = frontier
    for d in range(1, bound + 1):
        onward = frontier.join(wide(steps), ["graph_id", "dst"]).select("graph_id", "src", F.col("to").alias("dst")).distinct()
        frontier = onward.join(wide(reached.select("graph_id", "src", "dst")), ["graph_id", "src", "dst"], "left_anti").withColumn("d", F.lit(d))
        if bound > 1:
            frontier = materialize(frontier, "frontier")
            if frontier.isEmpty():
                break
        reached = reached.unionByName(frontier)
    return reached


def at_distance(dist: DataFrame, d: int) -> DataFrame:
    return dist.where(F.col("d") == d)


def ball(dist: DataFrame, radius: int) -> DataFrame:
    """(graph_id, root, vid): vertices at most radius away from each root."""
    return dist.where(F.col("d") <= radius).select("graph_id", F.col("src").alias("root"), F.col("dst").alias("vid"))


def distance_or_missing(pairs: DataFrame, dist: DataFrame) -> DataFrame:
    """pairs (graph_id, src, dst) with d, -1 where there is no distance."""
    return pairs.join(dist, ["graph_id", "src", "dst"], "left").withColumn("d", F.coalesce("d", F.lit(-1)))


def path_vertices(dist: DataFrame, distance: int) -> DataFrame:
    """(graph_id, src, dst, vid): vertices on shortest paths of pairs at the distance.

    A vertex counts if it is k from src and distance - k from dst, both counted outwards; in a graph with edges one way
    only, that leaves the last vertex.
    """
    pairs = at_distance(dist, distance).select("graph_id", "src", "dst")
    from_src = dist.select("graph_id", "src", F.col("dst").alias("vid"), F.col("d").alias("k"))
    from_dst = dist.select("graph_id", F.col("src").alias("dst"), F.col("dst").alias("vid"), F.col("d").alias("l"))
    met = pairs.join(from_src, ["graph_id", "src"]).join(from_dst, ["graph_id", "dst", "vid"])
    return met.where(F.col("k") + F.col("l") == distance).select("graph_id", "src", "dst", "vid").distinct()


def thick_path_vertices(dist: DataFrame, distance: int, thickness: int) -> DataFrame:
    """path_vertices() with the balls of the given radius around them."""
    around = ball(dist, thickness)
    return path_vertices(dist, distance).withColumnRenamed("vid", "root").join(around, ["graph_id", "root"]).select("graph_id", "src", "dst", "vid").distinct()


def induced(v: DataFrame, e: DataFrame, members: DataFrame, group: str = "root") -> tuple[DataFrame, DataFrame]:
    """Subgraphs of members (graph_id, group, vid): vertices and edges with the group, old ids kept, new ids as idx from 0 by old id."""
    inside = members.join(v, KEY)
    numbered = inside.withColumn("idx", F.row_number().over(Window.partitionBy("graph_id", group).orderBy("vid")) - 1)
    ends = members.select("graph_id", group, "vid")
    kept = e.join(ends.withColumnRenamed("vid", "src"), ["graph_id", "src"]).join(ends.withColumnRenamed("vid", "dst"), ["graph_id", group, "dst"])
    return numbered, kept.select("graph_id", group, "src", "dst", "label")


def sizes(v: DataFrame, e: DataFrame) -> DataFrame:
    """(graph_id, n_vertices, n_edges)."""
    n = v.groupBy("graph_id").agg(F.count("*").alias("n_vertices"))
    m = e.groupBy("graph_id").agg(F.count("*").alias("n_edges"))
    return n.join(m, "graph_id", "left").fillna(0, ["n_edges"])


def check(v: DataFrame, e: DataFrame) -> DataFrame:
    """(graph_id, problem) of graphs with edges to no vertex, repeated vertex ids, or edges but no vertices."""
    ends = e.select("graph_id", F.col("src").alias("vid")).union(e.select("graph_id", "dst"))
    loose = ends.join(v.select(*KEY), KEY, "left_anti").select("graph_id", F.lit("edge without vertex").alias("problem"))
    twice = v.groupBy(*KEY).count().where("count > 1").select("graph_id", F.lit("repeated vertex").alias("problem"))
    empty = e.select("graph_id").join(v.select("graph_id"), "graph_id", "left_anti").select("graph_id", F.lit("no vertices").alias("problem"))
    return loose.union(twice).union(empty).distinct()


def abstract(v: DataFrame) -> DataFrame:
    """All labels "0"."""
    return v.withColumn("label", F.lit("0"))


def stems(v: DataFrame, e: DataFrame, edge_label: str = "s", label: str = "S") -> DataFrame:
    """Vertices that touch an edge of the label become S."""
    hit = e.where(F.col("label") == edge_label)
    ends = hit.select("graph_id", F.col("src").alias("vid")).union(hit.select("graph_id", "dst")).distinct().withColumn("_hit", F.lit(True))
    return v.join(ends, KEY, "left").withColumn("label", F.when(F.col("_hit"), label).otherwise(F.col("label"))).drop("_hit")


def mark_viewpoints(v: DataFrame, soft: bool = False) -> DataFrame:
    """"viewpoint." (soft: "viewpoint") before the labels of viewpoints."""
    return v.withColumn("label", F.when(F.col("viewpoint"), F.concat(F.lit("viewpoint" if soft else "viewpoint."), "label")).otherwise(F.col("label")))


def joined_label(labels: Column, soft: bool = False) -> Column:
    """One label of an array of attributes: all with "." between them, or the first."""
    return F.get(labels, F.lit(0)) if soft else F.array_join(labels, ".")


def out_edge(e: DataFrame) -> DataFrame:
    """One edge for each pair of ends; of parallel ones the first by eid (or label)."""
    order = "eid" if "eid" in e.columns else "label"
    return e.groupBy("graph_id", "src", "dst").agg(F.min_by("label", order).alias("label"))


def colours(v: DataFrame, colours: int = 26) -> DataFrame:
    """(label, colour): labels in order dealt round the colours; one row for each distinct label."""
    distinct = v.select("label").distinct()
    return distinct.withColumn("colour", ((F.dense_rank().over(Window.orderBy("label")) - 1) % colours).cast("int"))
