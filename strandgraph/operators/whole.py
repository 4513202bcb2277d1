"""Codes of neighbourhoods of radius 2 and more, graph by graph.

A graph's vertices and edges are put into one row and worked on in Arrow batches: there is one small subgraph for each
vertex and radius, and as rows these are many times the graph itself. Subgraphs of equal labels and equal edges (by
places) have equal codes, so a worker remembers the codes it has made. Graphs beyond LARGEST vertices and edges are left
to the caller's joins, which keep no graph in one place.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandgraph.functions.hashing import ap_hash
from strandgraph.operators import graph as G
from strandgraph.storage import importable, wide

#: Vertices and edges of a graph that is worked on in one place, the members of all its neighbourhoods, rows handed on at
#: once, and codes that a worker remembers.
LARGEST, REACH, ROWS, KEPT = 50_000, 4_000_000, 50_000, 500_000


def large(v: DataFrame, e: DataFrame, far: int = 2) -> DataFrame:
    """(graph_id) of graphs beyond LARGEST, or whose neighbourhoods of so many steps may have over REACH members in all.

    A neighbourhood has no more members than the graph, or than the largest number of ways out of any vertex allows.
    """
    nodes = v.groupBy("graph_id").agg(F.count("*").alias("n"))
    ways = e.groupBy("graph_id", "src").agg(F.count("*").alias("w")).groupBy("graph_id").agg(F.max("w").alias("w"), F.sum("w").alias("m"))
    sizes = nodes.join(ways, "graph_id", "left").fillna(0, ["w", "m"])
    return sizes.where((F.col("n") + F.col("m") > LARGEST) | (F.col("n") * F.least("n", F.pow(F.col("w") + 1, F.lit(far))) > REACH)).select("graph_id")


class Coder:
    """Codes of subgraphs; bounded memory of those made before."""

    def __init__(self) -> None:
        self.texts: dict[str, int] = {}
        self.made: dict[tuple, int] = {}

    def text(self, s: str) -> int:
        found = self.texts.get(s)
        if found is None:
            if len(self.texts) > KEPT:
                self.texts.clear()
            found = self.texts[s] = ap_hash(s)
        return found

    def subgraph(self, labels: tuple[str, ...], edges: tuple[tuple[int, int, str], ...], bound: int, distances: tuple | None = None) -> int:
        """The code of a subgraph of vertices 0, 1, ...: distances within it (at most bound, else -1) or the given ones."""
        key = labels, edges, bound, distances
        found = self.made.get(key)
        if found is None:
            if len(self.made) > KEPT:
                self.made.clear()
            found = self.made[key] = self._subgraph(*key)
        return found

    def _subgraph(self, labels, edges, bound, distances) -> int:
        n = len(labels)
        if distances is None:
            out: list[set[int]] = [set() for _ in range(n)]
            for a, b, _ in edges:
                out[a].add(b)
            distances = [_reached(out, s, bound) for s in range(n)]
        codes = [ap_hash(sorted(self.text(f"{d.get(j, -1)}{labels[j]}") for j in range(n))) for d in map(dict, distances)]
        return ap_hash(sorted(ap_hash([min(codes[a], codes[b]), max(codes[a], codes[b]), self.text(label)]) for a, b, label in edges))


def _reached(out, start: int, bound: int) -> dict[int, int]:
    """Distances of at most bound from start; out gives the next vertices by vertex."""
    found, frontier = {start: 0}, [start]
    for d in range(1, bound + 1):
        frontier = [b for b in {b for a in frontier for b in out[a]} if b not in found]
        if not frontier:
            break
        found.update(dict.fromkeys(frontier, d))
    return found


def graph_codes(coder: Coder, vids: Sequence[int], labels: Sequence[str], edges: Sequence[tuple[int, int, str]], radii: Sequence[int], approximate: bool) -> Iterator[tuple[int, int, int]]:
    """(vid, radius, code) of each vertex of a graph."""
    label = dict(zip(vids, labels, strict=True))
    arcs: dict[int, list[tuple[int, str]]] = {x: [] for x in vids}
    for a, b, text in edges:
        if a in arcs and b in arcs:
            arcs[a].append((b, text))
    out = {a: {b for b, _ in found} for a, found in arcs.items()}
    far = 2 * max(radii) if approximate else max(radii)
    seen = {x: _reached(out, x, far) for x in vids}
    for radius in radii:
        for root in vids:
            members = sorted(x for x, d in seen[root].items() if d <= radius)
            place = {x: i for i, x in enumerate(members)}
            inside = tuple((place[a], place[b], text) for a in members for b, text in arcs[a] if b in place)
            host = tuple(tuple(sorted((place[j], d) for j, d in seen[x].items() if d <= 2 * radius and j in place)) for x in members) if approximate else None
            yield root, radius, coder.subgraph(tuple(label[x] for x in members), inside, 2 * radius, host)


def graph_paths(coder: Coder, vids: Sequence[int], labels: Sequence[str], edges: Sequence[tuple[int, int, str]], distance: int, thickness: int) -> Iterator[tuple[int, int, int, int, int]]:
    """(d, t, src, dst, code) of the thickened shortest paths of a graph.

    A vertex is on a path if it is k from src and d - k from dst, both counted outwards.
    """
    label = dict(zip(vids, labels, strict=True))
    arcs: dict[int, list[tuple[int, str]]] = {x: [] for x in vids}
    for a, b, text in edges:
        if a in arcs and b in arcs:
            arcs[a].append((b, text))
    out = {a: {b for b, _ in found} for a, found in arcs.items()}
    seen = {x: _reached(out, x, max(distance, thickness, 1)) for x in vids}
    for src in vids:
        for dst, d in seen[src].items():
            if 0 < d <= distance:
                from_dst = seen[dst]
                on = [x for x, k in seen[src].items() if k <= d and from_dst.get(x) == d - k]
                for t in range(thickness + 1):
                    members = sorted({y for x in on for y, k in seen[x].items() if k <= t})
                    if members:
                        place = {x: i for i, x in enumerate(members)}
                        inside = tuple((place[a], place[b], text) for a in members for b, text in arcs[a] if b in place)
                        yield d, t, src, dst, coder.subgraph(tuple(label[x] for x in members), inside, d + 2 * t)


def _each_graph(v: DataFrame, e: DataFrame, raw: DataFrame | None, made, names: Sequence[str]) -> DataFrame:
    """(graph_id, names...): the rows of made(coder, vids, labels, edges) of each graph; "vid", "src" and "dst" have vid's type."""
    importable(v.sparkSession)
    nodes = G.alive(v).select("graph_id", "vid", *([] if raw is not None else ["label"]))
    if raw is not None:
        nodes = nodes.join(wide(raw.select("graph_id", "vid", "label")), ["graph_id", "vid"])
    of_nodes = nodes.groupBy("graph_id").agg(F.sort_array(F.collect_list(F.struct("vid", "label"))).alias("vs"))
    of_edges = e.groupBy("graph_id").agg(F.sort_array(F.collect_list(F.struct("src", "dst", "label"))).alias("es"))
    whole = of_nodes.join(of_edges, "graph_id", "left").select("graph_id", "vs.vid", "vs.label", *[F.coalesce(f"es.{c}", F.array()).alias(f"e_{c}") for c in ("src", "dst", "label")])
    kind = v.schema["vid"].dataType.simpleString()
    types = [(kind, pa.int64() if kind == "bigint" else pa.int32()) if n in ("vid", "src", "dst") else ("bigint", pa.int64()) if n == "code" else ("int", pa.int32()) for n in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder()
        for batch in batches:
            whose, rows = [], []

            def told(batch: pa.RecordBatch = batch, whose: list = whose, rows: list = rows) -> pa.RecordBatch:
                columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
                keys = batch.column(0).take(pa.array(whose, pa.int64()))
                out = pa.RecordBatch.from_arrays([keys, *[pa.array(c, t) for c, (_, t) in zip(columns, types, strict=True)]], ["graph_id", *names])
                whose.clear()
                rows.clear()
                return out

            for i in range(batch.num_rows):
                vids, labels, *edges = (batch.column(k)[i].as_py() for k in range(1, 6))
                for row in made(coder, vids, labels, list(zip(*edges, strict=True))):
                    whose.append(i)
                    rows.append(row)
                    if len(rows) >= ROWS:
                        yield told()
            yield told()

    schema = ", ".join([f"graph_id {v.schema['graph_id'].dataType.simpleString()}", *[f"{n} {t}" for n, (t, _) in zip(names, types, strict=True)]])
    return whole.mapInArrow(run, schema)


def codes(v: DataFrame, e: DataFrame, radii: Sequence[int], raw: DataFrame | None = None, approximate: bool = False) -> DataFrame:
    """(graph_id, vid, r, code) of the alive vertices for each of the radii. raw: vertices whose labels count instead of v's."""
    return _each_graph(v, e, raw, lambda *graph: graph_codes(*graph, radii, approximate), ["vid", "r", "code"])


def path_codes(v: DataFrame, e: DataFrame, distance: int, thickness: int = 0) -> DataFrame:
    """(graph_id, d, t, src, dst, code) of the thickened shortest paths between alive vertices."""
    return _each_graph(v, e, None, lambda *graph: graph_paths(*graph, distance, thickness), ["d", "t", "src", "dst", "code"])
