"""Kernels, neighbours, densities, clusters and splits over sparse features (instance_id, fid, val) or dense vectors.

Neighbour lists hold the instance itself and order by kernel, then id; kernels are rounded to DIGITS before they are
compared, so that ties don't hang on the order of a sum.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandgraph.functions.hashing import minhash_family
from strandgraph.functions.vectors import dot
from strandgraph.operators import metrics, ranks
from strandgraph.operators.train import SHUFFLE, shuffle_key
from strandgraph.storage import materialize, small

DIGITS = 6
#: Rows of a block of vectors held against another block, and rows of it whose products are in memory at once.
BLOCK, AT_ONCE = 16384, 256


# ---- kernels -----------------------------------------------------------------------------------------------------


#: Rows of one list that meet those of another in one group of a join.
LIST = 2000


def meetings(rows: DataFrame, key: Sequence[str], id: str, value: str | None = None, size: int | None = None) -> DataFrame:
    """(key, u, v, x, y) of every two rows of one key, each unordered pair once and each row with itself; x, y are their values.

    A key's rows are its list. Lists of more than size rows are cut into blocks by a hash of the id; every two blocks of a
    list meet in a group of their own, so a list of any length is spread over as many groups as it has pairs of blocks,
    and no group holds more than about size rows of each side. u <= v where value is None; else x belongs to u and y to v.
    """
    return _meetings(materialize(rows.select(*key, id, *([value] if value else [])), "lists"), key, id, value, size)


def _meetings(rows: DataFrame, key: Sequence[str], id: str, value: str | None = None, size: int | None = None) -> DataFrame:
    """meetings() of rows that are written already."""
    size = size or LIST
    long = small(rows.groupBy(*key).agg(F.ceil(F.count("*") / size).cast("int").alias("_n")).where("_n > 1"))  # one row for size rows
    value = F.col(value) if value else F.lit(None).cast("double")
    cut = rows.select(*key, F.col(id).alias("_id"), value.alias("_v")).join(long, list(key), "left").withColumn("_n", F.coalesce("_n", F.lit(1)))
    cut = cut.withColumn("_b", F.pmod(F.xxhash64("_id"), F.col("_n")).cast("int"))
    a = cut.select(*key, F.col("_id").alias("u"), F.col("_v").alias("x"), F.col("_b").alias("_i"), F.explode(F.sequence("_b", F.col("_n") - 1)).alias("_j"))
    b = cut.select(*key, F.col("_id").alias("v"), F.col("_v").alias("y"), F.col("_b").alias("_j"), F.explode(F.sequence(F.lit(0), F.col("_b"))).alias("_i"))
    met = a.join(b, [*key, "_i", "_j"]).where("_i < _j OR u <= v")
    turned = F.col("u") > F.col("v")
    return met.select(*key, F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), F.when(turned, F.col("y")).otherwise(F.col("x")).alias("x"), F.when(turned, F.col("x")).otherwise(F.col("y")).alias("y"))


#: Instances of one side of a block of pairs, and the share of all pairs that must meet, on the average, for blocks to be taken.
SIDE, DENSE = 1024, 0.05


def crowded(rows: DataFrame, key: Sequence[str], id: str) -> bool:
    """Whether the rows (key, id) meet so often by key that going over all pairs in blocks is less work than joining them."""
    lists = rows.groupBy(*key).agg(F.count("*").cast("double").alias("c")).agg(F.sum(F.col("c") * (F.col("c") + 1) / 2)).first()[0]
    n = rows.agg(F.approx_count_distinct(id)).first()[0]
    return (lists or 0) >= DENSE * n * (n + 1) / 2


def in_blocks(rows: DataFrame, id: str, least: int = 1, side: int | None = None) -> DataFrame:
    """(u, v, k, shared), u <= v, of all pairs with least features in common and the sums of their products; rows (id, f long, x double), no nulls.

    Instances are cut into blocks, and every two blocks meet in a group, which adds up in a matrix and gives each pair once: no
    row is made for a feature that a pair shares, and nothing is shuffled but an instance's features, once for each block.
    """
    side, kind = side or SIDE, rows.schema[id].dataType.simpleString()
    packed = materialize(rows.groupBy(F.col(id).alias("id")).agg(F.collect_list(F.struct("f", "x")).alias("p")).select("id", "p.f", "p.x"), "packed")
    n = max(1, -(-packed.count() // side))
    cut = packed.withColumn("b", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int"))
    groups = min(n * (n + 1) // 2, 2000)
    a = cut.select(F.col("b").alias("i"), F.explode(F.sequence("b", F.lit(n - 1))).alias("j"), "id", "f", "x").repartition(groups, "i", "j")
    b = cut.select(F.explode(F.sequence(F.lit(0), "b")).alias("i"), F.col("b").alias("j"), *[F.col(c).alias(f"{c}_") for c in ("id", "f", "x")]).repartition(groups, "i", "j")

    def meet(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.rename_columns(left.column_names)
        m, ids = left.num_rows, pa.chunked_array([*left["id"].chunks, *right["id"].chunks], left.schema.field("id").type).combine_chunks()
        k, shared = _products(left, right)
        known = pc.unique(ids)
        place = pc.index_in(ids, known.take(pc.sort_indices(known))).to_numpy()
        found = shared >= least
        if key[0].as_py() == key[1].as_py():  # a block with itself
            found &= place[:m, None] <= place[None, m:]
        r, c = np.nonzero(found)
        turned = place[r] > place[m + c]
        u, v = np.where(turned, m + c, r), np.where(turned, r, m + c)
        return pa.table([ids.take(pa.array(u)), ids.take(pa.array(v)), pa.array(k[r, c]), pa.array(shared[r, c].astype(np.int64))], ["u", "v", "k", "shared"])

    return a.groupBy("i", "j").cogroup(b.groupBy("i", "j")).applyInArrow(meet, f"u {kind}, v {kind}, k double, shared long")


def _products(left: pa.Table, right: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """For two blocks of lists f, x: the sums of products of the common features, and their numbers, of each row with each."""

    def entries(t: pa.Table) -> list[np.ndarray]:
        f, x = t["f"].combine_chunks(), t["x"].combine_chunks()
        return [np.repeat(np.arange(t.num_rows), pc.list_value_length(f).to_numpy()), f.flatten().to_numpy(), x.flatten().to_numpy()]

    k, shared = np.zeros((left.num_rows, right.num_rows)), np.zeros((left.num_rows, right.num_rows), np.float32)
    sides = [entries(left), entries(right)]
    common = np.intersect1d(sides[0][1], sides[1][1])
    if not len(common):
        return k, shared
    met = []
    for rows, f, x in sides:
        at = np.minimum(np.searchsorted(common, f), len(common) - 1)
        is_common = common[at] == f
        # One entry for each feature and row: repeated ones count as often as they are there.
        key, where = np.unique(at[is_common] * (int(rows.max()) + 1) + rows[is_common], return_inverse=True)
        met.append((key // (int(rows.max()) + 1), key % (int(rows.max()) + 1), np.bincount(where, x[is_common]), np.bincount(where).astype(np.float32)))
    ends = [np.searchsorted(f, np.arange(len(common) + 1)) for f, *_ in met]
    often = np.diff(ends[0]) * np.diff(ends[1]) * 8 > k.size
    often &= np.isfinite(met[0][2]).all() and np.isfinite(met[1][2]).all()
    for start in range(0, int(often.sum()), SIDE):  # what most have, as matrices
        some = np.flatnonzero(often)[start : start + SIDE]
        filled = []
        for (f, row, x, count), size in zip(met, k.shape, strict=True):
            at = np.minimum(np.searchsorted(some, f), len(some) - 1)
            here = some[at] == f
            for v, kind in ((x, float), (count, np.float32)):
                matrix = np.zeros((size, len(some)), kind)
                matrix[row[here], at[here]] = v[here]
                filled.append(matrix)
        k += filled[0] @ filled[2].T
        shared += filled[1] @ filled[3].T
    for i in np.flatnonzero(~often):
        (a, b), (c, d) = ends[0][i : i + 2], ends[1][i : i + 2]
        at = np.ix_(met[0][1][a:b], met[1][1][c:d])
        k[at] += np.outer(met[0][2][a:b], met[1][2][c:d])
        shared[at] += np.outer(met[0][3][a:b], met[1][3][c:d])
    return k, shared


def kernel(features: DataFrame) -> DataFrame:
    """(u, v, k) of all pairs u <= v that share a feature; pairs without have kernel 0."""
    rows = materialize(features.select("instance_id", "fid", "val"), "lists")
    if crowded(rows, ["fid"], "instance_id") and rows.where("instance_id IS NULL OR fid IS NULL OR val IS NULL").isEmpty():
        return in_blocks(rows.select("instance_id", F.col("fid").cast("long").alias("f"), F.col("val").cast("double").alias("x")), "instance_id").select("u", "v", "k")
    return _meetings(rows, ["fid"], "instance_id", "val").groupBy("u", "v").agg(F.sum(F.col("x") * F.col("y")).alias("k"))


def kernel_candidates(features: DataFrame, threshold: float) -> DataFrame:
    """(u, v), u <= v: a superset of the pairs whose kernel is threshold or more, found without the commonest features.

    Features are ordered by falling frequency. The products of an instance's first features with the largest weight that each has
    anywhere add up to a bound of what they can give to any kernel; as long as it stays below threshold they aren't
    indexed. The rarest feature that a pair of such a kernel shares is then indexed for both: were it not for one of
    them, no shared feature would be, and the kernel would stay below. threshold must be positive; values may be negative.
    """
    if threshold <= 0:
        raise ValueError("threshold must be positive")
    known = features.groupBy("fid").agg(F.count("*").alias("_c"), F.max(F.abs("val")).alias("_m"))
    rows = features.where("val <> 0").join(small(known), "fid")
    order = Window.partitionBy("instance_id").orderBy(F.desc("_c"), "fid").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_bound", F.sum(F.abs("val") * F.col("_m")).over(order)).where(F.col("_bound") >= threshold - 10**-DIGITS)
    return meetings(rows, ["fid"], "instance_id").select("u", "v").distinct()


def kernel_above(features: DataFrame, threshold: float) -> DataFrame:
    """(u, v, k) of all pairs u <= v whose kernel, rounded, is threshold or more: exact, from kernel_candidates()."""
    features = materialize(features.select("instance_id", "fid", "val"), "features")
    found = sparse_kernels(kernel_candidates(features, threshold), features)
    return found.withColumn("k", F.round("k", DIGITS)).where(F.col("k") >= threshold)


def symmetric(k: DataFrame) -> DataFrame:
    """Both orders of each pair."""
    return k.select("u", "v", "k").unionByName(k.where("u <> v").select(F.col("v").alias("u"), F.col("u").alias("v"), "k"))


def _matrix(t: pa.Table, column: str) -> np.ndarray:
    return t[column].combine_chunks().flatten().to_numpy().astype(float, copy=False).reshape(t.num_rows, -1)


def _nearest(k: int):
    """For cogrouped queries (qid, qv, least) and vectors (id, v): each query's k vectors of largest rounded product, of least or more."""
    target = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("k", pa.float64())])

    def top(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.Table.from_pylist([], schema=target)
        qids, ids, least = left["qid"].to_numpy(), right["id"].to_numpy(), left["least"].to_numpy().astype(float)
        q, x, out = _matrix(left, "qv"), _matrix(right, "v").T, ([], [], [])
        for start in range(0, len(q), AT_ONCE):
            part = q[start : start + AT_ONCE] @ x
            edge = least[start : start + AT_ONCE]
            if len(ids) > k and np.isnan(edge).any():
                edge = np.fmax(np.partition(part, len(ids) - k, axis=1)[:, len(ids) - k], edge)
            # What rounds to the edge or more lies no further below it than two roundings.
            at, near = np.nonzero(part >= np.where(np.isnan(edge), -np.inf, edge)[:, None] - 2 * 10**-DIGITS)
            found = np.round(part[at, near], DIGITS)
            order = np.lexsort((ids[near], -found, at))
            at, near, found = at[order], near[order], found[order]
            first = np.arange(len(at)) - np.searchsorted(at, at) < k
            for o, v in zip(out, (qids[start + at[first]], ids[near[first]], found[first]), strict=True):
                o.append(v)
        return pa.table([pa.array(np.concatenate(o), f.type) for o, f in zip(out, target, strict=True)], schema=target)

    return top


#: Pivots at most: what a task holds each vector against to find its cell.
PIVOTS = 1024


class Cells:
    """Vectors dealt to their nearest pivot, with what each cell can hold for a query.

    By Cauchy and Schwarz the product of a query q with a vector at distance d from pivot c is at most q·c + |q| d, so a cell's
    bound is q·c + |q| radius. Pivots are vectors taken by a hash of the id; the driver holds them and, for each, the
    cell's size and radius. Cells are cut into parts of about block vectors.
    """

    def __init__(self, vectors: DataFrame, block: int, cells: int | None = None):
        n = vectors.count()
        few = vectors.orderBy(F.xxhash64("id"), "id").limit(min(PIVOTS, cells or max(1, -(-n // block)))).collect()
        self.pivots = pivots = np.array([r.v for r in few], float)
        self.block, self.kind = block, vectors.schema["v"].dataType.simpleString()

        def assign(batches):
            for batch in batches:
                if batch.num_rows:
                    apart = _apart(_matrix(pa.table({"v": batch.column(1)}), "v"), pivots)
                    near = apart.argmin(1)
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near.astype(np.int32)), pa.array(apart[np.arange(len(near)), near])], ["id", "v", "cell", "apart"])

        dealt = materialize(vectors.mapInArrow(assign, f"id {vectors.schema['id'].dataType.simpleString()}, v {self.kind}, cell int, apart double"), "cells")
        stats = {r.cell: (r.n, r.radius) for r in dealt.groupBy("cell").agg(F.count("*").alias("n"), F.max("apart").alias("radius")).collect()}  # PIVOTS rows at most
        self.radius = np.array([stats.get(i, (0, -np.inf))[1] for i in range(len(few))])
        self.parts = {i: -(-m // block) for i, (m, _) in stats.items()}
        self.sizes = {i: m for i, (m, _) in stats.items()}
        self.dealt = dealt

    def visits(self, queries: DataFrame, own: bool) -> DataFrame:
        """(qid, qv, least, cell): the cells that queries (qid, qv, least) go to; own: the cell they lie in themselves, else all others that may hold a product of least."""
        pivots, radius = self.pivots, self.radius

        def choose(batches):
            for batch in batches:
                if not batch.num_rows:
                    continue
                q = _matrix(pa.table({"q": batch.column(1)}), "q")
                apart = _apart(q, pivots)
                apart[:, np.isinf(radius)] = np.inf
                home = np.zeros(apart.shape, bool)
                home[np.arange(len(q)), apart.argmin(1)] = True
                if own:
                    go = home
                else:
                    with np.errstate(invalid="ignore"):
                        most = q @ pivots.T + np.linalg.norm(q, axis=1)[:, None] * radius
                    least = np.array([-np.inf if x is None else x for x in batch.column(2).to_pylist()])
                    go = ~home & ~np.isinf(radius) & (most >= least[:, None] - 2 * 10**-DIGITS)
                for cell in np.flatnonzero(go.any(0)):  # one batch for each cell: no more rows at once than came in
                    here = pa.array(np.flatnonzero(go[:, cell]))
                    yield pa.RecordBatch.from_arrays([*[batch.column(i).take(here) for i in range(3)], pa.array(np.full(len(here), cell, np.int32))], ["qid", "qv", "least", "cell"])

        return queries.select("qid", "qv", "least").mapInArrow(choose, f"qid long, qv {queries.schema['qv'].dataType.simpleString()}, least double, cell int")

    def meet(self, visits: DataFrame, k: int) -> DataFrame:
        """(u, v, k): of every visit the k vectors of largest product in the cell, part by part."""
        spark = visits.sparkSession
        asked = {r.cell: r["count"] for r in visits.groupBy("cell").count().collect()}  # PIVOTS rows at most
        plan = spark.createDataFrame([(c, self.parts[c], -(-n // self.block)) for c, n in asked.items()], "cell int, parts int, groups int")
        q = visits.join(F.broadcast(plan), "cell").select("qid", "qv", "least", "cell", F.pmod(F.xxhash64("qid"), F.col("groups")).cast("int").alias("g"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("p"))
        d = self.dealt.join(F.broadcast(plan), "cell").select("id", "v", F.col("cell").alias("c"), F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("h"), F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("l"))
        return q.groupBy("cell", "g", "p").cogroup(d.groupBy("c", "h", "l")).applyInArrow(_nearest(k), "u long, v long, k double")

    def deal(self, homes: DataFrame) -> DataFrame:
        """(task, kind, cell, id, v, least): queries (kind 0) and vectors (1), one partition for each task.

        Queries are dealt to groups and vectors to parts, each group meets each part in one partition, which holds the queries
        and what they have found, while vectors go by cell by cell. So vectors are copied once for each group and queries once for
        each part, and there are no more of these with more rows until a group's queries would take more than HELD numbers.
        """
        n, wide = homes.count(), self.pivots.shape[1]
        groups = max(1, min(TASKS, -(-n // 1024)), -(-n * wide // HELD))
        parts = min(TASKS, max(1, len(self.parts)))
        task = lambda g, p: (g * parts + p).cast("int").alias("task")
        q = homes.select(F.col("qid").alias("id"), F.col("qv").alias("v"), "least", "cell", F.pmod(F.xxhash64("qid"), F.lit(groups)).alias("_g"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("_p"))
        d = self.dealt.select("id", "v", F.lit(None).cast("double").alias("least"), "cell", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("_g"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(parts)).alias("_p"))
        both_kind = "array<float>" if self.kind == homes.schema["qv"].dataType.simpleString() == "array<float>" else "array<double>"
        rows = lambda df, kind: df.select(task(F.col("_g"), F.col("_p")), F.lit(kind).alias("kind"), "cell", F.col("id").cast("long").alias("id"), F.col("v").cast(both_kind).alias("v"), "least")
        return rows(q, 0).unionByName(rows(d, 1)).repartitionById(groups * parts, "task").sortWithinPartitions("task", "kind", "cell")

    def sweep(self, homes: DataFrame, k: int) -> DataFrame:
        """(u, v, k): of each query (qid, qv, least, cell) its k vectors of largest product, of least or more, outside of its cell."""
        pivots, radius = self.pivots, self.radius

        def run(batches):
            asked, held = [], None
            for batch in batches:
                if not batch.num_rows:
                    continue
                t = pa.Table.from_batches([batch])
                kinds, cells = t["kind"].to_numpy(), t["cell"].to_numpy()
                first = int(np.searchsorted(kinds, 1))
                if first:
                    part = t.slice(0, first)
                    asked.append((part["id"].to_numpy(), _plain(part), np.array(part["least"].to_pylist(), float), cells[:first]))
                if first == len(kinds) or not asked:
                    continue
                held = held or Sweep(k, *[np.concatenate(x) for x in zip(*asked, strict=True)])
                edges = [first, *(np.flatnonzero(np.diff(cells[first:])) + first + 1), len(cells)]
                for a, b in zip(edges, edges[1:], strict=False):
                    one = t.slice(a, b - a)
                    held.meet(one["id"].to_numpy(), _plain(one), int(cells[a]), pivots[cells[a]], radius[cells[a]])
            if held:
                yield from held.found()

        return self.deal(homes).mapInArrow(run, "u long, v long, k double")


#: Groups of queries, and parts of vectors, that are made at most as long as a group's queries have HELD numbers at most.
TASKS, HELD = 6, 1 << 24


def _plain(t: pa.Table) -> np.ndarray:
    return t["v"].combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1)


class Sweep:
    """Queries and the k nearest that they have found so far, while vectors go by."""

    def __init__(self, k: int, ids: np.ndarray, q: np.ndarray, least: np.ndarray, homes: np.ndarray):
        self.k, self.ids, self.q, self.homes = k, ids, q, homes
        self.norms = np.sqrt(np.einsum("ij,ij->i", q, q, dtype=float))
        self.edge = np.where(np.isnan(least), -np.inf, least)
        self.best, self.near = np.full((len(q), k), -np.inf), np.zeros((len(q), k), np.int64)

    def meet(self, ids: np.ndarray, x: np.ndarray, cell: int, pivot: np.ndarray, radius: float) -> None:
        """Vectors of one cell: queries that it may hold something for are multiplied with all of them."""
        longest = float(np.sqrt(np.einsum("ij,ij->i", x, x, dtype=float).max()))
        for start in range(0, len(self.q), 4096):
            rows = slice(start, start + 4096)
            most = self.q[rows] @ pivot + self.norms[rows] * radius
            able = start + np.flatnonzero((self.homes[rows] != cell) & ~(most < self.edge[rows] - 2 * 10**-DIGITS))
            for at in range(0, len(able), AT_ONCE):
                self._multiply(able[at : at + AT_ONCE], ids, x, longest)

    def _multiply(self, some: np.ndarray, ids: np.ndarray, x: np.ndarray, longest: float) -> None:
        # Single-precision vectors are looked through in single precision, whose error by Cauchy and Schwarz is below slack.
        slack = (x.shape[1] + 4) * 2.0**-23 * float(self.norms[some].max()) * longest if x.dtype == np.float32 else 0.0
        q = self.q[some]
        part = q @ x.T if slack <= 1e-3 else q.astype(float) @ x.T.astype(float)
        edge = self.edge[some] - 2 * 10**-DIGITS - (slack if slack <= 1e-3 else 0.0)
        if len(ids) > self.k and np.isinf(edge).any():
            edge = np.fmax(edge, np.partition(part, len(ids) - self.k, axis=1)[:, len(ids) - self.k].astype(float) - 2 * 10**-DIGITS - 2 * (slack if slack <= 1e-3 else 0.0))
        low = edge.astype(part.dtype)
        at, near = np.nonzero(part >= np.where(low > edge, np.nextafter(low, np.array(-np.inf, part.dtype)), low)[:, None])
        if not len(at):
            return
        found = np.round(np.einsum("ij,ij->i", q[at].astype(float), x[near].astype(float)), DIGITS)
        touched, at = np.unique(at, return_inverse=True)
        mine = some[touched]
        row = np.concatenate([np.repeat(np.arange(len(mine)), self.k), at])
        value, who = np.concatenate([self.best[mine].ravel(), found]), np.concatenate([self.near[mine].ravel(), ids[near]])
        order = np.lexsort((who, -value, row))
        row, value, who = row[order], value[order], who[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        kept = place < self.k
        self.best[mine[row[kept]], place[kept]], self.near[mine[row[kept]], place[kept]] = value[kept], who[kept]
        self.edge[mine] = np.fmax(self.edge[mine], self.best[mine, -1])

    def found(self):
        for start in range(0, len(self.ids), 4096):
            best = self.best[start : start + 4096]
            at, place = np.nonzero(best > -np.inf)
            yield pa.RecordBatch.from_arrays([pa.array(self.ids[start + at]), pa.array(self.near[start + at, place]), pa.array(best[at, place])], ["u", "v", "k"])


def _apart(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances of rows to pivots, with a little added for what rounding may have lost."""
    squares = (x * x).sum(1)[:, None] + (pivots * pivots).sum(1) - 2 * x @ pivots.T
    return np.sqrt(np.maximum(squares, 0)) + 1e-6


def dense_neighbours(queries: DataFrame, vectors: DataFrame, k: int, id: str = "vec_id", vector: str = "embedding", block: int = BLOCK, cells: int | None = None) -> DataFrame:
    """(u, v, k, rank): for each query its k vectors of largest inner product, the query itself among them; exact.

    Queries first meet the cell they lie in. The k-th product found there bounds what they still look for: they go on to
    those cells alone that may hold as much, and what no cell can give them isn't computed. Vectors without any structure have cells
    that hold all of it, and then every query meets every cell. Null vectors take no part. Single-precision vectors are
    shuffled as they are; products are made in double precision.
    """
    kind = lambda df: "array<float>" if df.schema[vector].dataType.simpleString() == "array<float>" else "array<double>"
    x = materialize(vectors.where(F.col(vector).isNotNull()).select(F.col(id).cast("long").alias("id"), F.col(vector).cast(kind(vectors)).alias("v")), "vectors")
    q = queries.where(F.col(vector).isNotNull()).select(F.col(id).cast("long").alias("qid"), F.col(vector).cast(kind(queries)).alias("qv"))
    parted = Cells(x, block, cells)
    if not len(parted.pivots):
        return ranked(q.select(F.col("qid").alias("u"), F.col("qid").alias("v"), F.lit(0.0).alias("k")).where("false"), k)
    homes = parted.visits(q.withColumn("least", F.lit(None).cast("double")), True)
    if len(parted.pivots) == 1:
        return ranked(parted.meet(homes, k), k)
    homes = materialize(homes, "homes")
    first = materialize(ranked(parted.meet(homes, k), k), "home")
    least = first.where(F.col("rank") == k).select(F.col("u").alias("qid"), F.col("k").alias("least"))
    more = parted.sweep(homes.drop("least").join(least, "qid", "left"), k)
    return ranked(first.drop("rank").unionByName(more), k)


def dense_kernels(pairs: DataFrame, vectors: DataFrame, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(u, v, k): the inner products of the given pairs (u, v), each pair once."""
    x = vectors.select(F.col(id).alias("u"), F.col(vector).cast("array<double>").alias("x"))
    y = x.select(F.col("u").alias("v"), F.col("x").alias("y"))
    met = pairs.select("u", "v").distinct().join(x, "u").join(y, "v")
    return met.select("u", "v", F.round(dot(F.col("x"), F.col("y")), DIGITS).alias("k"))


def members(neighbours: DataFrame) -> DataFrame:
    """(u, a, b): the ordered pairs of different members of u's neighbourhood."""
    return neighbours.select("u", F.col("v").alias("a")).join(neighbours.select("u", F.col("v").alias("b")), "u").where("a <> b")


def vector_sum(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """One row (n, total): the number of vectors and their sum, added up within tasks first; no row for no vectors."""
    rows = vectors.where(F.col(vector).isNotNull()).select(F.col(vector).cast("array<double>").alias("v"))

    def add(batches):
        n, total = 0, None
        for batch in batches:
            x = _matrix(pa.table({"v": batch.column(0)}), "v") if batch.num_rows else np.empty((0, 0))
            if len(x):
                n, total = n + len(x), x.sum(0) if total is None else total + x.sum(0)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total.tolist()])], ["n", "v"])

    parts = rows.mapInArrow(add, "n long, v array<double>").select("n", F.posexplode("v").alias("i", "x"))
    return parts.groupBy("i").agg(F.sum("x").alias("x"), F.sum("n").alias("n")).agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("i", "x"))).alias("p")).where("n IS NOT NULL").select("n", F.col("p.x").alias("total"))


def dense_density(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, density): mean inner product of each vector with all others; null for a single one.

    The products of one vector with all are its product with their sum, so no two vectors meet.
    """
    x = vectors.where(F.col(vector).isNotNull()).select(id, F.col(vector).cast("array<double>").alias("x"))
    met = x.crossJoin(F.broadcast(vector_sum(vectors, vector)))  # one row
    return met.select(id, ((dot(F.col("x"), F.col("total")) - dot(F.col("x"), F.col("x"))) / F.expr("nullif(n - 1, 0)")).alias("density"))


def similarity_to_set(queries: DataFrame, members: DataFrame, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, similarity): the mean inner product of each query with all members, itself included if it is one of them; no rows without members."""
    x = queries.where(F.col(vector).isNotNull()).select(id, F.col(vector).cast("array<double>").alias("x"))
    met = x.crossJoin(F.broadcast(vector_sum(members, vector)))  # one row
    return met.select(id, (dot(F.col("x"), F.col("total")) / F.col("n")).alias("similarity"))


def kernels_to(centres: DataFrame, vectors: DataFrame, keep: Sequence[str] = (), id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(u, v, k, keep...): the inner product of each of a few centres with every vector, in one pass; nothing is shuffled.

    centres: as many as the caller has drawn; their vectors are sent to the tasks.
    """
    few = centres.where(F.col(vector).isNotNull()).select(F.col(id).alias("u"), F.col(vector).cast("array<double>").alias("x")).collect()
    ids, matrix = np.array([r.u for r in few], np.int64), np.array([r.x for r in few], float)
    rows = vectors.where(F.col(vector).isNotNull()).select(F.col(id).cast("long").alias("v"), F.col(vector).cast("array<double>").alias("x"), *keep)

    def run(batches):
        for batch in batches:
            if not batch.num_rows or not len(ids):
                continue
            products = np.round(_matrix(pa.table({"x": batch.column(1)}), "x") @ matrix.T, DIGITS)
            at = np.repeat(np.arange(batch.num_rows), len(ids))
            columns = [pa.array(np.tile(ids, batch.num_rows)), batch.column(0).take(pa.array(at)), pa.array(products.ravel())]
            yield pa.RecordBatch.from_arrays([*columns, *[batch.column(i + 2).take(pa.array(at)) for i in range(len(keep))]], ["u", "v", "k", *keep])

    kinds = ", ".join(["u long", "v long", "k double", *[f"{c} {rows.schema[c].dataType.simpleString()}" for c in keep]])
    return rows.mapInArrow(run, kinds)


# ---- neighbours --------------------------------------------------------------------------------------------------


def ranked(pairs: DataFrame, k: int | None = None) -> DataFrame:
    """(u, v, k, rank) by kernel and then v; the first k if given."""
    out = pairs.withColumn("k", F.round("k", DIGITS)).withColumn("rank", F.row_number().over(Window.partitionBy("u").orderBy(F.desc("k"), "v")))
    return out if k is None else out.where(F.col("rank") <= k)


def true_neighbours(features: DataFrame, k: int) -> DataFrame:
    """The k nearest of each instance among those that share a feature with it."""
    return ranked(symmetric(kernel(features)), k)


def _counted(met: DataFrame, least: int) -> DataFrame:
    """Both orders of the pairs that have met at least so often."""
    return _turned(met.groupBy("u", "v").agg(F.count("*").alias("shared")).where(F.col("shared") >= least))


def _turned(pairs: DataFrame) -> DataFrame:
    """Both orders of the pairs (u, v, shared), u <= v."""
    turned = F.explode(F.when(F.col("u") == F.col("v"), F.array(F.struct("u", "v"))).otherwise(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))))
    return pairs.select("shared", turned.alias("p")).select("p.u", "p.v", "shared")


#: Features of an instance that are paired with each other at most.
SHORT = 16


def shared_features(features: DataFrame, least: int = 2) -> DataFrame:
    """(u, v, shared): pairs by the inverted index of features, with at least so many in common.

    Two features or more in common are a common pair of features: instances of at most SHORT features meet by their pairs of
    features, of which most have one instance alone, and s common features give s (s - 1) / 2 common pairs. Instances of more features
    meet all others by single features.
    """
    if least != 2:
        return _counted(meetings(features.select("instance_id", "fid").distinct(), ["fid"], "instance_id"), least)
    known = features.where("instance_id IS NOT NULL AND fid IS NOT NULL")
    sets = materialize(known.groupBy("instance_id").agg(F.array_sort(F.collect_set("fid")).alias("f")).where(F.size("f") > 1), "sets")
    firsts = sets.where(F.size("f") <= SHORT).select("instance_id", "f", F.posexplode("f").alias("i", "a"))
    pairs = firsts.select("instance_id", "a", F.explode(F.slice("f", F.col("i") + 2, F.size("f"))).alias("b"))
    common = pairs.withColumn("n", F.count("*").over(Window.partitionBy("a", "b"))).where("n > 1")
    met = meetings(common, ["a", "b"], "instance_id").where("u <> v").groupBy("u", "v").agg(F.count("*").alias("c"))
    found = met.select("u", "v", F.round((1 + F.sqrt(1 + 8 * F.col("c"))) / 2).cast("long").alias("shared"))
    found = found.unionByName(sets.select(F.col("instance_id").alias("u"), F.col("instance_id").alias("v"), F.size("f").cast("long").alias("shared")))
    rows = sets.select("instance_id", (F.size("f") > SHORT).cast("double").alias("long"), F.explode("f").alias("fid"))
    wide = materialize(rows.where("long > 0").select("fid").distinct(), "wide")
    if not wide.isEmpty():
        more = meetings(rows.join(wide, "fid", "left_semi"), ["fid"], "instance_id", "long").where("u <> v AND (x > 0 OR y > 0)")
        found = found.unionByName(more.groupBy("u", "v").agg(F.count("*").alias("shared")).where("shared >= 2"))
    return _turned(found)


def trimmed(candidates: DataFrame, k: int, factor: int = 3) -> DataFrame:
    """The factor * k candidates of each u that share most, then smaller v; factor 0 keeps all."""
    out = candidates.withColumn("place", F.row_number().over(Window.partitionBy("u").orderBy(F.desc("shared"), "v")))
    return out if not factor else out.where(F.col("place") <= factor * k)


def reranked(candidates: DataFrame, features: DataFrame, k: int) -> DataFrame:
    """The k candidates of largest kernel."""
    a = features.select(F.col("instance_id").alias("u"), "fid", F.col("val").alias("x"))
    b = features.select(F.col("instance_id").alias("v"), "fid", F.col("val").alias("y"))
    pairs = candidates.select("u", "v").join(a, "u").join(b, ["v", "fid"]).groupBy("u", "v").agg(F.sum(F.col("x") * F.col("y")).alias("k"))
    return ranked(pairs, k)


def signatures(features: DataFrame, hashes: int = 30, compact: int = 1) -> DataFrame:
    """(instance_id, k, minhash): the least hash of an instance's features for each hash function; groups of compact added up.

    Features are shuffled once, before they are hashed; an instance's hashes are least values of one row. Repeated features count once.
    """
    dealt = features.select("instance_id", "fid").repartition("instance_id")
    least = dealt.groupBy("instance_id").agg(*[F.min(minhash_family(F.lit(k), F.col("fid"))).alias(f"_{k}") for k in range(hashes)])
    sums = [sum((F.col(f"_{k}") for k in range(i + 1, min(i + compact, hashes))), F.col(f"_{i}")) for i in range(0, hashes, compact)]
    return least.select("instance_id", F.posexplode(F.array(*sums)).alias("k", "minhash"))


def bin_statistics(bins: DataFrame) -> DataFrame:
    """Statistics of the sizes of the bins, each bin counted once for every instance in it."""
    sizes = bin_sizes(bins).groupBy(F.col("n").alias("size")).agg(F.sum("n").alias("times"))
    return metrics.statistics(materialize(sizes, "sizes"), "size", null=None, weight="times")


def bin_sizes(bins: DataFrame) -> DataFrame:
    """(k, minhash, n) of the bins of the table of signatures."""
    return bins.groupBy("k", "minhash").agg(F.count("*").alias("n"))


def shared_bins(bins: DataFrame, least: int = 2) -> DataFrame:
    """(u, v, shared): pairs that fall into at least so many common bins."""
    rows = materialize(bins.select("k", "minhash", "instance_id"), "lists")
    fits = f"k BETWEEN 0 AND {(1 << 22) - 1} AND minhash BETWEEN 0 AND {(1 << 40) - 1} AND instance_id IS NOT NULL"  # one number tells a bin
    if least > 0 and crowded(rows, ["k", "minhash"], "instance_id") and rows.where(f"NOT coalesce({fits}, false)").isEmpty():
        bin = (F.col("k").cast("long") * (1 << 40) + F.col("minhash")).alias("f")
        return _turned(in_blocks(rows.select("instance_id", bin, F.lit(1.0).alias("x")), "instance_id", least).select("u", "v", "shared"))
    return _counted(_meetings(rows, ["k", "minhash"], "instance_id"), least)


def alike(features: DataFrame) -> DataFrame:
    """(instance_id, class): class is the least id of the instances that have the same set of features, whose least hashes are equal."""
    sets = features.select("instance_id", "fid").distinct().groupBy("instance_id").agg(F.array_sort(F.collect_list("fid")).alias("_set"))
    keyed = sets.withColumn("_h", F.sha2(F.concat_ws(",", F.col("_set").cast("array<string>")), 256)).select("instance_id", "_h")
    least = keyed.groupBy("_h").agg(F.min("instance_id").alias("class"))
    return materialize(keyed.join(least, "_h").select("instance_id", "class"), "alike")


def nearest_bins(features: DataFrame, k: int, hashes: int = 30) -> DataFrame:
    """(u, v, shared, place): what trimmed(shared_bins(signatures(features, hashes)), k, 1) gives, without a pair of two copies.

    Instances of the same features have the same bins, and so the same candidates: those are found between classes, and of each
    class only its k least ids can be among the first k.
    """
    known = alike(features)
    few = features.join(known.where("instance_id = class"), "instance_id", "left_semi")
    met = shared_bins(signatures(few, hashes)).select(F.col("u").alias("class"), F.col("v").alias("_other"), "shared")
    first = known.withColumn("_i", F.row_number().over(Window.partitionBy("class").orderBy("instance_id"))).where(F.col("_i") <= k)
    first = materialize(first.select(F.col("class").alias("_other"), F.col("instance_id").alias("v")), "first")
    near = trimmed(met.join(first, "_other").select(F.col("class").alias("u"), "v", "shared"), k, 1)
    near = materialize(near.select(F.col("u").alias("class"), "v", "shared", "place"), "classes")
    return known.select(F.col("instance_id").alias("u"), "class").join(near, "class").select("u", "v", "shared", "place")


def approximate_neighbours(features: DataFrame, k: int, hashes: int = 30, factor: int = 3, rerank: bool = True) -> DataFrame:
    """Candidates by common bins, trimmed, then ranked by kernel unless rerank is off."""
    near = nearest_bins(features, factor * k, hashes) if factor else trimmed(shared_bins(signatures(features, hashes)), k, factor)
    return reranked(near, features, k) if rerank else near


def vote(neighbours: DataFrame, labels: DataFrame) -> DataFrame:
    """(u, prediction): the commonest label of the neighbours, ties to the first label; labels (instance_id, label)."""
    counts = neighbours.join(labels.select(F.col("instance_id").alias("v"), "label"), "v").groupBy("u", "label").agg(F.count("*").alias("n"))
    return counts.groupBy("u").agg(F.min(F.struct((-F.col("n")).alias("order"), "label")).alias("x")).select("u", F.col("x.label").alias("prediction"))


# ---- densities, clusters, splits ---------------------------------------------------------------------------------


def neighbourhood_density(neighbours: DataFrame) -> DataFrame:
    """(u, density): mean kernel to the neighbours other than itself, over their number less one; null for one alone."""
    return neighbours.groupBy("u").agg(F.expr("sum(CASE WHEN u <> v THEN k END) / nullif(count(*) - 1, 0)").alias("density"))


def set_density(neighbours: DataFrame, pairs: DataFrame) -> DataFrame:
    """(u, density): mean kernel over ordered pairs of different members of u's neighbourhood; pairs (u, v, k) without a row count as 0."""
    met = members(neighbours).join(pairs.select(F.col("u").alias("a"), F.col("v").alias("b"), "k"), ["a", "b"], "left")
    return met.groupBy("u").agg((F.sum(F.coalesce("k", F.lit(0.0))) / F.count("*")).alias("density"))


#: Rows of neighbour lists that one task walks through at most.
WALK = 100_000


def _walk(marked: DataFrame, overlap: int) -> DataFrame:
    """(u, place) taken of at most WALK rows (u, place, v, held), in order of place, in one task."""

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        seen, out = set(pdf["v"][pdf["held"]]), []
        for place, near in pdf.sort_values("place").groupby("place", sort=True):
            if sum(v in seen for v in near["v"]) <= overlap:
                out.append((near["u"].iloc[0], place))
                seen.update(near["v"])
        return pd.DataFrame(out, columns=["u", "place"])

    return marked.withColumn("_one", F.lit(0)).groupBy("_one").applyInPandas(walk, marked.select("u", "place").schema)


def density_centres(neighbours: DataFrame, density: DataFrame, sample: int = 10, overlap: int = 0, top_share: float = 1.0, batch: int = 1000, few: int = WALK) -> DataFrame:
    """(centre, rank): instances by falling density whose neighbourhoods share at most overlap ids with those taken before.

    Rounds of parallel choices give what a walk down the order would. The ids of a neighbourhood that taken ones hold can
    only grow, and with those that denser undecided ones hold they are all it can ever share. So in each round an instance
    is left out once the former are more than overlap, and taken once both together aren't; the densest undecided one is
    always decided. Rounds go over the first batch instances, and over twice as many until sample are taken; the last few
    rows that are open then go to one task, which walks. Lists stay in Spark; the driver sees numbers of rows.
    """
    known = density.where("density IS NOT NULL").select("u", F.round("density", DIGITS).alias("density"))
    order = materialize(ranks.ranked(known.withColumns({"_all": F.lit(0), "_o": -F.col("density")}), ["_all"], ["_o", "u"], "place").select("u", "place"), "order")
    keep, end = int(order.count() * top_share), 0
    taken = order.where("false")
    seen = neighbours.select("v").where("false")
    while end < keep:
        start, end = end, min(keep, max(batch, 2 * end))
        part = order.where(F.col("place").between(start, end - 1))
        open_ = materialize(part.join(neighbours.select("u", "v").distinct(), "u").select("u", "place", "v"), "open")
        while n := open_.count():
            marked = open_.join(seen.withColumn("held", F.lit(True)), "v", "left").select("u", "place", "v", F.coalesce("held", F.lit(False)).alias("held"))
            if n <= few:
                won = state = materialize(_walk(marked, overlap), "decided")
            else:
                marked = marked.join(open_.groupBy("v").agg(F.min("place").alias("first")), "v")
                state = marked.groupBy("u", "place").agg(F.count_if("held").alias("least"), F.count_if(F.col("held") | (F.col("first") < F.col("place"))).alias("most"))
                state = materialize(state.where((F.col("least") > overlap) | (F.col("most") <= overlap)), "decided")
                won = state.where(F.col("most") <= overlap).select("u", "place")
            taken = materialize(taken.unionByName(won), "taken")
            seen = materialize(seen.unionByName(open_.join(won, ["u", "place"], "left_semi").select("v")).distinct(), "seen")
            if n <= few:
                break
            open_ = materialize(open_.join(state, ["u", "place"], "left_anti"), "open")
        if taken.count() >= sample:
            break
    best = taken.orderBy("place").limit(sample)
    return best.select(F.col("u").alias("centre"), F.row_number().over(Window.orderBy("place")).alias("rank"))  # sample rows


def clusters(centres: DataFrame, neighbours: DataFrame) -> DataFrame:
    """(centre, rank, member, k) of the centres' neighbourhoods."""
    return centres.join(neighbours.select(F.col("u").alias("centre"), F.col("v").alias("member"), "k"), "centre")


def cluster_statistics(centres: DataFrame, density: DataFrame) -> DataFrame:
    """Statistics of the densities of the centres (of = "centres") and of all instances (of = "all")."""
    known = density.select(F.lit("all").alias("of"), "density").unionAll(centres.join(density, F.col("centre") == F.col("u")).select(F.lit("centres").alias("of"), "density"))
    return metrics.statistics(known, "density", ["of"])


class Swaps:
    """One start's set on its way through the instances; density falls never below that of its least dense member."""

    def __init__(self, start: int, sample: int, chance: float, seed: int):
        self.start, self.sample, self.seed, self.limit = start, sample, seed, chance
        self.rows: list[tuple[float, int, np.ndarray]] = []

    def _lucky(self, u: int) -> bool:
        draw = int.from_bytes(hashlib.blake2b(f"{self.seed} {u} {self.start}".encode(), digest_size=8).digest())
        return (draw >> 11) / (1 << 53) < self.limit

    @staticmethod
    def alike(rows: list) -> float:
        return float(np.square(np.sum([x for *_, x in rows], 0)).sum() / len(rows) ** 2)

    def meet(self, density: float, u: int, x: np.ndarray) -> None:
        one = (density, u, x)
        if len(self.rows) < self.sample:
            self.rows.append(one)
        elif density > (worst := min(self.rows, key=lambda s: s[:2]))[0]:
            other = [s for s in self.rows if s is not worst] + [one]
            if self._lucky(u) or self.alike(other) < self.alike(self.rows):
                self.rows = other


def greedy_centres(density: DataFrame, vectors: DataFrame, sample: int = 10, restarts: int = 100, seed: int = 1, growth: int = 4, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(centre, rank): of seeded starts, each a random set improved by swaps, the one that is least alike and densest.

    Each start goes through all instances in an order of its own (a hash of id and start). The first sample ones are its
    set; a later one that is denser than the set's least dense takes that one's place, if the mean kernel over all
    ordered pairs of the set (with themselves) falls, or, in early starts, by chance: 1 - (start + 1) / restarts. A later
    start is better than the best so far if its set is both less alike and denser.

    The orders are cut at shares of the hashes' range, each growth times the one before. Only instances denser than a
    start's least dense member can be swapped in, and that bound never falls, so a round shuffles those of the next part of
    each order that are denser than its bound; they meet the start's set, sorted, in one task that holds the set and a
    batch of rows. The driver gets each start's bound, and its two measures at the end.
    """
    known = density.where("density IS NOT NULL").select("u", F.col("density").cast("double").alias("density"))
    known = materialize(known.join(vectors.select(F.col(id).alias("u"), F.col(vector).cast("array<double>").alias("x")), "u").where("x IS NOT NULL"), "known")
    spark, n = known.sparkSession, known.count()
    kind = known.schema["u"].dataType.simpleString()
    spread = known.withColumn("start", F.explode(F.sequence(F.lit(0), F.lit(restarts - 1)))).withColumn("h", F.xxhash64("u", "start", F.lit(seed)))
    sets = known.select(F.lit(0).alias("start"), F.lit(True).alias("own"), F.lit(0).cast("long").alias("h"), "u", "density", "x").where("false")
    bounds: list[tuple[int, float]] = [(k, float("-inf")) for k in range(restarts)]
    share, low = min(1.0, 8 * sample / max(n, 1)), -(1 << 63)

    def swap(batches):
        now = None
        done = []
        for batch in batches:
            for r in batch.to_pylist():
                if now is None or r["start"] != now.start:
                    if now:
                        done.append(now)
                    now = Swaps(r["start"], sample, 1 - (r["start"] + 1) / restarts, seed)
                one = (r["density"], r["u"], np.array(r["x"]))
                now.rows.append(one) if r["own"] else now.meet(*one)
        for s in [*done, *([now] if now else [])]:
            out = [{"start": s.start, "own": True, "h": i, "u": u, "density": d, "x": x.tolist(), "alike": s.alike(s.rows)} for i, (d, u, x) in enumerate(s.rows)]
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("start", pa.int32()), ("own", pa.bool_()), ("h", pa.int64()), ("u", pa.int64()), ("density", pa.float64()), ("x", pa.list_(pa.float64())), ("alike", pa.float64())]))

    while n:
        high = (1 << 63) - 1 if share >= 1 else -(1 << 63) + int(share * (1 << 64))
        limit = spark.createDataFrame(bounds, "start int, bound double")
        part = spread.where(F.col("h").between(low, high)).join(F.broadcast(limit), "start").where("density > bound")  # restarts rows
        rows = sets.select("start", "own", "h", "u", "density", "x").unionByName(part.select("start", F.lit(False).alias("own"), "h", "u", "density", "x"))
        rows = rows.repartition("start").sortWithinPartitions("start", F.desc("own"), "h", "u")
        sets = materialize(rows.mapInArrow(swap, "start int, own boolean, h long, u long, density double, x array<double>, alike double"), "sets")
        least = {r.start: (r.least, r.size) for r in sets.groupBy("start").agg(F.min("density").alias("least"), F.count("*").alias("size")).collect()}
        bounds = [(k, least[k][0] if k in least and least[k][1] == sample else float("-inf")) for k in range(restarts)]
        if share >= 1:
            break
        low, share = high + 1, min(1.0, share * growth)
    if not n:
        return spark.createDataFrame([], f"centre {kind}, rank int")
    best = None
    for r in sets.groupBy("start").agg(F.max("alike").alias("alike"), F.sum("density").alias("dense")).orderBy("start").collect():
        if best is None or r.alike < best.alike and r.dense > best.dense:
            best = r
    won = sets.where(F.col("start") == best.start).select(F.col("u").cast(kind).alias("centre"), F.row_number().over(Window.orderBy(F.desc("density"), "u")).alias("rank"))  # sample rows
    return won


def sampled_centres(density: DataFrame, sample: int = 10, thin: int = 4, seed: int = 1) -> DataFrame:
    """(centre, rank): a sample with chances by density, of which every thin-th by density stays.

    Weighted sampling by keys: the largest log(random) / density win, in one pass. Whole ids are shuffled by the portable
    key of the trainer, others by a hash.
    """
    whole = density.schema["u"].dataType.simpleString() in ("bigint", "int", "smallint", "tinyint")
    unit = (shuffle_key("u", seed) + 1) / float(SHUFFLE + 1) if whole else (F.pmod(F.xxhash64("u", F.lit(seed)), F.lit(1 << 30)) + 1) / float((1 << 30) + 1)
    won = density.where("density > 0").withColumn("key", F.log(unit) / F.col("density")).orderBy(F.desc("key"), "u").limit(sample * thin)
    ranked_ = won.withColumn("place", F.row_number().over(Window.orderBy(F.desc("density"), "u")))  # sample * thin rows
    return ranked_.where((F.col("place") - 1) % thin == 0).select(F.col("u").alias("centre"), (F.floor((F.col("place") - 1) / thin) + 1).cast("int").alias("rank"))


def balanced_runs(kernels: DataFrame, imbalance: float = 1.5) -> DataFrame:
    """(u, size, k, positives, negatives): for each centre the longest run of its ranking whose classes stay in balance.

    kernels: rows (u, v, k, y) of every centre with all instances, ranked by falling k, then v. In balance: the ratio of
    positives to negatives lies in (1 / imbalance, imbalance); others count in neither class but take a place. k is that of the run's last
    instance. Rankings are dealt by ranges, so a centre's may be of any length; only its last place in balance goes on.
    """
    running = {"p": (F.col("y") > 0).cast("long"), "m": (F.col("y") < 0).cast("long")}
    rows = kernels.select("u", "v", "k", F.coalesce("y", F.lit(0)).alias("y"), (-F.col("k")).alias("_o"))
    placed = ranks.ranked(rows, ["u"], ["_o", "v"], "place", running)
    placed = placed.withColumns({"p": F.col("p") + (F.col("y") > 0).cast("long"), "m": F.col("m") + (F.col("y") < 0).cast("long")})
    even = placed.where((F.col("p") < F.lit(imbalance) * F.col("m")) & (F.col("p") * F.lit(imbalance) > F.col("m")))
    last = even.groupBy("u").agg(F.max(F.struct("place", "k", "p", "m")).alias("x"))
    return last.select("u", (F.col("x.place") + 1).alias("size"), "x.k", F.col("x.p").alias("positives"), F.col("x.m").alias("negatives"))


def dataset_splits(train: DataFrame, tests: DataFrame, drawn: Sequence[str], centres: int = 10, threshold: int = 30, imbalance: float = 1.5, batch: int = 32, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(centre, rank, size, bound, positives, negatives, tests): splits around centres that are drawn from the test set.

    train (id, vector, y), tests (id, vector); drawn: SQL expressions over tests that order the draw, ties by id. A centre is
    valid if the longest run in balance of its ranking of the whole training set is longer than threshold and more than
    threshold tests are as near as the run's last instance (k >= bound). Centres are tried batch by batch, in the order
    of the draw, until so many are valid or all have been tried; twice as many at once each time, 256 at most.
    """
    keyed = tests.where(F.col(vector).isNotNull()).select(id, vector, F.lit(0).alias("_all"), *[F.expr(x).alias(f"_d{i}") for i, x in enumerate(drawn)])
    order = materialize(ranks.ranked(keyed, ["_all"], [*[f"_d{i}" for i in range(len(drawn))], id], "draw").select(id, vector, "draw"), "draw")
    found, at, n, total = None, 0, 0, order.count()
    while n < centres and (at < total or found is None):
        part = order.where(F.col("draw").between(at, at + batch - 1))
        runs = materialize(balanced_runs(kernels_to(part, train, ["y"], id, vector), imbalance).where(F.col("size") > threshold), "runs")
        able = part.join(F.broadcast(runs.select(F.col("u").alias(id))), id, "left_semi")  # batch rows at most
        near = kernels_to(able, tests, (), id, vector).join(F.broadcast(runs.select("u", F.col("k").alias("bound"))), "u").where("k >= bound").groupBy("u").agg(F.count("*").alias("tests"))
        valid = runs.join(near, "u").where(F.col("tests") > threshold).join(part.select(F.col(id).alias("u"), "draw"), "u")
        valid = materialize(valid.select(F.col("u").alias("centre"), "draw", "size", F.col("k").alias("bound"), "positives", "negatives", "tests"), "valid")
        found, n = valid if found is None else found.unionByName(valid), n + valid.count()
        at, batch = at + batch, min(2 * batch, 256)
    best = found.orderBy("draw").limit(centres)
    return best.withColumn("rank", F.row_number().over(Window.orderBy("draw"))).select("centre", "rank", "size", "bound", "positives", "negatives", "tests")  # centres rows


def split_ids(splits: DataFrame, train: DataFrame, tests: DataFrame, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(centre, part, id): for each split all training and all test instances that are as near as its bound; ties of the bound stay in."""
    centres = tests.join(F.broadcast(splits.select(F.col("centre").alias(id))), id, "left_semi")
    bounds = F.broadcast(splits.select(F.col("centre").alias("u"), "bound"))  # one row for each split
    within = lambda vectors, part: kernels_to(centres, vectors, (), id, vector).join(bounds, "u").where("k >= bound").select(F.col("u").alias("centre"), F.lit(part).alias("part"), F.col("v").alias("id"))
    return within(train, "train").unionByName(within(tests, "test"))


def sparse_kernels(pairs: DataFrame, features: DataFrame) -> DataFrame:
    """(u, v, k): the kernels of the given pairs (u, v), each pair once; pairs that share no feature have no row."""
    a = features.select(F.col("instance_id").alias("u"), "fid", F.col("val").alias("x"))
    b = features.select(F.col("instance_id").alias("v"), "fid", F.col("val").alias("y"))
    met = pairs.select("u", "v").distinct().join(a, "u").join(b, ["v", "fid"])
    return met.groupBy("u", "v").agg(F.sum(F.col("x") * F.col("y")).alias("k"))


def filtered(features: DataFrame, hashes: int = 200, neighbours: int = 10, overlap: int = 1, sample: int = 1000) -> DataFrame:
    """(instance_id) of low-overlap dense centres among the denser half: a smaller training set. Kernels are those of neighbours."""
    features = materialize(features.select("instance_id", "fid", "val"), "features")
    near = materialize(nearest_bins(features, neighbours, hashes), "near")
    met = members(near).select(F.col("a").alias("u"), F.col("b").alias("v"))
    dense = materialize(set_density(near, sparse_kernels(met, features)), "density")
    return density_centres(near, dense, sample, overlap, 0.5).select(F.col("centre").alias("instance_id"))
