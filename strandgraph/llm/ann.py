"""Nearest neighbours by multi-index hashing over learned rotated binary codes.

Codes. Unit vectors are centred, turned into their principal axes and rotated so that rounding each axis to its sign
loses least (iterative quantisation); TURNS rotations learned from different beginnings are put side by side, so a code
has TURNS bits for each dimension.

Index. A code is split into substrings of PART bits; each substring has a table from its value to the vectors that have
it. If two codes differ in at most r bits, then by the pigeonhole principle some substring differs in at most r // m bits
(and after the first r % m + 1 substrings even one bit less is enough), so probing all values that near in each table
finds every code within the radius. Where a probe would name more values than a table has, the table's own values are
gone through instead. The codes found are checked against the radius, and the vectors that remain are ranked by the
exact cosine of the original vectors in double precision.

The radius is the one that holds QUANTILE of the true neighbours within the training sample; where a block has too few
codes within it, the radius grows until enough are found. Training (axes, rotations, radius) uses about TRAIN vectors,
taken by a hash of their values; every vector is indexed.

Vectors are dealt into blocks of at most BLOCK, queries into groups of at most BLOCK, and each pair of a block and a
group is one task's work, so memory is bounded. Equal vectors are one entry of the index, with as many of their smallest
ids as can be among the answers; a vector that a third of all rows have costs no more than any other.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandgraph.llm import common

TRAIN, TURNS, PART, ROUNDS, QUANTILE, BLOCK, BLOCKS = 20_000, 4, 16, 30, 0.985, 65_536, 8
K = 5


@dataclass
class Codes:
    """mean and projection (dimensions x bits) of the codes; radius in bits."""

    mean: np.ndarray
    projection: np.ndarray
    radius: int

    @property
    def parts(self) -> int:
        return -(-self.projection.shape[1] // PART)

    def encode(self, unit: np.ndarray) -> np.ndarray:
        """Codes as rows of PART-bit numbers; bits that fill the last substring are 0."""
        bits = (unit - self.mean) @ self.projection > 0
        bits = np.pad(bits, ((0, 0), (0, self.parts * PART - bits.shape[1])))
        return np.packbits(bits, axis=1).view(">u2").astype(np.uint16)


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Rows times a power of two that brings their largest component near 1: exact, so cosines don't change, and no square overflows."""
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(1, keepdims=True))[1])


def learn(vectors: np.ndarray, k: int = K, turns: int = TURNS, seed: int = 0) -> Codes:
    """Codes from a sample of vectors (rows)."""
    rng = np.random.default_rng(seed)
    vectors = scaled(vectors)
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    mean = unit.mean(0)
    centred = unit - mean
    _, axes = np.linalg.eigh(centred.T @ centred)
    turned = centred @ axes
    d = unit.shape[1]
    projections = []
    for _ in range(turns):
        rotation = np.linalg.qr(rng.normal(size=(d, d)))[0]
        for _ in range(ROUNDS):
            u, _, v = np.linalg.svd(np.sign(turned @ rotation).T @ turned)
            rotation = (u @ v).T
        projections.append(axes @ rotation)
    codes = Codes(mean, np.concatenate(projections, 1), 0)
    probes = rng.choice(len(unit), min(len(unit), 400), replace=False)
    if len(unit) > 1:
        cosines = unit[probes] @ unit.T
        cosines[np.arange(len(probes)), probes] = -np.inf
        near = np.argsort(-cosines, axis=1)[:, : min(k, len(unit) - 1)]
        code = codes.encode(unit)
        apart = np.bitwise_count(code[probes][:, None, :] ^ code[near]).sum(2)
        codes.radius = int(np.quantile(apart, QUANTILE)) + 1
    return codes


class Block:
    """The index of one block of vectors."""

    def __init__(self, codes: Codes, ids: np.ndarray, vectors: np.ndarray):
        self.codes, self.ids, self.vectors = codes, ids, scaled(vectors)
        self.norms = np.linalg.norm(self.vectors, axis=1)
        self.code = codes.encode(self.vectors / self.norms[:, None])
        self.tables = []
        for j in range(codes.parts):
            order = np.argsort(self.code[:, j], kind="stable")
            values, starts = np.unique(self.code[order, j], return_index=True)
            self.tables.append((order, values, np.append(starts, len(order))))
        self._masks: dict[int, np.ndarray] = {}

    def _near_values(self, j: int, value: int, radius: int) -> np.ndarray:
        """Places in the j-th table of the values within radius bits of value."""
        values = self.tables[j][1]
        if radius <= 3:
            if radius not in self._masks:
                self._masks[radius] = np.array([sum(1 << b for b in bits) for n in range(radius + 1) for bits in combinations(range(PART), n)], np.uint16)
            if len(self._masks[radius]) < len(values):
                wanted = np.uint16(value) ^ self._masks[radius]
                at = np.minimum(np.searchsorted(values, wanted), len(values) - 1)
                return at[values[at] == wanted]
        return np.flatnonzero(np.bitwise_count(values ^ np.uint16(value)) <= radius)

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Places of all vectors whose codes differ from code in at most radius bits."""
        m = self.codes.parts
        hit = np.zeros(len(self.ids), bool)
        for j in range(m):
            least = radius // m - (j > radius % m)
            if least < 0:
                continue
            order, _, starts = self.tables[j]
            at = self._near_values(j, int(code[j]), least)
            first, size = starts[at], starts[at + 1] - starts[at]
            if len(at):
                hit[order[np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())]] = True
        found = np.flatnonzero(hit)
        return found[np.bitwise_count(self.code[found] ^ code).sum(1) <= radius]

    def search(self, vector: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, cosines) of the k nearest vectors found, ties to smaller ids."""
        vector = scaled(vector[None])[0]
        norm = np.linalg.norm(vector)
        code = self.codes.encode((vector / norm)[None])[0]
        radius, most = self.codes.radius, self.codes.parts * PART
        found = self.within(code, radius)
        while len(found) < min(k, len(self.ids)) and radius < most:
            radius = min(most, radius + PART)
            found = self.within(code, radius)
        cosines = (self.vectors[found] * vector).sum(1) / (self.norms[found] * norm)
        best = np.lexsort((self.ids[found], -cosines))[:k]
        return self.ids[found[best]], cosines[best]


def _usable(vectors: DataFrame, dim: int | None) -> DataFrame:
    """(vec_id, v) with v of doubles; without vectors that are null, zero, of another dimension or not finite."""
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("v")).where("vec_id IS NOT NULL AND v IS NOT NULL AND size(v) > 0")
    rows = rows.where("forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity')) AND exists(v, x -> x <> 0)")
    return rows if dim is None else rows.where(F.size("v") == dim)


def nearest(vectors: DataFrame, queries: str, k: int = K, train: int = TRAIN, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of vectors (vec_id, embedding) that meets the condition queries, its k nearest other rows found.

    Nearness is the cosine; ties go to the smaller vec_id; all others if there are fewer than k. Vectors that are null,
    all zero, or hold null or non-finite components take no part, nor do those without an id or of another dimension than
    most. Rows with equal vectors are each other's neighbours; rows with equal ids are one place with several vectors, of
    which the nearest counts. An empty table gives no rows; other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = _usable(vectors, None)
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = _usable(vectors, sizes[0]["d"])
    # The first k + 1 ids of each vector; ranks are cut before the shuffle, so that a frequent vector meets no single task.
    ranked = rows.withColumn("place", F.dense_rank().over(Window.partitionBy("v").orderBy("vec_id"))).where(F.col("place") <= k + 1)
    ranked = common.materialize(ranked.dropDuplicates(["vec_id", "v"]), "annrows")
    entries = ranked.where("place = 1").select(F.col("vec_id").alias("entry"), "v")
    names = ranked.join(entries, "v").select("entry", "vec_id")
    n = entries.count()
    share = min(1.0, train / n)
    sample = entries.where(F.pmod(F.xxhash64("entry"), F.lit(1 << 20)) < int(share * (1 << 20))).orderBy("entry").limit(2 * train)
    learned = np.array([r["v"] for r in sample.select("v").collect()] or [r["v"] for r in entries.limit(1).collect()])
    codes = spark.sparkContext.broadcast(learn(learned, k))

    asking = rows.where(queries)
    asked = common.materialize(asking.join(entries, "v").select(F.col("vec_id").alias("query_id"), F.col("entry").alias("asks")).distinct(), "annqueries")
    distinct = entries.join(asked.select(F.col("asks").alias("entry")).distinct(), "entry", "left_semi")
    blocks = max(BLOCKS, -(-n // block))
    groups = max(1, -(-distinct.count() // block))
    data = entries.withColumn("block", F.pmod(F.xxhash64("entry"), F.lit(blocks))).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    probes = distinct.withColumn("part", F.pmod(F.xxhash64("entry"), F.lit(groups)).cast("int")).withColumn("block", F.explode(F.expr(f"sequence(0L, {blocks - 1}L)")))

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        out = ([], [], [])
        if left.num_rows and right.num_rows:
            matrix = lambda t, c: t[c].combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1)
            index = Block(codes.value, left["entry"].to_numpy(), matrix(left, "v"))
            for asks, vector in zip(right["asks"].to_pylist(), matrix(right, "w"), strict=True):
                ids, cosines = index.search(vector, k + 1)
                for x, v in zip(out, ([asks] * len(ids), ids.tolist(), cosines.tolist()), strict=True):
                    x.extend(v)
        return pa.table({"asks": pa.array(out[0], pa.int64()), "entry": pa.array(out[1], pa.int64()), "score": pa.array(out[2], pa.float64())})

    common.importable(spark)
    probes = probes.select(F.col("entry").alias("asks"), F.col("v").alias("w"), F.col("block").alias("on"), F.col("part").alias("of"))
    found = data.groupBy("block", "part").cogroup(probes.groupBy("on", "of")).applyInArrow(search, "asks long, entry long, score double")
    best = lambda by, *order: F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score"), *order))
    found = found.withColumn("place", best("asks", "entry")).where(F.col("place") <= k + 1).select("asks", "entry", "score")
    named = found.join(names, "entry").groupBy("asks", "vec_id").agg(F.max("score").alias("score")).withColumn("place", best("asks", "vec_id")).where(F.col("place") <= k + 1)
    answers = asked.join(named.select("asks", "vec_id", "score"), "asks").where("query_id <> vec_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return answers.withColumn("rank", best("query_id", "vec_id")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(common.table(spark, sf_dir, "embeddings"), "vec_id % 50 = 0")
