"""Dense vectors as arrays of numbers, sparse vectors as long tables (instance, fid, val) or arrays of pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---- dense -------------------------------------------------------------------------------------------------------


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision, in the order of the components."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def squared_norm(a: Column) -> Column:
    return dot(a, a)


def scale(a: Column, c: float) -> Column:
    return F.transform(a, lambda x: x * F.lit(c))


def add_constant(a: Column, c: float) -> Column:
    return F.transform(a, lambda x: x + F.lit(c))


def add(a: Column, b: Column, c: float = 1.0) -> Column:
    """a + c * b; the shorter one is filled with zeros."""
    return F.zip_with(a, b, lambda x, y: F.coalesce(x, F.lit(0)).cast("double") + F.lit(c) * F.coalesce(y, F.lit(0)).cast("double"))


def add_masked(a: Column, b: Column, mask: Column, c: float = 1.0) -> Column:
    """a + c * b where the mask is non-zero, else a."""
    return F.zip_with(F.arrays_zip(a.alias("a"), b.alias("b")), mask, lambda p, m: F.when(m != 0, p["a"] + F.lit(c) * p["b"]).otherwise(p["a"]))


def combine(a: Column, ca: float, b: Column, cb: float) -> Column:
    return add(scale(a, ca), b, cb)


def resize(a: Column, n: int) -> Column:
    """The first n components, filled with zeros."""
    return F.concat(F.slice(a, 1, n), F.array_repeat(F.lit(0.0), F.greatest(F.lit(0), F.lit(n) - F.size(a))))


def direction(a: Column) -> Column:
    """The vector at length 1; the zero vector as it is."""
    length = F.sqrt(squared_norm(a))
    return F.when(length > 0, F.transform(a, lambda x: x / length)).otherwise(a)


def agreement(a: Column, b: Column) -> Column:
    """How two directions agree: 1 both zero, 2 one zero, 3 parallel (cosine over 0.5), 4 anti-parallel, 5 neither."""
    m, n = squared_norm(a), squared_norm(b)
    cosine = dot(a, b) / F.sqrt(m * n)
    return F.when((m == 0) & (n == 0), 1).when((m == 0) | (n == 0), 2).when(cosine > 0.5, 3).when(cosine < -0.5, 4).otherwise(5)


def average_direction(vectors: Column, dimensions: int = 3, threshold: float = 0.05) -> Column:
    """Mean of an array of vectors; zero if its squared norm is under threshold times the largest one, or if there are none."""
    n = F.size(vectors)
    total = lambda k: F.aggregate(F.transform(vectors, lambda v: v[k]), F.lit(0.0), lambda s, x: s + x)
    mean = F.array(*[total(k) / n for k in range(dimensions)])
    largest = F.array_max(F.transform(vectors, squared_norm))
    zero = F.array(*[F.lit(0.0)] * dimensions)
    return F.when((n > 0) & (squared_norm(mean) >= threshold * largest) & (largest > 0), mean).otherwise(zero)


# ---- sparse, as pairs --------------------------------------------------------------------------------------------


def pack(features: DataFrame, *by: str) -> DataFrame:
    """(by, pairs): the vectors as arrays of (fid, val) in order of fid; zeros are left out."""
    return features.where("val <> 0").groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("fid", "val"))).alias("pairs"))


def unpack(packed: DataFrame, *by: str) -> DataFrame:
    return packed.select(*by, F.explode("pairs").alias("p")).select(*by, "p.fid", "p.val")


def component(pairs: Column, fid: Column) -> Column:
    """The value at fid, 0 if there is none."""
    return F.coalesce(F.get(F.filter(pairs, lambda p: p["fid"] == fid), F.lit(0))["val"], F.lit(0.0))


def with_component(pairs: Column, fid: int, val: float) -> Column:
    """The vector with another value at fid; zero removes it."""
    rest = F.filter(pairs, lambda p: p["fid"] != fid)
    return rest if val == 0 else F.array_sort(F.concat(rest, F.array(F.struct(F.lit(fid).cast("long").alias("fid"), F.lit(val).alias("val")))))


def between(pairs: Column, low: int, high: int) -> Column:
    """The components of low to high, both included."""
    return F.filter(pairs, lambda p: p["fid"].between(low, high))


def trimmed(pairs: Column, least: float) -> Column:
    """Without components smaller than least."""
    return F.filter(pairs, lambda p: F.abs(p["val"]) >= least)


# ---- sparse, as tables -------------------------------------------------------------------------------------------


def sparse_combine(a: DataFrame, ca: float, b: DataFrame, cb: float, by: str = "instance_id") -> DataFrame:
    """(by, fid, val) of ca * a + cb * b; components that cancel are left out."""
    both = a.select(by, "fid", (F.col("val") * ca).alias("val")).unionByName(b.select(by, "fid", (F.col("val") * cb).alias("val")))
    return both.groupBy(by, "fid").agg(F.sum("val").alias("val")).where("val <> 0")


def sparse_dot(a: DataFrame, b: DataFrame, by: str = "instance_id") -> DataFrame:
    """(by, dot) of the vectors of a with those of b that have the same by; 0 where nothing meets."""
    met = a.join(b.select(by, "fid", F.col("val").alias("other")), [by, "fid"]).groupBy(by).agg(F.sum(F.col("val") * F.col("other")).alias("dot"))
    return a.select(by).distinct().join(met, by, "left").select(by, F.coalesce("dot", F.lit(0.0)).alias("dot"))


def sparse_dense_dot(pairs: Column, dense: Column) -> Column:
    """Inner product of pairs (fid from 0) with a dense vector."""
    return F.aggregate(pairs, F.lit(0.0), lambda s, p: s + p["val"] * F.coalesce(F.get(dense, p["fid"].cast("int")), F.lit(0)).cast("double"))
