"""Variant sites: rows (chrom, pos, ref, alts array<string>, filter, ac array<int>, genotypes array<struct<sample, gt>>)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def by_type(sites: DataFrame, kind: str, least_count: int = 1) -> DataFrame:
    """Sites whose alleles are all of the kind "snp" (one base for one) or not ("indel"), with an allele count of least_count."""
    snp = F.forall("alts", lambda a: (F.length(a) == F.length("ref")) & (F.length(a) == 1) | (a == "*"))
    return sites.where(snp if kind == "snp" else ~snp).where(F.exists("ac", lambda c: c >= least_count))


def split_alleles(sites: DataFrame) -> DataFrame:
    """One row for each allele: alt, its count, and its number i from 0."""
    one = sites.select("*", F.posexplode("alts").alias("i", "alt"))
    return one.withColumn("allele_count", F.get("ac", F.col("i"))).drop("alts", "ac")


def without_stars(split: DataFrame) -> DataFrame:
    """Without alleles that stand for an overlapping deletion."""
    return split.where("alt <> '*'")


def merged_alleles(split: DataFrame, keep: Sequence[str] = (), parts: int | None = None) -> DataFrame:
    """Sites of all alleles at a place again, in order.

    keep: columns that a site's alleles have in common. parts: the number of tasks, by default Spark's own for a shuffle.
    """
    place = ["chrom", "pos", "ref"]
    split = split.select(*place, "i", "alt", "allele_count", *keep)
    split = split.repartition(parts, *place) if parts else split
    one = split.groupBy(*place).agg(F.array_sort(F.collect_list(F.struct("i", "alt", "allele_count"))).alias("a"), *[F.first(c).alias(c) for c in keep])
    return one.select(*place, F.col("a.alt").alias("alts"), F.col("a.allele_count").alias("ac"), *keep)


def concatenated(*chunks: DataFrame, parts: int | None = None) -> DataFrame:
    """All chunks, ordered within partitions (parts, by default Spark's number for a shuffle) of a range of places."""
    out = chunks[0]
    for more in chunks[1:]:
        out = out.unionByName(more)
    place = ["chrom", "pos"]
    return (out.repartitionByRange(parts, *place) if parts else out.repartitionByRange(*place)).sortWithinPartitions(*place)


def passed(sites: DataFrame) -> DataFrame:
    return sites.where("filter = 'PASS'")


def without_samples(sites: DataFrame, samples: DataFrame) -> DataFrame:
    """Genotypes of the listed samples taken out; samples (sample) is a short list, held in one array."""
    names = samples.agg(F.collect_set("sample").alias("_names"))
    return sites.crossJoin(F.broadcast(names)).withColumn("genotypes", F.filter("genotypes", lambda g: ~F.array_contains("_names", g["sample"]))).drop("_names")  # one row
