"""Layered graphs of sequences.

A peptide of length n has layers of n vertices: the backbone, then property layers, in the order polarity, charge,
hydrophobicity, identity; domain layers follow in the same order. Vertex ids count from 1 layer by layer. The backbone is
a chain; each later layer hangs on the one before it, vertex by vertex. In a domain alignment the first layer with
gaps has GAP vertices; later layers leave gap positions out but keep their numbers.

Vertices are rows (graph_id, vid, layer, pos, label), edges rows (graph_id, src, dst, label).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandgraph.functions import residues as R
from strandgraph.storage import materialize

LAYERS = ("any", "polarity", "charge", "hydrophobicity", "identity")
DRIVER_LAYERS = ("any", "charge", "hydrophobicity", "identity")


def _checked(layers: Sequence[str]) -> list[str]:
    if "any" not in layers or set(layers) - set(LAYERS):
        raise ValueError(f"layers need 'any' and may hold {LAYERS[1:]}, got {tuple(layers)}")
    return [x for x in LAYERS if x in layers]


def _label(layer: str, aa: Column, pos: Column, side: str) -> Column:
    if layer == "any":
        return F.lit("X") if side == "P" else F.concat(F.lit("D"), pos.cast("string"))
    return getattr(R, layer)(aa, side)


def vertices(peptides: DataFrame, layers: Sequence[str] = DRIVER_LAYERS, side: str = "P", by: str = "peptide_id", first: str | int = 0) -> DataFrame:
    """Vertices of rows (by, seq). first: number (or column) of the vertices before these, as for a domain after a peptide."""
    names = _checked(layers)
    offset = F.col(first) if isinstance(first, str) else F.lit(first)
    spread = peptides.where("seq <> ''").select(F.col(by).alias("graph_id"), F.length("seq").alias("_n"), offset.alias("_first"), F.posexplode(F.split("seq", "")).alias("_p", "_aa"))
    spread = spread.withColumn("pos", F.col("_p") + 1)
    labels = F.array(*[F.struct(F.lit(k).alias("layer"), _label(x, F.col("_aa"), F.col("pos"), side).alias("label")) for k, x in enumerate(names)])
    out = spread.select("graph_id", "_n", "_first", "pos", "_aa", F.explode(labels).alias("v"))
    label = F.col("v.label")
    if side == "D":
        label = F.when((F.col("_aa") == "-") & (F.col("v.layer") == 1), "GAP").otherwise(label)
        out = out.where("_aa <> '-' OR v.layer <= 1")
    vid = (F.col("_first") + F.col("v.layer") * F.col("_n") + F.col("pos")).cast("int")
    return out.select("graph_id", vid.alias("vid"), F.col("v.layer").alias("layer"), "pos", label.alias("label"))


def edges(peptides: DataFrame, layers: Sequence[str] = DRIVER_LAYERS, side: str = "P", by: str = "peptide_id", first: str | int = 0, both_ways: bool = False) -> DataFrame:
    """Edges of rows (by, seq): the chain of the backbone, and from each vertex to the one below it in the next layer."""
    names = _checked(layers)
    offset = F.col(first) if isinstance(first, str) else F.lit(first)
    spread = peptides.where("seq <> ''").select(F.col(by).alias("graph_id"), F.length("seq").alias("_n"), offset.alias("_first"), F.posexplode(F.split("seq", "")).alias("_p", "_aa"))
    layer = F.explode(F.sequence(F.lit(0), F.lit(len(names) - 1)))
    out = spread.select("graph_id", "_n", "_first", (F.col("_p") + 1).alias("pos"), "_aa", layer.alias("layer"))
    out = out.where("layer > 0 OR pos < _n")
    if side == "D":
        out = out.where("_aa <> '-' OR layer <= 1")
    at = F.col("_first") + F.col("layer") * F.col("_n") + F.col("pos")
    src = F.when(F.col("layer") == 0, at).otherwise(at - F.col("_n")).cast("int")
    dst = F.when(F.col("layer") == 0, at + 1).otherwise(at).cast("int")
    out = out.select("graph_id", src.alias("src"), dst.alias("dst"), F.lit("").alias("label"), "layer")
    if both_ways:
        out = out.unionByName(out.where("layer > 0").select("graph_id", F.col("dst").alias("src"), F.col("src").alias("dst"), "label", "layer"))
    return out.drop("layer")


def directed(v: DataFrame, e: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each graph beside its reversed copy, whose vertices are numbered on and labelled "r." before the label."""
    size = v.groupBy("graph_id").agg(F.max("vid").alias("_n"))
    twins = v.join(size, "graph_id").withColumns({"vid": F.col("vid") + F.col("_n"), "label": F.concat(F.lit("r."), "label")}).drop("_n")
    back = e.join(size, "graph_id").select("graph_id", (F.col("dst") + F.col("_n")).alias("src"), (F.col("src") + F.col("_n")).alias("dst"), "label")
    return v.unionByName(twins), e.select("graph_id", "src", "dst", "label").unionByName(back)


def undirected(e: DataFrame) -> DataFrame:
    """The edges and their reversals."""
    return e.select("graph_id", "src", "dst", "label").unionByName(e.select("graph_id", F.col("dst").alias("src"), F.col("src").alias("dst"), "label"))


def _literal(pattern: Column) -> Column:
    """The longest text that every match of a pattern holds, as far as it is told here; empty for groups, classes, escapes.

    A character before "*" or "?" may be absent, so it ends a run, as any special character does.
    """
    runs = F.split(F.regexp_replace(pattern, r".[*?][+?]?|[.^$+]", "\n"), "\n")
    longest = F.array_max(F.transform(runs, lambda r: F.struct(F.length(r).alias("n"), r.alias("r"))))["r"]
    return F.when(pattern.rlike(r"[|()\[\]{}\\]"), "").otherwise(longest)


#: Letters of the pieces that names are indexed by, and names in a block for patterns that hold none.
GRAM, NAMES = 3, 10_000


def _grams(text: Column) -> Column:
    return F.expr(f"array_distinct(transform(sequence(1, length({text}) - {GRAM - 1}), i -> substring({text}, i, {GRAM})))")


def matches(patterns: DataFrame, names: DataFrame, block: int = NAMES) -> DataFrame:
    """(pattern, names...) of all rows of names (name, ...) in which a pattern (pattern) is found; each distinct pattern once.

    A pattern that holds a literal of GRAM letters meets only the names that hold the rarest of its grams: an equi-join on
    grams. One without meets the names block by block, an equi-join on the block's number. Null patterns and names match nothing.
    """
    found = patterns.where("pattern IS NOT NULL").select("pattern").distinct().withColumn("_l", _literal(F.col("pattern")))
    names = materialize(names.where("name IS NOT NULL"), "names")
    index = names.where(f"length(name) >= {GRAM}").withColumn("_g", F.explode(_grams("name")))
    grams = found.where(f"length(_l) >= {GRAM}").select("pattern", F.explode(_grams("_l")).alias("_g"))
    often = index.groupBy("_g").agg(F.count("*").alias("_c"))
    rarest = grams.join(often, "_g", "left").groupBy("pattern").agg(F.min_by("_g", F.coalesce("_c", F.lit(0))).alias("_g"))
    hit = rarest.join(index, "_g").where("name RLIKE pattern").drop("_g")
    blocks = max(1, -(-names.count() // block))
    rest = found.where(f"length(_l) < {GRAM}").select("pattern", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_b"))
    met = rest.join(names.withColumn("_b", F.pmod(F.xxhash64("name"), F.lit(blocks)).cast("int")), "_b").where("name RLIKE pattern").drop("_b")
    return hit.unionByName(met)


def with_domain(peptides: DataFrame, domains: DataFrame) -> DataFrame:
    """peptides (peptide_id, seq) with aligned: the sequence of the first domain whose name matches peptide_id as a pattern.

    domains: (ord, name, aligned_seq), a lookup table of any size; the first row by ord counts. Unmatched peptides have no
    domain (null).
    """
    hit = matches(peptides.select(F.col("peptide_id").alias("pattern")), domains.select("ord", "name", "aligned_seq"))
    first = hit.groupBy(F.col("pattern").alias("peptide_id")).agg(F.min_by("aligned_seq", "ord").alias("aligned"))
    return peptides.join(first, "peptide_id", "left")
