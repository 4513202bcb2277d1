"""Text of the output formats as columns, and writers of them. Each writer gives rows (value), one for a record or graph."""

from __future__ import annotations

import struct
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandgraph.functions import residues as R


def fasta(records: DataFrame, line_length: int | str | None = None) -> DataFrame:
    """(value): head, comment and wrapped sequence of records (head, comment, seq).

    line_length "input" takes the layout of the records (n_lines, width): what had one line gets one, all others the
    length of the longest line of any.
    """
    if line_length == "input":
        records = records.crossJoin(F.broadcast(records.agg(F.greatest(F.max("width"), F.lit(1)).alias("_w"))))  # one row
        wrapped = F.regexp_replace("seq", F.concat(F.lit("(.{"), F.col("_w").cast("string"), F.lit("})(?=.)")), F.lit("$1\n"))
        seq = F.when(F.col("n_lines") > 1, wrapped).otherwise(F.col("seq"))
    else:
        seq = R.wrap(F.col("seq"), line_length) if line_length else F.col("seq")
    head = F.concat(F.lit(">"), "head")
    comment = F.when(F.coalesce("comment", F.lit("")) != "", F.col("comment")) if "comment" in records.columns else F.lit(None).cast("string")
    return records.select(F.concat_ws("\n", head, comment, seq).alias("value"))


def save_text(rows: DataFrame, path: str, compression: str | None = None) -> None:
    rows.select("value").write.text(path, compression=compression)


def save_table(rows: DataFrame, path: str, separator: str = "\t") -> None:
    """Tab-separated rows: peptides, predictions (prediction, margin), validation (id, target, prediction, margin), vertex margins."""
    rows.write.csv(path, sep=separator)


def _number(x: Column) -> Column:
    """Whole numbers as such, others with seven significant digits."""
    whole = (x == F.floor(x)) & (F.abs(x) < 32768)
    return F.when(whole, F.format_string("%d", x.cast("long"))).otherwise(F.format_string("%.7e", x))


def sparse_text(features: DataFrame) -> DataFrame:
    """(instance_id, value): "index:value" in order of index."""
    token = features.select("instance_id", "fid", F.concat_ws(":", "fid", _number(F.col("val"))).alias("t"))
    packed = token.groupBy("instance_id").agg(F.array_sort(F.collect_list(F.struct("fid", "t"))).alias("p"))
    return packed.select("instance_id", F.array_join(F.col("p.t"), " ").alias("value"))


def sparse_binary(features: DataFrame) -> DataFrame:
    """(instance_id, content): native binary vectors."""
    packed = features.groupBy("instance_id").agg(F.array_sort(F.collect_list(F.struct("fid", "val"))).alias("p"))

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            content = [struct.pack("=i", len(f)) + b"".join(struct.pack("=if", a, b) for a, b in zip(f, v, strict=True)) for f, v in zip(pdf["fids"], pdf["vals"], strict=True)]
            yield pd.DataFrame({"instance_id": pdf["instance_id"], "content": content})

    rows = packed.select("instance_id", F.col("p.fid").alias("fids"), F.col("p.val").alias("vals"))
    return rows.mapInPandas(encode, f"instance_id {features.schema['instance_id'].dataType.simpleString()}, content binary")


def dense_text(vectors: DataFrame, id: str = "instance_id", vector: str = "vector") -> DataFrame:
    """(id, value): "index:value" of the components that aren't 0, and of the last one."""
    kept = F.filter(F.transform(F.col(vector), lambda x, i: F.struct(i.alias("i"), x.cast("double").alias("x"))), lambda p: (p["x"] != 0) | (p["i"] == F.size(vector) - 1))
    return vectors.select(id, F.array_join(F.transform(kept, lambda p: F.concat_ws(":", p["i"], _number(p["x"]))), " ").alias("value"))


def dense_binary(vectors: DataFrame, id: str = "instance_id", vector: str = "vector") -> DataFrame:
    """(id, content): native binary vectors, a 32-bit count and then 32-bit values."""

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({id: pdf[id], "content": [struct.pack(f"=i{len(x)}f", len(x), *x) for x in pdf[vector]]})

    return vectors.select(id, vector).mapInPandas(encode, f"{id} {vectors.schema[id].dataType.simpleString()}, content binary")


def save_parts(rows: DataFrame, path: str, by: Sequence[str]) -> None:
    """Tab-separated rows in a folder for each value of by: learning-curve files by fold, ids of a split by centre and part."""
    rows.write.partitionBy(*by).csv(path, sep="\t")


def save_feature_maps(maps: dict[str, DataFrame], path: str) -> None:
    """One folder of tab-separated (code, text) for each generator's dictionary(), by its name."""
    for name, table in maps.items():
        table.write.csv(f"{path.rstrip('/')}/{name}", sep="\t")


def model(models: DataFrame, weights: DataFrame) -> DataFrame:
    """(model, value): every level of each model as text."""
    token = weights.groupBy("model", "level").agg(F.array_sort(F.collect_list(F.struct("fid", F.concat_ws(":", "fid", F.format_string("%.7e", F.col("w"))).alias("t")))).alias("p"))
    rows = models.join(token, ["model", "level"], "left")
    line = lambda k, c: F.concat(F.lit(k + " "), F.col(c).cast("string"))
    text = F.concat_ws("\n", line("bitsize", "bits"), F.lit("instance_parts_threshold 1"), line("radius", "radius"), line("distance", "distance"), line("positive_threshold", "pos_thr"), line("negative_threshold", "neg_thr"), line("bias", "bias"), line("wscale", "wscale"), F.concat(F.lit("w  "), F.coalesce(F.array_join(F.col("p.t"), " "), F.lit(""))))
    levels = rows.select("model", "level", text.alias("t")).groupBy("model").agg(F.array_sort(F.collect_list(F.struct("level", "t"))).alias("p"))
    return levels.select("model", F.concat(F.lit("num_levels "), F.size("p").cast("string"), F.lit("\n"), F.array_join(F.col("p.t"), "\n"), F.lit("\n")).alias("value"))


def save_models(models: DataFrame, weights: DataFrame, path: str) -> None:
    """A folder for each model, with its text in one file."""
    model(models, weights).repartition("model").write.partitionBy("model").text(path)


# ---- graphs ------------------------------------------------------------------------------------------------------


def label(labels: Column, separator: str = ":") -> Column:
    """One text of an array of labels, or of a label."""
    return F.array_join(labels, separator)


def _lines(vertices: DataFrame, edges: DataFrame, begin: Column, node: Column, arc: Column, end: str | None) -> DataFrame:
    """(graph_id, value): a graph's lines in order of vertex and edge ids."""
    v = vertices.select("graph_id", F.lit(1).alias("o"), F.col("vid").cast("long").alias("a"), F.lit(0).cast("long").alias("b"), node.alias("t"))
    e = edges.select("graph_id", F.lit(2).alias("o"), F.col("src").cast("long").alias("a"), F.col("dst").cast("long").alias("b"), arc.alias("t"))
    rows = v.unionByName(e).groupBy("graph_id").agg(F.array_sort(F.collect_list(F.struct("o", "a", "b", "t"))).alias("p"))
    return rows.select("graph_id", F.concat_ws("\n", begin, F.array_join(F.col("p.t"), "\n"), F.lit(end)).alias("value"))


def _backward(edges: DataFrame) -> DataFrame:
    """Of an undirected graph's edges the ones to the smaller end."""
    return edges.where("dst < src")


def export(vertices: DataFrame, edges: DataFrame, form: str) -> DataFrame:
    """(graph_id, value) in the form dot, gml, gdl, csv or gspan; another is an error. Undirected edges are written once."""
    if form not in EXPORTS:
        raise ValueError(f"unknown export format: {form}; known: {sorted(EXPORTS)}")
    return EXPORTS[form](vertices, edges)


def _dot(v: DataFrame, e: DataFrame) -> DataFrame:
    begin = F.concat(F.lit('graph "'), F.col("graph_id").cast("string"), F.lit('"{'))
    return _lines(v, _backward(e), begin, F.format_string('%d [label="%s", shape=box, style=filled]', "vid", "label"), F.format_string('%d -- %d [label="%s"]', "src", "dst", "label"), "}")


def _gml(v: DataFrame, e: DataFrame) -> DataFrame:
    begin = F.concat(F.lit("graph [\n\tdirected 0\n\tlabel \""), F.col("graph_id").cast("string"), F.lit('"'))
    node = F.format_string('\tnode [\n\t\tid %d\n\t\tLabelGraphics [ text "%s" ]\n\t]', "vid", "label")
    return _lines(v, _backward(e), begin, node, F.format_string('\tedge [\n\t\tlabel "%s"\n\t\tsource %d\n\t\ttarget %d\n\t]', "label", "src", "dst"), "]")


def _gdl(v: DataFrame, e: DataFrame) -> DataFrame:
    begin = F.concat(F.lit('graph: { title: "'), F.col("graph_id").cast("string"), F.lit('"\n\tlayoutalgorithm: forcedir'))
    return _lines(v, _backward(e), begin, F.format_string('node: { title: "%d" shape: box label: "%s" }', "vid", "label"), F.format_string('edge: { sourcename: "%d" targetname: "%d" }', "src", "dst"), "}")


def _csv(v: DataFrame, e: DataFrame) -> DataFrame:
    name = v.select("graph_id", "vid", "label")
    rows = _backward(e).select("graph_id", "src", "dst", F.col("label").alias("edge"))
    rows = rows.join(name.select("graph_id", F.col("vid").alias("src"), F.col("label").alias("x")), ["graph_id", "src"]).join(name.select("graph_id", F.col("vid").alias("dst"), F.col("label").alias("y")), ["graph_id", "dst"])
    packed = rows.groupBy("graph_id").agg(F.array_sort(F.collect_list(F.struct("src", "dst", F.concat_ws(",", "src", "x", "dst", "y", "edge").alias("t")))).alias("p"))
    return packed.select("graph_id", F.array_join(F.col("p.t"), "\n").alias("value"))


def _gspan(v: DataFrame, e: DataFrame) -> DataFrame:
    begin = F.concat(F.lit("t # "), F.col("graph_id").cast("string"))
    node = F.concat_ws(" ", F.lit("v"), "vid", "label")
    return _lines(v, e.where("src < dst"), begin, node, F.concat_ws(" ", F.lit("e"), "src", "dst", F.expr("nullif(label, '')")), None)


EXPORTS = {"dot": _dot, "gml": _gml, "gdl": _gdl, "csv": _csv, "gspan": _gspan}


def one_line(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph_id, value): vertices, then edges, on one line."""
    return _lines(vertices, edges, F.lit(None).cast("string"), F.concat_ws(":", "vid", "label"), F.concat_ws(":", F.concat_ws("-", "src", "dst"), "label"), None).withColumn("value", F.regexp_replace("value", "\n", " "))


def annotated(vertices: DataFrame, vertex_features: DataFrame, weights: DataFrame) -> DataFrame:
    """vertices with score: the sum of the weights of the features that begin at them."""
    score = vertex_features.join(weights, "fid").groupBy(F.col("instance_id").alias("graph_id"), "vid").agg(F.sum(F.col("val") * F.col("w")).alias("score"))
    return vertices.join(score, ["graph_id", "vid"], "left").fillna(0.0, ["score"])


def dictionary(strings: DataFrame, text: str, code: str) -> DataFrame:
    """(code, text): what stands behind hash values."""
    return strings.select(F.col(code).alias("code"), F.col(text).alias("text")).distinct()
