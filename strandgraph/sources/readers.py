"""Readers of the text and binary formats as DataFrames.

Formats whose records span lines are split by a record separator, so files stay splittable by Spark; gzip is read by
its extension. Records keep the file and their order in it through their own ids where the format has them, else through
rank().
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandgraph.functions import residues as R
from strandgraph.operators.ranks import ranked


def is_fasta(spark: SparkSession, path: str) -> bool:
    """Whether any line begins with ">"."""
    return not spark.read.text(path).where("value LIKE '>%'").limit(1).isEmpty()


def fasta(spark: SparkSession, paths: str | list[str], valid: str = "-a-zA-Z", separator: str = "\t", layout: bool = False) -> DataFrame:
    """(head, head_fields, id, comment, seq) of records; lines of "#" within a record are its comment.

    A head without a sequence is an error when its record is read.
    """
    chunks = spark.read.option("lineSep", "\n>").text(paths if isinstance(paths, list) else [paths])
    return parsed_fasta(chunks, valid, separator, layout)


def parsed_fasta(chunks: DataFrame, valid: str = "-a-zA-Z", separator: str = "\t", layout: bool = False) -> DataFrame:
    """Records of rows (value) that were cut before each ">"; also for streams. The part before the first head is dropped.

    layout: with n_lines and width, the number of the sequence's lines and the length of the longest.
    """
    body = F.expr("CASE WHEN value LIKE '>%' THEN substring(value, 2) WHEN value LIKE '#%' AND instr(value, '\\n>') > 0 THEN substring(value, instr(value, '\\n>') + 2) ELSE value END")
    rows = chunks.where("NOT (value LIKE '#%' AND instr(value, '\\n>') = 0) AND trim(value) <> ''").select(F.split(body, "\n").alias("lines"))
    rows = rows.select(F.col("lines")[0].alias("head"), F.expr("slice(lines, 2, size(lines))").alias("rest"))
    comment = F.array_join(F.filter("rest", lambda x: x.startswith("#")), "\n")
    seq = R.clean(F.array_join(F.filter("rest", lambda x: ~x.startswith("#")), ""), valid)
    body = F.filter("rest", lambda x: ~x.startswith("#") & (x != ""))
    shape = F.size(body).alias("n_lines"), F.coalesce(F.array_max(F.transform(body, F.length)), F.lit(0)).alias("width")
    seq = F.when(F.exists("rest", lambda x: ~x.startswith("#")), seq).otherwise(F.raise_error(F.concat(F.lit("no sequence after head: "), "head")))
    return rows.select("head", R.head_fields(F.col("head"), separator).alias("head_fields"), R.head_id(F.col("head")).alias("id"), comment.alias("comment"), seq.alias("seq"), *(shape if layout else ()))


def stream_comment(spark: SparkSession, path: str) -> str:
    """The "#" lines before the first head."""
    first = spark.read.option("lineSep", "\n>").text(path).limit(1).collect()
    return "\n".join(x for x in (first[0].value.split("\n") if first and first[0].value[:1] == "#" else []) if x[:1] == "#")


def pairs(spark: SparkSession, path: str) -> DataFrame:
    """(peptide_id, seq) of tab-separated lines, sequences in upper case."""
    return spark.read.csv(path, sep="\t", schema="peptide_id string, seq string").withColumn("seq", F.upper("seq"))


def strings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).where("trim(value) <> ''").select(F.trim("value").alias("value"))


def integers(spark: SparkSession, path: str) -> DataFrame:
    """(id) of all integers in a file."""
    return numbers(spark, path).select(F.col("value").cast("long").alias("id"))


def numbers(spark: SparkSession, path: str) -> DataFrame:
    """(value) of all white-space separated numbers."""
    tokens = spark.read.text(path).select(F.explode(F.split(F.trim("value"), r"\s+")).alias("t")).where("t <> ''")
    return tokens.select(F.col("t").cast("double").alias("value"))


def feature_weights(spark: SparkSession, path: str) -> DataFrame:
    """(fid, w) of lines "index value"."""
    parts = F.split(F.trim("value"), r"[\s:]+")
    return spark.read.text(path).where("trim(value) <> ''").select(parts[0].cast("long").alias("fid"), parts[1].cast("double").alias("w"))


def domains(spark: SparkSession, path: str) -> DataFrame:
    """(ord, name, aligned_seq) of a tab-separated lookup table."""
    rows = spark.read.csv(path, sep="\t", schema="name string, aligned_seq string")
    return rank(rows, "ord")


def rank(rows: DataFrame, name: str = "instance_id") -> DataFrame:
    """rows with a number from 0 in file order: sizes of the partitions are summed first, then rows numbered within each."""
    marked = rows.withColumn("_m", F.monotonically_increasing_id())
    marked = marked.withColumns({"_p": F.shiftright("_m", 33), "_i": F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))})
    sizes = {p: n for p, n in marked.groupBy("_p").count().collect()}  # one row for each partition
    before, total = {}, 0
    for p in sorted(sizes):
        before[p] = total
        total += sizes[p]
    shift = F.create_map(*[F.lit(x).cast("long") for p in before.items() for x in p])[F.col("_p")] if before else F.lit(0)
    return marked.withColumn(name, F.col("_i") + shift).drop("_m", "_p", "_i")


def targets(spark: SparkSession, path: str) -> DataFrame:
    """(instance_id, y) of white-space separated targets -1, 0, 1; others are an error."""
    lines = rank(spark.read.text(path).where("trim(value) <> ''"), "line")
    tokens = lines.select("line", F.posexplode(F.split(F.trim("value"), r"\s+")).alias("k", "t"))
    y = F.col("t").try_cast("double").cast("int")
    y = F.when(y.isin(-1, 0, 1), y).otherwise(F.raise_error(F.concat(F.lit("no target: "), "t")))
    wide = lines.select(F.max(F.size(F.split(F.trim("value"), r"\s+"))).alias("w")).first()["w"] or 1
    if wide == 1:
        return tokens.select(F.col("line").alias("instance_id"), y.alias("y"))
    ordered = ranked(tokens.withColumn("_all", F.lit(0)), ["_all"], ["line", "k"], "instance_id")
    return ordered.select(F.col("instance_id").cast("long").alias("instance_id"), y.alias("y"))


def gspan(spark: SparkSession, path: str, weights: bool = False, viewpoint: bool = False, coordinates: bool = False, absolute_id: bool = False, nominal: bool = False) -> tuple[DataFrame, DataFrame]:
    """(vertices, edges) of graphs that begin with a "t" line or after a blank line; other markers are ignored.

    Options name further columns: viewpoint (0 or 1) after the label, x y z, a second label, a weight after an edge's
    label. Graphs without vertices are dropped. graph_id counts from 0 in file order.
    """
    records = spark.read.option("lineSep", "\nt").text(path)
    graphs = rank(records.select(F.explode(F.split("value", r"\n[ \t]*\n")).alias("value")).where("value RLIKE '(?m)^v '"), "graph_id")
    return parsed_gspan(graphs, weights, viewpoint, coordinates, absolute_id, nominal)


def parsed_gspan(graphs: DataFrame, weights: bool = False, viewpoint: bool = False, coordinates: bool = False, absolute_id: bool = False, nominal: bool = False) -> tuple[DataFrame, DataFrame]:
    """(vertices, edges) of rows (graph_id, value).

    nominal: ids may be any text; vertices are numbered from 0 in the order of their lines and edges' ends are mapped to
    these numbers (of a repeated id the last one counts). An end that no vertex has is an error. Else ids are numbers.
    """
    lines = graphs.select("graph_id", F.posexplode(F.split("value", "\n")).alias("at", "line")).select("graph_id", "at", F.split(F.trim("line"), r"\s+").alias("f"))
    v = lines.where("f[0] = 'v' AND size(f) > 2")
    vid = (F.row_number().over(Window.partitionBy("graph_id").orderBy("at")) - 1) if nominal else F.col("f")[1].cast("int")
    v = v.select("graph_id", vid.alias("vid"), F.col("f")[2].alias("label"), "f")
    at = 3
    if absolute_id:
        v = v.withColumn("absolute_id", F.get("f", F.lit(at)))
        at += 1
    if viewpoint:
        v = v.withColumn("viewpoint", F.get("f", F.lit(at)) == "1")
        at += 1
    if coordinates:
        v = v.withColumn("coord", F.transform(F.slice("f", at + 1, 3), lambda x: x.cast("double")))
    e = lines.where("f[0] = 'e' AND size(f) > 2")
    if nominal:
        known = v.groupBy("graph_id", F.col("f")[1].alias("_id")).agg(F.max("vid").alias("_vid"))
        for side, place in (("src", 1), ("dst", 2)):
            e = e.withColumn("_id", F.col("f")[place]).join(known, ["graph_id", "_id"], "left")
            e = e.withColumn(side, F.coalesce("_vid", F.raise_error(F.concat_ws(" ", F.lit("edge without vertex:"), "graph_id", "_id")).cast("int"))).drop("_id", "_vid")
    else:
        e = e.withColumns({"src": F.col("f")[1].cast("int"), "dst": F.col("f")[2].cast("int")})
    e = e.select("graph_id", "src", "dst", F.coalesce(F.get("f", F.lit(3)), F.lit("")).alias("label"), "f")
    if weights:
        e = e.withColumn("weight", F.get("f", F.lit(4)).cast("double"))
    return v.drop("f"), e.drop("f")


def sdf(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(vertices, edges) of molecules: counts in line 4, atoms' labels in columns 32 to 34, bonds in threes of columns; undirected.

    A count line that disagrees with the lines that follow is an error.
    """
    records = rank(spark.read.option("lineSep", "$$$$\n").text(path).where("length(trim(value)) > 0"), "graph_id")
    rows = records.select("graph_id", F.split("value", "\n").alias("l")).where("size(l) > 3")
    n, m = F.trim(F.substring(F.col("l")[3], 1, 3)).cast("int"), F.trim(F.substring(F.col("l")[3], 4, 3)).cast("int")
    rows = rows.select("graph_id", "l", n.alias("n"), m.alias("m"))
    rows = rows.withColumn("l", F.when(F.size("l") >= 4 + F.col("n") + F.col("m"), F.col("l")).otherwise(F.raise_error(F.lit("molecule shorter than its counts"))))
    atoms = rows.select("graph_id", F.posexplode(F.expr("slice(l, 5, n)")).alias("vid", "a")).select("graph_id", "vid", F.trim(F.substring("a", 32, 3)).alias("label"))
    bonds = rows.select("graph_id", F.explode(F.expr("slice(l, 5 + n, m)")).alias("b"))
    part = lambda k: F.trim(F.substring("b", k, 3))
    bonds = bonds.select("graph_id", (part(1).cast("int") - 1).alias("src"), (part(4).cast("int") - 1).alias("dst"), part(7).alias("label"))
    return atoms, bonds.unionByName(bonds.select("graph_id", F.col("dst").alias("src"), F.col("src").alias("dst"), "label"))


def sparse_text(spark: SparkSession, path: str) -> DataFrame:
    """(instance_id, fid, val) of lines of "index:value"; tokens without ":" are skipped."""
    lines = rank(spark.read.text(path), "instance_id")
    token = lines.select("instance_id", F.explode(F.split(F.trim("value"), r"\s+")).alias("t")).where("t LIKE '%:%'")
    return token.select("instance_id", F.split_part("t", F.lit(":"), F.lit(1)).cast("long").alias("fid"), F.split_part("t", F.lit(":"), F.lit(2)).cast("double").alias("val"))


def sparse_binary(spark: SparkSession, path: str) -> DataFrame:
    """(file, vector, fid, val) of native binary vectors: a 32-bit count, then pairs of 32-bit index and value."""
    return decoded_sparse(spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "content"))


def decoded_sparse(contents: DataFrame) -> DataFrame:
    """(file, vector, fid, val) of rows (file, content), each one or many vectors; vectors count from 0 in each."""
    kind = contents.schema["file"].dataType.simpleString()

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                for number, at, n in _places(content, 8):
                    pairs = np.frombuffer(content, [("fid", "=i4"), ("val", "=f4")], n, at)
                    yield pa.RecordBatch.from_arrays([pa.array([name.as_py()] * n, name.type), pa.array(np.full(n, number)), pa.array(pairs["fid"].astype(np.int64)), pa.array(pairs["val"].astype(float))], ["file", "vector", "fid", "val"])

    return contents.select("file", "content").mapInArrow(decode, f"file {kind}, vector long, fid long, val double")


def _places(content: bytes, width: int) -> Iterator[tuple[int, int, int]]:
    """(number, offset, entries) of the vectors of a content whose entries have so many bytes; a cut last vector is an error."""
    at = number = 0
    while at < len(content):
        if at + 4 > len(content) or at + 4 + (n := int.from_bytes(content[at : at + 4], sys.byteorder, signed=True)) * width > len(content) or n < 0:
            raise ValueError(f"vector {number} goes beyond the end of its content")
        yield number, at + 4, n
        at, number = at + 4 + width * n, number + 1


def sparse_text_strict(spark: SparkSession, path: str) -> DataFrame:
    """sparse_text() that fails on any token other than "index:value"."""
    lines = rank(spark.read.text(path), "instance_id")
    token = lines.select("instance_id", F.explode(F.filter(F.split(F.trim("value"), r"\s+"), lambda t: t != "")).alias("t"))
    good = F.col("t").rlike(r"^[0-9]+:[-+]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][-+]?[0-9]+)?$")
    token = token.withColumn("t", F.when(good, F.col("t")).otherwise(F.raise_error(F.concat(F.lit("not index:value: "), "t"))))
    return token.select("instance_id", F.split_part("t", F.lit(":"), F.lit(1)).cast("long").alias("fid"), F.split_part("t", F.lit(":"), F.lit(2)).cast("double").alias("val"))


def dense_text(spark: SparkSession, path: str) -> DataFrame:
    """(instance_id, vector array<double>) of lines of "index:value": as long as the largest index says, zeros where none is given."""
    lines = rank(spark.read.text(path), "instance_id")
    pairs = F.transform(F.filter(F.split(F.trim("value"), r"\s+"), lambda t: t.contains(":")), lambda t: F.struct(F.split_part(t, F.lit(":"), F.lit(1)).cast("int").alias("key"), F.split_part(t, F.lit(":"), F.lit(2)).cast("double").alias("value")))
    rows = lines.select("instance_id", pairs.alias("p")).withColumn("n", F.coalesce(F.array_max(F.transform("p", lambda x: x["key"])) + 1, F.lit(0)))
    filled = F.expr("transform(slice(sequence(0, n), 1, n), i -> coalesce(element_at(map_from_entries(p), i), 0D))")
    return rows.select("instance_id", filled.alias("vector"))


def dense_binary(spark: SparkSession, path: str) -> DataFrame:
    """(file, number, vector array<double>) of native binary vectors: a 32-bit count, then as many 32-bit values."""
    return decoded_dense(spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "content"))


def decoded_dense(contents: DataFrame) -> DataFrame:
    """(file, number, vector array<double>) of rows (file, content), each one or many vectors; they count from 0 in each."""
    kind = contents.schema["file"].dataType.simpleString()

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                found = [(number, np.frombuffer(content, "=f4", n, at).astype(float)) for number, at, n in _places(content, 4)]
                yield pa.RecordBatch.from_arrays([pa.array([name.as_py()] * len(found), name.type), pa.array([i for i, _ in found], pa.int64()), pa.array([v for _, v in found], pa.list_(pa.float64()))], ["file", "number", "vector"])

    return contents.select("file", "content").mapInArrow(decode, f"file {kind}, number long, vector array<double>")


def listed(rows: DataFrame, white: DataFrame | None = None, black: DataFrame | None = None, id: str = "instance_id") -> DataFrame:
    """rows whose 1-based number is on the white list; if there is a black list, it decides alone over both lists' ids."""
    number = rows.withColumn("_n", F.col(id) + 1)
    if black is not None:
        number = number.join(black.select(F.col("id").alias("_n")).distinct(), "_n", "left_anti")
    elif white is not None:
        number = number.join(white.select(F.col("id").alias("_n")).distinct(), "_n", "left_semi")
    return number.drop("_n")


def model(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(models, weights) of one or many model files: levels count from 0; keys come in a fixed order.

    The file's name is the model, or in what save_models() has written the folder's value.
    """
    keys = ["bitsize", "instance_parts_threshold", "radius", "distance", "positive_threshold", "negative_threshold", "bias", "wscale"]
    files = spark.read.text(path, wholetext=True)
    name = F.col("model").cast("string") if "model" in files.columns else F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    text = files.select(name.alias("model"), "value")
    level = text.select("model", F.posexplode(F.expr("slice(split(value, '(?m)^bitsize '), 2, length(value))")).alias("level", "value"))
    level = level.withColumn("value", F.concat(F.lit("bitsize "), "value"))
    wrong = F.raise_error(F.concat(F.lit("model keys out of order: "), "model"))
    pattern = "(?s)" + r"\s+".join(rf"{k}\s+\S+" for k in keys) + r"\s+w\s.*"
    level = level.withColumn("value", F.when(F.col("value").rlike("^" + pattern), F.col("value")).otherwise(wrong))
    got = lambda k: F.regexp_extract("value", rf"(?m)^{k}\s+(\S+)", 1)
    models = level.select("model", "level", got("bitsize").cast("int").alias("bits"), got("radius").cast("int").alias("radius"), got("distance").cast("int").alias("distance"), got("positive_threshold").cast("double").alias("pos_thr"), got("negative_threshold").cast("double").alias("neg_thr"), got("bias").cast("double").alias("bias"), got("wscale").cast("double").alias("wscale"))
    token = level.select("model", "level", F.explode(F.split(F.regexp_extract("value", r"(?m)^w\s+(.*)$", 1), r"\s+")).alias("t")).where("t LIKE '%:%'")
    return models, token.select("model", "level", F.split_part("t", F.lit(":"), F.lit(1)).cast("long").alias("fid"), F.split_part("t", F.lit(":"), F.lit(2)).cast("double").alias("w"))
