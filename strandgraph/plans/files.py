"""Queries that write the library's formats with its writers into the shared folder and read them back with its readers."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandgraph.functions import vectors as V
from strandgraph.operators import encode, sequence, train, variants
from strandgraph.plans import inputs as I
from strandgraph.plans.learning import KEY, LETTER_MARGIN, _letter_margin
from strandgraph.plans.inputs import table
from strandgraph.sources import readers, writers
from strandgraph.storage import fresh, materialize, wide

QUERIES, SQL = {}, {}


def fasta(spark, d):
    """Documents as FASTA in two folders, one of them zipped, wrapped, read as one input."""
    records = I.sequences(spark, d).where("seq <> ''")
    records = records.select("lang", F.concat_ws("\t", "id", F.concat(F.lit("lang="), "lang")).alias("head"), F.concat(F.lit("# "), "lang").alias("comment"), "seq")
    paths = [fresh(spark, "fasta") for _ in range(2)]
    writers.save_text(writers.fasta(records.where("lang = 'en'"), 60), paths[0])
    writers.save_text(writers.fasta(records.where("lang <> 'en'"), 70), paths[1], "gzip")
    found = readers.fasta(spark, paths, layout=True)
    return found.select("id", F.size("head_fields").alias("n_fields"), F.col("head_fields")[1].alias("field"), "comment", "seq", "n_lines", "width", F.lit(readers.is_fasta(spark, paths[0])).alias("sniffed"))


QUERIES["q_fasta_files"] = fasta
SQL["q_fasta_files"] = I.query(
    I.SEQ, "w AS (SELECT *, CASE WHEN lang = 'en' THEN 60 ELSE 70 END AS w, CAST(len(seq) AS INTEGER) AS n FROM seqs WHERE seq <> '')",
    final="SELECT CAST(id AS VARCHAR) AS id, 2 AS n_fields, 'lang=' || lang AS field, '# ' || lang AS comment, seq, CAST((n + w - 1) // w AS INTEGER) AS n_lines, least(n, w) AS width, true AS sniffed FROM w",
)


def fasta_layout(spark, d):
    """Documents' text lines as records, written again in the layout of the input."""
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x: F.upper(F.regexp_replace(x, "[^a-zA-Z]", ""))), lambda x: x != "")
    docs = table(spark, d, "documents").select("doc_id", lines.alias("l")).where("size(l) > 0")
    chunks = docs.select(F.concat(F.lit(">"), "doc_id", F.lit("\n"), F.array_join("l", "\n")).alias("value"))
    found = readers.parsed_fasta(chunks, layout=True)
    return writers.fasta(found, "input")


QUERIES["q_fasta_layout"] = fasta_layout
SQL["q_fasta_layout"] = r"""WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: upper(regexp_replace(x, '[^a-zA-Z]', '', 'g'))), lambda x: x <> '') AS l FROM documents),
    r AS (SELECT doc_id, len(l) AS n, array_to_string(l, '') AS seq, list_max(list_transform(l, lambda x: len(x))) AS w FROM l WHERE len(l) > 0), m AS (SELECT max(w) AS w FROM r)
    SELECT '>' || doc_id || chr(10) || CASE WHEN n = 1 THEN seq ELSE array_to_string(list_transform(range(0, len(seq), m.w), lambda i: substr(seq, CAST(i AS INTEGER) + 1, CAST(m.w AS INTEGER))), chr(10)) END AS value FROM r, m"""


def peptide_table(spark, d):
    path = fresh(spark, "peptides")
    writers.save_table(I.peptides(spark, d).select("peptide_id", F.lower("seq")), path)
    return readers.pairs(spark, path)


QUERIES["q_peptide_table"] = peptide_table
SQL["q_peptide_table"] = I.query(*I.PEP, final="SELECT peptide_id, seq FROM pep")


def _shapes(v, e):
    """(labels, edges, n): graphs by content."""
    labels = v.groupBy("graph_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("vid", "label"))), lambda x: x["label"]), " ").alias("labels"))
    ends = F.array_sort(F.collect_list(F.struct("src", "dst")))
    edges = e.where("src < dst").groupBy("graph_id").agg(F.array_join(F.transform(ends, lambda x: F.concat_ws("-", x["src"], x["dst"])), " ").alias("edges"))
    return labels.join(edges, "graph_id", "left").groupBy("labels", "edges").agg(F.count("*").alias("n"))


def gspan(spark, d):
    """Peptides' graphs written as gspan text and scanned again."""
    p, path = I.peptides(spark, d), fresh(spark, "gspan")
    writers.save_text(writers.export(encode.vertices(p), encode.edges(p), "gspan"), path)
    return _shapes(*readers.gspan(spark, path))


SHAPES = "lab AS (SELECT graph_id, string_agg(label, ' ' ORDER BY vid) AS labels FROM v1 GROUP BY 1), edg AS (SELECT graph_id, string_agg(src || '-' || dst, ' ' ORDER BY src, dst) AS edges FROM e1 WHERE src < dst GROUP BY 1)"
QUERIES["q_gspan_files"] = gspan
SQL["q_gspan_files"] = I.query(*I.PEP, *I.encode_sql(), SHAPES, final="SELECT labels, edges, count(*) AS n FROM lab LEFT JOIN edg USING (graph_id) GROUP BY 1, 2")


def one_line(spark, d):
    p = I.peptides(spark, d)
    return writers.one_line(encode.vertices(p), encode.edges(p))


QUERIES["q_one_line_graphs"] = one_line
SQL["q_one_line_graphs"] = I.query(
    *I.PEP, *I.encode_sql(),
    final="SELECT graph_id, vs || ' ' || es AS value FROM (SELECT graph_id, string_agg(vid || ':' || label, ' ' ORDER BY vid) AS vs FROM v1 GROUP BY 1) JOIN (SELECT graph_id, string_agg(src || '-' || dst || ':' || label, ' ' ORDER BY src, dst) AS es FROM e1 GROUP BY 1) USING (graph_id)",
)


def gspan_columns(spark, d):
    """Orders as chain graphs with every optional column: a second label, viewpoints, places, weights."""
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus")
    rows = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("graph_id")).agg(F.array_sort(F.collect_list(line)).alias("p"))
    v = F.transform("p", lambda x, i: F.concat_ws(" ", F.lit("v"), i + 1, x["l_returnflag"], x["l_linestatus"], (x["l_quantity"] > 25).cast("int"), x["l_quantity"], x["l_discount"], x["l_tax"]))
    e = F.transform(F.slice("p", 1, F.size("p") - 1), lambda x, i: F.concat_ws(" ", F.lit("e"), i + 1, i + 2, F.lit("next"), x["l_tax"]))
    text = F.concat(F.lit("t # "), F.col("graph_id").cast("string"), F.lit("\n"), F.array_join(v, "\n"), F.lit("\n"), F.array_join(e, "\n"))
    vertices, edges = readers.parsed_gspan(rows.select("graph_id", text.alias("value")), weights=True, viewpoint=True, coordinates=True, absolute_id=True)
    arcs = edges.select("graph_id", F.col("src").alias("vid"), "dst", F.col("label").alias("edge"), "weight")
    found = vertices.join(arcs, ["graph_id", "vid"], "left")
    return found.select("graph_id", "vid", "label", "absolute_id", "viewpoint", F.col("coord")[0].alias("x"), F.col("coord")[1].alias("y"), F.col("coord")[2].alias("z"), "dst", "edge", "weight")


QUERIES["q_gspan_columns"] = gspan_columns
SQL["q_gspan_columns"] = """WITH l AS (SELECT *, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_discount, l_tax, l_returnflag, l_linestatus) AS INTEGER) AS vid, count(*) OVER (PARTITION BY l_orderkey) AS last FROM lineitem)
    SELECT l_orderkey AS graph_id, vid, l_returnflag AS label, l_linestatus AS absolute_id, l_quantity > 25 AS viewpoint, l_quantity AS x, l_discount AS y, l_tax AS z,
        CASE WHEN vid < last THEN vid + 1 END AS dst, CASE WHEN vid < last THEN 'next' END AS edge, CASE WHEN vid < last THEN l_tax END AS weight FROM l"""


def gspan_nominal(spark, d):
    """Orders as stars whose vertices have names: the first line is bound to all others."""
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_tax", "l_returnflag")
    rows = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("graph_id")).agg(F.array_sort(F.collect_list(line)).alias("p"))
    name = lambda x, i: F.concat(F.lit("part"), x["l_partkey"].cast("string"), F.lit("/"), (i * 7 % 10).cast("string"))
    v = F.transform("p", lambda x, i: F.concat_ws(" ", F.lit("v"), name(x, i), x["l_returnflag"]))
    e = F.transform(F.expr("slice(p, 2, size(p))"), lambda x, i: F.concat_ws(" ", F.lit("e"), name(F.col("p")[0], F.lit(0)), name(x, i + 1), x["l_linenumber"]))
    text = F.concat(F.array_join(v, "\n"), F.lit("\n"), F.array_join(e, "\n"))
    vertices, edges = readers.parsed_gspan(rows.select("graph_id", text.alias("value")), nominal=True)
    ends = edges.select("graph_id", F.col("dst").alias("vid"), "src", F.col("label").alias("edge"))
    return vertices.join(ends, ["graph_id", "vid"], "left")


QUERIES["q_gspan_nominal"] = gspan_nominal
SQL["q_gspan_nominal"] = """SELECT l_orderkey AS graph_id, vid, l_returnflag AS label, CASE WHEN vid > 0 THEN 0 END AS src, CASE WHEN vid > 0 THEN CAST(l_linenumber AS VARCHAR) END AS edge
    FROM (SELECT *, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_discount, l_tax, l_returnflag) - 1 AS INTEGER) AS vid FROM lineitem)"""


def sdf(spark, d):
    """Orders as molecules: lines are atoms, those that follow one another are bound."""
    line = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_returnflag"))).alias("p")).withColumn("n", F.size("p"))
    atoms = F.array_join(F.transform("p", lambda x: F.format_string("%31s%-3s 0", F.lit(""), x["l_returnflag"])), "\n")
    bonds = F.array_join(F.transform(F.expr("slice(sequence(1, n), 1, n - 1)"), lambda i: F.format_string("%3d%3d%3d", i, i + 1, F.lit(1))), "\n")
    text = F.concat_ws("\n", F.concat(F.lit("order "), F.col("l_orderkey").cast("string")), F.lit(" made"), F.lit(" here"), F.format_string("%3d%3d  0", "n", F.col("n") - 1), atoms, F.when(F.col("n") > 1, bonds), F.lit("$$$$"))
    path = fresh(spark, "sdf")
    writers.save_text(line.select(text.alias("value")), path)
    return _shapes(*readers.sdf(spark, path))


QUERIES["q_sdf_files"] = sdf
SQL["q_sdf_files"] = """WITH m AS (SELECT l_orderkey, string_agg(l_returnflag, ' ' ORDER BY l_linenumber, l_returnflag) AS labels, count(*) AS n FROM lineitem GROUP BY 1)
    SELECT labels, CASE WHEN m.n > 1 THEN array_to_string(list_transform(range(0, m.n - 1), lambda i: i || '-' || (i + 1)), ' ') END AS edges, count(*) AS n FROM m GROUP BY 1, 2"""


def targets(spark, d):
    """Targets in one column and in lines of many, counted after the scan."""
    rows, paths = I.targets(spark, d), [fresh(spark, "targets") for _ in range(2)]
    writers.save_text(rows.select(F.col("y").cast("string").alias("value")), paths[0])
    wide = rows.groupBy(F.floor(F.col("instance_id") / 10)).agg(F.array_join(F.transform(F.collect_list("y"), lambda y: y.cast("string")), " ").alias("value"))
    writers.save_text(wide, paths[1])
    each = [readers.targets(spark, p).groupBy("y").agg(F.count("*").alias("n"), F.count_distinct("instance_id").alias("ids")).withColumn("form", F.lit(f)) for p, f in zip(paths, ("column", "lines"), strict=True)]
    return each[0].unionByName(each[1])


QUERIES["q_target_files"] = targets
SQL["q_target_files"] = I.query(I.TGT, final="SELECT y, count(*) AS n, count(*) AS ids, form FROM tgt, (VALUES ('column'), ('lines')) f(form) GROUP BY y, form")


def models(spark, d):
    """Models made of the classes' letters, one file for each language, saved and parsed."""
    docs = I.sequences(spark, d).select(F.col("id").alias("instance_id"), "lang")
    n = I.letters(spark, d).join(docs, "instance_id").groupBy(F.col("lang").alias("model"), "fid").agg(F.count("*").alias("n"))
    level = F.explode(F.array(F.lit(0), F.lit(1))).alias("level")
    weights = n.select("model", level, "fid", "n").select("model", "level", "fid", (F.col("n") * (F.col("level") + 1)).cast("double").alias("w"))
    heads = weights.groupBy("model", "level").agg(F.sum("w").alias("bias")).select("model", "level", F.lit(14).alias("bits"), F.lit(2).alias("radius"), F.lit(3).alias("distance"), F.lit(0.5).alias("pos_thr"), F.lit(-0.5).alias("neg_thr"), "bias", F.lit(2.0).alias("wscale"))
    path = fresh(spark, "models")
    writers.save_models(heads, weights, path)
    heads, weights = readers.model(spark, path)
    return heads.join(weights, ["model", "level"]).groupBy("model", *heads.columns[1:]).agg(F.count("*").alias("n"), F.sum("fid").alias("fids"), F.sum("w").alias("w")).drop("model")


QUERIES["q_model_files"] = models
SQL["q_model_files"] = I.query(
    I.SEQ, I.LETTERS, "c AS (SELECT lang, fid, count(*) AS n FROM letters JOIN seqs ON id = instance_id GROUP BY 1, 2)",
    final="SELECT CAST(level AS INTEGER) AS level, 14 AS bits, 2 AS radius, 3 AS distance, 0.5e0 AS pos_thr, -0.5e0 AS neg_thr, CAST(sum(n * (level + 1)) AS DOUBLE) AS bias, 2e0 AS wscale, count(*) AS n, CAST(sum(fid) AS BIGINT) AS fids, CAST(sum(n * (level + 1)) AS DOUBLE) AS w FROM c, (VALUES (0), (1)) l(level) GROUP BY lang, level",
)


def _counts(spark, d):
    """(instance_id, fid, val): how often documents hold each letter."""
    counts = sequence.residue_histogram(I.sequences(spark, d), ["id"])
    return counts.select(F.col("id").alias("instance_id"), F.ascii("residue").cast("long").alias("fid"), F.col("n").cast("double").alias("val"))


COUNTS = "cnt AS (SELECT id AS instance_id, CAST(ascii(r) AS BIGINT) AS fid, CAST(count(*) AS DOUBLE) AS val FROM (SELECT id, unnest(string_split(seq, '')) AS r FROM seqs WHERE seq <> '') GROUP BY 1, 2)"


def sparse_files(spark, d):
    """Letter counts as sparse vectors in text, read by both scans."""
    path = fresh(spark, "sparse")
    writers.save_text(writers.sparse_text(_counts(spark, d)), path)
    out = None
    for form, scan in (("loose", readers.sparse_text), ("strict", readers.sparse_text_strict)):
        one = scan(spark, path).groupBy("instance_id").agg(F.count("*").alias("size"), F.sum("fid").alias("fids"), F.sum("val").alias("total"), F.max("val").alias("most"))
        one = one.groupBy("size", "fids", "total", "most").agg(F.count("*").alias("n")).withColumn("form", F.lit(form))
        out = one if out is None else out.unionByName(one)
    return out


QUERIES["q_sparse_files"] = sparse_files
SQL["q_sparse_files"] = I.query(I.SEQ, COUNTS, "s AS (SELECT count(*) AS size, CAST(sum(fid) AS BIGINT) AS fids, sum(val) AS total, max(val) AS most FROM cnt GROUP BY instance_id)", final="SELECT size, fids, total, most, count(*) AS n, form FROM s, (VALUES ('loose'), ('strict')) f(form) GROUP BY ALL")
QUERIES["q_sparse_binary"] = lambda spark, d: readers.decoded_sparse(writers.sparse_binary(_counts(spark, d)).select(F.col("instance_id").alias("file"), "content")).withColumnRenamed("file", "instance_id")
SQL["q_sparse_binary"] = I.query(I.SEQ, COUNTS, final="SELECT instance_id, CAST(0 AS BIGINT) AS vector, fid, val FROM cnt")


def dense_binary(spark, d):
    """Embeddings in binary, those of one hundred of ids after one another in one content."""
    one = writers.dense_binary(table(spark, d, "embeddings"), "vec_id", "embedding")
    many = one.groupBy(F.floor(F.col("vec_id") / 100).alias("file")).agg(F.array_sort(F.collect_list(F.struct("vec_id", "content"))).alias("p"))
    found = readers.decoded_dense(many.select("file", F.aggregate("p.content", F.lit(b""), lambda a, x: F.concat(a, x)).alias("content")))
    return found.select("file", "number", F.size("vector").alias("dims"), F.round(V.squared_norm(F.col("vector")), 6).alias("norm"), F.col("vector")[0].alias("first"))


QUERIES["q_dense_binary"] = dense_binary
SQL["q_dense_binary"] = """SELECT vec_id // 100 AS file, row_number() OVER (PARTITION BY vec_id // 100 ORDER BY vec_id) - 1 AS number, CAST(len(v) AS INTEGER) AS dims, round(list_dot_product(v, v), 6) AS norm, v[1] AS first
    FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"""


def dense_files(spark, d):
    """Embeddings in tenths of thousandths as text vectors."""
    path = fresh(spark, "dense")
    whole = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.round(x.cast("double") * 1000)).alias("embedding"))
    writers.save_text(writers.dense_text(whole, "vec_id", "embedding"), path)
    return readers.dense_text(spark, path).select(F.concat_ws(" ", F.transform("vector", lambda x: x.cast("long").cast("string"))).alias("vector")).groupBy("vector").agg(F.count("*").alias("n"))


QUERIES["q_dense_files"] = dense_files
SQL["q_dense_files"] = "SELECT vector, count(*) AS n FROM (SELECT array_to_string(list_transform(embedding, lambda x: CAST(round(CAST(x AS DOUBLE) * 1000) AS BIGINT)), ' ') AS vector FROM embeddings) GROUP BY 1"


def lists(spark, d):
    """Numbers in lines of several, integers, names, and weights by index."""
    e, path = table(spark, d, "lineitem"), [fresh(spark, "lists") for _ in range(3)]
    line = e.groupBy("l_orderkey").agg(F.array_join(F.transform(F.collect_list("l_partkey"), lambda x: x.cast("string")), " ").alias("value"))
    writers.save_text(line, path[0])
    parts = table(spark, d, "part")
    writers.save_text(parts.select(F.concat(F.lit("  "), "p_name", F.lit(" ")).alias("value")), path[1])
    writers.save_text(parts.select(F.concat_ws(" ", "p_partkey", "p_size").alias("value")), path[2])
    kinds = {
        "numbers": readers.numbers(spark, path[0]).select("value"), "integers": readers.integers(spark, path[0]).select(F.col("id").cast("double").alias("value")),
        "strings": readers.strings(spark, path[1]).select(F.length("value").cast("double").alias("value")), "weights": readers.feature_weights(spark, path[2]).select((F.col("fid") * F.col("w")).alias("value")),
    }
    out = None
    for kind, rows in kinds.items():
        one = rows.agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.max("value").alias("most")).withColumn("kind", F.lit(kind))
        out = one if out is None else out.unionByName(one)
    return out


QUERIES["q_list_files"] = lists
SQL["q_list_files"] = """SELECT count(*) AS n, sum(x) AS total, max(x) AS most, kind FROM (
    SELECT CAST(l_partkey AS DOUBLE) AS x, kind FROM lineitem, (VALUES ('numbers'), ('integers')) k(kind) UNION ALL SELECT CAST(len(trim(p_name)) AS DOUBLE), 'strings' FROM part UNION ALL SELECT CAST(p_partkey * p_size AS DOUBLE), 'weights' FROM part) GROUP BY kind"""


def domains(spark, d):
    """Parts' names by type and brand as a lookup table in a file; every row has its own number."""
    path = fresh(spark, "domains")
    writers.save_table(table(spark, d, "part").select(F.concat_ws(" ", "p_type", "p_brand"), "p_name"), path)
    found = readers.domains(spark, path)
    return found.groupBy("name", "aligned_seq").agg(F.count_distinct("ord").alias("n"))


QUERIES["q_domain_files"] = domains
SQL["q_domain_files"] = "SELECT p_type || ' ' || p_brand AS name, p_name AS aligned_seq, count(*) AS n FROM part GROUP BY 1, 2"


def results(spark, d):
    """Validation rows and their folds, written as tables and by part, read as tab-separated text."""
    rows = _letter_margin(spark, d).where("y <> 0")
    rows = train.folds(rows.select("instance_id", "y", "margin"), 10).select("instance_id", "y", F.when(F.col("margin") >= 0, 1).otherwise(-1).alias("prediction"), "margin", "fold")
    paths = [fresh(spark, "results") for _ in range(2)]
    writers.save_table(rows.drop("fold"), paths[0])
    writers.save_parts(rows, paths[1], ["fold"])
    kinds = "instance_id long, y int, prediction int, margin double"
    back = lambda path, schema: spark.read.schema(schema).csv(path, sep="\t")
    return back(paths[0], kinds).withColumn("fold", F.lit(None).cast("int")).unionByName(back(paths[1], kinds + ", fold int"))


QUERIES["q_result_files"] = results
SQL["q_result_files"] = I.query(
    *LETTER_MARGIN, f"f AS (SELECT *, CAST(row_number() OVER (PARTITION BY y ORDER BY {KEY.replace('doc_id', 'instance_id')}, instance_id) % 10 AS INTEGER) AS fold FROM lm WHERE y <> 0)",
    final="SELECT instance_id, CAST(y AS INTEGER) AS y, CASE WHEN margin >= 0 THEN 1 ELSE -1 END AS prediction, margin, CASE WHEN k = 1 THEN fold END AS fold FROM f, (VALUES (0), (1)) b(k)",
)


def feature_maps(spark, d):
    """Dictionaries of hashes of two columns of parts, one folder each."""
    from strandgraph.functions.hashing import ap_hash_string

    parts, path = table(spark, d, "part"), fresh(spark, "maps")
    writers.save_feature_maps({c: writers.dictionary(parts.withColumn("code", ap_hash_string(c)), c, "code") for c in ("p_type", "p_brand")}, path)
    read = lambda c: spark.read.schema("code long, text string").csv(f"{path}/{c}", sep="\t").withColumn("generator", F.lit(c))
    return read("p_type").unionByName(read("p_brand"))


QUERIES["q_feature_maps"] = feature_maps
SQL["q_feature_maps"] = f"SELECT {I.ap_text('text')} AS code, text, generator FROM (SELECT DISTINCT p_type AS text, 'p_type' AS generator FROM part UNION ALL SELECT DISTINCT p_brand, 'p_brand' FROM part)"


#: Lines that one task of the variant workflow takes, about.
LINES = 250_000


def workflow(spark, d):
    """The variant workflow: chunks brought together, passed sites of one kind, samples taken out, alleles split and merged.

    Every shuffle has tasks by the number of lines, so a task's rows don't grow with the tables. Sites are made once and written;
    chunks and kinds read them.
    """
    line = table(spark, d, "lineitem")
    parts = -(-line.count() // LINES) or 1
    line = line.where("l_partkey % 7 <> 0")
    alt = F.when(F.col("l_returnflag") == "R", "*").when(F.col("l_shipdate") < "1995-01-01", "AT").otherwise(F.col("l_linestatus"))
    one = F.struct("l_linenumber", alt.alias("alt"), F.round("l_quantity").cast("int").alias("c"), F.struct(F.concat(F.lit("s"), (F.col("l_suppkey") % 5).cast("string")).alias("sample"), F.col("l_returnflag").alias("gt")).alias("g"))
    status = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus").repartition(parts, "l_orderkey")
    sites = wide(line.select("l_orderkey", one.alias("one")).repartition(parts, "l_orderkey").groupBy("l_orderkey").agg(F.array_sort(F.collect_list("one")).alias("a"))).join(status, "l_orderkey")
    sites = sites.select(F.concat(F.lit("chr"), (F.col("l_orderkey") % 3).cast("string")).alias("chrom"), F.col("l_orderkey").alias("pos"), F.lit("N").alias("ref"), F.col("a.alt").alias("alts"), F.when(F.col("o_orderstatus") == "F", "PASS").otherwise("low").alias("filter"), F.col("a.c").alias("ac"), F.col("a.g").alias("genotypes"))
    sites = materialize(sites, "sites")
    whole = materialize(variants.passed(variants.concatenated(*[sites.where(F.col("chrom") == f"chr{k}") for k in range(3)], parts=parts)), "passed")
    out = None
    for kind in ("snp", "indel"):
        kept = variants.without_samples(variants.by_type(whole, kind, 10), spark.createDataFrame([("s1",), ("s3",)], "sample string"))
        kept = kept.withColumn("samples", F.array_join("genotypes.sample", ","))
        merged = variants.merged_alleles(variants.without_stars(variants.split_alleles(kept)), ["samples"], parts)
        part = merged.select("chrom", "pos", F.array_join("alts", "/").alias("alts"), F.array_join(F.transform("ac", lambda x: x.cast("string")), "/").alias("counts"), "samples", F.lit(kind).alias("kind"))
        out = part if out is None else out.unionByName(part)
    return out


QUERIES["q_variant_workflow"] = workflow
SQL["q_variant_workflow"] = """WITH a AS (SELECT l_orderkey AS pos, l_linenumber AS n, CASE WHEN l_returnflag = 'R' THEN '*' WHEN l_shipdate < TIMESTAMP '1995-01-01' THEN 'AT' ELSE l_linestatus END AS alt, CAST(round(l_quantity) AS INTEGER) AS c, 's' || (l_suppkey % 5) AS sample
        FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_partkey % 7 <> 0 AND o_orderstatus = 'F'),
    s AS (SELECT pos, CASE WHEN bool_and(alt <> 'AT') THEN 'snp' ELSE 'indel' END AS kind, string_agg(sample, ',' ORDER BY n, alt, c, sample) FILTER (sample NOT IN ('s1', 's3')) AS samples FROM a GROUP BY 1 HAVING max(c) >= 10)
    SELECT 'chr' || (pos % 3) AS chrom, pos, string_agg(alt, '/' ORDER BY n, alt, c) AS alts, string_agg(CAST(c AS VARCHAR), '/' ORDER BY n, alt, c) AS counts, coalesce(any_value(samples), '') AS samples, any_value(kind) AS kind FROM a JOIN s USING (pos) WHERE alt <> '*' GROUP BY pos"""
