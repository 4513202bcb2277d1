"""Views that several queries share, as DataFrames and as parts of a WITH clause."""

from __future__ import annotations

from string import ascii_uppercase

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandgraph.functions.hashing import MASK31, SEED
from strandgraph.operators import encode, features, sequence

MODELS = 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, lang, seq) of documents: letters in upper case."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang", "text")
    return sequence.cleaned(docs).drop("text")


def peptides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 15 residues every 5 over the whole texts of benchmark: the set of graphs of the graph queries."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text")
    return sequence.windows(sequence.cleaned(items))


def graphs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Vertices and edges of the peptides, each graph beside its reversed copy."""
    p = peptides(spark, sf_dir)
    return encode.directed(encode.vertices(p), encode.edges(p))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of the peptides at radius 0 and distance 1, 15 bits.

    Equal peptides have equal features: they are made once for each distinct sequence and joined back.
    """
    p = peptides(spark, sf_dir)
    distinct = p.select("seq").distinct().select(F.col("seq").alias("peptide_id"), "seq")
    v, e = encode.directed(encode.vertices(distinct), encode.edges(distinct))
    made = features.graph_vectors(v, e, 0, 1)
    return p.select("peptide_id", "seq").join(made, F.col("seq") == F.col("instance_id")).select(F.col("peptide_id").alias("instance_id"), "fid", "val")


def weights(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """Five made-up models over all feature ids."""
    grid = spark.range(32768).select(F.col("id").alias("fid"), F.explode(F.sequence(F.lit(0), F.lit(MODELS - 1))).alias("model"))
    w = grid.select("model", F.lit(0).alias("level"), "fid", (((F.col("fid") * 7919 + F.col("model") * 104729) % 2001 - 1000) / 1000).alias("w"))
    models = spark.range(MODELS).select(F.col("id").cast("int").alias("model"), F.lit(0).alias("level"), F.lit(0.0).alias("bias"), F.lit(1.0).alias("wscale"), F.lit(0.0).alias("pos_thr"), F.lit(0.0).alias("neg_thr"))
    return w, models


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(instance_id, y) of documents: quality as 1 or -1, 0 where there is no label."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    y = F.when(F.col("quality") == 1, 1).when(F.col("quality") == 0, -1).otherwise(0)
    return docs.select("doc_id").join(labels, "doc_id", "left").select(F.col("doc_id").alias("instance_id"), y.alias("y"))


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    return labels.select(F.col("doc_id").alias("instance_id"), (2 * F.col("quality") - 1).alias("y"), (1 - 2 * F.col("toxic")).alias("prediction"))


def letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(instance_id, fid, val) of documents: shares of the letters A to Z (fid 65 to 90), as small feature vectors."""
    counts = sequences(spark, sf_dir).select("id", *[sequence.letter_count(c).alias(c) for c in ascii_uppercase])
    counts = counts.groupBy("id").agg(*[F.sum(c).alias(c) for c in ascii_uppercase]).withColumn("total", sum(F.col(c) for c in ascii_uppercase))
    share = lambda c: F.struct(F.lit(ord(c)).cast("long").alias("fid"), (F.col(c) / F.when(F.col("total") > 0, F.col("total"))).alias("val"))
    return counts.select(F.col("id").alias("instance_id"), F.inline(F.array(*[share(c) for c in ascii_uppercase]))).where("val > 0")


# ---- SQL ---------------------------------------------------------------------------------------------------------


def query(*parts: str, final: str) -> str:
    return "WITH RECURSIVE " + ", ".join(parts) + " " + final


def ap(items: str, mask: int = MASK31) -> str:
    """SQL of the alternating hash of a list of numbers."""
    step = "CASE WHEN i % 2 = 1 THEN xor(h, xor(h << 7, c * (h >> 3))) & 4294967295 ELSE xor(h, ~xor((h << 11) + c, h >> 5)) & 4294967295 END"
    return f"(list_reduce({items}, lambda h, c, i: {step}, CAST({SEED} AS BIGINT)) & {mask})"


def ap_text(text: str, mask: int = MASK31) -> str:
    codes = f"list_transform(string_split({text}, ''), lambda c: CAST(ascii(c) AS BIGINT))"
    return f"CASE WHEN {text} = '' THEN {SEED & mask} ELSE {ap(codes, mask)} END"


SEQ = "seqs AS (SELECT doc_id AS id, lang, upper(regexp_replace(text, '[^a-zA-Z]', '', 'g')) AS seq FROM documents)"
ITEMS = "items AS (SELECT item_id AS id, upper(regexp_replace(text, '[^a-zA-Z]', '', 'g')) AS seq FROM benchmark)"


def windows_sql(source: str) -> str:
    return f"""pep AS (SELECT id, CAST(i + 1 AS INTEGER) AS start, CAST(i + 15 AS INTEGER) AS "end", id || '-' || (i + 1) || '-' || (i + 15) AS peptide_id, substr(seq, CAST(i AS INTEGER) + 1, 15) AS seq
        FROM (SELECT *, unnest(range(0, len(seq) - 14, 5)) AS i FROM {source} WHERE len(seq) >= 15))"""


PEP = (ITEMS, windows_sql("items"))
POL = "CASE WHEN contains('AGILMFPWV', aa) THEN '{0}PN' ELSE '{0}PP' END"
CHA = "CASE WHEN contains('DE', aa) THEN '{0}CA' WHEN contains('RKH', aa) THEN '{0}CB' ELSE '{0}CN' END"
HYD = "CASE WHEN contains('LVI', aa) THEN '{0}HVH' WHEN contains('AMCF', aa) THEN '{0}HH' WHEN contains('GTSWYP', aa) THEN '{0}HL' ELSE '{0}HVL' END"


def encode_sql(source: str = "pep", id: str = "peptide_id") -> tuple[str, str]:
    """v1 and e1: vertices and edges of the four layers."""
    v = f"""v1 AS (SELECT graph_id, CAST(layer * n + pos AS INTEGER) AS vid, layer, pos, CASE layer WHEN 0 THEN 'X' WHEN 1 THEN {CHA.format("P")} WHEN 2 THEN {HYD.format("P")} ELSE 'PA' || aa END AS label
        FROM (SELECT {id} AS graph_id, len(seq) AS n, CAST(p AS INTEGER) AS pos, substr(seq, CAST(p AS INTEGER), 1) AS aa, CAST(l AS INTEGER) AS layer FROM (SELECT *, unnest(range(1, len(seq) + 1)) AS p FROM {source}), (SELECT unnest(range(0, 4)) AS l)))"""
    e = f"""e1 AS (SELECT {id} AS graph_id, CAST(CASE WHEN l = 0 THEN p ELSE (l - 1) * len(seq) + p END AS INTEGER) AS src, CAST(CASE WHEN l = 0 THEN p + 1 ELSE l * len(seq) + p END AS INTEGER) AS dst, '' AS label
        FROM (SELECT *, unnest(range(1, len(seq) + 1)) AS p FROM {source}), (SELECT unnest(range(0, 4)) AS l) WHERE l > 0 OR p < len(seq))"""
    return v, e


DOUBLED = (
    "size AS (SELECT graph_id, max(vid) AS n FROM v1 GROUP BY graph_id)",
    "v AS (SELECT graph_id, vid, label FROM v1 UNION ALL SELECT graph_id, CAST(vid + n AS INTEGER), 'r.' || label FROM v1 JOIN size USING (graph_id))",
    "e AS (SELECT graph_id, src, dst, label FROM e1 UNION ALL SELECT graph_id, CAST(dst + n AS INTEGER), CAST(src + n AS INTEGER), label FROM e1 JOIN size USING (graph_id))",
)
GRAPHS = (*PEP, *encode_sql(), *DOUBLED)


def distances_sql(bound: int, v: str = "v", e: str = "e", name: str = "dist") -> tuple[str, ...]:
    """dist (graph_id, src, dst, d): walks of each length, of which the shortest counts."""
    out = [f"{name}0 AS (SELECT graph_id, vid AS src, vid AS dst, 0 AS d FROM {v})"]
    for k in range(1, bound + 1):
        out.append(f"{name}{k} AS (SELECT DISTINCT a.graph_id, a.src, b.dst, {k} AS d FROM {name}{k - 1} a JOIN {e} b ON a.graph_id = b.graph_id AND a.dst = b.src)")
    union = " UNION ALL ".join(f"SELECT * FROM {name}{k}" for k in range(bound + 1))
    return (*out, f"{name} AS (SELECT graph_id, src, dst, CAST(min(d) AS INTEGER) AS d FROM ({union}) GROUP BY graph_id, src, dst)")


CODES0 = f"code0 AS (SELECT graph_id, vid, code FROM v JOIN (SELECT label, {ap_text('label')} AS code FROM (SELECT DISTINCT label FROM v)) USING (label))"
CODES1 = f"""text1 AS (SELECT graph_id, vid, label || ':' || coalesce(a, '') AS t FROM v LEFT JOIN (SELECT e.graph_id, e.src AS vid, string_agg(w.label || '-' || e.label, '.' ORDER BY w.label || '-' || e.label) AS a FROM e JOIN v w ON w.graph_id = e.graph_id AND w.vid = e.dst GROUP BY e.graph_id, e.src) USING (graph_id, vid)),
    code1 AS (SELECT graph_id, vid, code FROM text1 JOIN (SELECT t, {ap_text('t')} AS code FROM (SELECT DISTINCT t FROM text1)) USING (t))"""


def subgraphs_sql(name: str, members: str, bound: int, v: str = "v", e: str = "e", host: str = "") -> tuple[str, ...]:
    """{name}_code (graph_id, root, code) of the subgraphs of members (graph_id, root, vid).

    Distances are of walks within the subgraph of at most bound edges, or those of the table host (graph_id, src, dst, d).
    """
    out = [f"{name}_e AS (SELECT a.graph_id, a.root, x.src, x.dst, x.label FROM {e} x JOIN {members} a ON a.graph_id = x.graph_id AND a.vid = x.src JOIN {members} b ON b.graph_id = x.graph_id AND b.vid = x.dst AND b.root = a.root)"]
    if not host:
        out.append(f"{name}_w0 AS (SELECT graph_id, root, vid AS src, vid AS dst, 0 AS d FROM {members})")
        for k in range(1, bound + 1):
            out.append(f"{name}_w{k} AS (SELECT DISTINCT a.graph_id, a.root, a.src, b.dst, {k} AS d FROM {name}_w{k - 1} a JOIN {name}_e b ON a.graph_id = b.graph_id AND a.root = b.root AND a.dst = b.src)")
        union = " UNION ALL ".join(f"SELECT * FROM {name}_w{k}" for k in range(bound + 1))
        out.append(f"{name}_d AS (SELECT graph_id, root, src, dst, min(d) AS d FROM ({union}) GROUP BY ALL)")
        on = "w.graph_id = a.graph_id AND w.root = a.root AND w.src = a.vid AND w.dst = b.vid"
    else:
        out.append(f"{name}_d AS (SELECT graph_id, src, dst, d FROM {host} WHERE d <= {bound})")
        on = "w.graph_id = a.graph_id AND w.src = a.vid AND w.dst = b.vid"
    near = f"SELECT a.graph_id, a.root, a.vid, coalesce(w.d, -1) || x.label AS t FROM {members} a JOIN {members} b ON b.graph_id = a.graph_id AND b.root = a.root JOIN {v} x ON x.graph_id = b.graph_id AND x.vid = b.vid LEFT JOIN {name}_d w ON {on}"
    hashed = f"SELECT list_sort(list(h)) AS hs, graph_id, root, vid FROM {name}_t JOIN (SELECT t, {ap_text('t')} AS h FROM (SELECT DISTINCT t FROM {name}_t)) USING (t) GROUP BY graph_id, root, vid"
    ends = f"SELECT x.graph_id, x.root, x.label AS l, least(a.code, b.code) AS p, greatest(a.code, b.code) AS q FROM {name}_e x JOIN {name}_n a ON a.graph_id = x.graph_id AND a.root = x.root AND a.vid = x.src JOIN {name}_n b ON b.graph_id = x.graph_id AND b.root = x.root AND b.vid = x.dst"
    coded = f"SELECT hs, {ap('hs')} AS code FROM (SELECT DISTINCT hs FROM {{}})"
    triple = f"SELECT p, q, l, {ap(f'[p, q, {ap_text(chr(108))}]')} AS h FROM (SELECT DISTINCT p, q, l FROM {name}_x)"
    return (
        *out,
        f"{name}_t AS ({near})",
        f"{name}_h AS ({hashed})",
        f"{name}_n AS (SELECT graph_id, root, vid, code FROM {name}_h JOIN ({coded.format(f'{name}_h')}) USING (hs))",
        f"{name}_x AS ({ends})",
        f"{name}_y AS (SELECT graph_id, root, list_sort(list(h)) AS hs FROM {name}_x JOIN ({triple}) USING (p, q, l) GROUP BY graph_id, root)",
        f"{name}_code AS (SELECT m.graph_id, m.root, coalesce(c.code, {SEED & MASK31}) AS code FROM (SELECT DISTINCT graph_id, root FROM {members}) m LEFT JOIN {name}_y y USING (graph_id, root) LEFT JOIN ({coded.format(f'{name}_y')}) c USING (hs))",
    )


def histogram_sql(distance: int = 1, kind: str = "hard", first: str = "true") -> str:
    """hist (graph_id, block, selector, predicate, bin, cnt) of radius 0 from dist and code0."""
    block = f"CASE d {' '.join(f'WHEN {d} THEN ' + ap_text(f"'d:{d} r:0'") for d in range(distance + 1))} END"
    number = ap("[CAST(d AS BIGINT), 0]")
    pair = "SELECT p.*, a.code AS a, b.code AS b FROM dist p JOIN code0 a ON a.graph_id = p.graph_id AND a.vid = p.src JOIN code0 b ON b.graph_id = p.graph_id AND b.vid = p.dst WHERE {}".format(first)
    one = {
        "hard": f"SELECT graph_id, {block} AS block, CASE WHEN d = 0 THEN {ap('[a]')} ELSE {ap('[least(a, b), greatest(a, b)]')} END AS selector, CASE WHEN d = 0 THEN 1 ELSE 2 END AS c FROM pair",
        "alias": f"SELECT graph_id, {number} AS block, {ap('[a, b]')} AS selector, 2 AS c FROM pair UNION ALL SELECT graph_id, {ap('[1, CAST(d AS BIGINT), 0]')}, {ap('[b]')}, 1 FROM pair",
        "gapped": f"SELECT graph_id, {ap('[CAST(0 AS BIGINT)]')} AS block, {ap('[least(a, b), greatest(a, b)]')} AS selector, 2 AS c FROM pair JOIN (SELECT graph_id, max(d) AS d FROM pair GROUP BY graph_id) USING (graph_id, d)",
    }[kind]
    return f"pair AS ({pair}), one AS ({one}), hist AS (SELECT graph_id, block, selector, CAST(1 AS BIGINT) AS predicate, CAST(1 AS BIGINT) AS bin, CAST(sum(c) AS DOUBLE) AS cnt FROM one GROUP BY graph_id, block, selector)"


def vectors_sql(mode: str = "normalised", mask: int = 32767) -> str:
    """vec (instance_id, fid, val) from hist."""
    if mode == "normalised":
        value, source = "cnt / sqrt(n0 * n1 * n2 * ss)", """(SELECT h.*, 0 AS z, n0, n1, n2, ss FROM hist h
            JOIN (SELECT graph_id, count(DISTINCT block) AS n0 FROM hist GROUP BY 1) USING (graph_id) JOIN (SELECT graph_id, block, count(DISTINCT selector) AS n1 FROM hist GROUP BY 1, 2) USING (graph_id, block)
            JOIN (SELECT graph_id, block, selector, count(DISTINCT predicate) AS n2 FROM hist GROUP BY 1, 2, 3) USING (graph_id, block, selector)
            JOIN (SELECT graph_id, block, selector, predicate, sum(cnt * cnt) AS ss FROM hist GROUP BY 1, 2, 3, 4) USING (graph_id, block, selector, predicate))"""
    elif mode == "counts":
        value, source = "cnt", "(SELECT *, 0 AS z FROM hist)"
    else:
        value, source = "1e0", "(SELECT *, unnest(range(0, CAST(ceil(cnt) AS BIGINT))) AS z FROM hist)"
    return f"vec AS (SELECT graph_id AS instance_id, {ap('[block, selector, predicate, bin, z]', mask)} AS fid, max({value}) AS val FROM {source} GROUP BY 1, 2)"


FEATURES = (*GRAPHS, *distances_sql(1), CODES0, histogram_sql(), vectors_sql())
WEIGHT = "(((fid * 7919 + m * 104729) % 2001 - 1000) / 1e3)"
MARGINS = (*FEATURES, f"scored AS (SELECT instance_id, CAST(m AS INTEGER) AS model, sum(val * {WEIGHT}) AS margin FROM vec, (SELECT unnest(range(0, {MODELS})) AS m) GROUP BY 1, 2)")
TGT = "tgt AS (SELECT doc_id AS instance_id, CASE quality WHEN 1 THEN 1 WHEN 0 THEN -1 ELSE 0 END AS y FROM documents LEFT JOIN labels USING (doc_id))"
LETTERS = "letters AS (SELECT id AS instance_id, CAST(ascii(c) AS BIGINT) AS fid, count(*) / any_value(len(seq)) AS val FROM (SELECT id, seq, unnest(string_split(seq, '')) AS c FROM seqs WHERE seq <> '') GROUP BY id, c)"
