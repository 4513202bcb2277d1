"""Queries of records, sequences and their windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandgraph.functions import residues as R
from strandgraph.operators import metrics, sequence, variants
from strandgraph.plans import inputs as I
from strandgraph.plans.inputs import table

QUERIES, SQL = {}, {}


def fasta_clean(spark, d):
    return I.sequences(spark, d).select("id", "seq", F.length("seq").alias("n_residues"))


QUERIES["q_fasta_clean"] = fasta_clean
SQL["q_fasta_clean"] = I.query(I.SEQ, final="SELECT id, seq, CAST(len(seq) AS INTEGER) AS n_residues FROM seqs")


def header_fields(spark, d):
    """The query strings of page addresses as key=value fields of a head."""
    pages = table(spark, d, "pages").select("page_id", F.concat_ws("\t", "url", F.regexp_replace(F.regexp_extract("url", r"\?([^#]*)", 1), "&", "\t")).alias("head"))
    fields = R.head_fields(F.col("head"))
    pairs = F.map_entries(R.key_values(F.slice(fields, F.lit(2), F.size(fields))))
    return pages.select("page_id", R.head_id(F.col("head")).alias("id"), F.size(fields).alias("n_fields"), F.array_join(F.array_sort(F.transform(pairs, lambda p: F.concat_ws("=", p["key"], p["value"]))), ",").alias("pairs"))


QUERIES["q_fasta_header_fields"] = header_fields
SQL["q_fasta_header_fields"] = r"""WITH h AS (SELECT page_id, url, string_split(url || chr(9) || replace(regexp_extract(url, '\?([^#]*)', 1), '&', chr(9)), chr(9)) AS f FROM pages),
    p AS (SELECT page_id, split_part(x, '=', 1) AS k, split_part(x, '=', 2) AS v, i FROM (SELECT page_id, unnest(f[2:]) AS x, unnest(range(0, len(f) - 1)) AS i FROM h) WHERE regexp_matches(x, '^[^=]+=[^=]+$')),
    l AS (SELECT page_id, k, arg_max(v, i) AS v FROM p GROUP BY 1, 2), a AS (SELECT page_id, string_agg(k || '=' || v, ',' ORDER BY k || '=' || v) AS pairs FROM l GROUP BY 1)
    SELECT page_id, regexp_extract(url, '^\s*(\S+)', 1) AS id, CAST(len(f) AS INTEGER) AS n_fields, coalesce(pairs, '') AS pairs FROM h LEFT JOIN a USING (page_id)"""


def record_grep(spark, d):
    return sequence.grep(I.sequences(spark, d), "seq LIKE '%THE%' AND length(seq) >= 300").select("id", F.length("seq").alias("n"))


QUERIES["q_record_grep"] = record_grep
SQL["q_record_grep"] = I.query(I.SEQ, final="SELECT id, CAST(len(seq) AS INTEGER) AS n FROM seqs WHERE seq LIKE '%THE%' AND len(seq) >= 300")


def record_sort(spark, d):
    """A top-k report: the twenty longest records."""
    return sequence.sort(I.sequences(spark, d).select("id", F.length("seq").alias("n")), "-n", "id").limit(20)


QUERIES["q_record_sort_topk"] = record_sort
SQL["q_record_sort_topk"] = I.query(I.SEQ, final="SELECT id, CAST(len(seq) AS INTEGER) AS n FROM seqs ORDER BY len(seq) DESC, id LIMIT 20")


def record_script(spark, d):
    rows = sequence.script(I.sequences(spark, d), {"half": "substring(seq, 1, length(seq) DIV k)", "n": "length(seq) DIV k"}, begin={"k": 2}, where="lang = 'en'")
    return rows.select("id", "half", "n")


QUERIES["q_record_script"] = record_script
SQL["q_record_script"] = I.query(I.SEQ, final="SELECT id, substr(seq, 1, len(seq) // 2) AS half, CAST(len(seq) // 2 AS BIGINT) AS n FROM seqs WHERE lang = 'en'")


def totals(spark, d):
    return sequence.totals(I.sequences(spark, d), {"records": "count(*)", "residues": "sum(length(seq))", "longest": "max(length(seq))"}, ["lang"])


QUERIES["q_begin_end_total_residues"] = totals
SQL["q_begin_end_total_residues"] = I.query(I.SEQ, final="SELECT lang, count(*) AS records, CAST(sum(len(seq)) AS BIGINT) AS residues, CAST(max(len(seq)) AS INTEGER) AS longest FROM seqs GROUP BY lang")

QUERIES["q_residue_histogram"] = lambda spark, d: sequence.residue_histogram(I.sequences(spark, d), ["lang"])
SQL["q_residue_histogram"] = I.query(I.SEQ, final="SELECT lang, residue, count(*) AS n FROM (SELECT lang, unnest(string_split(seq, '')) AS residue FROM seqs WHERE seq <> '') GROUP BY ALL")

QUERIES["q_line_wrap"] = lambda spark, d: I.sequences(spark, d).select("id", R.wrap(F.col("seq"), 60).alias("wrapped"))
SQL["q_line_wrap"] = I.query(I.SEQ, final=r"SELECT id, rtrim(regexp_replace(seq, '(.{60})', '\1' || chr(10), 'g'), chr(10)) AS wrapped FROM seqs")

QUERIES["q_peptide_windows"] = lambda spark, d: sequence.windows(I.sequences(spark, d)).select("id", "start", "end", "peptide_id", "seq")
SQL["q_peptide_windows"] = I.query(I.SEQ, I.windows_sql("seqs"), final='SELECT id, start, "end", peptide_id, seq FROM pep')


def window_counts(spark, d):
    rows = I.sequences(spark, d)
    return sequence.windows(rows).groupBy("id").agg(F.count("*").alias("n")).join(rows.select("id", "lang"), "id").groupBy("lang").agg(F.sum("n").alias("windows"), F.count("*").alias("records"))


QUERIES["q_window_count_by_lang"] = window_counts
SQL["q_window_count_by_lang"] = I.query(I.SEQ, final="SELECT lang, CAST(sum((len(seq) - 15) // 5 + 1) AS BIGINT) AS windows, count(*) AS records FROM seqs WHERE len(seq) >= 15 GROUP BY lang")


def _profile(f, name):
    def run(spark, d):
        counts = sequence.residue_histogram(I.sequences(spark, d), ["lang"])
        return counts.withColumn("label", f(F.col("residue"))).groupBy("lang", "label").agg(F.sum("n").alias("n"))

    return run


for _name, _f, _case in (("polarity", R.polarity, I.POL), ("charge", R.charge, I.CHA), ("hydrophobicity", R.hydrophobicity, I.HYD)):
    QUERIES[f"q_{_name}_profile"] = _profile(_f, _name)
    SQL[f"q_{_name}_profile"] = I.query(I.SEQ, final=f"SELECT lang, {_case.format('P')} AS label, count(*) AS n FROM (SELECT lang, unnest(string_split(seq, '')) AS aa FROM seqs WHERE seq <> '') GROUP BY ALL")


def list_filter(spark, d):
    """Black list of the documents labelled toxic, white list of those of good quality, by 1-based number."""
    from strandgraph.sources.readers import listed

    docs, labels = table(spark, d, "documents").select(F.col("doc_id").alias("instance_id"), "lang"), table(spark, d, "labels")
    ids = lambda c: labels.where(c).select((F.col("doc_id") + 1).alias("id"))
    white = listed(docs, white=ids("quality = 1")).withColumn("list", F.lit("white"))
    return white.unionByName(listed(docs, black=ids("toxic = 1")).withColumn("list", F.lit("black")))


QUERIES["q_white_black_list"] = list_filter
SQL["q_white_black_list"] = """SELECT doc_id AS instance_id, lang, 'white' AS list FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)
    UNION ALL SELECT doc_id, lang, 'black' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)"""


def first_match(spark, d):
    """Domain lookup: parts' types against a short table of names that are matched as patterns."""
    from strandgraph.operators.encode import with_domain

    parts = table(spark, d, "part").select(F.col("p_type").alias("peptide_id"), F.col("p_partkey").alias("seq"))
    domains = table(spark, d, "part").groupBy(F.concat_ws(" ", "p_type", "p_brand").alias("name")).agg(F.min("p_partkey").alias("ord"), F.min("p_name").alias("aligned_seq"))
    return with_domain(parts, domains).select(F.col("seq").alias("p_partkey"), "aligned")


QUERIES["q_regex_first_match_lookup"] = first_match
SQL["q_regex_first_match_lookup"] = """WITH dom AS (SELECT p_type || ' ' || p_brand AS name, min(p_partkey) AS ord, min(p_name) AS aligned FROM part GROUP BY 1),
    hit AS (SELECT t, arg_min(aligned, ord) AS aligned FROM (SELECT DISTINCT p_type AS t FROM part), dom WHERE regexp_matches(name, t) GROUP BY t)
    SELECT p_partkey, aligned FROM part LEFT JOIN hit ON t = p_type"""


def statistics(spark, d):
    return metrics.statistics(table(spark, d, "lineitem").withColumn("x", F.round("l_quantity")), "x", ["l_returnflag"]).select("l_returnflag", "num", "total", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"), "least", "most", "q5", "q25", "q50", "q75", "q95", "mad")


QUERIES["q_stats_summary"] = statistics
SQL["q_stats_summary"] = """WITH r AS (SELECT l_returnflag AS g, round(l_quantity) AS x FROM lineitem WHERE round(l_quantity) <> -1), s AS (SELECT g, list_sort(list(x)) AS v FROM r GROUP BY g),
    b AS (SELECT g, count(*) AS num, sum(x) AS total, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS sd, min(x) AS least, max(x) AS most FROM r GROUP BY g),
    q AS (SELECT g, v[CAST(floor(len(v) * 0.05) AS INT) + 1] AS q5, v[CAST(floor(len(v) * 0.25) AS INT) + 1] AS q25, v[CAST(floor(len(v) * 0.5) AS INT) + 1] AS q50, v[CAST(floor(len(v) * 0.75) AS INT) + 1] AS q75, v[CAST(floor(len(v) * 0.95) AS INT) + 1] AS q95 FROM s),
    m AS (SELECT g, list_sort(list(abs(x - q50))) AS v FROM r JOIN q USING (g) GROUP BY g)
    SELECT g AS l_returnflag, num, total, mean, sd, least, most, q5, q25, q50, q75, q95, v[CAST(floor(len(v) * 0.5) AS INT) + 1] AS mad FROM b JOIN q USING (g) JOIN m USING (g)"""


def alleles(spark, d):
    """Orders as sites and their lines as alleles: split, without the starred ones, merged again."""
    lines = table(spark, d, "lineitem").select("l_orderkey", F.struct("l_linenumber", F.when(F.col("l_returnflag") == "R", "*").otherwise(F.col("l_linestatus")).alias("alt"), F.round("l_quantity").cast("int").alias("c")).alias("a"))
    sites = lines.groupBy(F.col("l_orderkey").alias("pos")).agg(F.array_sort(F.collect_list("a")).alias("a")).select(F.lit("chr1").alias("chrom"), "pos", F.lit("N").alias("ref"), F.col("a.alt").alias("alts"), F.col("a.c").alias("ac"))
    merged = variants.merged_alleles(variants.without_stars(variants.split_alleles(sites)))
    return merged.select("pos", F.array_join("alts", "/").alias("alts"), F.array_join(F.transform("ac", lambda x: x.cast("string")), "/").alias("counts"))


QUERIES["q_multiallelic_split_merge"] = alleles
SQL["q_multiallelic_split_merge"] = """WITH a AS (SELECT l_orderkey AS pos, l_linenumber AS n, CASE WHEN l_returnflag = 'R' THEN '*' ELSE l_linestatus END AS alt, CAST(round(l_quantity) AS INTEGER) AS c FROM lineitem)
    SELECT pos, string_agg(alt, '/' ORDER BY n, alt, c) AS alts, string_agg(CAST(c AS VARCHAR), '/' ORDER BY n, alt, c) AS counts FROM a WHERE alt <> '*' GROUP BY pos"""
