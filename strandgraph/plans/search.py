"""Queries of kernels, neighbours, densities, clusters and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandgraph.operators import similarity as S
from strandgraph.plans import inputs as I
from strandgraph.plans.inputs import table
from strandgraph.storage import materialize

QUERIES, SQL = {}, {}


def _lines(spark, d):
    """(instance_id, fid) of every line, repeated parts too: operators that take sets don't need them apart."""
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("instance_id"), F.col("l_partkey").alias("fid"))


ITEMS = "item AS (SELECT DISTINCT l_orderkey AS instance_id, l_partkey AS fid FROM lineitem)"
SHARED = "shared AS (SELECT a.instance_id AS u, b.instance_id AS v, count(*) AS shared FROM item a JOIN item b USING (fid) GROUP BY 1, 2 HAVING count(*) >= 2)"


def kernel(spark, d):
    """All pairs of peptides' graphs that share a feature, over whole vectors."""
    return S.kernel(I.vectors(spark, d)).select("u", "v", F.round("k", 6).alias("k"))


QUERIES["q_kernel_matrix"] = kernel
SQL["q_kernel_matrix"] = I.query(*I.FEATURES, final="SELECT a.instance_id AS u, b.instance_id AS v, round(sum(a.val * b.val), 6) AS k FROM vec a JOIN vec b USING (fid) WHERE a.instance_id <= b.instance_id GROUP BY 1, 2")

#: Kernels from here on are alike.
ALIKE = 0.95
QUERIES["q_kernel_above"] = lambda spark, d: S.kernel_above(I.vectors(spark, d), ALIKE)
SQL["q_kernel_above"] = I.query(*I.FEATURES, final=f"SELECT a.instance_id AS u, b.instance_id AS v, round(sum(a.val * b.val), 6) AS k FROM vec a JOIN vec b USING (fid) WHERE a.instance_id <= b.instance_id GROUP BY 1, 2 HAVING round(sum(a.val * b.val), 6) >= {ALIKE}")

EMB = "emb AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings), prod AS (SELECT a.vec_id AS u, b.vec_id AS v, round(list_dot_product(a.v, b.v), 6) AS k FROM emb a, emb b)"
KNN = "knn AS (SELECT *, CAST(row_number() OVER (PARTITION BY u ORDER BY k DESC, v) AS INTEGER) AS rank FROM prod QUALIFY rank <= 10)"


def _knn(spark, d):
    e = table(spark, d, "embeddings")
    return S.dense_neighbours(e, e, 10)


QUERIES["q_true_knn"] = lambda spark, d: _knn(spark, d)
SQL["q_true_knn"] = I.query(EMB, KNN, final="SELECT u, v, k, rank FROM knn")
QUERIES["q_knn_vote"] = lambda spark, d: S.vote(_knn(spark, d), table(spark, d, "embeddings").select(F.col("vec_id").alias("instance_id"), "label"))
SQL["q_knn_vote"] = I.query(EMB, KNN, "c AS (SELECT u, label, count(*) AS n FROM knn JOIN emb ON vec_id = knn.v GROUP BY 1, 2)", final="SELECT u, label AS prediction FROM c QUALIFY row_number() OVER (PARTITION BY u ORDER BY n DESC, label) = 1")
QUERIES["q_inverted_index_candidates"] = lambda spark, d: S.trimmed(S.shared_features(_lines(spark, d)), 10).select("u", "v", "shared")
SQL["q_inverted_index_candidates"] = I.query(ITEMS, SHARED, final="SELECT u, v, shared FROM shared QUALIFY row_number() OVER (PARTITION BY u ORDER BY shared DESC, v) <= 30")
MIN = "sig AS (SELECT instance_id, CAST(k AS INTEGER) AS k, min(((fid % 2147483647) * (96542 * k + 16807) + (69621 * k + 12345)) % 2147483647) AS minhash FROM {}, (SELECT unnest(range(0, 30)) AS k) GROUP BY 1, 2)"
BINS = "bins AS (SELECT a.instance_id AS u, b.instance_id AS v, count(*) AS shared FROM sig a JOIN sig b USING (k, minhash) GROUP BY 1, 2 HAVING count(*) >= 2)"
QUERIES["q_minhash_signature"] = lambda spark, d: S.signatures(_lines(spark, d), 30)
SQL["q_minhash_signature"] = I.query(ITEMS, MIN.format("item"), final="SELECT instance_id, k, minhash FROM sig")
QUERIES["q_minhash_compact"] = lambda spark, d: S.signatures(_lines(spark, d), 30, 3)
SQL["q_minhash_compact"] = I.query(ITEMS, MIN.format("item"), final="SELECT instance_id, CAST(k // 3 AS INTEGER) AS k, CAST(sum(minhash) AS BIGINT) AS minhash FROM sig GROUP BY ALL")
QUERIES["q_bin_sizes"] = lambda spark, d: S.bin_sizes(S.signatures(_lines(spark, d), 30))
SQL["q_bin_sizes"] = I.query(ITEMS, MIN.format("item"), final="SELECT k, minhash, count(*) AS n FROM sig GROUP BY ALL")
QUERIES["q_lsh_candidates"] = lambda spark, d: S.shared_bins(S.signatures(I.vectors(spark, d), 30))
SQL["q_lsh_candidates"] = I.query(*I.FEATURES, MIN.format("vec"), BINS, final="SELECT u, v, shared FROM bins")


def approximate(spark, d):
    return S.approximate_neighbours(I.vectors(spark, d), 5, 30, 3)


QUERIES["q_approx_knn"] = approximate
SQL["q_approx_knn"] = I.query(
    *I.FEATURES, MIN.format("vec"), BINS,
    "cand AS (SELECT u, v FROM bins QUALIFY row_number() OVER (PARTITION BY u ORDER BY shared DESC, v) <= 15)",
    "kk AS (SELECT u, v, round(sum(a.val * b.val), 6) AS k FROM cand JOIN vec a ON a.instance_id = u JOIN vec b ON b.instance_id = v AND b.fid = a.fid GROUP BY 1, 2)",
    final="SELECT u, v, k, CAST(row_number() OVER (PARTITION BY u ORDER BY k DESC, v) AS INTEGER) AS rank FROM kk QUALIFY rank <= 5",
)
QUERIES["q_true_density"] = lambda spark, d: S.dense_density(table(spark, d, "embeddings")).select("vec_id", F.round("density", 6).alias("density"))
SQL["q_true_density"] = I.query(EMB.replace("round(list_dot_product(a.v, b.v), 6)", "list_dot_product(a.v, b.v)"), final="SELECT u AS vec_id, round(avg(k) FILTER (u <> v), 6) AS density FROM prod GROUP BY 1")
QUERIES["q_neighbourhood_density"] = lambda spark, d: S.neighbourhood_density(_knn(spark, d)).select("u", F.round("density", 6).alias("density"))
SQL["q_neighbourhood_density"] = I.query(EMB, KNN, final="SELECT u, round(sum(k) FILTER (u <> v) / nullif(count(*) - 1, 0), 6) AS density FROM knn GROUP BY 1")


def set_density(spark, d):
    e = table(spark, d, "embeddings")
    near = materialize(S.dense_neighbours(e, e, 5), "near")
    met = S.members(near).select(F.col("a").alias("u"), F.col("b").alias("v"))
    return S.set_density(near, S.dense_kernels(met, e)).select("u", F.round("density", 8).alias("density"))


QUERIES["q_set_density"] = set_density
SQL["q_set_density"] = I.query(
    EMB, KNN.replace("rank <= 10", "rank <= 5"),
    final="SELECT a.u, round(avg(p.k), 8) AS density FROM knn a JOIN knn b ON a.u = b.u AND a.v <> b.v JOIN prod p ON p.u = a.v AND p.v = b.v GROUP BY 1",
)


def _centres(spark, d):
    near = materialize(_knn(spark, d), "near")
    density = S.neighbourhood_density(near)
    return near, density, S.density_centres(near, density, 10, 0)


def clusters(spark, d):
    near, _, centres = _centres(spark, d)
    return S.clusters(centres, near)


def cluster_statistics(spark, d):
    _, density, centres = _centres(spark, d)
    found = S.cluster_statistics(centres, density)
    return found.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in found.dtypes])


QUERIES["q_density_clusters"] = clusters
#: Ten centres, one after another: the next in order of density whose neighbourhood meets none of those taken.
CENTRES = (
    "dens AS (SELECT u, list(v) AS near, round(sum(k) FILTER (u <> v) / nullif(count(*) - 1, 0), 6) AS density FROM knn GROUP BY 1)",
    "ord AS (SELECT *, row_number() OVER (ORDER BY density DESC, u) AS place FROM dens)",
    "pick AS (SELECT 0 AS i, CAST(0 AS BIGINT) AS u, CAST(0 AS BIGINT) AS place, CAST([] AS BIGINT[]) AS seen UNION ALL SELECT i + 1, x.u, x.place, list_concat(seen, x.near) FROM pick, LATERAL (SELECT min({'place': place, 'u': o.u, 'near': near}) AS x FROM ord o WHERE o.place > pick.place AND NOT list_has_any(o.near, pick.seen)) WHERE i < 10 AND x IS NOT NULL)",
)
SQL["q_density_clusters"] = I.query(EMB, KNN, *CENTRES, final="SELECT pick.u AS centre, CAST(i AS INTEGER) AS rank, v AS member, k FROM pick JOIN knn ON knn.u = pick.u WHERE i > 0")
QUERIES["q_cluster_statistics"] = cluster_statistics
_stats = "SELECT of, density AS x FROM (SELECT 'all' AS of, sum(k) FILTER (u <> v) / (count(*) - 1) AS density FROM knn GROUP BY u UNION ALL SELECT 'centres', sum(k) FILTER (knn.u <> v) / (count(*) - 1) FROM knn JOIN pick ON pick.u = knn.u AND i > 0 GROUP BY knn.u)"


def statistics_sql(source: str, by: str) -> tuple[str, ...]:
    """stat: the descriptive statistics of x in source (by, x)."""
    at = lambda q, t: f"min(x) FILTER (i = CAST(floor(n * {q}) AS BIGINT)) AS {t}"
    return (
        f"val AS ({source})",
        f"place AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY x) - 1 AS i, count(*) OVER (PARTITION BY {by}) AS n FROM val)",
        f"base AS (SELECT {by}, count(*) AS num, sum(x) AS total, avg(x) AS mean, stddev_samp(x) AS sd, min(x) AS least, max(x) AS most, {', '.join(at(q, f'q{round(100 * q)}') for q in (0.05, 0.25, 0.5, 0.75, 0.95))} FROM place GROUP BY 1)",
        f"apart AS (SELECT {by}, abs(x - q50) AS x FROM val JOIN base USING ({by}))",
        f"far AS (SELECT {by}, {at(0.5, 'mad')} FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY x) - 1 AS i, count(*) OVER (PARTITION BY {by}) AS n FROM apart) GROUP BY 1)",
    )


_rounded = "num, round(total, 6) AS total, round(mean, 6) AS mean, round(sd, 6) AS sd, round(least, 6) AS least, round(most, 6) AS most, round(q5, 6) AS q5, round(q25, 6) AS q25, round(q50, 6) AS q50, round(q75, 6) AS q75, round(q95, 6) AS q95, round(mad, 6) AS mad"
SQL["q_cluster_statistics"] = I.query(EMB, KNN, *CENTRES, *statistics_sql(_stats, "of"), final=f"SELECT of, {_rounded} FROM base JOIN far USING (of)")


def bin_statistics(spark, d):
    found = S.bin_statistics(S.signatures(_lines(spark, d), 30))
    return found.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in found.dtypes])


QUERIES["q_bin_statistics"] = bin_statistics
SQL["q_bin_statistics"] = I.query(ITEMS, MIN.format("item"), *statistics_sql("SELECT 0 AS z, CAST(count(*) OVER (PARTITION BY k, minhash) AS DOUBLE) AS x FROM sig", "z"), final=f"SELECT {_rounded} FROM base JOIN far USING (z)")


def approximate_vote(spark, d):
    """Peptides' classes (the first residue) voted by their approximate neighbours."""
    labels = I.peptides(spark, d).select(F.col("peptide_id").alias("instance_id"), F.substring("seq", 1, 1).alias("label"))
    return S.vote(approximate(spark, d), labels)


QUERIES["q_approx_knn_vote"] = approximate_vote
SQL["q_approx_knn_vote"] = I.query(
    *I.FEATURES, MIN.format("vec"), BINS,
    "cand AS (SELECT u, v FROM bins QUALIFY row_number() OVER (PARTITION BY u ORDER BY shared DESC, v) <= 15)",
    "kk AS (SELECT u, v, round(sum(a.val * b.val), 6) AS k FROM cand JOIN vec a ON a.instance_id = u JOIN vec b ON b.instance_id = v AND b.fid = a.fid GROUP BY 1, 2)",
    "nn AS (SELECT u, v FROM kk QUALIFY row_number() OVER (PARTITION BY u ORDER BY k DESC, v) <= 5)",
    "c AS (SELECT u, substr(seq, 1, 1) AS label, count(*) AS n FROM nn JOIN pep ON peptide_id = v GROUP BY 1, 2)",
    final="SELECT u, label AS prediction FROM c QUALIFY row_number() OVER (PARTITION BY u ORDER BY n DESC, label) = 1",
)
QUERIES["q_similarity_to_set"] = lambda spark, d: S.similarity_to_set(table(spark, d, "embeddings"), table(spark, d, "embeddings").where("label = 0")).select("vec_id", F.round("similarity", 6).alias("similarity"))
SQL["q_similarity_to_set"] = I.query(EMB.replace("round(list_dot_product(a.v, b.v), 6)", "list_dot_product(a.v, b.v)"), final="SELECT u AS vec_id, round(avg(k), 6) AS similarity FROM prod JOIN emb ON vec_id = prod.v WHERE label = 0 GROUP BY 1")


def greedy(spark, d):
    near = _knn(spark, d)
    return S.greedy_centres(S.neighbourhood_density(near), table(spark, d, "embeddings"))


# The swaps' random choices have no SQL; a test holds them against a plain loop.
QUERIES["q_greedy_centres"] = greedy
QUERIES["q_sampled_centres"] = lambda spark, d: S.sampled_centres(S.neighbourhood_density(_knn(spark, d)))
SQL["q_sampled_centres"] = I.query(
    EMB, KNN, "de AS (SELECT u, sum(k) FILTER (u <> v) / nullif(count(*) - 1, 0) AS density FROM knn GROUP BY 1)",
    "wo AS (SELECT u, density FROM de WHERE density > 0 ORDER BY ln((((u % 1000003) * 7921 + 104729) % 1000003 + 1) / 1000004e0) / density DESC, u LIMIT 40)",
    "pl AS (SELECT u, row_number() OVER (ORDER BY density DESC, u) - 1 AS i FROM wo)",
    final="SELECT u AS centre, CAST(i // 4 + 1 AS INTEGER) AS rank FROM pl WHERE i % 4 = 0",
)
QUERIES["q_data_filter"] = lambda spark, d: S.filtered(I.letters(spark, d).where("val > 0"))
SQL["q_data_filter"] = I.query(
    I.SEQ, I.LETTERS, "ls AS (SELECT * FROM letters WHERE val > 0)", MIN.format("ls").replace("range(0, 30)", "range(0, 200)"), BINS,
    "nn AS (SELECT u, v FROM bins QUALIFY row_number() OVER (PARTITION BY u ORDER BY shared DESC, v) <= 10)",
    "pr AS (SELECT DISTINCT a.v AS a, b.v AS b FROM nn a JOIN nn b USING (u) WHERE a.v <> b.v), kk AS (SELECT a, b, sum(x.val * y.val) AS k FROM pr JOIN ls x ON x.instance_id = a JOIN ls y ON y.instance_id = b AND y.fid = x.fid GROUP BY 1, 2)",
    "de AS (SELECT a.u, round(sum(coalesce(k, 0)) / count(*), 6) AS density FROM nn a JOIN nn b USING (u) LEFT JOIN kk ON kk.a = a.v AND kk.b = b.v WHERE a.v <> b.v GROUP BY 1)",
    "po AS (SELECT u, row_number() OVER (ORDER BY density DESC, u) AS place, count(*) OVER () AS n FROM de), half AS (SELECT po.u, place, list(v) AS near FROM po JOIN nn USING (u) WHERE place <= floor(n * 0.5) GROUP BY 1, 2)",
    "pick AS (SELECT 0 AS i, CAST(0 AS BIGINT) AS u, CAST(0 AS BIGINT) AS place, CAST([] AS BIGINT[]) AS seen UNION ALL SELECT i + 1, x.u, x.place, list_concat(seen, x.near) FROM pick, LATERAL (SELECT min({'place': place, 'u': o.u, 'near': near}) AS x FROM half o WHERE o.place > pick.place AND len(list_intersect(o.near, pick.seen)) <= 1) WHERE i < 1000 AND x IS NOT NULL)",
    final="SELECT u AS instance_id FROM pick WHERE i > 0",
)
#: The order in which centres of splits are drawn.
DRAWN = "(vec_id * 7919 + 104729) % 10007"


def _split(spark, d):
    """All vectors are the training set, the first three labels against the rest the classes, and those of odd ids the test set."""
    e = table(spark, d, "embeddings").withColumn("y", F.when(F.col("label") < 3, 1).otherwise(-1))
    tests = e.where("vec_id % 2 = 1")
    return e, tests, S.dataset_splits(e, tests, [DRAWN])


QUERIES["q_balanced_split"] = lambda spark, d: _split(spark, d)[-1]
SPLIT = (
    "cen AS (SELECT vec_id AS u FROM emb WHERE vec_id % 2 = 1)",
    "cs AS (SELECT p.u, p.k, row_number() OVER w AS size, CAST(sum(CASE WHEN label < 3 THEN 1 ELSE 0 END) OVER w AS BIGINT) AS positives, CAST(sum(CASE WHEN label < 3 THEN 0 ELSE 1 END) OVER w AS BIGINT) AS negatives FROM prod p JOIN cen USING (u) JOIN emb ON vec_id = p.v WINDOW w AS (PARTITION BY p.u ORDER BY p.k DESC, p.v ROWS UNBOUNDED PRECEDING))",
    "ru AS (SELECT u, size, k AS bound, positives, negatives FROM cs WHERE positives < 1.5 * negatives AND positives * 1.5 > negatives QUALIFY row_number() OVER (PARTITION BY u ORDER BY size DESC) = 1)",
    "te AS (SELECT p.u, count(*) AS tests FROM prod p JOIN ru USING (u) WHERE p.v % 2 = 1 AND p.k >= bound GROUP BY 1)",
    f"sp AS (SELECT u AS centre, CAST(row_number() OVER (ORDER BY {DRAWN.replace('vec_id', 'u')}, u) AS INTEGER) AS rank, size, bound, positives, negatives, tests FROM ru JOIN te USING (u) WHERE size > 30 AND tests > 30 QUALIFY rank <= 10)",
)
SQL["q_balanced_split"] = I.query(EMB, *SPLIT, final="SELECT centre, rank, size, bound, positives, negatives, tests FROM sp")


def split_ids(spark, d):
    e, tests, found = _split(spark, d)
    return S.split_ids(materialize(found, "splits"), e, tests)


QUERIES["q_split_ids"] = split_ids
SQL["q_split_ids"] = I.query(
    EMB, *SPLIT,
    final="SELECT centre, 'train' AS part, v AS id FROM sp JOIN prod ON u = centre WHERE k >= bound UNION ALL SELECT centre, 'test', v FROM sp JOIN prod ON u = centre WHERE v % 2 = 1 AND k >= bound",
)
