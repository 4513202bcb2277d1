"""The jobs as queries: each runs twice into one new folder of spark.checkpoint.dir and gives what lies there then."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from jobs import screen, trainset
from jobs.common import config
from strandgraph.plans import inputs as I
from strandgraph.storage import shared_dir


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def screened(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents screened; the second run finds nothing new."""
    at = _folder(spark, "job1-screen")
    for _ in range(2):  # a file stream takes a folder or a pattern: this one matches the table, be it a folder or a file
        screen.run(spark, f"{sf_dir}/documents.parque[t]", f"{at}/out", f"{at}/checkpoint", SCREEN)
    return screen.read(spark, f"{at}/out")


def training_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Peptides of all labelled documents; the second run replaces the first one's files by the same."""
    at = _folder(spark, "job2-trainset")
    for _ in range(2):
        trainset.run(spark, f"{sf_dir}/documents.parquet", f"{sf_dir}/labels.parquet", at, TRAINSET)
    return trainset.read(spark, at)


SCREEN, TRAINSET = config(None, "screen.json"), config(None, "trainset.json")


def _profile_sql(p: dict) -> str:
    case = " ".join(f"WHEN '{c}' THEN {w}" for c, w in p["weights"].items())
    return f"SELECT id, start, \"end\", seq, '{p['name']}' AS profile, list_sum(list_transform(string_split(seq, ''), lambda c: CASE c {case} ELSE 0 END)) + {p['bias']} AS m, {p['positive']} AS least FROM pep"


def _screen_sql() -> str:
    scored = " UNION ALL ".join(_profile_sql(p) for p in SCREEN["profiles"])
    return I.query(
        I.SEQ, I.windows_sql("seqs"), f"sc AS ({scored})",
        final="SELECT sc.id, start, \"end\", sc.seq, m / 1e3 AS margin, profile, CAST(0 AS BIGINT) AS batch, coalesce(nullif(lang, ''), 'none') AS part FROM sc JOIN seqs USING (id) WHERE m >= least",
    )


def _trainset_sql() -> str:
    t = TRAINSET
    key = f"((instance_id % 1000003) * {7919 + 2 * t['seed']} + 104729) % 1000003"
    return I.query(
        I.SEQ, I.windows_sql("seqs"),
        "vote AS (SELECT doc_id AS id, 2 * max(quality) - 1 AS vote FROM labels WHERE quality IN (0, 1) GROUP BY 1)",
        f"found AS (SELECT seq, count(*) FILTER (vote > 0) AS positives, count(*) FILTER (vote < 0) AS negatives FROM pep JOIN vote USING (id) GROUP BY 1 HAVING len(list_distinct(string_split(seq, ''))) >= {t['least_distinct_residues']})",
        f"sure AS (SELECT *, CASE WHEN 100 * positives >= {t['agreement_percent']} * (positives + negatives) THEN 1 WHEN 100 * negatives >= {t['agreement_percent']} * (positives + negatives) THEN -1 END AS y FROM found)",
        "num AS (SELECT *, row_number() OVER (ORDER BY seq) - 1 AS instance_id FROM sure WHERE y IS NOT NULL)",
        f"place AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY {key}, instance_id) AS i FROM num)",
        "size AS (SELECT count(*) FILTER (y > 0) AS p, count(*) FILTER (y < 0) AS m FROM num)",
        "o AS (SELECT place.*, CASE WHEN y > 0 THEN p ELSE m END AS own, CASE WHEN y > 0 THEN m ELSE p END AS other FROM place, size)",
        "val AS (SELECT instance_id, string_agg(r || ':' || n, ' ' ORDER BY r) AS value FROM (SELECT instance_id, ascii(r) AS r, count(*) AS n FROM (SELECT instance_id, unnest(string_split(seq, '')) AS r FROM num) GROUP BY ALL) GROUP BY 1)",
        final=f"SELECT instance_id, seq, positives, negatives, CASE WHEN own < other THEN other // own + CASE WHEN i - 1 < other % own THEN 1 ELSE 0 END ELSE 1 END AS copies, value, CAST(i % {t['folds']} AS INTEGER) AS fold, CAST(y AS INTEGER) AS y FROM o JOIN val USING (instance_id)",
    )


def queries() -> dict:
    return {"job1_screen": screened, "job2_trainset": training_set}


def oracle_sql() -> dict[str, str]:
    return {"job1_screen": _screen_sql(), "job2_trainset": _trainset_sql()}
