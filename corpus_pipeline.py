"""The corpus pipeline: documents filtered, made unique, cleared of secrets and packed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandgraph.llm import common, jaccard, langid, packing, quality, secrets_crf

#: (name, function of (spark, docs, sf_dir)), in order. All but the last return the columns of documents.
STAGES = [
    ("quality rules", quality.stage),
    ("language ID", langid.stage),
    ("n-gram Jaccard join", jaccard.stage),
    ("secret scans", secrets_crf.stage),
    ("packing", packing.stage),
]
#: SQL can express neither the learned stages nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; what each stage returns is written as Parquet and read again by the next."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.materialize(stage(spark, docs, sf_dir), name.lower().replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
