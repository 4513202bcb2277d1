"""Streams: FASTA files as they arrive, cut into peptides and scored, by the same stateless operators as batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandgraph.operators import encode, features, model, sequence
from strandgraph.sources import readers


def fasta_stream(spark: SparkSession, folder: str, valid: str = "-a-zA-Z") -> DataFrame:
    """Records (head, head_fields, id, comment, seq) of files that come into the folder."""
    return readers.parsed_fasta(spark.readStream.option("lineSep", "\n>").text(folder), valid)


def peptide_stream(records: DataFrame, length: int = 15, step: int = 5) -> DataFrame:
    """Windows of a stream of records; no state, so no watermark."""
    return sequence.windows(records.withColumn("seq", F.upper("seq")), length, step)


def scoring_sink(weights: DataFrame, models: DataFrame, path: str, radius: int = 0, distance: int = 1, bits: int = 14):
    """A function for foreachBatch that scores a batch of peptides and writes (instance_id, model, prediction, margin).

    Each batch goes to its own folder, which a repeated batch overwrites: every batch counts once.
    """

    def sink(batch: DataFrame, number: int) -> None:
        distinct = batch.select("seq").distinct().select(F.col("seq").alias("peptide_id"), "seq")
        v, e = encode.directed(encode.vertices(distinct), encode.edges(distinct))
        scored = model.predict(model.margins(features.graph_vectors(v, e, radius, distance, bits), weights, models))
        out = batch.select("peptide_id", "seq").join(scored, F.col("seq") == F.col("instance_id")).select("peptide_id", "model", "prediction", "margin")
        out.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return sink
