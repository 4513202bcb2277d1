"""Screens new sequence records for peptides that fit linear residue profiles.

    spark-submit --py-files ... jobs/screen.py --input IN --output OUT --checkpoint CP [--config FILE]

A file stream with a checkpoint: a run takes the files that came since the last one and ends (availableNow). Records become
sequences (letters, upper case) and windows; every window is scored by every profile within its own row, so that no window
is shuffled, and what a profile decides positive goes to OUT/hits, partitioned by batch and group. OUT/totals has windows,
hits and undecided ones by group and profile. A batch overwrites its own two folders: one that is repeated after a failure
counts once, and a run without new files changes nothing.
"""

from __future__ import annotations

import argparse

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import config, log, session
from strandgraph.operators import model, sequence

HITS = "id long, start int, end int, seq string, margin double, profile string, batch long, part string"
TOTALS = "profile string, windows long, hits long, undecided long, batch long, part string"


def scored(records: DataFrame, settings: dict) -> DataFrame:
    """(id, part, start, end, seq, profile, margin, decision) of every window and profile.

    records has id, text and part. Weights are whole thousandths, so margins are exact in any order of adding; residues
    without a weight count 0. Records with a null text or one shorter than a window have none.
    """
    seqs = sequence.cleaned(records.select("id", "part", "text"))
    windows = sequence.windows(seqs, settings["length"], settings["step"], keep=["part"])
    # Residues with a weight are counted once for all profiles, by expressions that code generation compiles.
    letters = sorted({c for p in settings["profiles"] for c in p["weights"] if len(c) == 1})
    rows = windows.select("id", "part", "start", "end", "seq", *[(F.length("seq") - F.length(F.replace(F.col("seq"), F.lit(c), F.lit("")))).alias(f"_n_{c}") for c in letters])
    marks = []
    for p in settings["profiles"]:
        total = F.lit(int(p["bias"]))
        for c, w in sorted(p["weights"].items()):
            total = total + F.lit(int(w)) * F.col(f"`_n_{c}`") if c in letters else total
        marks.append(F.struct(F.lit(p["name"]).alias("profile"), (total / 1000).alias("margin"), F.lit(p["positive"] / 1000).alias("p"), F.lit(p["negative"] / 1000).alias("n")))
    rows = rows.select("id", "part", "start", "end", "seq", F.explode(F.array(*marks)).alias("m")).select("*", "m.*")
    return rows.select("id", "part", "start", "end", "seq", "profile", "margin", model.decision(F.col("margin"), F.col("p"), F.col("n")).alias("decision"))


def screen_batch(batch: DataFrame, number: int, output: str, settings: dict) -> None:
    """Writes one batch's hits and totals to folders of their own, over what an earlier try has left there."""
    names = settings["columns"]
    group = F.coalesce(F.nullif(F.col(names["group"]).cast("string"), F.lit("")), F.lit("none"))
    records = batch.select(F.col(names["id"]).cast("long").alias("id"), F.col(names["text"]).alias("text"), group.alias("part"))
    rows = scored(records, settings)
    hits, totals = f"{output}/hits/batch={number}", f"{output}/totals/batch={number}"
    rows.where("decision = 1").drop("decision").write.mode("overwrite").partitionBy("part").parquet(hits)
    counted = rows.groupBy("part", "profile").agg(F.count("*").alias("windows"), F.count_if(F.col("decision") == 1).alias("hits"), F.count_if(F.col("decision") == 0).alias("undecided"))
    counted.write.mode("overwrite").partitionBy("part").parquet(totals)
    wrote = read(batch.sparkSession, output, "totals").where(F.col("batch") == number).agg(F.sum("windows"), F.sum("hits")).first()
    log.info("screen: batch %d read %d records, made %d scores of windows, wrote %d hits to %s", number, records.count(), wrote[0] or 0, wrote[1] or 0, hits)


def read(spark: SparkSession, output: str, name: str = "hits") -> DataFrame:
    """What all runs have written to OUT/hits or OUT/totals; no rows before the first batch."""
    schema = {"hits": HITS, "totals": TOTALS}[name]
    try:
        return spark.read.schema(schema).parquet(f"{output}/{name}")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def run(spark: SparkSession, source: str, output: str, checkpoint: str, settings: dict) -> int:
    """Takes what is new in the folder (or glob) source; the number of batches it made."""
    kind = {"id": "long", "text": "string", "group": "string"}
    schema = ", ".join(f"`{name}` {kind[key]}" for key, name in settings["columns"].items())
    stream = spark.readStream.schema(schema).format(settings["format"]).option("maxFilesPerTrigger", settings["files_per_batch"]).load(source)
    made: list[int] = []

    def take(batch: DataFrame, number: int) -> None:
        screen_batch(batch, number, output, settings)
        made.append(number)

    write = stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
    write.trigger(availableNow=True).start().awaitTermination()
    log.info("screen: %d batches of new records from %s", len(made), source)
    return len(made)


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="screen", description="Screens new sequence records for peptides that fit residue profiles.")
    for name, text in (("input", "folder or glob of the records' files"), ("output", "folder of hits and totals"), ("checkpoint", "folder of the stream's checkpoint")):
        parser.add_argument(f"--{name}", required=True, help=text)
    parser.add_argument("--config", help="JSON file of settings (default: jobs/screen.json)")
    args = parser.parse_args(arguments)
    with session("screen") as spark:
        run(spark, args.input, args.output, args.checkpoint, config(args.config, "screen.json"))


if __name__ == "__main__":
    main()
