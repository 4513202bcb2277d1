"""What the jobs share: logging, configuration, the session of the command line."""

from __future__ import annotations

import json
import logging
import sys
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import SparkSession

log = logging.getLogger("jobs")


def config(path: str | None, default: str) -> dict:
    """The settings of a JSON file; default names the one beside the jobs."""
    with open(path or Path(__file__).with_name(default), encoding="utf-8") as f:
        return json.load(f)


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A session's setting within, restored at the end."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


@contextmanager
def session(name: str) -> Iterator[SparkSession]:
    """A session for the command line, stopped at the end; its settings come from spark-submit."""
    logging.basicConfig(stream=sys.stderr, level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName(name).getOrCreate()
    try:
        yield spark
    finally:
        spark.stop()
