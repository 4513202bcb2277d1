"""All named queries with their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strandgraph.plans import files, graphs, learning, records, search

Query = Callable[[SparkSession, str], DataFrame]
MODULES = (records, graphs, learning, search, files)


def queries() -> dict[str, Query]:
    """Every query of the library proper, by name."""
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL by query name; queries that SQL cannot express have none."""
    return {name: s for m in MODULES for name, s in m.SQL.items()}
