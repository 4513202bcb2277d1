"""Every query with SQL gives the rows that DuckDB gives, over the smallest driver tables."""

from __future__ import annotations

import os
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from strandgraph.plans import catalogue

TABLES = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))
#: These run over the graphs of a few items, made from the driver's table; all others over whole tables.
FEW = {"q_kernel_matrix", "q_lsh_candidates", "q_approx_knn", "q_min_kernel", "q_vertex_margin", "q_extreme_vertices", "q_cascade_predict", "q_score_pivot", "q_bounded_distances", "q_shortest_path_union"}
FEW |= {"q_alias_features", "q_gapped_features", "q_viewpoint_features", "q_features_unnormalised", "q_feature_collisions", "q_approx_knn_vote"}
FEW |= {"q_kernel_above", "q_composite_features", "q_features_r3_d5", "q_path_features", "q_soft_path_features", "q_approximate_soft_features", "q_radius2_codes", "q_approximate_codes"}

pytestmark = pytest.mark.skipif(not TABLES.is_dir(), reason="no driver tables")


def _connect(folder):
    con = duckdb.connect()
    for f in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


@pytest.fixture(scope="module")
def whole():
    return str(TABLES), _connect(TABLES)


@pytest.fixture(scope="module")
def few(tmp_path_factory):
    folder = tmp_path_factory.mktemp("few")
    for f in TABLES.glob("*.parquet"):
        if f.stem != "benchmark":
            (folder / f.name).symlink_to(f)
    duckdb.sql(f"COPY (SELECT * FROM '{TABLES}/benchmark.parquet' ORDER BY item_id LIMIT 2) TO '{folder}/benchmark.parquet'")
    return str(folder), _connect(folder)


def _rows(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted(tuple("" if pd.isna(v) else f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in frame.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_sql(spark, whole, few, name):
    folder, duck = few if name in FEW else whole
    got, want = catalogue.queries()[name](spark, folder).toPandas(), duck.sql(catalogue.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert _rows(got) == _rows(want)


def test_entry_runs(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["instance_id", "model", "margin", "prediction"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
