"""The jobs: two runs over growing input, repeated batches, results against plain Python and against SQL."""

from __future__ import annotations

import os
import random
import re
from contextlib import contextmanager
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from jobs import registry, screen, trainset
from jobs.common import config
from strandgraph import storage

TABLES = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))
DOCS = "doc_id long, text string, lang string, source string"


def _texts(n, seed):
    r = random.Random(seed)
    return ["".join(r.choice("PRKLDEGVIFMACHpr 12é\n") for _ in range(r.randint(0, 150))) for _ in range(n)]


def _hits(rows, settings):
    out = set()
    for i, text, lang in rows:
        seq = re.sub("[^a-zA-Z]", "", text or "").upper()
        for at in range(0, len(seq) - 14, 5):
            for p in settings["profiles"]:
                m = p["bias"] + sum(p["weights"].get(c, 0) for c in seq[at : at + 15])
                if m >= p["positive"]:
                    out.add((i, at + 1, at + 15, seq[at : at + 15], m / 1000, p["name"], lang or "none"))
    return out


def _all(rows):
    return {(r.id, r.start, r.end, r.seq, r.margin, r.profile, r.part) for r in rows.collect()}


@pytest.fixture()
def mild():
    """Profiles that many random windows fit."""
    settings = config(None, "screen.json")
    return settings | {"profiles": [p | {"bias": p["bias"] // 3} for p in settings["profiles"]]}


def test_screen_takes_only_what_is_new(spark, tmp_path, mild):
    source, out, checkpoint = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/checkpoint"
    first = [(i, t, [None, "", "en", "1"][i % 4]) for i, t in enumerate([None, "", "short", *_texts(40, 1)])]
    more = [(100 + i, t, "de") for i, t in enumerate(_texts(30, 2))]
    add = lambda rows: spark.createDataFrame([(*r, "x") for r in rows], DOCS).coalesce(1).write.mode("append").parquet(source)
    assert screen.read(spark, out).count() == 0
    add(first)
    assert screen.run(spark, source, out, checkpoint, mild) == 1
    assert _all(screen.read(spark, out)) == _hits(first, mild) != set()
    before = {f: f.stat().st_mtime_ns for f in (tmp_path / "out").rglob("*.parquet")}
    assert screen.run(spark, source, out, checkpoint, mild) == 0
    add(more)
    assert screen.run(spark, source, out, checkpoint, mild) == 1
    got = screen.read(spark, out)
    assert _all(got) == _hits(first + more, mild) and got.count() == len(_all(got))
    assert {r.id >= 100 for r in got.where("batch = 1").collect()} == {True}
    assert all(f.stat().st_mtime_ns == t for f, t in before.items())
    totals = {(r.part, r.profile): (r.windows, r.hits) for r in screen.read(spark, out, "totals").where("part = 'de'").collect()}
    assert totals[("de", "basic")][1] == got.where("part = 'de' AND profile = 'basic'").count()
    assert screen.run(spark, source, out, checkpoint, mild) == 0 and _all(screen.read(spark, out)) == _hits(first + more, mild)


def test_screen_scores_by_compiled_expressions(spark, mild):
    """No fold over the residues of each window and profile, and whatever isn't one residue has no weight."""
    p = mild["profiles"][0] | {"weights": mild["profiles"][0]["weights"] | {"PR": 9, "": 9}}
    records = spark.createDataFrame([(1, "en", "PRKPRKPRKPRKPRK")], "id long, part string, text string")
    got = screen.scored(records, mild | {"profiles": [p]})
    assert "aggregate(" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert [r.margin for r in got.collect()] == [(p["bias"] + 5 * (1000 + 350 + 300)) / 1000]


def test_a_repeated_batch_counts_once(spark, tmp_path, mild):
    docs = spark.createDataFrame([(i, t, "en", "x") for i, t in enumerate(_texts(20, 3))], DOCS)
    for _ in range(2):
        screen.screen_batch(docs, 4, str(tmp_path), mild)
    got = screen.read(spark, str(tmp_path))
    assert got.count() == len(_all(got)) and {r.batch for r in got.collect()} == {4}


def test_a_batch_that_failed_half_way_is_taken_again(spark, tmp_path, mild, monkeypatch):
    rows = [(i, t, "en", "x") for i, t in enumerate(_texts(20, 4))]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/in")
    where = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/cp", mild
    monkeypatch.setattr(screen, "read", lambda *_: 1 / 0)  # after the batch's folders are written, before it is committed
    with pytest.raises(Exception, match="ZeroDivision"):
        screen.run(spark, *where)
    monkeypatch.undo()
    assert screen.run(spark, *where) == 1
    got = screen.read(spark, f"{tmp_path}/out")
    assert _all(got) == _hits([r[:3] for r in rows], mild) and got.count() == len(_all(got)) and {r.batch for r in got.collect()} == {0}


def test_files_are_split_into_batches(spark, tmp_path, mild):
    for k in range(3):
        spark.createDataFrame([(k, "PRKPRKPRKPRKPRK", "en", "x")], DOCS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    assert screen.run(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/cp", mild | {"files_per_batch": 1}) == 3
    assert sorted((r.id, r.profile) for r in screen.read(spark, f"{tmp_path}/out").collect()) == sorted((k, p) for k in range(3) for p in ("basic", "proline_rich"))


def test_training_set_against_plain_python(spark, tmp_path):
    settings = config(None, "trainset.json") | {"folds": 3, "length": 3, "step": 1, "least_distinct_residues": 2}
    texts = _texts(30, 5)
    docs = [(i, t, None, "x") for i, t in enumerate([None, "", *texts, texts[0]])]
    labels = [(i, [1, 0, None][i % 3], 0) for i in range(28)] + [(5, 1, 0), (None, 1, 0)]
    spark.createDataFrame(docs, DOCS).write.parquet(f"{tmp_path}/docs")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels")
    votes, count = {}, {}
    for i, q, _ in labels:
        if i is not None and q is not None:
            votes[i] = max(q, votes.get(i, 0))
    for i, t, *_ in docs:
        seq = re.sub("[^a-zA-Z]", "", t or "").upper()
        for at in range(len(seq) - 2) if i in votes else ():
            n = count.setdefault(seq[at : at + 3], [0, 0])
            n[1 - votes[i]] += 1
    kept = {s: 1 if 100 * p >= 60 * (p + m) else -1 for s, (p, m) in count.items() if len(set(s)) > 1 and (100 * p >= 60 * (p + m) or 100 * m >= 60 * (p + m))}
    assert trainset.run(spark, f"{tmp_path}/docs", f"{tmp_path}/labels", f"{tmp_path}/out", settings) == len(kept)
    got = {r.seq: r for r in trainset.read(spark, f"{tmp_path}/out").collect()}
    assert {s: r.y for s, r in got.items()} == kept and all(count[s] == [r.positives, r.negatives] for s, r in got.items())
    assert [got[s].instance_id for s in sorted(got)] == list(range(len(got)))
    assert all(r.value == " ".join(f"{ord(c)}:{s.count(c)}" for c in sorted(set(s))) for s, r in got.items())
    for y in (1, -1):
        sizes = [sum(r.y == y and r.fold == f for r in got.values()) for f in range(3)]
        assert max(sizes) - min(sizes) <= 1
    assert len({sum(r.copies for r in got.values() if r.y == y) for y in (1, -1)}) == 1
    trainset.run(spark, f"{tmp_path}/docs", f"{tmp_path}/labels", f"{tmp_path}/out", settings)
    assert {r.seq: r for r in trainset.read(spark, f"{tmp_path}/out").collect()} == got
    assert spark.read.json(f"{tmp_path}/out/sizes").agg({"examples": "sum"}).first()[0] == len(got)


def test_training_set_leaves_its_output_alone(spark, tmp_path):
    """Nothing that it wrote on the way stays, and features of peptides aren't shuffled."""
    settings, shared = config(None, "trainset.json") | {"length": 3, "step": 1, "least_distinct_residues": 2}, Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file:"))
    docs = spark.createDataFrame([(i, t, None, "x") for i, t in enumerate(_texts(20, 6))], DOCS)
    docs.write.parquet(f"{tmp_path}/docs")
    spark.range(20).selectExpr("id AS doc_id", "CAST(id % 2 AS INT) AS quality").write.parquet(f"{tmp_path}/labels")
    before = set(shared.glob("*"))
    trainset.run(spark, f"{tmp_path}/docs", f"{tmp_path}/labels", f"{tmp_path}/out", settings)
    assert set(shared.glob("*")) == before
    made = trainset.examples(trainset.peptides(docs, spark.read.parquet(f"{tmp_path}/labels"), settings), settings)
    assert "Exchange hashpartitioning" not in made._jdf.queryExecution().executedPlan().toString()


def test_training_set_runs_no_function_on_each_residue(spark, tmp_path, monkeypatch):
    """Windows and features come without Spark's interpreted folds over arrays, and rows are dealt out twice: once for each rank."""
    settings = config(None, "trainset.json") | {"length": 3, "step": 1, "least_distinct_residues": 2}
    docs = spark.createDataFrame([(i, t, None, "x") for i, t in enumerate(_texts(20, 7))], DOCS)
    labels = spark.range(20).selectExpr("id AS doc_id", "CAST(id % 2 AS INT) AS quality")
    found = trainset.peptides(docs, labels, settings)
    wrote = []
    monkeypatch.setattr("strandgraph.operators.ranks.materialize", lambda df, name: wrote.append(name) or storage.materialize(df, name))
    made = trainset.examples(found, settings)
    assert wrote == ["ranges", "shift"]
    for df in (found, made):
        assert "lambda" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert made.count() == found.count() > 0


def test_training_set_restores_settings_and_takes_no_peptides(spark, tmp_path):
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    spark.createDataFrame([(1, "PRK" * 30, None, "x")], DOCS).write.parquet(f"{tmp_path}/docs")
    for quality in (None, 1):  # nothing is labelled; few distinct residues
        spark.createDataFrame([(1, quality)], "doc_id long, quality int").write.mode("overwrite").parquet(f"{tmp_path}/labels")
        assert trainset.run(spark, f"{tmp_path}/docs", f"{tmp_path}/labels", f"{tmp_path}/out", config(None, "trainset.json")) == 0
    assert spark.conf.get(name) == before


def test_command_lines(spark, tmp_path, monkeypatch):
    @contextmanager
    def ours(name):
        yield spark

    monkeypatch.setattr(screen, "session", ours)
    monkeypatch.setattr(trainset, "session", ours)
    spark.createDataFrame([(1, "PRK" * 30, "en", "x")], DOCS).write.parquet(f"{tmp_path}/in")
    spark.createDataFrame([(1, 1)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels")
    screen.main(["--input", f"{tmp_path}/in", "--output", f"{tmp_path}/out", "--checkpoint", f"{tmp_path}/cp"])
    assert screen.read(spark, f"{tmp_path}/out").count() > 0
    (tmp_path / "c.json").write_text('{"length": 3, "step": 3, "agreement_percent": 60, "least_distinct_residues": 2, "folds": 2, "seed": 1}')
    trainset.main(["--records", f"{tmp_path}/in", "--labels", f"{tmp_path}/labels", "--output", f"{tmp_path}/set", "--config", f"{tmp_path}/c.json"])
    assert [(r.seq, r.y, r.copies) for r in trainset.read(spark, f"{tmp_path}/set").collect()] == [("PRK", 1, 1)]
    with pytest.raises(SystemExit):
        screen.main(["--input", "x"])


@pytest.mark.skipif(not TABLES.is_dir(), reason="no driver tables")
@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_job_equals_sql(spark, name):
    con = duckdb.connect()
    for f in TABLES.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    got, want = registry.queries()[name](spark, str(TABLES)).toPandas(), con.sql(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and len(got) == len(want) > 0
    order = sorted(got.columns)
    pd.testing.assert_frame_equal(got[order].sort_values(order, ignore_index=True), want[order].sort_values(order, ignore_index=True))
