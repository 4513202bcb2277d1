"""Sequences, readers, writers, streams and variants."""

from __future__ import annotations

import re
import struct

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandgraph.functions import residues as R
from strandgraph.operators import encode, features, graph, sequence, variants
from strandgraph.sources import readers, writers
from strandgraph.streaming import peptides

FASTA = "# made by hand\n# second line\n>seq_1\tk=v\tflag\n# about it\nEEPLI\nPPPLPPRK*KF\n>seq_2 rest\tx=1=2\nACD EF\n"


@pytest.fixture
def fasta(tmp_path):
    path = tmp_path / "in.fasta"
    path.write_text(FASTA)
    return str(path)


def test_fasta_records(spark, fasta, tmp_path):
    rows = {r.id: r for r in readers.fasta(spark, fasta).collect()}
    assert rows["seq_1"].seq == "EEPLIPPPLPPRKKF" and rows["seq_1"].comment == "# about it"
    assert rows["seq_2"].seq == "ACDEF" and rows["seq_2"].head_fields == ["seq_2 rest", "x=1=2"]
    assert readers.stream_comment(spark, fasta) == "# made by hand\n# second line"
    assert readers.is_fasta(spark, fasta)
    empty = tmp_path / "bad.fasta"
    empty.write_text(">a\n>b\nAC\n")
    with pytest.raises(Exception, match="no sequence"):
        readers.fasta(spark, str(empty)).collect()
    plain = tmp_path / "plain.txt"
    plain.write_text("nothing\n")
    assert not readers.is_fasta(spark, str(plain))


def test_fasta_round_trip_with_gzip(spark, fasta, tmp_path):
    rows = readers.fasta(spark, fasta)
    writers.save_text(writers.fasta(rows, 4), str(tmp_path / "out"), "gzip")
    back = readers.fasta(spark, str(tmp_path / "out"))
    columns = ["head", "id", "comment", "seq"]
    assert sorted(map(tuple, back.select(columns).collect())) == sorted(map(tuple, rows.select(columns).collect()))


def test_key_values_need_one_equals_sign(spark):
    row = spark.createDataFrame([(["a=1", "b", "c=1=2", "=x", "a=3", "d="],)], "f array<string>").select(R.key_values(F.col("f")).alias("m")).first()
    assert row.m == {"a": "3"}


def test_windows_wrap_and_scripts(spark):
    rows = spark.createDataFrame([(1, "abcdefghijklmnopqrstu"), (2, "short"), (3, None)], "id long, text string")
    got = sequence.windows(sequence.cleaned(rows)).orderBy("start").collect()
    assert [(r.peptide_id, r.seq) for r in got] == [("1-1-15", "ABCDEFGHIJKLMNO"), ("1-6-20", "FGHIJKLMNOPQRST")]
    assert rows.where("id = 1").select(R.wrap(F.col("text"), 8).alias("w")).first().w == "abcdefgh\nijklmnop\nqrstu"
    made = sequence.script(rows, {"n": "length(text) * k"}, {"k": 2}, "id < 3").orderBy("id").collect()
    assert [r.n for r in made] == [42, 10] and "k" not in made[0].asDict()
    assert sequence.totals(rows, {"n": "count(text)"}).first().n == 2
    assert sequence.residue_histogram(sequence.cleaned(rows)).where("residue = 'S'").first().n == 2
    with pytest.raises(Exception):
        sequence.checked(rows, "no_such_column + 1")
    for wrong in ({"grep": "x", "print_each": True}, {"one_line": True, "line_length": 5}, {"line_length": 0}, {"sort_by": "x", "end": "y"}):
        with pytest.raises(ValueError):
            sequence.check_options(**wrong)
    assert sequence.python_script(rows.where("id < 3"), lambda it: (p.assign(text=p["text"].str[::-1]) for p in it), rows.schema).where("id = 2").first().text == "trohs"


@pytest.mark.parametrize(("length", "step"), [(15, 5), (4, 3), (2, 4), (1, 1)])
def test_windows_of_any_characters(spark, length, step):
    texts = [None, "", "A", "ABCDEFGHIJKLMNOPQRSTUVW", "ABCDéFGHIJΩLMNOPQRST", "𝄞" * 17 + "\n" * 3, "x" * 15, "é" * 14, "AB\nCD EF" * 9]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, seq string")
    got = {(r.id, r.start, r.end, r.peptide_id, r.seq) for r in sequence.windows(rows, length, step).collect()}
    assert got == {(i, at + 1, at + length, f"{i}-{at + 1}-{at + length}", t[at : at + length]) for i, t in enumerate(texts) if t for at in range(0, len(t) - length + 1, step)}
    assert "lambda" not in sequence.windows(rows, length, step)._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("kind", [pa.string(), pa.large_string()])
def test_counts_of_residues(kind):
    for seqs in ([], [None], [""], ["", "PRKPR", None, "AAAAAAAAAAAA", "Z"], ["éA𝄞", "A", None, "Ωé"]):
        want = [None if s is None else " ".join(f"{ord(c)}:{s.count(c)}" for c in sorted(set(s))) for s in seqs]
        assert R.counts(pa.array(seqs, kind)).to_pylist() == want
        assert R.counts(pa.array(["before", *seqs], kind)[1:]).to_pylist() == want


def test_gspan_round_trip(spark, tmp_path):
    p = spark.createDataFrame([("0", "EPL"), ("1", "KF")], "peptide_id string, seq string")
    v, e = encode.vertices(p), encode.edges(p)
    writers.save_text(writers.export(v, e, "gspan").orderBy("graph_id").coalesce(1), str(tmp_path / "g"))
    w, f = readers.gspan(spark, str(tmp_path / "g"))
    key = lambda df, *c: sorted((str(r[0]), *r[1:]) for r in df.select("graph_id", *c).collect())
    assert key(w, "vid", "label") == key(v, "vid", "label") and key(f, "src", "dst", "label") == key(e, "src", "dst", "label")
    for form in ("dot", "gml", "gdl", "csv"):
        assert writers.export(v, encode.undirected(e), form).count() == 2
    assert "0 -- " not in writers.export(v, e, "dot").first().value
    with pytest.raises(ValueError):
        writers.export(v, e, "png")
    assert writers.one_line(v, e).where("graph_id = '1'").first().value.startswith("1:X 2:X 3:PCB")


def test_gspan_with_further_columns(spark, tmp_path):
    (tmp_path / "g.txt").write_text("t # a\nv 0 A A0 1 1.5 2 3\nv 1 B B1 0 0 0 0\ne 0 1 s 0.5\nx ignored\n\nv 0 C C0 0 1 1 1\nt # b\nt # c\nv 5 D D5 1 0 0 0\n")
    v, e = readers.gspan(spark, str(tmp_path / "g.txt"), weights=True, viewpoint=True, coordinates=True, absolute_id=True)
    got = {(r.graph_id, r.vid): r for r in v.collect()}
    assert set(got) == {(0, 0), (0, 1), (1, 0), (2, 5)}
    assert got[0, 0].absolute_id == "A0" and got[0, 0].viewpoint and got[0, 0].coord == [1.5, 2.0, 3.0]
    assert [(r.graph_id, r.src, r.dst, r.label, r.weight) for r in e.collect()] == [(0, 0, 1, "s", 0.5)]


def test_molecules(spark, tmp_path):
    atom = lambda x: f"{'':31}{x:<3} 0"
    molecule = "name\n\n\n  3  2  0\n" + "\n".join(map(atom, ["C", "N", "Cl"])) + "\n  1  2  1\n  2  3  2\nM END\n"
    (tmp_path / "m.sdf").write_text(molecule + "$$$$\n" + molecule + "$$$$\n")
    v, e = readers.sdf(spark, str(tmp_path / "m.sdf"))
    assert [(r.vid, r.label) for r in v.where("graph_id = 1").orderBy("vid").collect()] == [(0, "C"), (1, "N"), (2, "Cl")]
    assert {(r.src, r.dst, r.label) for r in e.where("graph_id = 0").collect()} == {(0, 1, "1"), (1, 0, "1"), (1, 2, "2"), (2, 1, "2")}
    (tmp_path / "bad.sdf").write_text("name\n\n\n  9  9  0\nx\n$$$$\n")
    with pytest.raises(Exception, match="shorter"):
        readers.sdf(spark, str(tmp_path / "bad.sdf"))[0].collect()


def test_targets_numbers_and_lists(spark, tmp_path):
    (tmp_path / "t.txt").write_text("1\n-1\n0\n1\n")
    assert [(r.instance_id, r.y) for r in readers.targets(spark, str(tmp_path / "t.txt")).orderBy("instance_id").collect()] == [(0, 1), (1, -1), (2, 0), (3, 1)]
    (tmp_path / "row.txt").write_text("1 -1 0\n")
    assert [r.y for r in readers.targets(spark, str(tmp_path / "row.txt")).orderBy("instance_id").collect()] == [1, -1, 0]
    (tmp_path / "bad.txt").write_text("1\n2\n")
    with pytest.raises(Exception, match="no target"):
        readers.targets(spark, str(tmp_path / "bad.txt")).collect()
    (tmp_path / "n.txt").write_text("1.5 2\n 3\n")
    assert sorted(r.value for r in readers.numbers(spark, str(tmp_path / "n.txt")).collect()) == [1.5, 2, 3]
    rows, ids = spark.range(5).withColumnRenamed("id", "instance_id"), lambda *x: spark.createDataFrame([(i,) for i in x], "id long")
    assert {r[0] for r in readers.listed(rows, white=ids(1, 3)).collect()} == {0, 2}
    assert {r[0] for r in readers.listed(rows, black=ids(1, 3)).collect()} == {1, 3, 4}
    assert {r[0] for r in readers.listed(rows, white=ids(1), black=ids(2)).collect()} == {0, 2, 3, 4}


def test_sparse_formats(spark, tmp_path):
    rows = spark.createDataFrame([(0, 3, 1.0), (0, 7, 0.25), (1, 2, -3.0)], "instance_id long, fid long, val double")
    text = writers.sparse_text(rows).orderBy("instance_id").collect()
    assert [r.value for r in text] == ["3:1 7:2.5000000e-01", "2:-3"]
    (tmp_path / "v.txt").write_text("\n".join(r.value for r in text) + " junk\n")
    assert sorted(map(tuple, readers.sparse_text(spark, str(tmp_path / "v.txt")).collect())) == sorted(map(tuple, rows.collect()))
    binary = {r.instance_id: bytes(r.content) for r in writers.sparse_binary(rows).collect()}
    assert binary[0] == struct.pack("=iifif", 2, 3, 1.0, 7, 0.25)
    (tmp_path / "v.bin").write_bytes(binary[0] + binary[1])
    got = readers.sparse_binary(spark, str(tmp_path / "v.bin")).orderBy("vector", "fid").collect()
    assert [(r.vector, r.fid, r.val) for r in got] == [(0, 3, 1.0), (0, 7, 0.25), (1, 2, -3.0)]


def test_model_files(spark, tmp_path):
    text = "num_levels 1\nbitsize 14\ninstance_parts_threshold 1\nradius 0\ndistance 3\npositive_threshold 0\nnegative_threshold 0\nbias -0.446269\nwscale 0.0203799\nw  375:-2.6751585e+01 979:1.5e+00\n"
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "one").write_text(text)
    models, weights = readers.model(spark, str(tmp_path / "m"))
    row = models.first()
    assert (row.model, row.level, row.bits, row.distance, row.bias, row.wscale) == ("one", 0, 14, 3, -0.446269, 0.0203799)
    assert {(r.fid, r.w) for r in weights.collect()} == {(375, -26.751585), (979, 1.5)}
    again = writers.model(models, weights).first().value
    (tmp_path / "n").mkdir()
    (tmp_path / "n" / "one").write_text(again)
    assert sorted(map(tuple, readers.model(spark, str(tmp_path / "n"))[1].collect())) == sorted(map(tuple, weights.collect()))
    (tmp_path / "n" / "one").write_text(text.replace("radius 0\n", ""))
    with pytest.raises(Exception, match="out of order"):
        readers.model(spark, str(tmp_path / "n"))[0].collect()


def test_ranks_follow_the_file(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"part{k}.txt").write_text("".join(f"{k}-{i}\n" for i in range(4)))
    got = readers.rank(spark.read.text(str(tmp_path))).orderBy("instance_id").collect()
    assert [r.instance_id for r in got] == list(range(12)) and all(got[i + 1].value[-1] == "1" for i in range(0, 12, 4))


def test_stream_of_fasta_is_scored(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.fasta").write_text(">p1\nEEPLIPPPLPPRKKF\n>p2\nEEPLIPPPLPPRKKFAAAAA\n")
    w = spark.range(32768).selectExpr("0 AS model", "0 AS level", "id AS fid", "1e0 AS w")
    m = spark.createDataFrame([(0, 0, 0.0, 1.0, 0.0, 0.0)], "model int, level int, bias double, wscale double, pos_thr double, neg_thr double")
    stream = peptides.peptide_stream(peptides.fasta_stream(spark, str(tmp_path / "in")))
    q = stream.writeStream.option("checkpointLocation", str(tmp_path / "state")).foreachBatch(peptides.scoring_sink(w, m, str(tmp_path / "out"))).trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert {r.peptide_id for r in got} == {"p1-1-15", "p2-1-15", "p2-6-20"} and all(r.prediction == 1 for r in got)
    assert {round(r.margin, 6) for r in got if r.peptide_id.endswith("1-15")} == {round(30 * 0.12909944 + 32 * 0.125, 6)}


def test_variants(spark):
    rows = [("1", 5, "A", ["C", "*"], "PASS", [1, 2], [("s1", "0/1"), ("s2", "0/0")]), ("1", 9, "AT", ["A"], "LOW", [1], [("s1", "0/1")]), ("1", 7, "G", ["T"], "PASS", [0], [])]
    sites = spark.createDataFrame(rows, "chrom string, pos long, ref string, alts array<string>, filter string, ac array<int>, genotypes array<struct<sample: string, gt: string>>")
    assert [r.pos for r in variants.by_type(sites, "snp").collect()] == [5] and [r.pos for r in variants.by_type(sites, "indel").collect()] == [9]
    merged = variants.merged_alleles(variants.without_stars(variants.split_alleles(sites))).where("pos = 5").first()
    assert merged.alts == ["C"] and merged.ac == [1]
    assert variants.passed(sites).count() == 2
    left = variants.without_samples(sites, spark.createDataFrame([("s2",)], "sample string")).where("pos = 5").first()
    assert [g.sample for g in left.genotypes] == ["s1"]
    assert [r.pos for r in variants.concatenated(sites.where("pos > 6"), sites.where("pos < 6")).collect()] == [5, 7, 9]


def test_annotation_and_colours(spark):
    p = spark.createDataFrame([("a", "EP")], "peptide_id string, seq string")
    v, e = encode.vertices(p), encode.edges(p)
    vec = features.vertex_vectors(v, e, 0, 1)
    weights = vec.select("fid").distinct().withColumn("w", F.lit(2.0))
    got = writers.annotated(v, vec, weights)
    assert got.count() == 8 and got.where("score > 0").count() == 8
    assert graph.colours(v).agg(F.max("colour")).first()[0] == v.select("label").distinct().count() - 1


def test_dense_vectors_in_both_formats(spark, tmp_path):
    rows = [(0, [0.0, 1.5, 0.0]), (1, [2.0]), (2, []), (3, [0.0, 0.0, 0.25, 4.0])]
    vectors = spark.createDataFrame(rows, "instance_id long, vector array<double>")
    text = writers.dense_text(vectors).orderBy("instance_id").collect()
    assert [r.value for r in text] == ["1:1.5000000e+00 2:0", "0:2", "", "2:2.5000000e-01 3:4"]
    (tmp_path / "dense.txt").write_text("".join(r.value + "\n" for r in text))
    assert [(r.instance_id, r.vector) for r in readers.dense_text(spark, str(tmp_path / "dense.txt")).orderBy("instance_id").collect()] == rows
    content = [bytes(r.content) for r in writers.dense_binary(vectors).orderBy("instance_id").collect()]
    (tmp_path / "dense.bin").write_bytes(b"".join(content))
    assert [(r.number, r.vector) for r in readers.dense_binary(spark, str(tmp_path / "dense.bin")).orderBy("number").collect()] == rows


def test_strict_sparse_text_and_files_by_part(spark, tmp_path):
    (tmp_path / "good.txt").write_text("1:2 3:-4.5e1\n\n7:.5\n")
    assert [tuple(r) for r in readers.sparse_text_strict(spark, str(tmp_path / "good.txt")).orderBy("instance_id", "fid").collect()] == [(0, 1, 2.0), (0, 3, -45.0), (2, 7, 0.5)]
    (tmp_path / "bad.txt").write_text("1:2 x\n")
    with pytest.raises(Exception, match="not index:value"):
        readers.sparse_text_strict(spark, str(tmp_path / "bad.txt")).collect()
    ids = spark.createDataFrame([(4, "train", 1), (4, "test", 2), (9, "train", 3)], "centre long, part string, id long")
    writers.save_parts(ids, str(tmp_path / "split"), ["centre", "part"])
    assert {p.parent.relative_to(tmp_path / "split").as_posix() for p in (tmp_path / "split").rglob("*.csv")} == {"centre=4/part=train", "centre=4/part=test", "centre=9/part=train"}
    writers.save_feature_maps({"hard": spark.createDataFrame([(1, "a")], "code long, text string")}, str(tmp_path / "maps"))
    assert spark.read.csv(str(tmp_path / "maps" / "hard"), sep="\t").first()[:] == ("1", "a")


@pytest.mark.parametrize("block", [2, 1000])
def test_patterns_meet_names_without_a_nested_loop(spark, block):
    names = ["alpha beta", "alphabet", "beta.gamma", "xyz", "", "aaab", "a?b", "(x)", "abcabd", None, "xyz"]
    patterns = ["alpha", "^beta", "a+b", "xy*z", "abc?", "b.ta", "al|xy", "(alpha )?beta", "[xy]+z", r"a\?b", "", "zz", "never there", "a*?aab", "t$", "gam+a", "ab", None]
    table = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "name string, ord int")
    found = encode.matches(spark.createDataFrame([(p,) for p in [*patterns, "alpha"]], "pattern string"), table, block)
    want = sorted((p, i) for p in patterns if p is not None for i, n in enumerate(names) if n is not None and re.search(p, n))
    assert sorted((r.pattern, r.ord) for r in found.collect()) == want
    plan = found._jdf.queryExecution().optimizedPlan().toString() + found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_layout_of_the_input(spark):
    chunks = spark.createDataFrame([(">a\nABC\nDEFGH\nIJ",), (">b\nABCDEFGHIJKLMNOP",), ("c\n# note\nAB\nC",)], "value string")
    out = sorted(r.value for r in writers.fasta(readers.parsed_fasta(chunks, layout=True), "input").collect())
    assert out == [">a\nABCDEFGHIJ", ">b\nABCDEFGHIJKLMNOP", ">c\n# note\nABC"]
    assert [tuple(r) for r in readers.parsed_fasta(chunks, layout=True).orderBy("id").select("n_lines", "width").collect()] == [(3, 5), (1, 16), (2, 2)]


def test_cut_binary_vectors_are_an_error(spark):
    for content, read in ((b"\x02\0\0\0" + b"\0" * 8, readers.decoded_sparse), (b"\x02\0\0\0" + b"\0" * 4, readers.decoded_dense), (b"\x01", readers.decoded_dense)):
        with pytest.raises(Exception, match="beyond the end"):
            read(spark.createDataFrame([("f", bytearray(content))], "file string, content binary")).collect()


def test_variant_tasks_follow_the_lines(spark, monkeypatch):
    """More lines are more tasks, not larger ones, with the same sites (q_variant_workflow)."""
    from strandgraph.plans import files, inputs

    rows = [("1", p, "A", 0, "C", 1, "s") for p in range(40)] + [("1", p, "A", 1, "T", 2, "s") for p in range(0, 40, 2)]
    split = spark.createDataFrame(rows, "chrom string, pos long, ref string, i int, alt string, allele_count int, samples string")
    merged = variants.merged_alleles(split, ["samples"], 7)
    assert merged.rdd.getNumPartitions() == 7 and all(r.samples == "s" and r.alts == (["C", "T"] if r.pos % 2 == 0 else ["C"]) for r in merged.collect())
    few = files.workflow(spark, "/root/testdata/sf0.001")
    monkeypatch.setattr(files, "LINES", 1000)
    many = files.workflow(spark, "/root/testdata/sf0.001")
    lines = inputs.table(spark, "/root/testdata/sf0.001", "lineitem").count()
    assert few.rdd.getNumPartitions() <= 2 and many.rdd.getNumPartitions() >= -(-lines // 1000)
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, many.collect()))


def test_residues_beside_the_letters_are_counted(spark):
    rows = spark.createDataFrame([("a", "AB-é-B"), ("a", "é."), ("b", ""), ("b", None), ("c", "ab")], "id string, seq string")
    got = {(r.id, r.residue): r.n for r in sequence.residue_histogram(rows, ["id"]).collect()}
    assert got == {("a", "A"): 1, ("a", "B"): 2, ("a", "-"): 2, ("a", "é"): 2, ("a", "."): 1, ("c", "a"): 1, ("c", "b"): 1}
