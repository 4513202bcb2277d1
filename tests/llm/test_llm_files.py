"""The audit of filters and the token files."""

from __future__ import annotations

import random
import re
import zlib
from itertools import permutations

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from strandgraph.llm import audit, tokenfile
from strandgraph.storage import fresh

SCHEMA = "doc_id long, text string, lang string, mask int, p int, part string, n long, fp long"
LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture()
def many_parts(spark):
    """Ranges so small that copies run over several of them."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "17")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def _docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, 7, 8, "own", 9, 10) for i, t, lang in rows], SCHEMA)


def _failed(rows):
    """Masks by definition."""
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    out = []
    for i, t, lang in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        tests = (len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), bool(re.search(r"[#$%&*|]", t)), i is not None and i > least[t])
        out.append((lang or "", frozenset(x for x, hit in zip("ABCDE", tests, strict=True) if hit)))
    return out


def _report(rows, labels):
    out, good, toxic = {}, {i for i, q, _ in labels if q == 1}, {i for i, _, x in labels if x == 1}
    failed = _failed(rows)
    for part in {p for p, _ in failed}:
        mine = [(f, i) for (p, f), (i, *_) in zip(failed, rows, strict=True) if p == part]
        total = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = mine
            for step, x in enumerate(order, 1):
                gone, stay = [m for m in left if x in m[0]], [m for m in left if x not in m[0]]
                n = sum(x in f for f, _ in mine)
                total[x] += len(gone)
                out[part, "".join(order), step] = [len(stay), len(gone), n - len(gone), sum(f == {x} for f, _ in mine), sum(i in good for _, i in gone), sum(i in toxic for _, i in gone)]
                left = stay
        for (p, order, step), row in out.items():
            if p == part:
                row.append(total[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def _texts(r):
    words = ["alpha", "Beta", "GAMMA", "d#", "é", "日本", "e\x0bf", "g h", " "]
    return "".join(r.choice(words) + r.choice([" ", "\n", "\t", "  "]) for _ in range(r.choice([0, 3, 99, 100, 101])))


def test_audit_equals_walking_through_every_order(spark, many_parts):
    r = random.Random(5)
    some = [_texts(r) for _ in range(20)] + [" ".join(map(str, range(120))), None, "", "A" * 11 + "b" * 89]
    rows = [(r.choice([None, *range(60)]), r.choice(some), r.choice([None, "", "en", "de"])) for _ in range(150)] + [(i, "hot copy", "fr") for i in range(200, 320)]
    labels = [(r.choice([None, *range(60)]), r.choice([None, 0, 1]), r.choice([None, 0, 1])) for _ in range(60)] + [(210, 1, 1), (210, 1, 1)]
    docs = _docs(spark, rows).repartition(5)
    got = audit.report(audit.counters(audit.masks(docs), spark.createDataFrame(labels, LABELS))).collect()
    assert {tuple(x[:3]): tuple(x[3:]) for x in got} == _report(rows, [x for x in labels if x[0] is not None])


def test_copies_that_run_over_ranges_fail_but_for_the_first(spark, many_parts):
    rows = [(i, "same text", "en") for i in range(500)] + [(None, "same text", "en"), (0, "same text", "en"), (3, "other", "en")]
    docs = _docs(spark, rows)
    assert docs.repartitionByRange("doc_id").select(F.spark_partition_id()).distinct().count() > 5
    got = [(x.doc_id, x.mask >> 4) for x in audit.masks(docs).collect()]
    assert sorted(got, key=str) == sorted([(i, int(i > 0)) for i in range(500)] + [(None, 0), (0, 0), (3, 0)], key=str)


def test_equal_fingerprints_of_different_texts():
    runs, found = audit.Runs(), []
    for text, doc_id in ((b"a", 2), (b"a", 2), (b"a", 5), (b"b", 1), (b"b", None), (b"c", None)):
        found.append(runs.step(7, text, doc_id))
    assert found == [(False, 0), (False, 0), (True, 0), (False, 1), (False, 1), (False, 2)]
    assert runs.heads == [(7, b"a", 0), (7, b"b", 1), (7, b"c", 2)] and runs.tails() == [(7, b"a", 0), (7, b"b", 1)]
    assert runs.step(8, b"a", 9) == (False, None) and runs.tails() == [(8, b"a", 0)]


def test_audit_of_nothing(spark):
    none = _docs(spark, [])
    assert audit.report(audit.counters(audit.masks(none), spark.createDataFrame([], LABELS))).count() == 0
    one = audit.report(audit.counters(audit.masks(_docs(spark, [(None, None, None)])), spark.createDataFrame([], LABELS)))
    assert one.count() == 600 and one.agg(F.sum("removed"), F.max("shapley")).first()[:] == (120, 120)


def test_limits_are_parameters():
    assert audit.Limits(least_words=0, symbols=b"x").failed(b"x y") == 8
    assert audit.Limits(capitals_percent=50, least_words=2).failed(b"Ab Cd") == 0


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 32), st.integers(0, 70), st.sampled_from([8, 16, 64]), st.randoms())
def test_images_give_back_any_run_of_ids(bits, n, block, r):
    ids = np.array([r.randrange(1 << bits) for _ in range(n)], "<u4")
    image = tokenfile.pack(ids, bits, block)
    assert np.array_equal(tokenfile.unpack(image), ids)
    first, last = sorted((r.randint(0, n), r.randint(0, n + 3)))
    assert np.array_equal(tokenfile.unpack(image, first, last), ids[first:last])
    blocks = -(-n // block)
    assert len(image) == tokenfile.HEADER.size + 4 * (blocks + 1) + -(-n * bits // 8)


def test_images_refuse_what_they_cannot_hold():
    for ids, bits, block in (([8], 3, 8), ([1], 0, 8), ([1], 33, 8), ([1], 4, 12)):
        with pytest.raises(ValueError):
            tokenfile.pack(np.array(ids, "<u4"), bits, block)
    with pytest.raises(ValueError):
        tokenfile.unpack(b"x" * 40)


@pytest.mark.parametrize("segment", [64, tokenfile.SEGMENT])
def test_token_files_hold_the_library_s_ids_in_order(spark, many_parts, segment):
    r = random.Random(2)
    texts = [None, "", " \n", "日本 é ½ <|endoftext|> it's", "word " * 400, "x"] + ["".join(r.choice("ab é\n1") for _ in range(r.randint(0, 200))) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "no id"), (3, "again"), (3, "again"), (70, "copy"), (71, "copy")]
    docs = spark.createDataFrame([(i, t, "x", 5, True) for i, t in rows], "doc_id long, text string, start string, first int, split boolean").repartition(6)
    path = fresh(spark, "test-tokens")
    tokenfile.write(docs, path, public_tokenizers.path("byte_bpe_50k.json"), segment=segment, block=16)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = sorted(((-1 if i is None else i), [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]) for i, t in rows)
    got = sorted(tokenfile.read(spark, path).collect(), key=lambda x: x.start)
    assert [-1 if x.doc_id is None else x.doc_id for x in got] == [i for i, _ in want]
    assert sorted((-1 if x.doc_id is None else x.doc_id, np.frombuffer(x.ids, "<u4").tolist()) for x in got) == want
    at = 0
    for x in got:
        assert x.start == at and x.n_tokens == len(x.ids) // 4
        at += x.n_tokens
    flat = np.concatenate([np.frombuffer(x.ids, "<u4") for x in got])
    for first, last in ((0, at), (5, 6), (100, 333), (at - 1, at + 9), (at, at + 1)):
        found = sorted(tokenfile.read_range(spark, path, first, last).collect(), key=lambda x: x.at)
        assert b"".join(x.ids for x in found) == flat[first:last].tobytes() and (not found or found[0].at == first)
    if segment == 64:
        assert spark.read.parquet(f"{path}/segments").where("split").count() > 2


def test_token_file_of_nothing(spark):
    path = fresh(spark, "test-tokens")
    tokenfile.write(spark.createDataFrame([], "doc_id long, text string"), path, public_tokenizers.path("byte_bpe_50k.json"))
    assert tokenfile.read(spark, path).count() == 0 and tokenfile.read_range(spark, path, 0, 5).count() == 0


def test_op12_checksums(spark):
    docs = spark.createDataFrame([(4, "b"), (2, "a a")], "doc_id long, text string")
    path = fresh(spark, "test-tokens")
    tokenfile.write(docs, path, public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    crc = lambda t: zlib.crc32(np.array([*tokenizer.encode(t).ids, 0], "<u4").tobytes())
    got = tokenfile.read(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids")).collect()
    assert sorted(map(tuple, got)) == [(2, 0, 3, crc("a a")), (4, 3, 2, crc("b"))]
