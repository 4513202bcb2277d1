"""Operators over many rows: Jaccard join, nearest neighbours, pages, licences, chats, and the pipeline."""

from __future__ import annotations

import itertools
import json
import math
import random
import re
import time

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from strandgraph.llm import ann, chat, components, jaccard, licences, wrapper

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def _brute(texts, words_each, percent):
    sets = {}
    for i, t in texts:
        w = (t or "").encode().lower().split()
        sets[i] = set(zip(*[w[k:] for k in range(words_each)], strict=False)) if len(w) >= words_each else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= percent * len(sets[a] | sets[b]) and find(a) != find(b):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("words_each,percent", [(3, 90), (5, 80), (2, 50)])
def test_jaccard_components_against_all_pairs(spark, words_each, percent):
    r = random.Random(words_each)
    texts = [None, "", "  \n", "one", "one", "one two", "Repeated Line " * 40, "repeated line " * 41]
    bases = [[r.choice(["a", "b", "c", "de", "É", "fg"]) + str(r.randint(0, 200)) for _ in range(r.randint(5, 120))] for _ in range(12)]
    passage = [f"p{k}" for k in range(40)]
    for base in bases:
        for _ in range(8):
            copy = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2, 4])):
                copy[r.randrange(len(copy))] = f"new{r.randint(0, 10**6)}"
            texts.append(" ".join(copy + (passage if r.random() < 0.3 else [])))
    rows = list(enumerate(texts))
    got = jaccard.similar(spark.createDataFrame(rows, "doc_id long, text string"), words_each, percent)
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in got.collect()} == _brute(rows, words_each, percent)


@pytest.mark.parametrize("words_each,percent", [(3, 90), (5, 80), (2, 50), (1, 60), (1, 34)])
def test_jaccard_links_small_sets_with_larger_ones(spark, words_each, percent):
    least = -(-percent // (100 - percent))  # shingles of the smallest set that links with a larger one
    texts = []
    for k in range(4):
        words = [f"t{k}w{i}" for i in range(least + words_each - 1)]
        texts += [" ".join(words), " ".join([*words, "after"]), " ".join(["before", *words]), " ".join(words[1:]), " ".join(["other", *words[1:]])]
    rows = list(enumerate(texts))
    want = _brute(rows, words_each, percent)
    assert [want[i] for i in (0, 1, 2)] == [(least, 0), (least + 1, 0), (least + 1, 0)]
    got = jaccard.similar(spark.createDataFrame(rows, "doc_id long, text string"), words_each, percent)
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in got.collect()} == want


@pytest.mark.parametrize("percent", [90, 80, 50])
def test_jaccard_of_nested_and_equal_sized_sets(spark, percent):
    texts = []
    for n in range(1, 31):
        words = [f"n{n}w{i}" for i in range(n)]
        texts += [" ".join(words), " ".join([*words, *(f"n{n}more{i}" for i in range(max(1, n * (100 - percent) // percent)))]), " ".join([f"n{n}other", *words[1:]])]
    rows = list(enumerate(texts))
    got = jaccard.similar(spark.createDataFrame(rows, "doc_id long, text string"), 1, percent)
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in got.collect()} == _brute(rows, 1, percent)


def test_sketch_counts_every_shingle(spark):
    docs = spark.createDataFrame([(i, " ".join(f"w{i}x{k}" for k in range(20)) + " one and the same end") for i in range(40)], "doc_id long, text string").repartition(3)
    order = jaccard._order(jaccard._sets(docs, 3).where("slot IS NOT NULL"))
    assert (order[(jaccard.shingles("one and the same end") % np.uint64(jaccard.SLOTS)).astype(int)] >= 6).all() and np.count_nonzero(order) > 700


def test_jaccard_of_no_rows_and_of_the_stage(spark):
    empty = spark.createDataFrame([], DOCS)
    assert jaccard.similar(empty).count() == 0 and jaccard.stage(spark, empty, "").count() == 0
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(5, long, "en", "a", 1), (3, long + " x", "en", "b", 2), (9, long, None, None, None), (9, long, None, None, None), (7, None, "en", "a", 0), (8, "", "en", "a", 0), (4, "other " * 9, "en", "c", 3), (4, "other " * 9, "en", "c", 3)]
    kept = jaccard.stage(spark, spark.createDataFrame(rows, DOCS), "").collect()
    assert sorted(x.doc_id for x in kept) == [3, 4, 7, 8]


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(0, 30)] + [(100, k) for k in range(101, 140)] + [(7, 7)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(31)}, **{i: 100 for i in range(100, 140)}}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_neighbours_have_exact_scores_and_enough_recall(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(1500, 16)).astype(np.float32) + rng.integers(0, 4, (1500, 1))
    x[300:700] = x[0]
    rows = [(i, v.tolist(), 0, "r") for i, v in enumerate(x)]
    odd = [(2000, None, 0, "r"), (2001, [0.0] * 16, 0, "r"), (2002, [math.nan] * 16, 0, "r"), (2003, [None] * 16, 0, "r"), (2004, [math.inf] + [1.0] * 15, 0, "r"), (2005, [1.0] * 3, 0, "r"), (2006, [], 0, "r")]
    got = ann.nearest(spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, rank int, score string"), "vec_id % 20 = 0").toPandas()
    assert len(got) == 75 * 5 and set(got.vec_id) < set(range(1500))
    y = x.astype(float)
    n = np.linalg.norm(y, axis=1)
    hit = 0
    for q, mine in got.groupby("query_id"):
        c = y @ y[q] / (n * n[q])
        assert np.allclose(mine.score, c[mine.vec_id], atol=1e-12) and mine.sort_values("rank")["rank"].tolist() == [1, 2, 3, 4, 5]
        best = [i for i in np.lexsort((np.arange(1500), -np.round(c, 12))) if i != q][:5]
        hit += len(set(best) & set(mine.vec_id))
        if 300 <= q < 700:
            assert mine.sort_values("rank").vec_id.tolist() == [0, 300, 301, 302, 303, 304][: 6][1 if q == 0 else 0 :][:5] if q > 304 else True
    assert hit / (75 * 5) >= 0.9
    assert ann.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>"), "true").count() == 0
    again = spark.createDataFrame([(None, [1.0, 2.0]), (1, [1.0, 2.0]), (1, [1.0, 2.0]), (1, [2.0, 1.0]), (2, [0.5, 2.0]), (3, [2.0, 1.0]), (3, [2.0, 1.0])], "vec_id long, embedding array<float>")
    assert [(r.query_id, r.rank, r.vec_id) for r in ann.nearest(again, "true").orderBy("query_id", "rank").collect()] == [(1, 1, 3), (1, 2, 2), (2, 1, 1), (2, 2, 3), (3, 1, 1), (3, 2, 2)]
    few = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.1]), (3, [0.0, 1.0])], "vec_id long, embedding array<float>")
    assert [(r.query_id, r.rank, r.vec_id) for r in ann.nearest(few, "vec_id = 1").orderBy("rank").collect()] == [(1, 1, 2), (1, 2, 3)]


def test_probing_finds_every_code_within_the_radius():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 8))
    codes = ann.learn(x, turns=3)
    block = ann.Block(codes, np.arange(400), x)
    for radius in (0, 1, 3, 5, 9, 14, 24):
        want = np.flatnonzero(np.bitwise_count(block.code ^ block.code[7]).sum(1) <= radius)
        assert block.within(block.code[7], radius).tolist() == want.tolist()


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body>
<header><a href="/">Site</a></header><nav><ul><li><a href=/a>A</a></li><li>B</li></ul></nav><!-- x --><div class="cookie-notice">We use cookies {n}</div>
<{tag}><h1>Title {n} &amp; more</h1><p>First&nbsp;block {n}<br>goes  <b>on<p>Second &lt;b&gt; {n} {body}</p><form><p>Search {n}</p></form><aside>See {n}</aside><p>Read our newsletter.</p></{end}>
<section id="comments"><p>Nice {n}!</p></section><footer>&copy; host {n}</footer></body></html>"""


def test_pages_keep_the_article_only(spark):
    rows = [(i, f"http://a.example/{i}?x=1", PAGE.format(n=i, tag="article", end="article", body="words " * (i + 1))) for i in range(8)]
    rows += [(20 + i, f"https://B.example:80/{i}", PAGE.format(n=i, tag='div class="c"', end="div", body="words " * 40)) for i in range(8)]
    rows += [(50, "http://a.example/null", None), (51, None, ""), (52, None, "no markup at all &eacute;"), (53, "x", "<p>open <i>only"), (54, "x", "<div>" * 3000 + "deep")]
    got = {r.page_id: r.text for r in wrapper.extract(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit(1)).withColumn("kept", F.lit(2))).collect()}
    assert len(got) == len(rows)
    for i in range(8):
        want = [f"Title {i} & more", f"First block {i} goes on", f"Second <b> {i} {('words ' * (i + 1)).strip()}", "Read our newsletter."]
        assert got[i] == "\n\n".join(want)
        assert got[20 + i].split("\n\n")[:3] == [f"Title {i} & more", f"First block {i} goes on", f"Second <b> {i} {('words ' * 40).strip()}"]
    assert got[50] == got[51] == "" and got[52] == "no markup at all é"
    assert wrapper.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_pages_of_another_layout_and_constant_parts_of_articles_keep_their_text(spark):
    top = "<div class=top><p>Our site since 1999</p></div>"
    rows = [(i, None, f"<body>{top}<article><h2>Summary</h2><p>Story number {i} goes on.</p></article></body>") for i in range(8)]
    rows += [(20, None, f"<body>{top}<nav><p>Home</p></nav><div class=text><p>A page laid out otherwise.</p><p>It goes on.</p></div></body>"), (21, None, f"<body>{top}</body>")]
    got = {r.page_id: r.text for r in wrapper.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {**{i: f"Summary\n\nStory number {i} goes on." for i in range(8)}, 20: "A page laid out otherwise.\n\nIt goes on.", 21: ""}


def test_wrapper_is_a_union_free_expression():
    pages = ["<body><h1>a</h1><ul><li>x</li><li>y</li></ul><p>same</p></body>", "<body><h1>b</h1><ul><li>x</li></ul><div class=new>n</div><p>same</p></body>"]
    read = [wrapper.read(source) for source in pages]
    literal = wrapper._hash(read[0].blocks[-1].path, "same")
    out = wrapper.merge(*[wrapper.expression(p, {literal}) for p in read])
    assert wrapper.to_text(out) == "p1:#TEXT p2:#TEXT+ p3:#TEXT? p4:literal"
    grouped = wrapper.expression(wrapper.read("<body>" + "<h2>h</h2><p>a</p><p>b</p>" * 3 + "<h2>h</h2><div>end</div></body>"))
    assert wrapper.to_text(grouped) == "(p1:#TEXT p2:#TEXT+)+ p1:#TEXT p3:#TEXT"


def test_alignment_is_a_longest_common_subsequence():
    r = random.Random(6)
    for _ in range(300):
        a, b = ([[r.randrange(4), 0, 0, 0, 1, 1, 0, 0] for _ in range(r.randint(0, 7))] for _ in range(2))
        got = wrapper.matches(a, b)
        assert all(a[i][0] == b[j][0] for i, j in got) and all(x[0] < y[0] and x[1] < y[1] for x, y in zip(got, got[1:], strict=False))
        keys = [t[0] for t in b]
        longest = max(len(c) for n in range(len(a) + 1) for c in itertools.combinations([t[0] for t in a], n) if _is_within(c, keys))
        assert len(got) == longest


def _is_within(short, long):
    rest = iter(long)
    return all(x in rest for x in short)


def test_host_templates_decide_and_copies_make_none(spark):
    note = "<div class=x><p>Subscribe now for a better life</p></div>"
    rows = [(i, f"http://a.example/{i}", f"<title>t{i}</title><div class=x><h1>Title {i}</h1><p>{'long text ' * 9}{i}</p></div>{note}") for i in range(8)]
    rows += [(20 + i, f"http://b.example/{i}", "<title>t</title><div class=y><h1>Title</h1><p>one and the same article</p></div>") for i in range(5)]
    rows += [(30 + i, f"http://b.example/x{i}", f"<title>u{i}</title><div class=y><h1>Other {i}</h1><p>another article {i}</p></div>") for i in range(2)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in wrapper.extract(pages).collect()}
    alone = {i: wrapper.main_text(wrapper.read(h), None, ()) for i, _, h in rows}
    for i in range(8):
        assert got[i] == f"Title {i}\n\n{'long text ' * 9}{i}" and alone[i] == got[i] + "\n\nSubscribe now for a better life"
    assert all(got[20 + i] == "Title\n\none and the same article" for i in range(5)) and got[31] == "Other 1\n\nanother article 1"
    assert {r.page_id: r.text for r in wrapper.extract(pages.repartition(7).sortWithinPartitions("html")).collect()} == got


def test_pages_take_time_in_proportion_to_their_length():
    for source in ["<a " * 700_000, '<a ">"' * 300_000 + '"', "<div class=a>x" * 60_000, "<ul><li>" + "<div>" * 60_000 + "<li></li>" * 60_000, "<div>" * 60_000 + "</x>" * 60_000]:
        began = time.perf_counter()
        page = wrapper.read(source)
        wrapper.main_text(page, wrapper.expression(page), ())
        assert time.perf_counter() - began < 12
    deep = wrapper.read("<article>" + "<div>" * 400 + "text" + "<nav>" + "<div>" * 400 + "menu")
    assert wrapper.main_text(deep, None, ()) == "text"


def _sql(sql, **tables):
    con = duckdb.connect()
    for name, frame in tables.items():
        con.register(name, frame)
    return sorted(map(repr, con.sql(sql).fetchall()))


def test_neighbours_of_the_table_and_of_huge_and_tiny_vectors(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    x = table.toPandas().sort_values("vec_id")
    y = np.array(x.embedding.tolist(), float)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    got = ann.nearest(table, "vec_id % 5 = 0").toPandas()
    hit = total = 0
    for q, mine in got.groupby("query_id"):
        at = int(np.flatnonzero(x.vec_id.to_numpy() == q)[0])
        near = [i for i in np.argsort(-(y @ y[at]), kind="stable") if i != at][:5]
        hit, total = hit + len({int(x.vec_id.iloc[i]) for i in near} & set(mine.vec_id)), total + 5
    assert hit / total >= 0.9
    odd = [(k, [size * c for c in v]) for k, (size, v) in enumerate((s, v) for s in (1e200, 1e-200, 1.0) for v in ([1.0, 2.0], [2.0, 1.0], [1.0, -1.0]))]
    near = {(r.query_id, r.rank): (r.vec_id, r.score) for r in ann.nearest(spark.createDataFrame(odd, "vec_id long, embedding array<double>"), "vec_id = 0").collect()}
    assert near[0, 1][0] == 3 and near[0, 2][0] == 6 and near[0, 1][1] == pytest.approx(1)
    assert {near[0, k][0] for k in (3, 4, 5)} == {1, 4, 7} and near[0, 5][1] == pytest.approx(0.8)


def test_licences_against_sql(spark):
    texts = [None, "", "x", "Released under the MIT License.", "intro\nLicensed under the Apache License, Version 2.0.\n\nmore", "released UNDER the mit   licence", "The MIT License was released.", licences.TEMPLATES[15][1], "Licensed under CC BY-NC 4.0.\nReleased under the MIT License.", "a " * 5000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("licence", F.lit(1)).withColumn("dice", F.lit(2))
    got = sorted(repr(tuple(r)) for r in licences.licences(docs).collect())
    assert got == _sql(licences.SQL, documents=docs.toPandas())
    found = {r.doc_id: r.licence for r in licences.licences(docs).collect()}
    assert found[3] == "MIT" and found[4] == "Apache-2.0" and found[7] == "ISC" and found[8] == "CC-BY-NC-4.0" and found[9] is None
    assert licences.licences(docs.limit(0)).count() == 0


def test_whole_licence_texts(spark):
    full = {name: "\n\n".join(parts) for name, parts in licences.FULL}
    wrapped = "Copyright (c) 2020 Someone\n\n" + re.sub(r"(.{60,75}) ", r"\1\n", full["MIT"])
    texts = [full["MIT"], wrapped, "x = 1\n\n" + full["Zlib"] + "\n\ndef f(): pass " * 300, full["BSD-2-Clause"], "\n".join(full["Unlicense"].split("\n")[:3]), "a permission notice without limitation " * 400, (licences.TEMPLATES[0][1] + " ") * 300]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: (r.licence, r.dice) for r in licences.licences(docs).collect()}
    assert found[0] == ("MIT", 1.0) and found[1][0] == "MIT" and found[1][1] > 0.95 and found[2] == ("Zlib", 1.0) and found[3] == ("BSD-2-Clause", 1.0) and found[5][0] is None
    assert sorted(repr(tuple(r)) for r in licences.licences(docs).collect()) == _sql(licences.SQL, documents=docs.toPandas())


def test_size_bounds_lose_no_match():
    for b in range(1, 40):
        low, high = licences.size_bounds(b)
        for a in range(1, 120):
            assert (200 * min(a, b) >= licences.LEAST * (a + b)) <= (low <= a <= high)


SCHEMAS = {"add": {"x": ("BIGINT", True), "y": ("BIGINT", False)}, "say": {"text": ("STRING", True)}}


def test_tool_calls_are_linked_ordered_and_checked(spark):
    call = lambda *c: json.dumps({"tool_calls": [{"id": i, "name": n, "arguments": a} for i, n, a in c]})
    answer = lambda i: json.dumps({"tool_call_id": i, "content": 1})
    rows = [
        (1, 0, "user", "hi"),
        (1, 1, "assistant", call(("c1", "add", {"y": 2, "x": 1}), ("c2", "add", {"x": "no"}))),
        (1, 2, "tool", answer("c1")),
        (1, 3, "assistant", call(("c3", "say", {"text": {"$ref": "c1"}}))),
        (1, 4, "tool", answer("c3")),
        (1, 5, "tool", answer("nobody")),
        (1, 6, "assistant", call(("k1", "say", {"text": {"$ref": "k2"}}), ("k2", "say", {"text": {"$ref": "k1"}}))),
        (2, 0, "tool", answer("c9")),
        (2, 1, "assistant", call(("c9", "nothing", {}))),
        (2, 2, "assistant", None),
        (2, 2, None, None),
        (2, 3, "assistant", "{broken"),
        (2, 3, "assistant", "{broken"),
    ]
    out = chat.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("level", F.lit("x")), SCHEMAS).collect()
    assert len(out) == len(rows)
    by = {(r.conv_id, r.turn, r.role): r for r in out}
    first = by[1, 1, "assistant"]
    assert (first.n_calls, first.n_answered, first.n_valid, first.level) == (2, 1, 1, 0)
    assert json.loads(first.json)["tool_calls"][0]["arguments"] == {"x": 1, "y": 2} and '"arguments":{"x":1,"y":2},"id":"c1","name":"add"' in first.json
    assert (by[1, 2, "tool"].call_turn, by[1, 2, "tool"].level) == (1, 1)
    assert by[1, 3, "assistant"].level == 2 and by[1, 4, "tool"].level == 3
    assert by[1, 5, "tool"].call_turn is None and by[1, 5, "tool"].level == 0
    assert by[1, 6, "assistant"].level is None
    assert by[2, 0, "tool"].call_turn is None and by[2, 1, "assistant"].n_valid == 0
    assert chat.link(spark.createDataFrame([], "conv_id long, turn long, role string, text string"), SCHEMAS).count() == 0


def test_levels_are_those_of_a_plain_search(spark, monkeypatch):
    r = random.Random(11)
    needs = {(1, f"c{i}"): [f"c{i - 1}"] if i else [] for i in range(1000)}  # a chain
    needs |= {(2, f"d{i}"): sorted({f"d{r.randrange(30)}" for _ in range(r.randint(0, 3))} - {f"d{i}"}) for i in range(30)}  # with cycles
    needs |= {(3, f"e{i}"): sorted({f"e{r.randrange(i)}" for _ in range(2)}) if i else ["unknown"] for i in range(25)}

    def level(c, k, seen):
        if k in seen:
            return None
        below = [level(c, n, seen | {k}) for n in needs[c, k] if (c, n) in needs]
        return None if None in below else max(below, default=-2) + 2

    want = {(1, f"c{i}"): 2 * i for i in range(1000)} | {(c, k): level(c, k, frozenset()) for c, k in needs if c > 1}
    rows = [(c, k, json.dumps({f"a{j}": {"$ref": n} for j, n in enumerate(ns)})) for (c, k), ns in needs.items()]
    written = []
    monkeypatch.setattr(chat.common, "materialize", lambda df, name, f=chat.common.materialize: (written.append(name), f(df, name))[1])
    calls = spark.createDataFrame(rows, "conv_id long, call_id string, arguments string")
    levels = lambda some: {(x.conv_id, x.call_id): x.level for x in some.join(chat._levels(some), ["conv_id", "call_id"], "left").collect()}
    got = levels(calls.where("conv_id = 1"))
    assert written.count("references") <= 1 + 3 * 12  # once, and up to three times in each of twelve rounds, for a chain of 1,000
    got |= levels(calls.where("conv_id > 1"))
    assert got == want and None in want.values()


def test_chat_joins_are_hash_joins(spark):
    rows = spark.createDataFrame([(1, 0, "user", "x"), (1, 1, "assistant", "y")], "conv_id long, turn long, role string, text string")
    plan = chat.link(rows, chat.TOOLS)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" in plan


def test_chat_query_against_sql(spark, tmp_path):
    rows = [(1, 0, "system", "be\n\"good\""), (1, 1, "user", "é \\ /"), (1, 2, "assistant", "ok\t"), (2, 0, "assistant", "first"), (2, 1, "user", None), (3, 0, None, None), (4, 0, "user", "a"), (4, 0, "user", "a")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    table.write.parquet(str(tmp_path / "conversations.parquet"))
    got = sorted(repr(tuple(r)) for r in chat.query(spark, str(tmp_path)).where("role IS NOT NULL AND text IS NOT NULL").collect())
    assert got == _sql(f"SELECT * FROM ({chat.SQL}) WHERE json IS NOT NULL", conversations=table.toPandas().where(lambda x: x.notna(), None))


def test_pipeline_keeps_columns_and_clean_documents(spark, tmp_path):
    r = random.Random(9)
    words = {lang: ["".join(r.choice(letters) for _ in range(r.randint(2, 7))) for _ in range(300)] for lang, letters in (("aa", "abcdefgh"), ("bb", "mnopqrst"))}
    rows = []
    for i in range(120):
        lang = "aa" if i % 3 else "bb"
        rows.append((i, " ".join(r.choice(words[lang]) for _ in range(150)) + ".", lang, "s", 10))
    rows += [(200, rows[0][1], "bb", "s", 10), (201, "too short", "aa", "s", 9), (202, None, "aa", "s", 0), (203, "# $ % " * 100, "aa", "s", 0), (204, rows[1][1] + " token = '" + "0123456789abcdef" * 2 + "'", "aa", "s", 1)]
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
            out.write.parquet(str(tmp_path / f"stage{k}"))
            docs = spark.read.parquet(str(tmp_path / f"stage{k}"))
        if k == 2:
            assert sorted(x.doc_id for x in docs.select("doc_id").collect()) == list(range(120))
    assert {x.doc_id for x in out.select("doc_id").distinct().collect()} == set(range(120))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == out.count()


def test_arguments_that_are_no_json_stay(spark):
    rows = [(1, 1, "assistant", '{"tool_calls":[{"id":"a","name":"reply","arguments":"not json"},{"id":"b","name":"reply","arguments":"{\\"text\\":\\"x\\"}"},{"id":"c","name":"reply"}]}')]
    got = chat.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), SCHEMAS).first()
    made = json.loads(got.json)["tool_calls"]
    assert [c.get("arguments") for c in made] == ["not json", {"text": "x"}, None] and got.n_calls == 3
