"""Main text of web pages by wrappers inferred from the pages of each host.

A page is a stream of tokens: its blocks of text, each under the path of the elements around it. A wrapper is a union-free
regular expression over such streams: tokens in order, each plain, optional (?) or, alone or with its neighbours, repeated
(+), with a literal text or a text slot. It begins as one page's stream and is aligned with one after another: equal
neighbouring runs become a repeated group, a token that one side lacks an optional one, and texts become slots.

A text outside of articles is literal (part of the template) where the host's pages share it although they are different
pages: it stands under one path on at least LITERAL_PAGES of them and on half of all, and these differ in their titles
and their longest other texts, and in a good part of all their characters. Copies and near copies of a page therefore make
nothing literal, and whatever stands in an article element stays.

Equal streams are merged first; different ones in rounds of at most FAN a task, dealt by a hash of the stream and in
its order, so a host with a third of all pages meets no single task and the result doesn't hang on partitions. What is
kept of a page are the blocks that stand at the wrapper's content slots.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Collection, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandgraph.llm import common
from strandgraph.llm.htmlpage import Page, parse

#: Pages that must share a literal text; expressions merged in one task; places of one token in an expression.
LITERAL_PAGES, FAN, PLACES = 5, 1000, 4
#: Tokens of a repeated group at most; different streams kept in a task before they are handed on.
PERIOD, STREAMS = 4, 5000

#: Elements that never hold main text, and words of class, id or role that mark such parts, or the main part.
DROPPED_TAGS = frozenset("head nav footer aside form button dialog menu search object audio video canvas map fieldset".split())
DROPPED_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner banners sponsor sponsored promo promos promotion nav navbar navigation menu menus breadcrumb breadcrumbs "
    "sidebar sidebars aside footer foot header masthead topbar toolbar comment comments disqus respond reply replies discussion notice notices alert cookie cookies consent gdpr modal popup "
    "overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations widget widgets pagination pager paging search skip hidden complementary contentinfo "
    "paywall copyright".split()
)
CONTENT_TAGS = frozenset(["article", "main"])
#: Of these words, the ones that also count on an article element itself.
READER_WORDS = frozenset("comment comments disqus reply replies discussion".split())


def _words(sig: str) -> list[str]:
    return [w for part in re.split(r"[.#@]", sig)[1:] for w in [part, *re.split(r"[^a-z]+", part)] if w]


def _is_dropped(sig: str, inside: bool) -> bool:
    tag = re.split(r"[.#@!]", sig, maxsplit=1)[0]
    if tag in DROPPED_TAGS or sig.endswith("!hidden") or tag == "header" and not inside:
        return True
    marks = READER_WORDS if tag in CONTENT_TAGS else () if tag in ("html", "body") else DROPPED_WORDS
    return any(w in marks for w in _words(sig))


def _is_content(sig: str) -> bool:
    tag = re.split(r"[.#@!]", sig, maxsplit=1)[0]
    return tag in CONTENT_TAGS or "@main" in sig




def read(source: str) -> Page:
    return parse(source, _is_dropped, _is_content)


def _hash(path: int, text: str) -> int:
    return xxhash.xxh3_64_intdigest(f"{path} {text}") >> 1


# ---- union-free expressions --------------------------------------------------------------------------------------
# A token is a list: path, literal text's hash or 0, dropped, in content, pages that have it, characters, those in
# links, and the lengths of the repeated groups that end with it, as bits. Characters are sums over pages.
PATH, LITERAL, DROPPED, CONTENT, PAGES, CHARS, LINKS, GROUP = range(8)


def _same(a: list, b: list) -> bool:
    return a[PATH] == b[PATH] and a[LITERAL] == b[LITERAL]


def _both(a: list, b: list, one_page: bool) -> list:
    """Two tokens at one place; those of one page are counted once."""
    return [*a[:PAGES], max(a[PAGES], b[PAGES]) if one_page else a[PAGES] + b[PAGES], a[CHARS] + b[CHARS], a[LINKS] + b[LINKS], a[GROUP] | b[GROUP]]


def fold(tokens: list[list]) -> tuple[list[list], list[int]]:
    """Neighbouring equal runs of up to PERIOD tokens as one repeated group; and the place of each token in the result."""
    out: list[list] = []
    held: list[list[int]] = []  # the given tokens at each place
    for i, token in enumerate(tokens):
        out.append(list(token))
        held.append([i])
        more = True
        while more:
            more = False
            for n in range(1, min(PERIOD, len(out) // 2) + 1):
                if all(_same(out[-n + k], out[-2 * n + k]) for k in range(n)):
                    for k in range(n):
                        out[-2 * n + k] = _both(out[-2 * n + k], out[-n + k], one_page=True)
                        held[-2 * n + k] += held[-n + k]
                    out[-n - 1][GROUP] |= 1 << n
                    del out[-n:], held[-n:]
                    more = True
                    break
    places = [0] * len(tokens)
    for place, those in enumerate(held):
        for i in those:
            places[i] = place
    return out, places


def tokens_of(page: Page, literals: Collection[int] = ()) -> list[list]:
    out = []
    for b in page.blocks:
        h = _hash(b.path, b.text)
        out.append([b.path, h if h in literals and not b.content else 0, int(b.dropped), int(b.content), 1, len(b.text), b.link_chars, 0])
    return out


def expression(page: Page, literals: Collection[int] = ()) -> dict:
    """The expression of one page: n pages, t tokens, and p the parents of paths, for pages without a content element."""
    out = {"n": 1, "t": fold(tokens_of(page, literals))[0]}
    if any(t[CONTENT] and not t[DROPPED] for t in out["t"]):
        return out | {"p": {}}
    return out | {"p": {str(k): [up, int(textual)] for k, (up, textual) in page.paths.items()}}


def matches(a: list[list], b: list[list]) -> list[tuple[int, int]]:
    """Places (in a, in b) of a longest common subsequence of two lists of tokens; of several the one that goes on in a first.

    Time grows with the product of what lies between the common beginning and end, memory with the second and the root of the first.
    """
    head = 0
    while head < min(len(a), len(b)) and _same(a[head], b[head]):
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and _same(a[-1 - tail], b[-1 - tail]):
        tail += 1
    out = [(i, i) for i in range(head)]
    x, y = a[head : len(a) - tail], b[head : len(b) - tail]
    if x and y:
        names: dict[tuple, int] = {}
        kx, ky = (np.array([names.setdefault((t[PATH], t[LITERAL]), len(names)) for t in z]) for z in (x, y))

        def above(below: np.ndarray, i: int) -> np.ndarray:
            """Row i of the lengths from row i + 1: the most that goes on from each place of y."""
            row = np.zeros_like(below)
            row[:-1] = np.maximum.accumulate(np.maximum(below[:-1], np.where(ky == kx[i], below[1:] + 1, 0))[::-1])[::-1]
            return row

        # Every step-th row of the lengths is kept, those between are made again on the way: any length fits in memory.
        step = math.isqrt(len(x)) + 1
        row = np.zeros(len(y) + 1, np.int32)
        kept = {len(x): row}
        for i in range(len(x) - 1, -1, -1):
            row = above(row, i)
            if i % step == 0:
                kept[i] = row
        i = j = 0
        near: dict[int, np.ndarray] = {}
        while i < len(x) and j < len(y):
            if i + 1 not in near:
                end = min((i // step + 1) * step, len(x))
                near = {end: kept[end]}
                for r in range(end - 1, i, -1):
                    near[r] = above(near[r + 1], r)
                near[i] = kept[i] if i in kept else above(near[i + 1], i)
            if kx[i] == ky[j]:
                out.append((head + i, head + j))
                i, j = i + 1, j + 1
            elif near[i + 1][j] >= near[i][j + 1]:
                i += 1
            else:
                j += 1
    return out + [(len(a) - k, len(b) - k) for k in range(tail, 0, -1)]


def merge(a: dict, b: dict) -> dict:
    """Two expressions aligned: what both have becomes one token, what one lacks is optional."""
    out, i, j = [], 0, 0
    for x, y in [*matches(a["t"], b["t"]), (len(a["t"]), len(b["t"]))]:
        out += a["t"][i:x] + b["t"][j:y]
        if x < len(a["t"]):
            out.append(_both(a["t"][x], b["t"][y], one_page=False))
        i, j = x + 1, y + 1
    return {"n": a["n"] + b["n"], "t": _bounded(out), "p": a["p"] | b["p"]}


def _bounded(tokens: list[list]) -> list[list]:
    """A token has PLACES places at most, so that an expression grows with the template and not with the pages."""
    seen: dict[tuple[int, int], list[int]] = {}
    out: list[list] = []
    for t in tokens:
        at = seen.setdefault((t[PATH], t[LITERAL]), [])
        if len(at) < PLACES:
            at.append(len(out))
            out.append(t)
        else:
            out[at[-1]] = _both(out[at[-1]], t, one_page=False)
    return out


def to_text(wrapper: dict) -> str:
    """The wrapper as a regular expression over numbered paths, for people."""
    names: dict[int, str] = {}
    out: list[str] = []
    for t in wrapper["t"]:
        name = names.setdefault(t[PATH], f"p{len(names) + 1}")
        out.append(f"{name}:{'literal' if t[LITERAL] else '#TEXT'}{'?' if t[PAGES] < wrapper['n'] else ''}")
        for n in range(1, PERIOD + 1):
            if t[GROUP] >> n & 1:
                out[-n:] = [f"({' '.join(out[-n:])})+" if n > 1 else f"{out[-1]}+"]
    return " ".join(out)


# ---- content slots -----------------------------------------------------------------------------------------------


def content_slots(wrapper: dict) -> list[bool]:
    """By token, whether it is a slot of main text.

    Parts that never hold main text are not, nor are literals. Of the rest, slots in an article or main element count if
    there are any; else those in the smallest element that holds most of the text, without slots that are mostly links.
    """
    tokens = wrapper["t"]
    free = [not t[DROPPED] and not t[LITERAL] for t in tokens]
    if any(f and t[CONTENT] for f, t in zip(free, tokens, strict=True)):
        return [f and bool(t[CONTENT]) for f, t in zip(free, tokens, strict=True)]
    free = [f and 2 * t[LINKS] <= t[CHARS] for f, t in zip(free, tokens, strict=True)]
    up = {int(k): v for k, v in wrapper["p"].items()}  # parents come first
    mass: dict[int, int] = {}
    for f, t in zip(free, tokens, strict=True):
        if f:
            mass[t[PATH]] = mass.get(t[PATH], 0) + t[CHARS]
    heaviest: dict[int, int] = {}
    for path in reversed(up):
        if path in mass:
            parent = up[path][0]
            mass[parent] = mass.get(parent, 0) + mass[path]
            if parent not in heaviest or (mass[path], path) > (mass[heaviest[parent]], heaviest[parent]):
                heaviest[parent] = path
    root = 0
    while root in heaviest and mass[heaviest[root]] >= 0.6 * mass[root] and not up[heaviest[root]][1]:
        root = heaviest[root]
    inside = {0: root == 0}
    for path, (parent, _) in up.items():
        inside[path] = path == root or inside.get(parent, False)
    return [f and inside.get(t[PATH], root == 0) for f, t in zip(free, tokens, strict=True)]


def main_text(page: Page, wrapper: dict | None, literals: Collection[int], slots: list[bool] | None = None) -> str:
    """The page's blocks at the wrapper's content slots.

    Blocks that the alignment leaves over go by the slots of their path, if the wrapper has it. A page without any kept
    block is of another layout and goes by its own expression.
    """
    every = tokens_of(page, literals)
    folded, places = fold(every)
    kept = [False] * len(every)
    if wrapper:
        slots = content_slots(wrapper) if slots is None else slots
        of_path: dict[int, bool] = {}
        for t, s in zip(wrapper["t"], slots, strict=True):
            if not t[LITERAL]:
                of_path[t[PATH]] = of_path.get(t[PATH], False) or s
        at = dict(matches(folded, wrapper["t"]))
        kept = [slots[at[p]] if p in at else not t[LITERAL] and of_path.get(t[PATH], False) for t, p in zip(every, places, strict=True)]
    if every and not any(kept):
        own = content_slots(expression(page, literals))
        kept = [own[p] for p in places]
    return "\n\n".join(b.text for b, k in zip(page.blocks, kept, strict=True) if k)


# ---- Spark -------------------------------------------------------------------------------------------------------

HOST = "coalesce(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '')"


def literal_texts(pages: DataFrame) -> DataFrame:
    """(host, literals array<long>) of hosts that have any, from all rows of pages (host, html); at most some for each block of a page.

    Candidates are texts that enough pages share. Of the pages that hold one, those count that have different titles
    (if the host has different ones) and different longest other texts, and at most twice as many characters in
    candidates as in others.
    """

    def facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = ([], [], [], [], [])
            for source in common.strings(batch.column(1)):
                page = read(source)
                article = max((b.text for b in page.blocks if b.content and not b.dropped), key=lambda t: (len(t), t), default="")
                loose = sorted({(-len(b.text), _hash(b.path, b.text)) for b in page.blocks if not b.content and not b.dropped})
                for x, v in zip(out, (_hash(0, page.title), _hash(0, article) if article else None, len(article), [h for _, h in loose], [-n for n, _ in loose]), strict=True):
                    x.append(v)
            types = pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x, t) for x, t in zip(out, types, strict=True)]], ["host", "title", "article", "chars", "texts", "sizes"])

    seen = common.materialize(common.map_batches(pages, facts, "host string, title long, article long, chars long, texts array<long>, sizes array<long>"), "pagefacts")
    longest = F.coalesce("article", F.expr("get(texts, 0)"))
    hosts = seen.groupBy("host").agg(F.count_distinct(longest).alias("bodies"), F.count_distinct("title").alias("titles"))
    often = seen.select("host", F.explode("texts").alias("text")).groupBy("host", "text").agg(F.count("*").alias("n")).where(F.col("n") >= LITERAL_PAGES)
    often = often.join(hosts, "host").where("2 * n >= bodies").groupBy("host", "bodies", "titles").agg(F.collect_list("text").alias("shared"))
    often = common.materialize(often, "shared")
    met = seen.join(often, "host").withColumn("others", F.expr("filter(arrays_zip(texts, sizes), x -> NOT array_contains(shared, x.texts))"))
    sum_of = lambda column: f"aggregate({column}, 0L, (s, n) -> s + n)"
    met = met.select("host", "bodies", "titles", "title", F.expr("coalesce(article, get(others, 0).texts)").alias("body"),
                     F.expr(f"{sum_of('sizes')} <= 3 * ({sum_of('others.sizes')}) + 2 * chars").alias("own"), F.explode(F.array_intersect("texts", "shared")).alias("text"))
    counted = met.groupBy("host", "text", "bodies", "titles").agg(F.count("*").alias("n"), F.count_distinct(F.when(F.col("own"), F.col("body"))).alias("d"), F.count_distinct(F.when(F.col("own"), F.col("title"))).alias("t"))
    counted = counted.withColumn("least", F.expr("CASE WHEN titles > 1 THEN least(d, t) ELSE d END"))
    return counted.where(f"least >= {LITERAL_PAGES} AND 2 * least >= n AND 2 * least >= bodies").groupBy("host").agg(F.sort_array(F.collect_list("text")).alias("literals"))


def _merged(found: list[str]) -> dict:
    out = None
    for w in sorted(found):
        out = json.loads(w) if out is None else merge(out, json.loads(w))
    return out


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, wrapper as JSON) inferred from all rows of pages (host, html, literals)."""

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple, dict] = {}

        def emit() -> pa.RecordBatch:
            rows = [(host, xxhash.xxh3_64_intdigest(repr(stream)) >> 1, json.dumps(w)) for (host, stream), w in known.items()]
            known.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int64(), pa.string()))], ["host", "stream", "wrapper"])

        for batch in batches:
            for host, source, literals in zip(batch.column(0).to_pylist(), common.strings(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                page = read(source)
                if page.blocks:
                    e = expression(page, frozenset(literals or ()))
                    key = host, tuple((t[PATH], t[LITERAL], t[GROUP]) for t in e["t"])
                    known[key] = merge(known[key], e) if key in known else e
            if len(known) > STREAMS:
                yield emit()
        yield emit()

    def same(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"host": [rows["host"].iloc[0]], "stream": [rows["stream"].min()], "wrapper": [json.dumps(_merged(list(rows["wrapper"])))]})

    schema = "host string, stream long, wrapper string"
    made = common.materialize(common.map_batches(pages.select("host", "html", "literals"), begin, schema), "streams")
    while True:
        sizes = made.groupBy("host").agg(F.count_distinct("stream").alias("streams"))
        most = sizes.agg(F.max("streams")).first()[0] or 0
        dealt = made.join(sizes, "host").withColumn("part", F.expr(f"pmod(stream, CAST(ceil(streams / {FAN}) AS BIGINT))"))
        made = common.materialize(dealt.select("host", "part", "stream", "wrapper").groupBy("host", "part").applyInPandas(same, schema), "wrappers")
        if most <= FAN:
            return made.select("host", "wrapper")


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text) of every row of pages (page_id, url, html), by its host's wrapper.

    A page without a block at its host's content slots is of another layout and goes by its own expression. Pages
    without a host share one wrapper. A null or empty html, and a page without main text, give the empty text; repeated rows
    give equal results, and however often a page is repeated, it keeps its text; an empty table gives no rows; other
    columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[str, tuple[dict, list[bool], frozenset]] = {}
        for batch in batches:
            texts = []
            if len(made) > STREAMS:
                made.clear()
            for host, source, wrapper, literals in zip(batch.column(2).to_pylist(), common.strings(batch.column(3)), batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True):
                if wrapper and host not in made:
                    w = json.loads(wrapper)
                    made[host] = w, content_slots(w), frozenset(literals or ())
                w, slots, known = made.get(host, (None, None, frozenset()))
                texts.append(main_text(read(source), w, known, slots))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    hosted = pages.select("page_id", "url", F.expr(HOST).alias("host"), "html")
    # Tables by host are written first: Spark then knows their size, broadcasts them only if small, and else splits a hot host.
    literals = common.materialize(literal_texts(hosted.select("host", "html")), "literals")
    found = wrappers(hosted.join(literals, "host", "left"))
    both = common.materialize(found.join(literals, "host", "left"), "hosts")
    return common.map_batches(hosted.join(both, "host", "left").select("page_id", "url", "host", "html", "wrapper", "literals"), run, "page_id long, url string, text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(common.table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))
