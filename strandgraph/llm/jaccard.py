"""Jaccard self-join of word shingles by a token-group matrix.

Documents of equal shingle sets are one class, found by a 128-bit digest before anything else; from there on, classes
are joined. The steps:

1. A sketch of SLOTS counters, filled over all documents, gives every shingle an order: shingles in rare slots first.
   Any order that all documents share is a right one, so collisions in the sketch cost time only.
2. Two sets with a Jaccard similarity of at least t share their first LEAST shared shingles within their prefixes of
   n - ceil(t n) + LEAST shingles. Only prefixes are moved.
3. Grouping, in TURNS rounds. In every list of one shingle and one band of set sizes, each class is held against one
   class of the list (a star, not all pairs). Links found are exact, and their connected components are the groups of
   similar documents; later rounds take other centres and only lists of several groups.
4. The matrix holds each group's union of prefix shingles: one row for a shingle and group. The overlap of a class with
   a group's union bounds its overlap with every member, so a group is opened for a class only if that bound reaches
   what the similarity needs, and links are only looked for between different groups, the smaller group asking the larger.
5. Members of opened groups that share as many prefix shingles with the asking class themselves are verified on their whole sets.
   Links of steps 3 and 5 together have the components of all links.

Classes of fewer than nine shingles (at t = 0.9) link with no other class; one of nine links with larger ones only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandgraph.llm import common
from strandgraph.llm.components import components

WORDS_EACH, PERCENT, LEAST, SLOTS, TURNS = 3, 90, 2, 1 << 17, 3
#: Words whose hashes are kept in a Python worker.
KEPT = 200_000


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= KEPT:
            self.clear()
        found = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            self[word] = found
        return found


_hashes = _Hashes()


def shingles(text: str, words_each: int = WORDS_EACH) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; the whole sequence if it is shorter; none without words."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: lower() and split() know ASCII only
    h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    if not len(h):
        return h
    n = max(1, len(h) - words_each + 1)
    mixed = np.full(n, min(len(h), words_each), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(min(len(h), words_each)):
            mixed = (mixed ^ h[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(32)
    mixed.sort()
    return mixed[np.concatenate(([True], mixed[1:] != mixed[:-1]))]


def _digest(s: np.ndarray) -> tuple[int, int]:
    d = xxhash.xxh3_128_digest(s.tobytes())
    return int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True)


def _sets(docs: DataFrame, words_each: int) -> DataFrame:
    """Rows (doc_id, n, d1, d2) of every document, and rows (slot, count) of the sketch with a null n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(SLOTS, np.int64)
        names = ["doc_id", "n", "d1", "d2", "slot", "count"]
        for batch in batches:
            rows = []
            for text in common.strings(batch.column(1)):
                s = shingles(text, words_each)
                np.add.at(sketch, (s % np.uint64(SLOTS)).astype(np.int64), 1)
                rows.append((len(s), *_digest(s)))
            none = pa.nulls(len(rows), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *[pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], none, none], names)
        at = np.flatnonzero(sketch)
        if len(at):
            none = pa.nulls(len(at), pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, none, none, pa.array(at, pa.int64()), pa.array(sketch[at], pa.int64())], names)

    return common.map_batches(docs.select("doc_id", "text"), run, "doc_id long, n long, d1 long, d2 long, slot long, count long")


def _order(sketch: DataFrame) -> np.ndarray:
    """The sketch's orders of magnitude by slot, one byte each: at most SLOTS rows come to the driver."""
    out = np.zeros(SLOTS, np.uint8)
    for slot, n in sketch.groupBy("slot").agg(F.sum("count").alias("n")).collect():
        out[slot] = int(n).bit_length()
    return out


def _ranked(s: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Shingles as sorted numbers whose upper six bits are the sketch's order of magnitude."""
    ranked = (order[(s % np.uint64(SLOTS)).astype(np.int64)].astype(np.uint64) << np.uint64(58)) | (s >> np.uint64(6))
    ranked.sort()
    return ranked


def least_overlap(n: int, percent: int = PERCENT) -> int:
    return -(-n * percent // 100)


def _links(n: int | Column, percent: int) -> bool | Column:
    """Whether a set of n can have the similarity with another set: a larger one if with any."""
    return 100 * n >= percent * (n + 1)


def _least_shared(percent: int) -> int:
    """The fewest shingles that two different sets of the similarity share: all but one of the smallest such union."""
    return -(-100 // (100 - percent)) - 1 if percent < 100 else 1


def _needed(n: str, low: str, high: str, percent: int, least: int) -> str:
    """SQL for the number of prefix shingles that a set of n must share with one of low to high for the similarity.

    Shared shingles beyond the prefix that ends first all lie in that set's rest of ceil(t n) - least shingles.
    """
    overlap = f"({percent} * ({n} + {low}) + {99 + percent}) DIV {100 + percent}"
    rest = f"(greatest({n}, {high}) * {percent} + 99) DIV 100 - {least}"
    return f"greatest({least}, {overlap} - ({rest}))"


def _prefixes(docs: DataFrame, order: np.ndarray, words_each: int, percent: int, least: int) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(order)  # SLOTS bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = ([], [], [], [])
            for doc_id, text in zip(batch.column(0).to_pylist(), common.strings(batch.column(1)), strict=True):
                s = shingles(text, words_each)
                if _links(len(s), percent):
                    for x, v in zip(out, (doc_id, _digest(s)[0], len(s), _ranked(s, shared.value)[: len(s) - least_overlap(len(s), percent) + least].view(np.int64)), strict=True):
                        x.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.list_(pa.int64()))], ["u", "d1", "n", "tokens"])

    return common.map_batches(docs.select("doc_id", "text"), run, "u long, d1 long, n long, tokens array<long>")


def _whole_sets(docs: DataFrame, words_each: int) -> DataFrame:
    """(u, d1, set): the sorted shingles as 64-bit numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t, words_each) for t in common.strings(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array([_digest(s)[0] for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["u", "d1", "set"])

    return common.map_batches(docs.select("doc_id", "text"), run, "u long, d1 long, set binary")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets have the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                s, t = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = np.concatenate((s, t))
                both.sort(kind="stable")  # two sorted runs
                same = int(np.count_nonzero(both[1:] == both[:-1]))
                keep.append(100 * same >= percent * (len(both) - same))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    full = pairs.join(sets.select(F.col("u").alias("a"), F.col("set").alias("s")), "a").join(sets.select(F.col("u").alias("b"), F.col("set").alias("t")), "b")
    return common.map_batches(full.select("a", "b", "s", "t"), run, "a long, b long")


def _grouped(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """rows with the group g of u, which is u itself where groups has none."""
    return rows.join(groups, "u", "left").withColumn("g", F.coalesce("g", "u"))


def _mixed(rows: DataFrame) -> DataFrame:
    """Shingles that classes of more than one group have."""
    return rows.groupBy("token").agg(F.min("g").alias("x"), F.max("g").alias("y")).where("x <> y").select("token")


def similar(docs: DataFrame, words_each: int = WORDS_EACH, percent: int = PERCENT, least: int = LEAST) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_shingles and component_id, the smallest doc_id reachable by links.

    Two documents link when 100 * |intersection| >= percent * |union| of their sets of shingles. Documents without words
    (null, empty or blank texts) have no shingles and link with nothing. Rows of equal doc_id are one document for
    links; each row keeps its own n_shingles. An empty table gives no rows; other columns are ignored.
    """
    least = min(least, _least_shared(percent))
    counted = common.materialize(_sets(docs, words_each), "sets")
    base = counted.where("n IS NOT NULL").select("doc_id", "n", "d1", "d2")
    order = _order(counted.where("slot IS NOT NULL"))
    classes = base.where("n > 0").groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("u"))
    classes = common.materialize(classes, "classes")
    key = classes.where(_links(F.col("n"), percent)).select("u", "d1")

    prefix = _prefixes(docs, order, words_each, percent, least).join(key, ["u", "d1"], "left_semi").dropDuplicates(["u", "d1"])
    rows = common.materialize(prefix.select("u", F.col("n").cast("int").alias("n"), F.explode("tokens").alias("token")), "prefixes")
    lists = rows.groupBy("token").agg(F.count("*").alias("listed")).where("listed > 1").select("token")
    rows = common.materialize(rows.join(lists, "token"), "lists")

    def sets_of(pairs: DataFrame) -> DataFrame:
        """The whole sets of the classes in pairs, made anew from their texts."""
        asked = key.join(pairs.select(F.col("a").alias("u")).union(pairs.select("b")).distinct(), "u")
        asked = common.materialize(asked, "asked")
        texts = common.matching(docs.select("doc_id", "text"), asked.select(F.col("u").alias("doc_id")).distinct(), "doc_id")
        made = _whole_sets(texts, words_each).join(asked, ["u", "d1"], "left_semi").dropDuplicates(["u", "d1"])
        return common.materialize(made, "whole")

    # Grouping. Round 0 takes as hub of a list the class with most listed shingles (the centre of a group of copies has
    # hardly any of its own), later rounds take other ones by hash; only lists of more than one group go on.
    band = F.floor(F.log("n") / -np.log(percent / 100)).cast("int")
    weight = rows.groupBy("u").agg(F.count("*").alias("weight"))
    rows = common.materialize(rows.join(weight, "u").withColumn("band", band), "weighted")
    tested, links, groups = None, None, None
    for turn in range(TURNS):
        live = rows.withColumn("g", F.col("u")) if groups is None else _grouped(rows, groups)
        live = live.join(_mixed(live), "token")
        first = F.struct(-F.col("weight"), "u", "n", "g") if turn == 0 else F.struct(F.xxhash64("u", F.lit(turn), F.pmod("token", F.lit(4))), "u", "n", "g")
        hubs = live.groupBy("token", "band").agg(F.min(first).alias("hub"))
        stars = live.join(hubs, ["token", "band"]).where("hub.g <> g").groupBy(F.col("hub.u").alias("a"), F.col("u").alias("b")).agg(F.count("*").alias("shared"))
        stars = stars.where(F.col("shared") >= least).select("a", "b")
        if tested is not None:
            stars = stars.join(tested, ["a", "b"], "left_anti")
        stars = common.materialize(stars, "stars")
        found = common.materialize(_verified(stars, sets_of(stars), percent), "starlinks")
        both = stars.union(stars.select("b", "a"))
        tested = both if tested is None else tested.union(both)
        if found.isEmpty():
            break
        links = found if links is None else links.unionByName(found)
        groups = components(links).select(F.col("node").alias("u"), F.col("component").alias("g"))
    if groups is None:
        links = found
        groups = links.select(F.col("a").alias("u"), F.col("b").alias("g"))  # none

    # The matrix of shingles and groups, for shingles that more than one group has.
    sized = groups.groupBy("g").agg(F.count("*").alias("members"))
    grouped = _grouped(rows, groups).join(sized, "g", "left").select("token", "u", "n", "g", F.coalesce("members", F.lit(1)).alias("members"))
    grouped = common.materialize(grouped.join(_mixed(grouped), "token"), "mixed")
    matrix = grouped.groupBy("token", "g", "members").agg(F.min("n").alias("least_n"), F.max("n").alias("most_n"))
    into = matrix.select("token", F.col("g").alias("into"), F.col("members").alias("into_members"), "least_n", "most_n")
    smaller = "(members < into_members OR members = into_members AND g < into)"
    opened = grouped.join(into, "token").where(f"g <> into AND {smaller} AND n * 100 >= {percent} * least_n AND {percent} * n <= 100 * most_n")
    opened = opened.groupBy("u", "n", "into").agg(F.count("*").alias("bound"), F.min("least_n").alias("low"), F.max("most_n").alias("high"))
    opened = opened.where(f"bound >= {_needed('n', f'greatest(low, n * {percent} DIV 100)', f'least(high, n * 100 DIV {percent})', percent, least)}")
    opened = common.materialize(opened.select("u", "into"), "opened")

    asking = grouped.select("token", "u", "n").join(opened, "u")
    members = grouped.select("token", F.col("g").alias("into"), F.col("u").alias("v"), F.col("n").alias("n_v"))
    pairs = asking.join(members, ["token", "into"]).where(f"100 * n >= {percent} * n_v AND {percent} * n <= 100 * n_v")
    pairs = pairs.groupBy(F.col("u").alias("a"), F.col("v").alias("b"), "n", "n_v").agg(F.count("*").alias("shared"))
    pairs = pairs.where(f"shared >= {_needed('n', 'n_v', 'n_v', percent, least)}").select("a", "b")
    pairs = common.materialize(pairs.join(tested, ["a", "b"], "left_anti"), "pairs")
    links = links.unionByName(_verified(pairs, sets_of(pairs), percent))

    found = components(links).select(F.col("node").alias("u"), "component")
    named = classes.join(found, "u", "left").select("n", "d1", "d2", F.coalesce("component", "u").alias("component_id"))
    out = base.join(named, ["n", "d1", "d2"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar(common.table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each group of near-duplicates the document of the smallest doc_id; five words, 80 in 100.

    Documents without words stay. Rows are told apart by doc_id and text; of equal rows one stays.
    """
    keyed = docs.withColumn("_key", F.xxhash64("doc_id", "text"))
    groups = similar(keyed.select(F.col("_key").alias("doc_id"), "text"), words_each=5, percent=80)
    groups = groups.select(F.col("doc_id").alias("_key"), "component_id")
    groups = common.materialize(keyed.select("_key", "doc_id").join(groups.distinct(), "_key"), "grouping")
    first = groups.groupBy("component_id").agg(F.min(F.struct("doc_id", "_key")).alias("first"))
    dropped = groups.select("_key").join(first.select(F.col("first._key").alias("_key")), "_key", "left_anti").distinct()
    kept = common.matching(keyed, common.materialize(dropped, "dropped"), "_key", anti=True)
    again = common.materialize(groups.groupBy("_key").count().where("count > 1").select("_key"), "again")
    if not again.isEmpty():  # equal rows, or by a rare chance different ones of one key, which stay both
        kept = common.matching(kept, again, "_key", anti=True).unionByName(common.matching(kept, again, "_key").dropDuplicates(["_key", "doc_id", "text"]))
    return kept.select(*docs.columns)
