"""How the filters of a corpus act on one another, in every order they may be applied in.

Each document fails some of five filters: its mask. Four look at the text alone; the fifth, exact duplicates, is found by
sorting: documents are dealt by ranges of (fingerprint, doc_id), sorted by (fingerprint, text, doc_id) within a range, and
each is held against its predecessor there. Copies that run on into later ranges are told by the ranges' ends: a range
reports the texts of its first and of its last fingerprint, and a text that ended an earlier range makes the rows that
begin this one duplicates. So a group of copies of any size is spread over tasks, and only a few texts for each task are
compared between tasks.

What an order of filters removes at a step depends on the masks alone, so masks are merged into counters by part, mask and
label, and all orders are read off these.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import permutations

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandgraph.llm import common

LETTERS = "ABCDE"
CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
#: Bytes that continue a character in UTF-8.
CONTINUED = bytes(range(0x80, 0xC0))


@dataclass(frozen=True)
class Limits:
    """Thresholds of the filters on single texts."""

    least_words: int = 100
    distinct_percent: int = 80
    capitals_percent: int = 10
    symbols: bytes = b"#$%&*|"

    def failed(self, text: bytes) -> int:
        """Bits A to D of a text: too few words, too few distinct ones, too many capitals, a symbol."""
        words = text.split()  # bytes split at exactly 0x20 and 0x09 to 0x0D
        capitals = len(text) - len(text.translate(None, CAPITALS))
        points = len(text.translate(None, CONTINUED))
        return (
            (len(words) < self.least_words)
            | (100 * len(set(words)) < self.distinct_percent * len(words)) << 1
            | (100 * capitals > self.capitals_percent * points) << 2
            | (len(text.translate(None, self.symbols)) < len(text)) << 3
        )


class Runs:
    """Goes through one range's rows in order of (fingerprint, text, doc_id) and tells duplicates.

    seen holds the texts of the present fingerprint with whether any has an id (one text, but for equal fingerprints of
    different texts).
    """

    def __init__(self) -> None:
        self.fingerprint = self.text = self.least = None
        self.leading, self.seen = True, []
        self.heads: list[tuple[int, bytes, int]] = []

    def step(self, fingerprint: int, text: bytes, doc_id) -> tuple[bool, int | None]:
        """(whether a row of this range with the same text has a smaller id, the text's number if its fingerprint begins the range)."""
        if fingerprint != self.fingerprint:
            self.leading = self.fingerprint is None
            self.fingerprint, self.text, self.seen = fingerprint, None, []
        if text != self.text:
            self.text, self.least = text, doc_id  # nulls come last: a null here means that none has an id
            self.seen.append((text, doc_id is not None))
            if self.leading:
                self.heads.append((fingerprint, text, len(self.seen) - 1))
        return doc_id is not None and self.least < doc_id, len(self.seen) - 1 if self.leading else None

    def tails(self) -> list[tuple[int, bytes, int]]:
        """Texts of the last fingerprint that have an id: any row of a later range with the same text has a greater one."""
        return [(self.fingerprint, text, i) for i, (text, has_id) in enumerate(self.seen) if has_id]


def masks(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """(doc_id, part, mask) of every row of docs (doc_id, text, lang): bit i is set where it fails the i-th filter.

    part is lang, null as the empty string. A null text is empty. A row fails E if any row has the same text and a
    smaller doc_id; rows with equal ids don't make each other fail, and a null id neither fails nor makes fail. Every
    text is taken whole, with those of 64-bit fingerprints compared byte by byte; other columns are ignored; an empty
    table has no rows.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), F.xxhash64(text).alias("fp"), text.cast("binary").alias("text"))
    late = F.asc_nulls_last("doc_id")
    dealt = keyed.repartitionByRange("fp", late).sortWithinPartitions("fp", "text", late)
    schema = f"kind int, doc_id {id_type}, part string, mask int, p int, run int, fp long, text binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, runs = TaskContext.get().partitionId(), Runs()
        kinds = None
        for batch in batches:
            kinds = kinds or pa.schema([("kind", pa.int32()), ("doc_id", batch.schema.field("doc_id").type), ("part", pa.string()), ("mask", pa.int32()), ("p", pa.int32()), ("run", pa.int32()), ("fp", pa.int64()), ("text", pa.binary())])
            ids, texts = batch["doc_id"].to_pylist(), batch["text"].to_pylist()
            found = [runs.step(*row) for row in zip(batch["fp"].to_pylist(), texts, ids, strict=True)]
            failed = [limits.failed(t) | twice << 4 for t, (twice, _) in zip(texts, found, strict=True)]
            n = len(ids)
            columns = [pa.array([0] * n), batch["doc_id"], batch["part"], pa.array(failed), pa.array([p] * n), pa.array([r for _, r in found], pa.int32()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary())]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, kinds, strict=True)], schema=kinds)
        ends = [(kind, *row) for kind, rows in ((1, runs.heads), (2, runs.tails())) for row in rows] if kinds else []
        for kind, fp, value, number in ends:
            yield pa.RecordBatch.from_pylist([{"kind": kind, "p": p, "run": number, "fp": fp, "text": value}], schema=kinds)

    told = common.materialize(common.map_batches(dealt, run, schema), "audit")
    # One row for each task and end of its range (and one more for each other text of that fingerprint).
    tails = told.where("kind = 2").groupBy("fp", "text").agg(F.min("p").alias("since"))
    heads = told.where("kind = 1").join(tails, ["fp", "text"]).where("since < p").select("p", "run", F.lit(True).alias("again"))
    rows = told.where("kind = 0").select("doc_id", "part", "mask", "p", "run").join(F.broadcast(heads), ["p", "run"], "left")
    return rows.select("doc_id", "part", F.col("mask").bitwiseOR(F.when(F.col("again") & F.col("doc_id").isNotNull(), 16).otherwise(0)).alias("mask"))


def counters(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, good, toxic, n): documents by part, failure mask and label: additive, so parts of a corpus add up.

    A document is good (toxic) if any row of labels (doc_id, quality, toxic) with its id has a 1 there.
    """
    each = masks.groupBy("doc_id", "part", "mask").agg(F.count("*").alias("n"))
    any_one = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False))).alias(f"_{c}")
    marks = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(any_one("quality"), any_one("toxic"))
    met = each.join(marks, "doc_id", "left").select("part", "mask", F.coalesce("_quality", F.lit(False)).alias("good"), F.coalesce("_toxic", F.lit(False)).alias("toxic"), "n")
    return met.groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n"))


def report(counted: DataFrame, letters: str = LETTERS) -> DataFrame:
    """One row for each part, order of the filters and step, from counters(); filter i of a mask is the i-th letter.

    kept and removed at the step, redundant (fails the step's filter, removed before), unique_fails (fails that filter
    alone), good_lost and toxic_lost (labelled ones of the removed), and shapley: what its filter removes over all orders.
    A document that fails k filters is removed by each of them in one k-th of the orders.
    """
    orders = ["".join(o) for o in permutations(letters)]
    by_mask = counted.groupBy("part").agg(F.collect_list(F.struct("mask", "good", "toxic", "n")).alias("c"))  # 4 * 2 ** filters at most
    steps = by_mask.select("part", "c", F.explode(F.lit(orders)).alias("filter_order"))
    steps = steps.select("*", F.split("filter_order", "").alias("o")).select("*", F.posexplode("o").alias("k", "letter"))
    bit = lambda x: F.call_function("shiftleft", F.lit(1), F.position(x, F.lit(letters)) - 1)
    steps = steps.withColumns({"bit": bit(F.col("letter")), "earlier": F.aggregate(F.slice("o", 1, F.col("k")), F.lit(0), lambda a, x: a.bitwiseOR(bit(x)))})
    total = lambda condition, times="1L": F.expr(f"aggregate(c, 0L, (a, x) -> a + IF({condition}, x.n * {times}, 0L))")
    removed = "(x.mask & bit) <> 0 AND (x.mask & earlier) = 0"
    return steps.select(
        "part", "filter_order", (F.col("k") + 1).cast("int").alias("step"),
        total("(x.mask & (bit | earlier)) = 0").alias("kept"),
        total(removed).alias("removed"),
        total("(x.mask & bit) <> 0 AND (x.mask & earlier) <> 0").alias("redundant"),
        total("x.mask = bit").alias("unique_fails"),
        total(f"{removed} AND x.good").alias("good_lost"),
        total(f"{removed} AND x.toxic").alias("toxic_lost"),
        total("(x.mask & bit) <> 0", f"({len(orders)}L DIV greatest(bit_count(x.mask), 1))").alias("shapley"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(counters(masks(common.table(spark, sf_dir, "documents")), common.table(spark, sf_dir, "labels")))


#: The same by definition: every order is walked through, and the sums over orders are summed.
SQL = r"""WITH RECURSIVE d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
    w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws, length(t) AS points, length(regexp_replace(t, '[^A-Z]', '', 'g')) AS caps FROM d),
    f AS (SELECT doc_id, part, len(ws) < 100 AS a, 100 * len(list_distinct(ws)) < 80 * len(ws) AS b, 100 * caps > 10 * points AS c, regexp_matches(t, '[#$%&*|]') AS d, coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS e FROM w),
    l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY 1),
    m AS (SELECT part, list_filter(['A', 'B', 'C', 'D', 'E'], lambda x, i: [a, b, c, d, e][i]) AS fails, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, count(*) AS n FROM f LEFT JOIN l USING (doc_id) GROUP BY ALL),
    o AS (SELECT '' AS s UNION ALL SELECT s || x FROM o, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x) WHERE NOT contains(s, x)),
    st AS (SELECT s AS filter_order, CAST(k AS INTEGER) AS step, substr(s, CAST(k AS INTEGER), 1) AS x, string_split(substr(s, 1, CAST(k AS INTEGER) - 1), '') AS earlier FROM (SELECT s, unnest(range(1, 6)) AS k FROM o WHERE length(s) = 5)),
    r AS (SELECT part, filter_order, step, x, list_contains(fails, x) AS hit, list_has_any(fails, earlier) AS gone, len(fails) AS k, good, toxic, n FROM m, st),
    c AS (SELECT part, filter_order, step, x, coalesce(sum(n) FILTER (NOT hit AND NOT gone), 0) AS kept, coalesce(sum(n) FILTER (hit AND NOT gone), 0) AS removed, coalesce(sum(n) FILTER (hit AND gone), 0) AS redundant, coalesce(sum(n) FILTER (hit AND k = 1), 0) AS unique_fails,
        coalesce(sum(n) FILTER (hit AND NOT gone AND good), 0) AS good_lost, coalesce(sum(n) FILTER (hit AND NOT gone AND toxic), 0) AS toxic_lost FROM r GROUP BY ALL)
    SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
        CAST(sum(removed) OVER (PARTITION BY part, x) AS BIGINT) AS shapley FROM c"""
