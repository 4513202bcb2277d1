"""Language identification by interpolated Kneser-Ney character models.

One model of ORDER characters for each language, over lower-cased letters with every run of other characters as one
space. The n-grams of all languages lie in sorted arrays of 64-bit hashes, one array for each order, with the
interpolated log-probability of every language beside them; an n-gram that no language has is scored by the languages'
back-off weights and the next lower order. A text gets the language of the lowest cross-entropy per character. It is
rejected if even that lies further above the language's usual value than calibration texts of its length do.

Fitted on a sample of about TRAIN_DOCS labelled documents for each language (taken by a hash of doc_id, so the same ones
each time), of which one in five serves for calibration; whole texts are used, in fitting and in scoring.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from strandgraph.llm import common

ORDER, TRAIN_DOCS = 4, 800
#: Calibration: the share of calibration texts that stay, and the slack beyond them.
KEEP, SLACK, LONGEST = 0.99, 2.0, 400
UNKNOWN = "und"
#: Characters scored at a time.
CHUNK = 1 << 20

_letters: np.ndarray | None = None


def _is_letter() -> np.ndarray:
    """By code point: whether str.isalpha() holds."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _letters


def normalise(text: str) -> np.ndarray:
    """Code points of the lower-cased letters, other runs and both ends as one space; empty without letters."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _is_letter()[points]
    if not letter.any():
        return points[:0]
    out = np.concatenate(([32], np.where(letter, points, 32), [32])).astype(np.uint32)
    keep = np.ones(len(out), bool)
    keep[1:] = (out[1:] != 32) | (out[:-1] != 32)
    return out[keep]


def _hashes(points: np.ndarray, order: int) -> np.ndarray:
    """A hash for each position with order characters up to it."""
    n = len(points) - order + 1
    h = np.zeros(max(n, 0), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(order):
            h = (h ^ points[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(31)
    return h


@dataclass
class Model:
    languages: list[str]
    keys: list[np.ndarray]  # by order - 1: sorted hashes
    logp: list[np.ndarray]  # beside them, by language
    context: list[np.ndarray]  # by length of the context - 1: sorted hashes
    backoff: list[np.ndarray]  # beside them, by language
    unseen: np.ndarray  # log-probabilities of a character that no language has
    usual: np.ndarray
    spread: np.ndarray

    def _lookup(self, keys: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        return at, keys[at] == h

    def scores(self, points: np.ndarray, order: int, at: np.ndarray | None = None) -> np.ndarray:
        """Log-probabilities by language of the characters at the given places (default: all that have a full context)."""
        n = len(self.keys) if order > len(self.keys) else order
        h = _hashes(points, n) if at is None else self._at(points, at, n)
        row, found = self._lookup(self.keys[n - 1], h)
        out = self.logp[n - 1][row]
        missing = np.flatnonzero(~found)
        if len(missing):
            place = missing + n - 1 if at is None else at[missing]
            if n == 1:
                out[missing] = self.unseen
            else:
                lower = self.scores(points, n - 1, place)
                row, known = self._lookup(self.context[n - 2], self._at(points, place - 1, n - 1))
                lower[known] += self.backoff[n - 2][row[known]]
                out[missing] = lower
        return out

    def _at(self, points: np.ndarray, at: np.ndarray, order: int) -> np.ndarray:
        h = np.zeros(len(at), np.uint64)
        with np.errstate(over="ignore"):
            for k in range(order):
                h = (h ^ points[at - order + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(31)
        return h

    def _total(self, points: np.ndarray) -> np.ndarray:
        """Log-probabilities by language, added up over the characters of one text, CHUNK at a time."""
        n, total = len(self.keys), np.zeros(len(self.languages))
        padded = np.concatenate((np.full(n - 1, 32, np.uint32), points))
        for at in range(0, len(points), CHUNK):
            total += self.scores(padded[at : at + CHUNK + n - 1], n).sum(0, np.float64)
        return total

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(cross-entropies by text and language in nats a character, characters); without letters 0 characters.

        Short texts are looked up together, but each is added up by itself: its values are the same in any batch.
        """
        n = len(self.keys)
        points = [normalise(t) for t in texts]
        size = np.array([len(p) for p in points])
        out, i = np.zeros((len(texts), len(self.languages))), 0
        pad = np.full(n - 1, 32, np.uint32)
        while i < len(texts):
            j, chars = i, 0
            while j < len(texts) and (size[j] > CHUNK or chars + size[j] <= CHUNK):
                chars += size[j] if size[j] <= CHUNK else 0
                j += 1
            some = [k for k in range(i, j) if 0 < size[k] <= CHUNK]
            if some:
                joined = np.concatenate([x for k in some for x in (pad, points[k])])
                each = self.scores(joined, n).astype(np.float64)  # one for each character from the first full context on
                starts = np.cumsum([0, *[size[k] + n - 1 for k in some]])[:-1]
                ends = starts + size[some]
                each = np.concatenate((each, np.zeros((1, each.shape[1]))))  # so that the last text has an end
                sums = np.add.reduceat(each, np.stack((starts, ends), 1).reshape(-1), 0)[::2]
                out[some] = -sums / size[some, None]
            for k in range(i, j):
                if size[k] > CHUNK:
                    out[k] = -self._total(points[k]) / size[k]
            i = j
        return out, size


def count_grams(texts: list[str], order: int) -> Counter:
    """n-grams of the normalised texts, each begun with order - 1 spaces."""
    found: Counter = Counter()
    for t in texts:
        p = normalise(t)
        if len(p):
            s = " " * (order - 1) + p.tobytes().decode("utf-32-le", "surrogatepass")
            found.update(map("".join, zip(*[s[k:] for k in range(order)], strict=False)))
    return found


def fit(counts: dict[str, dict[str, int]], order: int = ORDER) -> Model:
    """A model from each language's counts of n-grams of the highest order."""
    languages = sorted(counts)
    chars = {c for found in counts.values() for g in found for c in g}
    unseen = 1 / (len(chars) + 1)
    tables = []  # by language: by order: (n-gram -> count, context -> (sum, kinds), discount)
    for language in languages:
        level, levels = dict(counts[language]), []
        for n in range(order, 0, -1):
            total, kinds = defaultdict(int), defaultdict(int)
            for g, c in level.items():
                total[g[:-1]] += c
                kinds[g[:-1]] += 1
            once, twice = (sum(c == k for c in level.values()) for k in (1, 2))
            discount = once / (once + 2 * twice) if once and twice else 0.5
            levels.append((level, total, kinds, discount))
            lower: dict[str, int] = defaultdict(int)
            for g in level:  # how many characters precede it
                lower[g[1:]] += 1
            level = dict(lower) if n > 1 else {}
        tables.append(levels[::-1])
    keys, logp, context, backoff, known = [], [], [], [], {"": [unseen] * len(languages)}
    for n in range(order):
        now: dict[str, list[float]] = {}
        for g in {g for t in tables for g in t[n][0]}:
            row = []
            for k, t in enumerate(tables):
                level, total, kinds, discount = t[n]
                below, h = known[g[1:]][k], g[:-1]
                if h in total:
                    below = (max(level.get(g, 0) - discount, 0) + discount * kinds[h] * below) / total[h]
                row.append(below)
            now[g] = row
        hashed = _sorted({g: [math.log(x) for x in row] for g, row in now.items()}, n + 1)
        keys.append(hashed[0])
        logp.append(hashed[1])
        if n:
            contexts = {h for t in tables for h in t[n][1]}
            weights = {h: [math.log(t[n][3] * t[n][2][h] / t[n][1][h]) if h in t[n][1] else 0.0 for t in tables] for h in contexts}
            hashed = _sorted(weights, n)
            context.append(hashed[0])
            backoff.append(hashed[1])
        known = now
    many = len(languages)
    rest = np.array([math.log(t[0][3] * t[0][2][""] / t[0][1][""] * unseen) for t in tables], np.float32)
    return Model(languages, keys, logp, context, backoff, rest, np.zeros(many), np.full(many, np.inf))


def _sorted(rows: dict[str, list[float]], order: int) -> tuple[np.ndarray, np.ndarray]:
    points = np.frombuffer("".join(rows).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(rows), order)
    h = np.zeros(len(rows), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(order):
            h = (h ^ points[:, k]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(31)
    by = np.argsort(h)
    return h[by], np.array(list(rows.values()), np.float32)[by]


def held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


def train(labelled: DataFrame, order: int = ORDER, train_docs: int = TRAIN_DOCS) -> Model | None:
    """A calibrated model from (doc_id, text, lang); None if no row has both a text and a language.

    n-grams are counted on the executors; the driver receives the sample's counts and one row for each calibration text.
    """
    rows = labelled.where("text IS NOT NULL AND lang IS NOT NULL").select("doc_id", "text", "lang")
    sizes = dict(rows.groupBy("lang").count().collect())
    if not sizes:
        return None
    unit = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / float(1 << 20)
    share = F.coalesce(*[F.when(F.col("lang") == lang, min(1.0, train_docs / n)) for lang, n in sizes.items()])
    sample = common.materialize(rows.withColumn("share", share).where(unit < F.col("share")).withColumn("probe", F.pmod(F.hash("doc_id", "text"), F.lit(5)) == 0), "langsample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, Counter] = defaultdict(Counter)
        for batch in batches:
            for lang, text in zip(batch.column(1).to_pylist(), common.strings(batch.column(0)), strict=True):
                found[lang].update(count_grams([text], order))
        for lang, grams in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(list(grams), pa.string()), pa.array(list(grams.values()), pa.int64())], ["lang", "gram", "n"])

    counts: dict[str, dict[str, int]] = defaultdict(dict)
    for learn in (~F.col("probe"), F.lit(True)):  # a tiny sample may have calibration texts only
        grams = common.map_batches(sample.where(learn).select("text", "lang"), count, "lang string, gram string, n long")
        for lang, gram, n in grams.groupBy("lang", "gram").agg(F.sum("n")).collect():
            counts[lang][gram] = n
        if len(counts) == len(sizes):
            break
    if not counts:
        return None
    model = fit(counts, order)
    measured = score(sample.select("doc_id", "text", "lang", "probe"), model, keep=("lang", "probe")).where("n_letters > 0 AND lang_pred = lang")
    by_lang = defaultdict(list)
    for lang, probe, h, n in measured.select("lang", "probe", "entropy", "n_letters").collect():
        by_lang[lang].append((probe, h, n))
    for k, lang in enumerate(model.languages):
        rest = [(h, n) for probe, h, n in by_lang[lang] if probe] or [(h, n) for _, h, n in by_lang[lang]]
        if rest:
            h, n = map(np.array, zip(*rest, strict=True))
            model.usual[k] = np.median(h)
            model.spread[k] = max(np.quantile((h - model.usual[k]) * np.sqrt(np.minimum(n, LONGEST)), KEEP), 4.0) * SLACK
    return model


SCORED = "lang_pred string, score double, entropy double, n_letters long, rejected boolean"


def score(docs: DataFrame, model: Model | None, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, *keep, lang_pred, score, entropy, n_letters, rejected) of every row of docs (doc_id, text).

    lang_pred is UNKNOWN, with score 0 and rejected, if the text is null or has no letter (or nothing was learned); else
    the language of the lowest cross-entropy, ties to the first by name. score is its share when the languages'
    likelihoods of fifty characters are compared. Repeated rows get equal results.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # its size is bounded by the training sample
    first = ["doc_id", *keep]
    schema = StructType([*[docs.schema[c] for c in first], *StructType.fromDDL(SCORED).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            texts = common.strings(batch.column(len(first)))
            if model is None or not texts:
                rows = [(UNKNOWN, 0.0, None, 0, True)] * len(texts)
            else:
                h, n = model.entropies(texts)
                best = h.argmin(1)
                low = h[np.arange(len(h)), best]
                share = 1 / np.exp(-(h - low[:, None]) * np.minimum(n, 50)[:, None]).sum(1)
                over = (low - model.usual[best]) * np.sqrt(np.minimum(n, LONGEST)) > model.spread[best]
                rows = [(model.languages[b], float(s), float(e), int(k), bool(o)) if k else (UNKNOWN, 0.0, None, 0, True) for b, s, e, k, o in zip(best, share, low, n, over, strict=True)]
            columns = list(zip(*rows, strict=True)) or [()] * 5
            types = [pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in range(len(first))], *[pa.array(c, t) for c, t in zip(columns, types, strict=True)]], [*first, *[x.split()[0] for x in SCORED.split(", ")]])

    return common.map_batches(docs.select(*first, "text"), run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    model = train(docs.where(~held_out()))
    scored = score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "entropy", "rejected")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents whose language is known and not rejected; learned from the stage's own input."""
    scored = score(docs.withColumn("_doc", F.struct(*docs.columns)), train(docs), keep=("_doc",))
    return scored.where("NOT rejected").select("_doc.*")
