"""Quality rules as weak supervision, with DataFrame functions only.

Each rule votes good (1) or bad (-1) on a document, or abstains (0). The votes' patterns are counted over the whole corpus
(their number is bounded by 2 to the number of rules); expectation-maximisation on these counts estimates, for each
rule, how often it votes on good and on bad documents, and the share of good documents. The posterior probability
that a document is good then takes the place of a demand that it pass every rule.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandgraph.llm import common

WHITE = r"[\x20\x09-\x0D]+"
#: (name, vote, condition): the rule gives its vote where the condition holds and abstains elsewhere. A rule has one
#: side only: passing a check for one fault says little about all others. Columns are those of features().
RULES = (
    ("short", -1, "n_words < 50"),
    ("endless", -1, "n_words > 200000"),
    ("repetition", -1, "n_repeat_words > 0.3 * n_words"),
    ("symbols", -1, "n_symbols > 0.15 * n_words"),
    ("lines", -1, "n_lines > 2 AND n_dup_lines > 0.35 * n_lines"),
    ("capitals", -1, "n_upper > 0.4 * n_letters"),
    ("wordlike", -1, "n_letters < 0.6 * word_chars"),
    ("variety", -1, "n_words >= 50 AND n_distinct < 0.1 * n_words"),
    ("shouting", -1, "n_exclaim > 0.3 * n_words"),
    ("word_length", -1, "word_chars < 2.5 * n_words OR word_chars > 14 * n_words"),
    ("prose", 1, "n_symbols < 0.05 * n_words AND n_letters > 0.7 * word_chars AND n_exclaim < 0.1 * n_words"),
    ("varied", 1, "n_repeat_words < 0.2 * n_words AND (n_lines < 3 OR n_dup_lines < 0.35 * n_lines)"),
    ("cased", 1, "n_upper < 0.2 * n_letters AND word_chars BETWEEN 3 * n_words AND 12 * n_words"),
)
#: Starting values: the share of good documents, and how often a rule votes where it is right and where it is wrong.
PRIOR_GOOD, RIGHT, WRONG, STEPS = 0.8, {-1: 0.15, 1: 0.95}, {-1: 0.003, 1: 0.3}, 100
#: What the starting chances on good documents weigh against the corpus: without it the class of bad documents can
#: settle on the faults that come together and take a fault that comes alone for a habit of good documents.
TRUST = 0.1
#: Documents with a smaller posterior are rejected.
LEAST_POSTERIOR = 0.5


def _count_of(text: Column, pattern: str) -> Column:
    """Number of code points of text in the complement of pattern's class."""
    return F.length(F.regexp_replace(text, pattern, ""))


def features(docs: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Counts of each row's whole text, by doc_id and the columns in keep; a null text has none of anything.

    n_repeat_words counts the words that lie in a window of three words found twice or more in the text. Windows are
    compared by a 64-bit hash.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    words = docs.select("doc_id", *keep, text.alias("text")).select(
        "doc_id",
        *keep,
        "text",
        F.expr(f"filter(split(text, '{WHITE}'), w -> w <> '')".replace("\\", "\\\\")).alias("words"),
        F.expr("filter(split(text, '\\n'), l -> trim(BOTH ' \\t\\n\\u000b\\u000c\\r' FROM l) <> '')").alias("lines"),
    )
    counted = words.select(
        "doc_id",
        *keep,
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        _count_of(F.col("text"), r"[^#*$%&|<>]+").cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _count_of(F.col("text"), r"[^\p{L}]+").cast("long").alias("n_letters"),
        _count_of(F.col("text"), r"[^\p{Lu}]+").cast("long").alias("n_upper"),
        _count_of(F.col("text"), r"[^!]+").cast("long").alias("n_exclaim"),
        F.size(F.array_distinct("words")).cast("long").alias("n_distinct"),
        F.expr("""transform(arrays_zip(slice(words, 1, greatest(size(words) - 2, 0)), slice(words, 2, greatest(size(words) - 2, 0)), slice(words, 3, greatest(size(words) - 2, 0))),
                      (w, i) -> struct(xxhash64(w.`0`, w.`1`, w.`2`) AS h, i AS p))""").alias("windows"),
    )
    seen_twice = counted.withColumn(
        "windows", F.expr("CASE WHEN size(array_distinct(windows.h)) = size(windows) THEN slice(windows, 1, 0) ELSE sort_array(windows) END")
    )
    neighbours = seen_twice.withColumn(
        "positions",
        F.expr("""sort_array(transform(filter(
                arrays_zip(windows, concat(array(named_struct('h', CAST(NULL AS BIGINT), 'p', 0)), slice(windows, 1, greatest(size(windows) - 1, 0))), slice(windows, 2, size(windows))),
                z -> coalesce(z.windows.h = z.`1`.h, false) OR coalesce(z.windows.h = z.`2`.h, false)), z -> z.windows.p))"""),
    )
    covered = F.expr("aggregate(positions, named_struct('n', 0L, 'last', -3), (s, p) -> named_struct('n', s.n + least(3, p - s.last), 'last', p), s -> s.n)")
    return neighbours.select(*[c for c in counted.columns if c != "windows"], covered.alias("n_repeat_words"))


def _start(side: int) -> tuple[float, float]:
    return (RIGHT[1], WRONG[1]) if side > 0 else (WRONG[-1], RIGHT[-1])


def estimate(patterns: Sequence[tuple[tuple[bool, ...], int]], sides: Sequence[int], steps: int = STEPS) -> tuple[float, list[tuple[float, float]]]:
    """(share of good, for each rule how often it votes on good and on bad documents) by expectation-maximisation.

    patterns: which rules vote, with the number of documents. The starting chances on good documents count as TRUST
    times the corpus; one pseudo-document of each class keeps the chances off 0 and 1.
    """
    prior, chance = PRIOR_GOOD, [_start(x) for x in sides]
    total = sum(n for _, n in patterns)
    weight = 1 + TRUST * total
    for _ in range(steps):
        good, sums = 0.0, [[0.0, 0.0] for _ in sides]
        for votes, n in patterns:
            p = _posterior(votes, prior, chance)
            good += n * p
            for s, v in zip(sums, votes, strict=True):
                if v:
                    s[0] += n * p
                    s[1] += n * (1 - p)
        starts = [_start(x) for x in sides]
        new = (good + PRIOR_GOOD) / (total + 1), [((g + weight * x) / (good + weight), (b + y) / (total - good + 1)) for (g, b), (x, y) in zip(sums, starts, strict=True)]
        moved = abs(new[0] - prior) + sum(abs(x - y) for p, q in zip(new[1], chance, strict=True) for x, y in zip(p, q, strict=True))
        prior, chance = new
        if moved < 1e-9:
            break
    return prior, chance


def _weights(prior: float, chance: list[tuple[float, float]]) -> tuple[float, list[tuple[float, float]]]:
    """Log-odds of the share of good; of each rule's vote and of its abstention."""
    least = 1e-9
    odds = lambda a, b: math.log(max(a, least) / max(b, least))
    return odds(prior, 1 - prior), [(odds(g, b), odds(1 - g, 1 - b)) for g, b in chance]


def _posterior(votes: Sequence[bool], prior: float, chance: list[tuple[float, float]]) -> float:
    base, weights = _weights(prior, chance)
    score = base + sum(w[0] if v else w[1] for v, w in zip(votes, weights, strict=True))
    return 1 / (1 + math.exp(-max(-700.0, min(700.0, score))))


def judge(counts: DataFrame, rules: Sequence[tuple[str, int, str]] = RULES) -> DataFrame:
    """counts with vote_<rule> and posterior (double): the chance that a row is good, estimated from all rows.

    counts is read twice: give it materialised. An empty table gives no rows.
    """
    names = [f"vote_{name}" for name, *_ in rules]
    voted = counts.select("*", *[F.when(F.expr(when), side).otherwise(0).alias(f"vote_{name}") for name, side, when in rules])
    found = voted.groupBy(*names).count().collect()  # at most 2 ** len(rules) rows
    prior, chance = estimate(sorted((tuple(v != 0 for v in r[:-1]), r[-1]) for r in found), [side for _, side, _ in rules])
    base, weights = _weights(prior, chance)
    score = F.lit(base)
    for name, (vote, none) in zip(names, weights, strict=True):
        score = score + F.when(F.col(name) != 0, vote).otherwise(none)
    return voted.withColumn("posterior", 1 / (1 + F.exp(-score)))


def assess(docs: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """features() and judge() of docs with base_failed and kept.

    Kept are rows that don't fail the base rules (under 50 words, or over half of the words repeated) and whose
    posterior is LEAST_POSTERIOR or more. Texts that are null or empty fail; repeated rows get equal results; other
    columns are ignored but for those in keep, which stay beside the counts.
    """
    failed = F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words")
    judged = judge(common.materialize(features(docs, keep), "quality")).withColumn("base_failed", failed)
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= LEAST_POSTERIOR))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assess(common.table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents that the rules keep."""
    return assess(docs.withColumn("_doc", F.struct(*docs.columns)), ["_doc"]).where("kept").select("_doc.*")
