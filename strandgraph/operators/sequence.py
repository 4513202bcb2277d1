"""Record processing and windows over sequences.

Records are rows (id, seq) or (head, comment, seq); record scripts are SQL expressions over their columns, so Catalyst
checks them before anything runs, prunes what they don't use and compiles them.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from string import ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandgraph.functions import residues as R


def cleaned(df: DataFrame, text: str = "text", valid: str = "a-zA-Z") -> DataFrame:
    """df with seq: the valid characters of text in upper case."""
    return df.withColumn("seq", F.upper(R.clean(F.col(text), valid)))


def windows(df: DataFrame, length: int = 15, step: int = 5, by: str = "id", keep: Sequence[str] = ()) -> DataFrame:
    """(by, keep..., start, end, peptide_id, seq): windows of length residues every step residues; 1-based, end included.

    Sequences shorter than a window have none. keep: columns that every window of a sequence carries along.
    """
    # Taking a substring counts characters from the start of a text, so a window is taken from bytes where every character is
    # one, and else put together from blocks that a text is cut into once: both in linear time. explode_outer() keeps Spark
    # from making the sequence twice, once more for a filter that it infers.
    block, n = math.gcd(length, step), F.length("seq")
    plain = F.octet_length("seq") == n
    whole = df.select(by, *keep, F.when(plain, F.col("seq").cast("binary")).alias("bytes"), F.when(~plain, F.regexp_extract_all("seq", F.lit(f"(?s).{{1,{block}}}"), F.lit(0))).alias("blocks"), n.alias("n"))
    at = whole.select(by, *keep, "bytes", "blocks", F.explode_outer(F.when(F.col("n") >= length, F.sequence(F.lit(0), F.col("n") - length, F.lit(step)))).alias("i")).where("i IS NOT NULL")
    seq = F.when(F.col("blocks").isNull(), F.substring("bytes", F.col("i") + 1, F.lit(length)).cast("string")).otherwise(F.expr(f"array_join(slice(blocks, i DIV {block} + 1, {length // block}), '')"))
    return at.select(by, *keep, (F.col("i") + 1).alias("start"), (F.col("i") + length).alias("end"), F.concat_ws("-", by, F.col("i") + 1, F.col("i") + length).alias("peptide_id"), seq.alias("seq"))


def grep(df: DataFrame, predicate: str | Column) -> DataFrame:
    return df.where(predicate)


def sort(df: DataFrame, *keys: str | Column) -> DataFrame:
    """Records in order of key expressions."""
    return df.orderBy(*[F.expr(k) if isinstance(k, str) else k for k in keys])


def script(df: DataFrame, assign: Mapping[str, str], begin: Mapping[str, object] | None = None, where: str | None = None) -> DataFrame:
    """Each record with the assigned expressions; begin names constants that the expressions may use."""
    for name, value in (begin or {}).items():
        df = df.withColumn(name, F.lit(value))
    if where:
        df = df.where(where)
    return df.withColumns({k: F.expr(v) for k, v in assign.items()}).drop(*(begin or {}))


def totals(df: DataFrame, end: Mapping[str, str], by: Sequence[str] = ()) -> DataFrame:
    """The END block: aggregate expressions over all records, or over groups."""
    return df.groupBy(*by).agg(*[F.expr(v).alias(k) for k, v in end.items()])


def python_script(df: DataFrame, f: Callable, schema: str) -> DataFrame:
    """Records mapped by a Python function over batches, for what expressions cannot say."""
    return df.mapInPandas(f, schema)


def checked(df: DataFrame, expression: str) -> None:
    """Raises the analyser's error if an expression doesn't fit the records; runs nothing."""
    df.select(F.expr(expression)).schema  # noqa: B018


def check_options(grep: str | None = None, print_each: bool = False, sort_by: str | None = None, end: str | None = None, one_line: bool = False, line_length: int | None = None) -> None:
    """Raises for options that exclude one another."""
    for a, b, names in ((print_each, grep, "print_each and grep"), (sort_by, end, "sort_by and end"), (sort_by, print_each, "sort_by and print_each"), (one_line, line_length, "one_line and line_length")):
        if a and b:
            raise ValueError(f"{names} exclude each other")
    if line_length is not None and line_length <= 0:
        raise ValueError("line_length must be positive")


def letter_count(letter: str) -> Column:
    """How often one of A to Z is in seq, as an expression that code generation compiles; Spark splits by a single letter without a pattern."""
    return (F.size(F.split("seq", letter)) - 1).cast("long")


def residue_histogram(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, residue, n) over whole sequences: residues are counted inside each row, then summed by a partial aggregate."""
    letters = F.array(*[F.struct(F.lit(c).alias("residue"), letter_count(c).alias("n")) for c in ascii_uppercase])
    other = F.array_distinct(R.residues(F.col("_other")))  # none in most sequences: A to Z are counted without cutting a sequence up
    each = F.transform(other, lambda r: F.struct(r.alias("residue"), (F.length("seq") - F.length(F.replace(F.col("seq"), r, F.lit("")))).cast("long").alias("n")))
    counted = df.select(*by, "seq", F.regexp_replace("seq", "[A-Z]+", "").alias("_other")).where("seq IS NOT NULL")
    return counted.select(*by, F.explode(F.concat(letters, each)).alias("_r")).where("_r.n > 0").groupBy(*by, "_r.residue").agg(F.sum("_r.n").alias("n"))
