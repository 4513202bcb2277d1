"""Residue classes and scalar expressions over sequences."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Residues by class, for peptide layers (P) and domain layers (D). Other residues have the last label.
POLARITY = {"N": "AGILMFPWV", "P": ""}
CHARGE = {"A": "DE", "B": "RKH", "N": ""}
HYDROPHOBICITY = {"VH": "LVI", "H": "AMCF", "L": "GTSWYP", "VL": ""}


def _class(aa: Column, prefix: str, classes: dict[str, str]) -> Column:
    out = None
    for label, residues in reversed(classes.items()):
        value = F.lit(prefix + label)
        out = value if out is None else F.when(aa.isin(*residues), value).otherwise(out)
    return out


def polarity(aa: Column, side: str = "P") -> Column:
    return _class(aa, f"{side}P", POLARITY)


def charge(aa: Column, side: str = "P") -> Column:
    return _class(aa, f"{side}C", CHARGE)


def hydrophobicity(aa: Column, side: str = "P") -> Column:
    return _class(aa, f"{side}H", HYDROPHOBICITY)


def identity(aa: Column, side: str = "P") -> Column:
    return F.concat(F.lit(f"{side}A"), aa)


def clean(seq: Column, valid: str = "-a-zA-Z") -> Column:
    """Only the characters of the class valid."""
    return F.regexp_replace(seq, f"[^{valid}]+", "")


def residues(seq: Column) -> Column:
    """The array of residues; empty for the empty sequence."""
    return F.when(seq == "", F.array().cast("array<string>")).otherwise(F.split(seq, ""))


def counts(seq: pa.Array) -> pa.Array:
    """Each string's residues as "code:count" in order of codes, joined by spaces; for arrow_udf().

    A batch is counted in one matrix of its strings and its distinct residues, which should be few.
    """
    if seq.null_count:
        return pc.if_else(seq.is_valid(), counts(pc.fill_null(seq, "")), pa.scalar(None, pa.string()))
    n, seq = len(seq), seq.cast(pa.string())
    ends = np.frombuffer(seq.buffers()[1], np.int32, n + 1, 4 * seq.offset) if n else np.zeros(1, np.int32)
    text = seq.buffers()[2].slice(ends[0], ends[-1] - ends[0]).to_pybytes() if ends[-1] > ends[0] else b""
    codes, lengths = (np.frombuffer(text, np.uint8), np.diff(ends)) if text.isascii() else (np.frombuffer(text.decode().encode("utf-32-le"), np.uint32), pc.utf8_length(seq).to_numpy())
    total = np.bincount(codes)
    letters = np.flatnonzero(total)
    cells = np.repeat(np.arange(n) * len(letters), lengths) + (np.cumsum(total > 0) - 1)[codes]
    matrix = np.bincount(cells, minlength=n * len(letters))
    at = np.flatnonzero(matrix > 0)
    row, letter = np.divmod(at, max(len(letters), 1))
    most = matrix.max(initial=0) + 1
    words = pa.array([f"{c}:{k}" for c in letters for k in range(most)], pa.string())
    starts = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n))]).astype(np.int32)
    return pc.binary_join(pa.ListArray.from_arrays(starts, words.take(pa.array(letter * most + matrix[at]))), " ")


def wrap(seq: Column, width: int) -> Column:
    """Lines of width characters."""
    return F.regexp_replace(seq, f"(.{{{width}}})(?=.)", "$1\n")


def head_fields(head: Column, separator: str = "\t") -> Column:
    """All fields of a head line, the identifier first."""
    return F.split(head, separator)


def head_id(head: Column) -> Column:
    """The first token of a head line."""
    return F.regexp_extract(head, r"^\s*(\S+)", 1)


def key_values(fields: Column) -> Column:
    """The map of those fields that have exactly one "=", with something on both sides; of equal keys the last counts."""
    pairs = F.filter(fields, lambda x: x.rlike("^[^=]+=[^=]+$"))
    later = F.filter(pairs, lambda x, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda y: F.split_part(y, F.lit("="), F.lit(1)) == F.split_part(x, F.lit("="), F.lit(1))))
    return F.map_from_entries(F.transform(later, lambda x: F.struct(F.split_part(x, F.lit("="), F.lit(1)), F.split_part(x, F.lit("="), F.lit(2)))))


def purine_pyrimidine(label: Column) -> Column:
    """Nucleotide letters as R (A, G) or Y (C, T, U); other labels as they are."""
    return F.when(label.isin("A", "G"), "R").when(label.isin("C", "T", "U"), "Y").otherwise(label)


def cast_or_null(text: Column, kind: str) -> Column:
    """A value of the given type, null where the text is none."""
    return text.try_cast(kind)


def ordered_pair(a: Column, b: Column) -> tuple[Column, Column]:
    return F.least(a, b), F.greatest(a, b)


#: Losses and their derivatives over z = y * margin.
def loss(z: Column, kind: str = "hinge") -> Column:
    one = F.lit(1.0)
    if kind == "log":
        return F.when(z > 18, F.exp(-z)).when(z < -18, -z).otherwise(F.log(1 + F.exp(-z)))
    if kind == "log_margin":
        return F.when(z > 18, F.exp(1 - z)).when(z < -18, 1 - z).otherwise(F.log(1 + F.exp(1 - z)))
    if kind == "smooth_hinge":
        return F.when(z < 0, 0.5 - z).when(z < 1, 0.5 * (1 - z) * (1 - z)).otherwise(0.0)
    if kind == "squared_hinge":
        return F.when(z < 1, 0.5 * (1 - z) * (1 - z)).otherwise(0.0)
    if kind == "hinge":
        return F.when(z < 1, one - z).otherwise(0.0)
    raise ValueError(f"unknown loss: {kind}")


def loss_slope(z: Column, kind: str = "hinge") -> Column:
    """Minus the derivative of the loss."""
    if kind == "log":
        return F.when(z > 18, F.exp(-z)).when(z < -18, 1.0).otherwise(1 / (F.exp(z) + 1))
    if kind == "log_margin":
        return F.when(z > 18, F.exp(1 - z)).when(z < -18, 1.0).otherwise(1 / (F.exp(z - 1) + 1))
    if kind == "smooth_hinge":
        return F.when(z < 0, 1.0).when(z < 1, 1 - z).otherwise(0.0)
    if kind == "squared_hinge":
        return F.when(z < 1, 1 - z).otherwise(0.0)
    if kind == "hinge":
        return F.when(z < 1, 1.0).otherwise(0.0)
    raise ValueError(f"unknown loss: {kind}")
