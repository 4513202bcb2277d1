"""The 32-bit mixing hashes of labels and number lists, as column expressions and as plain Python.

Every step is done in 64-bit integers and cut to 32 bits, so the values are those of unsigned arithmetic. Items at even
places are mixed one way, at odd places another. Strings are hashed by code point, which for ASCII is the byte.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEED, MASK31 = 2863311530, 2147483647
#: Fixed values of the block hash: its multiplier and the two shifts of its end.
BLOCK_M, BLOCK_SHIFTS = 1540483477, (13, 15)
#: The rolling hash's two multipliers.
ROLL_A, ROLL_B = 63689, 378551


def feature_mask(bits: int) -> int:
    """The mask of feature ids for a bit size: one bit more than the number says."""
    return (2 << bits) - 1


def ap_hash(values: str | Sequence[int], mask: int = MASK31) -> int:
    """The alternating hash of a string or a list of unsigned numbers, in Python; for constants and tests."""
    h = SEED
    for i, c in enumerate(map(ord, values) if isinstance(values, str) else values):
        h ^= ((h << 7) ^ (c * (h >> 3))) if i % 2 == 0 else ~(((h << 11) + c) ^ (h >> 5))
        h &= 0xFFFFFFFF
    return h & mask


def rolling_hash(values: str | Sequence[int], mask: int = MASK31) -> int:
    """The multiplying hash of a string or a list of unsigned numbers, in Python."""
    h, a = 0, ROLL_A
    for c in map(ord, values) if isinstance(values, str) else values:
        h, a = (h * a + c) & 0xFFFFFFFF, a * ROLL_B & 0xFFFFFFFF
    return h & mask


def _step(h: str, item: str, place: str) -> str:
    even = f"({h} ^ (shiftleft({h}, 7) ^ ({item} * shiftright({h}, 3))))"
    odd = f"({h} ^ ~((shiftleft({h}, 11) + {item}) ^ shiftright({h}, 5)))"
    return f"((CASE WHEN {place} % 2 = 0 THEN {even} ELSE {odd} END) & 4294967295L)"


def ap_hash_string(column: str, mask: int = MASK31) -> Column:
    """Hash of a string column; null stays null."""
    codes = f"transform(split({column}, ''), (c, i) -> struct(CAST(ascii(c) AS BIGINT) AS c, i AS i))"
    folded = f"aggregate({codes}, {SEED}L, (h, x) -> {_step('h', 'x.c', 'x.i')})"
    return F.expr(f"CASE WHEN {column} = '' THEN {SEED & mask}L ELSE {folded} & {mask}L END")


def rolling_hash_string(column: str, mask: int = MASK31) -> Column:
    """Multiplying hash of a string column; null stays null."""
    codes = f"transform(split({column}, ''), c -> CAST(ascii(c) AS BIGINT))"
    state = f"named_struct('h', 0L, 'a', {ROLL_A}L)"
    product = "(s.h * (s.a & 65535L) + shiftleft((s.h * shiftright(s.a, 16)) & 65535L, 16))"  # 64 bits would overflow
    step = f"(s, c) -> named_struct('h', ({product} + c) & 4294967295L, 'a', (s.a * {ROLL_B}L) & 4294967295L)"
    return F.expr(f"CASE WHEN {column} IS NULL THEN NULL WHEN {column} = '' THEN 0L ELSE aggregate({codes}, {state}, {step}).h & {mask}L END")


def ap_hash_array(column: str, mask: int = MASK31) -> Column:
    """Hash of an array of numbers, of any length; for a few values known by name hash_values() is faster."""
    items = f"transform({column}, (c, i) -> struct(CAST(c AS BIGINT) AS c, i AS i))"
    return F.expr(f"aggregate({items}, {SEED}L, (h, x) -> {_step('h', 'x.c', 'x.i')}) & {mask}L")


def hash_values(df: DataFrame, name: str, values: Sequence[str | int], mask: int | str = MASK31) -> DataFrame:
    """df with column name: the hash of the listed values (expressions or numbers), one projection for each step.

    Leading numbers are folded here. The steps are plain arithmetic, which code generation compiles.
    """
    h, first = SEED, 0
    while first < len(values) and isinstance(values[first], int):
        c = values[first]
        h = (h ^ (((h << 7) ^ (c * (h >> 3))) if first % 2 == 0 else ~(((h << 11) + c) ^ (h >> 5)))) & 0xFFFFFFFF
        first += 1
    df = df.withColumn(name, F.lit(h).cast("long"))
    for place in range(first, len(values)):
        item = f"CAST({values[place]} AS BIGINT)"
        even, odd = f"{name} ^ (shiftleft({name}, 7) ^ ({item} * shiftright({name}, 3)))", f"{name} ^ ~((shiftleft({name}, 11) + {item}) ^ shiftright({name}, 5))"
        df = df.withColumn(name, F.expr(f"({odd if place % 2 else even}) & 4294967295L"))
    return df.withColumn(name, F.expr(f"{name} & {mask}"))


def block_hash(data: bytes, seed: int = 0) -> int:
    """The 32-bit hash of bytes in little-endian blocks of four (MurmurHash2), in Python."""
    words = [int.from_bytes(data[i : i + 4], "little") for i in range(0, len(data), 4)]
    full, rest = divmod(len(data), 4)
    h = seed ^ len(data)
    for k in words[:full]:
        k = k * BLOCK_M & 0xFFFFFFFF
        h = (h * BLOCK_M & 0xFFFFFFFF) ^ ((k ^ k >> 24) * BLOCK_M & 0xFFFFFFFF)
    if rest:
        h = (h ^ words[-1]) * BLOCK_M & 0xFFFFFFFF
    h = (h ^ h >> BLOCK_SHIFTS[0]) * BLOCK_M & 0xFFFFFFFF
    return h ^ h >> BLOCK_SHIFTS[1]


def block_hash_string(column: str, seed: int = 0) -> Column:
    """block_hash() of a string column's bytes in UTF-8; null stays null. No product is over 63 bits."""
    digits, n = f"hex(encode({column}, 'UTF-8'))", f"octet_length({column})"
    byte = lambda at: f"CAST(conv(substring({digits}, 2 * ({at}) + 1, 2), 16, 10) AS BIGINT)"
    word = " + ".join(f"shiftleft(coalesce({byte(f'4 * i + {k}')}, 0L), {8 * k})" for k in range(4))
    words = f"transform(slice(sequence(0, greatest({n}, 1)), 1, CAST(ceil({n} / 4) AS INT)), i -> struct(i * 4 + 4 <= {n} AS whole, {word} AS k))"
    mixed = f"(((x.k * {BLOCK_M}L) & 4294967295L) ^ shiftright((x.k * {BLOCK_M}L) & 4294967295L, 24))"
    step = f"(h, x) -> CASE WHEN x.whole THEN ((h * {BLOCK_M}L) & 4294967295L) ^ (({mixed} * {BLOCK_M}L) & 4294967295L) ELSE ((h ^ x.k) * {BLOCK_M}L) & 4294967295L END"
    end = f"h -> transform(array(((h ^ shiftright(h, {BLOCK_SHIFTS[0]})) * {BLOCK_M}L) & 4294967295L), g -> g ^ shiftright(g, {BLOCK_SHIFTS[1]}))[0]"
    return F.expr(f"aggregate({words}, {seed}L ^ CAST({n} AS BIGINT), {step}, {end})")


def minhash_family(k: Column, fid: Column) -> Column:
    """The k-th (from 0) of a family of hashes modulo a Mersenne prime, equal in any engine with 64-bit integers."""
    return ((fid % F.lit(MASK31)) * (F.lit(2 * 48271) * k + F.lit(16807)) + (F.lit(69621) * k + F.lit(12345))) % F.lit(MASK31)
