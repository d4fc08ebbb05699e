"""Scalar functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def falling_factorial(m: Column, n: int, kind: str = "bigint") -> Column:
    """m (m - 1) ... (m - n + 1): ways to choose n of m in order; 1 for n = 0, 0 for m < n."""
    if n < 0:
        raise ValueError("n must not be negative")
    out = F.lit(1).cast(kind)
    for i in range(n):
        out = out * (m.cast(kind) - i).cast(kind)
        if kind != "bigint":
            out = out.cast(kind)
    return F.when(m < n, F.lit(0).cast(kind)).otherwise(out)


def all_different(values: Column) -> Column:
    """True if no element of the array stands twice."""
    return F.size(F.array_distinct(values)) == F.size(values)


def not_contains(values: Column, x: Column | int) -> Column:
    return ~F.array_contains(values, x)


def hash_combine(*columns: Column) -> Column:
    """One 64-bit hash of several values."""
    return F.xxhash64(*columns)


def owner(key: Column, workers: int) -> Column:
    """The worker, 0 to workers - 1, that a key belongs to."""
    return F.pmod(key, F.lit(workers)).cast("int")


def parse_id(token: Column) -> Column:
    """The number at the start of a token, 0 if there is none."""
    return F.coalesce(F.nullif(F.regexp_extract(token, r"^\s*([+-]?\d+)", 1), F.lit("")).cast("bigint"), F.lit(0).cast("bigint"))


def first_char(token: Column) -> Column:
    return F.substring(token, 1, 1)


def before(a: list[Column], b: list[Column]) -> Column:
    """Lexicographic a < b of pairs, triplets and so on."""
    return F.struct(*[x.alias(f"k{i}") for i, x in enumerate(a)]) < F.struct(*[x.alias(f"k{i}") for i, x in enumerate(b)])


def conflict_mask(flags: list[Column]) -> Column:
    """Flag i as bit i of a bigint."""
    if len(flags) > 63:
        raise ValueError("a mask holds 63 conflicts at most")
    out = F.lit(0).cast("bigint")
    for i, f in enumerate(flags):
        out = out.bitwiseOR(F.when(f, F.shiftleft(F.lit(1).cast("bigint"), i)).otherwise(F.lit(0).cast("bigint")))
    return out
