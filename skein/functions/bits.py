"""Binary fingerprints as BIGINT words, and their algebra."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

MASK32 = 0xFFFFFFFF


def sign_word(v: Column, first: int, n: int = 32) -> Column:
    """Bit i is set if component first + i is over 0."""
    return F.aggregate(F.sequence(F.lit(0), F.lit(n - 1)), F.lit(0).cast("long"), lambda a, i: a.bitwiseOR(F.when(F.get(v, i + first) > 0, F.expr("1L")).otherwise(F.expr("0L")) * F.pow(F.lit(2.0), i).cast("long")))


def popcount(words: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, [F.bit_count(w) for w in words]).cast("long")


def hamming(a: list[Column], b: list[Column]) -> Column:
    return popcount([x.bitwiseXOR(y) for x, y in zip(a, b, strict=True)])


def both(a: list[Column], b: list[Column]) -> Column:
    return popcount([x.bitwiseAND(y) for x, y in zip(a, b, strict=True)])


def pap_sim(a: list[Column], b: list[Column]) -> Column:
    """Shared bits over the geometric mean of the counts; 0 if a side is empty."""
    n = popcount(a) * popcount(b)
    return F.when(n == 0, F.lit(0.0)).otherwise(both(a, b) / F.sqrt(n.cast("double")))


def pap_dist(a: list[Column], b: list[Column]) -> Column:
    """0 if both sides are empty, 1 if one is."""
    return F.when((popcount(a) == 0) & (popcount(b) == 0), F.lit(0.0)).otherwise(1 - pap_sim(a, b))
