"""Whole-number ranges as nodes of a tree of 16: a range is a few nodes, a number one for each level, so both meet by an equi join."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LEVELS, BITS = 15, 4


def _shift(v: Column, bits: int) -> Column:
    return F.shiftright(v, bits) if bits else v


def _at_level(k: int):
    return lambda n: F.struct(F.lit(k).alias("level"), n.alias("node"))


def nodes(low: Column, high: Column) -> Column:
    """Array of (level, node): together exactly the numbers low..high; at most 30 a level. Empty if reversed, null for null."""
    low, end = low.cast("bigint"), high.cast("bigint") + 1
    up = lambda v, b: -_shift(-v, b)
    out = []
    for k in range(LEVELS):
        lo, hi = up(low, BITS * k), _shift(end, BITS * k)
        above, over = up(low, BITS * (k + 1)) * 16, _shift(end, BITS * (k + 1)) * 16
        upto = lambda a, b: F.when(a < b, F.sequence(a, F.greatest(a, b - 1))).otherwise(F.array().cast("array<bigint>"))
        own = F.when(above < over, F.concat(upto(lo, above), upto(over, hi))).otherwise(upto(lo, hi))
        out.append(F.transform(own, _at_level(k)))
    return F.when(low.isNotNull() & end.isNotNull(), F.concat(*out))


def above(n: Column, top: int = LEVELS - 1) -> Column:
    """Array of (level, node) up to level ``top`` that hold the number."""
    return F.array(*[F.struct(F.lit(k).alias("level"), _shift(n.cast("bigint"), BITS * k).alias("node")) for k in range(top + 1)])
