"""Exact order statistics without a global sort.

Values are seen as whole numbers in the same order: a double as its 64 bits with the order of the
negative ones turned round, a whole number as itself. A rank is then found digit by digit, as in a
radix sort: each pass counts the next digits of the rows that share the digits found so far. The
passes are six whatever the values are, infinities and neighbouring doubles included, and each
returns at most 2^11 small rows per open rank.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Callable
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHIFTS = (53, 42, 31, 20, 9, 0)  # bits that are still open after each pass
_WHOLE = ("tinyint", "smallint", "int", "bigint")
_MOST = (1 << 63) - 1


@dataclass(frozen=True)
class Ranked:
    """The value at a rank, rows strictly below it, rows equal to it."""

    value: float | int
    below: int
    ties: int


def image(value: Column, kind: str) -> Column:
    """A long in the order of the values; NULL for NULL and NaN."""
    if kind in _WHOLE:
        return value.cast("bigint")
    double = value.cast("double") + F.lit(0.0)  # -0.0 is 0.0
    bits = F.java_method(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), double).cast("bigint")
    return F.when(value.isNotNull() & ~F.isnan(double), F.when(bits < 0, bits.bitwiseXOR(F.lit(_MOST))).otherwise(bits))


def value_of(seen: int, kind: str) -> float | int:
    """The value that has an image."""
    if kind in _WHOLE:
        return seen
    return struct.unpack("<d", struct.pack("<q", seen if seen >= 0 else seen ^ _MOST))[0]


def select_ranks(df: DataFrame, column: str, ranks: Callable[[int], list[int]]) -> tuple[int, dict[int, Ranked]]:
    """(number of values, rank -> value) of the values of a column that are neither NULL nor NaN.

    `ranks` names the wanted 0-based ranks for a given number of values. The one narrow column is
    kept (memory, then disk) for the passes, so an expensive input is evaluated once; a lost block
    is evaluated again from the input. Whole numbers stay whole: ids above 2^53 are told apart.
    """
    kind = dict(df.dtypes)[column]
    rows = df.select(image(F.col(column), kind).alias("_v")).filter(F.col("_v").isNotNull())
    rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        count = rows.count()
        open_ = {None: (0, sorted({r for r in ranks(count) if 0 <= r < count}))}  # digits -> rows below, wanted ranks
        found: dict[int, Ranked] = {}
        before = None
        for shift in SHIFTS:
            if not any(wanted for _, wanted in open_.values()):
                break
            digits = F.shiftright("_v", shift)
            inside = F.lit(True) if before is None else F.shiftright("_v", before).isin(list(open_))
            counted = rows.filter(inside).groupBy(digits.alias("p")).agg(F.count("_v").alias("n")).collect()
            closer: dict = {}
            for parent, (below, wanted) in open_.items():
                own = [(r.p, r.n) for r in counted if before is None or r.p >> (before - shift) == parent]
                for p, n in sorted(own):
                    hits = [r for r in wanted if below <= r < below + n]
                    if hits and shift:
                        closer[p] = (below, hits)
                    found.update({r: Ranked(value_of(p, kind), below, n) for r in hits if not shift})
                    below += n
            open_, before = closer, shift
        return count, found
    finally:
        rows.unpersist()


def _between(low: float, high: float, share: float) -> float:
    if share == 0 or low == high:
        return low
    span = high - low
    if math.isinf(span) and math.isfinite(low) and math.isfinite(high):
        return low * (1 - share) + high * share
    return low + span * share


def exact_quantiles(df: DataFrame, column: str, shares: list[float]) -> list[float | None]:
    """Linearly interpolated quantiles; None where there is no value at all."""

    def around(count: int) -> list[int]:
        places = [(count - 1) * share for share in shares]
        return sorted({r for p in places for r in (int(p), min(int(p) + 1, count - 1))}) if count else []

    count, at = select_ranks(df, column, around)
    if count == 0:
        return [None] * len(shares)
    places = [(count - 1) * share for share in shares]
    return [_between(float(at[int(p)].value), float(at[min(int(p) + 1, count - 1)].value), p - int(p)) for p in places]


def rows_at_ranks(df: DataFrame, first: str, second: str, ranks: list[int]) -> tuple[int, dict[int, tuple]]:
    """(rows with a value, rank -> (first, second)) in the order by both columns; `second` is unique.

    `second` is looked up only among rows that share the value of `first`; where that is one row,
    None stands for it.
    """
    count, hits = select_ranks(df, first, lambda _: ranks)
    out = {}
    for rank, hit in hits.items():
        place, at = rank - hit.below, None
        if hit.ties > 1:
            peers = df.filter(F.col(first) == F.lit(hit.value))
            at = select_ranks(peers, second, lambda _, p=place: [p])[1][place].value
        out[rank] = (hit.value, at)
    return count, out
