"""Small numeric column helpers with explicit missing-value rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_totals(df: DataFrame, name: str, **aggregates: Column) -> DataFrame:
    """Add a struct of whole-table aggregates, computed once as a scalar subquery.

    Held as a column so that the subquery appears once in the plan however many
    expressions read it.
    """
    row = F.struct(*[a.alias(n) for n, a in aggregates.items()]).alias(name)
    return df.withColumn(name, df.agg(row).scalar())


def clip(value: Column, low: float, high: float) -> Column:
    """Limit to [low, high]; NULL stays NULL (least/greatest alone would drop it)."""
    return F.when(value.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), value)))


def holds(condition: Column) -> Column:
    """A condition that counts as false when it cannot be decided."""
    return F.coalesce(condition, F.lit(False))


def tier_word(score: Column, words: tuple[str, str, str], low_end: float, medium_end: float) -> Column:
    """Half-open bands: below low_end, below medium_end, rest."""
    return F.when(score < low_end, words[0]).when(score < medium_end, words[1]).otherwise(words[2])


def hashed_digits(seed: int, identity: tuple[Column, ...], digits: int) -> Column:
    """A whole number of so many hexadecimal digits from the MD5 of the identity and the seed.

    The identity is written as text, parts joined by |, missing ones empty, so that another engine
    can draw the same numbers. Unlike rand(seed) they do not change with partitioning: a task that
    is run again after an executor loss gives the same values.
    """
    text = F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("")) for c in identity], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, digits), 16, 10).cast("bigint")


def uniform(seed: int, *identity: Column) -> Column:
    """A number in (0, 1) that depends only on the row's identity and the seed."""
    return (hashed_digits(seed, identity, 13).cast("double") + 0.5) / float(1 << 52)


def gaussian(seed: int, *identity: Column) -> Column:
    """Standard normal value per row identity (Box-Muller on two hashed uniforms)."""
    radius = F.sqrt(-2.0 * F.log(uniform(seed, *identity, F.lit("radius"))))
    return radius * F.cos(2.0 * F.pi() * uniform(seed, *identity, F.lit("angle")))
