"""Text building on columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def _fixed_or_null(value: Column, digits: int) -> Column:
    """format_number without separators; its one wrong case, a lone 5 right after the last digit, is spelled out."""
    tie = float(f"5e-{digits + 1}")
    text = F.translate(F.format_number(value, digits), ",", "")
    if digits < 3:
        return text
    return F.when(value == tie, f"{tie:.{digits}f}").when(value == -tie, f"{-tie:.{digits}f}").otherwise(text)


def fixed(value: Column, digits: int) -> Column:
    """Fixed-point text, half-even on the exact binary value; "nan" where missing.

    format_number rounds that way, while plain printf formatting rounds half up
    on the shortest decimal form.
    """
    return F.coalesce(_fixed_or_null(value, digits), F.lit("nan"))


def percent(value: Column, digits: int) -> Column:
    return F.concat(fixed(value * 100.0, digits), F.lit("%"))


def rounded(value: Column, digits: int) -> Column:
    """Half-even rounding of the exact binary value; NULL stays NULL."""
    return _fixed_or_null(value, digits).cast("double")


def fill(template: str, **parts: Column) -> Column:
    """Concatenate a template's literal text with the columns its {names} stand for."""
    pieces = re.split(r"\{(\w+)\}", template)
    columns = [
        parts[piece] if i % 2 else F.lit(piece)
        for i, piece in enumerate(pieces)
        if i % 2 or piece
    ]
    return F.concat(*columns)


def iso(moment: Column) -> Column:
    """ISO-8601 text, with microseconds only where they are not zero."""
    return F.concat(
        F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss"),
        F.when(F.unix_micros(moment) % 1_000_000 != 0, F.date_format(moment, ".SSSSSS")).otherwise(""),
    )


def known(value: Column, blanks: tuple[str, ...]) -> Column:
    """Trimmed text, or NULL where it is missing or one of the blank words."""
    text = F.trim(value.cast("string"))
    return F.when(~F.lower(text).isin(*blanks), text)
