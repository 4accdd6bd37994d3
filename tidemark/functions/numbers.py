"""Numbers out of report cells. Nothing here fails on bad text: what is no number is null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_float(cell: Column) -> Column:
    """Digits, point and minus of a cell as a double; null if they are no number."""
    return F.regexp_replace(cell.cast("string"), r"[^0-9.\-]", "").try_cast("double")


def to_int(cell: Column) -> Column:
    """The same rounded half away from zero."""
    return F.round(to_float(cell), 0).try_cast("bigint")


def to_millions(cell: Column) -> Column:
    """An amount of money in millions, six decimals; minus signs are ignored."""
    return F.round(F.regexp_replace(cell.cast("string"), r"[^0-9.]", "").try_cast("double") / 1_000_000, 6)


def large_to_millions(amount: Column) -> Column:
    """Amounts over 1000 are single units and become millions; others are millions already."""
    return F.when(amount > 1000, amount / 1_000_000).otherwise(amount)


def first_number(text: Column) -> Column:
    """The first signed number in a text."""
    return F.regexp_extract(F.replace(text, F.lit(","), F.lit("")), r"([-+]?\d+(?:\.\d+)?)", 1).try_cast("double")


def repair_digits(cell: Column) -> Column:
    """Undoes digits that a table reader repeated around separators: ``17, 7, 785`` is 17785, ``28. 8. 23`` is 28.23."""
    joined = F.regexp_replace(F.trim(cell), r"(\d+)\.\s*\d+\.\s*(\d+)", "$1.$2")
    joined = F.regexp_replace(joined, r",\s*\d(?=\s*,)", "")
    joined = F.regexp_replace(F.regexp_replace(joined, r"^\s*[.,]+\s*", ""), r"\s*[.,]+\s*$", "")
    return F.trim(F.regexp_replace(joined, r",\s*", ""))


def close_to(a: Column, b: Column, relative: float = 1e-9) -> Column:
    return F.abs(a - b) <= relative * F.greatest(F.abs(a), F.abs(b))
