"""Small column helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def number(c: Column | str) -> Column:
    """To double; what isn't a number, NaN included, becomes null."""
    x = col(c).cast("string").try_cast("double")
    return F.when(~F.isnan(x), x)


def finite(c: Column | str) -> Column:
    """Infinities and NaN become null."""
    x = col(c)
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def flag(condition: Column) -> Column:
    """1 where the condition holds, 0 where it doesn't or is null."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def lookup(c: Column, values: dict[str | int, str | int], default: str | int | None = None) -> Column:
    """The value of a small fixed table, or ``default``."""
    pairs = [F.lit(x) for kv in values.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), c), F.lit(default)) if default is not None else F.element_at(F.create_map(*pairs), c)


def half_even(c: Column | str, digits: int = 0) -> Column:
    """Rounding with halves to even, as numeric tools outside SQL do."""
    return F.rint(col(c) * 10**digits) / 10**digits if digits else F.rint(col(c))
