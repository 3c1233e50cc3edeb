"""Text and date helpers."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators.filters import col

UNITS = ("years", "months", "weeks", "days", "hours", "minutes", "seconds")


def join(items: list[Any], separator: str = "") -> Column:
    """Concatenation; items that are no text are cast, and a null makes the whole null."""
    parts = [(x if isinstance(x, Column) else F.lit(x)).cast("string") for x in items]
    out = [parts[0]]
    for p in parts[1:]:
        out += [F.lit(separator), p] if separator else [p]
    return F.concat(*out)


def case(conditions: Mapping[Any, Any] | list[tuple[Any, Any]], default: Any = None, on: str | Column | None = None) -> Column:
    """A searched CASE from conditions, or a simple one from values that ``on`` may equal."""
    out = F
    for key, value in conditions.items() if isinstance(conditions, Mapping) else conditions:
        out = out.when(key if on is None else col(on) == key, value)
    return out.otherwise(default)


def date_add(column: str | Column, **amounts: Any) -> Column:
    """Adds years, months, weeks, days, hours, minutes and seconds, numbers or columns."""
    if unknown := set(amounts) - set(UNITS):
        raise ValueError(f"no such units: {sorted(unknown)}")
    parts = [amounts.get(u, 0) for u in UNITS]
    return col(column) + F.make_interval(*(p if isinstance(p, Column) else F.lit(p) for p in parts))


def date_sub(column: str | Column, **amounts: Any) -> Column:
    return date_add(column, **{u: -v for u, v in amounts.items()})


def extract(part: str, column: str | Column) -> Column:
    """A date's part; dow counts from Sunday as 0."""
    return F.dayofweek(col(column)) - 1 if part == "dow" else F.date_part(F.lit(part), col(column))
