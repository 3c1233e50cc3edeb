"""Conditions: pairs, exclusion, inversion, membership, pattern search.

``where(cond)`` keeps rows for which a condition is true; ``exclude`` those for which it is
definitely false; ``exclude_or_null`` those for which it is false or null.
"""

from __future__ import annotations

import functools
import operator
import re
from collections.abc import Iterable, Mapping
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The POSIX classes that other dialects write and the names that Java's patterns have for them.
POSIX = {
    "[:alnum:]": r"\p{Alnum}", "[:alpha:]": r"\p{Alpha}", "[:blank:]": r"\p{Blank}", "[:cntrl:]": r"\p{Cntrl}",
    "[:digit:]": r"\p{Digit}", "[:graph:]": r"\p{Graph}", "[:lower:]": r"\p{Lower}", "[:print:]": r"\p{Print}",
    "[:punct:]": r"\p{Punct}", "[:space:]": r"\p{Space}", "[:upper:]": r"\p{Upper}", "[:xdigit:]": r"\p{XDigit}",
}


@dataclass(frozen=True)
class Between:
    """A range of values; an open end is None, the upper end can be left out."""

    low: Any = None
    high: Any = None
    exclusive: bool = False


def col(name: str | Column) -> Column:
    return name if isinstance(name, Column) else F.col(name)


def all_of(conditions: Iterable[Column]) -> Column:
    return functools.reduce(operator.and_, conditions, F.lit(True))


def any_of(conditions: Iterable[Column]) -> Column:
    return functools.reduce(operator.or_, conditions, F.lit(False))


def is_in(column: str | Column, values: Iterable[Any], *, nulls_known: bool = False) -> Column:
    """Membership.  An empty list is plain false; with nulls_known a None among the values matches nulls."""
    values = list(values)
    known = [v for v in values if v is not None] if nulls_known else values
    out = col(column).isin(known) if known else F.lit(False)
    return out | col(column).isNull() if nulls_known and len(known) < len(values) else out


def not_in(column: str | Column, values: Iterable[Any], *, nulls_known: bool = False) -> Column:
    """The inverse of ``is_in``: plain true for an empty list, also where the column is null."""
    values = list(values)
    known = [v for v in values if v is not None] if nulls_known else values
    out = ~col(column).isin(known) if known else F.lit(True)
    return out & col(column).isNotNull() if nulls_known and len(known) < len(values) else out


def is_in_null_aware(column: str | Column, values: Iterable[Any]) -> Column:
    """Membership that is unknown where the column is null, also for an empty list."""
    values = list(values)
    return col(column).isin(values) if values else col(column) != col(column)


def tuples_in(columns: list[str], values: Iterable[tuple]) -> Column:
    """Whether several columns together are one of the tuples."""
    return any_of(all_of(col(c) == v for c, v in zip(columns, row, strict=True)) for row in values)


def pair(name: str | Column, value: Any) -> Column:
    """What ``column: value`` means: equality, IS, a range, a list, or a pattern, by the kind of the value."""
    c = col(name)
    if value is None:
        return c.isNull()
    if value is True or value is False:
        return c.eqNullSafe(F.lit(value))
    if isinstance(value, Between):
        ends = [c >= value.low] if value.low is not None else []
        if value.high is not None:
            ends.append(c < value.high if value.exclusive else c <= value.high)
        return all_of(ends)
    if isinstance(value, re.Pattern):
        return matches(c, value)
    if isinstance(value, (list, tuple, set, frozenset)):
        return is_in(c, value)
    return c == value


def conditions(spec: Column | Mapping[str, Any] | Iterable[tuple[str, Any]] | None) -> Column:
    """A condition from a Column or from pairs, which must all hold; None is never true."""
    if spec is None:
        return F.lit(None).cast("boolean")
    if isinstance(spec, Column):
        return spec
    if isinstance(spec, (str, bytes, int, float)):
        raise TypeError("a condition is a Column or pairs of a column and a value")
    return all_of(pair(k, v) for k, v in (spec.items() if isinstance(spec, Mapping) else spec))


def any_pair(spec: Mapping[str, Any]) -> Column:
    return any_of(pair(k, v) for k, v in spec.items())


def no_pair(spec: Mapping[str, Any]) -> Column:
    """None of the pairs holds."""
    return all_of(~pair(k, v) for k, v in spec.items())


def exclude(df: DataFrame, spec) -> DataFrame:
    return df.where(~conditions(spec))


def exclude_or_null(df: DataFrame, spec) -> DataFrame:
    return df.where(~F.coalesce(conditions(spec), F.lit(False)))


def distinct_from(a: str | Column, b: str | Column) -> Column:
    return ~col(a).eqNullSafe(col(b))


def escape_like(text: str) -> str:
    """The text with %, _ and the backslash escaped for LIKE."""
    return re.sub(r"([%_\\])", r"\\\1", text)


def like(column: str | Column, *patterns: str, ignore_case: bool = False) -> Column:
    """Whether any of the LIKE patterns matches."""
    c = col(column)
    return any_of(c.ilike(p) if ignore_case else c.like(p) for p in patterns)


def matches(column: str | Column, pattern: str | re.Pattern, ignore_case: bool = False) -> Column:
    """Whether a regular expression is found, POSIX classes included."""
    text = pattern.pattern if isinstance(pattern, re.Pattern) else pattern
    ignore_case |= isinstance(pattern, re.Pattern) and bool(pattern.flags & re.IGNORECASE)
    for name, java in POSIX.items():
        text = text.replace(name, java)
    return col(column).rlike(("(?i)" if ignore_case else "") + text)


def grep(df: DataFrame, columns: list[str], patterns: list[str | re.Pattern], *, all_patterns=False, all_columns=False, ignore_case=False) -> DataFrame:
    """Rows in which any (or all) of the columns match any (or all) of the patterns."""

    def one(c: str, p) -> Column:
        return matches(c, p, ignore_case) if isinstance(p, re.Pattern) else like(c, p, ignore_case=ignore_case)

    over_columns = all_of if all_columns else any_of
    if all_patterns:
        return df.where(all_of(over_columns(one(c, p) for c in columns) for p in patterns))
    return df.where(over_columns(any_of(one(c, p) for p in patterns) for c in columns))


def words_search(column: str | Column, words: list[str], *, all_words: bool = True) -> Column:
    """Full-text search without an index: the words as whole words in any case."""
    found = [col(column).rlike(rf"(?i)(?U)\b{re.escape(w)}\b") for w in words]
    return all_of(found) if all_words else any_of(found)


def words_rank(column: str | Column, words: list[str]) -> Column:
    """How often the words occur as whole words in any case, for an order by relevance; 0 in a null text."""
    pattern = rf"(?i)(?U)\b({'|'.join(map(re.escape, words))})\b"
    return F.regexp_count(F.coalesce(col(column), F.lit("")), F.lit(pattern))
