"""Ranges as structs: lower, upper, lower_inc, upper_inc; a null end is open, null ranges are unknown."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators.filters import col


def make(lower: Any, upper: Any, bounds: str = "[)") -> Column:
    value = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(
        value(lower).alias("lower"), value(upper).alias("upper"), F.lit(bounds[0] == "[").alias("lower_inc"), F.lit(bounds[1] == "]").alias("upper_inc"))


def is_empty(r: str | Column) -> Column:
    r = col(r)
    return F.coalesce((r.lower > r.upper) | ((r.lower == r.upper) & ~(r.lower_inc & r.upper_inc)), F.lit(False))


def contains_value(r: str | Column, x: Any) -> Column:
    r, x = col(r), x if isinstance(x, Column) else F.lit(x)
    low = r.lower.isNull() | (x > r.lower) | ((x == r.lower) & r.lower_inc)
    high = r.upper.isNull() | (x < r.upper) | ((x == r.upper) & r.upper_inc)
    return low & high


def left_of(a: str | Column, b: str | Column) -> Column:
    """Whether all of a lies before all of b."""
    a, b = col(a), col(b)
    return F.coalesce((a.upper < b.lower) | ((a.upper == b.lower) & ~(a.upper_inc & b.lower_inc)), F.lit(False)) & ~is_empty(a) & ~is_empty(b)


def right_of(a: str | Column, b: str | Column) -> Column:
    return left_of(b, a)


def overlaps(a: str | Column, b: str | Column) -> Column:
    apart = left_of(a, b) | left_of(b, a) | is_empty(a) | is_empty(b)
    return F.when(col(a).isNotNull() & col(b).isNotNull(), ~apart)


def contains(a: str | Column, b: str | Column) -> Column:
    """Whether all of b is in a."""
    a, b = col(a), col(b)
    low = a.lower.isNull() | F.coalesce((a.lower < b.lower) | ((a.lower == b.lower) & (a.lower_inc | ~b.lower_inc)), F.lit(False))
    high = a.upper.isNull() | F.coalesce((a.upper > b.upper) | ((a.upper == b.upper) & (a.upper_inc | ~b.upper_inc)), F.lit(False))
    return is_empty(b) | (low & high)


def adjacent(a: str | Column, b: str | Column) -> Column:
    """Whether the ranges touch without a gap or an overlap."""
    a, b = col(a), col(b)
    touch = lambda x, y: F.coalesce((x.upper == y.lower) & (x.upper_inc != y.lower_inc), F.lit(False))
    return touch(a, b) | touch(b, a)


def intersection(a: str | Column, b: str | Column) -> Column:
    a, b = col(a), col(b)
    lower, upper = F.greatest(a.lower, b.lower), F.least(a.upper, b.upper)
    at = lambda end, x, y, inc: F.when(x.eqNullSafe(y), x_inc(a, inc) & x_inc(b, inc)).when(end.eqNullSafe(x), x_inc(a, inc)).otherwise(x_inc(b, inc))
    x_inc = lambda r, inc: r[inc]
    return F.struct(
        lower.alias("lower"), upper.alias("upper"), at(lower, a.lower, b.lower, "lower_inc").alias("lower_inc"),
        at(upper, a.upper, b.upper, "upper_inc").alias("upper_inc"))


def merge(a: str | Column, b: str | Column) -> Column:
    """The smallest range with both; an open end stays open, and an empty range adds nothing."""
    x, y = col(a), col(b)
    both = F.struct(
        F.when(x.lower.isNotNull() & y.lower.isNotNull(), F.least(x.lower, y.lower)).alias("lower"),
        F.when(x.upper.isNotNull() & y.upper.isNotNull(), F.greatest(x.upper, y.upper)).alias("upper"),
        F.coalesce(F.when(x.lower == y.lower, x.lower_inc | y.lower_inc).when(x.lower < y.lower, x.lower_inc).when(x.lower > y.lower, y.lower_inc), F.lit(False)).alias("lower_inc"),
        F.coalesce(F.when(x.upper == y.upper, x.upper_inc | y.upper_inc).when(x.upper > y.upper, x.upper_inc).when(x.upper < y.upper, y.upper_inc), F.lit(False)).alias("upper_inc"))
    return F.when(is_empty(a), y).when(is_empty(b), x).otherwise(both)


def starts_after(a: str | Column, b: str | Column) -> Column:
    """Whether a does not reach to the left of b."""
    a, b = col(a), col(b)
    low = F.coalesce((a.lower > b.lower) | ((a.lower == b.lower) & (b.lower_inc | ~a.lower_inc)), F.lit(False))
    return (low | b.lower.isNull()) & ~is_empty(a) & ~is_empty(b)


def ends_before(a: str | Column, b: str | Column) -> Column:
    """Whether a does not reach to the right of b."""
    a, b = col(a), col(b)
    high = F.coalesce((a.upper < b.upper) | ((a.upper == b.upper) & (b.upper_inc | ~a.upper_inc)), F.lit(False))
    return (high | b.upper.isNull()) & ~is_empty(a) & ~is_empty(b)


def lower_inf(r: str | Column) -> Column:
    return col(r).lower.isNull() & ~is_empty(r)


def upper_inf(r: str | Column) -> Column:
    return col(r).upper.isNull() & ~is_empty(r)


def union(a: str | Column, b: str | Column) -> Column:
    """Both together; null where a gap lies between them."""
    return F.when(overlaps(a, b) | adjacent(a, b) | is_empty(a) | is_empty(b), merge(a, b))


def difference(a: str | Column, b: str | Column) -> Column:
    """What of a lies outside b, as an array of none, one or two ranges."""
    x, y = col(a), col(b)
    before = F.struct(x.lower.alias("lower"), y.lower.alias("upper"), x.lower_inc.alias("lower_inc"), (~y.lower_inc).alias("upper_inc"))
    after = F.struct(y.upper.alias("lower"), x.upper.alias("upper"), (~y.upper_inc).alias("lower_inc"), x.upper_inc.alias("upper_inc"))
    parts = F.array(F.when(y.lower.isNotNull() & ~is_empty(before), before), F.when(y.upper.isNotNull() & ~is_empty(after), after))
    return F.when(overlaps(a, b), F.filter(parts, lambda p: p.isNotNull())).otherwise(F.filter(F.array(x), lambda p: ~is_empty(p)))


def multirange(rs: str | Column) -> Column:
    """An array of ranges as the fewest ranges that hold the same values, in order."""

    def joined(done: Column, r: Column) -> Column:
        last = F.get(done, F.size(done) - 1)
        touches = F.coalesce(overlaps(last, r) | adjacent(last, r), F.lit(False))
        return F.when(touches, F.concat(F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))), F.array(merge(last, r)))).otherwise(F.concat(done, F.array(r)))

    known = F.filter(col(rs), lambda r: r.isNotNull() & ~is_empty(r))
    return F.aggregate(F.sort_array(known), F.filter(known, lambda r: F.lit(False)), joined)


def multirange_contains(rs: str | Column, x: Any) -> Column:
    return F.exists(col(rs), lambda r: contains_value(r, x))
