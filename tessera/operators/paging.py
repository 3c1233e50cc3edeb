"""Top rows, pages and keysets.

A row count over everything never needs one task with all rows: numbers come from limits
or keysets, or from windows within a group.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .filters import all_of, any_of


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """DISTINCT ON: the first row of each key in the given order."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_n", n).where("_n = 1").drop("_n")


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, offset: int = 0, ties: bool = False) -> DataFrame:
    """Rows offset + 1 to offset + k of each group; with ties also those equal to the last."""
    n = (F.rank() if ties else F.row_number()).over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_n", n).where(F.col("_n").between(offset + 1, offset + k)).drop("_n")


def with_ties(df: DataFrame, order: Sequence[str], k: int, ascending: bool = True) -> DataFrame:
    """The first k rows and those equal to the last of them in the order's columns (not null)."""
    ways = [F.col(c).asc() if ascending else F.col(c).desc() for c in order]
    edge = df.orderBy(*ways).limit(k).agg((F.max if ascending else F.min)(F.struct(*order)).alias("_edge"))
    row = F.struct(*order)
    inside = row <= F.col("_edge") if ascending else row >= F.col("_edge")
    return df.crossJoin(F.broadcast(edge)).where(inside).drop("_edge")  # edge is one row


def after(order: Sequence[tuple[str, str, str | None]], last: Sequence[Any]) -> Column:
    """Rows behind a row with these values: (a > x) or (a = x and b > y) and so on.

    Nulls lie where the order puts them; where it does not say, first if ascending and last if descending, as in Spark.
    """
    steps = []
    for i, (c, way, nulls) in enumerate(order):
        nulls_last = nulls == "last" or (nulls is None and way == "desc")
        if last[i] is None:
            beyond = F.lit(False) if nulls_last else F.col(c).isNotNull()
        else:
            beyond = F.col(c) > F.lit(last[i]) if way == "asc" else F.col(c) < F.lit(last[i])
            beyond = beyond | F.col(c).isNull() if nulls_last else F.coalesce(beyond, F.lit(False))
        steps.append(all_of(F.col(order[j][0]).eqNullSafe(F.lit(last[j])) for j in range(i)) & beyond)
    return any_of(steps)


def with_found_rows(page: DataFrame, whole: DataFrame, name: str = "found_rows") -> DataFrame:
    """A limited query with the number of rows that it has without the limit; one row is broadcast."""
    return page.crossJoin(F.broadcast(whole.agg(F.count(F.lit(1)).alias(name))))


@dataclass(frozen=True)
class Page:
    df: DataFrame
    number: int
    size: int
    record_count: int

    @property
    def page_count(self) -> int:
        return max(1, -(-self.record_count // self.size))

    @property
    def previous(self) -> int | None:
        return self.number - 1 if self.number > 1 else None

    @property
    def next(self) -> int | None:
        return self.number + 1 if self.number < self.page_count else None


def paginate(df: DataFrame, number: int, size: int, record_count: int | None = None) -> Page:
    """A page of an ordered query; the rows are counted unless their number is given."""
    if number < 1 or size < 1:
        raise ValueError("pages are numbered and sized from 1")
    return Page(df.offset((number - 1) * size).limit(size), number, size, df.count() if record_count is None else record_count)
