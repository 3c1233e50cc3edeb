"""An immutable, chainable query over DataFrames.

A Dataset keeps its clauses apart, so that ``select`` replaces the projection, ``or_`` and
``invert`` rewrite the filter and ``reverse`` the order; ``df`` puts them together in the
order in which SQL evaluates them.  All the work is the DataFrame's.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from . import frames, joins, recursion, sets
from .filters import all_of, col, conditions

Key = str | Column


class NoMatchingRow(LookupError):
    pass


def flipped(order: tuple[tuple[str, str, str | None], ...]) -> tuple[tuple[str, str, str | None], ...]:
    other = {"asc": "desc", "desc": "asc", "first": "last", "last": "first", None: None}
    return tuple((c, other[way], other[nulls]) for c, way, nulls in order)


def ordering(order: tuple[tuple[str, str, str | None], ...]) -> list[Column]:
    return [getattr(F.col(c), way if nulls is None else f"{way}_nulls_{nulls}")() for c, way, nulls in order]


def _orders(keys: tuple) -> tuple[tuple[str, str, str | None], ...]:
    """Each key is a name, or (name, "asc" or "desc"[, "first" or "last" for nulls])."""
    out = []
    for k in keys:
        k = (k,) if isinstance(k, str) else tuple(k)
        out.append((k[0], k[1] if len(k) > 1 else "asc", k[2] if len(k) > 2 else None))
    return tuple(out)


@dataclass(frozen=True)
class Dataset:
    source: DataFrame
    filter: Column | None = None
    keys: tuple[Key, ...] = ()
    grouping: str = "groupBy"
    sets_of_keys: tuple[tuple[str, ...], ...] | None = None
    aggregates: tuple[Column, ...] = ()
    having_filter: Column | None = None
    projection: tuple[Key, ...] = ()
    unique: bool = False
    order_keys: tuple[tuple[str, str, str | None], ...] = ()
    count_limit: int | None = None
    skip: int | None = None
    tables: tuple[tuple[str, DataFrame], ...] = ()
    windows: tuple[tuple[str, frames.Named], ...] = ()

    # names within a query
    def with_(self, name: str, other: Dataset | DataFrame | str, columns: list[str] | None = None, materialized: bool = False) -> Dataset:
        """WITH: later joins, compounds and ``from_`` may use the query by its name; materialized keeps its rows, so that they are computed once."""
        df = self._named(other)
        df = df.toDF(*columns) if columns else df
        return replace(self, tables=(*self.tables, (name, (df.persist() if materialized else df).alias(name))))

    def with_recursive(self, name: str, base: Dataset | DataFrame | str, step: Callable[[DataFrame], DataFrame], distinct: bool = False) -> Dataset:
        return self.with_(name, recursion.recursive(self._named(base), step, distinct=distinct))

    def from_(self, other: Dataset | DataFrame | str) -> Dataset:
        """Another source under the same names."""
        return self._rows(self._named(other))

    def window(self, name: str, partition: tuple = (), order: tuple = (), rows: tuple | None = None, range: tuple | None = None, base: str | None = None) -> Dataset:  # noqa: A002
        """WINDOW: a window by name, which may start from an earlier one."""
        own = frames.Named(tuple(partition), tuple(order), rows, range)
        return replace(self, windows=(*self.windows, (name, own if base is None else dict(self.windows)[base].extended(own))))

    def over(self, name: str, **outputs: Column) -> Dataset:
        """Adds functions over a named window to the projection."""
        spec = dict(self.windows)[name].spec
        return self.select_append(*(f.over(spec).alias(out) for out, f in outputs.items()))

    def create_view(self, name: str) -> Dataset:
        """A temporary view, replaced if there is one."""
        self.df.createOrReplaceTempView(name)
        return self

    def _named(self, other: Dataset | DataFrame | str) -> DataFrame:
        if not isinstance(other, str):
            return other.df if isinstance(other, Dataset) else other
        if other not in dict(self.tables):
            raise LookupError(f"no query is called {other}")
        return dict(self.tables)[other]

    def _rows(self, df: DataFrame) -> Dataset:
        return Dataset(df, tables=self.tables, windows=self.windows)

    # filters
    def where(self, spec: Any = None, **pairs: Any) -> Dataset:
        return replace(self, filter=self._and(self.filter, conditions(pairs if pairs else spec)))

    def exclude(self, spec: Any = None, **pairs: Any) -> Dataset:
        return replace(self, filter=self._and(self.filter, ~conditions(pairs if pairs else spec)))

    def exclude_or_null(self, spec: Any = None, **pairs: Any) -> Dataset:
        return replace(self, filter=self._and(self.filter, ~F.coalesce(conditions(pairs if pairs else spec), F.lit(False))))

    def or_(self, spec: Any = None, **pairs: Any) -> Dataset:
        """Widens the filter; without one it changes nothing."""
        return self if self.filter is None else replace(self, filter=self.filter | conditions(pairs if pairs else spec))

    def invert(self) -> Dataset:
        """Rows that the filter (and HAVING) rules out; none if there is no filter."""
        if self.filter is None and self.having_filter is None:
            return replace(self, filter=F.lit(False))
        flip = lambda c: None if c is None else ~c
        return replace(self, filter=flip(self.filter), having_filter=flip(self.having_filter))

    def unfiltered(self) -> Dataset:
        return replace(self, filter=None, having_filter=None)

    def having(self, spec: Any) -> Dataset:
        return replace(self, having_filter=self._and(self.having_filter, conditions(spec)))

    def exclude_having(self, spec: Any) -> Dataset:
        return replace(self, having_filter=self._and(self.having_filter, ~conditions(spec)))

    def exclude_or_null_having(self, spec: Any) -> Dataset:
        return replace(self, having_filter=self._and(self.having_filter, ~F.coalesce(conditions(spec), F.lit(False))))

    def nullify(self) -> Dataset:
        """The same columns without a row."""
        return self._rows(self.df.where(F.lit(False)))

    @staticmethod
    def _and(a: Column | None, b: Column) -> Column:
        return b if a is None else a & b

    # projection
    def select(self, *columns: Key) -> Dataset:
        return replace(self, projection=columns)

    def select_all(self, *aliases: str) -> Dataset:
        """All columns, or all of these sources."""
        return replace(self, projection=tuple(f"{a}.*" for a in aliases))

    def select_append(self, *columns: Key) -> Dataset:
        return replace(self, projection=(*(self.projection or ("*",)), *columns))

    def select_prepend(self, *columns: Key) -> Dataset:
        return replace(self, projection=(*columns, *(self.projection or ("*",))))

    def select_remove(self, *names: str) -> Dataset:
        return self._rows(self.df.drop(*names))

    def select_group(self, *columns: Key) -> Dataset:
        return replace(self, keys=columns, projection=())

    def distinct(self) -> Dataset:
        return replace(self, unique=True)

    # grouping
    def group(self, *keys: Key) -> Dataset:
        return replace(self, keys=keys)

    def group_append(self, *keys: Key) -> Dataset:
        return replace(self, keys=(*self.keys, *keys))

    def group_rollup(self) -> Dataset:
        return replace(self, grouping="rollup")

    def group_cube(self) -> Dataset:
        return replace(self, grouping="cube")

    def grouping_sets(self, *sets_of_keys: tuple[str, ...]) -> Dataset:
        return replace(self, sets_of_keys=tuple(map(tuple, sets_of_keys)))

    def ungrouped(self) -> Dataset:
        return replace(self, keys=(), aggregates=(), having_filter=None, grouping="groupBy", sets_of_keys=None)

    def agg(self, *aggregates: Column) -> Dataset:
        return replace(self, aggregates=aggregates)

    def group_and_count(self, *keys: Key) -> Dataset:
        return replace(self, keys=keys, aggregates=(F.count(F.lit(1)).alias("count"),))

    # order and limits
    def order(self, *keys: Any) -> Dataset:
        return replace(self, order_keys=_orders(keys))

    def order_append(self, *keys: Any) -> Dataset:
        return replace(self, order_keys=(*self.order_keys, *_orders(keys)))

    def order_prepend(self, *keys: Any) -> Dataset:
        return replace(self, order_keys=(*_orders(keys), *self.order_keys))

    def reverse(self, *keys: Any) -> Dataset:
        return replace(self, order_keys=flipped(_orders(keys) or self.order_keys))

    def unordered(self) -> Dataset:
        return replace(self, order_keys=())

    def limit(self, n: int, offset: int | None = None) -> Dataset:
        if n < 1:
            raise ValueError("a limit is 1 or more")
        return replace(self, count_limit=n, skip=self.skip if offset is None else offset)

    def offset(self, n: int) -> Dataset:
        if n < 0:
            raise ValueError("an offset is 0 or more")
        return replace(self, skip=n)

    def unlimited(self) -> Dataset:
        return replace(self, count_limit=None, skip=None)

    # joins and compounds: these work on the rows so far
    def join(self, other: Dataset | DataFrame | str, on: Any = None, how: str = "inner") -> Dataset:
        return self._rows(joins.join(self.df, self._named(other), on, how))

    def union(self, other: Dataset | DataFrame | str, all: bool = False) -> Dataset:  # noqa: A002
        return self._rows(sets.union(self.df, self._named(other), all))

    def intersect(self, other: Dataset | DataFrame | str, all: bool = False) -> Dataset:  # noqa: A002
        return self._rows(sets.intersect(self.df, self._named(other), all))

    def except_(self, other: Dataset | DataFrame | str, all: bool = False) -> Dataset:  # noqa: A002
        return self._rows(sets.except_(self.df, self._named(other), all))

    def from_self(self, alias: str | None = None, columns: list[str] | None = None) -> Dataset:
        df = self.df.toDF(*columns) if columns else self.df
        return self._rows(df.alias(alias) if alias else df)

    def pipe(self, change: Callable[..., Dataset], *args: Any, **named: Any) -> Dataset:
        """change(self, ...), so that subsets and other methods of one's own chain."""
        return change(self, *args, **named)

    # the DataFrame
    @property
    def df(self) -> DataFrame:
        out = self.source if self.filter is None else self.source.where(self.filter)
        if self.sets_of_keys is not None:
            out = out.groupingSets([[F.col(k) for k in s] for s in self.sets_of_keys], *(col(k) for k in self.keys)).agg(*self.aggregates)
        elif self.keys or self.aggregates:
            grouped = getattr(out, self.grouping)(*(col(k) for k in self.keys))
            if self.aggregates:
                out = grouped.agg(*self.aggregates)
            elif self.grouping == "groupBy":
                out = out.select(*self.keys).distinct()
            else:  # the subtotal rows come from the grouping alone
                out = grouped.agg(F.count(F.lit(1)).alias("_n")).drop("_n")
        if self.having_filter is not None:
            out = out.where(self.having_filter)
        if self.projection:
            out = out.select(*self.projection)
        if self.unique:
            out = out.distinct()
        if self.order_keys:
            out = out.orderBy(*ordering(self.order_keys))
        if self.skip:
            out = out.offset(self.skip)
        return out if self.count_limit is None else out.limit(self.count_limit)

    @property
    def columns(self) -> list[str]:
        return self.df.columns

    # actions
    def count(self) -> int:
        return self.df.count()

    def _value(self, aggregate: Callable, name: str) -> Any:
        """Of the rows that this query gives: where it is limited, its order says which."""
        limited = self.count_limit is not None or self.skip
        return (self if limited else self.unordered()).df.agg(aggregate(name)).first()[0]

    def avg(self, name: str) -> Any:
        return self._value(F.avg, name)

    def sum(self, name: str) -> Any:
        return self._value(F.sum, name)

    def min(self, name: str) -> Any:
        return self._value(F.min, name)

    def max(self, name: str) -> Any:
        return self._value(F.max, name)

    def empty(self) -> bool:
        return self.df.isEmpty()

    def first(self, n: int | None = None, spec: Any = None, **pairs: Any) -> Row | list[Row] | None:
        """The first row, or the first n; with a condition, of the rows for which it holds."""
        rows = self.where(spec, **pairs) if spec is not None or pairs else self
        return rows.limit(1).df.first() if n is None else rows.limit(n).df.collect()

    def first_or_raise(self) -> Row:
        if (row := self.first()) is None:
            raise NoMatchingRow
        return row

    def last(self) -> Row | None:
        if not self.order_keys:
            raise ValueError("last needs an order")
        return self.reverse().first()

    def get(self, column: Key) -> Any:
        row = self.select(column).first()
        return None if row is None else row[0]

    def all(self) -> list[Row]:
        return self.df.collect()

    def __iter__(self) -> Iterator[Row]:
        return self.df.toLocalIterator()

    def as_hash(self, key: str, value: str) -> dict:
        """Value by key; of rows with one key the last wins."""
        return {r[0]: r[1] for r in self.select(key, value).df.collect()}

    def to_groups(self, key: str, value: str) -> dict:
        out: dict = {}
        for r in self.select(key, value).df.collect():
            out.setdefault(r[0], []).append(r[1])
        return out

    def select_map(self, column: Key) -> list:
        return [r[0] for r in self.select(column).df.collect()]

    def select_order_map(self, column: str) -> list:
        return self.select(column).order(column).select_map(column)

    def select_set(self, column: Key) -> set:
        return {r[0] for r in self.select(column).df.distinct().collect()}

    def select_hash(self, key: str, value: str) -> dict:
        return self.as_hash(key, value)

    def select_hash_groups(self, key: str, value: str) -> dict:
        return self.to_groups(key, value)

    def single_value(self) -> Any:
        row = self.first()
        return None if row is None else row[0]

    def single_value_or_raise(self) -> Any:
        return self.first_or_raise()[0]

    def explain(self, mode: str = "formatted") -> str:
        """Spark's plan as text."""
        return self.df._jdf.queryExecution().explainString(self.df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString(mode))

    def each_page(self, size: int) -> Iterator[Any]:
        """The pages of an ordered query one after another."""
        from .paging import paginate

        if not self.order_keys:
            raise ValueError("each_page needs an order")
        page = paginate(self.df, 1, size)
        yield page
        while page.next:
            page = paginate(self.df, page.next, size, page.record_count)
            yield page

    def paged_datasets(self, rows: int = 1000) -> Iterator[Dataset]:
        """A query for each page of an ordered one, cut at keys; the order must be unique."""
        if not self.order_keys:
            raise ValueError("paged_datasets needs an order")
        from .paging import after

        names, rest = [c for c, _, _ in self.order_keys], self
        while (end := rest.select(*names).limit(1, rows - 1).df.first()) is not None:
            yield rest.where(~after(self.order_keys, list(end)))
            rest = self.where(after(self.order_keys, list(end)))
        if not rest.empty():
            yield rest

    def paged_each(self, rows: int = 1000) -> Iterator[Row]:
        """All rows in order, fetched in pages after the last key seen; the order must be unique."""
        if not self.order_keys:
            raise ValueError("paged_each needs an order")
        from .paging import after

        last = None
        while True:
            page = self if last is None else self.where(after(self.order_keys, last))
            found = page.limit(rows).df.collect()
            yield from found
            if len(found) < rows:
                return
            last = [found[-1][c] for c, _, _ in self.order_keys]


def where_all(df: DataFrame, *specs: Any) -> DataFrame:
    return df.where(all_of(conditions(s) for s in specs))
