"""Joins by columns, pairs or conditions; semi and anti joins; graphs of several tables."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ranges
from .filters import all_of


def join(left: DataFrame, right: DataFrame, on: Any = None, how: str = "inner") -> DataFrame:
    """on: names (USING), pairs of a right and a left column, a condition, or None for all pairs of rows."""
    if on is None:
        return left.crossJoin(right)
    if isinstance(on, Mapping):
        on = all_of(right[r] == left[c] for r, c in on.items())
    return left.join(right, on, how)


def natural_join(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """Equal values in all columns of the same name, which appear once."""
    shared = [c for c in left.columns if c in right.columns]
    return left.join(right, shared, how) if shared else left.crossJoin(right)


def exists(df: DataFrame, other: DataFrame, on: Any) -> DataFrame:
    return join(df, other, on, "left_semi")


def not_exists(df: DataFrame, other: DataFrame, on: Any) -> DataFrame:
    return join(df, other, on, "left_anti")


def in_query(df: DataFrame, columns: list[str], other: DataFrame) -> DataFrame:
    """Rows whose columns are, by position, among the rows of another query."""
    named = other.toDF(*(f"_in{i}" for i in range(len(columns))))
    return df.join(named, all_of(F.col(c) == F.col(f"_in{i}") for i, c in enumerate(columns)), "left_semi")


def not_in_query(df: DataFrame, column: str, other: DataFrame) -> DataFrame:
    """NOT IN as SQL has it: a null in the query leaves no row; a null in the column only stays if the query is empty.

    The query's facts (rows, nulls) come from one aggregate of one row, so that the join
    stays an equality join instead of the nested loop that three-valued logic would need.
    """
    named = other.toDF("_in")
    facts = named.agg(F.count(F.lit(1)).alias("_rows"), F.count("_in").alias("_known"))
    kept = df.join(named.where("_in IS NOT NULL"), F.col(column) == F.col("_in"), "left_anti").crossJoin(facts)
    good = (F.col("_rows") == 0) | ((F.col("_rows") == F.col("_known")) & F.col(column).isNotNull())
    return kept.where(good).drop("_rows", "_known")


def apply(left: DataFrame, right: DataFrame, on: Column | None = None, outer: bool = False) -> DataFrame:
    """CROSS or OUTER APPLY: a lateral join; right may refer to left's columns with ``.outer()``."""
    return left.lateralJoin(right, on, "left" if outer else "inner")


def overlap_join(left: DataFrame, right: DataFrame, a: str, b: str, width: float) -> DataFrame:
    """Pairs of rows whose ranges of numbers overlap, by an equality join on bins of a width.

    A row goes to every bin that its range reaches, and a pair is kept in the first bin that both reach, so that it
    comes once.  An open end reaches as far as any end on either side.  Choose a width of about a usual range.
    """
    known = left.select(F.explode(F.array(f"{a}.lower", f"{a}.upper")).alias("x")).union(right.select(F.explode(F.array(f"{b}.lower", f"{b}.upper"))))
    ends = known.agg(F.coalesce(F.min("x"), F.lit(0)).alias("_low"), F.coalesce(F.max("x"), F.lit(0)).alias("_high"))

    def binned(df: DataFrame, r: str, first: str) -> DataFrame:
        at = lambda end, limit: F.floor(F.coalesce(F.col(f"{r}.{end}"), F.col(limit)) / width)
        rows = df.where(F.col(r).isNotNull() & ~ranges.is_empty(r)).crossJoin(F.broadcast(ends))  # one row
        rows = rows.withColumn(first, at("lower", "_low"))
        return rows.withColumn("_bin", F.explode(F.sequence(F.col(first), at("upper", "_high")))).drop("_low", "_high")

    pairs = binned(left, a, "_first_a").join(binned(right, b, "_first_b"), "_bin")
    own = (F.col("_bin") == F.greatest("_first_a", "_first_b")) & ranges.overlaps(a, b)
    return pairs.where(own).drop("_bin", "_first_a", "_first_b")


def graph(tables: Mapping[str, DataFrame], links: Mapping[str, Column], how: str = "left") -> DataFrame:
    """Joins tables under their aliases and keeps each one's row apart.

    The first table is the root; links has a condition in qualified names for each other one.
    The result has a struct for each table, null where an outer join found nothing.
    """
    names = list(tables)
    out = None
    for name in names:
        row = tables[name].withColumn("_here", F.lit(True)).alias(name)
        out = row if out is None else out.join(row, links[name], how)
    return out.select(*(
        F.when(F.col(f"{n}._here"), F.struct(*(F.col(f"{n}.{c}") for c in tables[n].columns))).alias(n) for n in names
    ))


def graph_columns(tables: Mapping[str, DataFrame], links: Mapping[str, Column], how: str = "left") -> DataFrame:
    """Like ``graph``, flat: a column whose name is taken is called table_column, then table_column_0 and so on."""
    rows = graph(tables, links, how)
    taken: list[str] = []
    out = []
    for t, df in tables.items():
        for c in df.columns:
            name, n = c, -1
            while name in taken:
                name, n = (f"{t}_{c}" if n < 0 else f"{t}_{c}_{n}"), n + 1
            taken.append(name)
            out.append(F.col(f"{t}.{c}").alias(name))
    return rows.select(*out)


def path(vertices: DataFrame, edges: DataFrame, steps: int, key: str, source: str, target: str, kind: str = "steps") -> DataFrame:
    """Rows of vertex keys v0 .. vn along paths of n edges, by joining the edges end to end."""
    out = vertices.select(F.col(key).alias("v0"))
    hop = edges.select(F.col(source).alias("_from"), F.col(target).alias("_to"))
    for i in range(steps):
        out = out.join(hop, F.col(f"v{i}") == F.col("_from")).withColumnRenamed("_to", f"v{i + 1}").drop("_from")
    return out
