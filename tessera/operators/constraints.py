"""Constraints as queries: each function returns the rows or keys that break one."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .filters import all_of, conditions


def check_violations(df: DataFrame, condition: Any) -> DataFrame:
    """CHECK: rows for which the condition is false; where it is null, a row passes."""
    return df.where(~conditions(condition))


def unique_violations(df: DataFrame, *keys: str) -> DataFrame:
    """UNIQUE: keys that several rows hold, with their number ``n``; a key with a null is like no other."""
    known = df.where(all_of(F.col(k).isNotNull() for k in keys))
    return known.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def missing_references(df: DataFrame, other: DataFrame, keys: Mapping[str, str]) -> DataFrame:
    """FOREIGN KEY: rows whose key the other table lacks; a key with a null refers to nothing and passes."""
    held = other.select(*(F.col(b).alias(f"_k{i}") for i, b in enumerate(keys.values())))
    known = df.where(all_of(F.col(a).isNotNull() for a in keys))
    return known.join(held, all_of(F.col(a) == F.col(f"_k{i}") for i, a in enumerate(keys)), "left_anti")


def overlap_violations(df: DataFrame, keys: Sequence[str], start: str, end: str) -> DataFrame:
    """EXCLUDE: rows whose [start, end) meets that of another row with the same keys; empty and open-ended ones are passed over.

    One sort by the keys and the start instead of pairs: a row meets an earlier one if the latest
    end so far lies beyond its start, and a later one if the next start lies before its end.
    """
    w = Window.partitionBy(*keys).orderBy(start, end)
    latest = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = df.where(F.col(start) < F.col(end)).withColumns({"_latest": latest, "_next": F.lead(start).over(w)})
    return marked.where((F.col("_latest") > F.col(start)) | (F.col("_next") < F.col(end))).drop("_latest", "_next")
