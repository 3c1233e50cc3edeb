"""Set operations by position; distinct unless all is asked for."""

from __future__ import annotations

from pyspark.sql import DataFrame


def union(a: DataFrame, b: DataFrame, all: bool = False) -> DataFrame:  # noqa: A002
    return a.union(b) if all else a.union(b).distinct()


def intersect(a: DataFrame, b: DataFrame, all: bool = False) -> DataFrame:  # noqa: A002
    return a.intersectAll(b) if all else a.intersect(b)


def except_(a: DataFrame, b: DataFrame, all: bool = False) -> DataFrame:  # noqa: A002
    return a.exceptAll(b) if all else a.subtract(b)
