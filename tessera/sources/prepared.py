"""Queries prepared once and called with values."""

from __future__ import annotations

from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Prepared:
    """SQL with :names, the values bound so far, and the tables that it calls by {name}."""

    spark: SparkSession
    sql: str
    tables: tuple[tuple[str, DataFrame], ...] = ()
    values: tuple[tuple[str, Any], ...] = ()

    def bind(self, **values: Any) -> Prepared:
        """Later values replace earlier ones."""
        return replace(self, values=tuple((dict(self.values) | values).items()))

    def call(self, **values: Any) -> DataFrame:
        return self.spark.sql(self.sql, args=dict(self.values) | values, **dict(self.tables))
