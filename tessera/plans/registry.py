"""Where queries and their SQL are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import NAMES, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The tables of a folder by attribute: t.orders."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self._sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name not in NAMES:
            raise AttributeError(name)
        return table(self.spark, self._sf_dir, name)


def query(sql: str | None = None):
    """Registers a function of Tables under its name."""

    def register(function: Callable[[Tables], DataFrame]):
        QUERIES[function.__name__] = lambda spark, sf_dir: function(Tables(spark, sf_dir))
        if sql:
            ORACLES[function.__name__] = sql
        return function

    return register
