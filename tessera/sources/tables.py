"""Reading and writing tables."""

from __future__ import annotations

import re
from typing import Any

from pyspark.sql import DataFrame, SparkSession

#: Tables of the driver's data.
NAMES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def values(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def fetch(spark: SparkSession, sql: str, *args: Any, **named: Any) -> DataFrame:
    """A query with ? or :name placeholders."""
    return spark.sql(sql, args=named or list(args))


def read_file(spark: SparkSession, path: str, kind: str, schema: str | None = None, **options: Any) -> DataFrame:
    """csv, json, xml, orc, parquet or text."""
    reader = spark.read.format(kind).options(**options)
    return (reader.schema(schema) if schema else reader).load(path)


def write_file(df: DataFrame, path: str, kind: str, mode: str = "errorifexists", partition_by: tuple[str, ...] = (), **options: Any) -> None:
    df.write.format(kind).mode(mode).options(**options).partitionBy(*partition_by).save(path)


def read_jdbc(spark: SparkSession, url: str, name: str, *, column: str | None = None, bounds: tuple[Any, Any] | None = None, partitions: int = 1, **properties: str) -> DataFrame:
    """A table of another database, read in parallel by ranges of a column."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=name, **properties)
    if column and bounds:
        reader = reader.options(partitionColumn=column, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=partitions)
    return reader.load()


def co_located(df: DataFrame, name: str, keys: list[str], buckets: int) -> DataFrame:
    """The table saved in buckets by its keys, so that joins and groups by them need no shuffle."""
    df.write.bucketBy(buckets, *keys).sortBy(*keys).mode("overwrite").saveAsTable(name)
    return df.sparkSession.table(name)


def describe(spark: SparkSession, name: str) -> list[tuple[str, str, bool]]:
    return [(c.name, c.dataType, c.nullable) for c in spark.catalog.listColumns(name)]


def loose_count(spark: SparkSession, name: str) -> int | None:
    """The number of rows that the catalog knows from the last ANALYZE TABLE, without a scan; None if it knows none."""
    found = spark.sql(f"DESCRIBE EXTENDED {name}").where("col_name = 'Statistics'").first()
    rows = None if found is None else re.search(r"(\d+) rows", found.data_type)
    return None if rows is None else int(rows[1])


def tables(spark: SparkSession) -> list[str]:
    return sorted(t.name for t in spark.catalog.listTables())
