"""Windows over event streams; each function takes a stream or a table alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_stream(spark: SparkSession, folder: str, schema, pattern: str = "events.parquet", **options: str) -> DataFrame:
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).options(**options).parquet(folder)


def _late(df: DataFrame, column: str, delay: str) -> DataFrame:
    return df.withWatermark(column, delay) if df.isStreaming else df


def tumbling(events: DataFrame, size: str, keys: tuple[str, ...] = (), delay: str = "10 minutes", time: str = "ts", value: str = "value") -> DataFrame:
    """n and total of each window and key."""
    grouped = _late(events, time, delay).groupBy(F.window(time, size), *keys)
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("start"), *keys, "n", "total")


def sliding(events: DataFrame, size: str, slide: str, keys: tuple[str, ...] = (), delay: str = "10 minutes", time: str = "ts", value: str = "value") -> DataFrame:
    grouped = _late(events, time, delay).groupBy(F.window(time, size, slide), *keys)
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("start"), *keys, "n", "total")


def sessions(events: DataFrame, gap: str, key: str = "user_id", delay: str = "10 minutes", time: str = "ts") -> DataFrame:
    """Each key's stretches without a pause of ``gap``: start, end of the last event plus gap, n."""
    grouped = _late(events, time, delay).groupBy(F.session_window(time, gap), key)
    return grouped.agg(F.count(F.lit(1)).alias("n")).select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def once(events: DataFrame, keys: list[str], delay: str = "10 minutes", time: str = "ts") -> DataFrame:
    """Each event once; a stream forgets keys after the delay."""
    return _late(events, time, delay).dropDuplicatesWithinWatermark(keys) if events.isStreaming else events.dropDuplicates(keys)
