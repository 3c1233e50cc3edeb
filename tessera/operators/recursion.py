"""Recursive queries: step by step over the new rows, until there are none."""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import collections as c


def _kept(df: DataFrame) -> DataFrame:
    """The rows written to the checkpoint folder, so that a step's plan does not hold all steps before."""
    spark = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None) and not spark.sparkContext.getCheckpointDir():
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tessera-checkpoint-"))
    return df.checkpoint(eager=True)


def recursive(base: DataFrame, step: Callable[[DataFrame], DataFrame], *, distinct: bool = False, most_steps: int = 100) -> DataFrame:
    """WITH RECURSIVE: base, then step of the rows that the last step added, and so on.

    distinct drops rows that came before (UNION); without it (UNION ALL) a cycle runs until
    most_steps and then raises.
    """
    new = _kept(base.distinct() if distinct else base)
    out = new
    for _ in range(most_steps):
        new = step(new)
        if distinct:
            new = new.distinct().subtract(out)
        new = _kept(new)
        if new.isEmpty():
            return out
        out = out.unionByName(new)
    raise RecursionError(f"more than {most_steps} steps")


def descendants(tree: DataFrame, roots: Column, key: str = "id", parent: str = "parent_id", most_levels: int | None = None) -> DataFrame:
    """Rows below the chosen ones with root and level (1 for children)."""
    below = tree.select(F.col(key).alias("_key"), F.col(parent).alias("_parent"))
    base = tree.where(roots).select(F.col(key).alias("root"), F.col(key).alias("node"), F.lit(0).alias("level"))

    def step(rows: DataFrame) -> DataFrame:
        if most_levels is not None:
            rows = rows.where(F.col("level") < most_levels)
        return rows.join(below, F.col("node") == F.col("_parent")).select("root", F.col("_key").alias("node"), (F.col("level") + 1).alias("level"))

    return recursive(base, step).where("level > 0")


def ancestors(tree: DataFrame, chosen: Column, key: str = "id", parent: str = "parent_id") -> DataFrame:
    """Rows above the chosen ones with start and level (1 for the parent)."""
    up = tree.select(F.col(key).alias("_key"), F.col(parent).alias("_parent"))
    base = tree.where(chosen).select(F.col(key).alias("start"), F.col(key).alias("node"), F.lit(0).alias("level"))

    def step(rows: DataFrame) -> DataFrame:
        found = rows.join(up, F.col("node") == F.col("_key")).where(F.col("_parent").isNotNull())
        return found.select("start", F.col("_parent").alias("node"), (F.col("level") + 1).alias("level"))

    return recursive(base, step).where("level > 0")


def with_descendants(tree: DataFrame, roots: Column, name: str, key: str = "id", parent: str = "parent_id", most_levels: int | None = None) -> DataFrame:
    """Chosen rows, each with all rows below it as an array of level and row, level by level."""
    rows = tree.select(F.col(key).alias("node"), F.struct(*tree.columns).alias("row"))
    found = descendants(tree, roots, key, parent, most_levels).join(rows, "node")
    gathered = F.sort_array(F.collect_list(F.struct("level", "node", "row")))
    below = found.groupBy("root").agg(F.transform(gathered, lambda x: F.struct(x.level.alias("level"), x.row.alias("row"))).alias(name))
    chosen = tree.where(roots)
    return chosen.join(below, F.col(key) == F.col("root"), "left").select(*chosen.columns, F.coalesce(name, F.array().cast(below.schema[name].dataType)).alias(name))


def json_tree(df: DataFrame, column: str, keep: list[str]) -> DataFrame:
    """A row for each value in a JSON text, the nested ones included: the kept columns, path, type and value as JSON text."""
    base = df.select(*keep, F.lit("$").alias("path"), F.col(column).alias("value")).where(c.is_json("value"))

    def step(rows: DataFrame) -> DataFrame:
        at = lambda tail, v: F.struct(F.concat(F.col("path"), *tail).alias("path"), F.to_json(v).alias("value"))
        members = F.transform(F.map_entries(c.json_members("value")), lambda e: at((F.lit("."), e.key), e.value))
        elements = F.transform(c.json_elements("value"), lambda v, i: at((F.lit("["), i.cast("string"), F.lit("]")), v))
        kind = c.json_type("value")
        return rows.select(*keep, F.explode(F.when(kind == "object", members).when(kind == "array", elements)).alias("_x")).select(*keep, "_x.*")

    return recursive(base, step).select(*keep, "path", c.json_type("value").alias("type"), "value")


def walk(edges: DataFrame, start: DataFrame, source: str, target: str, most_steps: int = 100) -> DataFrame:
    """Paths from start along edges: node, path, is_cycle; a path ends where it meets itself (CYCLE)."""
    hop = edges.select(F.col(source).alias("_from"), F.col(target).alias("_to"))
    base = start.toDF("node").select("node", F.array("node").alias("path"), F.lit(False).alias("is_cycle"))

    def step(rows: DataFrame) -> DataFrame:
        found = rows.where(~F.col("is_cycle")).join(hop, F.col("node") == F.col("_from"))
        return found.select(
            F.col("_to").alias("node"), F.array_append("path", F.col("_to")).alias("path"), F.array_contains("path", F.col("_to")).alias("is_cycle"))

    return recursive(base, step, most_steps=most_steps)
