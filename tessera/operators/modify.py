"""INSERT, UPDATE, DELETE and MERGE as functions from a snapshot to the next one.

Plain files have no row-level changes; each function returns the table as it would be, and
``write_snapshot`` puts that next to the old one.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .filters import all_of, conditions


def _value(v: Any) -> Column:
    return v if isinstance(v, Column) else F.lit(v)


def insert(table: DataFrame, rows: DataFrame | Sequence[Mapping[str, Any]]) -> DataFrame:
    """The table and the rows; columns that a row does not name are null."""
    if not isinstance(rows, DataFrame):
        rows = table.sparkSession.createDataFrame([tuple(r.get(c) for c in table.columns) for r in rows], table.schema)
    missing = {f.name: F.lit(None).cast(f.dataType) for f in table.schema if f.name not in rows.columns}
    return table.unionByName(rows.withColumns(missing).select(*table.columns))


def update(table: DataFrame, where: Any, values: Mapping[str, Any]) -> DataFrame:
    hit = F.coalesce(conditions(where), F.lit(False))
    changed = {c: F.when(hit, _value(v).cast(table.schema[c].dataType)).otherwise(F.col(c)) for c, v in values.items()}
    return table.select(*(changed.get(c, F.col(c)).alias(c) for c in table.columns))


def updated_rows(table: DataFrame, where: Any, values: Mapping[str, Any]) -> DataFrame:
    """UPDATE ... RETURNING: the changed rows as they are afterwards."""
    return update(table.where(conditions(where)), F.lit(True), values)


def delete(table: DataFrame, where: Any) -> DataFrame:
    """Rows for which the condition is false or null stay."""
    return table.where(~F.coalesce(conditions(where), F.lit(False)))


def deleted_rows(table: DataFrame, where: Any) -> DataFrame:
    """DELETE ... RETURNING: the rows that go."""
    return table.where(conditions(where))


def delete_using(table: DataFrame, other: DataFrame, on: Column) -> DataFrame:
    """DELETE with a join: rows that have a partner go."""
    return table.join(other, on, "left_anti")


@dataclass(frozen=True)
class Branch:
    """One WHEN of a MERGE.  on: matched, not_matched or not_matched_by_source; values None means delete
    (or, with nothing set, do nothing)."""

    on: str
    values: Mapping[str, Column] | None = None
    when: Column | None = None
    nothing: bool = False


def merge(target: DataFrame, source: DataFrame, keys: Mapping[str, str], branches: Sequence[Branch]) -> DataFrame:
    """The target after the first branch that fits each row.

    Conditions and values name columns as ``t.x`` and ``s.x``.  One full join by the keys;
    the source's keys must be unique, as in SQL.
    """
    t = target.withColumn("_t", F.lit(True)).alias("t")
    s = source.withColumn("_s", F.lit(True)).alias("s")
    rows = t.join(s, all_of(F.col(f"t.{a}") == F.col(f"s.{b}") for a, b in keys.items()), "full")
    state = F.when(F.col("_t") & F.col("_s"), "matched").when(F.col("_s"), "not_matched").otherwise("not_matched_by_source")
    fits = [(state == b.on) & (F.lit(True) if b.when is None else F.coalesce(b.when, F.lit(False))) for b in branches]

    def pick(name: str) -> Column:
        out = None
        for b, fit in zip(branches, fits, strict=True):
            kept = F.col(f"t.{name}")
            v = kept if b.nothing or b.values is None else b.values.get(name, F.lit(None) if b.on == "not_matched" else kept)
            out = F.when(fit, v) if out is None else out.when(fit, v)
        return (F.col(f"t.{name}") if out is None else out.otherwise(F.col(f"t.{name}"))).cast(target.schema[name].dataType)

    stays = None
    for b, fit in zip(branches, fits, strict=True):
        there = F.col("_t").isNotNull() if b.nothing else F.lit(b.values is not None)
        stays = F.when(fit, there) if stays is None else stays.when(fit, there)
    there = F.col("_t").isNotNull()
    stays = there if stays is None else stays.otherwise(there)
    return rows.where(stays).select(*(pick(c).alias(c) for c in target.columns))


def upsert(table: DataFrame, rows: DataFrame, key: str | Sequence[str], update_columns: Sequence[str] | None = None, ignore: bool = False) -> DataFrame:
    """INSERT ... ON CONFLICT (keys): update the columns (all others by default), or ignore the new row."""
    keys = [key] if isinstance(key, str) else list(key)
    columns = [c for c in (update_columns or table.columns) if c not in keys]
    matched = Branch("matched", nothing=True) if ignore else Branch("matched", {c: F.col(f"s.{c}") for c in columns})
    return merge(table, rows, {k: k for k in keys}, [matched, Branch("not_matched", {c: F.col(f"s.{c}") for c in table.columns})])


def replace(table: DataFrame, rows: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """REPLACE: rows of the table with a key of the new ones go, and all new ones come in; columns that they lack are null."""
    keys = [key] if isinstance(key, str) else list(key)
    return insert(table.join(rows.select(*keys), keys, "left_anti").select(*table.columns), rows)


def update_using(table: DataFrame, other: DataFrame, keys: Mapping[str, str], values: Mapping[str, Column]) -> DataFrame:
    """UPDATE with a join; values name columns as ``t.x`` and ``s.x``.  The other table's keys must be unique."""
    return merge(table, other, keys, [Branch("matched", values)])


def insert_select(table: DataFrame, rows: DataFrame | Sequence[Mapping[str, Any]]) -> DataFrame:
    """The rows as an insert makes them: columns of the table, null where a row does not name one."""
    return insert(truncate(table), rows)


def truncate(table: DataFrame) -> DataFrame:
    return table.where(F.lit(False))


def for_portion_of(table: DataFrame, start: str, end: str, low: Any, high: Any, where: Any, values: Mapping[str, Any]) -> DataFrame:
    """Temporal UPDATE of [low, high): a row that reaches beyond is split, and only its part inside changes."""
    low, high = _value(low), _value(high)
    hit = F.coalesce(conditions(where), F.lit(False)) & (F.col(start) < high) & (F.col(end) > low)
    parts = F.when(hit, F.array(
        F.struct(F.col(start).alias("a"), F.least(F.greatest(F.col(start), low), F.col(end)).alias("b"), F.lit(False).alias("in")),
        F.struct(F.greatest(F.col(start), low).alias("a"), F.least(F.col(end), high).alias("b"), F.lit(True).alias("in")),
        F.struct(F.least(F.col(end), high).alias("a"), F.col(end).alias("b"), F.lit(False).alias("in")),
    )).otherwise(F.array(F.struct(F.col(start).alias("a"), F.col(end).alias("b"), F.lit(False).alias("in"))))
    rows = table.withColumn("_p", F.explode(parts)).where("_p.a < _p.b")
    new = {c: F.when(F.col("_p.in"), _value(v)).otherwise(F.col(c)) for c, v in values.items()}
    new |= {start: F.col("_p.a"), end: F.col("_p.b")}
    return rows.select(*(new.get(c, F.col(c)).cast(table.schema[c].dataType).alias(c) for c in table.columns))


def write_snapshot(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.parquet(path)
