"""Associations between tables: nested loading, joins and filters by name.

Everything is a join or a window over whole tables; nothing loads row by row.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from .filters import all_of
from .paging import top_per_group


@dataclass(frozen=True)
class Association:
    """How rows of one table reach rows of another.

    keys: own column -> column of the other table, or of the join table if through is given;
    far_keys then lead from the join table to the other one.
    """

    name: str
    other: DataFrame
    keys: Mapping[str, str]
    through: DataFrame | None = None
    far_keys: Mapping[str, str] = field(default_factory=dict)
    one: bool = False
    order: Sequence[Column] = ()
    limit: int | None = None
    offset: int = 0

    def refined(self, change: Callable[[DataFrame], DataFrame], **options) -> Association:
        """The association over changed rows of the other table (a condition, a join), or with other options (order, limit, name)."""
        return replace(self, other=change(self.other), **options)

    def rows(self) -> DataFrame:
        """The other table's rows as struct ``row`` with the columns _k0, _k1 ... that own rows match."""
        row = F.struct(*(F.col(f"o.{c}") for c in self.other.columns)).alias("row")
        if self.through is None:
            out = self.other.alias("o").select(*(F.col(f"o.{c}").alias(f"_k{i}") for i, c in enumerate(self.keys.values())), row)
        else:
            on = all_of(F.col(f"j.{a}") == F.col(f"o.{b}") for a, b in self.far_keys.items())
            out = self.through.alias("j").join(self.other.alias("o"), on).select(
                *(F.col(f"j.{c}").alias(f"_k{i}") for i, c in enumerate(self.keys.values())), row)
        limit, keys = 1 if self.one else self.limit, [f"_k{i}" for i in range(len(self.keys))]
        if self.order:
            nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*self.order))
            out = out.select("*", "row.*").select(*keys, "row", nth.alias("_n"))
            if limit is not None:
                out = out.where(F.col("_n").between(self.offset + 1, self.offset + limit))
        elif limit == 1 and not self.offset:  # any one row, by one aggregate
            out = out.groupBy(*keys).agg(F.first("row").alias("row"))
        elif limit is not None:
            columns = [f"row.{f.name}" for f in self.other.schema if not isinstance(f.dataType, MapType)]
            out = top_per_group(out, keys, [F.col(c) for c in columns], limit, self.offset)
        return out

    def on(self, own: DataFrame) -> Column:
        return all_of(own[c] == F.col(f"_k{i}") for i, c in enumerate(self.keys))


def association_join(own: DataFrame, association: Association, how: str = "inner") -> DataFrame:
    """Own columns and the struct of the other row under the association's name."""
    joined = own.join(association.rows(), association.on(own), how)
    return joined.select(*(own[c] for c in own.columns), F.col("row").alias(association.name))


def eager(own: DataFrame, *associations: Association) -> DataFrame:
    """Own rows, each with a struct or an array of structs for each association.

    Many rows are gathered per key before the join, so that two associations do not multiply
    each other.
    """
    out = own
    for a in associations:
        keys = [f"_k{i}" for i in range(len(a.keys))]
        rows = a.rows()
        if not a.one and a.order:  # in the declared order
            gathered = F.array_sort(F.collect_list(F.struct("_n", "row")), lambda x, y: x["_n"] - y["_n"])
            rows = rows.groupBy(*keys).agg(F.transform(gathered, lambda x: x.row).alias("row"))
        elif not a.one:
            rows = rows.groupBy(*keys).agg(F.sort_array(F.collect_list("row")).alias("row"))
        else:
            rows = rows.select(*keys, "row")
        joined = out.join(rows, all_of(out[c] == F.col(f"_k{i}") for i, c in enumerate(a.keys)), "left")
        empty = F.col("row") if a.one else F.coalesce("row", F.array().cast(rows.schema["row"].dataType))
        out = joined.select(*(out[c] for c in out.columns), empty.alias(a.name))
    return out


def with_any(own: DataFrame, association: Association, condition: Column | None = None) -> DataFrame:
    """Rows that have an associated row (for which the condition, on ``row.x``, holds)."""
    rows = association.rows()
    return own.join(rows if condition is None else rows.where(condition), association.on(own), "left_semi")


def without_any(own: DataFrame, association: Association, condition: Column | None = None) -> DataFrame:
    rows = association.rows()
    return own.join(rows if condition is None else rows.where(condition), association.on(own), "left_anti")


def associated(own: DataFrame, association: Association) -> DataFrame:
    """The distinct associated rows of all own rows."""
    rows = association.rows()
    keys = own.select(*(F.col(c).alias(f"_o{i}") for i, c in enumerate(association.keys))).distinct()
    on = all_of(F.col(f"_o{i}") == F.col(f"_k{i}") for i in range(len(association.keys)))
    return rows.join(keys, on, "left_semi").select("row.*").distinct()


def to_many_by_array(own: DataFrame, array: str, other: DataFrame, key: str, name: str) -> DataFrame:
    """Own rows with the other table's rows whose key is in an array column."""
    arrays = own.select(F.col(array).alias("_a")).distinct()  # rows with one array have the same partners
    pairs = arrays.select("_a", F.explode(F.array_distinct("_a")).alias("_k")).join(other, F.col("_k") == other[key])
    found = pairs.groupBy("_a").agg(F.sort_array(F.collect_list(F.struct(*(other[c] for c in other.columns)))).alias(name))
    return own.join(found, own[array] == found["_a"], "left").select(*(own[c] for c in own.columns), name)
