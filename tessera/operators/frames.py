"""Named windows, frames that Spark's windows do not have (GROUPS offsets and EXCLUDE), and counts over wide range frames."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

#: Quantiles at which ``range_count`` cuts the values.
PARTS = 1024


@dataclass(frozen=True)
class Named:
    """A window that others may start from; rows and range are a frame's two ends."""

    partition: tuple = ()
    order: tuple = ()
    rows: tuple[int, int] | None = None
    range: tuple[int, int] | None = None

    def extended(self, more: Named) -> Named:
        """As in SQL: what starts from a window adds an order if that has none, and a frame; never a partition."""
        if more.partition or (more.order and self.order) or self.rows or self.range:
            raise ValueError("a window that starts from another one only adds an order, or a frame where there is none")
        return Named(self.partition, more.order or self.order, more.rows, more.range)

    @property
    def spec(self) -> WindowSpec:
        out = Window.partitionBy(*self.partition)
        out = out.orderBy(*self.order) if self.order else out
        out = out.rowsBetween(*self.rows) if self.rows else out
        return out.rangeBetween(*self.range) if self.range else out


def groups_frame(df: DataFrame, partition: Sequence[str], order: str, start: int, end: int, **outputs: Callable[[Column], Column] | tuple) -> DataFrame:
    """Aggregates over peer groups start..end around each row's own (negative: before).

    Every row gets the number of its peer group, and a range frame over that number is the
    frame in groups.  outputs: name = (aggregate function, column).
    """
    peers = df.withColumn("_peer", F.dense_rank().over(Window.partitionBy(*partition).orderBy(order)))
    frame = Window.partitionBy(*partition).orderBy("_peer").rangeBetween(start, end)
    return peers.withColumns({name: f(c).over(frame) for name, (f, c) in outputs.items()}).drop("_peer")


def range_count(df: DataFrame, partition: Sequence[str], order: str, start: float, end: float, name: str, parts: int = PARTS) -> DataFrame:
    """count(*) OVER (PARTITION BY ... ORDER BY order RANGE start..end), for numbers and finite ends (negative: before).

    Spark's own range frame adds up all rows of the frame for each row, a partition in a task.  Here the count is
    the rows up to a frame's end less those before its start: each distinct value asks at both ends, and a running count
    over values and questions answers.  It is taken in bins, after the sum of those before.  Bins are cut at quantiles of
    the values and at these moved by both ends, so a bin holds few values and few questions, whatever gaps and
    repeated values there are; where they are cut changes no result.  The frame of a null holds the nulls.
    """
    if start > end:
        raise ValueError("a frame starts before its end")
    quantiles = df.select(F.col(order).cast("double").alias("_v")).approxQuantile("_v", [i / parts for i in range(parts + 1)], 0.25 / parts)
    cuts = {-float("inf"), 0.0, float("inf")} | {q + by for q in quantiles for by in (start, 0, end)}
    bins = Bucketizer(splits=sorted(cuts), inputCol="_place", outputCol="_cell", handleInvalid="keep")
    keys = [f"_k{i}" for i in range(len(partition))]
    counted = df.groupBy(*(F.col(c).alias(k) for c, k in zip(partition, keys, strict=True)), F.col(order).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    asked = counted.select(*keys, "_v", F.posexplode(F.array(F.lit(0).cast("long"), F.col("_c"), F.lit(0).cast("long"))).alias("_kind", "_n"))  # start, the value, end
    asked = asked.withColumn("_at", F.col("_v") + F.when(F.col("_kind") == 0, F.lit(start)).when(F.col("_kind") == 2, F.lit(end)).otherwise(F.lit(0)))
    asked = bins.transform(asked.withColumn("_place", F.col("_at").cast("double")))
    asked = asked.select(*keys, F.coalesce(F.col("_cell").cast("int"), F.lit(-1)).alias("_bin"), "_at", "_kind", "_n", "_v")
    earlier = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    totals = asked.groupBy(*keys, "_bin").agg(F.sum("_n").alias("_all"))
    totals = totals.select(*(F.col(k).alias(f"{k}_") for k in keys), F.col("_bin").alias("_bin_"), F.coalesce(F.sum("_all").over(earlier), F.lit(0)).alias("_before"))
    running = Window.partitionBy(*keys, "_bin").orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    same = [F.col(k).eqNullSafe(F.col(f"{k}_")) for k in keys]
    found = asked.withColumn("_upto", F.sum("_n").over(running)).where("_kind <> 1").join(totals, [F.col("_bin") == F.col("_bin_"), *same])
    upto = F.col("_before") + F.col("_upto")
    found = found.groupBy(*keys, "_v").agg(F.sum(F.when(F.col("_kind") == 2, upto).otherwise(-upto)).alias("_found"))
    own = [F.col(c).eqNullSafe(F.col(k)) for c, k in zip([*partition, order], [*keys, "_v"], strict=True)]
    return df.join(found, own).select(*df.columns, F.col("_found").alias(name))


def sum_excluding(df: DataFrame, partition: Sequence[str], order: Sequence[str], value: str, exclude: str, name: str, start: int = Window.unboundedPreceding, end: int = Window.currentRow) -> DataFrame:
    """A running sum by rows that leaves out the current row, its peers (group) or its other peers (ties).

    The rows left out are summed on their own and taken off; a frame that has no row left
    sums to null.  For ``group`` and ``ties`` the frame must hold all peers or go by range.
    """
    ordered = Window.partitionBy(*partition).orderBy(*order)
    frame = ordered.rowsBetween(start, end) if exclude == "current" else ordered.rangeBetween(start, end)
    peers = Window.partitionBy(*partition, *order)
    own = F.col(value)
    total = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0))
    left_out = {"current": F.coalesce(own, F.lit(0)), "group": total(own, peers), "ties": total(own, peers) - F.coalesce(own, F.lit(0))}[exclude]
    known = F.count(own).over(frame)
    known_out = {"current": own.isNotNull().cast("int"), "group": F.count(own).over(peers), "ties": F.count(own).over(peers) - own.isNotNull().cast("int")}[exclude]
    return df.withColumn(name, F.when(known > known_out, F.sum(own).over(frame) - left_out))


def aggregate_excluding(df: DataFrame, partition: Sequence[str], order: str, value: str, exclude: str, start: int, end: int, **outputs: str) -> DataFrame:
    """sum, count, avg, min or max over peer groups start..end without the current row, its group, or its ties.

    The frame (start <= 0 <= end) is put together from the frames on both sides of what is left out, so that
    aggregates that cannot be taken back (min, max) work too.  outputs: name = aggregate.
    """
    ordered = Window.partitionBy(*partition).orderBy("_peer")
    peers = Window.partitionBy(*partition, "_peer").orderBy("_peer")
    parts = [ordered.rangeBetween(start, -1)] if start < 0 else []
    parts += [ordered.rangeBetween(1, end)] if end > 0 else []
    parts += {
        "current": [peers.rowsBetween(Window.unboundedPreceding, -1), peers.rowsBetween(1, Window.unboundedFollowing)],
        "ties": [peers.rowsBetween(0, 0)],
        "group": [],
    }[exclude]

    def over(kind: str) -> Column:
        if kind == "avg":
            return F.try_divide(over("sum"), over("count"))
        found = [getattr(F, kind)(value).over(w) for w in parts]
        if kind in ("min", "max"):
            pick = F.least if kind == "min" else F.greatest
            return pick(*found) if len(found) > 1 else (found or [F.lit(None)])[0]
        total = F.lit(0)
        for x in found:
            total = total + F.coalesce(x, F.lit(0))
        return total if kind == "count" else F.when(over("count") > 0, total)

    numbered = df.withColumn("_peer", F.dense_rank().over(Window.partitionBy(*partition).orderBy(order)))
    return numbered.withColumns({name: over(kind) for name, kind in outputs.items()}).drop("_peer")


def count_distinct_over(df: DataFrame, partition: Sequence[str], column: str, name: str) -> DataFrame:
    """count(DISTINCT column) OVER (PARTITION BY ...), by an aggregate joined back."""
    counted = df.groupBy(*(F.col(k).alias(f"_{k}") for k in partition)).agg(F.countDistinct(column).alias(name))
    return df.join(counted, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in partition]).select(*df.columns, name)


def string_agg(df: DataFrame, keys: Sequence[str], column: str, name: str, order: Sequence[Column] | None = None, separator: str = ",", distinct: bool = False) -> DataFrame:
    """The values of each group joined to one text, in an order, without nulls.

    A group's text is one value and has to fit into a task, in any engine.
    """
    if distinct:
        return df.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_set(column)), separator).alias(name))
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*(order or [F.col(column)])))
    items = F.array_sort(F.collect_list(F.when(F.col(column).isNotNull(), F.struct(F.col("_n"), F.col(column).cast("string").alias("v")))))
    return df.withColumn("_n", n).groupBy(*keys).agg(F.array_join(F.transform(items, lambda x: x.v), separator).alias(name))
