"""Aggregates and table functions of one's own."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def aggregate(df: DataFrame, keys: Sequence[str], partial: Callable[[pd.DataFrame], Mapping[str, Any]], state: str, *finish: Column) -> DataFrame:
    """Groups with an aggregate of one's own.

    partial turns some rows of a group, those in one Arrow batch, into a state with the columns
    that ``state`` names; finish combines states by Spark's aggregates.  Rows never leave their
    task, so a group may be of any size.
    """
    keys, columns = list(keys), StructType.fromDDL(state)
    schema = StructType([*(df.schema[k] for k in keys), *columns])
    arrow = to_arrow_schema(schema)

    def states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = batch.to_pandas(integer_object_nulls=True)
            group = rows.groupby(keys, dropna=False, sort=False).ngroup().to_numpy() if keys else np.zeros(len(rows), int)
            by_group = np.argsort(group, kind="stable")
            parts = np.split(by_group, np.flatnonzero(np.diff(group[by_group])) + 1)
            made = [partial(rows.iloc[p]) for p in parts]
            held = [batch.column(k).take(pa.array([p[0] for p in parts])).cast(arrow.field(k).type) for k in keys]
            yield pa.RecordBatch.from_arrays([*held, *(pa.array([m[c] for m in made], arrow.field(c).type) for c in columns.names)], schema=arrow)

    return df.mapInArrow(states, schema).groupBy(*keys).agg(*finish)


def generate(df: DataFrame, handler: type, returns: str, *arguments: str | Column) -> DataFrame:
    """Each row with the rows that a table function makes of the arguments; handler's ``eval`` yields them."""
    made = F.udtf(handler, returnType=returns)
    return df.lateralJoin(made(*((F.col(a) if isinstance(a, str) else a).outer() for a in arguments)))
