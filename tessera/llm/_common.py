"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Callable, Iterable, Iterator
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: What counts as a word wherever a contract speaks of words.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """``df``, computed once and kept in the shared checkpoint folder, without its lineage.

    The folder is the session's ``spark.checkpoint.dir``; where that is unset, a session in one
    process (tests, a laptop) gets a temporary one, and any other session an error.
    """
    spark = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None) and not spark.sparkContext.getCheckpointDir():
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tessera-checkpoint-"))
    return df.checkpoint(eager=True)


def sampled(share: float | Column, name: str, key: str = "doc_id") -> Column:
    """Whether a row is in the sample ``name`` of this share, by a hash of its key; any share above 0 chooses rows, however small."""
    return F.xxhash64(key, F.lit(name)) / F.lit(2.0**64) + F.lit(0.5) < share


def words_of(text: Column) -> Column:
    """The words of a text as an array; a null text has none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({WORD})"), 1)


def fold_of(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5; fold 0 is held out.  A null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5


def arrow_schema(ddl: str):
    """Arrow's schema for columns given as in SQL."""
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(StructType.fromDDL(ddl))


def in_slices(batches: Iterable[Any], rows: int = 1000) -> Iterator[Any]:
    """The batches in parts, so that few texts at a time are Python objects."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def map_arrow(df: DataFrame, function: Callable[..., Any], schema: str, state: Callable[[], Any] | None = None) -> DataFrame:
    """mapInArrow of a function from one record batch to a dict of columns (or an iterator of such dicts).

    state: makes what the batches of a task share, the function's second argument; it ends with the task.
    """

    types = arrow_schema(schema)

    def run(batches):
        import pyarrow as pa

        more = () if state is None else (state(),)
        for batch in in_slices(batches):
            made = function(batch, *more)
            for columns in [made] if isinstance(made, dict) else made:
                yield pa.RecordBatch.from_pydict(columns, schema=types)
        del more, batches
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)


def map_rows(df: DataFrame, function: Callable[..., Any], state: Callable[[], Any] | None = None) -> DataFrame:
    """mapInArrow of a function between record batches with the columns of ``df``, whatever their names; state as in map_arrow."""

    def run(batches):
        import pyarrow as pa

        more = () if state is None else (state(),)
        for batch in in_slices(batches):
            yield function(batch, *more)
        del more, batches
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, df.schema)


def sorted_groups(batches: Iterable[Any], keys: list[str], columns: tuple[str, ...]) -> Iterator[dict[str, list]]:
    """The columns of each run of rows with equal keys, from batches that are sorted by them."""
    held: dict[str, list] = {c: [] for c in columns}
    last = None
    for batch in batches:
        names = [batch.column(k).to_pylist() for k in keys]
        values = [batch.column(c).to_pylist() for c in columns]
        for i, key in enumerate(zip(*names, strict=True)):
            if key != last:
                if last is not None:
                    yield held
                held, last = {c: [] for c in columns}, key
            for c, v in zip(columns, values, strict=True):
                held[c].append(v[i])
    if last is not None:
        yield held


def tokenizer_file(name: str) -> str:
    """Path of a public vocabulary; TESSERA_TOKENIZERS names another folder."""
    folder = os.environ.get("TESSERA_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)
