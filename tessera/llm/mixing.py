"""Mixing sources to target weights by systematic sampling, with built-in functions only.

Sources, ordered by code point with null last, weigh 1, 2, 3, 1, 2, 3, ...  They share
100 % of all sizes by weight; a target stops at ``most`` times its source's size and the
excess is shared again by weight until no target is above.  This has a closed form:
``target = least(most * size, level * weight)``, where the level follows from the sources
ordered by ``most * size / weight``.

Within its source every document has ``target / source_size`` expected copies.  Documents
are laid out by size class, then a spread bucket, then size and id; the prefix sum of the
expected copies plus one offset per source crosses an integer boundary once per copy.  A
prefix sum over a hot source never meets in one task: it is the sum of three bounded ones
(size classes of a source, buckets of a size class, rows of a bucket).

Defined results: a null text or one without words has size 0 and takes 0 words; a null
source is a source of its own, ordered last; a null id is spread by its text; repeated
rows are separate documents; an empty table gives no rows; other columns, whatever their
names, are kept by ``mix`` and not read by ``taken``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import WORD, cut, read

#: Buckets of a size class of a source: four hexadecimal digits of a hash.
DIGITS = 4
MOST = 3


def size_of(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def _hex(value: Column, digits: int) -> Column:
    return F.conv(F.substring(F.md5(value.cast("binary")), 1, digits), 16, 10).cast("long")


def spread(doc_id: Column, text: Column) -> Column:
    """A document's bucket, by its id, or by its text if it has none."""
    return _hex(F.coalesce(doc_id.cast("string"), text, F.lit("")), DIGITS)


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, spread: what the mix reads of the documents."""
    return docs.select("doc_id", "source", size_of(F.col("text")).alias("size"), spread(F.col("doc_id"), F.col("text")).alias("spread"))


def source_targets(sized: DataFrame, most: int = MOST, seed: str = "mix") -> DataFrame:
    """One row per source: source, source_size, target, u (its random offset in [0, 1))."""
    by_name = Window.orderBy(F.asc_nulls_last("source"))
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), F.asc_nulls_last("source"))
    everything = Window.partitionBy()
    through = by_cap.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = (
        sized.groupBy("source").agg(F.sum("size").alias("source_size"))
        .withColumn("weight", ((F.row_number().over(by_name) - 1) % 3 + 1).cast("long"))
        .withColumn("cap", F.col("source_size") * most)
        .withColumn("total", F.sum("source_size").over(everything))
        .withColumn("weights", F.sum("weight").over(everything))
        .withColumn("cap_before", F.sum("cap").over(through) - F.col("cap"))
        .withColumn("weight_before", F.sum("weight").over(through) - F.col("weight"))
    )
    # the level if this source and all after it are below their caps; the first such source fixes it
    level = (F.col("total") - F.col("cap_before")).cast("double") / (F.col("weights") - F.col("weight_before"))
    fits = level * F.col("weight") <= F.col("cap")
    ordinal = F.row_number().over(by_cap)
    leveled = (
        ranked.withColumn("own_level", level).withColumn("ordinal", ordinal).withColumn("fits", fits)
        .withColumn("first_fit", F.min(F.when(F.col("fits"), F.col("ordinal"))).over(everything))
        .withColumn("level", F.max(F.when(F.col("ordinal") == F.col("first_fit"), F.col("own_level"))).over(everything))
    )
    shared = F.when(
        F.col("first_fit").isNull() | (F.col("ordinal") < F.col("first_fit")), F.col("cap").cast("double")
    ).otherwise(F.col("level") * F.col("weight"))
    return leveled.select(
        "source", "source_size", shared.alias("target"),
        (_hex(F.concat(F.lit(f"{seed}:"), F.coalesce("source", F.lit("\x00"))), 5) / F.lit(1048576.0)).alias("u"),
    )


def _rank(sized: DataFrame) -> DataFrame:
    """``sized`` with n, the 1-based place of each row within its source."""
    placed = sized.withColumns({"_class": F.length(F.bin("size")), "_bucket": F.col("spread").cast("int")})
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    cells = placed.groupBy("source", "_class", "_bucket").agg(F.count(F.lit(1)).alias("c"))
    classes = placed.groupBy("source", "_class").agg(F.count(F.lit(1)).alias("c"))
    classes = classes.select(
        "source", "_class",
        F.coalesce(F.sum("c").over(earlier(Window.partitionBy("source").orderBy("_class"))), F.lit(0)).alias("n_class"),
    )
    cells = cells.select(
        "source", "_class", "_bucket",
        F.coalesce(F.sum("c").over(earlier(Window.partitionBy("source", "_class").orderBy("_bucket"))), F.lit(0)).alias("n_cell"),
    )
    in_cell = F.row_number().over(Window.partitionBy("source", "_class", "_bucket").orderBy("size", F.asc_nulls_first("doc_id")))
    rows = placed.withColumn("n_row", in_cell)
    cells = cells.select(F.col("source").alias("_s"), F.col("_class").alias("_k"), F.col("_bucket").alias("_b"), "n_cell")
    classes = classes.select(F.col("source").alias("_s"), F.col("_class").alias("_k"), "n_class")
    of_class = F.col("source").eqNullSafe(F.col("_s")) & (F.col("_class") == F.col("_k"))
    out = rows.join(cells, of_class & (F.col("_bucket") == F.col("_b"))).drop("_s", "_k", "_b")
    out = out.join(classes, of_class).drop("_s", "_k")
    return out.withColumn("n", F.col("n_class") + F.col("n_cell") + F.col("n_row")).drop("_class", "_bucket", "n_class", "n_cell", "n_row")


def taken(sized: DataFrame, most: int = MOST, seed: str = "mix") -> DataFrame:
    """From what ``sized`` gives: doc_id, source, size, spread, source_size, target, copies, taken."""
    sized = cut(sized)
    ranked = _rank(sized)
    targets = source_targets(sized, most, seed).withColumnRenamed("source", "_s")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    crossed = F.floor(F.col("u") + F.col("n") * rate) - F.floor(F.col("u") + (F.col("n") - 1) * rate)
    joined = ranked.join(targets, F.col("source").eqNullSafe(F.col("_s")))
    out = joined.select(
        "doc_id", "source", "size", "spread", "source_size", "target",
        F.least(crossed.cast("long"), F.lit(most).cast("long")).alias("copies"),
    )
    return out.withColumn("taken", F.col("copies") * F.col("size"))


def mix(docs: DataFrame, most: int = MOST, seed: str = "mix") -> DataFrame:
    """The documents, each as often as the mix takes it; columns as in ``docs``.

    Rows that agree in id, source and size lie side by side, so their copies differ by one at
    most; the first of them by a hash of the text get the larger number.
    """
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("\x00"))
    key = F.concat_ws("\x01", part("doc_id"), part("source"), F.col("_size").cast("string"), F.col("_spread").cast("string"))
    copies = taken(sized(docs), most, seed).withColumnsRenamed({"size": "_size", "spread": "_spread"}).groupBy(key.alias("_key")).agg(F.count(F.lit(1)).alias("_rows"), F.sum("copies").alias("_copies"))
    own = docs.select(
        F.struct(*docs.columns).alias("_row"), "doc_id", "source", size_of(F.col("text")).alias("_size"), spread(F.col("doc_id"), F.col("text")).alias("_spread"))
    own = own.select("_row", key.alias("_key"))  # whatever names the documents have, they don't meet these
    out = own.join(copies.where("_copies > 0"), "_key")
    nth = F.row_number().over(Window.partitionBy("_key").orderBy(F.xxhash64("_row.text")))
    out = out.withColumn("_nth", F.when(F.col("_rows") > 1, nth).otherwise(1))
    times = F.floor(F.col("_copies") / F.col("_rows")) + (F.col("_nth") <= F.col("_copies") % F.col("_rows")).cast("int")
    out = out.withColumn("_times", times.cast("int")).where("_times > 0")
    return out.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times")))).select("_row.*")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = taken(sized(read(spark, sf_dir, "documents")))
    return out.select("doc_id", "size", "source_size", "target", "taken")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), text, '')), 1, 4)) AS BIGINT) AS spread FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS weight, source_size * 3 AS cap FROM s
), c AS (
  SELECT *, CAST(sum(source_size) OVER () AS BIGINT) AS total, CAST(sum(weight) OVER () AS BIGINT) AS weights,
    CAST(sum(cap) OVER o AS BIGINT) - cap AS cap_before, CAST(sum(weight) OVER o AS BIGINT) - weight AS weight_before,
    row_number() OVER (ORDER BY CAST(cap AS DOUBLE) / weight, source ASC NULLS LAST) AS ordinal
  FROM w WINDOW o AS (ORDER BY CAST(cap AS DOUBLE) / weight, source ASC NULLS LAST ROWS UNBOUNDED PRECEDING)
), l AS (
  SELECT *, CAST(total - cap_before AS DOUBLE) / (weights - weight_before) AS own_level FROM c
), f AS (
  SELECT *, min(CASE WHEN own_level * weight <= cap THEN ordinal END) OVER () AS first_fit FROM l
), g AS (
  SELECT *, max(CASE WHEN ordinal = first_fit THEN own_level END) OVER () AS level FROM f
), t AS (
  SELECT source, source_size,
    CASE WHEN first_fit IS NULL OR ordinal < first_fit THEN CAST(cap AS DOUBLE) ELSE level * weight END AS target,
    CAST(('0x' || substr(md5('mix:' || coalesce(source, chr(0))), 1, 5)) AS BIGINT) / 1048576.0::DOUBLE AS u
  FROM g
), r AS (
  SELECT d.*, row_number() OVER (PARTITION BY source ORDER BY length(bin(size)),
    spread, size, doc_id ASC NULLS FIRST) AS n
  FROM d
), e AS (
  SELECT doc_id, size, source_size, target, u, n,
    CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0::DOUBLE END AS rate
  FROM r JOIN t ON r.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
  least(CAST(floor(u + n * rate) - floor(u + (n - 1) * rate) AS BIGINT), 3) * size AS taken
FROM e
"""
