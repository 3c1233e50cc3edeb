"""Embedding near-dedup with randomised-rotation binary codes.

A vector of length 1 is rotated at random a few times; the signs of the components are its code, and with
each rotation goes a correction factor f = <code, vector>.  ``code / f``, turned back, is an unbiased estimate
of the vector, so that products of the estimates of two vectors from different rotations, which are
independent, estimate their inner product without bias.  How far such an estimate may be off follows from the
factors, the dimension and the number of rotations; only pairs whose confidence bound reaches the threshold are
recomputed, in double precision from the vectors as given.

Pairs are met in buckets: each of the ``tables`` picks ``bits`` signs of the code.  Bits and tables follow from
the number of vectors, so that buckets hold about ``IN_BUCKET`` and at most the share ``MISS`` of the pairs at the threshold
meets in no table.  What the shuffle carries for each table is the code and its factors; only vectors
that have a pair within the bound bring their components, once for each bucket where that is so.  A pair counts in the first
table in which it meets, so that nothing has to be made distinct.  A bucket of more than ``BLOCK``
vectors is dealt into blocks and met block against block: no cap, and no task holds more.

Defined results: a vector that is null, empty or zero, or holds a null or a component that
is not finite, links with nothing and is kept; equal vectors link with each other; vectors of
different dimensions do not link; a row with a null id links with nothing; rows that repeat an id are vectors of
their own; an empty table gives no rows; other columns, labels included, are not read.  Equal vectors are told by
128 bits of hashes.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import arrow_schema, cut, map_arrow, read
from .components import components

LEAST = 0.9
MISS = 0.01
BLOCK, IN_BUCKET, TOGETHER = 1024, 256, 256
#: Signs of a code, at least, and rotations, at least.
SIGNS, ROTATIONS = 256, 3
#: Standard deviations of an estimate within which a pair is recomputed.
CONFIDENCE = 4.0
SEED = 90210


def rotations_for(dimension: int) -> int:
    return max(ROTATIONS, -(-SIGNS // dimension))


def plan(n: int) -> tuple[int, int]:
    """Signs in a table, and tables, for n vectors.

    Two vectors at the threshold agree in each of ``SIGNS`` signs with 1 - acos(0.9) / pi; if in the share a of them,
    they meet in a table with a ** bits.
    """
    bits = min(40, max(4, round(math.log2(max(n, 1) / IN_BUCKET))))
    p = 1 - math.acos(LEAST) / math.pi
    agree = np.array([math.comb(SIGNS, k) * p**k * (1 - p) ** (SIGNS - k) for k in range(SIGNS + 1)])
    meet = (np.arange(SIGNS + 1) / SIGNS) ** bits
    tables = 1
    while (agree * (1 - meet) ** tables).sum() > MISS:
        tables = tables + 1 + tables // 16
    return bits, tables


@functools.cache
def rotation(dimension: int, k: int) -> np.ndarray:
    """The k-th random rotation."""
    q, r = np.linalg.qr(np.random.default_rng((SEED, dimension, k)).standard_normal((dimension, dimension)))
    return q * np.sign(np.diag(r))


@functools.cache
def picked(n_signs: int, bits: int, tables: int) -> np.ndarray:
    """The signs of each table."""
    rng = np.random.default_rng((SEED, n_signs, bits, tables))
    return np.array([rng.choice(n_signs, bits, replace=False) for _ in range(tables)])


def table_keys(on: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """The bucket in each table of codes given as rows of booleans."""
    out = np.zeros((len(on), tables), np.int64)
    for k, column in enumerate(picked(on.shape[1], bits, tables).T):
        out |= on[:, column].astype(np.int64) << k
    return out


def coded(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes (rows of booleans, rotation by rotation) and factors of vectors of one dimension."""
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    turned = [unit @ rotation(x.shape[1], k) for k in range(rotations_for(x.shape[1]))]
    factors = np.stack([np.abs(t).sum(1) / math.sqrt(x.shape[1]) for t in turned], 1).astype(np.float32)
    return np.concatenate([t > 0 for t in turned], 1), factors


def estimated(on: np.ndarray, factors: np.ndarray, dimension: int) -> tuple[np.ndarray, np.ndarray]:
    """Unbiased estimates of all inner products, and how far each may be off within the confidence."""
    r = factors.shape[1]
    codes = np.where(on, 1, -1).astype(np.float32).reshape(len(on), r, dimension) / (np.float32(math.sqrt(dimension)) * factors[:, :, None])
    guess = sum(codes[:, k] @ rotation(dimension, k).T.astype(np.float32) for k in range(r))  # r times the vector, without bias
    flat = codes.reshape(len(on), -1)
    estimate = (guess @ guess.T - flat @ flat.T) / (r * (r - 1))  # products from one rotation are dependent and left out
    spread = ((1 / factors.astype(np.float64) ** 2 - 1).mean(1) / max(1, dimension - 1)) / r  # variance of a guess in any direction
    both = spread[:, None] + spread[None, :] + spread[:, None] * spread[None, :] * dimension
    return estimate, CONFIDENCE * np.sqrt(both * r / (r - 1))


def packed(on: np.ndarray, factors: np.ndarray, n: list[int]) -> list[bytes]:
    """Dimension, class size, factors and code of each row as bytes."""
    bits = np.packbits(on, axis=1)
    dimension = np.full((len(on), 1), on.shape[1] // factors.shape[1], "<u4").view(np.uint8)
    size = np.array(n, "<u4")[:, None].view(np.uint8)
    return [x.tobytes() for x in np.concatenate([dimension, size, np.ascontiguousarray(factors, "<f4").view(np.uint8), bits], 1)]


class Members:
    """Rows that are met together: codes, factors, class sizes and keys of one dimension."""

    def __init__(self, codes: list[bytes], shape: tuple[int, int]):
        raw = np.frombuffer(b"".join(codes), np.uint8).reshape(len(codes), -1)
        self.dimension = int(raw[0, :4].copy().view("<u4")[0])
        self.n = np.ascontiguousarray(raw[:, 4:8]).view("<u4")[:, 0].astype(np.int64)
        r = rotations_for(self.dimension)
        self.factors = np.ascontiguousarray(raw[:, 8:8 + 4 * r]).view("<f4")
        self.on = np.unpackbits(raw[:, 8 + 4 * r:], axis=1, count=r * self.dimension).astype(bool)
        self.keys = table_keys(self.on, *shape)

    def pairs(self, may: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs i < j, among those that ``may`` marks, within the bound and not met in an earlier table; table: of each row."""
        estimate, error = estimated(self.on, self.factors, self.dimension)
        i, j = np.nonzero(np.triu(may & (estimate + error >= LEAST), 1))
        earlier = (self.keys[i] == self.keys[j]) & (np.arange(self.keys.shape[1]) < table[i][:, None])
        new = ~earlier.any(1)
        return i[new], j[new]


GROUP = ["bucket", "lo", "hi"]


def chunks(batches, columns: tuple[str, ...]) -> Iterator[tuple[dict[str, list], np.ndarray]]:
    """Rows of whole groups, up to about ``TOGETHER`` of them or one larger group, and the number of each row's group."""
    held: dict[str, list] = {c: [] for c in columns}

    def groups(last: bool):
        mark = list(zip(*(held[c] for c in GROUP), strict=True))
        edges = [k for k in range(len(mark)) if not k or mark[k] != mark[k - 1]]
        if last:
            edges.append(len(mark))
        at = 0
        for k in range(1, len(edges)):
            # groups whose codes are equally long, so of one dimension, are met together
            if k + 1 == len(edges) or edges[k + 1] - at > TOGETHER or len(held["code"][edges[k]]) != len(held["code"][at]):
                end = edges[k]
                starts = np.array([e - at for e in edges if at <= e < end])
                if end - at > len(starts):
                    yield {c: held[c][at:end] for c in columns}, np.searchsorted(starts, np.arange(end - at), "right")
                at = end
        for c in columns:
            held[c] = held[c][at:]

    for batch in batches:
        for c in columns:
            held[c] += batch.column(c).to_pylist()
        yield from groups(False)
    if held[columns[0]]:
        yield from groups(True)


def _met(rows: dict[str, list], group: np.ndarray, shape: tuple[int, int]) -> tuple[Members, np.ndarray, np.ndarray]:
    """Members and pairs within the bound of rows of some groups; in a group of two blocks only rows of different blocks meet."""
    members, side = Members(rows["code"], shape), np.array(rows["side"])
    may = (group[:, None] == group[None, :]) & ((side[:, None] != side[None, :]) | (side[:, None] == 0))
    return members, *members.pairs(may, np.array(rows["place"]))


POST = "bucket long, lo int, hi int, side int, place int, rep long, code binary"


def within_bound(posts: DataFrame, shape: tuple[int, int]) -> DataFrame:
    """The posts that have a pair within the bound, each in its bucket."""
    types = arrow_schema(POST)

    def run(batches):
        import pyarrow as pa

        for rows, group in chunks(batches, tuple(types.names)):
            _, i, j = _met(rows, group, shape)
            if found := np.unique(np.concatenate([i, j])).tolist():
                yield pa.RecordBatch.from_pydict({c: [v[k] for k in found] for c, v in rows.items()}, schema=types)

    return posts.repartition(*GROUP).sortWithinPartitions(*GROUP).select(*types.names).mapInArrow(run, POST)


def meetings(posts: DataFrame, classes: DataFrame, shape: tuple[int, int]) -> DataFrame:
    """rep, n, other: links counted at rep, and a link to other unless it is rep; classes: rep, embedding."""
    types = arrow_schema(schema := "rep long, n long, other long")
    columns = (*arrow_schema(POST).names, "embedding")

    def run(batches):
        import pyarrow as pa

        for rows, group in chunks(batches, columns):
            members, i, j = _met(rows, group, shape)
            x = np.array(rows["embedding"], np.float64)
            x /= np.abs(x).max(1, keepdims=True)  # no overflow in what follows; the angle stays
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            keep = np.concatenate([np.einsum("ij,ij->i", x[i[a:a + 8192]], x[j[a:a + 8192]]) >= LEAST for a in range(0, len(i), 8192)] or [np.empty(0, bool)])
            i, j = i[keep], j[keep]
            rep, label = np.array(rows["rep"]), np.arange(len(x))
            n = np.bincount(i, members.n[j], len(x)) + np.bincount(j, members.n[i], len(x))
            while len(i):
                low, before = np.minimum(label[i], label[j]), label.copy()
                np.minimum.at(label, i, low)
                np.minimum.at(label, j, low)
                label = label[label]
                if (label == before).all():
                    break
            tell = np.flatnonzero(n > 0)
            yield pa.RecordBatch.from_pydict({"rep": rep[tell], "n": n[tell].astype(np.int64), "other": rep[label[tell]]}, schema=types)

    rows = posts.join(classes, "rep").repartition(*GROUP).sortWithinPartitions(*GROUP)
    return rows.select(*columns).mapInArrow(run, schema)


def posted(classes: DataFrame, shape: tuple[int, int], block: int | None = None) -> DataFrame:
    """A row of each class for each table, and for each pair of blocks in a large bucket."""
    block = block or BLOCK
    bits, tables = shape

    def run(batch):
        by_dimension: dict[int, list[int]] = {}
        vectors = batch.column("embedding").to_pylist()
        for k, v in enumerate(vectors):
            by_dimension.setdefault(len(v), []).append(k)
        for d, places in by_dimension.items():
            x = np.array([vectors[k] for k in places], np.float64)
            on, factors = coded(x / np.abs(x).max(1, keepdims=True))
            n = [batch.column("n")[k].as_py() for k in places]
            # a bucket's number holds the dimension, the table and the key
            bucket = ((np.int64(d) * np.int64(tables) + np.arange(tables)) << np.int64(bits)) + table_keys(on, bits, tables)
            yield {"rep": [batch.column("rep")[k].as_py() for k in places], "code": packed(on, factors, n), "buckets": bucket.tolist()}

    rows = cut(map_arrow(classes, run, "rep long, code binary, buckets array<long>"))
    posts = rows.select("rep", "code", F.posexplode("buckets").alias("place", "bucket"))
    large = cut(posts.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > block))
    if large.isEmpty():
        return posts.withColumns({"lo": F.lit(0), "hi": F.lit(0), "side": F.lit(0)})
    blocks = F.ceil(F.col("size") / block).cast("int")
    own = F.pmod(F.xxhash64("rep"), blocks).cast("int")
    posts = posts.join(large.withColumn("blocks", blocks), "bucket", "left")
    posts = posts.withColumn("own", F.when(F.col("blocks").isNotNull(), own).otherwise(0))
    posts = posts.withColumn("with", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)))
    side = F.when(F.col("own") == F.col("with"), 0).when(F.col("own") < F.col("with"), 1).otherwise(2)
    return posts.withColumns({"lo": F.least("own", "with"), "hi": F.greatest("own", "with"), "side": side})


def near_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id, n_links, component_id from vec_id and embedding."""
    good = F.coalesce(
        F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("embedding", lambda v: v != 0),
        F.lit(False),
    ) & F.col("vec_id").isNotNull()
    key = F.struct(F.xxhash64("embedding").alias("a"), F.xxhash64(F.lit("embedding"), "embedding").alias("b"))
    rows = vectors.select("vec_id", "embedding", good.alias("good"))
    usable = rows.where("good").select("vec_id", key.alias("key"), "embedding")
    classes = usable.groupBy("key").agg(F.min("vec_id").alias("low"), F.count(F.lit(1)).alias("n"), F.first("embedding").alias("embedding"))
    classes = cut(classes.withColumn("rep", F.monotonically_increasing_id()))  # written, so that the numbers stay
    shape = plan(classes.count())
    close = cut(within_bound(posted(classes.select("rep", "n", "embedding"), shape), shape))
    found = cut(meetings(close, classes.select("rep", "embedding"), shape))
    counts = found.groupBy("rep").agg(F.sum("n").alias("links"))
    joined = components(found.select(F.col("rep").alias("a"), F.col("other").alias("b")))
    named = joined.join(classes.select(F.col("rep").alias("node"), "low"), "node")
    named = named.select("node", "component").join(named.groupBy("component").agg(F.min("low").alias("lowest")), "component").select("node", "lowest")
    of_class = classes.select("key", "rep", "low", "n").join(counts, "rep", "left").join(named, F.col("rep") == named.node, "left")
    of_class = cut(of_class.select(
        "key", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).cast("long").alias("n_links"), F.coalesce("lowest", "low").alias("component_id")))
    linked = usable.select("vec_id", "key").join(of_class, "key").select("vec_id", "n_links", "component_id")
    return linked.unionByName(rows.where("NOT good").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))


def op2_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_vectors(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
