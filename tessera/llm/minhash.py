"""MinHash near-dedup by a signature-coordinate inverted join.

Every distinct shingle set is one class.  Each class is posted under the pairs of
coordinate and value of its MinHash signature; two sets of similarity 0.75 agree in about
three quarters of the ``COORDINATES``, and only pairs with ``MATCHES`` collisions or more
are candidates (below 5e-6 of the pairs at the very threshold are lost so).

Prefix: postings nobody shares are dropped, and classes left with fewer than ``MATCHES``;
of the rest of its m postings, rarest first, a class keeps the first m - MATCHES + 1, since
two classes that collide MATCHES times meet in those.  Skip: every list first compares its
members with one hub only; once those links are joined to components, lists that lie within
one component are skipped, and in the others members of the largest component meet only those outside it.
In what is left, collisions are counted in blocks, without ever writing a pair: a pair counts in the list
of the first prefix coordinate that it shares, if its classes are in different components.  Only members
of a pair with ``MATCHES`` collisions bring their full sets, on which the pairs are then confirmed; a block
returns the links that span its components.  So a large group of near copies costs a few
comparisons a member, and no link between components is lost.

Defined results: a text that is null, empty or without words has an empty set and links
with nothing; with fewer than five words the whole sequence is the one shingle; a row with a
null id links with nothing and is kept; rows that repeat an id are documents of their own, each linked by
its own text, and the component is named by the smallest id among its rows; ``dedup`` keeps one row of each
component, also of equal rows; an empty table gives no rows; other columns are not read.  Shingles are compared
by 64-bit, values of a coordinate by 32-bit, whole sets and rows by 128-bit hashes.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import arrow_schema, cut, in_slices, map_arrow, read, sorted_groups
from .components import components

WORDS, SHARE = 5, 75
COORDINATES, MATCHES = 48, 22
#: Members of a list in one block, and shingles of their sets together.
BLOCK, SHINGLES = 1024, 2_000_000
_RNG = np.random.default_rng(7411)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _RNG.integers(1, 2**63, WORDS + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_A = _RNG.integers(1, 2**63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 2**63, COORDINATES, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[32, 9, 10, 11, 12, 13]] = True


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingles(text: str | None) -> np.ndarray:
    """The sorted distinct 64-bit shingle hashes of a text."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass").lower(), np.uint8)  # bytes.lower: A-Z only
    space = _IS_SPACE[raw]
    edge = np.flatnonzero(np.diff(space, prepend=True, append=True))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.empty(0, np.uint64)
    inside = ~space
    lengths = ends - starts
    first = np.cumsum(lengths) - lengths  # of each word, among the bytes of words
    place = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
    power = np.cumprod(np.full(int(lengths.max()), _BASE, np.uint64))
    words = _mixed(np.add.reduceat(_BYTE[raw[inside]] * power[place], first) + lengths.astype(np.uint64))
    k = min(WORDS, len(words))
    n = len(words) - k + 1
    out = np.full(n, k, np.uint64)
    for j in range(k):
        out = out + words[j:j + n] * _PLACE[j]
    return np.unique(_mixed(out))


def signature(sets: np.ndarray) -> np.ndarray:
    """Each coordinate's smallest value, as 32 bits of its hash."""
    low = np.full(COORDINATES, np.uint64(2**64 - 1))
    for at in range(0, len(sets), 4096):
        low = np.minimum(low, (sets[at:at + 4096, None] * _A + _B).min(0))
    return _mixed(low).astype(np.uint32).view(np.int32)


def text_hash(text: Column) -> Column:
    return F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit("text"), text).alias("b"))


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, of_text (hashes of the text), n_shingles, set_id (of the whole set; null if empty), signature."""

    def run(batch):
        out = {"doc_id": batch.column("doc_id"), "of_text": batch.column("of_text"), "n_shingles": [], "set_id": [], "signature": []}
        for text in batch.column("text").to_pylist():
            s = shingles(text)
            out["n_shingles"].append(len(s))
            out["set_id"].append(hashlib.md5(s.tobytes()).digest() if len(s) else None)
            out["signature"].append(signature(s) if len(s) else None)
        return out

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(
        docs.select("doc_id", "text", text_hash(F.col("text")).alias("of_text")), run,
        f"doc_id {kind}, of_text struct<a: long, b: long>, n_shingles long, set_id binary, signature array<int>")


def prefixes(classes: DataFrame) -> DataFrame:
    """rep, n_shingles, prefix (its tokens: coordinate << 32 | value) and mask (its coordinates as bits) of each class that has a prefix."""
    left = lambda x, k: F.call_function("shiftleft", x, k)
    value = F.col("v").cast("long").bitwiseAND(F.lit(0xFFFFFFFF))
    posts = classes.select("rep", "n_shingles", F.posexplode("signature").alias("place", "v"))
    posts = posts.select("rep", "n_shingles", left(F.col("place").cast("long"), F.lit(32)).bitwiseOR(value).alias("token"))
    shared = posts.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    ranked = posts.join(shared, "token").groupBy("rep", "n_shingles").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("p"))
    first = F.transform(F.slice("p", F.lit(1), F.size("p") - MATCHES + 1), lambda x: x.token)
    kept = ranked.where(F.size("p") >= MATCHES).select("rep", "n_shingles", first.alias("prefix"))
    place = lambda t: F.shiftright(t, 32).cast("int")
    return kept.withColumn("mask", F.aggregate("prefix", F.lit(0).cast("long"), lambda m, t: m.bitwiseOR(left(F.lit(1).cast("long"), place(t)))))


def confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes whose full sets are similar enough; texts: rep, text."""
    left = texts.select(F.col("rep").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("rep").alias("b"), F.col("text").alias("text_b"))

    def run(batch):
        a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
        keep, last, x = [], None, None
        for i, (p, s, t) in enumerate(zip(b, batch.column("text_a").to_pylist(), batch.column("text_b").to_pylist(), strict=True)):
            if p != last:
                last, x = p, shingles(t)
            y = shingles(s)
            both = len(np.intersect1d(x, y, assume_unique=True))
            if 100 * both >= SHARE * (len(x) + len(y) - both):
                keep.append(i)
        return {"a": [a[i] for i in keep], "b": [b[i] for i in keep]}

    return map_arrow(pairs.join(left, "a").join(right, "b"), run, "a long, b long")


def candidates(signatures: np.ndarray, masks: np.ndarray, place: int, component: np.ndarray, side: np.ndarray) -> np.ndarray:
    """For members i < j of a list (of the coordinate ``place``), whether the pair is met here and collides often enough.

    Met here: in different components, on different sides (side 0 where every two members meet), and no earlier coordinate
    is in both prefixes with one value.
    """
    n = len(masks)
    met = np.triu((component[:, None] != component[None, :]) & ((side[:, None] != side[None, :]) | (side[:, None] == 0)), 1)
    if not met.any():
        return met
    if n <= 64:
        equal = signatures[:, None, :] == signatures[None, :, :]
        held = (masks[:, None] >> np.arange(place) & 1).astype(bool)
        return met & (equal.sum(2) >= MATCHES) & ~(equal[:, :, :place] & held[:, None, :] & held[None, :, :]).any(2)
    times = np.zeros((n, n), np.uint8)
    for c in range(COORDINATES):
        equal = signatures[:, None, c] == signatures[None, :, c]
        times += equal
        if c < place:
            held = (masks >> c & 1).astype(bool)
            met &= ~(equal & held[:, None] & held[None, :])
    return met & (times >= MATCHES)


def spanning_links(sets: list[np.ndarray], component: np.ndarray, may: np.ndarray) -> list[tuple[int, int]]:
    """Links among the pairs i < j that ``may`` marks, as many as join what is similar enough and in different components."""
    size = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), size)
    _, column = np.unique(np.concatenate(sets), return_inverse=True)
    edge = np.concatenate([[0], np.cumsum(size)])
    label = np.unique(component, return_inverse=True)[1]
    mark = np.zeros(int(column.max(initial=-1)) + 1, bool)
    out = []
    for i in np.flatnonzero(may.any(1)).tolist():
        wanted = may[i] & (label != label[i])
        if not wanted.any():
            continue
        mark[column[edge[i]:edge[i + 1]]] = True
        if wanted.sum() < 8:
            both = np.zeros(len(sets), int)
            for j in np.flatnonzero(wanted).tolist():
                both[j] = mark[column[edge[j]:edge[j + 1]]].sum()
        else:
            both = np.bincount(owner, mark[column], len(sets))
        mark[column[edge[i]:edge[i + 1]]] = False
        for j in np.flatnonzero(wanted & (100 * both >= SHARE * (size[i] + size - both))).tolist():
            if label[i] != label[j]:
                out.append((i, j))
                label[label == label[j]] = label[i]
    return out


GROUP = ["token", "lo", "hi"]


def dealt(placed: DataFrame, block: int | None = None) -> DataFrame:
    """The members of lists that span components, by list and blocks (token, lo, hi) that meet, with their side.

    placed: rep, token, mask, component, n_shingles.  Of each list the members outside its
    largest component are dealt into blocks that meet each other; blocks of that component meet only those.
    """
    block = block or BLOCK
    held = placed.groupBy("token", "component").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("s"))
    lists = held.groupBy("token").agg(
        F.max(F.struct("n", "component", "s")).alias("most"), F.sum("n").alias("n"), F.sum("s").alias("s"), F.count(F.lit(1)).alias("components"))
    blocks = lambda n, s: F.greatest(F.lit(1), F.ceil(n / block), F.ceil(s / SHINGLES)).cast("int")
    lists = lists.where("components > 1").select(
        "token", F.col("most.component").alias("largest"), blocks(F.col("most.n"), F.col("most.s")).alias("inner"),
        blocks(F.col("n") - F.col("most.n"), F.col("s") - F.col("most.s")).alias("outer"))
    rows = placed.join(lists, "token").withColumn("in", F.col("component") == F.col("largest"))
    own = F.pmod(F.xxhash64("rep"), F.when(F.col("in"), F.col("inner")).otherwise(F.col("outer"))).cast("int")
    # outer blocks are 0 to outer - 1, inner ones follow
    rows = rows.withColumn("own", F.when(F.col("in"), own + F.col("outer")).otherwise(own))
    meets = F.when(F.col("in"), F.sequence(F.lit(0), F.col("outer") - 1)).otherwise(F.sequence(F.lit(0), F.col("outer") + F.col("inner") - 1))
    rows = rows.withColumn("with", F.explode(meets))
    side = F.when(F.col("own") == F.col("with"), 0).when(F.col("own") < F.col("with"), 1).otherwise(2)
    return rows.select("token", F.least("own", "with").alias("lo"), F.greatest("own", "with").alias("hi"), side.alias("side"), "mask", "rep", "component")


MEMBER = "token long, lo int, hi int, side int, mask long, rep long, component long, signature array<int>"


def _arrays(held: dict[str, list]) -> tuple[np.ndarray, np.ndarray, int, np.ndarray, np.ndarray]:
    """The arguments of ``candidates``."""
    return np.array(held["signature"], np.int32), np.array(held["mask"], np.int64), held["token"][0] >> 32, np.array(held["component"]), np.array(held["side"])


def colliding(members: DataFrame) -> DataFrame:
    """The members that have a candidate, from rows as ``dealt`` makes them with their signatures."""
    types = arrow_schema(MEMBER)

    def run(batches):
        import pyarrow as pa

        for held in sorted_groups(batches, GROUP, tuple(types.names)):
            if len(held["rep"]) > 1:
                may = candidates(*_arrays(held))
                found = np.flatnonzero(may.any(0) | may.any(1)).tolist()
                if found:
                    yield pa.RecordBatch.from_pydict({k: [v[i] for i in found] for k, v in held.items()}, schema=types)

    return members.repartition(*GROUP).sortWithinPartitions(*GROUP).select(*types.names).mapInArrow(run, MEMBER)


def links_across(members: DataFrame, texts: DataFrame) -> DataFrame:
    """a, b: links between components, from what ``colliding`` gives; texts: rep, text."""

    def sets_of(batch):
        return {"rep": batch.column("rep"), "set": [shingles(t).tobytes() for t in batch.column("text").to_pylist()]}

    needed = texts.join(members.select("rep").distinct(), "rep", "left_semi")
    rows = members.join(map_arrow(needed, sets_of, "rep long, set binary"), "rep").repartition(*GROUP).sortWithinPartitions(*GROUP)
    types = arrow_schema("a long, b long")
    names = (*arrow_schema(MEMBER).names, "set")

    def run(batches):
        import pyarrow as pa

        for held in sorted_groups(in_slices(batches, 256), GROUP, names):
            sets = [np.frombuffer(x, np.uint64) for x in held["set"]]
            if links := spanning_links(sets, np.array(held["component"]), candidates(*_arrays(held))):
                a, b = zip(*links, strict=True)
                yield pa.RecordBatch.from_pydict({"a": [held["rep"][i] for i in a], "b": [held["rep"][i] for i in b]}, schema=types)

    return rows.select(*names).mapInArrow(run, "a long, b long").distinct()


def near_rows(docs: DataFrame) -> DataFrame:
    """doc_id, of_text, n_shingles, component (null where nothing can link) and component_id (smallest doc_id reachable, itself included) of every row."""
    rows = cut(sketches(docs))
    usable = rows.where("set_id IS NOT NULL AND doc_id IS NOT NULL")
    classes = usable.groupBy("set_id").agg(
        F.min("doc_id").alias("low"), F.min(F.struct("doc_id", "of_text")).alias("one"), F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature"))
    classes = cut(classes.withColumn("rep", F.monotonically_increasing_id()))  # written, so that the numbers stay
    heads = cut(prefixes(classes))
    posts = heads.select("rep", F.explode("prefix").alias("token"))

    # one hub for each list; each class is compared with the hub it meets most often
    order = F.struct(F.xxhash64("rep").alias("h"), F.col("rep").alias("hub"))
    hubs = posts.groupBy("token").agg(F.min(order).hub.alias("hub"))
    met = posts.join(hubs, "token").where("rep <> hub").groupBy("rep", "hub").agg(F.count(F.lit(1)).alias("n"))
    first = met.groupBy("rep").agg(F.max(F.struct("n", "hub")).hub.alias("b")).select(F.col("rep").alias("a"), "b")
    used = classes.join(heads.select("rep"), "rep", "left_semi").select("rep", "one.*")
    own = docs.select(F.col("doc_id").alias("_id"), text_hash(F.col("text")).alias("_of"), "text")
    texts = own.join(used, (F.col("_id") == F.col("doc_id")) & (F.col("_of") == F.col("of_text"))).select("rep", "text")
    texts = cut(texts.dropDuplicates(["rep"]))
    links = cut(confirmed(first, texts))
    joined = components(links)

    # lists whose members are in different components yet
    placed = heads.join(joined, heads.rep == joined.node, "left").select(
        "rep", "n_shingles", "mask", F.coalesce("component", "rep").alias("component"), F.explode("prefix").alias("token"))
    members = cut(colliding(dealt(placed).join(classes.select("rep", "signature"), "rep")))
    if not members.isEmpty():
        across = cut(links_across(members, texts))
        if not across.isEmpty():
            joined = components(links.unionByName(across))

    named = joined.join(classes.select(F.col("rep").alias("node"), "low"), "node")
    lowest = named.groupBy("component").agg(F.min("low").alias("lowest"))
    of_class = named.select("node", "component").join(lowest, "component")
    of_set = classes.join(of_class, classes.rep == of_class.node, "left").select(
        "set_id", F.coalesce("component", "rep").alias("component"), F.coalesce("lowest", "low").alias("component_id"))
    columns = ("doc_id", "of_text", "n_shingles", "component", "component_id")
    linked = usable.join(cut(of_set), "set_id").select(*columns)
    alone = rows.where("set_id IS NULL OR doc_id IS NULL").withColumns({"component": F.lit(None).cast("long"), "component_id": F.col("doc_id")})
    return linked.unionByName(alone.select(*columns))


def near_groups(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    return near_rows(docs).select("doc_id", "n_shingles", "component_id")


def with_kept(groups: DataFrame) -> DataFrame:
    return groups.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def dedup(docs: DataFrame) -> DataFrame:
    """The documents but for near copies: of each component the row with the smallest id stays, of several such rows one."""
    rows = cut(near_rows(docs.select("doc_id", "text")).where("component IS NOT NULL").select("component", "doc_id", "of_text"))
    kept = rows.groupBy("component").agg(F.min(F.struct("doc_id", "of_text")).alias("one"), F.count(F.lit(1)).alias("n"))
    kept = cut(kept.where("n > 1").select("component", F.col("one.doc_id").alias("id"), F.col("one.of_text").alias("of")))
    same = (F.col("doc_id") == F.col("id")) & (F.col("of_text") == F.col("of"))
    copies = rows.join(kept, "component").groupBy("doc_id", "of_text").agg(F.min(same).alias("stays"), F.count(F.lit(1)).alias("n"))
    copies = cut(copies.where("NOT stays OR n > 1").select(F.col("doc_id").alias("_id"), F.col("of_text").alias("_of"), "stays"))
    inside = F.struct(*docs.columns).alias("_row")  # whatever names the documents have, they don't meet these
    own = docs.select(inside, F.col("doc_id").alias("_d"), text_hash(F.col("text")).alias("_t"))
    on = (F.col("_d") == F.col("_id")) & (F.col("_t") == F.col("_of"))
    out = own.join(copies, on, "left_anti").select("_row.*")
    again = copies.where("stays")
    if again.isEmpty():
        return out
    return out.unionByName(own.join(again, on).dropDuplicates(["_d", "_t"]).select("_row.*"))


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_kept(near_groups(read(spark, sf_dir, "documents").select("doc_id", "text")))
