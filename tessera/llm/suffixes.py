"""Suffix-array dedup: bytes of repeated 200-byte strings go, found by a distributed merge
sort of front-coded suffix runs.

Sorting every suffix would move hundreds of times the corpus, so the sort takes a sparse
suffix array that loses nothing.  Each window of ``SPAN`` bytes has an anchor, the place in
it whose ``GRAM``-byte string hashes lowest: equal windows have equal anchors.  Windows that
follow each other with one anchor make a stretch, and its string holds them all.  Three steps
cut off what needs no comparing (the distinguishing prefixes of the sort):

* an anchor string that occurs once in the corpus cannot lie in a repeated window;
* equal stretches repeat each other whole, so one of each is enough for the others;
* an anchor string with one distinct stretch has nothing else to compare with.

What is left, the stretches at the ends of repeats, is sorted by suffix from the anchor on:
tasks sort their suffixes into runs, front-code them (length of the prefix shared with the
suffix before, and the rest) and exchange the runs; a loser tree merges those of a bucket by
their known common prefixes and compares bytes only beyond them.  The common prefixes that
the merge leaves between neighbours, with the common endings to the left of the anchors, say
exactly which windows repeat.  Beyond ``PAIRED`` neighbours, where pairs get many, the windows at
each distance from the anchor are told apart by hashes in place of endings.  An anchor string
with more than ``MOST`` distinct stretches is too much for one task; its windows are counted by
their hashes wherever they lie.

Semi-joins are reduced by bitmaps of a fixed size (``BITS``); a full one only stops saving.

Defined results: a null text is empty; texts below 200 bytes lose nothing; a row that
repeats another (id and text) is a copy like any other; rows with a null id are compared
like the rest; an empty table gives no rows; other columns are not read.  Rows, equal anchors,
stretches and hot windows are told by 128 bits of hashes, windows in classes of more than
``PAIRED`` by 64.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import arrow_schema, cut, in_slices, map_arrow, read

SPAN, GRAM = 200, 64
MOST, PAIRED, SUFFIXES_IN_BUCKET, SUFFIXES_IN_RUN = 8192, 64, 20_000, 20_000
BITS = 1 << 25
#: Windows of a text taken on at a time; below 2**24, for places share a word with hashes.
WINDOWS_AT_ONCE = 1 << 18
_RNG = np.random.default_rng(5150)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE, _LOW = 0x9E3779B97F4A7C15, np.uint64(0xFFFFFF)
_POWERS = [np.empty(0, np.uint64), np.empty(0, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2**64; those for a part of a text are kept."""
    if len(_POWERS[0]) < n:
        made = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, b, np.uint64)])) for b in (_BASE, pow(_BASE, -1, 2**64))]
        if n > 2 * WINDOWS_AT_ONCE:
            return made[0][:n], made[1][:n]
        _POWERS[:] = made
    return _POWERS[0][:n], _POWERS[1][:n]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Hashed:
    """Hashes of any substring of some bytes."""

    def __init__(self, raw: np.ndarray):
        up, self.down = _powers(len(raw) + 1)
        self.sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_BYTE[raw] * up[:-1], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))


def stretches(raw: bytes) -> Iterator[dict[str, np.ndarray]]:
    """anchor (place), start (of the first window), n (windows), gram (hash at the anchor) and whole (hash of all its bytes) of each stretch.

    A long text is taken on in parts, which overlap by the longest stretch; each gives the stretches that start in it.
    """
    total = len(raw) - SPAN + 1
    width = SPAN - GRAM + 1  # windows that can share an anchor
    for at in range(0, total, WINDOWS_AT_ONCE):
        end = min(total, at + WINDOWS_AT_ONCE)
        lo, hi = max(0, at - 1), min(total, end + width)
        hashed = Hashed(np.frombuffer(raw, np.uint8)[lo:hi + SPAN - 1])
        places = np.arange(hi - lo + width - 1)
        grams = _mixed((hashed.sums[GRAM:] - hashed.sums[:-GRAM]) * hashed.down[:len(places)])
        low = (grams & ~_LOW) | places.astype(np.uint64)
        size = 1
        while 2 * size <= width:
            low = np.minimum(low[:-size], low[size:])
            size *= 2
        if width > size:
            low = np.minimum(low[:-(width - size)], low[width - size:])
        anchor = (low & _LOW).astype(np.int64)
        first = np.flatnonzero(np.diff(anchor, prepend=-1))
        n = np.diff(first, append=hi - lo)
        keep = (first + lo >= at) & (first + lo < end)
        first, n = first[keep], n[keep]
        yield {
            "anchor": anchor[first] + lo, "start": first + lo, "n": n, "gram": grams[anchor[first]].view(np.int64),
            "whole": hashed.of(first, first + n + SPAN - 1).view(np.int64),
        }


def _bytes_of(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def keyed(docs: DataFrame) -> DataFrame:
    """The documents with a key (k, h) of 128 bits that equal rows share."""
    row = [F.col("doc_id").isNull(), "doc_id", "text"]
    return docs.select("doc_id", "text", F.xxhash64(*row).alias("k"), F.xxhash64(F.lit("row"), *row).alias("h"))


def bitmap(keys: DataFrame, bits: int = BITS) -> np.ndarray:
    """A bitmap of the long column key, of at most ``bits`` bits whatever the number of keys."""
    slot = F.pmod(F.xxhash64("key"), F.lit(bits))
    words = keys.select(F.floor(slot / 64).cast("int").alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), (slot % 64).cast("int")).alias("b")).groupBy("w").agg(F.bit_or("b").alias("b"))
    found = words.toPandas()
    out = np.zeros(bits // 64, np.int64)
    out[found.w.to_numpy()] = found.b.to_numpy()
    return out


def in_bitmap(key: Column, shared) -> Column:
    """Whether the bitmap may hold the key."""
    bits = len(shared.value) * 64
    slot = F.pmod(F.xxhash64(key), F.lit(bits))

    @F.pandas_udf("boolean")
    def held(slots):
        s = slots.to_numpy()
        import pandas as pd

        return pd.Series((shared.value[s >> 6] >> (s & 63) & 1).astype(bool))

    return held(slot)


def repeated_grams(docs: DataFrame) -> DataFrame:
    """gram of the anchors that occur more than once."""

    def run(batch):
        for text in batch.column("text").to_pylist():
            for s in stretches(_bytes_of(text)):
                yield {"gram": s["gram"]}

    return map_batched(docs.where(F.octet_length("text") >= SPAN).select("text"), run, "gram long").groupBy("gram").agg(
        F.count(F.lit(1)).alias("n")).where("n > 1").select("gram")


def map_batched(df: DataFrame, function, schema: str, rows: int = 100_000) -> DataFrame:
    """Like map_arrow, for functions that yield many small dicts of arrays: those are put together."""
    types = arrow_schema(schema)

    def run(batches):
        import pyarrow as pa

        held: list[dict] = []
        n = 0

        def put():
            return pa.RecordBatch.from_pydict({k: np.concatenate([x[k] for x in held]) for k in types.names}, schema=types)

        for batch in in_slices(batches):
            for made in function(batch):
                held.append(made)
                n += len(made[types.names[0]])
                if n >= rows:
                    yield put()
                    held, n = [], 0
        if n:
            yield put()

    return df.mapInArrow(run, schema)


def repeated_stretches(docs: DataFrame, grams: DataFrame, may) -> DataFrame:
    """gram, whole (hash of the stretch), k, h, anchor, start, n of the stretches with a repeated anchor string; may: their bitmap, broadcast."""

    def run(batch):
        for text, k, h in zip(batch.column("text").to_pylist(), batch.column("k").to_pylist(), batch.column("h").to_pylist(), strict=True):
            for s in stretches(_bytes_of(text)):
                m = len(s["gram"])
                yield s | {"k": np.full(m, k), "h": np.full(m, h)}

    schema = "gram long, whole long, k long, h long, anchor long, start long, n long"
    found = map_batched(docs.where(F.octet_length("text") >= SPAN).select("text", "k", "h"), run, schema)
    return found.where(in_bitmap(F.col("gram"), may)).join(grams, "gram")


def common(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix, of which ``known`` bytes are known."""
    n = min(len(a), len(b))
    i = known
    while i + 16 <= n and a[i:i + 16] == b[i:i + 16]:
        i += 16
    while i < n and a[i] == b[i]:
        i += 1
    return i


def front_coded(strings: list[bytes]) -> tuple[list[int], list[bytes]]:
    """Of sorted strings: the length of the prefix shared with the string before, and the rest."""
    shared = [0, *(common(a, b) for a, b in zip(strings, strings[1:], strict=False))]
    return shared, [s[n:] for s, n in zip(strings, shared, strict=False)]


class LoserTree:
    """Merges front-coded sorted runs.

    Every string that waits in the tree carries the length of the prefix it is known to
    share with the last string put out.  The longer that prefix, the smaller the string; only
    strings with equal lengths are compared, from there on.
    """

    def __init__(self, runs: list[tuple[list[int], list[bytes]]]):
        self.runs = runs
        size = 1
        while size < len(runs):
            size *= 2
        self.size = size
        self.at = [0] * size
        self.head: list[bytes | None] = [r[1][0] if r[1] else None for r in runs] + [None] * (size - len(runs))
        self.known = [0] * size
        self.losers = [0] * size
        self.best = self._build(1)

    def _beats(self, a: int, b: int) -> tuple[int, int]:
        """(winner, loser) of two runs; the loser then knows the prefix it shares with the winner."""
        x, y = self.head[a], self.head[b]
        if x is None or y is None:
            return (b, a) if x is None else (a, b)
        p, q = self.known[a], self.known[b]
        if p != q:
            return (a, b) if p > q else (b, a)
        n = common(x, y, p)
        winner, loser = (a, b) if x[n:n + 1] < y[n:n + 1] or (n == len(x) == len(y) and a < b) else (b, a)
        self.known[loser] = n
        return winner, loser

    def _build(self, node: int) -> int:
        if node >= self.size:
            return node - self.size
        winner, self.losers[node] = self._beats(self._build(2 * node), self._build(2 * node + 1))
        return winner

    def __iter__(self) -> Iterator[tuple[int, int, int, bytes]]:
        """(run, place in it, prefix shared with the string before, string) in order."""
        while (string := self.head[self.best]) is not None:
            run = self.best
            place, known = self.at[run], self.known[run]
            yield run, place, known, string
            shared, rests = self.runs[run]
            place += 1
            self.at[run] = place
            if place < len(rests):
                self.head[run] = string[:shared[place]] + rests[place]
                self.known[run] = shared[place]
            else:
                self.head[run] = None
            winner, node = run, (run + self.size) // 2
            while node:
                winner, self.losers[node] = self._beats(winner, self.losers[node])
                node //= 2
            self.best = winner


def repeats_in_class(lefts: list[bytes], shared: list[int]) -> Iterator[tuple[int, int, int]]:
    """(member, from, to): offsets of windows before the anchor that another member repeats.

    lefts: what stands before each anchor, reversed; shared: the prefix each suffix shares with
    the one before it, in sorted order.  A window that starts o bytes before the anchor repeats
    if the lefts share o bytes and the suffixes SPAN - o.
    """
    m = len(lefts)
    for i in range(m):
        right = SPAN + GRAM * 8
        for j in range(i + 1, m):
            right = min(right, shared[j])
            if right < GRAM:
                break
            left = common(lefts[i], lefts[j])
            if left + right >= SPAN:
                yield i, max(0, SPAN - right), left
                yield j, max(0, SPAN - right), left


def repeats_by_offset(lefts: list[bytes], suffixes: list[bytes]) -> Iterator[tuple[int, int, int]]:
    """What repeats_in_class gives, by comparing at each offset the hashes of all members' windows."""
    raw = np.frombuffer(b"".join([x for left, s in zip(lefts, suffixes, strict=True) for x in (left[::-1], s)]), np.uint8)
    hashed = Hashed(raw)
    n_left, n_right = (np.array([len(x) for x in xs]) for xs in (lefts, suffixes))
    anchor = np.cumsum(n_left + n_right) - n_right
    again = np.zeros((int(n_left.max()) + 1, len(lefts)), bool)
    for o in range(len(again)):
        there = np.flatnonzero((n_left >= o) & (n_right >= SPAN - o))
        _, which, times = np.unique(hashed.of(anchor[there] - o, anchor[there] - o + SPAN), return_inverse=True, return_counts=True)
        again[o, there] = times[which] > 1
    edge = np.diff(np.pad(again.T.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    (i, lo), (_, hi) = np.nonzero(edge == 1), np.nonzero(edge == -1)
    yield from zip(i.tolist(), lo.tolist(), (hi - 1).tolist(), strict=True)


def merged_repeats(reps: DataFrame, n_reps: int) -> DataFrame:
    """k, h, start, end of the bytes that repeat, from sparse suffixes (columns as ``sliced`` makes them)."""
    buckets = max(1, -(-n_reps // SUFFIXES_IN_BUCKET))
    run_types = arrow_schema(schema := (
        "bucket long, shared array<int>, rests array<binary>, lefts array<binary>, k array<long>, h array<long>, anchor array<long>"))

    def runs(batches):
        import pyarrow as pa

        held: list[tuple] = []

        def put():
            held.sort()
            of: dict[int, list[tuple]] = {}
            for x in held:
                of.setdefault(x[1], []).append(x)
            held.clear()
            for bucket, rows in of.items():
                shared, rests = front_coded([x[0] for x in rows])
                yield pa.RecordBatch.from_pydict({
                    "bucket": [bucket], "shared": [shared], "rests": [rests], "lefts": [[x[2] for x in rows]],
                    "k": [[x[3] for x in rows]], "h": [[x[4] for x in rows]], "anchor": [[x[5] for x in rows]],
                }, schema=run_types)

        for batch in batches:
            names = ("suffix", "gram", "left", "k", "h", "anchor")
            for suffix, gram, left, k, h, anchor in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                held.append((suffix, gram % buckets, left, k, h, anchor))
            if len(held) >= SUFFIXES_IN_RUN:
                yield from put()
        yield from put()

    end_types = arrow_schema(end_schema := "k long, h long, start long, end long")

    def merge(table):
        import pyarrow as pa

        out: dict[str, list] = {"k": [], "h": [], "start": [], "end": []}
        rows = {c: table.column(c).to_pylist() for c in table.schema.names}
        klass: list[tuple[int, int]] = []
        shared: list[int] = []
        strings: list[bytes] = []

        def close():
            if len(klass) > 1:
                lefts = [rows["lefts"][r][p] for r, p in klass]
                for i, lo, hi in repeats_in_class(lefts, shared) if len(klass) <= PAIRED else repeats_by_offset(lefts, strings):
                    r, p = klass[i]
                    out["k"].append(rows["k"][r][p])
                    out["h"].append(rows["h"][r][p])
                    out["start"].append(rows["anchor"][r][p] - hi)
                    out["end"].append(rows["anchor"][r][p] - lo + SPAN)
            klass.clear()
            shared.clear()
            strings.clear()

        for run, place, known, string in LoserTree(list(zip(rows["shared"], rows["rests"], strict=True))):
            if known < GRAM:
                close()
            klass.append((run, place))
            shared.append(known)
            strings.append(string)
        close()
        return pa.Table.from_pydict(out, schema=end_types)

    return reps.mapInArrow(runs, schema).groupBy("bucket").applyInArrow(merge, end_schema)


def sliced(docs: DataFrame, wanted: DataFrame, may) -> DataFrame:
    """gram, suffix (from the anchor on), left (before it, reversed), k, h, anchor of the wanted stretches; may: the bitmap of their rows, broadcast."""
    per_doc = wanted.groupBy("k", "h").agg(F.collect_list(F.struct("gram", "anchor", "start", "n")).alias("wanted"))
    texts = docs.where(F.octet_length("text") >= SPAN).where(in_bitmap(F.xxhash64("k", "h"), may)).select("k", "h", "text").join(per_doc, ["k", "h"])

    def run(batch):
        for text, k, h, stretches_ in zip(*(batch.column(c).to_pylist() for c in ("text", "k", "h", "wanted")), strict=True):
            raw = _bytes_of(text)
            yield {
                "gram": [s["gram"] for s in stretches_], "k": [k] * len(stretches_), "h": [h] * len(stretches_),
                "anchor": [s["anchor"] for s in stretches_],
                "suffix": [raw[s["anchor"]:s["start"] + s["n"] + SPAN - 1] for s in stretches_],
                "left": [raw[s["start"]:s["anchor"]][::-1] for s in stretches_],
            }

    return map_arrow(texts, run, "gram long, k long, h long, anchor long, suffix binary, left binary").dropDuplicates(["k", "h", "anchor"])


def counted_repeats(reps: DataFrame) -> DataFrame:
    """What merged_repeats gives, for anchor strings with too many stretches: every window is counted by its hash."""

    def windows(batch):
        names = ("suffix", "left", "k", "h", "anchor")
        for suffix, left, k, h, anchor in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
            raw = np.frombuffer(left[::-1] + suffix, np.uint8)
            at = np.arange(len(raw) - SPAN + 1)
            hashed = Hashed(raw)
            half = SPAN // 2
            yield {
                "a": hashed.of(at, at + half).view(np.int64), "b": hashed.of(at + half, at + SPAN).view(np.int64),
                "k": np.full(len(at), k), "h": np.full(len(at), h), "start": at + anchor - len(left),
            }

    rows = map_batched(reps.select("suffix", "left", "k", "h", "anchor"), windows, "a long, b long, k long, h long, start long")
    again = cut(rows.groupBy("a", "b").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("a", "b"))
    return rows.join(again, ["a", "b"]).select("k", "h", "start", (F.col("start") + SPAN).alias("end"))


def repeats(docs: DataFrame, most: int = MOST) -> DataFrame:
    """k, h, start, end: stretches of bytes to remove (they may overlap) of documents as ``keyed`` makes them."""
    grams = cut(repeated_grams(docs))
    send = docs.sparkSession.sparkContext.broadcast
    may = send(bitmap(grams.select(F.col("gram").alias("key"))))
    found = cut(repeated_stretches(docs, grams, may))
    may.unpersist()
    one = F.min(F.struct("k", "h", "anchor", "start", "n")).alias("one")
    distinct = cut(found.groupBy("gram", "whole").agg(F.count(F.lit(1)).alias("c"), one))
    # anchor strings with several stretches of which at least one occurs once: those are open
    open_ = cut(distinct.groupBy("gram").agg(F.count(F.lit(1)).alias("m"), F.min("c").alias("least")).where("m > 1 AND least = 1").select("gram", "m"))
    wanted = cut(distinct.join(open_, "gram").select("gram", "m", "one.*"))
    of_copies = found.join(distinct.where("c > 1").select("gram", "whole"), ["gram", "whole"]).select(
        "k", "h", "start", (F.col("start") + F.col("n") + SPAN - 1).alias("end"))
    may = send(bitmap(wanted.select(F.xxhash64("k", "h").alias("key"))))
    reps = cut(sliced(docs, wanted, may).join(open_, "gram"))
    may.unpersist()
    few = reps.where(F.col("m") <= most)
    many = reps.where(F.col("m") > most)
    out = of_copies.unionByName(merged_repeats(few, few.count()))
    return out if many.isEmpty() else out.unionByName(counted_repeats(many))


def merged_spans(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted maximal stretches that the spans cover."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            if b > out[-1][1]:
                out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def with_spans(docs: DataFrame, most: int = MOST) -> DataFrame:
    """doc_id, text and spans (array of struct<start, end>, perhaps overlapping; null if none) of every row."""
    docs = keyed(docs)
    spans = repeats(docs, most).groupBy("k", "h").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    return docs.join(spans, ["k", "h"], "left").select("doc_id", "text", "spans")


def removed(docs: DataFrame, most: int = MOST) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""

    def run(batch):
        out = {"doc_id": batch.column("doc_id"), "n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": []}
        for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
            raw = _bytes_of(text)
            gone = merged_spans((s["start"], s["end"]) for s in spans or ())
            kept, at = hashlib.sha256(), 0
            for a, b in [*gone, (len(raw), len(raw))]:
                kept.update(raw[at:a])
                at = b
            out["n_bytes"].append(len(raw))
            out["n_removed"].append(sum(b - a for a, b in gone))
            out["n_spans"].append(len(gone))
            out["kept_sha256"].append(kept.hexdigest())
        return out

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(with_spans(docs, most), run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op1_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removed(read(spark, sf_dir, "documents").select("doc_id", "text"))
