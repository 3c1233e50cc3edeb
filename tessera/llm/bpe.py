"""Byte-level BPE encoding and decoding by corpus-level merge replay.

Each task takes its slice of the corpus, gathers the distinct pieces of many documents,
and replays the merges over all of them at once: an inverted index leads from the rank of
a token pair to the places in the pieces where that pair stands; ranks come off a heap in
order, each place is merged, and only the two touched neighbours enter the index anew.
A document is then the concatenation of its pieces' ids.  There is no shuffle; the
vocabulary, a file of fixed size, is read on the driver and broadcast.

A text is first cut at white space, which no match of the piece pattern crosses but for
one leading blank, so that each distinct chunk is matched and merged once.

Defined results: a null text is empty and has no ids; empty documents hash the empty
string; whole texts are encoded whatever their length; repeated rows repeat their result;
an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import itertools
import re
from collections.abc import Iterable
from struct import pack

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from ._common import map_arrow, read, tokenizer_file

VOCABULARY = "byte_bpe_50k.tiktoken"
#: White space as the pattern means it (Unicode's White_Space).
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Plain words before white space or a mark that no pattern joins to them come first, so that chunks differ less.
LATIN = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff"
CHUNK = rf" ?[{LATIN}]++(?=[{SPACE}.,;:!?|]|\Z)| ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
#: Bytes of chunks and their ids, and pairs, that a task keeps (they end with it), and characters of text it takes on at a time.
KEPT_BYTES, KEPT_PAIRS, TEXT_AT_ONCE = 64_000_000, 300_000, 1_000_000
#: About what a chunk and its ids take beside their bytes.
OBJECTS = 180


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def replay(pieces: list[bytes], ranks: dict[bytes, int], tokens: list[bytes], pairs: dict[int, int]) -> list[list[int]]:
    """The ids of each piece.

    tokens: bytes of each id.  pairs: what a pair of ids (first << 32 | second) merges to, -1 if to nothing;
    filled on the way.
    """
    text = b"".join(pieces)
    n = len(text)
    edges = np.cumsum([0, *map(len, pieces)])
    first = np.array([ranks[bytes([b])] for b in range(256)], np.int64)[np.frombuffer(text, np.uint8)]
    keys = first[:-1] << 32 | first[1:]
    distinct, which = np.unique(keys, return_inverse=True)
    made = [ranks.get(tokens[k >> 32] + tokens[k & 0xFFFFFFFF], -1) for k in distinct.tolist()]
    rank_at = np.append(np.array(made, np.int64)[which] if n > 1 else np.empty(0, np.int64), -1)[:n]  # of the pair that starts at each place
    rank_at[edges[1:] - 1] = -1
    order = np.argsort(rank_at, kind="stable")
    cuts = np.flatnonzero(np.diff(rank_at[order], prepend=-1))
    index = {}  # the inverted index: rank of a pair -> places of its first token
    for lo, hi in itertools.pairwise([*cuts.tolist(), n]):
        index[int(rank_at[order[lo]])] = order[lo:hi].tolist()
    ids, rank_at = first.tolist(), rank_at.tolist()
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        if lo < hi:
            before[lo] = after[hi - 1] = -1
    heap = list(index)
    heapq.heapify(heap)
    find, push, pop = pairs.get, heapq.heappush, heapq.heappop
    while heap:
        rank = pop(heap)
        places = index.pop(rank, None)
        if places is None:
            continue
        if len(places) > 1:
            places.sort()
        for at, i in enumerate(places):
            if rank_at[i] != rank:  # one of its tokens has been merged since
                continue
            j = after[i]
            k = after[i] = after[j]
            ids[i], ids[j], rank_at[j] = rank, -1, -1
            lower, touched = False, -1
            if k >= 0:
                before[k] = i
                key = rank << 32 | ids[k]
                if (touched := find(key)) is None:
                    touched = pairs[key] = ranks.get(tokens[rank] + tokens[ids[k]], -1)
                if touched >= 0:
                    lower = touched < rank
                    if (waiting := index.get(touched)) is not None:
                        waiting.append(i)
                    else:
                        index[touched] = [i]
                        push(heap, touched)
            rank_at[i] = touched
            if (h := before[i]) >= 0:
                key = ids[h] << 32 | rank
                if (touched := find(key)) is None:
                    touched = pairs[key] = ranks.get(tokens[ids[h]] + tokens[rank], -1)
                if touched >= 0:
                    lower |= touched < rank
                    if (waiting := index.get(touched)) is not None:
                        waiting.append(h)
                    else:
                        index[touched] = [h]
                        push(heap, touched)
                rank_at[h] = touched
            if lower and at + 1 < len(places):  # the new pair goes first; the rest of these places waits
                if rank in index:
                    index[rank].extend(places[at + 1:])
                else:
                    index[rank] = places[at + 1:]
                    push(heap, rank)
                break
    return [[t for t in ids[lo:hi] if t >= 0] for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]


class Codec:
    """Encodes and decodes texts; ids pass as little-endian unsigned 32-bit integers."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks = ranks
        self.tokens: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.pairs: dict[int, int] = {}
        self.chunks = re.compile(CHUNK).findall
        spaces = pattern.replace(r"[^\s", "[^" + SPACE).replace(r"\S", f"[^{SPACE}]").replace(r"\s", f"[{SPACE}]")
        self.pieces = regex.compile(spaces).findall
        self.known: dict[str, bytes] = {}
        self.held = 0  # bytes in known

    def learn(self, chunks: Iterable[str]) -> None:
        """Replays the merges over the distinct pieces of all these chunks."""
        split = [(c, [c] if c.isalpha() or c[1:].isalpha() and c[0] == " " else self.pieces(c)) for c in chunks]
        distinct = list({p for _, ps in split for p in ps}.difference(self.known))
        as_bytes = [p.encode("utf-8", "surrogatepass") for p in distinct]
        ids = {p: one.to_bytes(4, "little") for p, b in zip(distinct, as_bytes, strict=True) if (one := self.ranks.get(b)) is not None}
        rest = [(p, b) for p, b in zip(distinct, as_bytes, strict=True) if p not in ids]
        for (p, _), found in zip(rest, replay([b for _, b in rest], self.ranks, self.tokens, self.pairs), strict=True):
            ids[p] = pack(f"<{len(found)}I", *found)
        self.known |= ids
        known = self.known
        self.held += sum([len(p) + len(x) + OBJECTS for p, x in ids.items()])
        for c, ps in split:
            if len(ps) > 1:
                known[c] = made = b"".join([known[p] for p in ps])
                self.held += len(c) + len(made) + OBJECTS

    def encode_all(self, texts: list[str]) -> list[bytes]:
        found = [self.chunks(t) for t in texts]
        if self.held > KEPT_BYTES:
            self.known.clear()
            self.held = 0
        if len(self.pairs) > KEPT_PAIRS:
            self.pairs.clear()
        new = set().union(*found).difference(self.known)
        if new:
            self.learn(new)
        get = self.known.__getitem__
        return [b"".join(map(get, chunks)) for chunks in found]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def in_blocks(texts: list[str | None]) -> Iterable[list[str]]:
    block, size = [], 0
    for t in texts:
        block.append(t or "")
        size += len(block[-1])
        if size >= TEXT_AT_ONCE:
            yield block
            block, size = [], 0
    if block:
        yield block


def _vocabulary(spark: SparkSession, path: str | None):
    from public_tokenizers import PATTERN

    ranks = read_ranks(path or tokenizer_file(VOCABULARY))
    return spark.sparkContext.broadcast((ranks, PATTERN))


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and ids, an array of token ids; path: a rank file in tiktoken's format."""
    shared = _vocabulary(docs.sparkSession, path)

    def run(batch, made):
        at = 0
        for texts in in_blocks(batch.column("text").to_pylist()):
            ids = [np.frombuffer(x, "<u4").astype("i4") for x in made.encode_all(texts)]
            yield {"doc_id": batch.column("doc_id").slice(at, len(texts)), "ids": ids}
            at += len(texts)

    return map_arrow(docs.select("doc_id", "text"), run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>", lambda: Codec(*shared.value))


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and bytes from doc_id and ids; null ids are empty."""
    shared = _vocabulary(encoded.sparkSession, path)

    def run(batch, made):
        return {"doc_id": batch.column("doc_id"), "bytes": [made.decode(np.array(x or [], "<u4").tobytes()) for x in batch.column("ids").to_pylist()]}

    return map_arrow(encoded.select("doc_id", "ids"), run, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, bytes binary", lambda: Codec(*shared.value))


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each document, encoded and decoded in one pass."""
    shared = _vocabulary(docs.sparkSession, path)
    sha = lambda b: hashlib.sha256(b).hexdigest()

    def run(batch, made):
        at = 0
        for texts in in_blocks(batch.column("text").to_pylist()):
            ids = made.encode_all(texts)
            yield {
                "doc_id": batch.column("doc_id").slice(at, len(texts)), "n_tokens": [len(x) // 4 for x in ids],
                "ids_sha256": [sha(x) for x in ids], "decoded_sha256": [sha(made.decode(x)) for x in ids],
            }
            at += len(texts)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(docs.select("doc_id", "text"), run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string", lambda: Codec(*shared.value))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(read(spark, sf_dir, "documents"))
