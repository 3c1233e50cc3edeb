"""Personal data: base patterns, and a skip-chain conditional random field over each document.

The nodes are the tokens of a document that hold a digit or an at sign, or repeat the key of
one that does.  Neighbouring nodes share chain potentials; nodes of the same key (the same
digits, or the same letters and digits in any case and punctuation) are linked at any
distance by skip potentials.  A key that a document holds three times or more also has a hub, a node
without a token that is linked to each of its occurrences, so that evidence reaches any of them over
two links.  Loopy belief propagation passes messages over all documents of a block at once until
they converge, so that repeated and similar tokens agree on their label; a token that
the base patterns miss is found through its look-alikes.  What the beliefs add has the
kinds ``crf_email`` and so on and never overlaps a base span.

The field is trained piece by piece, with the base patterns as teachers: each potential is the maximum-likelihood
one of its own piece (smoothed log ratios of counts), which has a closed form for potentials that are tables.
The counts are taken in Spark over all documents; looks are hashed into ``LOOKS`` slots, so that the model is of fixed size
and every look counts.

Defined results: a null or empty text has no spans; very long texts are searched whole;
repeated rows, and rows with a null id, each have their own result; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import collections
import itertools
import re
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import map_arrow, read
from .spans import Span, clear_of, digest, joined

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, *(f"crf_{k}" for k in BASE_KINDS))
LABELS = ("none", *BASE_KINDS)
LOOKS = 1 << 14
#: Belief from which a token counts, log weight of a base match, characters of text in a block.
SURE, CLAMP, BLOCK = 0.9, 12.0, 2_000_000
#: Step of a message, updates of a message after which its step shrinks, so that every run ends, and change that counts.
STEP, STEADY, TOLERANCE = 0.5, 100, 1e-3

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
#: A match can only start where a run of digits does, and never gives digits back, so that long runs take one pass.
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
#: A text that this does not find has no base match and no node.
WORTH = "[0-9@]"
EDGES = ".,;:!?\"'|()[]{}<>*#$%&"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join([c for c in text if "0" <= c <= "9"])


def emails(text: str) -> list[Span]:
    """The matches of EMAIL from left to right; the search starts near each at sign, where alone one can be."""
    out, end = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and (text[start - 1].isascii() and (text[start - 1].isalnum() or text[start - 1] in "._%+-")):
            start -= 1
        if start < at and (m := EMAIL.match(text, start)):
            out.append(("email", *m.span()))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    return out


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each kind, failing ones dropped."""
    out: list[Span] = emails(text)
    for m in IP.finditer(text):
        if all(int(x) <= 255 if len(x) < 10 else not x[:-3].strip("0") and int(x[-3:]) <= 255 for x in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        d = digits_of(m[0])
        if 12 <= len(d) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(digits_of(m[0])) <= 15]
    return out


def shape(token: str) -> str:
    """A token's look: runs of digits by length, letters as a, other characters as they are."""
    out = []
    for c, run in itertools.groupby(token, key=lambda c: "9" if "0" <= c <= "9" else "a" if c.isalpha() else c):
        n = sum(1 for _ in run)
        out.append(f"9{min(n, 20)}" if c == "9" else c)
    return "".join(out[:12])


def key_of(token: str) -> str | None:
    """What similar tokens have in common; None if the token is too short to tell."""
    d = digits_of(token)
    if len(d) >= 7 and "@" not in token:
        return d
    k = "".join([c for c in token.lower() if c.isalnum() or c == "@"])
    return k if len(k) >= 5 else None


class Nodes:
    """The nodes and links of the documents of a block."""

    def __init__(self):
        self.doc, self.span, self.look, self.label, self.chain, self.skip = [], [], [], [], [], []
        self.hub: list[list[int]] = []  # the occurrences of each hub's key

    def add(self, doc: int, text: str, base: list[Span]) -> None:
        covers = sorted(base, key=lambda s: (s[1], BASE_KINDS.index(s[0])))
        tokens = [(m.start(), m.end(), m[0]) for m in TOKEN.finditer(text)]
        marked = [any("0" <= c <= "9" or c == "@" for c in t) for _, _, t in tokens]
        keys = {k for (_, _, t), x in zip(tokens, marked, strict=True) if x and (k := key_of(t))}
        last_of: dict[str, int] = {}
        of_key: dict[str, list[int]] = {}
        last, c = -2, 0
        for i, (a, b, token) in enumerate(tokens):
            k = key_of(token) if marked[i] or keys else None
            if not marked[i] and k not in keys:
                continue
            while c < len(covers) and covers[c][2] <= a:
                c += 1
            label = next((s[0] for s in covers[c:c + 4] if s[1] < b and a < s[2]), "none")
            lead = len(token) - len(token.lstrip(EDGES))
            core = token.strip(EDGES)
            n = len(self.doc)
            self.doc.append(doc)
            self.span.append((a + lead, a + lead + len(core)))
            self.look.append(slot(shape(core)))
            self.label.append(LABELS.index(label))
            if last == i - 1:
                self.chain.append((n - 1, n))
            if k is not None:
                if k in last_of and (last_of[k] != n - 1 or last != i - 1):  # neighbours share a chain potential already
                    self.skip.append((last_of[k], n))
                last_of[k] = n
                of_key.setdefault(k, []).append(n)
            last = i
        self.hub += [x for x in of_key.values() if len(x) > 2]


def slot(look: str) -> int:
    return zlib.crc32(look.encode("utf-8", "surrogatepass")) % LOOKS


def potentials(counts: list[tuple[str, int, int, int]]) -> tuple[dict[int, np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Unary potentials by slot of the look and of an unknown look, chain potentials, skip potentials.

    counts: ("look", slot, label, n), ("chain" or "skip", label, label, n).
    """
    m = len(LABELS)
    chain, skip, total = np.full((m, m), 0.5), np.eye(m) * 2 + 0.1, np.ones(m)
    looks: dict[int, np.ndarray] = {}
    for kind, a, b, n in counts:
        if kind == "look":
            looks.setdefault(a, np.zeros(m))[b] += n
            total[b] += n
        else:
            (chain if kind == "chain" else skip)[a, b] += n
    prior = total / total.sum()
    pmi = lambda x: np.clip(np.log(x / x.sum()) - np.log(x.sum(0) / x.sum()) - np.log(x.sum(1, keepdims=True) / x.sum()), -4, 4)
    return {k: np.log((v + prior) / (v.sum() + 1)) for k, v in looks.items()}, np.log(prior), pmi(chain), pmi(skip + skip.T)


def beliefs(nodes: Nodes, model) -> np.ndarray:
    """Label probabilities of each node by loopy sum-product message passing."""
    looks, prior, chain, skip = model
    n, hubs, m = len(nodes.doc), len(nodes.hub), len(LABELS)
    unary = np.concatenate([np.array([looks.get(x, prior) for x in nodes.look]).reshape(n, m), np.zeros((hubs, m))])
    label = np.array(nodes.label, int)
    known = np.flatnonzero(label)
    unary[known, label[known]] += CLAMP
    spokes = [(i, n + h) for h, members in enumerate(nodes.hub) for i in members]
    a = np.array([*nodes.chain, *nodes.skip, *spokes], int).reshape(-1, 2)
    e = len(a)
    src, dst = np.concatenate([a[:, 0], a[:, 1]]), np.concatenate([a[:, 1], a[:, 0]])
    # a spoke only costs disagreement: labels that agree gain nothing from one, whatever they are
    spoke = skip - (np.diag(skip)[:, None] + np.diag(skip)) / 2
    spoke = np.minimum(spoke, 0)
    kind = np.repeat([0, 1, 2], [len(nodes.chain), len(nodes.skip), len(spokes)])
    weights = np.exp(np.array([chain, skip, spoke, chain.T, skip.T, spoke.T]))
    kind = np.concatenate([kind, kind + 3])
    back = np.concatenate([np.arange(e, 2 * e), np.arange(e)])
    messages, updates = np.zeros((2 * e, m)), np.zeros(2 * e, int)
    total = unary.copy()
    live = np.arange(2 * e)
    while len(live):
        out = total[src[live]] - messages[back[live]]
        out = np.exp(out - out.max(1, keepdims=True))
        new = np.log(np.einsum("ei,eij->ej", out, weights[kind[live]]))
        updates[live] += 1
        step = STEP * np.minimum(1, STEADY / updates[live]) ** 2
        change = step[:, None] * (new - new.max(1, keepdims=True) - messages[live])
        messages[live] += change
        total += np.stack([np.bincount(dst[live], change[:, k], n + hubs) for k in range(m)], 1)
        far = live[np.abs(change).max(1) > TOLERANCE]
        awake = np.zeros(n + hubs, bool)
        awake[src[far]] = awake[dst[far]] = True
        live = np.flatnonzero(awake[src])
    total = total[:n]
    p = np.exp(total - total.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def crf_spans(block: list[tuple[str, list[Span]]], model) -> list[list[Span]]:
    """What the field adds to each text of a block."""
    nodes = Nodes()
    for i, (text, base) in enumerate(block):
        if text:
            nodes.add(i, text, base)
    out: list[list[Span]] = [[] for _ in block]
    if nodes.doc:
        p = beliefs(nodes, model)
        best = p.argmax(1)
        for k in np.flatnonzero((best > 0) & (p.max(1) >= SURE) & (np.array(nodes.label) == 0)).tolist():
            doc, (a, b) = nodes.doc[k], nodes.span[k]
            if a < b and clear_of(a, b, block[doc][1]):
                out[doc].append((f"crf_{LABELS[best[k]]}", a, b))
    return out


def worth(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.when(F.col("text").rlike(WORTH), F.col("text")).alias("text"))


def fit(docs: DataFrame):
    """The field's potentials, from counts over all documents; at most LOOKS x labels rows and two tables of labels come back."""

    def run(batch):
        counts: collections.Counter = collections.Counter()
        for text in batch.column("text").to_pylist():
            nodes = Nodes()
            nodes.add(0, text, base_spans(text))
            counts.update([("look", x, y) for x, y in zip(nodes.look, nodes.label, strict=True)])
            counts.update([(kind, nodes.label[i], nodes.label[j]) for kind, links in (("chain", nodes.chain), ("skip", nodes.skip)) for i, j in links])
        columns = list(zip(*counts, strict=True)) or [(), (), ()]
        return {"kind": columns[0], "a": columns[1], "b": columns[2], "n": list(counts.values())}

    counted = map_arrow(docs.where(F.col("text").rlike(WORTH)).select("text"), run, "kind string, a int, b int, n long")
    summed = counted.groupBy("kind", "a", "b").agg(F.sum("n").alias("n"))
    return potentials([tuple(r) for r in summed.collect()])


def find(docs: DataFrame, model) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch):
        out = {k: [] for k in ("n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")}
        block: list[tuple[str, list[Span]]] = []

        def flush():
            for (_, base), more in zip(block, crf_spans(block, shared.value), strict=True):
                for kind in BASE_KINDS:
                    out[f"n_{kind}"].append(sum(s[0] == kind for s in base))
                out["base_sha256"].append(digest(base, KINDS))
                out["spans"].append(joined(base + more, KINDS))
            block.clear()

        size = 0
        for text in batch.column("text").to_pylist():
            block.append((text or "", base_spans(text) if text else []))
            size += len(text or "")
            if size >= BLOCK:
                flush()
                size = 0
        flush()
        return {"doc_id": batch.column("doc_id"), **out}

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(
        worth(docs), run,
        f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string",
    )


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return find(docs, fit(docs))
